"""DataFrame operators over vectors, access grants, queries and recorded runs."""
