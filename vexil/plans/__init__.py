"""Label predicates: parsing, and compilation to Spark columns and SQL."""
