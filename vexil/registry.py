"""All queries of the vector engine and their SQL."""

from __future__ import annotations

from vexil import catalog, catalog_index, catalog_labels, catalog_sweeps

#: The modules that register queries with the catalog when they are read.
MODULES = (catalog, catalog_index, catalog_labels, catalog_sweeps)
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
