"""All registered jobs and oracle statements."""

from __future__ import annotations

from plumbline.workloads import catalog, changes, governance, graphs, profiles, relational, streams
from plumbline.workloads import derived as V

_MODULES = (profiles, governance, changes, catalog, graphs, relational, streams)

QUERIES = {name: job for module in _MODULES for name, job in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}


def prepare(spark, sf: str) -> None:
    """Stores the metadata tables that jobs start from, and the catalog's search index: in real life they are there before a question is asked."""
    for table in (V.CATALOG_TABLES, V.CATALOG_COLUMNS, V.SQL_LOG, V.LINEAGE_EDGES):
        V.stored(spark, sf, table)
    catalog.catalog_index(spark, sf)
