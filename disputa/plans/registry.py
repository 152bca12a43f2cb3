"""Imports every module that registers queries."""

from disputa.plans import graph_queries, source_queries, table_queries  # noqa: F401
from disputa.plans.catalog import ORACLES, QUERIES  # noqa: F401
