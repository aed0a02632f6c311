"""Queries of the core operators over the driver's tables, with equivalent SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrystone.plans import data_queries, search_queries

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (search_queries, data_queries)
QUERIES: dict[str, Query] = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
