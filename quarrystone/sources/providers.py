"""Sources of full sets of records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators.records import RECORD_SCHEMA


class Provider(Protocol):
    """Anything that loads records, as a table with the record columns."""

    def load(self, spark: SparkSession) -> DataFrame: ...


@dataclass(frozen=True)
class CallableProvider:
    """Records from a function that returns a table or a list of dictionaries."""

    function: Callable[[SparkSession], DataFrame | list[dict]]

    def load(self, spark: SparkSession) -> DataFrame:
        got = self.function(spark)
        return got if isinstance(got, DataFrame) else records_frame(spark, got)


@dataclass(frozen=True)
class TableProvider:
    """Records from any table that Spark reads, with a mapping of record columns to columns or expressions of it.

    What is not mapped and not there gets an empty value.
    """

    table: Callable[[SparkSession], DataFrame]
    mapping: dict[str, str | Column]

    def load(self, spark: SparkSession) -> DataFrame:
        return as_records(self.table(spark), self.mapping)


def as_records(df: DataFrame, mapping: dict[str, str | Column]) -> DataFrame:
    empty = {"fields": "map()", "metadata": "map()", "tags": "array()", "title": "NULL", "body": "''", "updated_at_epoch_seconds": "0"}
    out = []
    for column in RECORD_SCHEMA.split(", "):
        name, kind = column.split(" ", 1)
        value = mapping[name] if name in mapping else F.col(name) if name in df.columns else F.expr(empty[name])
        out.append((F.expr(value) if isinstance(value, str) else value).cast(kind).alias(name))
    return df.select(*out)


def records_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A table of records from dictionaries; missing parts are empty, a missing time is 0."""
    full = [
        (r["id"], r["collection"], r.get("title"), r.get("body", ""), r.get("fields") or {}, r.get("tags") or [], r.get("metadata") or {}, int(r.get("updated_at_epoch_seconds", 0)))
        for r in rows
    ]
    return spark.createDataFrame(full, RECORD_SCHEMA)
