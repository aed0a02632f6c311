"""SQLite databases through Spark's data source interface."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quarrystone.config import EngineError
from quarrystone.functions.frames import ship
from quarrystone.sources.providers import as_records


def as_text(value: Any) -> str | None:
    """A value as text: blobs as UTF-8, NULL if they are none."""
    if isinstance(value, bytes):
        try:
            return value.decode()
        except UnicodeDecodeError:
            return None
    return None if value is None else str(value)


def _open(path: str) -> sqlite3.Connection:
    try:
        return sqlite3.connect(f"{Path(path).absolute().as_uri()}?mode=ro", uri=True)
    except sqlite3.Error as e:
        raise EngineError("openFailed", f"{path}: {e}") from e


class _Slice(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        """One, or ranges of an integer column (partition_column, partitions) so that a large table is read in parallel."""
        column, n = self.options.get("partition_column"), int(self.options.get("partitions", "1"))
        if not column or n < 2:
            return [_Slice(None, None)]
        con = _open(self.options["path"])
        low, high = con.execute(f"SELECT min({column}), max({column}) FROM ({self.options['query']})").fetchone()
        con.close()
        if low is None:
            return [_Slice(None, None)]
        edges = [low + (high + 1 - low) * k // n for k in range(n + 1)]
        return [_Slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        con = _open(self.options["path"])
        query, args = self.options["query"], ()
        if partition.low is not None:
            query = f"SELECT * FROM ({query}) WHERE {self.options['partition_column']} >= ? AND {self.options['partition_column']} < ?"
            args = (partition.low, partition.high)
        text = [f.dataType.typeName() == "string" for f in self.schema.fields]
        try:
            for row in con.execute(query, args):
                yield tuple(as_text(v) if t else v for v, t in zip(row, text, strict=True))
        finally:
            con.close()


class SQLiteSource(DataSource):
    """format("sqlite_query") with options path, query and optionally partition_column and partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_query"

    def schema(self) -> str:
        """Columns of the query, with the types of the first row; text where that is NULL or there is none."""
        con = _open(self.options["path"])
        try:
            cursor = con.execute(self.options["query"])
        except sqlite3.Error as e:
            raise EngineError("prepareFailed", str(e)) from e
        first = cursor.fetchone()
        con.close()
        kinds = {int: "bigint", float: "double", bytes: "binary"}
        types = [kinds.get(type(v), "string") for v in first] if first else ["string"] * len(cursor.description)
        return ", ".join(f"`{d[0]}` {t}" for d, t in zip(cursor.description, types, strict=True))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def read_sqlite(spark: SparkSession, path: str, query: str, schema: str | None = None, **options: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(SQLiteSource)
    reader = spark.read.format("sqlite_query").options(path=path, query=query, **options)
    return (reader.schema(schema) if schema else reader).load()


@dataclass(frozen=True)
class SQLiteProvider:
    """Records from a query on a SQLite database."""

    path: str
    query: str
    mapping: dict[str, str | Column] = field(default_factory=dict)

    def load(self, spark: SparkSession) -> DataFrame:
        return as_records(read_sqlite(spark, self.path, self.query), self.mapping)
