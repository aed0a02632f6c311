"""Records to searchable units and chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.config import CHUNK_COUNT_BUDGET, CHUNK_TOO_LARGE, RESIDENT_BUDGET, ChunkingConfig, EngineError, MemoryBudget
from quarrystone.functions.frames import cut, python_batches

RECORD_SCHEMA = "id string, collection string, title string, body string, fields map<string,string>, tags array<string>, metadata map<string,string>, updated_at_epoch_seconds bigint"
CHUNK_SCHEMA = "chunk_id bigint, record_id string, collection string, field string, ordinal int, updated_at_epoch_seconds bigint, text string, tags array<string>, metadata map<string,string>"
CHUNK_COLUMNS = tuple(c.split()[0] for c in CHUNK_SCHEMA.split(", "))


def searchable_fields() -> Column:
    """array<struct<field, text>>: title, body, then the fields by name; NULL and empty texts are left out."""
    pair = lambda name, text: F.struct(F.lit(name).alias("field"), text.alias("text"))
    named = F.transform(F.array_sort(F.map_keys(F.coalesce("fields", F.create_map().cast("map<string,string>")))), lambda k: F.struct(k.alias("field"), F.element_at("fields", k).alias("text")))
    return F.filter(F.concat(F.array(pair("title", F.col("title")), pair("body", F.col("body"))), named), lambda x: x["text"] != "")


def units(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per record and searchable field: record_id, collection, field, field_no, text, tags, metadata, time; and
    further columns of the records to keep. Others are dropped, so they cannot clash."""
    read = records.select("id", "collection", "tags", "metadata", "updated_at_epoch_seconds", *keep, F.posexplode(searchable_fields()).alias("field_no", "unit"))
    return read.select(
        F.col("id").alias("record_id"), "collection", F.col("unit.field").alias("field"), "field_no", F.col("unit.text").alias("text"), "tags", "metadata", "updated_at_epoch_seconds", *keep
    )


def chunk_text(text: str, config: ChunkingConfig) -> list[str]:
    """Segments of a text: whole if it fits, else cut after the last break character that fits, trimmed, each but the
    first beginning up to overlap_bytes before the cut, leading blanks skipped. The next segment always begins later
    than the one before, so that every text comes to an end."""
    size = np.frombuffer(text.encode("utf-32-le"), "<u4")
    at = np.concatenate(([0], np.cumsum(1 + (size >= 0x80).astype(np.int64) + (size >= 0x800) + (size >= 0x10000))))
    if at[-1] <= config.max_chunk_bytes:
        return [text]
    out, start, n = [], 0, len(text)
    while start < n:
        end = int(np.searchsorted(at, at[start] + config.max_chunk_bytes, side="right")) - 1
        if end < n:
            best = max((text.rfind(b, start, end) + len(b) for b in config.break_characters if text.rfind(b, start, end) >= 0), default=0)
            end = best if best > start else end
        segment = text[start:end].strip()
        if segment:
            out.append(segment)
        if end >= n:
            break
        back = int(np.searchsorted(at, at[end] - config.overlap_bytes, side="left"))
        start = back if start < back < end else end
        while start < n and text[start].isspace():
            start += 1
    return out


def _chunker(config: ChunkingConfig):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: chunk_text(t, config), na_action="ignore")

    return F.pandas_udf(run, "array<string>")


def chunk_rows(records: DataFrame, config: ChunkingConfig = ChunkingConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks without ids, in one pass. Only texts over the limit leave the JVM; the others are one chunk each, as they
    are."""
    python_batches(records.sparkSession)
    rows = units(records, keep)
    over = F.octet_length("text") > config.max_chunk_bytes
    cut_ = rows.withColumn("segments", F.coalesce(_chunker(config)(F.when(over, F.col("text"))), F.array("text"))).drop("text")
    return cut_.select("record_id", "collection", "field", "field_no", "updated_at_epoch_seconds", "tags", "metadata", *keep, F.posexplode("segments").alias("ordinal", "text")).where("text <> ''")


def numbered(rows: DataFrame, order: list[str], name: str = "chunk_id", start: int = 0, kept: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Consecutive ids in a total order, without sorting everything in one task: ranges are sorted where they lie, and
    only their sizes meet. The sorted rows are kept, so that every reading sees the same ids: in the shared folder, or
    as `kept` does it."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = F.lit((1 << 33) - 1)
    placed = kept(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__n", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__n", 33)).withColumn("__in", F.col("__n").bitwiseAND(low))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows")).select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__in") + F.lit(start)).drop("__n", "__part", "__in", "__before")


def chunk_records(records: DataFrame, config: ChunkingConfig = ChunkingConfig(), start: int = 0, by: str | None = None, kept: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Chunks with ids in the order of records (by the column `by`, else by key), fields and ordinals."""
    order = ["collection", "record_id"] if by is None else [by]
    rows = chunk_rows(records, config, () if by is None else (by,))
    return numbered(rows, [*order, "field_no", "ordinal"], start=start, kept=kept).select(*CHUNK_COLUMNS)


def renumbered(chunks: DataFrame, start: int = 0, kept: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Chunks with new ids by collection, record, field and ordinal."""
    rows = chunks.withColumnRenamed("chunk_id", "__old")
    return numbered(rows, ["collection", "record_id", "field", "ordinal", "__old"], start=start, kept=kept).select(*CHUNK_COLUMNS)


def latest_per_key(records: DataFrame, by: str) -> DataFrame:
    """Of rows with equal collection and id the one with the largest `by`, aggregated before the shuffle."""
    whole = F.struct(*(F.col(c) for c in records.columns))
    return records.groupBy("collection", "id").agg(F.max_by(whole, by).alias("r")).select("r.*")


def check_budget(chunks: DataFrame, budget: MemoryBudget) -> None:
    """Raises if chunks exceed a budget."""
    size = F.octet_length("text")
    r = chunks.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n"), F.max_by("record_id", size).alias("who"), F.coalesce(F.max(size), F.lit(0)).alias("largest")).first()
    if r.bytes > budget.max_resident_bytes:
        raise EngineError(RESIDENT_BUDGET, f"chunks hold {r.bytes} bytes, {budget.max_resident_bytes} are allowed")
    if r.n > budget.max_chunks:
        raise EngineError(CHUNK_COUNT_BUDGET, f"there are {r.n} chunks, {budget.max_chunks} are allowed")
    if r.largest > budget.max_chunk_bytes:
        raise EngineError(CHUNK_TOO_LARGE, f"a chunk of record {r.who} has {r.largest} bytes, {budget.max_chunk_bytes} are allowed")


def corpus_signature(records: DataFrame) -> DataFrame:
    """signature: 256 bits of the whole collection's searchable content, in the order of keys; metadata is no part.

    Each record is hashed where it lies; the hashes are folded by sums of 32-bit words, which needs no order of rows,
    as the key is in every hash.
    """
    text = F.to_json(F.struct("collection", "id", "title", "body", F.array_sort(F.map_entries("fields")).alias("fields"), "tags", "updated_at_epoch_seconds"))
    h = F.sha2(text, 256)
    sums = records.select(h.alias("h")).select(*(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)").alias(f"w{k}") for k in range(8)))
    return sums.agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"w{k}").alias(f"w{k}") for k in range(8))).select(F.sha2(F.concat_ws(",", "n", *(f"w{k}" for k in range(8))), 256).alias("signature"))
