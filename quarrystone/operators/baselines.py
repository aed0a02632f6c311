"""Other ways to answer the same query, for comparison, and their timing."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.config import NO_REUSE, NOTHING_TO_REUSE, EngineError, FileQuery, IndexConfig, Mode, RecordIndexConfig, RecordQuery
from quarrystone.functions.matching import is_insensitive
from quarrystone.operators import search
from quarrystone.operators.files import FileIndex, as_text_files, search_files
from quarrystone.operators.records import units
from quarrystone.operators.store import Generations, RecordIndex
from quarrystone.sources.crawl import crawl

Progress = Callable[[str, str], None]


def tag_text(tags: Column) -> Column:
    """Tags as |a|b|, sorted."""
    return F.concat(F.lit("|"), F.array_join(F.array_sort(tags), "|"), F.lit("|"))


def _scope(q: RecordQuery) -> Column:
    """Tags in any case here, as in full-text tables."""
    scope = F.lit(True)
    if q.collections:
        scope &= F.col("collection").isin(*q.collections)
    if q.fields:
        scope &= F.col("field").isin(*q.fields)
    for tag in q.required_tags:
        scope &= F.lower(tag_text(F.col("tags"))).contains(f"|{tag.lower()}|")
    return scope


def _distinct(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct("record_id").alias("matched_records"))


def trigram_phrase(records: DataFrame, q: RecordQuery) -> DataFrame:
    """A phrase in a table of trigrams: case never matters, and fewer than three characters match nothing."""
    text = F.lower("text")
    hit = text.contains(q.text.lower()) if len(q.text) >= 3 else F.lit(False)
    return _distinct(units(records).where(_scope(q) & hit))


def contains_like(records: DataFrame, q: RecordQuery) -> DataFrame:
    """CONTAINS; without regard to case and accents if the query ignores case."""
    if not q.text:
        return _distinct(units(records).where("false"))
    if is_insensitive(q.text, q.case_insensitive, q.smart_case):
        hit = F.contains(F.collate("text", "UNICODE_CI_AI"), F.collate(F.lit(q.text), "UNICODE_CI_AI"))
    else:
        hit = F.col("text").contains(q.text)
    return _distinct(units(records).where(_scope(q) & hit))


def wildcard(records: DataFrame, q: RecordQuery) -> DataFrame:
    """*text*; ignoring case if the query does."""
    literal = q.text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    like = F.col("text").ilike if is_insensitive(q.text, q.case_insensitive, q.smart_case) else F.col("text").like
    return _distinct(units(records).where(_scope(q) & (like(f"%{literal}%") if literal else F.lit(False))))


ENGINES: dict[str, Callable[[DataFrame, RecordQuery], DataFrame]] = {
    "trigram_phrase": trigram_phrase,
    "contains": contains_like,
    "wildcard": wildcard,
    "scan": search.naive_count,
}
RESULT = "engine string, build_ms double, query_ms double, matched_records long, available boolean, note string, speedup double"


def available(q: RecordQuery, engine: str) -> bool:
    """Only the scan and the index take regular expressions."""
    return q.mode is Mode.LITERAL or engine in ("scan", "index")


def compare(records: DataFrame, q: RecordQuery) -> DataFrame:
    """engine, matched_records, available of all engines as one table, without timing."""
    out = None
    for name, engine in ENGINES.items():
        ok = available(q, name)
        row = engine(records, q) if ok else records.sparkSession.range(1).select(F.lit(None).cast("long").alias("matched_records"))
        row = row.select(F.lit(name).alias("engine"), "matched_records", F.lit(ok).alias("available"))
        out = row if out is None else out.unionByName(row)
    return out


def benchmark_records(spark: SparkSession, records: DataFrame, q: RecordQuery, config: RecordIndexConfig = RecordIndexConfig(), reuse: bool = False, progress: Progress = lambda phase, message: None) -> DataFrame:
    """A row per engine: build and query milliseconds, matched records, whether it can take the query, and how many times
    faster than the scan it was (NULL if either was not measured)."""
    ms = lambda began: (time.perf_counter() - began) * 1000
    progress("prepare", "opening the index")
    if reuse:
        if config.storage is None:
            raise EngineError(NO_REUSE, "only a stored index can be used again")
        if Generations(spark, config.storage).current() is None:
            raise EngineError(NOTHING_TO_REUSE, f"there is no index at {config.storage}")
    began = time.perf_counter()
    index = RecordIndex(spark, config)
    if not reuse:
        progress("build", "index")
        index.replace_all(records)
    built = 0.0 if reuse else ms(began)
    rows = []
    progress("query", "index")
    began = time.perf_counter()
    n = index.search(q, "indexed")[1].first().matched_record_count
    rows.append(("index", built, ms(began), n, True, ""))
    for name, engine in ENGINES.items():
        progress("query", name)
        if not available(q, name):
            rows.append((name, None, None, None, False, "takes literals only"))
            continue
        began = time.perf_counter()
        n = engine(records, q).first().matched_records
        rows.append((name, None, ms(began), n, True, ""))
    progress("done", "")
    scan = next((r[2] for r in rows if r[0] == "scan"), None)
    return spark.createDataFrame([(*r, scan / r[2] if scan and r[2] else None) for r in rows], RESULT)


def benchmark_files(spark: SparkSession, root: str, pattern: str, q: FileQuery = FileQuery(), config: IndexConfig = IndexConfig()) -> DataFrame:
    """One row: file_count, build_ms, indexed_ms, scan_ms, indexed_matches, scan_matches, speedup (NULL if not measured)."""
    began = time.perf_counter()
    index = FileIndex.build(spark, root, config)
    files = index.postings.agg(F.count_distinct("chunk_id")).first()
    built = (time.perf_counter() - began) * 1000
    del files
    began = time.perf_counter()
    indexed = index.search(pattern, q, "indexed").matches().count()
    a = (time.perf_counter() - began) * 1000
    began = time.perf_counter()
    scanned = search_files(as_text_files(crawl(spark, root, config)), pattern, q).matches().count()
    b = (time.perf_counter() - began) * 1000
    row = (index.files.count(), built, a, b, indexed, scanned, b / a if a else None)
    return spark.createDataFrame([row], "file_count long, build_ms double, indexed_ms double, scan_ms double, indexed_matches long, scan_matches long, speedup double")
