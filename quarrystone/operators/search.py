"""Searching chunks of records: filter, verify, rank, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.config import IndexConfig, Mode, RecordQuery
from quarrystone.functions import matching
from quarrystone.operators.planner import Plan, ScanAll, plan_literal, plan_regex
from quarrystone.operators.postings import restricted
from quarrystone.operators.records import searchable_fields

HIT_COLUMNS = ("record_id", "collection", "field", "chunk_id", "ordinal", "excerpt", "score", "updated_at_epoch_seconds", "tags", "metadata")


@dataclass(frozen=True)
class Compiled:
    """A query as the engine runs it."""

    query: RecordQuery
    insensitive: bool
    plan: Plan

    @property
    def literal(self) -> bool:
        return self.query.mode is Mode.LITERAL

    def found(self, text: Column) -> Column:
        return matching.found(text, self.query.text, self.literal, self.insensitive)

    def count(self, text: Column) -> Column:
        return matching.count(text, self.query.text, self.literal, self.insensitive)

    def excerpt(self, text: Column) -> Column:
        return matching.excerpt(text, self.query.text, self.literal, self.insensitive)


def compiled(query: RecordQuery, config: IndexConfig = IndexConfig()) -> Compiled:
    insensitive = matching.is_insensitive(query.text, query.case_insensitive, query.smart_case)
    if insensitive or not query.prefilter:
        plan: Plan = ScanAll()
    else:
        make = plan_literal if query.mode is Mode.LITERAL else plan_regex
        plan = make(query.text, config.max_gram_length, config.max_covering_grams)
    return Compiled(query, insensitive, plan)


def in_scope(query: RecordQuery) -> Column:
    """Filters on collection, field and required tags; cheap ones, so they come before any look at the text."""
    scope = F.lit(True)
    if query.collections:
        scope &= F.col("collection").isin(*query.collections)
    if query.fields:
        scope &= F.col("field").isin(*query.fields)
    for tag in query.required_tags:
        scope &= F.array_contains("tags", tag)
    return scope


def candidates(chunks: DataFrame, c: Compiled, postings: DataFrame | None = None) -> DataFrame:
    """Chunks in scope; with postings, only those that the plan lets through."""
    return (chunks if postings is None else restricted(chunks, c.plan, postings)).where(in_scope(c.query))


def verified(chunks: DataFrame, c: Compiled, postings: DataFrame | None = None) -> DataFrame:
    """Candidates that match, with match_count and score."""
    score = F.col("match_count") * 1000.0 + F.col("updated_at_epoch_seconds") / 1e6
    hit = candidates(chunks, c, postings).where(c.found(F.col("text")))
    return hit.withColumn("match_count", c.count(F.col("text"))).withColumn("score", score)


def hits(chunks: DataFrame, query: RecordQuery, postings: DataFrame | None = None, config: IndexConfig = IndexConfig()) -> DataFrame:
    """The best hits, by score, then chunk id. Excerpts are made for them alone."""
    c = compiled(query, config)
    top = verified(chunks, c, postings).orderBy(F.desc("score"), "chunk_id").limit(query.max_results)
    return top.withColumn("excerpt", c.excerpt(F.col("text"))).select(*HIT_COLUMNS, "match_count")


def report(chunks: DataFrame, query: RecordQuery, postings: DataFrame | None = None, config: IndexConfig = IndexConfig()) -> DataFrame:
    """One row over all matches, before the limit: candidate_chunk_count, matched_record_count (distinct record ids,
    whatever the collection), total_match_count. One pass: candidates that do not match count as zero matches."""
    c = compiled(query, config)
    n = F.when(c.found(F.col("text")), c.count(F.col("text")))
    return candidates(chunks, c, postings).select("record_id", n.alias("n")).agg(
        F.count(F.lit(1)).alias("candidate_chunk_count"),
        F.count_distinct(F.when(F.col("n") > 0, F.col("record_id"))).alias("matched_record_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_match_count"),
    )


def naive_count(records: DataFrame, query: RecordQuery) -> DataFrame:
    """matched_records: records with a matching field, rows that came twice counted twice; no chunks, no index."""
    c = compiled(query)
    fields = F.filter(searchable_fields(), lambda x: x["field"].isin(*query.fields)) if query.fields else searchable_fields()
    hit = F.exists(fields, lambda x: c.found(x["text"]))
    scope = F.lit(True)
    if query.collections:
        scope &= F.col("collection").isin(*query.collections)
    for tag in query.required_tags:
        scope &= F.array_contains("tags", tag)
    return records.where(scope & hit).agg(F.count(F.lit(1)).alias("matched_records"))
