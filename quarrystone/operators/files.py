"""Searching files line by line, and an index of files that is kept on disk."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.config import NO_INDEX, NOT_PERSISTED, OTHER_CONFIG, EngineError, FileQuery, IndexConfig
from quarrystone.functions import matching
from quarrystone.functions.frames import cut, small
from quarrystone.operators import grams
from quarrystone.operators.globs import glob_regex, is_valid
from quarrystone.operators.planner import Plan, ScanAll, plan_literal, plan_regex
from quarrystone.operators.postings import restricted
from quarrystone.operators.store import Generations, age_seconds, one_row
from quarrystone.sources.crawl import SNIFF_SEARCH, crawl, has_nul, head_commit

LINE = "struct<line:int,excerpt:string>"
MATCHES_SCHEMA = ("doc_id", "relative_path", "match_no", "line", "column", "excerpt", "match_length", "context_before", "context_after")


def as_text_files(files: DataFrame) -> DataFrame:
    """doc_id, relative_path, text of files with binary content; binary ones are left out, bad UTF-8 is replaced."""
    return files.where(~has_nul(F.col("content"), SNIFF_SEARCH)).select("doc_id", "relative_path", F.decode("content", "UTF-8").alias("text"))


def path_filter(q: FileQuery, path: Column) -> Column:
    """File type (the extension, without dots, in any case) and glob, where * also crosses slashes. An invalid glob is
    no filter."""
    keep = F.lit(True)
    if q.file_type:
        keep &= F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)) == q.file_type.lower().strip(".")
    if q.glob and is_valid(q.glob):
        keep &= path.rlike(glob_regex(q.glob, across=True))
    return keep


def plan_of(pattern: str, q: FileQuery, config: IndexConfig = IndexConfig()) -> Plan:
    insensitive = matching.is_insensitive(pattern, q.case_insensitive, q.smart_case)
    if insensitive or not q.prefilter:
        return ScanAll()
    return (plan_literal if q.literal else plan_regex)(pattern, config.max_gram_length, config.max_covering_grams)


def stays_in_line(pattern: str, literal: bool) -> bool:
    """Whether no match can hold a line end; if unsure, it can."""
    if literal:
        return "\n" not in pattern and "\r" not in pattern
    return not re.search(r"\\[nrRsWDSvVHXxu0cpPNQ]|\[\^|\[[^\]]*\\|\(\?[a-z]*s|\n|\^|\$|\\[AZzGbB]|\(\?<?[=!]", pattern)


def _line_matches(text: Column, pattern: str, literal: bool, insensitive: bool, context: int) -> Column:
    """array of matches, each with its line's place in the file, for patterns that stay within lines. Lines are looked
    at where they lie; only those with a match get spans and context."""
    lines = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")
    numbered = F.filter(F.transform(lines, lambda x, k: F.struct(k.alias("k"), x.alias("x"))), lambda s: matching.found(s["x"], pattern, literal, insensitive))
    context_of = lambda a, b: F.transform(F.sequence(a, b), lambda k: F.struct((k + 1).alias("line"), lines[k].alias("excerpt")))
    none = F.array().cast(f"array<{LINE}>")

    def of_line(s: Column) -> Column:
        k = s["k"]
        before = F.when((k > 0) & F.lit(context > 0), context_of(F.greatest(k - context, F.lit(0)), k - 1)).otherwise(none)
        after = F.when((k < F.size(lines) - 1) & F.lit(context > 0), context_of(k + 1, F.least(k + context, F.size(lines) - 1))).otherwise(none)
        return F.transform(
            matching.match_spans(s["x"], pattern, literal, insensitive),
            lambda m: F.struct((k + 1).alias("line"), (m["start"] + 1).alias("column"), s["x"].alias("excerpt"), m["length"].alias("match_length"), before.alias("context_before"), after.alias("context_after")),
        )

    return F.flatten(F.transform(numbered, of_line))


def _file_matches(text: Column, pattern: str, literal: bool, insensitive: bool, context: int) -> Column:
    """The same for any pattern: places in the file are turned into lines by what lies before them."""
    clean = F.regexp_replace(text, "\r\n", "\n")
    lines = F.split(clean, "\n")
    context_of = lambda a, b: F.transform(F.sequence(a, b), lambda k: F.struct((k + 1).alias("line"), lines[k].alias("excerpt")))
    none = F.array().cast(f"array<{LINE}>")

    def of(m: Column) -> Column:
        head = F.split(F.substring(clean, F.lit(1), m["start"]), "\n")
        k = F.size(head) - 1
        before = F.when((k > 0) & F.lit(context > 0), context_of(F.greatest(k - context, F.lit(0)), k - 1)).otherwise(none)
        after = F.when((k < F.size(lines) - 1) & F.lit(context > 0), context_of(k + 1, F.least(k + context, F.size(lines) - 1))).otherwise(none)
        return F.struct((k + 1).alias("line"), (F.length(F.element_at(head, -1)) + 1).alias("column"), lines[k].alias("excerpt"), m["length"].alias("match_length"), before.alias("context_before"), after.alias("context_after"))

    return F.transform(matching.match_spans(clean, pattern, literal, insensitive), of)


@dataclass(frozen=True)
class FileSearch:
    """The tables of one search; each is computed only if it is asked for."""

    candidates: DataFrame
    verified: DataFrame
    query: FileQuery
    pattern: str
    insensitive: bool

    def counts(self) -> DataFrame:
        """doc_id, relative_path, match_count of the files with a match; capped per file, 1 for files_only and quiet."""
        return self.verified.select("doc_id", "relative_path", "match_count")

    def matches(self) -> DataFrame:
        """The matches in the order of files and places, up to max_results; none for count_matches and quiet."""
        q = self.query
        make = _line_matches if stays_in_line(self.pattern, q.literal) else _file_matches
        found = make(F.col("text"), self.pattern, q.literal, self.insensitive, q.context_lines)
        cap = 1 if q.files_only else q.max_count_per_file
        if cap is not None:
            found = F.slice(found, 1, cap)
        source = self.verified.where(F.lit(not (q.count_matches or q.quiet)))
        rows = source.select("doc_id", "relative_path", F.posexplode(found).alias("match_no", "m")).select("doc_id", "relative_path", "match_no", "m.*")
        ordered = rows.orderBy("doc_id", "match_no")
        return (ordered if q.max_results is None else ordered.limit(q.max_results)).select(*MATCHES_SCHEMA)

    def report(self) -> DataFrame:
        """candidate_count, matched_file_count, total_match_count: before max_results, after the cap per file. One pass:
        candidates that do not match count as zero matches."""
        q = self.query
        n = F.when(matching.found(F.col("text"), self.pattern, q.literal, self.insensitive), _capped(self.pattern, q, self.insensitive))
        most = (lambda c: F.least(c, F.lit(1))) if q.quiet else (lambda c: c)
        return self.candidates.select(n.alias("n")).agg(
            F.count(F.lit(1)).alias("candidate_count"),
            most(F.count("n")).alias("matched_file_count"),
            most(F.coalesce(F.sum("n"), F.lit(0))).alias("total_match_count"),
        )


def _capped(pattern: str, q: FileQuery, insensitive: bool) -> Column:
    """Matches of a file: one for files_only and quiet, else up to the cap."""
    n = matching.count(F.col("text"), pattern, q.literal, insensitive)
    cap = 1 if q.files_only or q.quiet else q.max_count_per_file
    return n if cap is None else F.least(n, F.lit(cap))


def search_files(files: DataFrame, pattern: str, q: FileQuery = FileQuery(), postings: DataFrame | None = None, config: IndexConfig = IndexConfig()) -> FileSearch:
    """files: doc_id, relative_path, text. postings: gram, chunk_id (the file's id), to narrow what is looked at."""
    insensitive = matching.is_insensitive(pattern, q.case_insensitive, q.smart_case)
    read = files.select("doc_id", "relative_path", "text")
    if postings is not None:
        read = restricted(read.withColumnRenamed("doc_id", "chunk_id"), plan_of(pattern, q, config), postings).withColumnRenamed("chunk_id", "doc_id")
    candidates = read.where(path_filter(q, F.col("relative_path")))
    hit = candidates.where(matching.found(F.col("text"), pattern, q.literal, insensitive)).withColumn("match_count", _capped(pattern, q, insensitive))
    if q.quiet:
        hit = hit.orderBy("doc_id").limit(1)
    return FileSearch(candidates, hit, q, pattern, insensitive)


def changed_files(base: DataFrame, current: DataFrame) -> DataFrame:
    """relative_path, change (deleted, changed by size or second of change, new) between two listings."""
    b = base.select("relative_path", F.col("byte_count").alias("b_size"), F.col("modified_at_epoch_seconds").alias("b_at"))
    c = current.select("relative_path", F.col("byte_count").alias("c_size"), F.col("modified_at_epoch_seconds").alias("c_at"))
    change = (
        F.when(F.col("c_size").isNull(), "deleted")
        .when(F.col("b_size").isNull(), "new")
        .when((F.col("b_size") != F.col("c_size")) | (F.col("b_at") != F.col("c_at")), "changed")
    )
    return b.join(c, "relative_path", "full_outer").select("relative_path", change.alias("change")).where("change IS NOT NULL")


class FileIndex:
    """An index of a folder's files: a base generation and, after updates, an overlay with tombstones.

    The same files give the same answers with and without postings; those only narrow what is looked at.
    """

    VERSION = 2

    def __init__(self, spark: SparkSession, root: str, config: IndexConfig, files: DataFrame, postings: DataFrame, path: str | None = None, meta: dict | None = None):
        self.spark, self.root, self.config, self.path, self.meta = spark, root, config, path, meta or {}
        self.files, self.postings = files, postings

    @classmethod
    def build(cls, spark: SparkSession, root: str, config: IndexConfig = IndexConfig()) -> FileIndex:
        """An index in memory."""
        files = crawl(spark, root, config)
        return cls(spark, root, config, files, cls._postings(files, config))

    @staticmethod
    def _postings(files: DataFrame, config: IndexConfig) -> DataFrame:
        return grams.postings(files.select(F.col("doc_id").alias("chunk_id"), F.decode("content", "UTF-8").alias("text")), config.max_gram_length)

    @classmethod
    def create(cls, spark: SparkSession, root: str, path: str, config: IndexConfig = IndexConfig()) -> FileIndex:
        index = cls.build(spark, root, config)
        index.save(path)
        return cls.open(spark, path)

    def save(self, path: str) -> None:
        tables = {"files": self.files, "postings": cut(self.postings).repartitionByRange("gram", "chunk_id").sortWithinPartitions("gram", "chunk_id")}
        Generations(self.spark, path).publish(tables, {"version": self.VERSION, "root": self.root, "config": asdict(self.config), "commit": head_commit(self.root)})

    @classmethod
    def open(cls, spark: SparkSession, path: str, root: str | None = None) -> FileIndex:
        store = Generations(spark, path)
        meta = store.current()
        if meta is None:
            raise EngineError(NO_INDEX, f"there is no index at {path}")
        store.require_version(meta, cls.VERSION)
        files, postings = store.read(meta, "files"), store.read(meta, "postings")
        if meta.get("overlay"):
            dead = store.read_overlay(meta, "tombstones")
            files = files.join(dead, "doc_id", "left_anti").unionByName(store.read_overlay(meta, "files"))
            postings = postings.join(dead.withColumnRenamed("doc_id", "chunk_id"), "chunk_id", "left_anti").unionByName(store.read_overlay(meta, "postings"))
        config = IndexConfig.from_dict({k: tuple(v) if isinstance(v, list) else v for k, v in meta["config"].items()})
        return cls(spark, root or meta["root"], config, files, postings, path, meta)

    @classmethod
    def update(cls, spark: SparkSession, root: str, path: str, config: IndexConfig = IndexConfig()) -> FileIndex:
        """Brings an index up to date by an overlay over its base; builds it anew if there is none, or one of another
        version or configuration. Nothing changed: the overlay, if any, goes."""
        store = Generations(spark, path)
        try:
            meta = store.current()
            if meta is None:
                raise EngineError(NO_INDEX, path)
            store.require_version(meta, cls.VERSION)
            if IndexConfig.from_dict({k: tuple(v) if isinstance(v, list) else v for k, v in meta["config"].items()}) != config:
                raise EngineError(OTHER_CONFIG, path)
        except EngineError:
            return cls.create(spark, root, path, config)
        base, now = store.read(meta, "files"), crawl(spark, root, config)
        changes = small(changed_files(base, now))
        dead = base.join(changes.where("change <> 'new'"), "relative_path", "left_semi").select("doc_id")
        first = base.agg(F.max("doc_id")).first()[0]
        fresh = now.join(changes.where("change <> 'deleted'"), "relative_path", "left_semi").withColumn("doc_id", F.col("doc_id") + F.lit(0 if first is None else first + 1))
        store.publish_overlay(meta, {"files": fresh, "postings": cls._postings(fresh, config), "tombstones": dead})
        return cls.open(spark, path)

    def search(self, pattern: str, q: FileQuery = FileQuery(), strategy: str = "scan") -> FileSearch:
        """strategy: scan, or indexed to narrow the files by postings first."""
        return search_files(as_text_files(self.files), pattern, q, self.postings if strategy == "indexed" else None, self.config)

    def status(self) -> DataFrame:
        """One row: file_count, byte_count, gram_count, overlay_file_count, tombstone_count, generation, commit,
        age_seconds (never below 0)."""
        if self.path is None:
            raise EngineError(NOT_PERSISTED, "the index was not saved")
        store = Generations(self.spark, self.path)
        overlay = {t: store.read_overlay(self.meta, t) if self.meta.get("overlay") else self.spark.range(0) for t in ("files", "tombstones")}
        rows = lambda df: df.agg(F.count(F.lit(1)))
        return one_row(
            {
                "file_count": rows(self.files),
                "byte_count": self.files.agg(F.coalesce(F.sum("byte_count"), F.lit(0))),
                "gram_count": self.postings.agg(F.count_distinct("gram")),
                "overlay_file_count": rows(overlay["files"]),
                "tombstone_count": rows(overlay["tombstones"]),
            }
        ).select("*", F.lit(self.meta["generation"]).alias("generation"), F.lit(self.meta.get("commit")).cast("string").alias("commit"), age_seconds(self.meta).alias("age_seconds"))
