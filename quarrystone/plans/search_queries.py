"""Queries of the search and index operators over the driver's tables.

The table chunks is searched as an index's chunks; records are the store that is scanned, chunked, changed and
compared; documents stand for files, one per document, with source and language as folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.config import ChunkingConfig, FileQuery, Mode, RecordIndexConfig, RecordQuery
from quarrystone.functions.frames import Held, cut, scratch, table
from quarrystone.functions.matching import trimmed
from quarrystone.operators import baselines, files, grams, ignore, postings, records, search, store
from quarrystone.operators.globs import glob_regex
from quarrystone.operators.planner import plan_regex
from quarrystone.plans import gram_sql
from quarrystone.sources.crawl import relative_to, write_files

LITERAL = RecordQuery("Dovit")
INSENSITIVE = RecordQuery("archive box")
REGEX = RecordQuery("[a-z]+ou[nt]", mode=Mode.REGEX, smart_case=False)
FILTERED = RecordQuery("The ", collections=("messages", "ws-01/messages", "notes"), fields=("body",), required_tags=("memory",))
ACCENTS = RecordQuery("índice", case_insensitive=True)
HIT = ("record_id", "collection", "field", "chunk_id", "ordinal", "excerpt", "score", "updated_at_epoch_seconds", "match_count")
IGNORE_LINES = [("", "release_notes/\n*7.txt\n!*17.txt\n/und\n# none\n"), ("chat_export", "de/*\n!de/1*\n")]


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks")


def _files(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, d, "documents").select("doc_id", path.alias("relative_path"), "text")


def _hits(query: RecordQuery):
    return lambda spark, d: search.hits(_chunks(spark, d), query).select(*HIT)


def _report(query: RecordQuery):
    return lambda spark, d: search.report(_chunks(spark, d), query)


def indexed_hits(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    return search.hits(chunks, LITERAL, grams.postings(chunks)).select(*HIT)


def indexed_matches(spark: SparkSession, d: str) -> DataFrame:
    """All matches of a regular expression by way of the postings; equal to a scan's."""
    chunks = _chunks(spark, d)
    c = search.compiled(RecordQuery("Dovit|Vesk (closed|copied)", mode=Mode.REGEX))
    return search.verified(chunks, c, grams.postings(chunks)).select("chunk_id", "match_count")


def all_excerpts(spark: SparkSession, d: str) -> DataFrame:
    c = search.compiled(REGEX)
    return search.verified(_chunks(spark, d), c).select("chunk_id", "match_count", c.excerpt(F.col("text")).alias("excerpt"))


def naive_record_count(spark: SparkSession, d: str) -> DataFrame:
    return search.naive_count(table(spark, d, "records"), LITERAL)


def record_units(spark: SparkSession, d: str) -> DataFrame:
    return records.units(table(spark, d, "records"), ("row_no",)).select("row_no", "record_id", "collection", "field", "text")


def unit_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = records.units(table(spark, d, "records"), ("row_no",)).select("row_no", "field_no", "field")
    return records.numbered(rows, ["row_no", "field_no"], "unit_id").select("row_no", "field", F.col("unit_id").cast("long").alias("unit_id"))


def record_chunks(spark: SparkSession, d: str) -> DataFrame:
    return records.chunk_records(table(spark, d, "records"), ChunkingConfig(max_chunk_bytes=1024, overlap_bytes=64), by="row_no").select("chunk_id", "record_id", "collection", "field", "ordinal", "text")


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    size = F.octet_length("text")
    return _chunks(spark, d).agg(F.count(F.lit(1)).alias("chunks"), F.sum(size).alias("bytes"), F.max(size).alias("largest"))


def trimmed_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").select("row_no", F.length(trimmed(F.col("body"))).alias("characters"), F.octet_length("body").alias("bytes"))


def tag_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").select("row_no", baselines.tag_text(F.col("tags")).alias("tag_text"))


def gram_postings(spark: SparkSession, d: str) -> DataFrame:
    return grams.postings(_chunks(spark, d))


def gram_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return grams.postings(_chunks(spark, d)).groupBy("gram").agg(F.count(F.lit(1)).alias("chunks"))


def posting_lists(spark: SparkSession, d: str) -> DataFrame:
    return grams.posting_lists(grams.postings(_chunks(spark, d))).select("gram", "block", F.array_join(F.col("chunks").cast("array<string>"), " ").alias("chunks"))


def _candidates(pattern: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return postings.candidates(plan_regex(pattern), grams.postings(_chunks(spark, d)))

    return run


def prefilter_off(spark: SparkSession, d: str) -> DataFrame:
    """A report with postings at hand that the query does not want: every chunk in scope is a candidate."""
    chunks = _chunks(spark, d)
    return search.report(chunks, RecordQuery("Dovit", prefilter=False), grams.postings(chunks))


def comparison_of_regex(spark: SparkSession, d: str) -> DataFrame:
    """Engines that know literals only are not available for a regular expression; they count as -1 here."""
    got = baselines.compare(table(spark, d, "records"), RecordQuery("Dovit (closed|opened)", mode=Mode.REGEX))
    return got.withColumn("matched_records", F.coalesce("matched_records", F.lit(-1)))


def _whole_texts(name: str, spark: SparkSession) -> store.RecordIndex:
    return store.RecordIndex(spark, RecordIndexConfig(storage=scratch(spark, name), chunking=ChunkingConfig(max_chunk_bytes=1 << 30), compaction_threshold=1 << 40))


def _changed_index(spark: SparkSession, d: str, name: str) -> store.RecordIndex:
    """An index of all records, after the feed's last upserts and deletes of their and of new keys."""
    index = _whole_texts(name, spark)
    index.replace_all(table(spark, d, "records"), by="row_no")
    feed = table(spark, d, "record_feed").withColumn("at", F.struct("arrived_at", "delivery_id"))
    with Held(spark) as held:
        last = held.keep(records.latest_per_key(feed.select("op", *(c.split()[0] for c in records.RECORD_SCHEMA.split(", ")), "at"), "at"))
        index.upsert(last.where("op = 'upsert'").drop("op"), by="at")
        index.delete_keys(last.where("op = 'delete'").select("collection", "id"))
    return index


UNIT = ("record_id", "collection", "field", "ordinal", "text")


def stored_changes(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a stored index after upserts and deletes, read again by another that opens the same store."""
    index = _changed_index(spark, d, "stored-changes")
    return store.RecordIndex(spark, index.config).chunks().select(*UNIT)


def stored_search(spark: SparkSession, d: str) -> DataFrame:
    """A search by postings of base and overlay without what is dead."""
    index = _changed_index(spark, d, "stored-search")
    c = search.compiled(LITERAL)
    return search.verified(index.chunks(), c, index.postings()).select("record_id", "collection", "field", "text", "match_count")


def stored_status(spark: SparkSession, d: str) -> DataFrame:
    return _changed_index(spark, d, "stored-status").status().select("record_count", "chunk_count", "resident_bytes", "overlay_chunk_count")


def stored_compact(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and status after compaction: no overlay, no tombstones, ids from 0 by key, field and ordinal."""
    index = _changed_index(spark, d, "stored-compact")
    index.compact()
    s = index.status("overlay_chunk_count", "tombstone_count").first()
    return index.chunks().select("chunk_id", *UNIT[:4], F.lit(s.overlay_chunk_count).alias("overlay"), F.lit(s.tombstone_count).alias("dead"))


def stored_deletes(spark: SparkSession, d: str) -> DataFrame:
    """Records of a stored index after deletes by id, in one collection and in all."""
    index = _whole_texts("stored-deletes", spark)
    index.replace_all(table(spark, d, "records"), by="row_no")
    index.delete(table(spark, d, "record_feed").where("op = 'delete'").select("id"), "notes")
    index.delete(table(spark, d, "ingest_runs").select(F.concat(F.lit("memo-"), F.col("run_no").cast("string")).alias("id")))
    return index.chunks().select(*UNIT[:4])


def _updated_files(spark: SparkSession, d: str) -> files.FileIndex:
    """An index of documents as files, made when some were shorter and others not there, and then brought up to date."""
    shared = scratch(spark, "stored-files")
    root = shared if "://" in shared else f"file://{shared.removeprefix('file:')}"
    now = _files(spark, d).where("text IS NOT NULL")
    write_files(now.where("relative_path NOT LIKE 'none/%'").withColumn("text", F.when(F.col("relative_path").contains("/en/"), F.substring("text", 1, 40)).otherwise(F.col("text"))), root)
    files.FileIndex.create(spark, root, f"{shared}-index")
    write_files(now, root)
    return files.FileIndex.update(spark, root, f"{shared}-index")


def stored_file_counts(spark: SparkSession, d: str) -> DataFrame:
    """Matches of each file by the postings of base and overlay."""
    return _updated_files(spark, d).search("Dovit", FileQuery(literal=True), "indexed").counts().select("relative_path", "match_count")


def stored_file_status(spark: SparkSession, d: str) -> DataFrame:
    return _updated_files(spark, d).status().select("file_count", "byte_count", (F.col("overlay_file_count") - F.col("tombstone_count")).alias("added"))


def gram_spans(spark: SparkSession, d: str) -> DataFrame:
    """The grams themselves, in hexadecimal, of short texts with grams of at most 32 bytes."""
    chunks = _chunks(spark, d).where("octet_length(text) <= 200")
    return grams.spelled(chunks, 32)


def index_status(spark: SparkSession, d: str) -> DataFrame:
    return store.index_status(_chunks(spark, d))


def compact_renumber(spark: SparkSession, d: str) -> DataFrame:
    return records.renumbered(_chunks(spark, d)).select(F.col("chunk_id").cast("long").alias("chunk_id"), "record_id", "collection", "field", "ordinal")


def _deleted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "record_feed").where("op = 'delete'").select("collection", "id").distinct()


def delete_in_collection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "record_snapshots").join(_deleted(spark, d), ["collection", "id"], "left_anti").select("snapshot_no", "collection", "id", "updated_at_epoch_seconds")


def delete_in_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "record_snapshots").join(_deleted(spark, d).select("id").distinct(), "id", "left_anti").select("snapshot_no", "collection", "id", "updated_at_epoch_seconds")


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    feed = table(spark, d, "record_feed").where("op = 'upsert'").withColumn("at", F.struct("arrived_at", "delivery_id"))
    return records.latest_per_key(feed.select("collection", "id", "delivery_id", "updated_at_epoch_seconds", "at"), "at").select("collection", "id", "delivery_id", "updated_at_epoch_seconds")


def active_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a base without those of records that an overlay replaces, and the overlay's units."""
    latest = table(spark, d, "record_feed").where("op = 'upsert'").withColumn("at", F.struct("arrived_at", "delivery_id"))
    new = records.latest_per_key(latest.select(*(c.split()[0] for c in records.RECORD_SCHEMA.split(", ")), "at"), "at")
    base = _chunks(spark, d).select("record_id", "collection", "field", "text")
    keys = new.select("collection", F.col("id").alias("record_id"))
    return base.join(keys, ["collection", "record_id"], "left_anti").select("record_id", "collection", "field", "text").unionByName(records.units(new).select("record_id", "collection", "field", "text"))


def active_set(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a base without those of records that the feed replaces or deletes, and the chunks of those whose last
    change is an upsert. active_chunks reads the feed's upserts only, and leaves their texts whole."""
    feed = table(spark, d, "record_feed").withColumn("at", F.struct("arrived_at", "delivery_id"))
    last = cut(records.latest_per_key(feed.select("op", *(c.split()[0] for c in records.RECORD_SCHEMA.split(", ")), "at"), "at"))
    keys = last.select("collection", F.col("id").alias("record_id"))
    base = _chunks(spark, d).join(keys, ["collection", "record_id"], "left_anti")
    columns = ["record_id", "collection", "field", "text"]
    return base.select(columns).unionByName(records.chunk_rows(last.where("op = 'upsert'")).select(columns))


def change_detection(spark: SparkSession, d: str) -> DataFrame:
    """The first and the last snapshot of records as two listings of files."""
    s = table(spark, d, "record_snapshots")
    rows = s.select("snapshot_no", F.concat_ws("/", "collection", "id").alias("relative_path"), F.octet_length("body").cast("long").alias("byte_count"), F.col("updated_at_epoch_seconds").alias("modified_at_epoch_seconds"))
    one = rows.groupBy("snapshot_no", "relative_path").agg(F.max(F.struct("modified_at_epoch_seconds", "byte_count")).alias("r")).select("snapshot_no", "relative_path", "r.*")
    ends = s.agg(F.min("snapshot_no").alias("a"), F.max("snapshot_no").alias("b")).first()
    return files.changed_files(one.where(F.col("snapshot_no") == ends.a), one.where(F.col("snapshot_no") == ends.b))


def _file_search(q: FileQuery, pattern: str = "Dovit"):
    return lambda spark, d: files.search_files(_files(spark, d), pattern, q)


def file_matches(spark: SparkSession, d: str) -> DataFrame:
    found = _file_search(FileQuery(literal=True, max_results=None))(spark, d).matches()
    return found.select("doc_id", "match_no", "line", "column", "excerpt", "match_length")


def file_matches_context(spark: SparkSession, d: str) -> DataFrame:
    found = _file_search(FileQuery(max_results=None, context_lines=2), "Dovit .*(box|log)")(spark, d).matches()
    lines = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["line"].cast("string"), F.lit(":"), x["excerpt"])), "\n")
    return found.select("doc_id", "line", "excerpt", lines("context_before").alias("context_before"), lines("context_after").alias("context_after"))


def file_matches_across_lines(spark: SparkSession, d: str) -> DataFrame:
    """A literal that holds line ends, so places are those in the file."""
    found = _file_search(FileQuery(literal=True, max_results=None), ".\n\n")(spark, d).matches()
    return found.select("doc_id", "match_no", "line", "column", "excerpt", "match_length")


def file_match_top(spark: SparkSession, d: str) -> DataFrame:
    return _file_search(FileQuery(literal=True, max_results=50))(spark, d).matches().select("doc_id", "match_no", "line", "column")


def _file_counts(q: FileQuery, pattern: str = "Dovit"):
    return lambda spark, d: _file_search(q, pattern)(spark, d).counts()


def file_report(spark: SparkSession, d: str) -> DataFrame:
    return _file_search(FileQuery(literal=True, max_count_per_file=3, glob="chat*/*"))(spark, d).report()


def files_only(spark: SparkSession, d: str) -> DataFrame:
    return _file_search(FileQuery(literal=True, files_only=True, max_results=None))(spark, d).matches().select("doc_id", "line", "column")


def indexed_file_counts(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    entries = grams.postings(f.select(F.col("doc_id").alias("chunk_id"), "text"))
    return files.search_files(f, "Dovit (closed|opened)", FileQuery(), entries).counts()


def glob_paths(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("relative_path")
    return _files(spark, d).select("doc_id", p.rlike(glob_regex("*/en/*[!0-4].txt")).alias("inside"), p.rlike(glob_regex("chat*1?.txt", across=True)).alias("across"))


def ignored_paths(spark: SparkSession, d: str) -> DataFrame:
    rules = ignore.rules_of(IGNORE_LINES)
    return _files(spark, d).select("doc_id", ignore.ignored_with_parents(F.col("relative_path"), rules).alias("ignored"))


def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    full = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/else/"), "relative_path")).otherwise(F.concat(F.lit("/data/root/"), "relative_path"))
    return _files(spark, d).select("doc_id", relative_to(full, "/data/root").alias("relative_path"))


def signature(spark: SparkSession, d: str) -> DataFrame:
    return records.corpus_signature(table(spark, d, "records"))


def _engine(engine: str, query: RecordQuery):
    return lambda spark, d: baselines.ENGINES[engine](table(spark, d, "records"), query)


QUERIES = {
    "record_search_literal": _hits(LITERAL),
    "record_search_insensitive": _hits(INSENSITIVE),
    "record_search_regex": _hits(REGEX),
    "record_search_filtered": _hits(FILTERED),
    "search_report_literal": _report(LITERAL),
    "search_report_smart_case": _report(INSENSITIVE),
    "search_report_regex": _report(REGEX),
    "search_report_filtered": _report(FILTERED),
    "indexed_search_literal": indexed_hits,
    "indexed_matches_regex": indexed_matches,
    "all_excerpts": all_excerpts,
    "naive_record_count": naive_record_count,
    "record_units": record_units,
    "unit_ids": unit_ids,
    "record_chunks": record_chunks,
    "chunk_stats": chunk_stats,
    "trimmed_texts": trimmed_texts,
    "tag_texts": tag_texts,
    "gram_postings": gram_postings,
    "gram_frequencies": gram_frequencies,
    "posting_lists": posting_lists,
    "stored_file_counts": stored_file_counts,
    "stored_file_status": stored_file_status,
    "gram_spans": gram_spans,
    "prefilter_off": prefilter_off,
    "comparison_of_regex": comparison_of_regex,
    "stored_changes": stored_changes,
    "stored_search": stored_search,
    "stored_status": stored_status,
    "stored_compact": stored_compact,
    "stored_deletes": stored_deletes,
    "candidates_and": _candidates("Dovit.*archive"),
    "candidates_or": _candidates("Dovit|Pirra|Vesk"),
    "index_status": index_status,
    "compact_renumber": compact_renumber,
    "upsert_latest": upsert_latest,
    "delete_in_collection": delete_in_collection,
    "delete_in_all": delete_in_all,
    "active_chunks": active_chunks,
    "active_set": active_set,
    "change_detection": change_detection,
    "file_matches": file_matches,
    "file_matches_context": file_matches_context,
    "file_matches_across_lines": file_matches_across_lines,
    "file_match_top": file_match_top,
    "file_counts": _file_counts(FileQuery(literal=True, count_matches=True)),
    "file_counts_capped": _file_counts(FileQuery(literal=True, max_count_per_file=2)),
    "file_counts_insensitive": _file_counts(FileQuery(case_insensitive=True), "dovit|pirra"),
    "file_counts_by_type_and_glob": _file_counts(FileQuery(literal=True, file_type=".TXT", glob="*export/*")),
    "file_quiet": _file_counts(FileQuery(literal=True, quiet=True)),
    "files_only": files_only,
    "file_report": file_report,
    "indexed_file_counts": indexed_file_counts,
    "glob_paths": glob_paths,
    "ignored_paths": ignored_paths,
    "relative_paths": relative_paths,
    "corpus_signature": signature,
    "baseline_trigram_phrase": _engine("trigram_phrase", LITERAL),
    "baseline_contains": _engine("contains", LITERAL),
    "baseline_contains_accents": _engine("contains", ACCENTS),
    "baseline_wildcard": _engine("wildcard", INSENSITIVE),
    "baseline_comparison": lambda spark, d: baselines.compare(table(spark, d, "records"), LITERAL),
}

_FILES = "files AS (SELECT doc_id, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), doc_id || '.txt') AS relative_path, text FROM documents)"
_UNITS = """
unit AS (
  SELECT row_no, id, collection, 0 AS no, 'title' AS field, title AS text, tags FROM records WHERE title <> ''
  UNION ALL SELECT row_no, id, collection, 1, 'body', body, tags FROM records WHERE body <> ''
  UNION ALL SELECT row_no, id, collection, 2, e.key, e.value, tags FROM (SELECT row_no, id, collection, tags, unnest(map_entries(fields)) AS e FROM records) WHERE e.value <> '')
"""


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x85\\p{{Z}}]+|[\\s\\x85\\p{{Z}}]+$', '', 'g')"


def _found_literal(x: str, lit: str) -> tuple[str, str, str]:
    """(condition, count, excerpt) in SQL for a literal in the text x (lower(x) for one that ignores case)."""
    n = len(lit)
    at = f"instr({x}, '{lit}')"
    return f"contains({x}, '{lit}')", f"CAST((length({x}) - length(replace({x}, '{lit}', ''))) // {n} AS INTEGER)", _trim(f"substr(text, greatest(1, {at} - 80), {at} + {n} + 120 - greatest(1, {at} - 80))")


def _hits_sql(cond: str, count: str, excerpt: str, scope: str = "true") -> str:
    return f"""
        SELECT record_id, collection, field, chunk_id, ordinal, {excerpt} AS excerpt, n * 1000.0::DOUBLE + updated_at_epoch_seconds / 1e6 AS score, updated_at_epoch_seconds, n AS match_count
        FROM (SELECT *, {count} AS n FROM chunks WHERE ({scope}) AND {cond}) ORDER BY score DESC, chunk_id LIMIT 20"""


def _report_sql(cond: str, count: str, scope: str = "true") -> str:
    return f"""
        SELECT count(*) AS candidate_chunk_count, count(DISTINCT CASE WHEN n > 0 THEN record_id END) AS matched_record_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_match_count
        FROM (SELECT record_id, CASE WHEN {cond} THEN {count} END AS n FROM chunks WHERE {scope})"""


_P = "[a-z]+ou[nt]"
_REGEX_COUNT = f"CAST(len(regexp_extract_all(text, '{_P}')) AS INTEGER)"
_FIRST = f"regexp_extract(text, '{_P}')"
_AT = f"(length(regexp_extract(text, '^((?s:.)*?){_P}', 1)) + 1)"
_REGEX_EXCERPT = _trim(f"substr(text, greatest(1, {_AT} - 80), {_AT} + length({_FIRST}) + 120 - greatest(1, {_AT} - 80))")
_SCOPE = "collection IN ('messages', 'ws-01/messages', 'notes') AND field = 'body' AND list_contains(tags, 'memory')"
_LIT, _CI, _THE = _found_literal("text", "Dovit"), _found_literal("lower(text)", "archive box"), _found_literal("text", "The ")
_COUNT_FILES = "SELECT doc_id, relative_path, {n} AS match_count FROM files WHERE contains(text, 'Dovit'){more}"
_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection, id ORDER BY arrived_at DESC, delivery_id DESC) AS k FROM record_feed WHERE op = 'upsert') WHERE k = 1"
_LINES = f"""{_FILES},
lines AS (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM files WHERE contains(text, 'Dovit'))),
parts AS (SELECT doc_id, line, ls[line] AS excerpt, string_split(ls[line], 'Dovit') AS p FROM lines WHERE contains(ls[line], 'Dovit')),
found AS (SELECT doc_id, line, excerpt, p, unnest(generate_series(1, len(p) - 1)) AS k FROM parts),
matches AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line, k) - 1 AS INTEGER) AS match_no, CAST(line AS INTEGER) AS line,
    CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + 5 * (k - 1) + 1 AS INTEGER) AS "column", excerpt, 5 AS match_length
  FROM found)"""

_HASHED = f"WITH {gram_sql.grams(128)}, {gram_sql.HASHED}"
_CHANGED = f"""last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection, id ORDER BY arrived_at DESC, delivery_id DESC) AS k FROM record_feed) WHERE k = 1),
{_UNITS},
fresh AS (
  SELECT id, collection, 'title' AS field, title AS text FROM last WHERE op = 'upsert' AND title <> ''
  UNION ALL SELECT id, collection, 'body', body FROM last WHERE op = 'upsert' AND body <> ''
  UNION ALL SELECT id, collection, e.key, e.value FROM (SELECT id, collection, unnest(map_entries(fields)) AS e FROM last WHERE op = 'upsert') WHERE e.value <> ''),
active AS (
  SELECT id AS record_id, collection, field, text, row_no AS place FROM unit u WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.collection = u.collection AND l.id = u.id)
  UNION ALL SELECT id, collection, field, text, 0 FROM fresh)"""

ORACLE = {
    "gram_spans": f"WITH {gram_sql.grams(32, 'strlen(text) <= 200')} SELECT gram_hex, chunk_id FROM found",
    "gram_postings": f"{_HASHED} SELECT gram, chunk_id FROM hashed",
    "gram_frequencies": f"{_HASHED} SELECT gram, count(*) AS chunks FROM hashed GROUP BY gram",
    "posting_lists": f"{_HASHED} SELECT gram, CAST(floor(chunk_id / 65536.0) AS BIGINT) AS block, string_agg(CAST(chunk_id AS VARCHAR), ' ' ORDER BY chunk_id) AS chunks FROM hashed GROUP BY gram, block",
    "candidates_and": f"WITH {gram_sql.grams(128)} {gram_sql.having_all('Dovi', 'vit', 'arc', 'chi', 'ive')}",
    "candidates_or": f"WITH {gram_sql.grams(128)} ({gram_sql.having_all('Dovi', 'vit')}) UNION ({gram_sql.having_all('Pir', 'irra')}) UNION ({gram_sql.having_all('Vesk')})",
    "record_chunks": f"""WITH RECURSIVE {_UNITS}, {gram_sql.pieces("unit", 1024, 64)},
        ids AS (SELECT row_no, field, t, row_number() OVER (ORDER BY row_no, no, field, nth) - 1 AS chunk_id, CAST(row_number() OVER (PARTITION BY row_no, no, field ORDER BY nth) - 1 AS INTEGER) AS ordinal FROM piece WHERE t <> '')
        SELECT chunk_id, id AS record_id, collection, field, ordinal, t AS text FROM ids JOIN records USING (row_no)""",
    "stored_file_counts": f"WITH {_FILES} SELECT relative_path, {_LIT[1]} AS match_count FROM files WHERE {_LIT[0]}",
    "stored_file_status": f"WITH {_FILES} SELECT count(*) AS file_count, CAST(sum(strlen(text)) AS BIGINT) AS byte_count, count(*) FILTER (relative_path LIKE 'none/%') AS added FROM files WHERE text IS NOT NULL",
    "prefilter_off": _report_sql(*_LIT[:2]),
    "comparison_of_regex": f"""WITH {_UNITS}
        SELECT 'trigram_phrase' AS engine, CAST(-1 AS BIGINT) AS matched_records, false AS available UNION ALL SELECT 'contains', -1, false UNION ALL SELECT 'wildcard', -1, false
        UNION ALL SELECT 'scan', count(DISTINCT row_no), true FROM unit WHERE regexp_matches(text, 'Dovit (closed|opened)')""",
    "active_set": f"""WITH RECURSIVE last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection, id ORDER BY arrived_at DESC, delivery_id DESC) AS k FROM record_feed) WHERE k = 1),
        renewed AS (
          SELECT delivery_id AS row_no, 0 AS no, 'title' AS field, title AS text FROM last WHERE op = 'upsert' AND title <> ''
          UNION ALL SELECT delivery_id, 1, 'body', body FROM last WHERE op = 'upsert' AND body <> ''
          UNION ALL SELECT delivery_id, 2, e.key, e.value FROM (SELECT delivery_id, unnest(map_entries(fields)) AS e FROM last WHERE op = 'upsert') WHERE e.value <> ''),
        {gram_sql.pieces("renewed", 8192, 64)}
        SELECT record_id, collection, field, text FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.collection = c.collection AND l.id = c.record_id)
        UNION ALL SELECT id, collection, field, t FROM piece JOIN last ON delivery_id = row_no WHERE t <> ''""",
    "stored_changes": f"WITH {_CHANGED} SELECT record_id, collection, field, CAST(0 AS INTEGER) AS ordinal, text FROM active",
    "stored_search": f"WITH {_CHANGED} SELECT record_id, collection, field, text, {_LIT[1]} AS match_count FROM active WHERE {_LIT[0]}",
    "stored_status": f"""WITH {_CHANGED} SELECT count(DISTINCT (collection, record_id)) AS record_count, count(*) AS chunk_count, CAST(sum(strlen(text)) AS BIGINT) AS resident_bytes,
        (SELECT count(*) FROM fresh) AS overlay_chunk_count FROM active""",
    "stored_compact": f"""WITH {_CHANGED} SELECT row_number() OVER (ORDER BY collection, record_id, field, place) - 1 AS chunk_id, record_id, collection, field, CAST(0 AS INTEGER) AS ordinal,
        CAST(0 AS BIGINT) AS overlay, CAST(0 AS BIGINT) AS dead FROM active""",
    "stored_deletes": f"""WITH {_UNITS} SELECT id AS record_id, collection, field, CAST(0 AS INTEGER) AS ordinal FROM unit
        WHERE NOT (collection = 'notes' AND id IN (SELECT id FROM record_feed WHERE op = 'delete')) AND id NOT IN (SELECT 'memo-' || run_no FROM ingest_runs)""",
    "record_search_literal": _hits_sql(*_LIT),
    "record_search_insensitive": _hits_sql(*_CI),
    "record_search_regex": _hits_sql(f"regexp_matches(text, '{_P}')", _REGEX_COUNT, _REGEX_EXCERPT),
    "record_search_filtered": _hits_sql(*_THE, scope=_SCOPE),
    "search_report_literal": _report_sql(*_LIT[:2]),
    "search_report_smart_case": _report_sql(*_CI[:2]),
    "search_report_regex": _report_sql(f"regexp_matches(text, '{_P}')", _REGEX_COUNT),
    "search_report_filtered": _report_sql(*_THE[:2], scope=_SCOPE),
    "indexed_search_literal": _hits_sql(*_LIT),
    "indexed_matches_regex": "SELECT chunk_id, CAST(len(regexp_extract_all(text, 'Dovit|Vesk (closed|copied)')) AS INTEGER) AS match_count FROM chunks WHERE regexp_matches(text, 'Dovit|Vesk (closed|copied)')",
    "all_excerpts": f"SELECT chunk_id, {_REGEX_COUNT} AS match_count, {_REGEX_EXCERPT} AS excerpt FROM chunks WHERE regexp_matches(text, '{_P}')",
    "naive_record_count": "SELECT count(*) AS matched_records FROM records WHERE contains(coalesce(title, ''), 'Dovit') OR contains(body, 'Dovit') OR len(list_filter(map_values(fields), lambda x: contains(x, 'Dovit'))) > 0",
    "record_units": f"WITH {_UNITS} SELECT row_no, id AS record_id, collection, field, text FROM unit",
    "unit_ids": f"WITH {_UNITS} SELECT row_no, field, row_number() OVER (ORDER BY row_no, no, field) - 1 AS unit_id FROM unit",
    "chunk_stats": "SELECT count(*) AS chunks, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(max(strlen(text)) AS INTEGER) AS largest FROM chunks",
    "trimmed_texts": f"SELECT row_no, CAST(length({_trim('body')}) AS INTEGER) AS characters, CAST(strlen(body) AS INTEGER) AS bytes FROM records",
    "tag_texts": "SELECT row_no, '|' || array_to_string(list_sort(tags), '|') || '|' AS tag_text FROM records",
    "index_status": "SELECT count(DISTINCT (collection, record_id)) AS record_count, count(*) AS chunk_count, CAST(sum(strlen(text)) AS BIGINT) AS resident_bytes FROM chunks",
    "compact_renumber": "SELECT row_number() OVER (ORDER BY collection, record_id, field, ordinal, chunk_id) - 1 AS chunk_id, record_id, collection, field, ordinal FROM chunks",
    "upsert_latest": f"SELECT collection, id, delivery_id, updated_at_epoch_seconds FROM ({_LATEST})",
    "delete_in_collection": "SELECT snapshot_no, collection, id, updated_at_epoch_seconds FROM record_snapshots s WHERE NOT EXISTS (SELECT 1 FROM record_feed f WHERE f.op = 'delete' AND f.collection = s.collection AND f.id = s.id)",
    "delete_in_all": "SELECT snapshot_no, collection, id, updated_at_epoch_seconds FROM record_snapshots s WHERE NOT EXISTS (SELECT 1 FROM record_feed f WHERE f.op = 'delete' AND f.id = s.id)",
    "active_chunks": f"""WITH latest AS ({_LATEST})
        SELECT record_id, collection, field, text FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.collection = c.collection AND l.id = c.record_id)
        UNION ALL SELECT id, collection, 'title', title FROM latest WHERE title <> ''
        UNION ALL SELECT id, collection, 'body', body FROM latest WHERE body <> ''
        UNION ALL SELECT id, collection, e.key, e.value FROM (SELECT id, collection, unnest(map_entries(fields)) AS e FROM latest) WHERE e.value <> ''""",
    "change_detection": """WITH one AS (
          SELECT snapshot_no, collection || '/' || id AS p, max((updated_at_epoch_seconds, strlen(body))) AS r FROM record_snapshots GROUP BY ALL),
        a AS (SELECT * FROM one WHERE snapshot_no = (SELECT min(snapshot_no) FROM one)), b AS (SELECT * FROM one WHERE snapshot_no = (SELECT max(snapshot_no) FROM one))
        SELECT coalesce(a.p, b.p) AS relative_path, CASE WHEN b.p IS NULL THEN 'deleted' WHEN a.p IS NULL THEN 'new' ELSE 'changed' END AS change
        FROM a FULL OUTER JOIN b ON a.p = b.p WHERE a.p IS NULL OR b.p IS NULL OR a.r <> b.r""",
    "file_matches": f"WITH {_LINES} SELECT doc_id, match_no, line, \"column\", excerpt, match_length FROM matches",
    "file_matches_context": f"""WITH {_FILES},
        lines AS (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM files))
        SELECT doc_id, CAST(n AS INTEGER) AS line, ls[n] AS excerpt,
          coalesce(array_to_string(list_transform(range(greatest(n - 2, 1), n), lambda k: k || ':' || ls[k]), chr(10)), '') AS context_before,
          coalesce(array_to_string(list_transform(range(n + 1, least(n + 2, len(ls)) + 1), lambda k: k || ':' || ls[k]), chr(10)), '') AS context_after
        FROM lines WHERE regexp_matches(ls[n], 'Dovit .*(box|log)')""",
    "file_matches_across_lines": f"""WITH {_FILES},
        p AS (SELECT doc_id, text, string_split(text, '.' || chr(10) || chr(10)) AS p FROM files WHERE contains(text, '.' || chr(10) || chr(10))),
        k AS (SELECT doc_id, text, p, unnest(generate_series(1, len(p) - 1)) AS k FROM p),
        heads AS (SELECT doc_id, text, k, substr(text, 1, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + 3 * (k - 1) AS BIGINT)) AS head FROM k),
        l AS (SELECT doc_id, k, string_split(head, chr(10)) AS h, string_split(text, chr(10)) AS ls FROM heads)
        SELECT doc_id, CAST(k - 1 AS INTEGER) AS match_no, CAST(len(h) AS INTEGER) AS line, CAST(length(h[len(h)]) + 1 AS INTEGER) AS "column", ls[len(h)] AS excerpt, 3 AS match_length FROM l""",
    "file_match_top": f"WITH {_LINES} SELECT doc_id, match_no, line, \"column\" FROM matches ORDER BY doc_id, match_no LIMIT 50",
    "file_counts": f"WITH {_FILES} " + _COUNT_FILES.format(n=_LIT[1], more=""),
    "file_counts_capped": f"WITH {_FILES} " + _COUNT_FILES.format(n=f"least({_LIT[1]}, 2)", more=""),
    "file_counts_insensitive": f"WITH {_FILES} SELECT doc_id, relative_path, CAST(len(regexp_extract_all(text, '(?i)dovit|pirra')) AS INTEGER) AS match_count FROM files WHERE regexp_matches(text, '(?i)dovit|pirra')",
    "file_counts_by_type_and_glob": f"WITH {_FILES} " + _COUNT_FILES.format(n=_LIT[1], more=" AND relative_path LIKE '%export/%' AND lower(relative_path) LIKE '%.txt'"),
    "file_quiet": f"WITH {_FILES} SELECT doc_id, relative_path, 1 AS match_count FROM files WHERE contains(text, 'Dovit') ORDER BY doc_id LIMIT 1",
    "files_only": f"WITH {_LINES} SELECT doc_id, line, \"column\" FROM matches WHERE match_no = 0",
    "file_report": f"""WITH {_FILES}, c AS (SELECT CASE WHEN contains(text, 'Dovit') THEN least({_LIT[1]}, 3) END AS n FROM files WHERE relative_path LIKE 'chat%/%')
        SELECT count(*) AS candidate_count, count(n) AS matched_file_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_match_count FROM c""",
    "indexed_file_counts": f"WITH {_FILES} SELECT doc_id, relative_path, CAST(len(regexp_extract_all(text, 'Dovit (closed|opened)')) AS INTEGER) AS match_count FROM files WHERE regexp_matches(text, 'Dovit (closed|opened)')",
    "glob_paths": f"WITH {_FILES} SELECT doc_id, regexp_matches(relative_path, '^[^/]*/en/[^/]*[^0-4]\\.txt$') AS inside, regexp_matches(relative_path, '^chat.*1.\\.txt$') AS across FROM files",
    "ignored_paths": f"""WITH {_FILES}, p AS (SELECT doc_id, relative_path, string_split(relative_path, '/') AS s FROM files)
        SELECT doc_id, list_contains(s[1:len(s) - 1], 'release_notes') OR list_contains(s, 'und')
          OR CASE WHEN regexp_matches(relative_path, '^chat_export/de/1') THEN false WHEN regexp_matches(relative_path, '^chat_export/de/') THEN true
            WHEN regexp_matches(relative_path, '17\\.txt$') THEN false ELSE regexp_matches(relative_path, '7\\.txt$') END AS ignored
        FROM p""",
    "relative_paths": f"WITH {_FILES} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id || '.txt' ELSE relative_path END AS relative_path FROM files",
    "baseline_trigram_phrase": f"WITH {_UNITS} SELECT count(DISTINCT id) AS matched_records FROM unit WHERE contains(lower(text), 'dovit')",
    "baseline_contains": f"WITH {_UNITS} SELECT count(DISTINCT id) AS matched_records FROM unit WHERE contains(text, 'Dovit')",
    "baseline_contains_accents": f"WITH {_UNITS} SELECT count(DISTINCT id) AS matched_records FROM unit WHERE contains(strip_accents(lower(text)), 'indice')",
    "baseline_wildcard": f"WITH {_UNITS} SELECT count(DISTINCT id) AS matched_records FROM unit WHERE text ILIKE '%archive box%'",
    "baseline_comparison": f"""WITH {_UNITS}
        SELECT 'trigram_phrase' AS engine, count(DISTINCT id) AS matched_records, true AS available FROM unit WHERE contains(lower(text), 'dovit')
        UNION ALL SELECT 'contains', count(DISTINCT id), true FROM unit WHERE contains(text, 'Dovit')
        UNION ALL SELECT 'wildcard', count(DISTINCT id), true FROM unit WHERE contains(text, 'Dovit')
        UNION ALL SELECT 'scan', count(DISTINCT row_no), true FROM unit WHERE contains(text, 'Dovit')""",
}
