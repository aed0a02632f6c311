"""Queries of the operators on snapshots and deliveries."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.frames import cut, scratch, table
from quarrystone.operators import incremental, snapshots
from quarrystone.sources.crawl import write_files
from quarrystone.streaming.changes import latest_in_batches, latest_of_batches


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "record_snapshots"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.pending_deliveries(table(spark, d, "record_feed"), table(spark, d, "ingest_runs"))


def p6_files(spark: SparkSession, d: str) -> DataFrame:
    """Days of deliveries as files of a folder, of a bounded number of lines each, which three runs work through: over the first of them, over all of
    them with the last ones cut short (a run that dies before its commit, and the one after it), and over those that
    have grown or changed back. What holds in the end is each delivery once, whatever was written on the way."""
    where = scratch(spark, "p6-files")
    root = where if "://" in where else f"file://{where.removeprefix('file:')}"
    feed = table(spark, d, "record_feed").where("arrived_at IS NOT NULL")
    lines = feed.select(F.date_format("arrived_at", "yyyy-MM-dd").alias("day"), F.floor(F.col("delivery_id") / 10_000).alias("part"), F.col("delivery_id").cast("string").alias("line"))
    days = cut(lines.groupBy("day", "part").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text")))
    names = sorted(r.day for r in days.select("day").distinct().collect())  # a name for each day
    middle, late = names[len(names) // 2], names[-len(names) // 4]
    files = days.select(F.concat("day", F.lit("-"), F.col("part").cast("string"), F.lit(".txt")).alias("relative_path"), "text", "day")
    runs = incremental.FileRuns(spark, root, f"{where}-runs")
    process = lambda entries, paths: spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"))

    def dies() -> None:
        raise InterruptedError

    write_files(files.where(F.col("day") < middle), root)
    runs.run(process)
    short = F.when(F.col("day") >= late, F.substring_index("text", "\n", 1)).otherwise(F.col("text"))
    write_files(files.where(F.col("day") >= middle).withColumn("text", short), root)
    write_files(files.where(F.col("day") == names[0]).withColumn("text", F.lit("none")), root)
    with contextlib.suppress(InterruptedError):
        runs.run(process, before_commit=dies)
    runs.run(process)
    write_files(files.where((F.col("day") >= late) | (F.col("day") == names[0])), root)
    runs.run(process)
    return runs.results().select(F.col("value").cast("long").alias("delivery_id"), F.regexp_extract("path", r"([0-9]+-[0-9]+-[0-9]+)-[0-9]+\.txt$", 1).alias("day"))


def stream_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """The feed as a stream, a few files at a time, to the last version of every record."""
    feed = f"{d}/record_fee[d].parquet"  # a pattern, as a stream's path must be a folder or a pattern
    stream = spark.readStream.schema(table(spark, d, "record_feed").schema).option("maxFilesPerTrigger", 4).parquet(feed)
    out, state = scratch(spark, "latest"), scratch(spark, "latest-state")
    latest_in_batches(stream.where("op = 'upsert'"), out, state).awaitTermination()
    return latest_of_batches(spark.read.parquet(out)).select("collection", "id", "delivery_id", "updated_at_epoch_seconds")


QUERIES = {"stream_upsert_latest": stream_upsert_latest, "p3_found": p3_found, "p6_found": p6_found, "p6_files": p6_files}

_CURRENT = """
current AS (
  SELECT snapshot_no, collection, id, coalesce(title, '') AS title, body, list_sort(map_entries(coalesce(fields, MAP {}))) AS fields,
    list_sort(map_entries(coalesce(metadata, MAP {}))) AS metadata, list_sort(list_distinct(coalesce(tags, []))) AS tags
  FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, collection, id ORDER BY updated_at_epoch_seconds DESC NULLS LAST) AS k FROM record_snapshots)
  WHERE k = 1),
numbers AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT snapshot_no FROM record_snapshots)),
later AS (SELECT c.*, n.before FROM current c JOIN numbers n USING (snapshot_no) WHERE n.before IS NOT NULL),
earlier AS (SELECT c.*, n.snapshot_no AS later FROM current c JOIN numbers n ON n.before = c.snapshot_no)
"""

_VERSIONS = """
seen AS (
  SELECT delivery_id, arrived_at,
    md5(CAST({'op': op, 'id': id, 'collection': collection, 'title': title, 'body': body, 'fields': list_sort(map_entries(fields)), 'tags': tags,
      'metadata': list_sort(map_entries(metadata)), 'at': updated_at_epoch_seconds} AS JSON)) AS version,
    EXISTS (SELECT 1 FROM ingest_runs r WHERE r.status = 'succeeded' AND r.from_arrived_at <= f.arrived_at AND f.arrived_at < r.to_arrived_at) AS is_read
  FROM record_feed f)
"""

ORACLE = {
    "stream_upsert_latest": """
        SELECT collection, id, arg_max(delivery_id, (arrived_at, delivery_id)) AS delivery_id, arg_max(updated_at_epoch_seconds, (arrived_at, delivery_id)) AS updated_at_epoch_seconds
        FROM record_feed WHERE op = 'upsert' GROUP BY collection, id""",
    "p3_found": f"""WITH {_CURRENT}
        SELECT coalesce(l.snapshot_no, e.later) AS snapshot_no, coalesce(l.collection, e.collection) AS collection, coalesce(l.id, e.id) AS id,
          CASE WHEN e.id IS NULL THEN 'added' WHEN l.id IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM later l FULL OUTER JOIN earlier e ON l.snapshot_no = e.later AND l.collection = e.collection AND l.id = e.id
        WHERE e.id IS NULL OR l.id IS NULL OR l.title <> e.title OR l.body <> e.body OR l.fields IS DISTINCT FROM e.fields
          OR l.metadata IS DISTINCT FROM e.metadata OR l.tags IS DISTINCT FROM e.tags""",
    "p6_files": "SELECT delivery_id, strftime(arrived_at, '%Y-%m-%d') AS day FROM record_feed WHERE arrived_at IS NOT NULL",
    "p6_found": f"""WITH {_VERSIONS}
        SELECT arg_min(delivery_id, (arrived_at, delivery_id)) AS delivery_id FROM seen GROUP BY version HAVING NOT bool_or(is_read)""",
}
