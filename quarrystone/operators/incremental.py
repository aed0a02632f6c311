"""Processing only what is new or changed since the last successful run.

A manifest lists the inputs that successful runs processed, each with its size and checksum; the last entry of an
input holds. A run anti-joins the listing of what is there against the manifest, writes its output and its entries under
a batch identifier that follows from the inputs and from the batches before, and only then commits both, by one small
file. A run that dies before the commit leaves nothing that counts: the next run finds the same inputs, derives the same
identifier and overwrites what was written.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.functions.frames import BROADCAST_ROWS, cut, entries, has_at_most, scratch, small

RECORD_COLUMNS = ("id", "collection", "title", "body", "fields", "tags", "metadata", "updated_at_epoch_seconds")


def unprocessed(listing: DataFrame, manifest: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """The entries of a listing that no entry of the manifest equals in the columns `on` (NULLs equal each other)."""
    keys = manifest.select(*(F.col(c).alias(f"__done_{c}") for c in on)).distinct()
    same = [listing[c].eqNullSafe(keys[f"__done_{c}"]) for c in on]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return listing.join(keys, cond, "left_anti")


class Runs:
    """Incremental runs: a manifest of what was processed, output by batch, and commits.

    folder is a path that all executors share. Below it, entries/batch=<id> lists what a batch processed,
    outputs/__batch=<id> holds what it wrote, and the last of commits/<number> names the batches that count, in order. A
    commit is one small file that is created only if its number is free, so of two runs that end at once one has to
    begin again. What the last commit does not name does not count.
    """

    #: Columns that tell one input from another, and those in which it has to equal its last entry to be done.
    KEY: tuple[str, ...] = ("path",)
    SAME: tuple[str, ...] = ("size", "checksum")
    SCHEMA = "path string, size long, modified timestamp, checksum string, listed timestamp, written string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jvm, self._at = jvm, lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._fs = self._at("commits").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # The manifest

    def _commits(self) -> list[tuple[str, bool]]:
        """(batch, whether it wrote output) of the committed batches in their order, as the last commit lists them."""
        if not self._fs.exists(self._at("commits")):
            return []
        numbers = [n for s in self._fs.listStatus(self._at("commits")) if (n := s.getPath().getName()).isdigit()]
        if not numbers:
            return []
        stream = self._fs.open(self._at(f"commits/{max(numbers)}"))
        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return [(b, o == "output") for b, o in map(str.split, text.splitlines())]

    def batches(self) -> list[str]:
        """The committed batches in the order of their commits."""
        return [b for b, _ in self._commits()]

    def outputs(self, batches: list[str]) -> DataFrame:
        """What batches wrote, with the batch in the column __batch."""
        paths = [f"{self.folder}/outputs/__batch={b}" for b in batches]
        schema = self.spark.read.parquet(paths[-1]).schema.add("__batch", "string")
        return self.spark.read.option("basePath", f"{self.folder}/outputs").schema(schema).parquet(*paths)

    def history(self) -> DataFrame:
        """Everything that committed batches processed: the columns of an entry, its batch and the number of the commit."""
        batches = self.batches()
        if not batches:
            return self.spark.createDataFrame([], f"{self.SCHEMA}, batch string, commit int")
        order = self.spark.createDataFrame([(b, k) for k, b in enumerate(batches)], "batch string, commit int")
        read = self.spark.read.option("basePath", f"{self.folder}/entries").schema(f"{self.SCHEMA}, batch string")
        return read.parquet(*(f"{self.folder}/entries/batch={b}" for b in batches)).join(small(order), "batch")

    def manifest(self, only: DataFrame | None = None) -> DataFrame:
        """The last entry of each input (of those in only, a table of few keys); written names the batch whose output
        holds it."""
        done = self.history()
        if only is not None:
            done = done.join(F.broadcast(only), list(self.KEY), "left_semi")
        whole = F.struct(*(c for c in done.columns if c not in self.KEY))
        return done.groupBy(*self.KEY).agg(F.max_by(whole, "commit").alias("e")).select(*self.KEY, "e.*")

    def results(self) -> DataFrame | None:
        """The output that holds for each input: that of its last entry. None before the first commit.

        An input that changed and changed back shows the output of its last run alone.
        """
        batches = [b for b, wrote in self._commits() if wrote]
        if not batches:
            return None
        live = self.manifest().select(*(F.col(k).alias(f"__{k}") for k in self.KEY), F.col("written").alias("__written"))
        out = self.outputs(batches)
        same = out["__batch"] == live["__written"]
        for k in self.KEY:
            same = same & out[k].eqNullSafe(live[f"__{k}"])
        return out.join(live, same, "left_semi").drop("__batch")

    # A run

    def unlisted(self, listing: DataFrame) -> DataFrame:
        """The entries of a listing that differ from the last entry of the same input, or have none."""
        few = listing.select(*self.KEY) if has_at_most(listing, BROADCAST_ROWS) else None
        return unprocessed(listing, self.manifest(few), (*self.KEY, *self.SAME))

    def _batch(self, todo: DataFrame, number: int) -> str:
        """An identifier that follows from the inputs, whatever their order, and from how many batches came before."""
        words = todo.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in (*self.KEY, *self.SAME)), F.lit(k)).cast("decimal(38,0)")).alias(f"w{k}") for k in (1, 2))).first()
        return hashlib.sha256(f"{number} {words.n} {words.w1} {words.w2}".encode()).hexdigest()[:16]

    def commit(self, todo: DataFrame, output: Callable[[DataFrame], DataFrame] | None = None, before_commit: Callable[[], None] | None = None, kept: DataFrame | None = None) -> str:
        """Writes what output makes of todo, then the entries of todo (and of kept, whose output is that of an earlier
        batch), then commits both. todo: rows of the columns of an entry that do not change from reading to reading."""
        before = self._commits()
        number = len(before)
        batch = self._batch(todo if kept is None else todo.unionByName(kept.select(todo.columns)), number)
        if output is not None:
            output(todo).write.mode("overwrite").parquet(f"{self.folder}/outputs/__batch={batch}")
        columns = [c.split()[0] for c in self.SCHEMA.split(", ")]
        entries = todo.withColumn("written", F.lit(batch))
        entries = entries if kept is None else entries.unionByName(kept)
        for c in columns:
            if c not in entries.columns:
                entries = entries.withColumn(c, F.lit(None))
        kinds = dict(c.split() for c in self.SCHEMA.split(", "))
        entries.select(*(F.col(c).cast(kinds[c]).alias(c) for c in columns)).write.mode("overwrite").parquet(f"{self.folder}/entries/batch={batch}")
        if before_commit:
            before_commit()
        part, whole = self._at(f"commits/.{batch}-{uuid.uuid4().hex}"), self._at(f"commits/{number:012d}")
        stream = self._fs.create(part, True)
        stream.write(bytearray("".join(f"{b} {'output' if o else 'none'}\n" for b, o in [*before, (batch, output is not None)]).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(part), self._fs.makeQualified(whole), none)
        except Exception as e:
            self._fs.delete(part, False)
            raise RuntimeError(f"another run committed before batch {batch}; run again") from e
        return batch


def spellings(path: str) -> set[str]:
    """A file's path as Spark's sources spell it: plain or with characters escaped, with one slash or three after the
    scheme of the local file system."""
    escaped = re.sub(r"[\x00-\x20\x7f%\"<>\\^`{|}#?\[\]]", lambda m: f"%{ord(m[0]):02X}", path)
    both = {path, escaped}
    return both | {re.sub("^file:/(?!/)", "file:///", p) for p in both}


def to_read(path: str) -> str:
    """A path for Spark's readers, which would take some characters of a name for a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


class FileRuns(Runs):
    """Incremental runs over the files of a folder, at most FILES of them in a batch.

    Names that begin with a dot or an underscore are not listed, as Spark takes them for its own. A file is looked into
    only if its size or time of change differs from its last entry, or if it changed so shortly
    before that entry was listed that a later change could bear the same time. A file with the content of its last
    entry is not processed again; its entry is brought up to date.
    """

    #: Files of a batch, whose paths pass through the driver, and seconds within which a time of change tells nothing.
    FILES, UNSURE = 10_000, 2

    def __init__(self, spark: SparkSession, inputs: str, folder: str):
        super().__init__(spark, folder)
        self.inputs = inputs

    def listing(self, glob: str = "*") -> DataFrame:
        """path, size, modified, listed of the input files; their contents are not read."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(self.inputs)
        return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.current_timestamp().alias("listed"))

    def suspects(self, glob: str = "*") -> DataFrame:
        """Entries of the listing without checksum that may be new or changed, in the order of paths."""
        last = self.manifest().select("path", F.col("size").alias("__size"), F.col("modified").alias("__modified"), F.col("listed").alias("__listed"))
        sure = F.col("__size").eqNullSafe(F.col("size")) & F.col("__modified").eqNullSafe(F.col("modified")) & (F.unix_micros("__listed") - F.unix_micros("__modified") > self.UNSURE * 1_000_000)
        return self.listing(glob).join(last, "path", "left").where(~F.coalesce(sure, F.lit(False))).select("path", "size", "modified", "listed").orderBy("path")

    def _checked(self, block: list) -> DataFrame:
        """The files of a block with size and checksum of what is in them now."""
        found = self.spark.createDataFrame([(r.path, r.modified, r.listed) for r in block], "path string, modified timestamp, listed timestamp")
        read = self.spark.read.format("binaryFile").load([to_read(r.path) for r in block]).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("checksum"))
        return found.join(read, "path").select("path", "size", "modified", "checksum", "listed")

    def _blocks(self, glob: str) -> Iterator[DataFrame]:
        block: list = []
        for r in cut(self.suspects(glob)).toLocalIterator():
            block.append(r)
            if len(block) == self.FILES:
                yield cut(self._checked(block))
                block = []
        if block:
            yield cut(self._checked(block))

    def pending(self, glob: str = "*") -> DataFrame:
        """path, size, modified, checksum, listed of the files that the next run would process."""
        out = self.spark.createDataFrame([], "path string, size long, modified timestamp, checksum string, listed timestamp")
        for block in self._blocks(glob):
            out = out.unionByName(self.unlisted(block))
        return out

    def _named(self, out: DataFrame, paths: list[str]) -> DataFrame:
        """Output with each row's path as the manifest has it."""
        known = self.spark.createDataFrame([(a, p) for p in paths for a in spellings(p)], "__alias string, __path string")
        stray = F.raise_error(F.concat(F.lit("no file of this batch: "), F.coalesce("path", F.lit("NULL")))).cast("string")
        joined = out.join(F.broadcast(known), out["path"] == known["__alias"], "left")
        return joined.withColumn("path", F.coalesce("__path", stray)).drop("__alias", "__path")

    def run(self, process: Callable[[DataFrame, list[str]], DataFrame], glob: str = "*", before_commit: Callable[[], None] | None = None) -> list[str]:
        """Processes the files that are new or changed and returns the ids of the batches that were committed.

        process gets the entries of a batch and their paths as readers take them, at most FILES, and keeps the path that a row is from in
        the column path, plain or as _metadata.file_path or input_file_name() have it; any other path is an error. A run that dies leaves the batches that it committed; the next one does the rest.
        """
        out = []
        for block in self._blocks(glob):
            todo = cut(self.unlisted(block))
            paths = [r.path for r in todo.select("path").orderBy("path").collect()]
            last = self.manifest().select("path", "written")
            settled = F.unix_micros("listed") - F.unix_micros("modified") > self.UNSURE * 1_000_000
            kept = cut(block.where(settled).join(todo.select("path"), "path", "left_anti").join(last, "path"))
            if paths:
                out.append(self.commit(todo, lambda d, paths=paths: self._named(process(d, list(map(to_read, paths))), paths), before_commit, kept))
            elif not has_at_most(kept, 0):
                self.commit(todo, None, None, kept)
        return out


class DeliveryRuns(Runs):
    """Incremental runs over deliveries of records. Deliveries with equal op and record columns are one version, which
    is an input of its own; its checksum and the size of its body tell it from others."""

    KEY, SAME = ("checksum", "size"), ()
    SCHEMA = "checksum binary, size int, written string"

    def import_log(self, seen: DataFrame) -> str:
        """Commits the versions that runs before the manifest read; their output lies elsewhere, so there is none here.
        seen: checksum, size, read."""
        return self.commit(cut(seen.where("read").select("checksum", "size").distinct()))

    def run(self, seen: DataFrame, before_commit: Callable[[], None] | None = None) -> str | None:
        """Processes the versions with a delivery that no run has read, and returns the batch's id, None if there are
        none. The output is the earliest of those deliveries (by arrived_at, then delivery_id; NULL times last)."""
        order = F.struct(F.col("arrived_at").isNull(), "arrived_at", "delivery_id")
        listing = cut(seen.where("NOT read").groupBy("checksum", "size").agg(F.min(order)["delivery_id"].alias("delivery_id")))
        todo = cut(self.unlisted(listing))
        return None if has_at_most(todo, 0) else self.commit(todo, lambda d: d, before_commit)


def version_checksum(op: str = "op") -> Column:
    """128 bits of a delivery's op and record columns; maps count as sets of entries, arrays in their order."""
    columns = [F.col(op), *(entries(F.col(c)).alias(c) if c in ("fields", "metadata") else F.col(c) for c in RECORD_COLUMNS)]
    return F.unhex(F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))


def covered_periods(runs: DataFrame) -> DataFrame:
    """begin, end of the disjoint periods that succeeded runs read; rows with a NULL or empty period are left out."""
    read = runs.where("status = 'succeeded' AND from_arrived_at < to_arrived_at").select(F.col("from_arrived_at").alias("begin"), F.col("to_arrived_at").alias("end")).distinct()
    by_time = Window.orderBy("begin", "end")
    reach = F.max("end").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    fresh = read.withColumn("fresh", F.when(reach.isNull() | (F.col("begin") > reach), 1).otherwise(0))
    return fresh.withColumn("period", F.sum("fresh").over(by_time)).groupBy("period").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).select("begin", "end")


def in_periods(deliveries: DataFrame, periods: DataFrame) -> DataFrame:
    """deliveries with read: whether arrived_at lies in one of the disjoint periods (begin inclusive, end exclusive).

    Both sides meet on the day, so each delivery is compared with the few periods that touch its day.
    """
    days = periods.select("begin", "end", F.explode(F.sequence(F.to_date("begin"), F.to_date("end"))).alias("day"))
    at = deliveries.withColumn("day", F.to_date("arrived_at"))
    hit = (at["day"] == days["day"]) & (at["arrived_at"] >= days["begin"]) & (at["arrived_at"] < days["end"])
    return at.join(small(days), hit, "left").select(*(at[c] for c in at.columns if c != "day"), days["begin"].isNotNull().alias("read"))


def pending_deliveries(feed: DataFrame, runs: DataFrame, folder: str | None = None) -> DataFrame:
    """delivery_id of the deliveries that the next run has to process, which it hereby does: they are the output that
    a run writes by its batch identifier and commits to the manifest in folder (by default a new one).

    A version with a delivery that a succeeded run read is done; of any other, the earliest delivery is due. The log of
    past runs is committed to a new manifest first. A record with any share of the rows is no hot key, as its versions
    spread, and versions sent often are aggregated before the shuffle. A delivery without a time was read by no run.
    """
    spark = feed.sparkSession
    size = F.coalesce(F.octet_length("body"), F.lit(-1)).alias("size")
    read = feed.select("delivery_id", "arrived_at", version_checksum().alias("checksum"), size)
    seen = cut(in_periods(read, covered_periods(runs)))
    log = DeliveryRuns(spark, folder or scratch(spark, "deliveries"))
    if not log.batches():
        log.import_log(seen)
    batch = log.run(seen)
    return spark.createDataFrame([], feed.select("delivery_id").schema) if batch is None else log.outputs([batch]).select("delivery_id")
