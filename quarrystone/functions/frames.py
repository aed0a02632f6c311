"""Helpers that every operator shares: tables, shared folder, size-checked broadcasts, skew-safe joins."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast after they were counted. At 100 bytes a row that is 10 MB.
BROADCAST_ROWS = 100_000
#: A key counts as heavy from this share of all rows on, so at most HEAVY_KEYS keys can be heavy, whatever the input.
HEAVY_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset (tests), a local one is set."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not given:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            given = tempfile.mkdtemp(prefix="quarrystone-")
            atexit.register(shutil.rmtree, given, ignore_errors=True)
        sc.setCheckpointDir(given)
    return given or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that losing an executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files and checkpoints that nothing refers to; else they stay until the driver happens to
    collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Held:
    """Tables kept in the shared folder, compressed, only until they are dropped or a block of code ends: for rows with
    texts, which a checkpoint stores as they are in memory and leaves until garbage is collected."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, scratch(spark, "held"), 0

    def __enter__(self) -> Held:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.option("compression", "zstd").parquet(at := f"{self.folder}/{self.n}")
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        release(self.spark)

    def __exit__(self, *error) -> None:
        self.drop()


def has_at_most(df: DataFrame, rows: int) -> bool:
    return len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows if rows < 1000 else df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it was counted to have at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if has_at_most(df, rows) else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], n: str, total: int) -> DataFrame:
    """Inner join of rows with one-per-key groups, where a key may hold any share of the rows.

    groups has the number of rows of each key in column n. Keys with more than total / HEAVY_KEYS rows, of which
    there can be no more than HEAVY_KEYS, are broadcast, so their rows stay where they are; the rest is shuffled.
    """
    on = [key] if isinstance(key, str) else key
    bar = max(1000, total // HEAVY_KEYS)
    heavy = groups.where(F.col(n) > bar)
    light = groups.where(F.col(n) <= bar)
    if has_at_most(heavy, 0):
        return rows.join(light, on)
    keys = F.broadcast(heavy.select(on))
    return rows.join(F.broadcast(heavy), on).unionByName(rows.join(keys, on, "left_anti").join(light, on))


def letters(x: Column) -> Column:
    """The letters of x (categories L, N and M), lower-cased; NULL as empty."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+", "")


def entries(m: Column) -> Column:
    """A map as its sorted entries, so that maps can be compared and hashed whatever the order; NULL as empty."""
    return F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))))


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that it need not be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_quarrystone_sent", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="quarrystone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "quarrystone.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._quarrystone_sent = True


def python_batches(spark: SparkSession, mb: int = 8) -> None:
    """Prepares for Python workers: sends them the package, and bounds what one gets at once by bytes, as texts may be
    long. The bound is the session's, as Spark has no other; it is only ever lowered."""
    ship(spark)
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(bound)))
    if now <= 0 or now > mb << 20:
        spark.conf.set(bound, str(mb << 20))
