"""Generations of tables on disk, and the index of records that lives in them.

A generation is a folder of Parquet tables that never changes. The file CURRENT, replaced by a rename, says which
generation and which overlay of it hold; what it does not name does not count. A writer that dies leaves folders that
nothing refers to.
"""

from __future__ import annotations

import functools
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from threading import Event, Thread

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.config import NO_PROVIDER, WRONG_VERSION, EngineError, RecordIndexConfig, RecordQuery, Recovery
from quarrystone.functions.frames import Held, cut, has_at_most, scratch, small
from quarrystone.operators import grams, search
from quarrystone.operators.records import CHUNK_SCHEMA, check_budget, chunk_records, latest_per_key, renumbered


#: Bytes of a page of a stored table; a search reads those pages that may hold its candidates.
PAGE = 64 << 10
PAGES = {"parquet.page.size": str(PAGE)}
#: How the tables of a record index are stored. Sorted grams and ids are small as differences, and dictionaries of them
#: are not.
PACKED = {"compression": "zstd", **PAGES}
STORED = {"chunks": PACKED, "postings": {**PACKED, "parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}, "tombstones": PACKED}


class Generations:
    """Tables under a path (any that Hadoop's file systems know)."""

    KEPT = 2

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm
        self._token: str | None = None

    #: Seconds after which a lock that nobody renews is taken over, and seconds between two looks at one.
    LEASE, LOOK = 120, 0.2

    def _renamed(self, part, name: str, overwrite: bool) -> bool:
        """Renames a file of the store in one step; False if the name is taken and must not be."""
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(options, int(overwrite))
        if overwrite:
            how[0] = options.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(part), self._fs.makeQualified(self._at(f"{self.path}/{name}")), how)
        except Py4JJavaError as e:
            if overwrite or "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise OSError(f"{name} could not be written") from e
            return False
        return True

    def _put(self, text: str):
        part = self._at(f"{self.path}/.part-{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        return part

    def _claimed(self, token: str) -> bool:
        """Puts the lock in its place if that is free."""
        if self._fs.getUri().getScheme() == "file":  # there, a rename does not keep what is in its place
            os.makedirs(folder := self._fs.makeQualified(self._at(self.path)).toUri().getPath(), exist_ok=True)
            try:
                with open(f"{folder}/LOCK", "x") as f:
                    f.write(token)
            except FileExistsError:
                return False
            return True
        part = self._put(token)
        if self._renamed(part, "LOCK", overwrite=False):
            return True
        self._fs.delete(part, False)
        return False

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._at(f"{self.path}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _age(self, name: str) -> float | None:
        """Seconds since a file was changed, by the clock of the file system; None if it is gone."""
        part = self._put("")
        try:
            now = self._fs.getFileStatus(part).getModificationTime()
            return (now - self._fs.getFileStatus(self._at(f"{self.path}/{name}")).getModificationTime()) / 1000
        except Py4JJavaError:
            return None
        finally:
            self._fs.delete(part, False)

    @contextmanager
    def locked(self) -> Iterator[None]:
        """One writer at a time, on any file system that renames a file in one step.

        The lock is a file that only one writer can put in its place; its holder renews it. A lock that was not renewed
        for LEASE seconds is that of a dead writer and is moved away. May be taken again by the holder.
        """
        if self._token is not None:
            yield
            return
        token = uuid.uuid4().hex
        while not self._claimed(token):
            if (age := self._age("LOCK")) is not None and age > self.LEASE:
                self._fs.rename(self._at(f"{self.path}/LOCK"), self._at(f"{self.path}/.dead-{uuid.uuid4().hex}"))
            else:
                time.sleep(self.LOOK)
        self._token, stop = token, Event()

        def renew() -> None:
            while not stop.wait(self.LEASE / 4):
                self._fs.setTimes(self._at(f"{self.path}/LOCK"), int(time.time() * 1000), -1)

        keeper = Thread(target=renew, daemon=True)
        keeper.start()
        try:
            yield
        finally:
            stop.set()
            keeper.join()
            self._token = None
            if self._holds(token):
                self._fs.delete(self._at(f"{self.path}/LOCK"), False)

    def _holds(self, token: str) -> bool:
        return self._fs.exists(self._at(f"{self.path}/LOCK")) and self._text("LOCK") == token

    def _write_current(self, meta: dict) -> None:
        if not self._holds(self._token):
            raise OSError("the lock was lost to another writer")
        self._renamed(self._put(json.dumps(meta)), "CURRENT", overwrite=True)

    def current(self) -> dict | None:
        """What CURRENT says; None if there is none. Raises ValueError if it cannot be read."""
        p = self._at(f"{self.path}/CURRENT")
        if not self._fs.exists(p):
            return None
        meta = json.loads(self._text("CURRENT"))
        if not self._fs.exists(self._at(f"{self.path}/generations/{meta['generation']}")):
            raise ValueError(f"generation {meta['generation']} is missing")
        return meta

    @staticmethod
    def require_version(meta: dict, version: int) -> None:
        if meta.get("version") != version:
            raise EngineError(WRONG_VERSION, f"the index has version {meta.get('version')}, not {version}")

    def _write(self, folder: str, tables: dict[str, DataFrame | Callable], stored: dict[str, dict[str, str]], otherwise: dict[str, str]) -> None:
        for table, df in tables.items():
            df = df(lambda of: self.spark.read.parquet(f"{folder}/{of}")) if callable(df) else df
            df.write.mode("overwrite").options(**stored.get(table, otherwise)).parquet(f"{folder}/{table}")

    def publish(self, tables: dict[str, DataFrame | Callable], meta: dict, stored: dict[str, dict[str, str]] = {}) -> dict:
        """A new generation. Its name begins with the time, so that names sort, and no two are the same. A table may be
        a function that makes it out of those written before. stored: options of writing, by table."""
        with self.locked():
            name = f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
            self._write(f"{self.path}/generations/{name}", tables, stored, {"parquet.bloom.filter.enabled#gram": "true", **PAGES})
            meta = {**meta, "generation": name, "overlay": 0, "kept": {}, "written": int(time.time())}
            self._write_current(meta)
            self._retire()
        return meta

    def publish_overlay(self, meta: dict, tables: dict[str, DataFrame | Callable], stored: dict[str, dict[str, str]] = {}, stay: tuple[str, ...] = (), **more) -> dict:
        """A new overlay of the current generation, in place of the one before. stay: tables of that one that are the new
        one's as they are, without a copy."""
        with self.locked():
            k = f"{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
            self._write(f"{self.path}/generations/{meta['generation']}/overlay-{k}", tables, stored, {})
            kept = {t: meta.get("kept", {}).get(t, meta["overlay"]) for t in stay}
            meta = {**meta, **more, "overlay": k, "kept": kept, "written": int(time.time())}
            self._write_current(meta)
        return meta

    def _retire(self) -> None:
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/generations")))
        for old in names[: -self.KEPT]:
            self._fs.delete(self._at(f"{self.path}/generations/{old}"), True)

    def read(self, meta: dict, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/generations/{meta['generation']}/{table}")

    def read_overlay(self, meta: dict, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/generations/{meta['generation']}/overlay-{meta.get('kept', {}).get(table, meta['overlay'])}/{table}")

    def remove(self) -> None:
        self._fs.delete(self._at(self.path), True)


def changes(method: Callable) -> Callable:
    """A change of an index: under the lock of its store, from what the last writer left."""

    @functools.wraps(method)
    def run(self, *args, **options):
        with self.store.locked():
            self.meta = self.store.current() or self.meta
            return method(self, *args, **options)

    return run


@dataclass(frozen=True)
class Maintained:
    """What a change did to an index."""

    upserted: int = 0
    deleted: int = 0
    compacted: bool = False
    rebuilt: bool = False


class RecordIndex:
    """Chunks of records with postings, kept as generations; searched, changed, compacted and recovered.

    Active chunks are those of base and overlay without tombstones, for either: a replaced chunk never comes back,
    whether it was in the base or in the overlay, and ids are never used again.
    """

    VERSION = 1

    def __init__(self, spark: SparkSession, config: RecordIndexConfig = RecordIndexConfig(), provider=None):
        self.spark, self.config, self.provider = spark, config, provider
        self.store = Generations(spark, config.storage or scratch(spark, "record-index"))
        self.meta = self._opened()
        if config.compact_on_open and self.meta.get("overlay"):
            self.compact()

    # Opening and recovering

    def _opened(self) -> dict:
        try:
            meta = self.store.current()
            if meta is None:
                return self._replace(self._empty(), 0)
            self.store.require_version(meta, self.VERSION)
            self.store.read(meta, "chunks").limit(1).count()
            return meta
        except Exception as e:
            if self.config.recovery is Recovery.FAIL:
                raise
            if self.config.recovery is Recovery.REBUILD and self.provider is None:
                raise EngineError(NO_PROVIDER, "the index is damaged and there is no provider to rebuild it from") from e
            self.store.remove()
            if self.config.recovery is Recovery.DISCARD:
                return self._replace(self._empty(), 0)
            return self._built(self.provider.load(self.spark))

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], CHUNK_SCHEMA)

    def _replace(self, chunks: DataFrame, next_id: int, held: Held | None = None) -> dict:
        def entries(written: Callable[[str], DataFrame]) -> DataFrame:
            if held is not None:  # the chunks are written
                held.drop()
            return grams.sorted_postings(written("chunks"), self.config.index.max_gram_length)

        self.meta = self.store.publish({"chunks": chunks, "postings": entries}, {"version": self.VERSION, "next_id": next_id}, STORED)
        return self.meta

    def _built(self, records: DataFrame, by: str | None = None) -> dict:
        with Held(self.spark) as held:
            chunks = chunk_records(records, self.config.chunking, by=by, kept=held.keep)
            self._check(chunks)
            return self._replace(chunks, chunks.count(), held)

    def _check(self, chunks: DataFrame) -> None:
        if self.config.budget is not None:
            check_budget(chunks, self.config.budget)

    # The tables

    def _overlay(self, table: str) -> DataFrame | None:
        return self.store.read_overlay(self.meta, table) if self.meta.get("overlay") else None

    def chunks(self) -> DataFrame:
        """The active chunks."""
        return self._active("chunks")

    def postings(self) -> DataFrame:
        """The postings of the active chunks."""
        return self._active("postings")

    def _active(self, table: str) -> DataFrame:
        base, overlay = self.store.read(self.meta, table), self._overlay(table)
        if overlay is None:
            return base
        return base.unionByName(overlay).join(self._overlay("tombstones"), "chunk_id", "left_anti")

    # Changes

    @changes
    def replace_all(self, records: DataFrame, by: str | None = None) -> Maintained:
        """The index of these records and no others. Equal keys are all kept. Budgets are checked before it is published."""
        self._built(records, by)
        return Maintained(compacted=True, rebuilt=True)

    def rebuild(self) -> Maintained:
        if self.provider is None:
            raise EngineError(NO_PROVIDER, "there is no provider to rebuild from")
        return self.replace_all(self.provider.load(self.spark))

    @changes
    def upsert(self, records: DataFrame, by: str | None = None) -> Maintained:
        """Puts records in place of those with their collection and id; the last of a batch counts, by the column `by`,
        else by the order of the rows. All or nothing: over budget, nothing changes."""
        if has_at_most(records, 0):
            return Maintained()
        order = by or "__order"
        batch = records if by else records.withColumn(order, F.monotonically_increasing_id())
        with Held(self.spark) as held:
            batch = held.keep(latest_per_key(batch, order))
            keys = batch.select("collection", F.col("id").alias("record_id"))
            replaced = self.chunks().join(small(keys), ["collection", "record_id"], "left_semi").select("chunk_id")
            new = chunk_records(batch.drop(order), self.config.chunking, start=self.meta["next_id"], kept=held.keep)
            result = Maintained(upserted=batch.count())
            self._commit(new, replaced)
        if self.config.compaction_threshold <= self.store.read_overlay(self.meta, "chunks").count():
            self.compact()
            return Maintained(upserted=result.upserted, compacted=True)
        return result

    @changes
    def delete(self, ids: list[str] | DataFrame, collection: str | None = None) -> Maintained:
        """Removes records by id, in one collection or in all. Counts the keys that were there."""
        wanted = ids.select("id").distinct() if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in set(ids)], "id string")
        found = self.chunks().join(small(wanted), F.col("record_id") == F.col("id"), "left_semi")
        return self._deleted(found if collection is None else found.where(F.col("collection") == collection))

    @changes
    def delete_keys(self, keys: DataFrame) -> Maintained:
        """Removes the records with these collections and ids."""
        wanted = keys.select("collection", F.col("id").alias("record_id")).distinct()
        return self._deleted(self.chunks().join(small(wanted), ["collection", "record_id"], "left_semi"))

    def _deleted(self, chunks: DataFrame) -> Maintained:
        found = cut(chunks.select("collection", "record_id", "chunk_id"))
        n = found.select("collection", "record_id").distinct().count()
        if n:
            self._commit(None, found.select("chunk_id"))
        return Maintained(deleted=n)

    def _commit(self, new: DataFrame | None, dead: DataFrame) -> None:
        """An overlay with new chunks, or none, and further dead ones. Without new ones, an overlay's chunks and postings
        stay where they are."""
        before = bool(self.meta.get("overlay"))
        overlay, stay = {"tombstones": dead}, ("chunks", "postings") if before and new is None else ()
        if not stay:
            new = self._empty() if new is None else new
            overlay |= {"chunks": new, "postings": grams.sorted_postings(new, self.config.index.max_gram_length)}
        if before:
            overlay = {t: self.store.read_overlay(self.meta, t).unionByName(df) for t, df in overlay.items()}
        overlay["tombstones"] = cut(overlay["tombstones"].distinct())
        if self.config.budget is not None:
            base = self.store.read(self.meta, "chunks").unionByName(self._overlay("chunks") if stay else overlay["chunks"])
            self._check(base.join(overlay["tombstones"], "chunk_id", "left_anti"))
        self.meta = self.store.publish_overlay(self.meta, overlay, STORED, stay, next_id=self.meta["next_id"] + (0 if new is None else new.count()))

    @changes
    def compact(self) -> Maintained:
        """Renumbers the active chunks into a new base; overlay and tombstones go. Texts are not chunked again."""
        with Held(self.spark) as held:
            chunks = renumbered(self.chunks(), kept=held.keep)
            self._replace(chunks, chunks.count(), held)
        return Maintained(compacted=True)

    def remove(self) -> None:
        self.store.remove()

    # Questions

    def search(self, query: RecordQuery, strategy: str = "scan") -> tuple[DataFrame, DataFrame]:
        """(hits, one-row report). strategy: scan, or indexed to narrow the chunks by postings first."""
        entries = self.postings() if strategy == "indexed" else None
        chunks = self.chunks()
        return search.hits(chunks, query, entries, self.config.index), search.report(chunks, query, entries, self.config.index)

    def status(self, *names: str) -> DataFrame:
        """One row: record_count, chunk_count, resident_bytes, gram_count, overlay_chunk_count, tombstone_count,
        generation, age_seconds (never below 0). names: the counts to make, if not all; counting grams is the dear one."""
        none = self.spark.range(0)
        overlay, dead = self._overlay("chunks"), self._overlay("tombstones")
        rows = lambda df: (none if df is None else df).agg(F.count(F.lit(1)))
        chunks = index_status(self.chunks())
        counts = {c: chunks.select(c) for c in chunks.columns}
        counts |= {"gram_count": self.postings().agg(F.count_distinct("gram")), "overlay_chunk_count": rows(overlay), "tombstone_count": rows(dead)}
        return one_row({n: df for n, df in counts.items() if not names or n in names}).select("*", F.lit(self.meta["generation"]).alias("generation"), age_seconds(self.meta).alias("age_seconds"))


def one_row(counts: dict[str, DataFrame]) -> DataFrame:
    """One row out of several one-value tables."""
    out = None
    for name, df in counts.items():
        part = df.toDF("value").select(F.lit(name).alias("name"), F.col("value").cast("long").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out.agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in counts))


def age_seconds(meta: dict) -> Column:
    return F.lit(max(0, int(time.time()) - int(meta.get("written", 0))))


def index_status(chunks: DataFrame) -> DataFrame:
    """One row about chunks: record_count (by collection and id), chunk_count, resident_bytes."""
    return chunks.agg(
        F.count_distinct(F.struct("collection", "record_id")).alias("record_count"),
        F.count(F.lit(1)).alias("chunk_count"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("resident_bytes"),
    )
