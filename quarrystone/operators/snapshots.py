"""What changed between full snapshots, by invertible Bloom lookup tables.

Every row of a snapshot becomes an element: 48 bits of its key and 56 bits of its whole content. Each task sums its
elements into the cells of a table per snapshot and hash bucket, in arrays, and packs what it has of a group of buckets
into one value; these are all that is shuffled, once. A cell holds a count and sums, so subtracting the table of one
snapshot from that of the next leaves only what differs, however large the snapshots are. A small sample of keys that is
compared outright tells how many differences there are, and the tables are made for that many. Buckets are then peeled:
a cell that holds copies of one element gives the element away, which is taken out of its other cells, and so on. A
bucket that cannot be emptied is built again with twice the cells. The recovered keys are a superset of the changed
ones; their rows, and no others, are compared exactly.

Sums are used instead of exclusive-or so that a row which a snapshot repeats is an element of a larger count. They wrap
around at more bits than an element has, so a cell of up to 255 copies, or of an odd multiple of them, can be divided.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.frames import BROADCAST_ROWS, cut, entries, has_at_most, ship, small

#: Rows of a snapshot that share a bucket, the fewest cells of each of a bucket's three tables, and rounds of enlarging.
BUCKET_ROWS, CELLS, ROUNDS = 4096, 8, 6
#: Rows of a snapshot, about, whose keys are compared to learn how many cells are needed.
SAMPLED = 4096
#: Placements that a task holds before it sums them up.
HELD = 2_000_000
KEY_BITS, ROW_BITS, CHECK_BITS, SPARE = 48, 56, 16, 8
LOW = 0xFFFFFFFF


def content_digest() -> Column:
    """128 bits of what makes a record's content: title (NULL as empty), body, fields and metadata as sets of entries,
    tags as a set. The time is no part of it."""
    tags = F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))))
    return F.unhex(F.md5(F.to_json(F.struct(F.coalesce("title", F.lit("")).alias("t"), F.col("body").alias("b"), entries(F.col("fields")).alias("f"), entries(F.col("metadata")).alias("m"), tags.alias("g")))))


def _hash_long(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of 8 bytes, as xxhash64 computes it for a bigint."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = seed + p5 + np.uint64(8)
    h = rot(h ^ (rot(value * p2, 31) * p1), 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def check_word(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The low bits of xxhash64(key, row), of two numbers."""
    with np.errstate(over="ignore"):
        return _hash_long(row, _hash_long(key, np.full(len(key), 42, np.uint64))) & _mask(CHECK_BITS)


def places(row: np.ndarray, cells: int) -> np.ndarray:
    """The cell of an element in each of the three tables."""
    return np.stack([((row >> np.uint64(18 * j)) & _mask(18)).astype(np.int64) % cells for j in range(3)])


class Cells:
    """Cells by their place: counts, and sums that wrap around."""

    def __init__(self, at: np.ndarray, n: np.ndarray, key: np.ndarray, row: np.ndarray, check: np.ndarray):
        self.at, self.n, self.key, self.row, self.check = at, n, key, row, check

    @classmethod
    def none(cls) -> Cells:
        empty = np.zeros(0, np.uint64)
        return cls(np.zeros(0, np.int64), np.zeros(0, np.int64), empty, empty, empty)

    @classmethod
    def joined(cls, parts: list[Cells]) -> Cells:
        return cls(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("at", "n", "key", "row", "check")))

    def summed(self) -> Cells:
        """The same with each place once, in order."""
        if not len(self.at):
            return self
        order = np.argsort(self.at, kind="stable")
        at = self.at[order]
        starts = np.nonzero(np.concatenate(([True], at[1:] != at[:-1])))[0]
        return Cells(at[starts], *(np.add.reduceat(x[order], starts) for x in (self.n, self.key, self.row, self.check)))

    def part(self, a: int, b: int) -> Cells:
        return Cells(self.at[a:b], self.n[a:b], self.key[a:b], self.row[a:b], self.check[a:b])

    def packed(self, base: int) -> bytes:
        """As bytes: places from base on as differences and counts, compressed; then the sums, as many bytes as count."""
        steps = np.diff(self.at, prepend=base).astype(np.uint32)
        index = zlib.compress(steps.tobytes() + self.n.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)
        low = lambda x, bits: np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, : bits // 8].tobytes()
        return np.array([len(self.at), len(index)], np.uint32).tobytes() + index + low(self.key, KEY_BITS + SPARE) + low(self.row, 64) + low(self.check, CHECK_BITS)

    @classmethod
    def unpacked(cls, data: bytes) -> Cells:
        """Places count from 0."""
        m, size = (int(x) for x in np.frombuffer(data, np.uint32, 2))
        index, at = zlib.decompress(data[8 : 8 + size]), 8 + size
        out = []
        for bits in (KEY_BITS + SPARE, 64, CHECK_BITS):
            wide = np.zeros((m, 8), np.uint8)
            wide[:, : bits // 8] = np.frombuffer(data, np.uint8, m * bits // 8, at).reshape(m, -1)
            out.append(wide.view(np.uint64).ravel())
            at += m * bits // 8
        n = np.ascontiguousarray(np.frombuffer(index, np.uint8, 8 * m, 4 * m).reshape(8, m).T).view(np.int64).ravel()
        return cls(np.cumsum(np.frombuffer(index, np.uint32, m).astype(np.int64)), n, *out)


def _inverse(odd: np.ndarray) -> np.ndarray:
    """Of odd numbers, modulo 2^64."""
    x = (odd * np.uint64(3)) ^ np.uint64(2)
    for _ in range(4):
        x = x * (np.uint64(2) - odd * x)
    return x


def peel(n: np.ndarray, key: np.ndarray, row: np.ndarray, check: np.ndarray, cells: int, buckets: int, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts, buckets that cannot be emptied) of the elements in the difference of two tables.

    The arrays hold the cells of successive buckets from the first on, three tables of so many cells each, and are
    changed. The key of an element gives its bucket of all the buckets, its row its cells.
    """
    keys, counts = [], []
    with np.errstate(over="ignore"):
        key &= _mask(KEY_BITS + SPARE)
        check &= _mask(CHECK_BITS)
        while True:
            at = np.nonzero(n)[0]
            m = n[at]
            low = m & -m
            twos = np.log2(low.astype(float)).astype(np.uint64)
            inverse = _inverse((m >> twos.astype(np.int64)).astype(np.uint64))
            r = ((row[at] >> twos) * inverse) & (_mask(64) >> twos)
            k = ((key[at] >> twos) * inverse) & (_mask(KEY_BITS + SPARE) >> twos)
            fits = (twos <= SPARE) & (r <= _mask(ROW_BITS)) & (k <= _mask(KEY_BITS)) & (row[at] == r * m.astype(np.uint64))
            at, m, r, k = at[fits], m[fits], r[fits], k[fits]
            word = check_word(k, r)
            p = places(r, cells) + (np.arange(3) * cells)[:, None] + ((k % np.uint64(buckets)).astype(np.int64) - first) * 3 * cells
            pure = (p[at // cells % 3, np.arange(len(at))] == at) & ((word * m.astype(np.uint64)) & _mask(CHECK_BITS) == check[at])
            if not pure.any():
                break
            _, once = np.unique(r[pure], return_index=True)
            pick = np.nonzero(pure)[0][once]
            m, r, k, word, p = m[pick], r[pick], k[pick], word[pick], p[:, pick].ravel()
            keys.append(k)
            counts.append(m)
            np.subtract.at(n, p, np.tile(m, 3))
            for sums, each in ((key, k), (row, r), (check, word)):
                np.subtract.at(sums, p, np.tile(each * m.astype(np.uint64), 3))
            key &= _mask(KEY_BITS + SPARE)
            check &= _mask(CHECK_BITS)
    left = np.nonzero((n != 0) | (key != 0) | (row != 0) | (check != 0))[0]
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(keys, np.uint64), join(counts, np.int64), np.unique(left // (3 * cells)) + first


def _tables(numbers: list[int], buckets: int, in_group: int, cells: int):
    """Tasks' elements to packed cells of groups of buckets."""
    width = len(numbers) * 3 * cells  # places of a bucket

    def out(held: Cells) -> Iterator[pd.DataFrame]:
        group = held.at // (in_group * width)
        starts = np.nonzero(np.diff(group, prepend=-1))[0]
        ends = np.append(starts[1:], len(group))
        for k in range(0, len(starts), 1000):
            parts = [(int(group[a]), held.part(a, b).packed(int(group[a]) * in_group * width)) for a, b in zip(starts[k : k + 1000], ends[k : k + 1000], strict=True)]
            yield pd.DataFrame(parts, columns=["group", "cells"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        order = np.array(numbers)
        for b in batches:
            key, row = b.key.to_numpy(np.int64).astype(np.uint64), b.row.to_numpy(np.int64).astype(np.uint64)
            table = (key % np.uint64(buckets)).astype(np.int64) * len(order) + np.searchsorted(order, b.snapshot_no.to_numpy())
            at = places(row, cells) + (np.arange(3) * cells)[:, None] + table * 3 * cells
            held.append(Cells(at.ravel(), np.ones(3 * len(b), np.int64), *(np.tile(x, 3) for x in (key, row, check_word(key, row)))))
            size += 3 * len(b)
            if size > HELD:
                held = [Cells.joined(held).summed()]
                size = len(held[0].at)
                if size > HELD // 2:
                    yield from out(held[0])
                    held, size = [], 0
        if held:
            yield from out(Cells.joined(held).summed())

    return run


def _peeler(numbers: list[int], buckets: int, in_group: int, cells: int):
    """A group's packed cells to the keys in which a snapshot and the one before it differ."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        first = int(g.group.iloc[0]) * in_group
        shape = (in_group, len(numbers), 3 * cells)
        n, key, row, check = np.zeros(shape, np.int64), *(np.zeros(shape, np.uint64) for _ in range(3))
        for data in g.cells:
            c = Cells.unpacked(data)
            for sums, each in ((n, c.n), (key, c.key), (row, c.row), (check, c.check)):
                sums.ravel()[c.at] += each
        found = []
        for k in range(1, len(numbers)):
            diff = [(x[:, k] - x[:, k - 1]).ravel() for x in (n, key, row, check)]
            keys, _, failed = peel(*diff, cells, buckets, first)
            keys = np.unique(keys).astype(np.int64)
            found.append(pd.DataFrame({"later": numbers[k], "bucket": (keys % buckets), "key": pd.array(keys, "Int64")}))
            found.append(pd.DataFrame({"later": numbers[k], "bucket": failed, "key": pd.array([None] * len(failed), "Int64")}))
        return pd.concat(found)[["later", "bucket", "key"]]

    return run


def changed_keys(elements: DataFrame, numbers: list[int], buckets: int, cells: int) -> DataFrame:
    """later, key of all elements in which a snapshot and the one before it differ, and maybe of some others; failed
    buckets are enlarged, and those that fail in every round count as different in all their keys."""
    in_group = max(1, min(16, 256 // len(numbers), buckets // 64))
    found, todo = None, elements
    for _ in range(ROUNDS):
        packed = todo.mapInPandas(_tables(numbers, buckets, in_group, cells), "group long, cells binary")
        got = cut(packed.groupBy("group").applyInPandas(_peeler(numbers, buckets, in_group, cells), "later int, bucket long, key long"))
        keys = got.where("key IS NOT NULL").select("later", "key")
        found = keys if found is None else found.unionByName(keys)
        failed = got.where("key IS NULL").select("bucket").distinct()
        if has_at_most(failed, 0):
            return found.distinct()
        todo = elements.join(small(failed, 10 * BROADCAST_ROWS), F.pmod("key", F.lit(buckets)) == failed["bucket"], "left_semi")
        cells = min(1 << 18, cells * 2)
    after = dict(zip(numbers, numbers[1:], strict=False))
    both = F.array_compact(F.array(F.when(F.col("snapshot_no") != numbers[0], F.col("snapshot_no")), F.element_at(F.create_map(*(F.lit(x) for p in after.items() for x in p)), F.col("snapshot_no"))))
    return found.unionByName(todo.select(F.explode(both).alias("later"), "key")).distinct()


def _cells_needed(elements: DataFrame, roles: DataFrame, largest: int, buckets: int) -> int:
    """Cells of each table, from the differences of the pair of snapshots that differs most, as the keys of about
    SAMPLED rows of a snapshot tell. Too few cells cost a further round, no result."""
    share = max(1, largest // SAMPLED)
    sample = elements.where(F.pmod("key", F.lit(share)) == 0).join(F.broadcast(roles), "snapshot_no")
    differ = sample.groupBy("later", "key", "row").agg(F.sum("sign").alias("n")).where("n <> 0")
    most = differ.groupBy("later").count().agg(F.max("count")).first()[0] or 0
    each = most * share / buckets
    return max(CELLS, int(1.28 * (each + 4.2 * each**0.5) / 3) + 4)


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """snapshot_no (the later one), collection, id, change (added, removed, changed) for each pair of successive snapshots.

    Of several rows of a record in a snapshot the one with the largest updated_at_epoch_seconds counts; NULL is the
    smallest time; of equal times, the row with the larger digest counts. Rows without a snapshot_no are left out. NULL
    is a collection or id like any other. Columns besides the record columns are not read, so they cannot clash.
    """
    spark = snapshots.sparkSession
    ship(spark)
    base = snapshots.where("snapshot_no IS NOT NULL").select(
        F.col("snapshot_no").cast("int").alias("snapshot_no"),
        "collection",
        "id",
        F.col("updated_at_epoch_seconds").alias("at"),
        content_digest().alias("digest"),
        F.shiftrightunsigned(F.xxhash64(F.coalesce("collection", F.lit("\u0000")), F.lit("\u0001"), F.coalesce("id", F.lit("\u0000"))), 64 - KEY_BITS).alias("key"),
    )
    base = cut(base.withColumn("row", F.shiftrightunsigned(F.xxhash64("key", F.coalesce("at", F.lit(-(2**62))), "digest"), 64 - ROW_BITS)))
    sizes = base.groupBy("snapshot_no").agg(F.count(F.lit(1)).alias("rows")).orderBy("snapshot_no").collect()  # a row for each snapshot
    if len(sizes) < 2:
        return spark.createDataFrame([], "snapshot_no int, collection string, id string, change string")
    numbers, largest = [r.snapshot_no for r in sizes], max(r.rows for r in sizes)
    pairs = list(zip(numbers, numbers[1:], strict=False))
    roles = spark.createDataFrame([(b, b, 1) for _, b in pairs] + [(a, b, -1) for a, b in pairs], "snapshot_no int, later int, sign int")
    buckets = -(-largest // BUCKET_ROWS)
    elements = base.select("snapshot_no", "key", "row")
    keys = changed_keys(elements, numbers, buckets, _cells_needed(elements, roles, largest, buckets))
    sought = keys.join(F.broadcast(roles), "later")
    rows = base.select("snapshot_no", "collection", "id", "key", F.struct(F.col("at").isNotNull(), "at", "digest").alias("version"))
    if has_at_most(sought, BROADCAST_ROWS):
        sought = F.broadcast(sought)
    else:  # one row for each record of a snapshot, before its key meets what is sought
        rows = rows.groupBy("snapshot_no", "collection", "id", "key").agg(F.max("version").alias("version"))
    sides = rows.join(sought, ["snapshot_no", "key"]).groupBy("later", "collection", "id")
    current = lambda sign: F.max(F.when(F.col("sign") == sign, F.col("version")))["digest"]
    both = sides.agg(current(1).alias("now"), current(-1).alias("then"))
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("then"), "changed")
    return both.select(F.col("later").alias("snapshot_no"), "collection", "id", change.alias("change")).where("change IS NOT NULL")
