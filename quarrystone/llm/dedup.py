"""Collapsing records that differ only in formatting.

Each record gets a 128-bit digest of its canonical form. One pass over the digests builds, per partition, a Bloom
filter of what was seen once and one of what was seen again; the partitions' filters are merged segment by segment.
Only rows whose digest may be in the merged filter of repeats are shuffled and grouped exactly; all others are
singletons and stay where they are.

The filters' size follows the number of rows up to MOST_BITS. More rows than fill such a filter go through it in ranges
of the digests' hashes, one after another, each with filters of its own: the digests lie sorted by hash in a table in
the shared folder, so that a range reads its own pages. The share of rows that are shuffled thus stays the same at any
size, and what is sent to an executor stays bounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.frames import cut, join_groups, letters, scratch, ship

LEAST_BITS, MOST_BITS, BITS_A_ROW = 1 << 17, 1 << 28, 16
#: Bytes of one segment of a filter; MOST_BITS is 32 MB, the most that is ever sent to an executor.
SEGMENT = 1 << 14
#: Beyond the marks that separate parts of a form; they are no letters, so no text holds them.
NAME, ENTRY, PART = "\u0001", "\u0002", "\u0003"

LINE = r"^\s*[\p{L}\p{N}\p{M}_-]+\s*:.*$"


def one_object(text: Column) -> Column:
    """The entries of a text that is one JSON object from its first to its last character, else NULL.

    from_json reads the first value of a text and ignores the rest. So the text is put into an array before a digest of
    itself: an array of these two alone was read to its end, and no text can hold its own digest.
    """
    end = F.md5(text)
    listed = F.when(text.startswith("{") & text.endswith("}"), F.concat(F.lit("["), text, F.lit(',{"":"'), end, F.lit('"}]')))
    read = F.from_json(listed, "array<map<string,string>>")
    return F.when((F.size(read) == 2) & (F.element_at(F.get(read, F.lit(1)), "") == end), F.get(read, F.lit(0)))


def canonical(title: Column, body: Column) -> Column:
    """Title and body as lower-cased letters; a form as the set of its entries.

    A form is one JSON object, or at least two lines (blank ones aside) that all read `name: value` with a one-word
    name. NULL counts as empty.
    """
    text = F.coalesce(body, F.lit(""))
    trimmed = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    as_json = one_object(trimmed)
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    as_lines = (F.size(lines) >= 2) & F.forall(lines, lambda x: x.rlike(LINE))
    joined = lambda pairs: F.concat(F.lit(PART), F.array_join(F.array_sort(F.array_distinct(pairs)), ENTRY))
    json_pairs = F.transform(F.map_entries(as_json), lambda e: F.concat(letters(e["key"]), F.lit(NAME), letters(e["value"])))
    line_pairs = F.transform(
        lines,
        lambda x: F.concat(letters(F.regexp_extract(x, r"^([^:]*):", 1)), F.lit(NAME), letters(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1))),
    )
    form = (
        F.when(as_json.isNotNull(), joined(json_pairs))
        .when(text.contains(":") & text.contains("\n") & as_lines, joined(line_pairs))
        .otherwise(letters(text))
    )
    return F.concat(letters(title), F.lit(PART), form)


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    u = h.astype(np.uint64)
    with np.errstate(over="ignore"):
        return u & np.uint64(bits - 1), (u * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - bits.bit_length())


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))


def _local_filters(bits: int):
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in batches:
            h, n = np.unique(b.h.to_numpy(np.int64), return_counts=True)
            p, q = _places(h, bits)
            seen = (n > 1) | (_has(once, p) & _has(once, q))
            _set(again, p[seen])
            _set(again, q[seen])
            _set(once, p)
            _set(once, q)
        for k in range(0, len(once), SEGMENT):
            if once[k : k + SEGMENT].any():
                yield pd.DataFrame({"segment": [k // SEGMENT], "once": [zlib.compress(once[k : k + SEGMENT].tobytes(), 1)], "again": [zlib.compress(again[k : k + SEGMENT].tobytes(), 1)]})

    return build


def _merge(parts: pd.DataFrame) -> pd.DataFrame:
    """What is in two filters' once is a repeat; bit by bit this can only add to the repeats, never miss one."""
    once = again = None
    for o, a in zip(parts.once, parts.again, strict=True):
        o, a = np.frombuffer(zlib.decompress(o), np.uint8), np.frombuffer(zlib.decompress(a), np.uint8)
        once, again = (o, a) if once is None else (once | o, again | a | (once & o))
    return pd.DataFrame({"segment": parts.segment.iloc[:1], "again": [zlib.compress(again.tobytes(), 1)]})


def repeats_filter(digests: DataFrame, rows: int) -> tuple[bytes, int]:
    """The merged filter of repeated digests (at most MOST_BITS / 8 bytes) of about so many rows, and its bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, rows) * BITS_A_ROW - 1).bit_length()))
    merged = (
        digests.select("h")
        .mapInPandas(_local_filters(bits), "segment long, once binary, again binary")
        .groupBy("segment")
        .applyInPandas(_merge, "segment long, again binary")
    )
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.toLocalIterator():
        part = np.frombuffer(zlib.decompress(r.again), np.uint8)
        out[r.segment * SEGMENT : r.segment * SEGMENT + len(part)] = part
    return out.tobytes(), bits


def _local_members(bits: int):
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for at in _places(b.h.to_numpy(np.int64), bits):
                _set(seen, at)
        for k in range(0, len(seen), SEGMENT):
            if seen[k : k + SEGMENT].any():
                yield pd.DataFrame({"segment": [k // SEGMENT], "seen": [zlib.compress(seen[k : k + SEGMENT].tobytes(), 1)]})

    return build


def _united(parts: pd.DataFrame) -> pd.DataFrame:
    seen = np.zeros(SEGMENT, np.uint8)
    for p in parts.seen:
        p = np.frombuffer(zlib.decompress(p), np.uint8)
        seen[: len(p)] |= p
    return pd.DataFrame({"segment": parts.segment.iloc[:1], "seen": [zlib.compress(seen.tobytes(), 1)]})


def member_filter(hashes: DataFrame) -> tuple[bytes, int]:
    """A filter, compressed, of all values of h, and its number of bits. Beyond the values that MOST_BITS take, it lets
    more others pass; it never keeps out one of its own."""
    ship(hashes.sparkSession)
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, hashes.count()) * BITS_A_ROW - 1).bit_length()))
    merged = hashes.mapInPandas(_local_members(bits), "segment long, seen binary").groupBy("segment").applyInPandas(_united, "segment long, seen binary")
    out = np.zeros(max(bits // 8, SEGMENT), np.uint8)
    for r in merged.toLocalIterator():
        out[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = np.frombuffer(zlib.decompress(r.seen), np.uint8)
    return zlib.compress(out.tobytes(), 1), bits


def may_hold(held, bits: int):
    """Whether a hash may be in the broadcast filter."""

    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen = np.frombuffer(zlib.decompress(held.value), np.uint8)
        for h in batches:
            p, q = _places(h.to_numpy(np.int64), bits)
            yield pd.Series(_has(seen, p) & _has(seen, q))

    return F.pandas_udf(test, "boolean")


def digests(records: DataFrame) -> DataFrame:
    """row_no, the 128-bit digest of the canonical form, and 64 bits of it for the filters; sorted by those in each
    file of a table in the shared folder."""
    d = records.select("row_no", F.unhex(F.md5(canonical(F.col("title"), F.col("body")))).alias("digest"))
    at = scratch(records.sparkSession, "digests")
    d.withColumn("h", F.xxhash64("digest")).sortWithinPartitions("h").write.parquet(at)
    return records.sparkSession.read.parquet(at)


def hash_ranges(rows: int) -> list[tuple[int, int]]:
    """(first, last) of ranges of 64-bit hashes that hold as many rows each as a filter of MOST_BITS takes."""
    n = max(1, -(-rows * BITS_A_ROW // MOST_BITS))
    edges = [-(1 << 63) + (1 << 64) * k // n for k in range(n + 1)]
    return [(a, b - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _marked(held, bits: int):
    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        again = np.frombuffer(zlib.decompress(held.value), np.uint8)
        for b in batches:
            p, q = _places(b.h.to_numpy(np.int64), bits)
            yield pd.DataFrame({"row_no": b.row_no, "digest": b.digest, "repeat": _has(again, p) & _has(again, q)})

    return mark


def marked_rows(records: DataFrame) -> tuple[DataFrame, int]:
    """(row_no, digest, repeat: whether the digest may occur more than once; the number of rows)."""
    spark = records.sparkSession
    ship(spark)
    d = digests(records)
    rows = d.count()
    ranges = hash_ranges(rows)
    out = scratch(spark, "marked")
    for k, (first, last) in enumerate(ranges):
        part = d if len(ranges) == 1 else d.where(F.col("h").between(first, last))
        again, bits = repeats_filter(part, -(-rows // len(ranges)))
        held = spark.sparkContext.broadcast(zlib.compress(again, 1))
        marks = part.mapInPandas(_marked(held, bits), "row_no long, digest binary, repeat boolean")
        if len(ranges) == 1:
            return marks, rows
        marks.write.parquet(f"{out}/range={k}")
        held.destroy()
    return spark.read.schema("row_no long, digest binary, repeat boolean").parquet(out), rows


def _grouped(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    marked, rows = marked_rows(records)
    may = marked.where("repeat").select("row_no", "digest")
    groups = cut(may.groupBy("digest").agg(F.min("row_no").alias("first_row_no"), F.count(F.lit(1)).alias("copies")))
    return marked, may, groups, rows


def distinct_records(records: DataFrame) -> DataFrame:
    """One row per distinct record: first_row_no (the smallest of its copies) and copies.

    Records with neither title nor body are copies of each other. A NULL row_no counts as a copy but is never the
    first one unless all are NULL. Reads row_no, title and body only.
    """
    marked, _, groups, _ = _grouped(records)
    singles = marked.where("NOT repeat").select(F.col("row_no").alias("first_row_no"), F.lit(1).cast("long").alias("copies"))
    return singles.unionByName(groups.select("first_row_no", "copies"))


def copies(records: DataFrame) -> DataFrame:
    """first_row_no, row_no: every row that is not the first of its group, with the group's first."""
    _, may, groups, rows = _grouped(records)
    found = join_groups(may, groups.where("copies > 1"), "digest", "copies", rows)
    return found.where("row_no <> first_row_no").select("first_row_no", "row_no")
