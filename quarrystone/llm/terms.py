"""How often every term of a collection occurs, and in how many records.

Heavy-light aggregation. A bounded sample of rows names the heavy terms (at most HEAVY, each short), which are
broadcast. One pass over all rows then counts heavy terms exactly in arrays that live as long as the partition, and
every other term per batch; only the latter's counts are shuffled as rows of their own, while a partition's array
comes to at most HEAVY rows. The sample decides where a term is counted, never what its count is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.frames import cut, python_batches

#: Most heavy terms of a field, the most characters of one, and the rows sampled to find them.
HEAVY, HEAVY_CHARS, SAMPLE_ROWS = 2048, 64, 4000
#: Most partitions that the sample is taken from.
SAMPLE_PARTITIONS = 200
#: A term in fewer records than this is rare, one in more than this share of all records is common.
RARE_BELOW, COMMON_ABOVE = 3, 10
NOT_LETTERS = r"[^\p{L}\p{N}\p{M}]+"
FIELDS = ("tags", "body")
SCHEMA = "field string, term string, occurrences long, records long"


def lowered(a: pa.Array) -> pa.Array:
    """Lower case as Python has it; Arrow's differs for a capital sigma at a word's end and a dotted capital I."""
    out = pc.utf8_lower(a)
    odd = pc.fill_null(pc.match_substring_regex(a, "[İΣ]"), False)
    if pc.any(odd).as_py():
        out = pc.replace_with_mask(out, odd, pa.array([x.lower() for x in a.filter(odd).to_pylist()], a.type))
    return out


def tokens(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """For each field its terms, one after another, with the number of the row that each is from."""
    tags = batch.column("tags")
    terms = pc.utf8_trim_whitespace(lowered(pc.list_flatten(tags)))
    yield "tags", terms, pc.list_parent_indices(tags).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern_regex(lowered(batch.column("body")), NOT_LETTERS)
    yield "body", pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)


def counted(terms: pa.Array, rows: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct non-empty terms, how often each occurs and in how many rows."""
    keep = pc.fill_null(pc.not_equal(terms, ""), False)
    rows = rows[keep.to_numpy(zero_copy_only=False)]
    coded = terms.filter(keep).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    codes, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    once = np.unique(rows.astype(np.int64) * max(n, 1) + codes)
    return coded.dictionary, np.bincount(codes, minlength=n), np.bincount(once % max(n, 1), minlength=n)


def _counter(heavy: dict[str, list[str]], total: bool = False):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = {f: pa.array(t, pa.string()) for f, t in heavy.items()}
        sums = {f: np.zeros((2, len(t)), np.int64) for f, t in heavy.items()}

        def rows(field: str, terms: pa.Array, occ: np.ndarray, rec: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array([field] * len(terms), pa.string()), terms, pa.array(occ, pa.int64()), pa.array(rec, pa.int64())], ["field", "term", "occurrences", "records"])

        n = 0
        for b in batches:
            n += b.num_rows
            for field, terms, at in tokens(b):
                found, occ, rec = counted(terms, at)
                place = pc.index_in(found, values[field])
                light = pc.is_null(place).to_numpy(zero_copy_only=False)
                where = pc.fill_null(place, 0).to_numpy(zero_copy_only=False)[~light]
                sums[field][0, where] += occ[~light]
                sums[field][1, where] += rec[~light]
                if light.any():
                    yield rows(field, found.filter(pa.array(light)), occ[light], rec[light])
        if total and n:
            yield rows("", pa.array([None], pa.string()), np.zeros(1, np.int64), np.array([n]))
        for field, s in sums.items():
            seen = s[1] > 0
            if seen.any():
                yield rows(field, values[field].filter(pa.array(seen)), s[0, seen], s[1, seen])

    return count


def _sampler(partitions: int):
    """The first rows of a bounded number of evenly spread partitions; the rest is not read."""
    stride = -(-partitions // SAMPLE_PARTITIONS)
    each = -(-SAMPLE_ROWS // -(-partitions // stride))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, left = _counter({f: [] for f in FIELDS}), each
        if TaskContext.get().partitionId() % stride:
            return
        for b in batches:
            yield from count(iter([b.slice(0, left)]))
            left -= b.num_rows
            if left <= 0:
                return

    return take


def heavy_terms(records: DataFrame) -> dict[str, list[str]]:
    """Terms of each field that occur most in a sample of about SAMPLE_ROWS rows: no more than HEAVY, each short."""
    partitions = max(1, records.rdd.getNumPartitions())
    counts = records.mapInArrow(_sampler(partitions), SCHEMA).where(F.length("term") <= HEAVY_CHARS).groupBy("field", "term").agg(F.sum("occurrences").alias("n")).where("n > 2")
    best = counts.groupBy("field").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "term")), asc=False), 1, HEAVY)["term"].alias("terms"))
    found = {r.field: list(r.terms) for r in best.collect()}
    return {f: found.get(f, []) for f in FIELDS}


def _counted(records: DataFrame) -> DataFrame:
    """term_counts, and a row without term that holds the number of rows as its records."""
    python_batches(records.sparkSession)
    read = records.select("tags", "body")
    return read.mapInArrow(_counter(heavy_terms(read), total=True), SCHEMA).groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def term_counts(records: DataFrame) -> DataFrame:
    """field (tags, body), term, occurrences, records: for every tag and every maximal run of letters in bodies.

    Both are lower-cased; tags lose outer blanks; empty terms, NULL bodies, NULL arrays and NULL tags count nothing.
    Every row is a record, so rows that came twice count twice. Reads tags and body only.
    """
    return _counted(records).where("term IS NOT NULL")


def marked_terms(records: DataFrame) -> DataFrame:
    """term_counts with mark: rare, common, or NULL for those between. A term that is both (in a collection of fewer
    than 30 records) is rare. The records are counted in the pass that counts the terms."""
    counts = cut(_counted(records))
    total = counts.where("term IS NULL").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    mark = F.when(F.col("records") < RARE_BELOW, "rare").when(F.col("records") * COMMON_ABOVE > total, "common")
    return counts.where("term IS NOT NULL").withColumn("mark", mark)
