"""Sparse n-grams: spans of bytes that stand out by the weights of their byte pairs.

A span reaches from one byte pair to another if every pair between weighs less than both; spans of two and three bytes
always count. For a pair, the only partners are the next and the previous one that weighs at least as much, so all
spans of a batch are found by comparing the whole batch with itself at growing distances, while the pairs that still
look for a partner get fewer at every step.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.frames import python_batches

# Weights of pairs of byte classes. Classes: lower, upper, digit, space, control, punctuation, other.
LOWER, UPPER, DIGIT, SPACE, CONTROL, PUNCT, OTHER = range(7)
UNORDERED = {
    (LOWER, SPACE): 15,
    (SPACE, SPACE): 5,
    (UPPER, UPPER): 60,
    (DIGIT, DIGIT): 80,
    (LOWER, DIGIT): 70,
    (UPPER, DIGIT): 75,
    (PUNCT, LOWER): 120,
    (PUNCT, UPPER): 130,
    (PUNCT, PUNCT): 140,
    (PUNCT, SPACE): 90,
    (SPACE, UPPER): 50,
    (SPACE, DIGIT): 60,
    (DIGIT, PUNCT): 110,
    (OTHER, OTHER): 230,
    (CONTROL, CONTROL): 200,
}
ORDERED = {(LOWER, UPPER): 100, (UPPER, LOWER): 40}
WITH_OTHER, WITH_CONTROL, LEAST, MOST = 220, 180, 1, 251
# Ranks of frequent letter pairs; their weight is 3 more. Any other pair has 30 + (7a xor 13b) mod 20.
RANKS = {
    "th": 1, "he": 2, "in": 3, "er": 4, "an": 5, "re": 6, "on": 7, "at": 8, "en": 9, "nd": 10, "ti": 11, "es": 12, "et": 12, "or": 13,
    "te": 14, "st": 14, "of": 15, "rn": 15, "ed": 16, "ng": 16, "is": 17, "le": 17, "it": 18, "un": 18, "al": 19, "ar": 20, "ct": 20,
}


def byte_class(b: int) -> int:
    if 97 <= b <= 122:
        return LOWER
    if 65 <= b <= 90:
        return UPPER
    if 48 <= b <= 57:
        return DIGIT
    if b in (32, 9, 10, 13):
        return SPACE
    if b < 32 or b == 127:
        return CONTROL
    return OTHER if b >= 128 else PUNCT


@lru_cache(1)
def weight_table() -> np.ndarray:
    table = np.zeros((256, 256), np.uint8)
    kinds = [byte_class(b) for b in range(256)]
    for a in range(256):
        for b in range(256):
            x, y = kinds[a], kinds[b]
            if x == y == LOWER:
                rank = RANKS.get(chr(a) + chr(b))
                w = 3 + rank if rank else 30 + ((a * 7) ^ (b * 13)) % 20
            elif (x, y) in ORDERED:
                w = ORDERED[x, y]
            else:
                w = UNORDERED.get((x, y)) or UNORDERED.get((y, x)) or (WITH_OTHER if OTHER in (x, y) else WITH_CONTROL)
            if a == b:
                w = w * 7 // 10
            table[a, b] = min(MOST, max(LEAST, w))
    return table


def weight(a: int, b: int) -> int:
    return int(weight_table()[a, b])


def _partners(w: np.ndarray, reach: int, forward: bool) -> tuple[np.ndarray, np.ndarray]:
    """(pair, distance) to the nearest pair on one side that weighs at least as much, within reach."""
    n = len(w)
    at = np.arange(n)
    pairs, distances = [], []
    for d in range(1, min(reach, n - 1) + 1):
        at = at[at + d < n] if forward else at[at >= d]
        if not len(at):
            break
        hit = (w[at + d] if forward else w[at - d]) >= w[at]
        pairs.append(at[hit])
        distances.append(np.full(int(hit.sum()), d))
        at = at[~hit]
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(pairs), np.concatenate(distances)


def spans(data: np.ndarray, ends: np.ndarray, max_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, length) of the spans of several texts that lie one after another; ends: where each ends."""
    n = len(data)
    if n < 2:
        return (np.empty(0, np.int64),) * 3
    w = weight_table()[data[:-1], data[1:]].astype(np.int16)
    inner = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < n)] - 1
    w[inner] = 1000  # no span crosses from one text to the next
    reach = max_length - 2
    ok = w < 1000
    begins, lengths = [np.nonzero(ok)[0]], [np.full(int(ok.sum()), 2)]
    if reach >= 1:
        both = np.nonzero(ok[:-1] & ok[1:])[0]
        begins.append(both)
        lengths.append(np.full(len(both), 3))
    for forward in (True, False):
        at, d = _partners(w, reach, forward)
        left = at if forward else at - d
        keep = (d >= 2) & ok[at] & ok[left] & ok[left + d]
        if not forward:
            keep &= w[left] != w[np.minimum(left + d, len(w) - 1)]  # a tie was found from its left pair
        begins.append(left[keep])
        lengths.append(d[keep] + 2)
    begin, length = np.concatenate(begins), np.concatenate(lengths)
    return np.searchsorted(ends, begin, side="right"), begin, length


BASE, MIX = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD


def _hashes(data: np.ndarray, begin: np.ndarray, length: np.ndarray, max_length: int) -> np.ndarray:
    """64 bits of each span. Sound for a pre-filter whatever collides: equal bytes have equal hashes."""
    with np.errstate(over="ignore"):
        powers = np.ones(max_length + 1, np.uint64)
        for k in range(1, max_length + 1):
            powers[k] = powers[k - 1] * np.uint64(BASE)
        h = np.zeros(len(begin), np.uint64)
        order = np.argsort(-length, kind="stable")
        live = order
        for k in range(int(length.max(initial=0))):
            live = live[: np.searchsorted(-length[live], -k, side="left")]
            h[live] = h[live] * np.uint64(BASE) + data[begin[live] + k].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(33)
        h = h * np.uint64(MIX) + length.astype(np.uint64)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def text_grams(texts: list[str], max_length: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of all distinct grams of each text."""
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    text, begin, length = spans(data, ends, max_length)
    if not len(begin):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gram = _hashes(data, begin, length, max_length)
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])))
    return text[new], gram[new]


def gram_strings(text: str, max_length: int = 128) -> list[bytes]:
    """The distinct spans themselves, in the order of their begins; for looking at."""
    raw = text.encode()
    _, begin, length = spans(np.frombuffer(raw, np.uint8), np.array([len(raw)]), max_length)
    return list(dict.fromkeys(raw[b : b + n] for b, n in sorted(zip(begin.tolist(), length.tolist(), strict=True))))


def cover(literal: str, max_length: int = 128, limit: int | None = None) -> list[bytes]:
    """The fewest spans that cover all byte pairs of a literal: of those that begin by the first pair not covered yet,
    the one that reaches farthest, again and again. A text that holds the literal holds all of them."""
    raw = literal.encode()
    if len(raw) < 2:
        return []
    _, begin, length = spans(np.frombuffer(raw, np.uint8), np.array([len(raw)]), max_length)
    reach: dict[int, int] = {}
    for b, n in zip(begin.tolist(), length.tolist(), strict=True):
        reach[b] = max(reach.get(b, 0), b + n)
    out, covered = [], 0
    while covered < len(raw) - 1:
        end, start = max((reach[b], -b) for b in range(covered + 1))
        out.append(raw[-start : end])
        covered = end - 1
    return list(dict.fromkeys(out))[: None if limit is None else max(1, limit)]


def gram_hash(gram: bytes) -> int:
    data = np.frombuffer(gram, np.uint8)
    return int(_hashes(data, np.array([0]), np.array([len(gram)]), len(gram))[0])


def _extractor(max_length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b.chunk_id.to_numpy(np.int64)
            part, size = 0, 0
            lengths = b.text.str.len().to_numpy()
            for k in range(len(b)):
                size += lengths[k]
                if size > 500_000 or k == len(b) - 1:
                    text, gram = text_grams(b.text.iloc[part : k + 1].tolist(), max_length)
                    yield pd.DataFrame({"gram": gram, "chunk_id": ids[part + text]})
                    part, size = k + 1, 0

    return run


def postings(chunks: DataFrame, max_length: int = 128) -> DataFrame:
    """gram, chunk_id: an entry for every distinct gram of every chunk. NULL and one-byte texts have none."""
    python_batches(chunks.sparkSession, 4)
    rows = chunks.where("text IS NOT NULL AND chunk_id IS NOT NULL").select(F.col("chunk_id").cast("long").alias("chunk_id"), "text")
    return rows.mapInPandas(_extractor(max_length), "gram long, chunk_id long")


def spelled(chunks: DataFrame, max_length: int = 128) -> DataFrame:
    """gram_hex, chunk_id: the postings with the grams' bytes in place of their hashes, for looking at."""
    python_batches(chunks.sparkSession, 4)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(g.hex(), i) for i, t in zip(b.chunk_id, b.text, strict=True) for g in gram_strings(t, max_length)]
            yield pd.DataFrame(rows, columns=["gram_hex", "chunk_id"])

    rows = chunks.where("text IS NOT NULL AND chunk_id IS NOT NULL").select(F.col("chunk_id").cast("long").alias("chunk_id"), "text")
    return rows.mapInPandas(run, "gram_hex string, chunk_id long")


#: Characters of text whose postings are sorted together, in the memory of a worker.
BLOCK_CHARS, ROWS_AT_ONCE = 4_000_000, 500_000


def _block_sorter(max_length: int):
    extract = _extractor(max_length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def sorted_block(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            gram, ids = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("gram", "chunk_id"))
            order = np.lexsort((ids, gram))
            for k in range(0, len(order), ROWS_AT_ONCE):
                part = order[k : k + ROWS_AT_ONCE]
                yield pd.DataFrame({"gram": gram[part], "chunk_id": ids[part]})

        parts, size = [], 0
        for b in batches:
            parts += extract(iter([b]))
            size += int(b.text.str.len().sum())
            if size > BLOCK_CHARS:
                yield from sorted_block(parts)
                parts, size = [], 0
        if parts:
            yield from sorted_block(parts)

    return run


def sorted_postings(chunks: DataFrame, max_length: int = 128) -> DataFrame:
    """Postings for storing: in blocks of chunks that lie together, each sorted by gram and chunk. A block is sorted
    where its texts are, so nothing is shuffled, spilled or kept besides; in the pages of a block a gram is found by
    their least and largest."""
    python_batches(chunks.sparkSession, 4)
    rows = chunks.where("text IS NOT NULL AND chunk_id IS NOT NULL").select(F.col("chunk_id").cast("long").alias("chunk_id"), "text")
    return rows.mapInPandas(_block_sorter(max_length), "gram long, chunk_id long")


#: Ids that a row of a posting list spans at most.
LIST_SPAN = 1 << 16


def posting_lists(entries: DataFrame) -> DataFrame:
    """gram, block and those of the gram's chunks whose id is in the block, ascending: block times LIST_SPAN is the
    first id that it could hold, so no frequent gram makes a row long. For export; searching uses the narrow form."""
    block = F.floor(F.col("chunk_id") / LIST_SPAN).alias("block")
    return entries.groupBy("gram", block).agg(F.sort_array(F.collect_set("chunk_id")).alias("chunks"))
