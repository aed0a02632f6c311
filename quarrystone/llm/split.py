"""Cutting oversized texts into overlapping pieces at natural boundaries.

Boundaries form a hierarchy: section, paragraph, sentence, word, character. A text over the limit is split at its
sections, a section that is still too large at its paragraphs, and so on; neighbouring parts are then packed greedily
up to the limit. Where a collection names preferred break characters, boundaries right after one of them come before
all others, in the same order among themselves.

Pieces are verbatim: without the overlaps they add up to the text again. Texts within the limit never leave the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.frames import python_batches, small

# Limits of a chunking configuration and what holds where a setting is NULL.
DEFAULT_MAX_BYTES, LEAST_MAX_BYTES, DEFAULT_OVERLAP_BYTES = 8192, 256, 64
DEFAULT_BREAKS = ("\n", " ", "\t")

NATURAL = (
    re.compile(r"\n(?=#{1,6} )|\n\s*\n\s*\n+"),  # section
    re.compile(r"\n[ \t\r]*\n+"),  # paragraph
    re.compile(r"\n|[.!?…؟]+[\"'”’»)\]]*\s+|[。！？।]+[”」』）]*\s*"),  # line or sentence
    re.compile(r"\s+"),  # word
)
CHARACTER = 2 * (len(NATURAL) + 1)


def widths(text: str) -> np.ndarray:
    """Bytes of UTF-8 before each character, and in all."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    w = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    return np.concatenate(([0], np.cumsum(w)))


def joined(ch: str) -> bool:
    """A character that belongs to the one before it: combining marks, joiners, variation selectors, skin tones."""
    c = ord(ch)
    return (
        0x300 <= c <= 0x36F
        or 0x200C <= c <= 0x200D
        or 0xFE00 <= c <= 0xFE0F
        or 0x1F3FB <= c <= 0x1F3FF
        or (c > 0x36F and unicodedata.category(ch) in ("Mn", "Mc", "Me"))
    )


def ranked_boundaries(text: str, breaks: Sequence[str]) -> list[np.ndarray]:
    """For each rank, best first, the positions where a cut of this rank may be; a position has its best rank only."""
    natural: dict[int, int] = {}
    for level, pattern in reversed(list(enumerate(NATURAL))):
        for m in pattern.finditer(text):
            natural[m.end()] = level
    after: set[int] = set()
    for b in breaks:
        if b:
            after.update(m.end() for m in re.finditer(re.escape(b), text))
    ranks: list[list[int]] = [[] for _ in range(CHARACTER)]
    for p in after:
        ranks[natural.get(p, len(NATURAL))].append(p)
    for p, level in natural.items():
        if p not in after:
            ranks[len(NATURAL) + 1 + level].append(p)
    return [np.array(sorted(r), dtype=np.int64) for r in ranks]


def cut_characters(text: str, at: np.ndarray, lo: int, hi: int, budget: int) -> list[int]:
    """Ends of parts of text[lo:hi] within the budget, not inside a grapheme unless a grapheme is over the budget."""
    ends = []
    while at[hi] - at[lo] > budget:
        end = raw = int(np.searchsorted(at, at[lo] + budget, side="right")) - 1
        while end > lo + 1 and (joined(text[end]) or text[end - 1] == "‍"):
            end -= 1
        lo = end if end > lo + 1 or raw == lo + 1 else raw
        ends.append(lo)
    return [*ends, hi]


def pieces(text: str, max_bytes: int, overlap_bytes: int, breaks: Sequence[str]) -> list[tuple[int, int, int]]:
    """(begin, first new character, end) of each piece, as character positions.

    The overlap is whole characters, from a word's begin on where one is near, and at most half of the limit, so that
    every piece brings something new.
    """
    at = widths(text)
    if at[-1] <= max_bytes:
        return [(0, 0, len(text))]
    overlap = min(overlap_bytes, max_bytes // 2)
    budget = max_bytes - overlap
    ranks = ranked_boundaries(text, breaks)
    ends: list[int] = []
    todo = [(0, len(text), 0)]
    while todo:
        lo, hi, rank = todo.pop()
        if at[hi] - at[lo] <= budget:
            ends.append(hi)
            continue
        inner: np.ndarray = np.empty(0, dtype=np.int64)
        while rank < CHARACTER and not len(inner):
            r = ranks[rank]
            inner = r[np.searchsorted(r, lo, side="right") : np.searchsorted(r, hi, side="left")]
            rank += 1
        if not len(inner):
            ends.extend(cut_characters(text, at, lo, hi, budget))
            continue
        edges = [lo, *inner.tolist(), hi]
        todo.extend((a, b, rank) for a, b in reversed(list(zip(edges, edges[1:], strict=False))))
    out: list[tuple[int, int, int]] = []
    until, new, begin = at[np.array(ends)], 0, 0
    while new < len(text):
        end = ends[int(np.searchsorted(until, at[begin] + max_bytes, side="right")) - 1]
        out.append((begin, new, end))
        new = end
        begin = int(np.searchsorted(at, at[end] - overlap, side="left"))
        word = re.compile(r"\s\S").search(text, begin, end) if begin and not text[begin - 1].isspace() else None
        if word:
            begin = word.start() + 1
        while begin < end and joined(text[begin]):
            begin += 1
    return out


def _split_each(bodies: pd.Series, most: pd.Series, lap: pd.Series, breaks: pd.Series) -> pd.DataFrame:
    """Pieces of the bodies that are not NULL."""
    rows = []
    for body, m, o, b in zip(bodies, most, lap, breaks, strict=True):
        if body is None:
            rows.append((None, None, None))
        else:
            cut = pieces(body, m, o, list(b))
            rows.append(([x for x, _, _ in cut], [n - x for x, n, _ in cut], [body[x:e] for x, _, e in cut]))
    return pd.DataFrame(rows, columns=["begin_char", "overlap_chars", "text"])


def _split(*columns: Column | str) -> Column:
    return F.pandas_udf(_split_each, "struct<begin_char:array<bigint>,overlap_chars:array<int>,text:array<string>>")(*columns)


def limits(configs: DataFrame) -> DataFrame:
    """collection, max_bytes, lap_bytes, breaks: settings as they are in force. Of rows that share a collection the
    one with the smallest config_id counts; a row without a collection is ignored."""
    one = (
        configs.where("collection IS NOT NULL")
        .groupBy("collection")
        .agg(F.min_by(F.struct("max_chunk_bytes", "overlap_bytes", "preferred_break_characters"), "config_id").alias("c"))
    )
    return one.select(
        "collection",
        F.greatest(F.coalesce("c.max_chunk_bytes", F.lit(DEFAULT_MAX_BYTES)), F.lit(LEAST_MAX_BYTES)).alias("max_bytes"),
        F.greatest(F.coalesce("c.overlap_bytes", F.lit(DEFAULT_OVERLAP_BYTES)), F.lit(0)).alias("lap_bytes"),
        F.coalesce("c.preferred_break_characters", F.array(*map(F.lit, DEFAULT_BREAKS))).alias("breaks"),
    )


def _sized(records: DataFrame, configs: DataFrame) -> tuple[DataFrame, Column]:
    """(row_no, body and the limits in force of every body that is not empty; whether it is over its limit)."""
    python_batches(records.sparkSession)
    sized = (
        records.select("row_no", "collection", "body")
        .where("body <> ''")
        .join(small(limits(configs)), "collection", "left")
        .select(
            "row_no",
            "body",
            F.coalesce("max_bytes", F.lit(DEFAULT_MAX_BYTES)).alias("max_bytes"),
            F.coalesce("lap_bytes", F.lit(DEFAULT_OVERLAP_BYTES)).alias("lap_bytes"),
            F.coalesce("breaks", F.array(*map(F.lit, DEFAULT_BREAKS))).alias("breaks"),
        )
    )
    return sized, F.octet_length("body") > F.col("max_bytes")


def split_bodies(records: DataFrame, configs: DataFrame) -> DataFrame:
    """Pieces of every body: row_no, piece_no from 0, begin_char, overlap_chars shared with the piece before, text.

    A body within its limit is one piece. NULL and empty bodies have none. A NULL collection, or one without a
    setting, gets the defaults. Only row_no, collection and body are read, so other columns cannot clash. Rows that
    occur twice are split twice. One pass; only bodies over their limit leave the JVM.
    """
    sized, over = _sized(records, configs)
    cut = sized.select("row_no", "body", _split(F.when(over, F.col("body")), "max_bytes", "lap_bytes", "breaks").alias("p"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin_char"), F.lit(0).alias("overlap_chars"), F.col("body").alias("text")))
    each = F.when(F.col("p.text").isNull(), whole).otherwise(F.arrays_zip("p.begin_char", "p.overlap_chars", "p.text"))
    return cut.select("row_no", F.posexplode(each).alias("piece_no", "piece")).select("row_no", "piece_no", "piece.*")


def cut_rows(records: DataFrame, configs: DataFrame) -> DataFrame:
    """row_no of the bodies that had to be cut: those that have a second piece."""
    sized, over = _sized(records, configs)
    cut = sized.where(over).select("row_no", _split("body", "max_bytes", "lap_bytes", "breaks").alias("p"))
    return cut.where(F.size("p.text") > 1).select("row_no")
