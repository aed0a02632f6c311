"""Test items that leaked into training text, found with an FM-index per shard of the text.

Texts are compared as sequences of lower-cased letters. Every task cuts its documents into shards of bounded size,
builds an FM-index over each (suffix order, Burrows-Wheeler transform, wavelet matrix with packed ranks, sampled suffix
positions) and searches all phrases of all items backwards at once; a phrase drops out as soon as its range is empty.
Phrases are taken from an item so densely that any run that counts holds a whole one. Occurrences are located by
walking to the next sampled position, extended to the longest run around them, kept if that is long enough, and merged
to removal spans.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.frames import cut, letters, python_batches, small

#: Bytes of text in a shard, distance of sampled positions, and bytes of items that are sent to the tasks at once.
SHARD_BYTES, SAMPLED, ITEM_BYTES = 1 << 21, 16, 8 << 20
#: Blocks of items whose phrases are searched in a shard before its index is given up.
BLOCKS = 4
# Letters that make a run, and those of items in languages without spaces.
RUN, SHORT_RUN, SHORT_LANGS = 50, 20, ("zh", "ja")


def leading(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number, zeros behind the end."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    return key


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, leading bytes) of a byte text in the order of its suffixes: by eight bytes at first, then doubling
    among ties only."""
    n = len(text)
    key = leading(text)
    order = np.argsort(key)
    key = key[order]
    starts = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n + 1, np.int64)  # of a group: the place of its first member
    rank[n] = -1
    group = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    rank[order] = group
    width = 8
    while True:
        tied = ~(starts & np.concatenate((starts[1:], [True])))
        at = np.nonzero(tied)[0]
        if not len(at):
            return order, key
        pos = order[at]
        head = rank[pos]
        tail = rank[np.minimum(pos + width, n)]
        by = np.argsort(head * np.int64(n + 2) + tail + 1)
        pos, head, tail = pos[by], head[by], tail[by]
        order[at] = pos
        fresh = np.concatenate(([True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])))
        starts[at] = fresh
        rank[pos] = np.maximum.accumulate(np.where(fresh, at, 0))
        width *= 2


class FMIndex:
    """Backward search and location over one text of bytes that ends in a 0 and holds no other."""

    def __init__(self, text: np.ndarray):
        used = np.unique(text)
        self.code = np.full(256, -1, np.int64)
        self.code[used] = np.arange(len(used))
        self.n = n = len(text)
        order, self.heads = suffix_order(text)
        last = self.code[text[order - 1]].astype(np.uint8)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(self.code[text], minlength=len(used)))))
        marked = order % SAMPLED == 0
        self.marks = self._packed(marked)
        self.samples = order[marked].astype(np.int32 if n < 2**31 else np.int64)
        self.levels = max(1, int(len(used) - 1).bit_length())
        self.words, self.zeros = [], []
        for level in range(self.levels):
            bit = (last >> (self.levels - 1 - level)) & 1 == 1
            self.words.append(self._packed(bit))
            self.zeros.append(n - int(bit.sum()))
            last = np.concatenate((last[~bit], last[bit]))

    @staticmethod
    def _packed(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 2, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        return words, np.concatenate(([0], ones[:-1])).astype(np.int32 if len(bits) < 2**31 else np.int64)

    @staticmethod
    def _ones(part: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        words, before = part
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[w] + np.bitwise_count(words[w] & mask).astype(np.int64)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of a symbol in the transform before each place."""
        low = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            one = (symbol >> (self.levels - 1 - level)) & 1 == 1
            a, b = self._ones(self.words[level], low), self._ones(self.words[level], at)
            z = self.zeros[level]
            low, at = np.where(one, z + a, low - a), np.where(one, z + b, at - b)
        return at - low

    def step(self, at: np.ndarray) -> np.ndarray:
        """The place of the suffix that is one longer than that of each place."""
        low, here = np.zeros(len(at), np.int64), at
        symbol = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            words = self.words[level][0]
            one = (words[here >> 6] >> (here & 63).astype(np.uint64)) & np.uint64(1) == 1
            symbol = symbol << 1 | one
            a, b = self._ones(self.words[level], low), self._ones(self.words[level], here)
            z = self.zeros[level]
            low, here = np.where(one, z + a, low - a), np.where(one, z + b, here - b)
        return self.first[symbol] + here - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, begin, end) of the phrases that occur; phrases: a row each, last byte first.

        The range of a phrase's last eight bytes is looked up among the suffixes' leading bytes; from there the search
        goes backwards, a byte at a time.
        """
        parts = [self._search(phrases, lengths, np.nonzero(lengths >= 8)[0], 8), self._search(phrases, lengths, np.nonzero(lengths < 8)[0], 0)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _search(self, phrases: np.ndarray, lengths: np.ndarray, live: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        begin, end = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        if skip and len(live):
            tail = np.zeros(len(live), np.uint64)
            for k in range(skip - 1, -1, -1):
                tail = (tail << np.uint64(8)) | phrases[live, k]
            begin, end = np.searchsorted(self.heads, tail, "left"), np.searchsorted(self.heads, tail, "right")
            some = begin < end
            live, begin, end = live[some], begin[some], end[some]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(skip, int(lengths[live].max(initial=0))):
            over = lengths[live] == k
            if over.any():
                done.append((live[over], begin[over], end[over]))
                live, begin, end = live[~over], begin[~over], end[~over]
            symbol = self.code[phrases[live, k]]
            known = symbol >= 0
            live, begin, end, symbol = live[known], begin[known], end[known], symbol[known]
            if not len(live):
                break
            both = self.rank(np.concatenate((symbol, symbol)), np.concatenate((begin, end)))
            begin, end = self.first[symbol] + both[: len(live)], self.first[symbol] + both[len(live) :]
            some = begin < end
            live, begin, end = live[some], begin[some], end[some]
        done.append((live, begin, end))
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of places in the suffix order."""
        out, todo, place = np.empty(len(at), np.int64), np.arange(len(at)), at
        for steps in range(SAMPLED):
            words = self.marks[0]
            hit = (words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[todo[hit]] = self.samples[self._ones(self.marks, place[hit])] + steps
            todo, place = todo[~hit], place[~hit]
            if not len(todo):
                break
            place = self.step(place)
        return out


class Phrases:
    """Phrases of a block of items, as rows of bytes, last byte first, with the places in items that they are from.

    A phrase has half the letters of the shortest run that counts, and phrases begin so close to each other that any
    such run of an item holds a whole one. The items lie one after another in letters, each ended by ITEM_END; places
    count from the first letter of all.
    """

    def __init__(self, items: list[tuple[int, str, int]]):
        self.ids, self.runs = [i for i, _, _ in items], np.array([run for _, _, run in items], np.int64)
        self.starts = np.cumsum([0, *(len(text) + 1 for _, text, _ in items)])[:-1]
        self.letters = codes("".join(text + ITEM_END for _, text, _ in items))
        known: dict[bytes, int] = {}
        phrase, place = [], []
        for start, (_, text, run) in zip(self.starts.tolist(), items, strict=True):
            size = run // 2
            for at in range(0, len(text) - size + 1, run - size + 1):
                phrase.append(known.setdefault(text[at : at + size].encode(), len(known)))
                place.append(start + at)
        order = np.argsort(np.array(phrase, np.int64), kind="stable")
        self.places = np.array(place, np.int64)[order]
        self.first = np.searchsorted(np.array(phrase, np.int64)[order], np.arange(len(known) + 1))
        self.lengths = np.array([len(p) for p in known], np.int64)
        self.bytes = np.zeros((len(known), int(self.lengths.max(initial=0))), np.uint8)
        for k, p in enumerate(known):
            self.bytes[k, : len(p)] = np.frombuffer(p[::-1], np.uint8)
        self.longest = int(self.runs.max(initial=0))


#: What ends a part of a document, and an item: no letters, and not the same.
PART_END, ITEM_END = "\x01", "\x02"
#: Pairs of an occurrence and a place in an item that are looked at together.
PAIRS = 1 << 20


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _reach(text: np.ndarray, x: np.ndarray, item: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """How many letters from each place on, in steps of 1 or -1, text and item have in common."""
    n, live = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(live):
        a, b = x[live] + step * n[live], y[live] + step * n[live]
        inside = (a >= 0) & (b >= 0)  # to the right, the ends differ
        inside[inside] = text[a[inside]] == item[b[inside]]
        live = live[inside]
        n[live] += 1
    return n


def shared_runs(text: np.ndarray, x: np.ndarray, phrases: Phrases, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, begin, end) of the runs long enough to count around places x of the text that equal places y of items.

    Places with the same distance between text and item may lie in one run; it is followed once.
    """
    order = np.lexsort((x, x - y))
    x, y = x[order], y[order]
    items, begins, ends = [], [], []
    while len(x):
        first = np.concatenate(([True], np.diff(x - y) != 0))
        fx, fy = x[first], y[first]
        end = fx + _reach(text, fx, phrases.letters, fy, 1)
        begin = fx - _reach(text, fx - 1, phrases.letters, fy - 1, -1)
        item = np.searchsorted(phrases.starts, fy, side="right") - 1
        enough = end - begin >= phrases.runs[item]
        items.append(item[enough])
        begins.append(begin[enough])
        ends.append(end[enough])
        later = x >= end[np.cumsum(first) - 1]
        x, y = x[later], y[later]
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(items), join(begins), join(ends)


def _pairs(phrases: Phrases, found: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in the suffix order, place in an item) of all found phrases, about PAIRS at a time."""
    places = phrases.first[found + 1] - phrases.first[found]
    step = np.maximum(1, PAIRS // places)  # occurrences that a phrase of many items brings at once
    parts = -(-(end - begin) // step)
    which = np.repeat(np.arange(len(found)), parts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    lo = begin[which] + nth * step[which]
    hi = np.minimum(lo + step[which], end[which])
    size = (hi - lo) * places[which]
    for k in np.split(np.arange(len(which)), np.nonzero(np.diff(np.cumsum(size) // PAIRS))[0] + 1):
        if len(k):
            n = (hi - lo)[k] * places[which[k]]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = np.repeat(k, n)
            yield lo[own] + at // places[which[own]], phrases.places[phrases.first[found[which[own]]] + at % places[which[own]]]


def shard_hits(texts: list[tuple[int, int, str]], blocks: list[Phrases]) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, begin, end) of shared runs; texts: (document, letter at which the part begins, letters)."""
    raw = "".join(t + PART_END for _, _, t in texts)
    letters_ = codes(raw)
    data = np.frombuffer(raw.encode() + b"\x00", np.uint8)
    index = FMIndex(data)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    starts = np.concatenate(([0], np.nonzero(letters_ == ord(PART_END))[0][:-1] + 1))
    for phrases in blocks:
        found, begin, end = index.search(phrases.bytes, phrases.lengths)
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for at, place in _pairs(phrases, found, begin, end):
            item, b, e = shared_runs(letters_, char[index.locate(at)], phrases, place)
            part = np.searchsorted(starts, b, side="right") - 1
            for k, i, x, y in zip(part.tolist(), item.tolist(), (b - starts[part]).tolist(), (e - starts[part]).tolist(), strict=True):
                doc, base, _ = texts[k]
                spans.setdefault((doc, phrases.ids[i]), []).append((base + x, base + y))
        for (doc, i), runs in spans.items():
            runs.sort()
            b, e = runs[0]
            for x, y in runs[1:]:
                if x > e:
                    yield doc, i, b, e
                    b, e = x, y
                e = max(e, y)
            yield doc, i, b, e


HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("begin_letter", pa.int64()), ("end_letter", pa.int64())])


def _searcher(held: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Phrases(h.value) for h in held]
        longest = max(p.longest for p in blocks)
        part, size = [], 0

        def hits() -> pa.RecordBatch:
            found = list(shard_hits(part, blocks))
            return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 4)], schema=HITS)

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("letters").to_pylist(), strict=True):
                step = SHARD_BYTES // 4  # a text beyond that is cut, each part repeating a phrase's length less one
                for k in range(0, len(text), step):
                    piece = text[k : k + step + longest - 1]
                    part.append((doc, k, piece))
                    size += len(piece.encode()) + 1
                    if size >= SHARD_BYTES:
                        yield hits()
                        part, size = [], 0
        if part:
            yield hits()

    return run


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str, int]]]:
    """Blocks of (item, letters, letters of a run) of at most about ITEM_BYTES; an item without a run is left out."""
    run = F.when(F.col("lang").isin(*SHORT_LANGS), SHORT_RUN).otherwise(RUN)
    block, size = [], 0
    for r in items.select("item_id", letters(F.col("text")).alias("letters"), run.alias("run")).where("length(letters) >= run").toLocalIterator():
        block.append((r.item_id, r.letters, r.run))
        size += len(r.letters.encode())
        if size >= ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, begin_letter, end_letter: runs that a document shares with an item.

    A run has at least 50 letters, 20 for items in zh and ja. Positions count the letters of the document, from 0, the
    end exclusive. Overlapping phrases of one item are one run. NULL and empty texts have none; a document or item that
    occurs twice is reported once. Only doc_id and text, and item_id, lang and text, are read.

    Items are sent in blocks of ITEM_BYTES. A shard's index is built once for as many as BLOCKS of them; what these
    find is kept before the next are sent, so that no more than that is held anywhere.
    """
    spark = documents.sparkSession
    python_batches(spark, 4)
    docs = documents.where("text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), letters(F.col("text")).alias("letters"))
    blocks = item_blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "lang", "text"))
    found, now = None, list(islice(blocks, BLOCKS))
    while now:
        held = [spark.sparkContext.broadcast(b) for b in now]
        hits = docs.mapInArrow(_searcher(held), "doc_id long, item_id long, begin_letter long, end_letter long")
        now = list(islice(blocks, BLOCKS))
        if found is not None or now:
            hits = cut(hits)
            for h in held:
                h.destroy()
        found = hits if found is None else found.unionByName(hits)
    return spark.createDataFrame([], "doc_id long, item_id long, begin_letter long, end_letter long") if found is None else found.distinct()


def leaked_pairs(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of each document that shares a run with an item."""
    return leaks(documents, items).select("doc_id", "item_id").distinct()


def letter_places(text: str) -> list[int]:
    """For each letter of the lower-cased text, the place in the text of the character it is from."""
    return [i for i, c in enumerate(text) for x in c.lower() if unicodedata.category(x)[0] in "LNM"]


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc, text, runs in zip(b.doc_id, b.text, b.runs, strict=True):
            at = letter_places(text)
            edges: list[list[int]] = []
            for r in sorted((r["begin_letter"], r["end_letter"]) for r in runs):
                lo, hi = at[r[0]], at[r[1] - 1] + 1
                if edges and lo <= edges[-1][1]:
                    edges[-1][1] = max(edges[-1][1], hi)
                else:
                    edges.append([lo, hi])
            kept = re.sub(r"\s+", " ", "".join(text[x:y] for x, y in zip([0, *(e for _, e in edges)], [*(s for s, _ in edges), len(text)], strict=True))).strip()
            rows.extend((doc, lo, hi, len(kept)) for lo, hi in edges)
        yield pd.DataFrame(rows, columns=["doc_id", "begin_char", "end_char", "chars_left"])


def removal_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, begin_char, end_char of what to take out of each document, runs of all items merged, and chars_left
    (characters of what stays, blanks joined). Of rows with equal doc_id the text that sorts first is used; rows without a
    doc_id are left out."""
    runs = cut(leaks(documents, items))
    found = runs.groupBy("doc_id").agg(F.collect_set(F.struct("begin_letter", "end_letter")).alias("runs"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(runs.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return texts.join(found, "doc_id").mapInPandas(_spans, "doc_id long, begin_char long, end_char long, chars_left long")
