"""Mixing sources of documents to target shares of tokens.

Tokens are counted with a public tokenizer. The largest total at which every source that has documents can reach its
share without being repeated too often is found, and token weights of the cells (source, language, topic) are raked to
it by iterative proportional fitting: sources to their targets, languages and topics to their shares in the corpus.
A cell's weight over its tokens is how often its documents are wanted on average; the whole part of that is copies of
all, the rest is sampled, with one threshold per source set so that the source's tokens come out.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.functions.frames import cut, python_batches, scratch, small

#: Steps of the thresholds, rounds of raking, and steps for the sources in a round.
STEPS, ROUNDS, SOURCE_STEPS = 4096, 200, 20
#: The cluster's rounds, as many as the driver's, so that the number of cells decides where they are raked, not to what.
CLUSTER_ROUNDS = ROUNDS
#: Cells (source, language, topic) up to which the driver rakes; beyond, the cluster does.
DRIVER_CELLS = 100_000
AXES = ("source", "lang", "topic")
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how a byte-level BPE splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer(path: str):
    return _encoding(Path(path).read_bytes())


@lru_cache(2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A run of so many blanks is beyond what the tokenizer's splitting takes in one piece.
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def count_tokens(text: str, encoding) -> int:
    """The number of tokens of a text, as the tokenizer has it for the whole text.

    A long run of blanks is cut out before, where the splitting pattern cuts: all of it but the last blank, which goes
    with what follows, is one piece, or all of it at the end of the text. Nothing else is cut, however long.
    """
    n, at = 0, 0
    for run in LONG_BLANK.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        n += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return n + len(encoding.encode_ordinary(text[at:]))


def _counter(held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(held.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "source": b.source, "lang": b.lang, "topic": b.topic, "tokens": [count_tokens(t, encoding) for t in b.text]})

    return run


def source_name(source: Column) -> Column:
    """A source however it is spelled: lower case, no outer blanks, underscores between words; NULL stays NULL."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_")


def language(lang: Column) -> Column:
    """The primary subtag of a language code in lower case; und for what is none."""
    code = F.regexp_extract(F.lower(F.trim(F.coalesce(lang, F.lit("")))), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(code == "", "und").when(code == "jp", "ja").otherwise(code)


def unit_of(most: float) -> float:
    """In how many parts, a power of two, a token is counted so that weights of at most so much are summed as integers,
    exactly and so in any order. A token a cell, as most has at least, leaves room for rounding up."""
    return 2.0 ** (61 - math.frexp(max(1.0, most))[1])


def _sums(w: np.ndarray, most: np.ndarray, classes: np.ndarray, n: int, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """The weight of each of n classes, and that of its cells below their most."""
    parts = np.ceil(w * unit).astype(np.int64)
    have, free = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(have, classes, parts)
    np.add.at(free, classes, np.where(w < most, parts, 0))
    return have / unit, free / unit


def fitted(w: np.ndarray, most: np.ndarray, have: np.ndarray, free: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Cell weights moved towards the total of their class, of which have, free and total are given for each cell."""
    lack = total - have
    up = np.where(free > 0, 1 + lack / np.maximum(free, 1e-9), 1)
    down = np.where(have > 0, total / np.maximum(have, 1e-9), 1)
    return np.where((lack > 0) & (w >= most), w, np.minimum(w * np.where(lack > 0, up, down), most))


def _settled(moved: float, weight: float) -> bool:
    return moved < 1e-6 * max(1.0, weight)


def rake(tokens: np.ndarray, axes: list[np.ndarray], totals: list[np.ndarray], most: np.ndarray, unit: float | None = None) -> np.ndarray:
    """Cell weights with the given totals along each axis, the first axis' exactly, none above its cell's most.

    axes: for each axis the class of each cell. A class whose cells are all at their most stays below its total.
    """
    w = np.minimum(tokens.astype(float), most)
    unit = unit or unit_of(max(w.sum(), *(t.sum() for t in totals)))
    order = [*range(1, len(axes)), 0]
    for _ in range(ROUNDS):
        before = w
        for a in order:
            for _ in range(SOURCE_STEPS if a == 0 else 1):
                have, free = _sums(w, most, axes[a], len(totals[a]), unit)
                w = fitted(w, most, have[axes[a]], free[axes[a]], totals[a][axes[a]])
        if _settled(np.abs(w - before).max(initial=0), int(np.ceil(w * unit).astype(np.int64).sum()) / unit):
            break
    return w


def sized(documents: DataFrame, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, lang, topic (thread or loose, by whether there is a conversation), tokens.

    The vocabulary, a file of the driver's of a few megabytes at most, is sent to the executors."""
    spark = documents.sparkSession
    python_batches(spark, 4)
    held = spark.sparkContext.broadcast(Path(tokenizer_path).read_bytes())
    docs = documents.where("text <> ''").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        source_name(F.col("source")).alias("source"),
        language(F.col("lang")).alias("lang"),
        F.when(F.col("conversation").isNull(), "loose").otherwise("thread").alias("topic"),
    )
    return docs.mapInPandas(_counter(held), "doc_id long, source string, lang string, topic string, tokens long")


def _moved(cells: pd.DataFrame, axis: str, known: dict[str, tuple[float, float, float]]) -> pd.DataFrame:
    """The cells fitted along an axis, of each of whose classes have, free and total are known."""
    have, free, total = np.array([known[c] for c in cells[axis]]).reshape(-1, 3).T
    return cells.assign(weight=fitted(cells.weight.to_numpy(), cells.most.to_numpy(), have, free, total))


def _language_fitter(langs: dict):
    return lambda batches: (_moved(b, "lang", langs) for b in batches)


def _round_fitter(langs: dict, topics: dict, unit: float):
    """A round's steps for the cells of one source."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        before = cells.weight.to_numpy()
        cells = _moved(_moved(cells, "lang", langs), "topic", topics)
        w, most, one = cells.weight.to_numpy(), cells.most.to_numpy(), np.zeros(len(cells), np.int64)
        for _ in range(SOURCE_STEPS):
            have, free = _sums(w, most, one, 1, unit)
            w = fitted(w, most, have[one], free[one], cells.total.to_numpy())
        return cells.assign(weight=w, moved=np.abs(w - before))

    return run


def rake_cells(cells: DataFrame, totals: DataFrame, unit: float) -> DataFrame:
    """rake() for any number of cells, to the same bits: sums are exact and the steps are its own.

    cells: source, lang, topic, tokens, most. totals: axis, class, total. Adds weight. Sums of languages (two or three
    letters, so 18,252 at most) and topics (two) go through the driver; the cells of a source, no more than those two
    make, are fitted by one task. The cells of a round are kept in the shared folder until those of the next are there.
    """
    spark = cells.sparkSession
    python_batches(spark)
    goal = {(r.axis, r["class"]): r.total for r in totals.where("axis <> 'source'").collect()}
    of_source = cut(totals.where("axis = 'source'").select(F.col("class").alias("source"), "total"))
    parts = F.ceil(F.col("weight") * F.lit(unit))
    free = F.when(F.col("weight") < F.col("most"), parts).otherwise(0)

    def sums(w: DataFrame, a: str) -> tuple[dict, bool]:
        rows = w.groupBy(a).agg(F.sum(parts).alias("have"), F.sum(free).alias("free"), F.max("moved").alias("moved")).collect()
        return {r[a]: (r.have / unit, r.free / unit, goal[a, r[a]]) for r in rows}, _settled(max((r.moved for r in rows), default=0.0), sum(r.have for r in rows) / unit)

    w = cut(cells.withColumn("weight", F.least(F.col("tokens").cast("double"), F.col("most"))).join(small(of_source), "source").withColumn("moved", F.lit(0.0)))
    kept = ""
    for _ in range(CLUSTER_ROUNDS):
        langs, settled = sums(w, "lang")
        if settled and kept:
            break
        topics, _ = sums(w.mapInPandas(_language_fitter(langs), w.schema), "topic")
        at = scratch(spark, "raked")
        w.groupBy("source").applyInPandas(_round_fitter(langs, topics, unit), w.schema).write.parquet(at)
        w = spark.read.schema(w.schema).parquet(at)
        if kept:
            path = spark._jvm.org.apache.hadoop.fs.Path(kept)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        kept = at
    return w.drop("total", "moved")


def wanted(targets: DataFrame) -> DataFrame:
    """source, target_share, most of the sources with a target, each once."""
    read = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.greatest(F.lit(1), F.coalesce("max_repeats", F.lit(1))).cast("int").alias("most"))
    return read.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("most").alias("most"))


def _plan(documents: DataFrame, targets: DataFrame, total: int | None, tokenizer_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents of sources with a target, with their tokens; whole and part copies of each cell; axis, class, total:
    the tokens wanted of each source, language and topic)."""
    names = cut(wanted(targets))
    docs = cut(sized(documents, tokenizer_path).join(small(names.select("source")), "source"))
    cells = cut(docs.groupBy(*AXES).agg(F.sum("tokens").alias("tokens")).where("tokens > 0").join(small(names), "source"))
    of_source = cells.groupBy("source").agg(F.sum("tokens").alias("have"), F.first("target_share").alias("share"), F.first("most").alias("most"))
    # Shares of those sources that have documents, and the largest size at which each can reach its own.
    whole = of_source.agg(F.sum("share").alias("shares"), F.min(F.col("have") * F.col("most") / F.col("share")).alias("reach")).first()
    size = (whole.reach or 0.0) * (whole.shares or 0.0) if total is None else float(total)
    wants = of_source.select("source", F.least(F.col("share") / F.lit(whole.shares or 1.0) * size, F.col("have") * F.col("most") * 1.0).alias("total"))
    sums = wants.agg(F.coalesce(F.sum("total"), F.lit(0.0))).first()[0]
    tokens = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    totals = wants.select(F.lit("source").alias("axis"), F.col("source").alias("class"), "total")
    for a in AXES[1:]:
        totals = totals.unionByName(cells.groupBy(a).agg((F.sum("tokens") * F.lit(sums / max(1, tokens))).alias("total")).select(F.lit(a).alias("axis"), F.col(a).alias("class"), "total"))
    totals = cut(totals)
    bounded = cells.select(*AXES, "tokens", (F.col("most") * F.col("tokens")).cast("double").alias("most"), F.col("most").alias("copies"))
    rows = cells.limit(DRIVER_CELLS + 1).count()
    unit = unit_of(max(sums, tokens))
    raked = _raked_here(bounded, totals, unit) if rows <= DRIVER_CELLS else rake_cells(bounded, totals, unit)
    rate = F.least(F.col("weight") / F.col("tokens"), F.col("copies").cast("double"))
    raked = raked.withColumn("whole", F.floor(rate + 1e-9).cast("int")).withColumn("part", F.greatest(F.lit(0.0), rate - F.floor(rate + 1e-9)))
    return docs, cut(raked.select(*AXES, "whole", "part")), totals


def _raked_here(cells: DataFrame, totals: DataFrame, unit: float) -> DataFrame:
    """The cells with weight, raked by the driver, which holds at most DRIVER_CELLS of them."""
    spark = cells.sparkSession
    rows = cells.orderBy(*AXES).collect()
    axes, sums = [], []
    goal = {(r.axis, r["class"]): r.total for r in totals.collect()}  # no more than three for each cell
    for a in AXES:
        values = {v: k for k, v in enumerate(sorted({r[a] for r in rows}))}
        axes.append(np.array([values[r[a]] for r in rows], np.int64))
        sums.append(np.array([goal[a, v] for v in values]))
    w = rake(np.array([r.tokens for r in rows], np.int64), axes, sums, np.array([r.most for r in rows]), unit) if rows else []
    return spark.createDataFrame([(*r, float(x)) for r, x in zip(rows, w, strict=True)], cells.schema.add("weight", "double"))


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, lang, topic, tokens, copies (1 or more) of the documents in the mixture.

    Without total_tokens the mixture is as large as the targets and repeats allow; with it, a source that cannot reach
    its share of it is repeated as often as it may. Sources are matched however they are spelled; of several targets of
    one source the largest counts. A source without documents has no share, and the others' targets are raised in
    proportion; documents of sources without a target are left out, as are NULL and empty texts. A max_repeats that is
    NULL or below 1 is 1.
    """
    return _mixed(documents, targets, total_tokens, tokenizer_path)[0]


def _mixed(documents: DataFrame, targets: DataFrame, total_tokens: int | None, tokenizer_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, plan, totals = _plan(documents, targets, total_tokens, tokenizer_path)
    rated = docs.join(small(plan), list(AXES))
    u = lambda seed: (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))
    z = F.when(F.col("part") > 1e-9, F.least(F.floor(u(11) / F.col("part") * (STEPS // 4)), F.lit(STEPS)).cast("int"))
    placed = rated.withColumn("z", z)
    # What is left to sample of each source, and the step up to which its documents are taken.
    steps = placed.groupBy("source", "z").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("whole")).alias("fixed"))
    goal = totals.where("axis = 'source'").select(F.col("class").alias("source"), F.col("total").alias("want"))
    by = Window.partitionBy("source")  # at most STEPS + 2 rows of a source
    need = F.col("want") - F.sum("fixed").over(by)
    before = F.coalesce(F.sum(F.when(F.col("z").isNotNull(), F.col("tokens"))).over(by.orderBy(F.col("z").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(need - before, F.col("tokens").cast("double"))))
    taken = cut(steps.join(small(goal), "source").select("source", "z", F.when(F.col("z").isNotNull(), ratio).alias("ratio")).where("z IS NOT NULL"))
    # Documents without a step meet none; they are spread, as a source may have most of its documents there.
    placed = placed.withColumn("z", F.coalesce("z", -1 - F.pmod(F.xxhash64("doc_id"), F.lit(STEPS)).cast("int")))
    chosen = placed.join(small(taken), ["source", "z"], "left")
    copies = F.col("whole") + F.when(u(23) < F.coalesce("ratio", F.lit(0.0)), 1).otherwise(0)
    return chosen.select("doc_id", "source", "lang", "topic", "tokens", copies.cast("int").alias("copies")).where("copies > 0"), totals, docs


def shares(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """source, target_share, max_repeats, documents, tokens (both with copies), reached_share, most_copies for every
    source with a target; zeros for one without documents."""
    got = mixture(documents, targets, total_tokens, tokenizer_path).groupBy("source").agg(
        F.sum("copies").alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    joined = wanted(targets).withColumnRenamed("most", "max_repeats").join(small(got), "source", "left").na.fill(0, ["documents", "tokens", "most_copies"])
    return _with_shares(joined, []).select("source", "target_share", "max_repeats", "documents", "tokens", "reached_share", "most_copies")


def _with_shares(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows, few of them, with reached_share: their part of all tokens of the same value of by."""
    whole = F.sum("tokens").over(Window.partitionBy(*by))
    return rows.withColumn("reached_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), whole.cast("double")), F.lit(0.0)))


def margins(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """axis (source, lang, topic), class, wanted_share, tokens (with copies), reached_share: how near the mixture comes
    to every total that it was raked to."""
    mixed, totals, _ = _mixed(documents, targets, total_tokens, tokenizer_path)
    sums = cut(mixed.groupBy(*AXES).agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens")))
    got = None
    for a in AXES:
        part = sums.groupBy(a).agg(F.sum("tokens").alias("tokens")).select(F.lit(a).alias("axis"), F.col(a).alias("class"), "tokens")
        got = part if got is None else got.unionByName(part)
    wanted = totals.withColumn("wanted_share", F.coalesce(F.try_divide(F.col("total"), F.sum("total").over(Window.partitionBy("axis"))), F.lit(0.0)))
    joined = wanted.join(small(got), ["axis", "class"], "left").na.fill(0, ["tokens"])
    return _with_shares(joined, ["axis"]).select("axis", "class", "wanted_share", "tokens", "reached_share")


def deviations(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """source, max_repeats, wanted_tokens, tokens, most_copies, longest for every source with a target: what it should
    and does contribute, and the tokens of its longest document, as which no mixture can come nearer. Zeros for a
    source without documents."""
    mixed, totals, docs = _mixed(documents, targets, total_tokens, tokenizer_path)
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    longest = docs.groupBy("source").agg(F.max("tokens").alias("longest"))
    wants = totals.where("axis = 'source'").select(F.col("class").alias("source"), F.col("total").alias("wanted_tokens"))
    rows = wanted(targets).select("source", F.col("most").alias("max_repeats"))
    for part in (wants, got, longest):
        rows = rows.join(small(part), "source", "left")
    return rows.na.fill(0).select("source", "max_repeats", "wanted_tokens", "tokens", "most_copies", "longest")
