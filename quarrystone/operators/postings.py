"""Plans over grams as set algebra over the postings table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.planner import And, Lookup, Or, Plan, ScanAll


def _lookups(children: tuple[Plan, ...]) -> tuple[list[int], list[Plan]]:
    hashes = sorted({c.hash for c in children if isinstance(c, Lookup)})
    return hashes, [c for c in children if not isinstance(c, Lookup)]


def _in_all(hits: DataFrame, hashes: list[int]) -> DataFrame:
    """chunk_id of the chunks that have all of the grams: a bit for each, put together in one aggregation."""
    if len(hashes) == 1:
        return hits.select("chunk_id").distinct()
    bits = []
    for k in range(0, len(hashes), 62):
        part = hashes[k : k + 62]
        bit = F.lit(0).cast("long")
        for j, h in enumerate(part):
            bit = F.when(F.col("gram") == h, F.lit(1 << j)).otherwise(bit)
        bits.append((F.bit_or(bit).alias(f"b{k}"), F.col(f"b{k}") == (1 << len(part)) - 1))
    out = hits.groupBy("chunk_id").agg(*(b for b, _ in bits))
    for _, all_set in bits:
        out = out.where(all_set)
    return out.select("chunk_id")


def candidates(plan: Plan, postings: DataFrame) -> DataFrame | None:
    """chunk_id of the chunks that satisfy a plan, each once; None for all.

    The lookups of a conjunction are one scan of the postings (a pushed-down IN) and one aggregation per chunk.
    """
    if isinstance(plan, ScanAll):
        return None
    if isinstance(plan, Lookup):
        return postings.where(F.col("gram") == plan.hash).select("chunk_id").distinct()
    hashes, rest = _lookups(plan.children)
    if isinstance(plan, Or):
        parts = [postings.where(F.col("gram").isin(hashes)).select("chunk_id")] if hashes else []
        for c in rest:
            part = candidates(c, postings)
            if part is None:
                return None
            parts.append(part)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct()
    assert isinstance(plan, And)
    out = None
    if hashes:
        out = _in_all(postings.where(F.col("gram").isin(hashes)), hashes)
    for c in rest:
        part = candidates(c, postings)
        if part is not None:
            out = part if out is None else out.join(part, "chunk_id", "left_semi")
    return out


#: Candidates up to which their ids go to the scan, at most 2 MB; those up to which they are part of its filter; and
#: the ranges of ids that are pushed down.
FEW, IN_FILTER, RANGES = 100_000, 500, 64


def id_ranges(ids: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """At most so many ranges that hold all of the sorted ids and leave out the widest gaps between them."""
    gaps = sorted(range(1, len(ids)), key=lambda k: ids[k - 1] - ids[k])[: most - 1]
    edges = [0, *sorted(k for k in gaps if ids[k] - ids[k - 1] > 1), len(ids)]
    return [(ids[a], ids[b - 1]) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def restricted(chunks: DataFrame, plan: Plan, postings: DataFrame) -> DataFrame:
    """The chunks that a plan lets through.

    Few candidates go to the scan: as ranges of ids, which Parquet checks against its row groups and pages, and as the
    ids themselves, in the filter or broadcast, before any text is looked at. So a store that is sorted by ids reads
    little more than the candidates, and the postings are searched once. Many candidates are joined, by a way left to
    their size at run time.
    """
    ids = candidates(plan, postings)
    if ids is None:
        return chunks
    some = ids.limit(FEW + 1).toArrow()
    if some.num_rows > FEW:
        return chunks.join(ids, "chunk_id", "left_semi")
    found = sorted(some.column("chunk_id").to_pylist())
    if not found:
        return chunks.where("false")
    near = chunks.where(" OR ".join(f"chunk_id BETWEEN {a}L AND {b}L" for a, b in id_ranges(found)))
    if len(found) <= IN_FILTER:
        return near.where(f"chunk_id IN ({', '.join(f'{i}L' for i in found)})")
    return near.join(F.broadcast(chunks.sparkSession.createDataFrame(some)), "chunk_id", "left_semi")
