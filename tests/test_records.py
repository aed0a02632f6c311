import pytest

from quarrystone.config import CHUNK_COUNT_BUDGET, CHUNK_TOO_LARGE, RESIDENT_BUDGET, ChunkingConfig, EngineError, MemoryBudget, RecordIndexConfig
from quarrystone.operators import records
from quarrystone.sources.providers import records_frame
from tests.conftest import RECORD


def brute(text, limit, lap, breaks):
    """The cutting rules, character by character."""
    if len(text.encode()) <= limit:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = start
        while end < len(text) and len(text[start : end + 1].encode()) <= limit:
            end += 1
        if end < len(text):
            cut = next((k for k in range(end, start, -1) if text[k - 1] in breaks), end)
            end = cut
        if text[start:end].strip():
            out.append(text[start:end].strip())
        if end >= len(text):
            break
        back = end
        while back > 0 and len(text[back - 1 : end].encode()) <= lap:
            back -= 1
        start = back if start < back < end else end
        while start < len(text) and text[start].isspace():
            start += 1
    return out


@pytest.mark.parametrize(("limit", "lap"), [(256, 0), (256, 64), (300, 10), (512, 500)])
def test_chunks_against_rules(limit, lap):
    import random

    random.seed(limit + lap)
    config = ChunkingConfig(limit, lap)
    for _ in range(60):
        text = "".join(random.choice(random.choice(["ab \n", "漢é ", "xyz"])) for _ in range(random.randint(0, 1500)))
        assert records.chunk_text(text, config) == brute(text, limit, lap, config.break_characters)


@pytest.mark.parametrize("text", ["ab " + "x" * 9000, "y" * 99 + " " + "x" * 9000, "x" * 20000])
def test_unbroken_text_ends(text):
    got = records.chunk_text(text, ChunkingConfig())
    assert len(got) < 10 and all(len(c) <= 8192 for c in got)
    if text == "x" * 20000:
        assert [len(c) for c in got] == [8192, 8192, 3744]


def test_config_limits():
    c = ChunkingConfig(3, -1)
    assert (c.max_chunk_bytes, c.overlap_bytes) == (256, 0)
    assert ChunkingConfig.from_dict({"max_chunk_bytes": 500, "unknown": 1}).overlap_bytes == 64
    assert RecordIndexConfig(compaction_threshold=0).compaction_threshold == 1


def test_units_and_chunk_ids(spark, frame):
    rows = [("b", "c", "", "body b", {"z": "last", "a": "first", "n": None, "e": ""}, [], {}, 1), ("a", "c", "title a", "w " * 300, None, None, None, 2), ("n", "c", None, None, None, None, None, None)]
    df = frame([(*r, k) for k, r in enumerate(rows)], RECORD + ", row_no long")
    got = [(r.record_id, r.field, r.text[:6]) for r in records.units(df, ("row_no",)).orderBy("row_no", "field_no").collect()]
    assert got == [("b", "body", "body b"), ("b", "a", "first"), ("b", "z", "last"), ("a", "title", "title "), ("a", "body", "w w w ")]
    config = ChunkingConfig(256, 0)
    by_row = [(r.chunk_id, r.record_id, r.field, r.ordinal) for r in records.chunk_records(df, config, by="row_no").orderBy("chunk_id").collect()]
    assert by_row == [(0, "b", "body", 0), (1, "b", "a", 0), (2, "b", "z", 0), (3, "a", "title", 0), (4, "a", "body", 0), (5, "a", "body", 1), (6, "a", "body", 2)]
    by_key = records.chunk_records(df, config, start=10)
    assert [r.record_id for r in by_key.orderBy("chunk_id").collect()] == ["a"] * 4 + ["b"] * 3
    assert by_key.agg({"chunk_id": "min"}).first()[0] == 10
    assert [r.chunk_id for r in records.renumbered(by_key).orderBy("chunk_id").collect()] == list(range(7))
    assert records.chunk_records(frame([], RECORD)).count() == 0


def test_latest_per_key(frame):
    df = frame([("a", "c", 1), ("a", "c", 3), ("a", "d", 2), (None, "c", 1)], "id string, collection string, n int")
    assert sorted((r.collection, r.id or "", r.n) for r in records.latest_per_key(df, "n").collect()) == [("c", "", 1), ("c", "a", 3), ("d", "a", 2)]


@pytest.mark.parametrize(("budget", "code"), [(MemoryBudget(max_resident_bytes=10), RESIDENT_BUDGET), (MemoryBudget(max_chunks=1), CHUNK_COUNT_BUDGET), (MemoryBudget(max_chunk_bytes=256), CHUNK_TOO_LARGE)])
def test_budgets(spark, budget, code):
    chunks = records.chunk_records(records_frame(spark, [dict(id="a", collection="c", title="t", body="x" * 400)]))
    with pytest.raises(EngineError) as e:
        records.check_budget(chunks, budget)
    assert e.value.code == code
    records.check_budget(chunks, MemoryBudget())


def test_signature_depends_on_content_alone(spark):
    rows = [dict(id=str(k), collection="c", body=f"b{k}", metadata={"m": str(k)}) for k in range(20)]
    sign = lambda r: records.corpus_signature(records_frame(spark, r)).first()[0]
    assert sign(rows) == sign(rows[::-1]) == sign([{**r, "metadata": {}} for r in rows])
    assert sign(rows) != sign(rows[1:]) and sign(rows) != sign([*rows[1:], {**rows[0], "body": "other"}])
