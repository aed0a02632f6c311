import random

import pandas as pd
import pytest

from quarrystone.operators import grams


def brute(text, longest):
    b = text.encode()
    w = [grams.weight(x, y) for x, y in zip(b, b[1:], strict=False)]
    return {b[i : j + 2] for i in range(len(w)) for j in range(i, min(len(w), i + longest - 1)) if j <= i + 1 or min(w[i], w[j]) > max(w[i + 1 : j])}


def test_weights():
    w = lambda s: grams.weight(*s.encode())
    assert w("th") == 4 and 30 <= w("qz") <= 50 and w("/q") == 120 and w("eB") == 100 and w("  ") == 3
    assert w("Ba") == 40 and w("AA") == 42 and w("a1") == w("1a") == 70 and grams.weight(200, 65) == 220 and grams.weight(0, 65) == 180 and grams.weight(200, 201) == 230


@pytest.mark.parametrize("longest", [2, 3, 4, 8, 128])
def test_spans_against_definition(longest):
    random.seed(longest)
    for _ in range(150):
        text = "".join(random.choice("abtheE 1/é漢") for _ in range(random.randint(0, 60)))
        other = "".join(random.choice("the ") for _ in range(9))
        assert set(grams.gram_strings(text, longest)) == brute(text, longest)
        which, found = grams.text_grams([text, other, "", text + "x"], longest)
        for k, t in enumerate([text, other, "", text + "x"]):
            assert set(found[which == k].tolist()) == {grams.gram_hash(g) for g in brute(t, longest)}
        a = random.randint(0, len(text))
        part = text[a : random.randint(a, len(text))]
        assert set(grams.cover(part, longest)) <= set(grams.gram_strings(text, longest))


def test_extraction_is_deterministic():
    a = grams.gram_strings("struct SearchEngine", 8)
    assert a == grams.gram_strings("struct SearchEngine", 8) and b"st" in a and any(len(g) >= 3 for g in a)


@pytest.mark.parametrize(
    ("literal", "want"),
    [("SearchEngine", ["SearchE", "hEngine"]), ("fast lookup", ["fast lo", "look", "okup"]), ("heron", ["her", "ron"]), ("sparse-index", ["spa", "pars", "rse-", "-inde", "dex"]), ("a", []), ("", [])],
)
def test_cover(literal, want):
    assert [g.decode() for g in grams.cover(literal)] == want


def test_postings(frame):
    rows = [(1, "heron"), (2, None), (3, ""), (4, "x"), (5, "heron heron"), (None, "heron")]
    got = grams.postings(frame(rows, "chunk_id long, text string"))
    assert {r.chunk_id for r in got.where(f"gram = {grams.gram_hash(b'her')}").collect()} == {1, 5}
    lists = {r.gram: r.chunks for r in grams.posting_lists(got).collect()}
    assert lists[grams.gram_hash(b"ron")] == [1, 5]
    far = grams.postings(frame([(1, "heron"), (grams.LIST_SPAN, "heron"), (grams.LIST_SPAN + 9, "heron")], "chunk_id long, text string"))
    assert [(r.block, r.chunks) for r in grams.posting_lists(far).where(f"gram = {grams.gram_hash(b'ron')}").orderBy("block").collect()] == [(0, [1]), (1, [grams.LIST_SPAN, grams.LIST_SPAN + 9])]
    assert grams.postings(frame([], "chunk_id long, text string")).count() == 0


def test_sorted_postings(frame, monkeypatch):
    rows = [(k, t) for k, t in enumerate(["heron", None, "", "x", "heron heron", "an archive box", "漢字 heron", "the heron box"])] + [(None, "heron")]
    chunks = frame(rows, "chunk_id long, text string")
    want = sorted(map(tuple, grams.postings(chunks).collect()))
    got = grams.sorted_postings(chunks)
    assert sorted(map(tuple, got.collect())) == want
    plan = chunks.sparkSession._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert "Exchange" not in plan and "Sort" not in plan
    monkeypatch.setattr(grams, "BLOCK_CHARS", 10)
    monkeypatch.setattr(grams, "ROWS_AT_ONCE", 7)
    batches = [pd.DataFrame({"chunk_id": [k], "text": [t]}) for k, t in rows[4:8]]
    parts = list(grams._block_sorter(128)(iter(batches)))
    assert max(map(len, parts)) <= 7
    found = [(int(g), int(i)) for p in parts for g, i in zip(p.gram, p.chunk_id, strict=True)]
    assert sorted(found) == [r for r in want if r[1] >= 4] and found != sorted(found)  # several blocks, sorted each
    monkeypatch.setattr(grams, "BLOCK_CHARS", 1000)
    found = [(int(g), int(i)) for p in grams._block_sorter(128)(iter(batches)) for g, i in zip(p.gram, p.chunk_id, strict=True)]
    assert found == [r for r in want if r[1] >= 4] and not list(grams._block_sorter(128)(iter([])))
