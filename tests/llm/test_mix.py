import os

import numpy as np
import pytest
import regex

from quarrystone.llm import mix

pytestmark = pytest.mark.skipif(not os.path.exists(mix.TOKENIZER), reason="no tokenizer files")
DOCS = "doc_id long, text string, lang string, source string, conversation string, tokens string, copies int, most int"
TARGETS = "source string, target_share double, max_repeats int"


def docs(n=2000):
    out = []
    for k in range(n):
        source = ["big", "Big ", "mid-size", "small", None, "unlisted"][min(5, int(np.sqrt(k % 40)))]
        out.append((k, f"document {k} says " + "word " * (k % 50), ["en", "de-DE", None, "jp"][k % 4], source, None if k % 3 else "c", "t", 1, 1))
    return out


def test_shares_are_reached_within_repeats(frame):
    d = frame([*docs(), (-1, None, None, "big", None, None, None, None), (-2, "", "en", "big", None, None, None, None)], DOCS)
    t = frame([("BIG", 0.5, 2), ("mid size", 0.3, 4), ("small", 0.1, 3), ("absent", 0.1, 9), (None, 0.5, 1), ("zero", 0.0, 1)], TARGETS)
    got = {r.source: r for r in mix.shares(d, t.where("source <> 'zero' OR source IS NULL").where("source IS NOT NULL")).collect()}
    for s, share in (("big", 0.5 / 0.9), ("mid_size", 0.3 / 0.9), ("small", 0.1 / 0.9)):
        assert got[s].reached_share == pytest.approx(share, abs=0.02)
        assert got[s].most_copies <= got[s].max_repeats
    assert got["absent"].tokens == 0
    m = mix.mixture(d, t)
    assert {r.source for r in m.select("source").distinct().collect()} == {"big", "mid_size", "small"}
    assert m.count() == m.select("doc_id").distinct().count()


def test_total_that_sources_cannot_reach(frame):
    t = frame([("big", 0.5, 1), ("small", 0.5, 2)], TARGETS)
    got = {r.source: r for r in mix.shares(frame(docs(), DOCS), t, total_tokens=10**9).collect()}
    assert got["big"].most_copies == 1 and got["small"].most_copies == 2


def test_rake_meets_totals():
    tokens = np.array([50, 10, 30, 5, 100, 1])
    axes = [np.array([0, 0, 1, 1, 2, 2]), np.array([0, 1, 0, 1, 0, 1])]
    totals = [np.array([40.0, 20, 40]), np.array([80.0, 20])]
    w = mix.rake(tokens, axes, totals, tokens * 4.0)
    assert np.bincount(axes[0], w) == pytest.approx(totals[0], abs=1e-3)
    assert (w <= tokens * 4.0 + 1e-9).all()


def by_pieces(text):
    """The count of the tokenizer by its pattern's pieces, one at a time."""
    t = mix.tokenizer(mix.TOKENIZER)
    return sum(len(t._encode_single_piece(p)) for p in regex.findall(mix.PATTERN, text))


@pytest.mark.parametrize(
    "text",
    [
        "Hello, wonderful world of 12 tokens", "ab1" * 2000, "我们去北京看天安门" * 2000, "日本語の長い文章です" * 6000, "ภาษาไทยไม่มีช่องว่าง" * 5000, "x" * 300_000,
        "a" + " " * 5000 + "b", "a" + "\n" * 3000 + "b", " " * 4000, "word " * 30_000 + " \n" * 2000 + "end", "don't" + "\u3000" * 1500 + "'s it", "it's" * 20_000, "\x1c" * 3000,
    ],
)
def test_tokens_are_those_of_the_tokenizer(frame, text):
    assert mix.count_tokens(text, mix.tokenizer(mix.TOKENIZER)) == by_pieces(text)
    assert mix.sized(frame([(1, text, "en", "s", None, None, None, None)], DOCS)).first().tokens == by_pieces(text)


def test_cluster_rakes_like_the_driver(frame, monkeypatch):
    d, t = frame(docs(), DOCS), frame([("BIG", 0.5, 2), ("mid size", 0.3, 4), ("small", 0.2, 3)], TARGETS)
    here = {r[:3]: r[3:] for r in map(tuple, mix._plan(d, t, None, mix.TOKENIZER)[1].collect())}
    monkeypatch.setattr(mix, "DRIVER_CELLS", 0)
    monkeypatch.setattr(mix, "CLUSTER_ROUNDS", 2)
    there = {r[:3]: r[3:] for r in map(tuple, mix._plan(d, t, None, mix.TOKENIZER)[1].collect())}
    assert here.keys() == there.keys()
    for k, (whole, part) in here.items():
        assert sum(there[k]) == pytest.approx(whole + part, abs=0.06)


def test_margins(frame):
    d, t = frame(docs(4000), DOCS), frame([("BIG", 0.5, 2), ("mid size", 0.3, 4), ("small", 0.2, 3)], TARGETS)
    got = mix.margins(d, t).collect()
    assert {r.axis for r in got} == {"source", "lang", "topic"}
    assert all(r.reached_share == pytest.approx(r.wanted_share, abs=0.03) for r in got)


def test_empty(frame):
    t = frame([("a", 1.0, None)], TARGETS)
    assert mix.mixture(frame([], DOCS), t).count() == 0
    assert mix.shares(frame([], DOCS), t).first().tokens == 0
    assert mix.mixture(frame(docs(50), DOCS), frame([], TARGETS)).count() == 0


def test_where_cells_are_raked_decides_nothing(frame):
    """Cells at their repeats, so that neither a few rounds nor a few steps for the sources are enough."""
    rng = np.random.default_rng(3)
    cells = []
    for k in range(6):
        for lang in ("en", "de", "fr", "zh"):
            for topic in ("loose", "thread"):
                n = int(rng.integers(1, 5000) ** 1.5)
                cells.append((f"s{k}", lang, topic, n, float(n * (1 + k % 3)), 1 + k % 3))
    tokens = sum(r[3] for r in cells)
    totals = [("source", f"s{k}", sum(r[4] for r in cells if r[0] == f"s{k}") * 0.95 / (1 + k % 2)) for k in range(6)]
    wanted = sum(r[2] for r in totals)
    for i, axis in ((1, "lang"), (2, "topic")):
        totals += [(axis, c, sum(r[3] for r in cells if r[i] == c) / tokens * wanted) for c in sorted({r[i] for r in cells})]
    c = frame(cells, "source string, lang string, topic string, tokens long, most double, copies int")
    t = frame(totals, "axis string, class string, total double")
    unit = mix.unit_of(max(wanted, tokens))
    here = sorted(map(tuple, mix._raked_here(c, t, unit).collect()))
    assert here == sorted(map(tuple, mix.rake_cells(c.repartition(5), t, unit).select(*mix.AXES, "tokens", "most", "copies", "weight").collect()))
    for _, source, total in totals[:6]:
        assert sum(r[-1] for r in here if r[0] == source) == pytest.approx(total, rel=1e-6)


def test_plan_is_the_same_from_driver_and_cluster(frame, monkeypatch):
    """After any number of rounds; the smallest source has all its cells at their repeats."""
    d, t = frame(docs(), DOCS), frame([("BIG", 0.5, 2), ("mid size", 0.3, 4), ("small", 0.2, 3)], TARGETS)
    for rounds in ("ROUNDS", "CLUSTER_ROUNDS"):
        monkeypatch.setattr(mix, rounds, 3)
    here = sorted(map(tuple, mix._plan(d, t, None, mix.TOKENIZER)[1].collect()))
    monkeypatch.setattr(mix, "DRIVER_CELLS", 0)
    assert here == sorted(map(tuple, mix._plan(d, t, None, mix.TOKENIZER)[1].collect()))
