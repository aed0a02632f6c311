import re

import pytest

from quarrystone.config import FileQuery, Mode, RecordQuery
from quarrystone.functions import matching
from quarrystone.operators import baselines, files, grams, records, search
from tests.conftest import RECORD, rows_of

CHUNK = records.CHUNK_SCHEMA
TEXTS = ["Sparse indexing helps", "sparse sparse SPARSE", "", None, "Straße ÉTÉ été", "a.b a+b", "x\\Ey", "  padded match  ", "z" * 300 + "needle" + "y" * 300, "Search1Engine SearchZZEngine"]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(k, f"r{k % 4}", "notes" if k % 2 else "messages", "body", 0, 10 * k, t, ["memory"] if k % 3 else ["Memory", "x"], {"a": "b"}) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, CHUNK).cache()


@pytest.mark.parametrize(
    ("text", "mode", "smart"),
    [("sparse", "literal", True), ("Sparse", "literal", True), ("a.b", "literal", False), ("été", "literal", True), ("x\\Ey", "literal", False), ("needle", "literal", False), ("", "literal", False), ("[sS]parse", "regex", False), ("search[0-9]+", "regex", True), ("Search[0-9]+Engine", "regex", True), ("absent", "literal", True)],
)
@pytest.mark.parametrize("strategy", ["scan", "indexed"])
def test_search_against_brute_force(chunks, text, mode, smart, strategy):
    q = RecordQuery(text, mode=mode, smart_case=smart, max_results=5)
    insensitive = smart and not any(c.isupper() for c in text)
    p = re.compile(text if mode == "regex" else re.escape(text), re.I if insensitive else 0)
    want = []
    for k, t in enumerate(TEXTS):
        found = [m for m in p.finditer(t or "")] if text else []
        if found:
            m = found[0]
            want.append((len(found) * 1000 + 10 * k / 1e6, k, (t[max(0, m.start() - 80) : m.end() + 120]).strip(), len(found)))
    want.sort(key=lambda x: (-x[0], x[1]))
    entries = grams.postings(chunks) if strategy == "indexed" else None
    got = [(r.score, r.chunk_id, r.excerpt, r.match_count) for r in search.hits(chunks, q, entries).collect()]
    assert got == [(pytest.approx(a), b, c, d) for a, b, c, d in want[:5]]
    report = search.report(chunks, q, entries).first()
    assert report.total_match_count == sum(w[3] for w in want)
    assert report.matched_record_count == len({w[1] % 4 for w in want})
    assert report.candidate_chunk_count >= len(want)


def test_filters(chunks):
    ids = lambda **k: {r.chunk_id for r in search.hits(chunks, RecordQuery("e", max_results=99, **k)).collect()}
    everything = ids()
    assert ids(collections=("notes",)) == {k for k in everything if k % 2}
    assert ids(required_tags=("memory",)) == {k for k in everything if k % 3}
    assert ids(required_tags=("x", "Memory")) == {k for k in everything if k % 3 == 0}
    assert ids(fields=("title",)) == set()
    assert RecordQuery("x", max_results=-3).max_results == 1


def test_plan_of_a_scan_pushes_down(chunks, tmp_path, spark):
    chunks.write.parquet(str(tmp_path / "c"))
    df = search.verified(spark.read.parquet(str(tmp_path / "c")), search.compiled(RecordQuery("Sparse", collections=("notes",)))).select("chunk_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(text,Sparse)" in plan and "EqualTo(collection,notes)" in plan and "Exchange" not in plan
    assert "metadata" not in plan.split("ReadSchema")[1]


def test_match_spans(frame):
    df = frame([("aXbXXc",), ("",), (None,), ("no",), ("\u0001X\u0002",)], "t string")
    spans = [r[0] and [tuple(x) for x in r[0]] for r in df.select(matching.match_spans(df.t, "X", True, False)).collect()]
    assert spans == [[(1, 1), (3, 1), (4, 1)], [], None, [], [(1, 1)]]
    assert [tuple(x) for x in df.limit(1).select(matching.match_spans(df.t, "x+", False, True)).first()[0]] == [(1, 1), (3, 2)]


FILES = [(0, "a/One.swift", "struct Engine {\n  let x = 1\n}"), (1, "b/two.txt", "Engine Engine\n\nengine\r\nlast Engine"), (2, "README", "nothing"), (3, "c.TXT", "Engine"), (4, "d.txt", "")]


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame(FILES, "doc_id long, relative_path string, text string")


def test_file_search(tree):
    s = files.search_files(tree, "Engine", FileQuery(literal=True, context_lines=1))
    got = [(r.doc_id, r.match_no, r.line, r.column, r.excerpt, r.match_length) for r in s.matches().collect()]
    assert got == [(0, 0, 1, 8, "struct Engine {", 6), (1, 0, 1, 1, "Engine Engine", 6), (1, 1, 1, 8, "Engine Engine", 6), (1, 2, 4, 6, "last Engine", 6), (3, 0, 1, 1, "Engine", 6)]
    assert [x.line for x in s.matches().where("doc_id = 1 AND match_no = 2").first().context_before] == [3]
    assert tuple(s.report().first()) == (5, 3, 5)


@pytest.mark.parametrize(
    ("options", "counts", "matches"),
    [
        ({"max_count_per_file": 1}, {0: 1, 1: 1, 3: 1}, 3), ({"files_only": True}, {0: 1, 1: 1, 3: 1}, 3), ({"count_matches": True}, {0: 1, 1: 3, 3: 1}, 0), ({"quiet": True}, {0: 1}, 0),
        ({"max_results": 2}, {0: 1, 1: 3, 3: 1}, 2), ({"max_results": -1}, {0: 1, 1: 3, 3: 1}, 0), ({"max_results": None}, {0: 1, 1: 3, 3: 1}, 5), ({"case_insensitive": True}, {0: 1, 1: 4, 3: 1}, 6),
        ({"file_type": ".txt"}, {1: 3, 3: 1}, 4), ({"glob": "*.txt"}, {1: 3}, 3), ({"glob": "[z-a]"}, {0: 1, 1: 3, 3: 1}, 5), ({"glob": "a/*"}, {0: 1}, 1),
    ],
)
def test_file_options(tree, options, counts, matches):
    s = files.search_files(tree, "Engine", FileQuery(literal=True, **options))
    assert {r.doc_id: r.match_count for r in s.counts().collect()} == counts
    assert s.matches().count() == matches


def test_matches_across_lines(tree):
    s = files.search_files(tree, r"\{\n\s+let", FileQuery(context_lines=9))
    r = s.matches().first()
    assert (r.line, r.column, r.excerpt, r.match_length) == (1, 15, "struct Engine {", 7)
    with pytest.raises(ValueError, match="max_count_per_file"):
        FileQuery(max_count_per_file=0)


def test_changed_files(frame):
    schema = "relative_path string, byte_count long, modified_at_epoch_seconds long"
    a, b = frame([("x", 1, 1), ("y", 1, 1), ("z", 1, 1), ("w", 1, 1)], schema), frame([("x", 1, 1), ("y", 2, 1), ("z", 1, 2), ("v", 1, 1)], schema)
    assert rows_of(files.changed_files(a, b)) == [("v", "new"), ("w", "deleted"), ("y", "changed"), ("z", "changed")]


def test_baselines_agree(frame):
    rows = [("1", "m", "SearchEngine memory", "text", {"s": "SearchEngine"}, ["Memory"], {}, 1), ("2", "n", None, "searchengine café", {}, [], {}, 1), ("2", "m", "", "no", None, None, None, 1)]
    df = frame(rows, RECORD)
    n = lambda f, q: f(df, q).first()[0]
    q = RecordQuery("SearchEngine")
    assert [n(f, q) for f in baselines.ENGINES.values()] == [2, 1, 1, 1]
    assert n(baselines.contains_like, RecordQuery("CAFE", case_insensitive=True)) == 1
    assert n(baselines.trigram_phrase, RecordQuery("se")) == 0
    assert n(baselines.wildcard, RecordQuery("search", required_tags=("memory",))) == 1
    got = {r.engine: r.available for r in baselines.compare(df, RecordQuery("a.b", mode=Mode.REGEX)).collect()}
    assert got == {"trigram_phrase": False, "contains": False, "wildcard": False, "scan": True}
