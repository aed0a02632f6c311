from collections import Counter

import regex

from quarrystone.llm.terms import heavy_terms, marked_terms, term_counts

SCHEMA = "row_no long, tags array<string>, body string, term string, records int, field string"


def brute(rows):
    occ, rec = Counter(), Counter()
    for _, tags, body, *_ in rows:
        found = [("tags", t.lower().strip()) for t in tags or [] if t and t.strip()]
        found += [("body", w) for w in regex.findall(r"[\p{L}\p{N}\p{M}]+", (body or "").lower())]
        occ.update(found)
        rec.update(set(found))
    return {k: (occ[k], rec[k]) for k in occ}


ROWS = [
    (1, ["Memory", " memory ", "", None, "a b"], "The the THE. don't, étude कितना 3.5 漢字、かな"),
    (2, None, None), (3, [], ""), (4, ["x"] * 3, "ΟΔΟΣ İstanbul ΑΣ. x_y"), (5, ["　x "], "x" * 100_000 + " end"), (5, ["x"], "the end"),
]


def test_against_brute_force(frame):
    rows = [(*r, "t", 1, "f") for r in ROWS]
    got = {(r.field, r.term): (r.occurrences, r.records) for r in term_counts(frame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_heavy_terms_are_exact(frame):
    rows = [(k, ["hot"] * (k % 3), f"hot hot word{k % 7} only{k}", None, None, None) for k in range(3000)]
    got = {(r.field, r.term): (r.occurrences, r.records) for r in term_counts(frame(rows, SCHEMA).repartition(5)).collect()}
    assert got == brute(rows)


def test_sample_is_bounded(frame, monkeypatch):
    monkeypatch.setattr("quarrystone.llm.terms.SAMPLE_PARTITIONS", 2)
    monkeypatch.setattr("quarrystone.llm.terms.SAMPLE_ROWS", 40)
    rows = [(k, ["Hot"] * 2, f"cold{k} often often often", None, None, None) for k in range(2000)]
    assert heavy_terms(frame(rows, SCHEMA).repartition(8).select("tags", "body")) == {"tags": ["hot"], "body": ["often"]}


def test_marks(frame):
    rows = [(k, ["all", f"t{k % 20}"], f"w{k}", None, None, None) for k in range(40)]
    got = {(r.field, r.term): r.mark for r in marked_terms(frame(rows, SCHEMA)).collect()}
    assert got["tags", "all"] == "common" and got["tags", "t3"] == "rare" and got["body", "w3"] == "rare"
    rows = [(k, [f"t{k % 10}"], "", None, None, None) for k in range(40)]
    assert {r.mark for r in marked_terms(frame(rows, SCHEMA)).collect()} == {None}


def test_empty(frame):
    assert marked_terms(frame([], SCHEMA)).count() == 0
