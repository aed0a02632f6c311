import json
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pandas as pd

from quarrystone.llm import dedup
from tests.conftest import rows_of

SCHEMA = "row_no long, title string, body string, digest string, copies int"


def letters(s):
    return "".join(c for c in (s or "").lower() if unicodedata.category(c)[0] in "LNM")


def form(body):
    body = body or ""
    try:
        if isinstance(o := json.loads(body), dict):
            return frozenset((letters(k), letters(str(v))) for k, v in o.items())
    except ValueError:
        pass
    lines = [x for x in body.split("\n") if x.strip()]
    if len(lines) >= 2 and all(re.match(r"\s*[\w-]+\s*:", x) for x in lines):
        return frozenset(tuple(map(letters, x.split(":", 1))) for x in lines)
    return letters(body)


def brute(rows):
    groups = defaultdict(list)
    for n, title, body, *_ in rows:
        groups[letters(title), form(body)].append(n)
    return sorted(((min(g), n) for g in groups.values() for n in g if n != min(g)), key=repr)


ROWS = [
    (1, "A title", "Some text, here."), (2, "a TITLE!", "some   text\nhere"), (3, "A title", "Some text hére."), (4, None, "x"), (5, "", "X!"), (6, None, None), (7, "", ""), (8, "  ", "👩"),
    (9, None, "size: 3\ncolour: red"), (10, None, "Colour:  RED\n\nsize: 3"), (11, None, '{"size": "3", "colour": "red"}'), (12, None, '{\n "colour":"red","size":"3"}  '),
    (13, None, "size: 3 colour: red"), (14, None, "size: 3\nno entry"), (15, None, "{not json}"), (16, None, "not: json"), (17, "t", "Ｘ"), (18, None, "two words: 3\nsize: 2"),
    (19, None, "size: 2\ntwo words: 3"), (20, None, "ΟΔΟΣ"), (21, None, "οδος"), (22, "A", "b"), (23, "a", "B"), (24, None, '{"a": null}'), (25, None, "{}"),
]


def test_against_brute_force(frame):
    rows = [(*r, "d", 1) for r in ROWS]
    assert rows_of(dedup.copies(frame(rows, SCHEMA))) == brute([r for r in rows if r[0] not in (24, 25)])


FIRST = '{"a": "x"}'
#: Bodies of more than one JSON object, or of one and something else; no two are copies, nor is any a form.
NOT_ONE_OBJECT = [
    FIRST + '\n{"b": "y"}', FIRST + ' {"b": "z"}', FIRST + " tail }", FIRST + ',{"b": "u"}', FIRST + '],[{"b": "v"}', FIRST + ',{"b": "w"}],[{}', FIRST + "\n\nlog: {7}",
    FIRST + ', "q": {}', FIRST + ',null,{"c": 8}',
]


def test_only_a_whole_body_is_an_object(frame):
    bodies = [FIRST, *NOT_ONE_OBJECT, '  {"A":"X"}\n']
    rows = [(k, "t", b, "d", 1) for k, b in enumerate(bodies)]
    assert rows_of(dedup.copies(frame(rows, SCHEMA))) == [(0, len(bodies) - 1)] == brute(rows)
    assert rows_of(dedup.distinct_records(frame(rows, SCHEMA))) == [(0, 2), *((k, 1) for k in range(1, len(bodies) - 1))]


def test_counts_keep_every_row(frame):
    rows = [(*r, "d", 1) for r in ROWS] * 3
    got = dedup.distinct_records(frame(rows, SCHEMA))
    assert got.agg({"copies": "sum"}).first()[0] == len(rows)
    assert {r.copies % 3 for r in got.collect()} == {0}


def test_hot_group_and_repeated_rows(frame):
    rows = [(k, "Same", "same text") if k % 3 else (k, "t", f"text number {k}") for k in range(6000)]
    found = dedup.copies(frame([(*r, "d", 1) for r in rows], SCHEMA))
    assert sorted(map(tuple, found.collect())) == [(1, k) for k in range(2, 6000) if k % 3]


def test_ranges_of_hashes(frame, monkeypatch):
    """More rows than a filter takes go through it in ranges, and no more of them are shuffled for that."""
    monkeypatch.setattr(dedup, "LEAST_BITS", 1 << 17)
    monkeypatch.setattr(dedup, "MOST_BITS", 1 << 17)
    rows = [(k, "t", f"text number {k // 2 if k % 100 == 1 else k}", "d", 1) for k in range(20_000)]
    d = frame(rows, SCHEMA)
    assert len(dedup.hash_ranges(len(rows))) == 3
    assert rows_of(dedup.copies(d)) == brute(rows)
    marked, n = dedup.marked_rows(d)
    assert marked.count() == n == len(rows)
    assert marked.where("repeat").count() < 0.1 * n
    assert dedup.distinct_records(d).agg({"copies": "sum"}).first()[0] == n


def test_ranges_cover_all_hashes():
    for rows in (0, 1, 10**9, 10**11):
        ranges = dedup.hash_ranges(rows)
        assert ranges[0][0] == -(2**63) and ranges[-1][1] == 2**63 - 1
        assert all(b + 1 == a for (_, b), (a, _) in zip(ranges, ranges[1:], strict=False))
        assert rows <= len(ranges) * (dedup.MOST_BITS // dedup.BITS_A_ROW)


def test_empty_and_nulls(frame):
    assert dedup.copies(frame([], SCHEMA)).count() == 0
    assert dedup.distinct_records(frame([(None, None, None, None, None)] * 2, SCHEMA)).collect()[0].copies == 2
    assert dedup.copies(frame([(1, "a", "x" * 500_000, "", 1), (2, "a", "X " * 500_000, "", 1)], SCHEMA)).collect() == [(1, 2)]


def test_merged_filters_miss_no_repeat():
    rng = np.random.default_rng(2)
    bits = 1 << 17
    parts = [rng.integers(-(2**62), 2**62, 500) for _ in range(4)]
    parts[3][:50] = parts[0][:50]
    parts[1][0] = parts[1][1]
    built = pd.concat(d for p in parts for d in dedup._local_filters(bits)(iter([pd.DataFrame({"h": p[:200]}), pd.DataFrame({"h": p[200:]})])))
    merged = {k: np.frombuffer(dedup.zlib.decompress(dedup._merge(g).again[0]), np.uint8) for k, g in built.groupby("segment")}
    again = np.zeros(bits // 8, np.uint8)
    for k, part in merged.items():
        again[k * dedup.SEGMENT : k * dedup.SEGMENT + len(part)] = part
    h = np.concatenate(parts)
    p, q = dedup._places(h, bits)
    may = dedup._has(again, p) & dedup._has(again, q)
    values, counts = np.unique(h, return_counts=True)
    assert may[np.isin(h, values[counts > 1])].all()
    assert may[np.isin(h, values[counts == 1])].mean() < 0.05
