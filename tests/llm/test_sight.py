import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrystone.llm import dedup
from quarrystone.llm.sight import consistent, consistent_values, mapping, same_sight_classes, same_sight_pairs
from tests.conftest import rows_of

RECORDS = "row_no long, title string, body string, key string, form string, field string"
CHUNKS = "chunk_id long, text string, key string, raw string"

SAME = [
    ("Ｆｕｌｌ１", "Full1"), ("café", "café"), ("ofﬁce", "office"), ("a b c　d", "a b c d"), ("zero​width﻿", "zerowidth"), ("so­ft", "soft"),
    ("pаypаl", "paypal"), ("ΑΒΕ", "ABE"), ("ё", "ë"), ("ё", "ë"), ("ｶﾞ", "ガ"), ("が", "が"), ("a‍b", "ab"), ("non‑break", "non-break"), ("e​́", "é"), ("Å", "Å"), ("각", "각"),
    ("，！", ",!"), ("ﻼ", "لا"), ("Ⅳ", "IV"),
]
DIFFERENT = [("a", "A"), ("cafe", "café"), ("a b", "a  b"), ("a\tb", "a b"), ("a\nb", "a b"), ("👩‍💻", "👩💻"), ("…", "..."), ("x²", "x2"), ("“a”", '"a"'), ("①", "1"), ("a.", "a")]


# Canonically the same, and compatibility characters of the same glyph; as escapes, since editors may normalize them.
SAME_ESCAPED = [
    ("\u212b", "\u00c5"), ("\u212b", "A\u030a"), ("\u212a", "K"), ("\u2126", "\u03a9"), ("\uf900", "\u8c48"), ("\U0002f800", "\u4e3d"), ("\ufb2a", "\u05e9\u05c1"), ("\u2329\u200d\u2329", "\u3008\u3008"),
    ("\u00b5", "\u03bc"), ("\u0e33", "\u0e4d\u0e32"), ("\u0e19\u0e49\u0e33", "\u0e19\u0e4d\u0e49\u0e32"), ("\u0eb3", "\u0ecd\u0eb2"), ("\u0edc", "\u0eab\u0e99"), ("\u0587", "\u0565\u0582"), ("\u2f00", "\u4e00"),
    ("\u0675", "\u0627\u0674"), ("\u0140", "l\u00b7"), ("\u2103", "\u00b0C"), ("\u2135", "\u05d0"), ("\uffa1\uffc2", "\u3131\u314f"), ("\uffa1", "\u1100"), ("\u1100", "\u3131"), ("a\u1161", "a\u314f"), ("\u1100\u1161", "\uac00"),
]
DIFFERENT_ESCAPED = [("\u3131\u314f", "\uac00"), ("\uffa1\uffc2", "\u1100\u1161"), ("\u03d1", "\u03b8"), ("\u2116", "No"), ("\u2474", "(1)")]


@pytest.mark.parametrize(("a", "b"), SAME_ESCAPED)
def test_same_escaped(a, b):
    assert consistent(a) == consistent(b) == consistent(consistent(a))


@pytest.mark.parametrize(("a", "b"), DIFFERENT_ESCAPED)
def test_different_escaped(a, b):
    assert consistent(a) != consistent(b)


def test_every_canonical_equivalent():
    for c in (chr(i) for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000):
        assert consistent(c) == consistent(unicodedata.normalize("NFC", c)) == consistent(unicodedata.normalize("NFD", c)), hex(ord(c))


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert consistent(a) == consistent(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert consistent(a) != consistent(b)


def test_ascii_and_table_are_final():
    text = "".join(map(chr, range(128)))
    assert consistent(text) == text
    assert all(consistent(v) == v for v in mapping().values())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("аеё́̈​‍👩💻ＡｶﾞﬁΟe "))))
def test_rewriting_twice_changes_nothing(text):
    once = consistent(text)
    assert consistent(once) == once
    assert consistent(unicodedata.normalize("NFD", text)) == consistent(unicodedata.normalize("NFC", text))


@pytest.mark.parametrize("part", [20_000, 1])
def test_pairs_against_brute_force(frame, monkeypatch, part):
    monkeypatch.setattr("quarrystone.llm.sight.PART_ROWS", part)
    titles = [None, "", "Note", "Nоte", "Note", "Ｎｏｔｅ", "note", "N​ote", "Other", "Other "]
    rows = [(k, t, t and t * 2, "k", "f", "x") for k, t in enumerate(titles)]
    texts = [(k, t, "k", "r") for k, t in enumerate(["a", "а", "a", None, "", "b" * 200_000, "b" * 199_999 + "ｂ"])]
    want = []
    for field, values in (("title", [(r[0], r[1]) for r in rows]), ("body", [(r[0], r[2]) for r in rows]), ("text", [t[:2] for t in texts])):
        for a, x in values:
            for b, y in values:
                if a < b and x is not None and y is not None and x != y and consistent(x) == consistent(y):
                    want.append((field, a, b))
    got = same_sight_pairs(frame(rows, RECORDS), frame(texts, CHUNKS))
    assert rows_of(got) == sorted(want, key=repr)
    links, classes = Counter(), {}
    for field, a, b in want:
        links.update([(field, a), (field, b)])
        for k in (a, b):
            classes[field, k] = min(classes.get((field, k), k), a)
    found = {(r.field, r.key): (r.class_key, r.links) for r in same_sight_classes(frame(rows, RECORDS), frame(texts, CHUNKS)).collect()}
    assert {k: v[1] for k, v in found.items()} == dict(links)
    assert found["title", 7] == (2, 4) == found["title", 3] and found["title", 2] == (2, 3)
    assert consistent_values(frame(rows, RECORDS), frame(texts, CHUNKS)).where("key = 5 AND field = 'title'").first().form == "Note"


def test_spread_groups(frame, monkeypatch):
    monkeypatch.setattr("quarrystone.llm.sight.PART_ROWS", 50)
    rows = [(k, "Common" if k % 40 else "Cоmmon", None, "", "", "") for k in range(400)]
    assert same_sight_pairs(frame(rows, RECORDS), frame([], CHUNKS)).count() == 10 * 390


# What shows nothing, wherever it stands, and what shows something although it is much like it; as escapes.
UNSEEN = ["\u034f", "\u061c", "\u180e", "\u202b", "\u2066", "\ufe0f", "\u2064", "\U000e0041", "\U000e0100", "\ufff0"]
LOOK_ALIKE = [("\u03bd\u03c1\u03c5\u03b9", "vpui"), ("\u0585", "o"), ("\u13aa", "A"), ("\ua4ee", "A"), ("\U0001d400", "A"), ("\U0001d7d9", "1"), ("\u210c", "H"), ("\u03ac", "\u00e1"), ("\u3164", " "), ("\uffa0", "\u3000")]


@pytest.mark.parametrize("c", UNSEEN)
def test_unseen(c):
    assert consistent(f"a{c}b") == "ab" and consistent(f"e{c}\u0301") == "\u00e9" and consistent(c) == ""


@pytest.mark.parametrize(("a", "b"), LOOK_ALIKE)
def test_look_alike(a, b):
    assert consistent(a) == consistent(b)


def test_emoji_stay():
    for x in ("\u2764\ufe0f", "#\ufe0f\u20e3", "\U0001f3f4\U000e0067\U000e0062\U000e007f", "\U0001f469\u200d\U0001f680", "\u202eabc"):
        assert consistent(x) == x
    assert consistent("\u2764\ufe0f") != consistent("\u2764")


def test_filter_keeps_its_own(frame):
    h = frame([(k * 7919,) for k in range(5000)], "h long")
    bits, size = dedup.member_filter(h)
    held = h.sparkSession.sparkContext.broadcast(bits)
    assert h.where(dedup.may_hold(held, size)("h")).count() == 5000
    assert frame([(-k,) for k in range(1, 5001)], "h long").where(dedup.may_hold(held, size)("h")).count() < 500
    assert dedup.member_filter(h.where("h < 0"))[1] == dedup.LEAST_BITS


def test_empty(frame):
    assert same_sight_classes(frame([], RECORDS), frame([], CHUNKS)).count() == 0
    assert same_sight_pairs(frame([], RECORDS), frame([], CHUNKS)).count() == 0
