import random

import pytest

from quarrystone.llm.split import cut_rows, limits, pieces, split_bodies
from tests.conftest import rows_of

RECORDS = "row_no long, collection string, body string, max_bytes int, text string"
CONFIGS = "config_id int, collection string, max_chunk_bytes int, overlap_bytes int, preferred_break_characters array<string>"


def check(text, limit, lap, breaks):
    got = pieces(text, limit, lap, breaks)
    back = ""
    for k, (begin, new, end) in enumerate(got):
        assert len(text[begin:end].encode()) <= limit
        assert len(text[begin:new].encode()) <= lap
        assert new == len(back) and new < end or not text
        assert k or begin == 0
        back += text[new:end]
    assert back == text
    return [text[b:e] for b, _, e in got]


def test_pieces_add_up_and_keep_limits():
    random.seed(5)
    for _ in range(150):
        alphabet = random.choice(["ab \n", "a漢字é. ", "x", "ab;.\n\n ", "é‍👩💻"])
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 3000)))
        check(text, random.choice([256, 300, 512]), random.choice([0, 16, 64, 300]), random.choice([[], ["\n", " "], [";", "\n"], ["\n\n", " "], ["", "."]]))


def test_best_boundary_comes_first():
    paragraph = "One sentence here. Another one there. " * 4
    got = check((paragraph.strip() + "\n\n") * 6, 400, 0, ["\n", " "])
    assert all(p.endswith("\n\n") for p in got[:-1])


def test_preferred_breaks_come_before_natural_ones():
    got = check("aaa bbb ccc; " * 60, 300, 0, [";"])
    assert all(p.endswith(";") for p in got[:-1])


def test_overlap_repeats_the_end_of_the_piece_before():
    text = "word " * 300
    spans = pieces(text, 256, 64, [" "])
    assert all(0 < new - begin <= 64 for begin, new, _ in spans[1:])
    assert all(text[begin - 1] == " " for begin, _, _ in spans[1:])


def test_graphemes_stay_whole():
    text = "é" * 400
    assert all(not p.startswith("́") for p in check(text, 256, 0, []))
    check("a" + "́" * 900, 256, 30, [])


@pytest.mark.parametrize("text", ["ab " + "x" * 9000, "y" * 99 + " " + "x" * 9000, "x" * 20000, "漢" * 50000])
def test_unbroken_text_ends(text):
    check(text, 8192, 64, ["\n", " ", "\t"])


def test_very_long_text():
    import time

    began = time.perf_counter()
    got = pieces("some words here. " * 300_000, 256, 64, ["\n", " "])
    assert len(got) > 20_000 and time.perf_counter() - began < 30


def test_frames(frame):
    configs = frame(
        [(1, "small", 100, -5, ["\n"]), (2, "null", None, None, None), (9, "twice", 4096, 0, []), (3, "twice", 300, 10, []), (4, None, 300, 0, [])], CONFIGS
    )
    assert {r.collection: (r.max_bytes, r.lap_bytes) for r in limits(configs).collect()} == {"small": (256, 0), "null": (8192, 64), "twice": (300, 10)}
    rows = [
        (1, "small", "a" * 256, 1, "c"), (2, "small", "a" * 257, 1, "c"), (3, "null", "b" * 8193, 1, "c"), (4, None, "b" * 9000, 1, "c"), (5, "none", None, 1, "c"),
        (6, "twice", "", 1, "c"), (7, "twice", "é" * 151, None, None), (8, "twice", "é" * 150, 1, "c"), (2, "small", "a" * 257, 1, "c"), (None, "small", "a" * 300, 1, "c"),
    ]
    found = rows_of(cut_rows(frame(rows, RECORDS), configs))
    assert found == rows_of(frame([(2,), (2,), (3,), (4,), (7,), (None,)], "n long"))
    whole = split_bodies(frame(rows, RECORDS), configs)
    assert whole.columns == ["row_no", "piece_no", "begin_char", "overlap_chars", "text"]
    assert {r.row_no for r in whole.where("row_no IN (5, 6)").collect()} == set()
    assert [r.text for r in whole.where("row_no = 1").collect()] == ["a" * 256]


def test_empty_tables(frame):
    assert split_bodies(frame([], RECORDS), frame([], CONFIGS)).count() == 0
    assert cut_rows(frame([(1, "x", "a " * 5000, 1, "")], RECORDS), frame([], CONFIGS)).count() == 1
