import random

import numpy as np
import pyarrow as pa
import pytest
import regex

from quarrystone.llm import leak
from tests.conftest import rows_of

DOCS = "doc_id long, text string, item_id string, letters string, lang string"
ITEMS = "item_id long, lang string, text string, doc_id long"


def letters(s):
    return regex.sub(r"[^\p{L}\p{N}\p{M}]+", "", (s or "").lower())


def brute(docs, items):
    out = set()
    for item, lang, text, *_ in items:
        run, t = 20 if lang in ("zh", "ja") else 50, letters(text)
        grams = {t[k : k + run] for k in range(len(t) - run + 1)}
        for doc, body, *_ in docs:
            s = letters(body)
            if any(s[k : k + run] in grams for k in range(len(s) - run + 1)):
                out.add((doc, item))
    return sorted(out, key=repr)


def test_index_against_sorting():
    rng = np.random.default_rng(4)
    for n in [1, 2, 3, 17, 64, 65, 300, 1000]:
        for high in (2, 4, 200):
            text = np.concatenate((rng.integers(1, high + 1, n).astype(np.uint8), [0])).astype(np.uint8)
            want = sorted(range(len(text)), key=lambda i: bytes(text[i:]))
            assert leak.suffix_order(text)[0].tolist() == want
            index = leak.FMIndex(text)
            assert index.locate(np.arange(len(text))).tolist() == want
            raw = bytes(text)
            phrases = [raw[i : i + k] for i in range(0, n, 7) for k in (1, 3, 9) if i + k <= n] + [b"\xf0\xf1"]
            table = np.zeros((len(phrases), 9), np.uint8)
            for k, p in enumerate(phrases):
                table[k, : len(p)] = np.frombuffer(p[::-1], np.uint8)
            found, begin, end = index.search(table, np.array([len(p) for p in phrases]))
            hits = {int(f): sorted(index.locate(np.arange(b, e)).tolist()) for f, b, e in zip(found, begin, end, strict=True)}
            for k, p in enumerate(phrases):
                assert hits.get(k, []) == [i for i in range(len(raw)) if raw.startswith(p, i)]


def corpus(seed=1, n=60):
    random.seed(seed)
    words = [f"{a}{b}" for a in ("lan", "mor", "tis", "vek", "оди", "漢字", "कि") for b in ("a", "o", "и", "の", "3")]
    items = [(k, random.choice(["en", "zh", "ja", None]), " ".join(random.choice(words) for _ in range(random.choice([3, 15, 40]))), 7) for k in range(12)]
    docs = []
    for k in range(n):
        text = " ".join(random.choice(words) for _ in range(60))
        if k % 3 == 0:
            i = letters(random.choice(items)[2])
            a = random.randint(0, len(i) - 1)
            part = i[a : a + random.choice([18, 19, 20, 21, 48, 49, 50, 51, 400])]
            text += " " + "".join(c.upper() + random.choice(["", "-", "\n"]) for c in part) + ", the end"
        docs.append((k, text, "i", "l", "en"))
    return docs, items


@pytest.mark.parametrize(("shard", "block", "blocks", "pairs"), [(1 << 21, 8 << 20, 4, 1 << 20), (4000, 300, 2, 5), (1 << 21, 1, 1, 1)])
def test_against_brute_force(frame, monkeypatch, shard, block, blocks, pairs):
    monkeypatch.setattr(leak, "SHARD_BYTES", shard)
    monkeypatch.setattr(leak, "ITEM_BYTES", block)
    monkeypatch.setattr(leak, "BLOCKS", blocks)
    monkeypatch.setattr(leak, "PAIRS", pairs)
    docs, items = corpus()
    docs += [(100, None, "", "", ""), (101, "", "", "", ""), (102, "...", "", "", ""), (5, docs[0][1], "", "", ""), (None, items[-1][2] * 2, "", "", "")]
    items += [(50, "en", None, 1), (51, None, "short", 1), (52, "zh", "", 1)]
    blocks = [type("B", (), {"value": b})() for b in leak.item_blocks(frame(items, ITEMS))]
    batch = pa.record_batch([[d[0] for d in docs], [letters(d[1]) for d in docs]], ["doc_id", "letters"])
    got = pa.Table.from_batches(leak._searcher(blocks)(iter([batch]))).to_pylist()
    assert sorted({(r["doc_id"], r["item_id"]) for r in got}, key=repr) == brute(docs, items)
    assert rows_of(leak.leaked_pairs(frame(docs, DOCS), frame(items, ITEMS))) == brute(docs, items)


def test_phrase_of_many_items_and_documents():
    """A phrase that everything has costs pairs, but only long runs are reported."""
    phrase = "thequickbrownfoxjumpsoverthelazydog"
    items = leak.Phrases([(k, f"{k:020d}{phrase}{k:020d}", 50) for k in range(300)])
    texts = [(k, 0, f"{k + 100:019d}x{phrase}") for k in range(300)]
    assert list(leak.shard_hits(texts, [items])) == []
    texts = [(k, 0, f"{k:020d}{phrase}") for k in range(300)]
    assert sorted(leak.shard_hits(texts, [items])) == [(k, k, 0, 55) for k in range(300)]


def test_spans_cover_the_leak(frame):
    item = "The quick brown fox jumps over the lazy dog while nine violins hum in the copper hall"
    text = f"Before it. {item.upper()}! After it."
    r = leak.removal_spans(frame([(1, text, "", "", "")], DOCS), frame([(7, "en", item, 1)], ITEMS)).first()
    assert text[r.begin_char : r.end_char] == item.upper() and r.chars_left == len("Before it. ! After it.")


def test_empty(frame):
    docs, items = corpus()
    assert leak.leaked_pairs(frame([], DOCS), frame(items, ITEMS)).count() == 0
    assert leak.leaked_pairs(frame(docs, DOCS), frame([], ITEMS)).count() == 0
    assert leak.removal_spans(frame([], DOCS), frame([], ITEMS)).count() == 0
