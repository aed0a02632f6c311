import random

import numpy as np
import pytest

from quarrystone.operators import snapshots
from tests.conftest import RECORD, rows_of

SCHEMA = f"snapshot_no int, taken_at timestamp, {RECORD}, digest string, key int, later int"


def brute(rows):
    def content(r):
        return (r[4] or "", r[5], frozenset((r[6] or {}).items()), frozenset(r[7] or []), frozenset((r[8] or {}).items()))

    now = {}
    for r in rows:
        if r[0] is None:
            continue
        k = (r[0], r[3], r[2])
        if k not in now or (r[9] is not None, r[9] or 0) > (now[k][0] is not None, now[k][0] or 0):
            now[k] = (r[9], content(r))
    numbers, out = sorted({k[0] for k in now}), []
    for a, b in zip(numbers, numbers[1:], strict=False):
        before, after = ({k[1:]: v[1] for k, v in now.items() if k[0] == n} for n in (a, b))
        for k in before.keys() | after.keys():
            if before.get(k) != after.get(k):
                out.append((b, *k, "added" if k not in before else "removed" if k not in after else "changed"))
    return sorted(out, key=repr)


def made(n=400, seed=3):
    random.seed(seed)
    rows = []
    for s in (1, 2, 5):
        for k in range(n):
            if random.random() < 0.05:
                continue
            body = f"body {k}" if random.random() < 0.9 else f"body {k} of {s}"
            tags = random.sample(["a", "b", "c"], 2)
            row = (s, None, f"id{k}", "m" if k % 3 else "n", None if k % 2 else "", body, {"x": "1", "y": None}, tags if k % 5 else tags * 2, None if k % 7 else {}, 100 + s * (k % 2), "d", 1, 1)
            rows += [row] * random.choice([1, 1, 1, 2, 5])
            if random.random() < 0.2:
                rows.append((*row[:5], "outdated", *row[6:9], 50, *row[10:]))
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [100_000, 0])
def test_against_brute_force(frame, monkeypatch, most):
    monkeypatch.setattr(snapshots, "BROADCAST_ROWS", most)
    rows = made()
    rows += [(2, None, None, None, None, None, None, None, None, None, None, None, None), (None, None, "id1", "m", "t", "b", None, None, None, 1, None, None, None)]
    assert rows_of(snapshots.snapshot_changes(frame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize(("cells", "rounds"), [(2, 6), (1, 1)])
def test_buckets_are_enlarged_until_all_is_told(frame, monkeypatch, cells, rounds):
    monkeypatch.setattr(snapshots, "CELLS", cells)
    monkeypatch.setattr(snapshots, "ROUNDS", rounds)
    rows = made(150, 8)
    assert rows_of(snapshots.snapshot_changes(frame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("held", [10, 2_000_000])
def test_many_buckets_and_sample(frame, monkeypatch, held):
    monkeypatch.setattr(snapshots, "BUCKET_ROWS", 8)
    monkeypatch.setattr(snapshots, "SAMPLED", 100)
    monkeypatch.setattr(snapshots, "HELD", held)
    rows = made(600, 5)
    assert rows_of(snapshots.snapshot_changes(frame(rows, SCHEMA))) == brute(rows)


def test_hot_key_and_equal_snapshots(frame):
    row = (1, None, "hot", "m", "t", "b", {}, [], {}, 5, "", 0, 0)
    rows = [row] * 500 + [(2, *row[1:])] * 300 + [(3, *row[1:5], "new", *row[6:])] * 2 + [(3, *row[1:])]
    got = rows_of(snapshots.snapshot_changes(frame([r if r[5] != "new" else (*r[:9], 9, *r[10:]) for r in rows], SCHEMA)))
    assert got == [(3, "m", "hot", "changed")]


def test_empty_and_single(frame):
    assert snapshots.snapshot_changes(frame([], SCHEMA)).count() == 0
    assert snapshots.snapshot_changes(frame(made(20)[:5], SCHEMA).where("snapshot_no = 1")).count() == 0


def test_check_word_is_the_engines_hash(frame):
    r = frame([(1, 2), (-5, 2**62)], "a long, b long").selectExpr("a", "b", "xxhash64(a, b) & 65535 AS h").collect()
    got = snapshots.check_word(np.array([x.a for x in r]).astype(np.uint64), np.array([x.b for x in r]).astype(np.uint64))
    assert got.tolist() == [x.h for x in r]


def made_table(key, row, n, cells, buckets):
    at = snapshots.places(row, cells) + (np.arange(3) * cells)[:, None] + (key % np.uint64(buckets)).astype(np.int64) * 3 * cells
    t = [np.zeros(3 * cells * buckets, np.int64), *(np.zeros(3 * cells * buckets, np.uint64) for _ in range(3))]
    for sums, each in zip(t, (np.ones(len(n), np.int64), key, row, snapshots.check_word(key, row)), strict=True):
        np.add.at(sums, at.ravel(), np.tile(each * n.astype(each.dtype), 3))
    return t


def test_peel():
    rng = np.random.default_rng(1)
    key, row = rng.integers(0, 2**48, 400).astype(np.uint64), rng.integers(0, 2**56, 400).astype(np.uint64)
    n = rng.choice([-3, -1, 1, 2, 255, 256, -1000, 10**9 + 1], 400)
    keys, counts, failed = snapshots.peel(*made_table(key, row, n, 64, 4), 64, 4)
    assert not len(failed) and sorted(zip(keys.tolist(), counts.tolist(), strict=True)) == sorted(zip(key.tolist(), n.tolist(), strict=True))
    _, _, failed = snapshots.peel(*made_table(key, row, n, 4, 4), 4, 4)
    assert failed.tolist() == [0, 1, 2, 3]
    keys, _, failed = snapshots.peel(*made_table(key[:0], row[:0], n[:0], 4, 4), 4, 4)
    assert not len(keys) and not len(failed)
    _, _, failed = snapshots.peel(*made_table(key[:1], row[:1], np.array([1 << 20]), 64, 1), 64, 1)
    assert failed.tolist() == [0]  # so many copies cannot be divided; the bucket's keys are all compared


def test_cells_pack():
    rng = np.random.default_rng(2)
    at = np.sort(rng.choice(10**6, 500, replace=False)) + 77
    sums = [rng.integers(0, 2**63, 500).astype(np.uint64) & m for m in (snapshots._mask(56), snapshots._mask(64), snapshots._mask(16))]
    c = snapshots.Cells(at, rng.integers(-5, 10**12, 500), *sums)
    back = snapshots.Cells.unpacked(c.packed(77))
    assert (back.at + 77 == c.at).all() and all((getattr(back, f) == getattr(c, f)).all() for f in ("n", "key", "row", "check"))
    twice = snapshots.Cells.joined([c, c]).summed()
    assert (twice.n == 2 * c.n).all() and (twice.at == c.at).all()
    assert not len(snapshots.Cells.none().summed().at)
