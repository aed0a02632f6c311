from collections import defaultdict
from datetime import datetime

from __spark_entry__ import queries
from quarrystone.config import ChunkingConfig
from quarrystone.operators.records import chunk_text
from tests.conftest import RECORD, rows_of

FEED = f"delivery_id long, arrived_at timestamp, op string, {RECORD}"
CHUNK = "chunk_id bigint, record_id string, collection string, field string, ordinal int, updated_at_epoch_seconds bigint, text string, tags array<string>, metadata map<string,string>"
LONG = "A sentence of some length. " * 2000


def brute(base, feed):
    """base and feed: rows as dicts."""
    last = {}
    for r in sorted(feed, key=lambda r: (r["arrived_at"], r["delivery_id"])):
        last[r["collection"], r["id"]] = r
    out = [(c["record_id"], c["collection"], c["field"], c["text"]) for c in base if (c["collection"], c["record_id"]) not in last]
    for r in last.values():
        for field, text in {"title": r["title"], "body": r["body"], **(r["fields"] or {})}.items():
            if r["op"] == "upsert" and text:
                out += [(r["id"], r["collection"], field, x) for x in chunk_text(text, ChunkingConfig())]
    return sorted(out, key=repr)


def test_last_operation_decides_and_texts_are_cut(spark, frame, tmp_path):
    changes = [  # key, then (op, time, text)
        ("gone", [("upsert", 1, "one"), ("delete", 2, None)]), ("only_deleted", [("delete", 1, None)]), ("back", [("delete", 1, None), ("upsert", 2, "again")]),
        ("tie", [("upsert", 5, "a"), ("delete", 5, None)]), ("long", [("upsert", 1, LONG)]), ("late", [("delete", 9, None), ("upsert", 3, "earlier")]),
    ]
    stamp = lambda t: datetime(2026, 1, 1, 0, t)
    feed, n = [], 0
    for key, ops in changes:
        for op, t, text in ops:
            n += 1
            feed.append((n, stamp(t), op, key, "c", None, text, {"note": "x"}, None, None, t))
    base = [(k, key, c, "body", 0, 0, f"base {key}", None, None) for k, (key, c) in enumerate([("kept", "c"), ("gone", "c"), ("only_deleted", "c"), ("only_deleted", "other"), ("back", "c"), ("tie", "c"), ("late", "c")])]
    frame(feed, FEED).write.parquet(f"{tmp_path}/record_feed.parquet")
    frame(base, CHUNK).write.parquet(f"{tmp_path}/chunks.parquet")
    got = rows_of(queries()["active_set"](spark, str(tmp_path)))
    names = lambda schema: [c.split()[0] for c in schema.split(", ")]
    assert got == brute([dict(zip(names(CHUNK), r)) for r in base], [dict(zip(names(FEED), r)) for r in feed])
    assert {r[:2] for r in got} == {("kept", "c"), ("only_deleted", "other"), ("back", "c"), ("long", "c")}
    assert max(len(r[3].encode()) for r in got) <= ChunkingConfig().max_chunk_bytes < len(LONG)


def test_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = defaultdict(list)
    for t in ("chunks", "record_feed"):
        rows[t] = [r.asDict() for r in spark.read.parquet(f"{d}/{t}.parquet").collect()]
    assert rows_of(queries()["active_set"](spark, d)) == brute(rows["chunks"], rows["record_feed"])
