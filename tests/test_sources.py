import sqlite3

import pytest

from quarrystone.config import EngineError
from quarrystone.sources.crawl import has_nul, relative_to
from quarrystone.sources.providers import CallableProvider, TableProvider, records_frame
from quarrystone.sources.sqlite import SQLiteProvider, as_text, read_sqlite


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE notes (id INTEGER, title TEXT, body TEXT, weight REAL, raw BLOB)")
        con.executemany("INSERT INTO notes VALUES (?, ?, ?, ?, ?)", [(k, f"t{k}" if k % 2 else None, f"body {k}", k / 2, b"\xff" if k else b"ok") for k in range(10)])
    return path


def test_sqlite(spark, database):
    df = read_sqlite(spark, database, "SELECT * FROM notes ORDER BY id")
    assert dict(df.dtypes) == {"id": "bigint", "title": "string", "body": "string", "weight": "double", "raw": "binary"} and df.count() == 10
    assert read_sqlite(spark, database, "SELECT * FROM notes", partition_column="id", partitions="4").agg({"id": "sum"}).first()[0] == 45
    assert [r.raw for r in read_sqlite(spark, database, "SELECT raw FROM notes WHERE id < 2 ORDER BY id", "raw string").collect()] == ["ok", None]
    assert read_sqlite(spark, database, "SELECT id FROM notes WHERE id > 99").count() == 0
    records = SQLiteProvider(database, "SELECT * FROM notes", {"id": "cast(id AS string)", "collection": "'db'", "metadata": "map('w', cast(weight AS string))"}).load(spark)
    assert records.where("id = '3'").first().metadata == {"w": "1.5"} and records.count() == 10
    assert (as_text(b"\xff"), as_text(b"a"), as_text(1), as_text(None)) == (None, "a", "1", None)
    with pytest.raises((EngineError, Exception)):
        read_sqlite(spark, database, "SELECT nothing FROM nowhere").count()


def test_providers(spark, frame):
    assert CallableProvider(lambda s: [dict(id="a", collection="c")]).load(spark).first().body == ""
    assert CallableProvider(lambda s: records_frame(s, [])).load(spark).count() == 0
    got = TableProvider(lambda s: s.range(3), {"id": "cast(id AS string)", "collection": "'numbers'", "body": "concat('number ', id)"}).load(spark)
    assert [r.body for r in got.orderBy("id").collect()] == ["number 0", "number 1", "number 2"] and got.first().tags == []


def test_columns_of_files(frame):
    df = frame([("/r/a", b"ab\0"), ("/rx/b", b"x" * 10 + b"\0"), ("/r/c/d", None)], "p string, c binary")
    assert [r[0] for r in df.select(relative_to(df.p, "/r")).collect()] == ["a", "b", "c/d"]
    assert [r[0] for r in df.select(has_nul(df.c, 5)).collect()] == [True, False, None]
