import importlib.util
import os

import pytest

import __spark_entry__ as driver

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    got = driver.queries()[name](spark, DATA)
    cursor = con.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    clean = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(clean, got.select(*columns).collect()), key=repr) == sorted(map(clean, cursor.fetchall()), key=repr)


def test_core_does_not_need_the_subpackage():
    root = os.path.dirname(os.path.abspath(driver.__file__))
    for folder, _, names in os.walk(os.path.join(root, "quarrystone")):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert "quarrystone.llm" not in f.read(), n
    assert importlib.util.find_spec("quarrystone.plans.registry")
