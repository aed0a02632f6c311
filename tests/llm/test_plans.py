import os
import re

import pytest

import __spark_entry__ as driver
from quarrystone.llm import terms

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def columns_read(text):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$)", text)]


@pytest.mark.parametrize(("name", "wanted"), [("p9_found", {"doc_id", "text"}), ("p1_found", {"row_no", "collection", "body"})])
def test_one_pass_over_the_columns_needed(spark, name, wanted):
    text = plan(driver.queries()[name](spark, DATA))
    assert not re.search(r"Exchange hashpartitioning|Exchange rangepartitioning|SortMergeJoin", text.split("BroadcastExchange")[0])
    assert all(c <= wanted | {"config_id", "max_chunk_bytes", "overlap_bytes", "preferred_break_characters", "array"} for c in columns_read(text))


def test_counts_are_aggregated_before_the_shuffle(spark):
    text = plan(terms.term_counts(spark.read.parquet(f"{DATA}/records.parquet")))
    assert text.index("functions=[sum") < text.index("Exchange") < text.index("functions=[partial_sum")
    assert columns_read(text) == [{"tags", "body", "array"}] or columns_read(text) == [{"tags", "body"}]
