import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quarrystone.session import local_session

    work = tmp_path_factory.mktemp("spark")
    session = local_session(4, **{"spark.checkpoint.dir": f"file://{work}/shared", "spark.sql.warehouse.dir": f"{work}/warehouse"})
    yield session
    session.stop()


RECORD = "id string, collection string, title string, body string, fields map<string,string>, tags array<string>, metadata map<string,string>, updated_at_epoch_seconds bigint"


@pytest.fixture(scope="session")
def frame(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
