"""A session for local runs; on a cluster the session is the caller's."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, **conf: str) -> SparkSession:
    n = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    settings = {
        "spark.master": f"local[{n}]",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
