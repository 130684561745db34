from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

from tabulith.session import tune


def local_session(cpus: str | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    # One machine only: its temporary folder can stand for the shared one.
    shared = os.environ.get("TABULITH_SHARED") or tempfile.mkdtemp(prefix="tabulith-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tabulith")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
