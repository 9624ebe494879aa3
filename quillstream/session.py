"""One way to make a session for tests, the bench and notebooks. A cluster's own session is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, app: str = "quillstream", memory: str | None = None) -> SparkSession:
    """A local session in UTC, with adaptive execution and as many shuffle partitions as cores."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    # Half of what the machine has: the rest is for Python.
    memory = memory or f"{max(2, os.sysconf('SC_PAGE_SIZE') * os.sysconf('SC_PHYS_PAGES') >> 31)}g"
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """A test table of a scale's folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
