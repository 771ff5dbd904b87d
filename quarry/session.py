"""Session helper for local runs, tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, app: str = "quarry", conf: dict[str, str] | None = None) -> SparkSession:
    """A local session with the settings the tests and the benchmark share.

    On a cluster, pass your own session to the operators instead: none of them creates one.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(map=conf or {"spark.sql.mapKeyDedupPolicy": "EXCEPTION"})
        .getOrCreate()
    )
