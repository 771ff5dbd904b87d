"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own_folder: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is spark.checkpoint.dir; where it is unset (one local machine) a temporary one of the process stands in.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append(f"file://{tempfile.mkdtemp(prefix='quarry-')}")
        folder = _own_folder[0]
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "round") -> DataFrame:
    """The rows of df, written once and read back, so that a loop's plan stays short and lost executors cost no rounds.

    The table stays in the shared folder: the frame that is returned reads it whenever it is used.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
