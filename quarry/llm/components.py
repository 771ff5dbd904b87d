"""Connected components of a graph too large for one machine, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common


def _summary(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hooks the larger (or smaller) neighbours of each node, and the node, to the least of them."""
    if small:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        out = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        out = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge (u, v: long), as a table: the least node that can be reached.

    Each round's edges are written to the shared folder in place of the last; only a count and a
    checksum of them reach the driver. Self loops are ignored; an empty graph gives no rows.
    """
    now = common.write_table(edges.where("u <> v").select("u", "v").distinct(), "edges")
    spark = edges.sparkSession

    def read(path: str) -> DataFrame:
        return spark.read.schema("u long, v long").parquet(path)

    state = _summary(read(now))
    while state[0]:
        before, now = now, common.write_table(_star(_star(read(now), small=False), small=True), "edges")
        common.delete_table(spark, before)
        after = _summary(read(now))
        if after == state:
            break
        state = after
    return read(now).select(F.col("u").alias("node"), F.col("v").alias("root"))
