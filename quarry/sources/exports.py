"""Exports and imports: graphs as JSON lines, subtrees with new ids, documentation bundles, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import entities


def export_graph(components: DataFrame, edges: DataFrame, folder: str) -> None:
    """Components and edges as JSON lines below a folder."""
    components.write.mode("overwrite").json(f"{folder}/components")
    edges.write.mode("overwrite").json(f"{folder}/edges")


def import_graph(spark: SparkSession, folder: str, components_schema, edges_schema) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(components_schema).json(f"{folder}/components"), spark.read.schema(edges_schema).json(f"{folder}/edges")


def export_subtree(rows: DataFrame, root: str) -> DataFrame:
    """A root and all below it, parents first by depth."""
    return entities.subtree(rows, root)


def _new_id(prefix: str, id_: Column, batch: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit(batch + "/"), id_), 256), 1, 16))


def import_subtree(old: DataFrame, exported: DataFrame, batch: str, merge: str = "skip", prefix: str = "imp_") -> DataFrame:
    """Old rows with an exported subtree (id, parent_id, title, depth, ...) under new ids.

    Rows are matched level by level on title and (new) parent: skip keeps the old row, overwrite
    takes the new one's values under the old id, duplicate always adds. Children follow their
    parent's id.
    """
    if merge not in ("skip", "overwrite", "duplicate"):
        raise ValueError(f"unknown merge strategy {merge!r}")
    depths = [r["depth"] for r in exported.select("depth").distinct().orderBy("depth").collect()]
    columns = old.columns
    ids: DataFrame | None = None
    added, replaced = None, None
    for depth in depths:
        level = exported.where(F.col("depth") == depth).withColumn("old_id", F.col("id"))
        if ids is None:
            level = level.withColumn("parent_id", F.lit(None).cast("string"))
        else:
            level = level.join(ids.select(F.col("from_id").alias("parent_id"), F.col("to_id").alias("new_parent")), "parent_id", "left").withColumn("parent_id", F.col("new_parent")).drop("new_parent")
        there = old.groupBy("title", "parent_id").agg(F.min("id").alias("match"))
        met = level.alias("l").join(there.alias("t"), (F.col("l.title") == F.col("t.title")) & F.col("l.parent_id").eqNullSafe(F.col("t.parent_id")), "left").select("l.*", F.col("t.match").alias("match"))
        target = _new_id(prefix, F.col("old_id"), batch) if merge == "duplicate" else F.coalesce("match", _new_id(prefix, F.col("old_id"), batch))
        named = met.withColumn("to_id", target)
        mapping = named.select(F.col("old_id").alias("from_id"), "to_id")
        ids = mapping if ids is None else ids.unionByName(mapping)
        fresh = named if merge == "duplicate" else named.where("match IS NULL")
        rows = fresh.withColumn("id", F.col("to_id")).select(*columns)
        added = rows if added is None else added.unionByName(rows)
        if merge == "overwrite":
            over = named.where("match IS NOT NULL").withColumn("id", F.col("to_id")).select(*columns)
            replaced = over if replaced is None else replaced.unionByName(over)
    base = old if replaced is None else old.join(replaced.select("id"), "id", "left_anti").select(*columns).unionByName(replaced)
    return base if added is None else base.unionByName(added)


def attached(bundles: dict[str, DataFrame]) -> DataFrame:
    """Documents of several bundles as one frame with `bundle_id`; a bundle is detached by leaving it out."""
    out = None
    for name, docs in bundles.items():
        part = docs.withColumn("bundle_id", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def library_id(names: DataFrame, asked: str) -> DataFrame:
    """(bundle_id) of the library of a name: equal, else the first that holds it."""
    low = asked.lower()
    rank = F.when(F.lower("name") == low, 0).when(F.contains(F.lower("name"), F.lit(low)), 1)
    return names.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "name", "bundle_id").limit(1).select("bundle_id")


def sections(docs: DataFrame) -> DataFrame:
    """Sections of each bundle by type, the most frequent first."""
    return docs.groupBy("bundle_id", "section_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bundle_id", "section_type")


def export_snapshot(frames: dict[str, DataFrame], folder: str) -> None:
    """Configuration frames as JSON lines, one folder each."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").json(f"{folder}/{name}")


def import_snapshot(spark: SparkSession, folder: str, schemas: dict[str, object]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{folder}/{name}") for name, schema in schemas.items()}
