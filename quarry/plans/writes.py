"""Queries of budgets, best rows and keyed writes: ties, nulls, repeated keys, and one group over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import context, ordered
from quarry.operators import entities as ops
from quarry.plans.registry import query
from quarry.sources.keyed import KeyedTable
from quarry.sources.tables import table
from quarry.sources.written import shared_path


def _greedy(rows: str, budget: int) -> str:
    """SQL of a greedy walk over rows (id, size, k from 1)."""
    return f"""WITH RECURSIVE c AS ({rows}), w AS (SELECT 0::bigint AS k, 0::bigint AS used, NULL::bigint AS kept
      UNION ALL SELECT c.k, CASE WHEN used + size <= {budget} THEN used + size ELSE used END, CASE WHEN used + size <= {budget} THEN c.id END FROM w JOIN c ON c.k = w.k + 1)"""


@query("budget_of_one_group", _greedy("SELECT doc_id AS id, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE n_chars END AS size, row_number() OVER (ORDER BY CASE WHEN doc_id % 5 > 0 THEN n_chars % 20 END NULLS LAST, doc_id) AS k FROM documents", 60_000) + " SELECT kept AS id FROM w WHERE kept IS NOT NULL")
def budget_of_one_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table is one group: by rounds, with null keys and null sizes."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 > 0, F.col("n_chars") % 20).alias("k"), F.when(F.col("doc_id") % 17 > 0, F.col("n_chars")).alias("size"))
    return ordered.within_budget(rows, [], ["k", "id"], "size", 60_000, folded=100).select("id")


@query("context_packed", _greedy("SELECT p_partkey AS id, ceil(length(p_name) * 1.2::double / 3.5::double)::bigint AS size, row_number() OVER (ORDER BY CASE p_size % 4 WHEN 0 THEN 10 WHEN 1 THEN 8 WHEN 2 THEN 3 ELSE 2 END DESC, CASE WHEN p_partkey % 7 > 0 THEN p_retailprice END DESC NULLS LAST, lpad(p_partkey::varchar, 9, '0')) AS k FROM part", 700) + " SELECT lpad(kept::varchar, 9, '0') AS id FROM w WHERE kept IS NOT NULL")
def context_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by type and score, some without one, as many as fit."""
    kind = F.when(F.col("p_size") % 4 == 0, "class").when(F.col("p_size") % 4 == 1, "function").when(F.col("p_size") % 4 == 2, "file").otherwise("other")
    items = table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("id"), kind.alias("type"), F.col("p_name").alias("content"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_retailprice")).alias("score"))
    edges = items.limit(0).select(F.col("id").alias("src"), F.col("id").alias("dst"), "type")
    return context.packed(context.Context(items, edges), 700).items.select("id")


@query("best_of_many_ties", "SELECT p_partkey AS id FROM (SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_partkey % 9 > 0 THEN p_size END DESC NULLS LAST, p_partkey) AS k, count(*) OVER () AS n FROM part) WHERE k <= ceil(n * 0.3)")
def best_of_many_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of 50 values: the last ones are told apart by their keys."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 9 > 0, F.col("p_size")).alias("score"))
    return ops.retained(rows, "score", 1000, 0.3).select("id")


@query("embeddings_upserted", """WITH old AS (SELECT vec_id AS id, unnest(['component', 'task']) AS type, label AS v FROM embeddings),
    b AS (SELECT vec_id + 3 AS id, 'task' AS type, label + 100 AS v FROM embeddings WHERE vec_id % 4 = 0)
    SELECT coalesce(b.id, old.id) AS id, coalesce(b.type, old.type) AS type, coalesce(b.v, old.v) AS v FROM old FULL JOIN b ON old.id = b.id AND old.type = b.type""")
def embeddings_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By (id, type): of a key's rows the first in order counts, those without an order come last."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("v"))
    old = rows.select("id", F.explode(F.array(F.lit("component"), F.lit("task"))).alias("type"), "v", F.lit(0).alias("at"))
    again = rows.where("id % 4 = 0").select((F.col("id") + 3).alias("id"), F.lit("task").alias("type"), F.explode(F.array(F.struct((F.col("v") + 100).alias("v"), F.lit(1).alias("at")), F.struct((F.col("v") + 200).alias("v"), F.lit(None).cast("int").alias("at")), F.struct((F.col("v") + 300).alias("v"), F.lit(2).alias("at")))).alias("x"))
    return ops.upserted(old, again.select("id", "type", "x.*"), ["id", "type"], "at").select("id", "type", "v")


@query("edges_upserted", """WITH b AS (SELECT l_orderkey AS src, l_partkey AS dst, arg_min(l_suppkey::varchar, (l_linenumber, l_suppkey::varchar)) AS mode FROM lineitem WHERE l_quantity > 30 GROUP BY ALL),
    o AS (SELECT l_orderkey AS src, l_partkey AS dst, arg_min(l_returnflag, (l_linenumber, l_returnflag)) AS flag FROM lineitem GROUP BY ALL)
    SELECT src, dst, 'flag=' || flag || coalesce(',mode=' || mode, '') AS metadata FROM o LEFT JOIN b USING (src, dst)""")
def edges_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata is merged, new keys beside the old ones."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("at"), "l_returnflag", F.col("l_suppkey").cast("string").alias("supplier"), "l_quantity")
    edge = lambda rows, key, value: rows.select("src", "dst", F.create_map(F.lit(key), F.col(value)).alias("metadata"), "at")
    old = ops.upserted(edge(lines.limit(0), "flag", "l_returnflag"), edge(lines, "flag", "l_returnflag"), ["src", "dst"], "at")
    new = ops.upserted(old, edge(lines.where("l_quantity > 30"), "mode", "supplier"), ["src", "dst"], "at", maps=["metadata"])
    parts = F.transform(F.array_sort(F.map_entries("metadata")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return new.select("src", "dst", F.array_join(parts, ",").alias("metadata"))


@query("patched_twice", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 3 = 0 THEN 'first' ELSE c_mktsegment END AS segment FROM customer")
def patched_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two patches a key: the last that sets a column counts, each row stays one."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    third = rows.where("id % 3 = 0").select("id")
    patch = lambda at, balance, segment, both: third.select("id", F.lit(balance).cast("double").alias("balance"), F.lit(True).alias("set_balance"), F.lit(segment).alias("segment"), F.lit(both).alias("set_segment"), F.lit(at).alias("at"))
    return ops.patched(rows, patch(1, 5.0, "first", True).unionByName(patch(2, None, "second", False)), order="at")


@query("keyed_table_writes", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 1 THEN 'seen' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 10 = 2 THEN NULL ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 10 <> 3 UNION ALL SELECT -o_orderkey, 'new', o_totalprice FROM orders WHERE o_orderkey % 10 = 4")
def keyed_table_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is written, upserted, patched and deleted from, bucket by bucket."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.lit(0).alias("at"))
    kept = KeyedTable(spark, shared_path(spark, "keyed"), orders.schema, ["id"], 8)
    kept.upsert(orders, "at")
    seen = orders.where("id % 10 = 1").withColumn("status", F.lit("seen"))
    kept.upsert(seen.unionByName(orders.where("id % 10 = 4").withColumns({"id": -F.col("id"), "status": F.lit("new")})), "at")
    kept.patch(orders.where("id % 10 = 2").select("id", F.lit(None).cast("double").alias("price"), F.lit(True).alias("set_price")))
    kept.delete(orders.where("id % 10 = 3").select("id"))
    return kept.read().drop("at")
