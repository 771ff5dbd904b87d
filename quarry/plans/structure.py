"""Queries over general task graphs and trees, whose rounds end with the graph's depth.

The tasks are parts: task p needs tasks p div 2 and p div 3, so most have several prerequisites. In
the tree, p div 2 is the parent; parts of some sizes are absent, which makes their children roots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import task_graph
from quarry.plans.registry import query
from quarry.sources.tables import table


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node"), F.col("p_size").cast("double").alias("effort"))


def _needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    both = table(spark, sf_dir, "part").select(F.explode(F.array(F.floor(p / 2), F.floor(p / 3))).alias("src"), p.cast("long").alias("dst"))
    return both.where("src >= 1").distinct()


_NEEDS = "needs AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey // 2 >= 1 UNION SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey // 3 >= 1)"
_CHAINS = f"""{_NEEDS}, chains AS (SELECT p_partkey AS node, 0 AS level, p_size::double AS finish, NULL::bigint AS via FROM part WHERE p_partkey NOT IN (SELECT dst FROM needs)
    UNION SELECT n.dst, c.level + 1, c.finish + p_size::double, c.node FROM chains c JOIN needs n ON c.node = n.src JOIN part ON p_partkey = n.dst),
    planned AS (SELECT node, max(level) AS level, max(finish) AS finish, arg_min(via, struct_pack(cost := -finish, at := via)) AS via FROM chains GROUP BY node)"""


@query("task_schedule", f"WITH RECURSIVE {_CHAINS} SELECT node, level, finish, via FROM planned")
def task_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_graph.schedule(_tasks(spark, sf_dir), _needs(spark, sf_dir))


@query(
    "task_critical_path",
    f"""WITH RECURSIVE {_CHAINS}, path AS (SELECT 0 AS step, node, finish, via FROM (FROM planned ORDER BY finish DESC, node LIMIT 1)
    UNION ALL SELECT step + 1, planned.node, planned.finish, planned.via FROM path JOIN planned ON planned.node = path.via) SELECT step, node, finish FROM path""",
)
def task_critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_graph.critical_path(_tasks(spark, sf_dir), _needs(spark, sf_dir))


@query("task_blockers", f"WITH {_NEEDS}, open AS (SELECT p_partkey AS node FROM part WHERE p_size > 10) SELECT dst AS node, count(*) AS blockers FROM needs WHERE src IN (FROM open) AND dst IN (FROM open) GROUP BY dst")
def task_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _tasks(spark, sf_dir).select("node", (F.col("effort") <= 10).alias("done"))
    return task_graph.blocked(tasks, _needs(spark, sf_dir))


@query(
    "tree_places",
    """WITH RECURSIVE n AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 0 THEN p_partkey // 2 END AS parent FROM part WHERE p_size % 7 <> 0),
    t AS (SELECT node, node AS root, 0 AS depth FROM n WHERE parent IS NULL OR parent NOT IN (SELECT node FROM n) UNION ALL SELECT n.node, t.root, t.depth + 1 FROM t JOIN n ON n.parent = t.node) SELECT node, root, depth FROM t""",
)
def tree_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "part").where("p_size % 7 <> 0")
    return task_graph.tree_places(kept.select(F.col("p_partkey").cast("long").alias("node"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 2)).alias("parent")))


_LINES = "SELECT conv_id, turn, string_split(text, '. ') AS lines, coalesce(list_position(list_transform(string_split(text, '. '), lambda s: contains(lower(s), 'the')), true), 0) AS hit FROM conversations"


@query("text_snippets", f"SELECT conv_id, turn, CASE WHEN lines IS NULL THEN 'none' WHEN hit > 0 THEN 'match' ELSE 'head' END AS reason, CASE WHEN lines IS NOT NULL THEN greatest(hit, 1) END AS line, md5(array_to_string(lines[greatest(greatest(hit, 1) - 3, 1) : greatest(hit, 1) + 3], '. ')) AS digest FROM ({_LINES})")
def text_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tx.snippet(F.col("text"), "the", 3, ". ")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("s"))
    return rows.select("conv_id", "turn", "s.reason", "s.line", F.md5("s.snippet").alias("digest"))
