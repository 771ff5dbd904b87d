"""Queries of the graph operators, over a graph of parts.

Part p calls part p div 2 and imports part p div 3; every fortieth part is used by the part it
calls, which closes cycles. In the grove, only large parts have an edge, so it falls into many trees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import edges as ed
from quarry.operators import graph
from quarry.plans.registry import query
from quarry.sources.tables import table


def _name(number: str) -> Column:
    return F.expr(f"concat('p', {number})")


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")

    def edge(src: str, dst: str, kind: str, where: str) -> DataFrame:
        return part.where(where).select(_name(src).alias("src"), _name(dst).alias("dst"), F.lit(kind).alias("type"))

    calls = edge("p_partkey", "p_partkey div 2", "calls", "p_partkey div 2 >= 1")
    imports = edge("p_partkey", "p_partkey div 3", "imports", "p_partkey div 3 >= 1")
    return calls.unionByName(imports).unionByName(edge("p_partkey div 2", "p_partkey", "uses", "p_partkey % 40 = 0"))


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).where("type <> 'uses'")


def _grove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size > 25 AND p_partkey div 2 >= 1").select(_name("p_partkey").alias("src"), _name("p_partkey div 2").alias("dst"), F.lit("contains").alias("type"))


def _nodes(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


_E = "e AS (SELECT 'p' || p_partkey AS src, 'p' || p_partkey // 2 AS dst, 'calls' AS type FROM part WHERE p_partkey // 2 >= 1 UNION ALL SELECT 'p' || p_partkey, 'p' || p_partkey // 3, 'imports' FROM part WHERE p_partkey // 3 >= 1 UNION ALL SELECT 'p' || p_partkey // 2, 'p' || p_partkey, 'uses' FROM part WHERE p_partkey % 40 = 0)"
_D = f"{_E}, d AS (SELECT DISTINCT src, dst FROM e WHERE type <> 'uses')"
_G = "g AS (SELECT 'p' || p_partkey AS src, 'p' || p_partkey // 2 AS dst FROM part WHERE p_size > 25 AND p_partkey // 2 >= 1), b AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g)"
_NEAR = f"{_E}, b AS (SELECT src AS here, dst AS next FROM e UNION SELECT dst, src FROM e), r AS (SELECT 'p180' AS node, 0 AS depth UNION SELECT next, depth + 1 FROM r JOIN b ON node = here WHERE depth < 3), near AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)"


@query("graph_shortest_path", f"WITH RECURSIVE {_E}, s AS (SELECT src, dst, min(type) AS type FROM e GROUP BY src, dst), w AS (SELECT 'p180' AS node, ['p180'] AS path, []::varchar[] AS types, 0 AS hops UNION ALL SELECT dst, list_append(path, dst), list_append(types, type), hops + 1 FROM w JOIN s ON node = src WHERE hops < 5) SELECT array_to_string(path, '>') AS path, array_to_string(types, '>') AS types, hops FROM (SELECT * FROM w WHERE node = 'p6' ORDER BY hops, path LIMIT 1)")
def graph_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.shortest_path(_graph(spark, sf_dir), "p180", "p6")
    return found.select(F.array_join("path", ">").alias("path"), F.array_join("types", ">").alias("types"), "hops")


@query("graph_walk_nodes", f"WITH RECURSIVE {_NEAR} SELECT node, depth FROM near")
def graph_walk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.walk(_nodes(spark, "p180"), _graph(spark, sf_dir), 3)[0]


@query("graph_walk_edges", f"WITH RECURSIVE {_NEAR} SELECT DISTINCT src, dst, type FROM e WHERE src <> dst AND (src IN (SELECT node FROM near WHERE depth < 3) OR dst IN (SELECT node FROM near WHERE depth < 3))")
def graph_walk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.walk(_nodes(spark, "p180"), _graph(spark, sf_dir), 3)[1]


@query("graph_chain", f"WITH {_E}, one AS (SELECT src, dst, type, ['p180', dst] AS path FROM e WHERE src = 'p180'), n AS (SELECT dst AS node, min(path) AS path FROM one WHERE dst <> 'p180' GROUP BY dst), two AS (SELECT e.src, e.dst, e.type, list_append(n.path, e.dst) AS path FROM n JOIN e ON e.src = node) SELECT src, dst, type, 1 AS depth, array_to_string(path, '>') AS path FROM one UNION ALL SELECT src, dst, type, 2, array_to_string(path, '>') FROM two")
def graph_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chain(_nodes(spark, "p180"), _graph(spark, sf_dir)).select("src", "dst", "type", "depth", F.array_join("path", ">").alias("path"))


@query("graph_ego_nodes", f"WITH {_E} SELECT DISTINCT node, depth FROM (SELECT 'p60' AS node, 0 AS depth UNION SELECT dst, 1 FROM e WHERE src = 'p60' AND dst <> 'p60' UNION SELECT src, 1 FROM e WHERE dst = 'p60' AND src <> 'p60')")
def graph_ego_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ego(_nodes(spark, "p60"), _graph(spark, sf_dir))[0]


@query("graph_one_hop", f"WITH {_E} SELECT src, dst, type FROM e WHERE (src = 'p60' OR dst = 'p60') AND type IN ('calls', 'uses')")
def graph_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.one_hop(_graph(spark, sf_dir), "p60", "both", ("calls", "uses"))


@query("graph_lenses", f"WITH {_E} SELECT 'callers' AS lens, src, dst, type FROM e WHERE dst = 'p20' AND type IN ('calls', 'called_by') UNION ALL SELECT 'callees', src, dst, type FROM e WHERE src = 'p20' AND type = 'calls' UNION ALL SELECT 'dependencies', src, dst, type FROM e WHERE src = 'p20' AND type IN ('imports', 'depends_on') UNION ALL SELECT 'dependents', src, dst, type FROM e WHERE dst = 'p20' AND type IN ('imports', 'imported_by', 'depends_on')")
def graph_lenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, out = _graph(spark, sf_dir), None
    for name in ("callers", "callees", "dependencies", "dependents"):
        part = ed.lens(e, "p20", name).select(F.lit(name).alias("lens"), "src", "dst", "type")
        out = part if out is None else out.unionByName(part)
    return out


@query("graph_dependencies", f"WITH {_E} SELECT src AS node, string_agg(DISTINCT dst, ',' ORDER BY dst) AS others FROM e WHERE type IN ('imports', 'uses', 'depends_on', 'requires') GROUP BY src")
def graph_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(_graph(spark, sf_dir)).select("node", F.array_join("others", ",").alias("others"))


@query("graph_dependents", f"WITH {_E} SELECT dst AS node, string_agg(DISTINCT src, ',' ORDER BY src) AS others FROM e WHERE type IN ('imports', 'uses', 'depends_on', 'requires') GROUP BY dst")
def graph_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(_graph(spark, sf_dir), reverse=True).select("node", F.array_join("others", ",").alias("others"))


@query("graph_closure", f"WITH RECURSIVE {_D}, r AS (SELECT src AS seed, dst AS node, 1 AS depth FROM d WHERE src IN ('p180', 'p150') UNION SELECT seed, d.dst, depth + 1 FROM r JOIN d ON node = d.src) SELECT seed, node, min(depth) AS depth FROM r GROUP BY seed, node")
def graph_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(_ordered(spark, sf_dir), _nodes(spark, "p180", "p150"))


@query("graph_would_cycle", f"WITH RECURSIVE {_D}, c AS (SELECT 'p' || p_partkey // 2 AS src, 'p' || p_partkey AS dst FROM part WHERE p_size > 40 AND p_partkey > 1 UNION SELECT 'p' || p_partkey, 'p' || p_partkey + 1 FROM part WHERE p_size > 40), r AS (SELECT dst AS seed, dst AS node FROM c UNION SELECT seed, d.dst FROM r JOIN d ON node = d.src) SELECT src, dst, EXISTS (SELECT 1 FROM r WHERE seed = c.dst AND node = c.src) AS closes FROM c")
def graph_would_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "part").where("p_size > 40")
    back = large.where("p_partkey > 1").select(_name("p_partkey div 2").alias("src"), _name("p_partkey").alias("dst"))
    candidates = back.unionByName(large.select(_name("p_partkey").alias("src"), _name("p_partkey + 1").alias("dst"))).distinct()
    return graph.would_cycle(_ordered(spark, sf_dir), candidates)


@query("graph_longest_depths", f"WITH RECURSIVE {_D}, r AS (SELECT src AS node, 0 AS depth FROM d WHERE src NOT IN (SELECT dst FROM d) UNION SELECT d.dst, depth + 1 FROM r JOIN d ON node = d.src) SELECT node, max(depth) AS depth FROM r GROUP BY node")
def graph_longest_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.longest_depths(_ordered(spark, sf_dir))


@query("graph_components", f"WITH RECURSIVE {_G}, r AS (SELECT src AS node, src AS other FROM b UNION SELECT r.node, b.dst FROM r JOIN b ON r.other = b.src) SELECT node, min(other) AS component FROM r GROUP BY node")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_components(_grove(spark, sf_dir))


@query("graph_component_count", f"WITH RECURSIVE {_G}, r AS (SELECT src AS node, src AS other FROM b UNION SELECT r.node, b.dst FROM r JOIN b ON r.other = b.src), n AS (SELECT 'p' || p_partkey AS node FROM part), i AS (SELECT count(*) AS isolated FROM n WHERE node NOT IN (SELECT src FROM b)) SELECT count(DISTINCT c) + any_value(isolated) AS components, any_value(isolated) AS isolated FROM (SELECT min(other) AS c FROM r GROUP BY node), i")
def graph_component_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.component_count(table(spark, sf_dir, "part").select(_name("p_partkey").alias("node")), _grove(spark, sf_dir))


@query("graph_context", f"WITH RECURSIVE {_E}, b AS (SELECT src AS here, dst AS next FROM e UNION SELECT dst, src FROM e), r AS (SELECT unnest(['p60', 'p7']) AS node, 0 AS depth UNION SELECT next, depth + 1 FROM r JOIN b ON node = here WHERE depth < 2) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def graph_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.expanded_context(_nodes(spark, "p60", "p7"), _graph(spark, sf_dir))


@query("graph_systems", f"WITH RECURSIVE {_G}, a AS (SELECT 'p' || p_partkey AS node, p_partkey AS place FROM part WHERE p_size > 45), r AS (SELECT node, place, 0 AS depth FROM a UNION SELECT b.dst, place, depth + 1 FROM r JOIN b ON node = src WHERE depth < 5), o AS (SELECT node, min(struct_pack(depth := depth, place := place)) AS best FROM r GROUP BY node) SELECT a.node AS anchor, o.node, best.depth AS depth FROM o JOIN a ON a.place = best.place WHERE best.place IN (SELECT best.place FROM o GROUP BY best.place HAVING count(*) >= 3)")
def graph_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = table(spark, sf_dir, "part").where("p_size > 45").select(_name("p_partkey").alias("node"), F.col("p_partkey").alias("place"))
    return graph.systems(anchors, _grove(spark, sf_dir))


@query("graph_pipelines", f"WITH RECURSIVE {_E}, c AS (SELECT src, dst FROM e WHERE type = 'calls'), r AS (SELECT 'p' || p_partkey AS entry, 'p' || p_partkey AS node, 0 AS depth FROM part WHERE 'p' || p_partkey NOT IN (SELECT dst FROM c) UNION SELECT entry, dst, depth + 1 FROM r JOIN c ON node = src WHERE depth < 10), s AS (SELECT entry, node, row_number() OVER (PARTITION BY entry ORDER BY depth, node) - 1 AS stage, count(*) OVER (PARTITION BY entry) AS n FROM r) SELECT entry, stage::int AS stage, node, stage >= n - 3 AS is_exit FROM s WHERE n >= 3")
def graph_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pipelines(table(spark, sf_dir, "part").select(_name("p_partkey").alias("node")), _graph(spark, sf_dir))


@query("graph_cohesion", f"WITH {_E}, m AS (SELECT p_brand AS grp, 'p' || p_partkey AS node FROM part), x AS (SELECT a.grp AS sg, b.grp AS dg FROM e JOIN m a ON a.node = src JOIN m b ON b.node = dst) SELECT s.grp AS \"group\", n, round((SELECT count(*) FROM x WHERE sg = s.grp AND dg = s.grp)::double / (n * (n - 1)), 8) AS cohesion, round((SELECT count(*) FROM x WHERE (sg = s.grp) <> (dg = s.grp))::double / (SELECT count(*) FROM e), 8) AS coupling FROM (SELECT grp, count(*) AS n FROM m GROUP BY grp) s")
def graph_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "part").select(F.col("p_brand").alias("group"), _name("p_partkey").alias("node"))
    return graph.cohesion(members, _graph(spark, sf_dir)).select("group", "n", F.round("cohesion", 8).alias("cohesion"), F.round("coupling", 8).alias("coupling"))


@query("graph_flow_complexity", f"""WITH RECURSIVE {_E}, s AS (SELECT DISTINCT src, dst FROM e), p AS (SELECT [src] AS path FROM s UNION SELECT list_append(path, dst) FROM p JOIN s ON path[-1] = src WHERE len(path) < 3 AND dst > path[1] AND NOT list_contains(path, dst)),
    r(seed, node, depth) USING KEY (seed, node) AS (SELECT src, dst, 1 FROM s WHERE src NOT IN (SELECT dst FROM s) UNION SELECT r.seed, s.dst, r.depth + 1 FROM r JOIN s ON r.node = s.src WHERE NOT EXISTS (SELECT 1 FROM recurring.r AS q WHERE q.seed = r.seed AND q.node = s.dst))
    SELECT (SELECT count(*) FROM p JOIN s ON path[-1] = src AND path[1] = dst) AS cycles, (SELECT max(depth) FROM r)::int AS depth, (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM s GROUP BY src)) AS branching""")
def graph_flow_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.flow_complexity(_graph(spark, sf_dir), 3).select("cycles", "depth", F.round("branching", 6).alias("branching"))


@query("graph_member_edges", f"WITH RECURSIVE {_G}, r AS (SELECT src AS node, src AS other FROM b UNION SELECT r.node, b.dst FROM r JOIN b ON r.other = b.src) SELECT node AS src, min(other) AS dst, 'member_of' AS type FROM r GROUP BY node")
def graph_member_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.derived_edges(graph.label_components(_grove(spark, sf_dir)), "component", "node", "member_of").drop("place")


@query("graph_preview", f"WITH {_E} SELECT src, dst, type FROM e ORDER BY src, dst, type LIMIT 200")
def graph_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preview: the limit is the feature."""
    return _graph(spark, sf_dir).orderBy("src", "dst", "type").limit(200)
