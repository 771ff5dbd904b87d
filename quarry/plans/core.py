"""Queries built from this library's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions import vector as vec
from quarry.operators import boolean_search, edges, graph
from quarry.plans.registry import query
from quarry.sources.tables import table


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the vector of id 0."""
    return F.broadcast(_vectors(spark, sf_dir).where("vec_id = 0").select(F.col("v").alias("q")).limit(1))


_Q = "(SELECT embedding::double[] FROM embeddings WHERE vec_id = 0)"


@query(
    "slice_vector_topk",
    f"""WITH s AS (SELECT vec_id, label, list_cosine_similarity(embedding::double[], {_Q}) AS score FROM embeddings),
    z AS (SELECT *, coalesce((score - avg(score) OVER w) / nullif(stddev_samp(score) OVER w, 0), 0) AS z FROM s WHERE score >= 0.0 WINDOW w AS (PARTITION BY label))
    SELECT vec_id, label, round(score, 6) AS score, round(0.5 + 0.5 * tanh(z / 2), 6) AS squashed FROM z ORDER BY score DESC, vec_id LIMIT 20""",
)
def slice_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _vectors(spark, sf_dir).join(_query_vector(spark, sf_dir)).withColumn("score", vec.cosine(F.col("v"), F.col("q"))).where("score >= 0.0")
    # mean and deviation of each type are one aggregate, so no type's rows meet in a task
    stats = scored.groupBy("label").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"))
    z = F.coalesce((F.col("score") - F.col("mean")) / F.nullif(F.coalesce("std", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    ranked = scored.join(stats, "label").withColumn("z", z).orderBy(F.desc("score"), "vec_id").limit(20)
    return ranked.select("vec_id", "label", F.round("score", 6).alias("score"), F.round(vec.squashed(F.col("z")), 6).alias("squashed"))


@query("vector_distances", f"SELECT vec_id, round(list_distance(embedding::double[], {_Q}), 5) AS euclidean, round(list_sum(list_transform(list_zip(embedding::double[], {_Q}), lambda x: abs(x[1] - x[2]))), 5) AS manhattan FROM embeddings")
def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).join(_query_vector(spark, sf_dir))
    return rows.select("vec_id", F.round(vec.euclidean(F.col("v"), F.col("q")), 5).alias("euclidean"), F.round(vec.manhattan(F.col("v"), F.col("q")), 5).alias("manhattan"))


@query("vector_knn_euclidean", f"SELECT vec_id, label, round(list_distance(embedding::double[], {_Q}), 5) AS distance FROM embeddings ORDER BY list_distance(embedding::double[], {_Q}), vec_id LIMIT 10")
def vector_knn_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).join(_query_vector(spark, sf_dir)).withColumn("d", vec.euclidean(F.col("v"), F.col("q")))
    return rows.orderBy("d", "vec_id").limit(10).select("vec_id", "label", F.round("d", 5).alias("distance"))


@query("vector_normalised", "SELECT vec_id, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) AS first_part, round(embedding[64]::double / sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) AS last_part FROM embeddings")
def vector_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = vec.l2_normalised(F.col("v"))
    return _vectors(spark, sf_dir).select("vec_id", F.round(unit[0], 6).alias("first_part"), F.round(unit[63], 6).alias("last_part"))


@query("vector_average_by_type", "SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding::double[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos")
def vector_average_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _vectors(spark, sf_dir).select("label", F.posexplode("v").alias("at", "x"))
    return parts.groupBy("label", (F.col("at") + 1).cast("long").alias("pos")).agg(F.round(F.avg("x"), 6).alias("mean"))


@query("boolean_search", "SELECT p_partkey, p_name FROM part WHERE (lower(p_name) LIKE '%steel%' OR lower(p_type) LIKE '%steel%') AND NOT (lower(p_name) LIKE '%small%' OR lower(p_type) LIKE '%small%') OR (lower(p_name) LIKE '%promo%' OR lower(p_type) LIKE '%promo%')")
def boolean_search_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(boolean_search.compile_query('steel AND NOT "small" OR promo', ["p_name", "p_type"])).select("p_partkey", "p_name")


@query("component_search_ranked", "SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%1%' ORDER BY CASE WHEN lower(p_name) = '1' THEN 1 ELSE 0 END DESC, CASE WHEN p_type ILIKE 'promo%' THEN 2 WHEN p_type ILIKE 'standard%' THEN 1 ELSE 0 END DESC, p_name, p_partkey LIMIT 25 OFFSET 10")
def component_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_type").ilike("promo%"), 2).when(F.col("p_type").ilike("standard%"), 1).otherwise(0)
    found = table(spark, sf_dir, "part").where(F.col("p_name").ilike("%1%"))
    return found.orderBy((F.lower("p_name") == "1").desc(), kind.desc(), "p_name", "p_partkey").offset(10).limit(25).select("p_partkey", "p_name", "p_type")


@query("name_match_ladder", "SELECT c_custkey, CASE WHEN lower(c_name) = 'customer 1' THEN 1.0 WHEN replace(lower(c_name), ' ', '') = 'customer1' THEN 0.9 WHEN starts_with(lower(c_name), 'customer 1') THEN 0.75 WHEN contains(lower(c_name), 'customer') AND contains(lower(c_name), '1') THEN 0.6 WHEN contains(lower(c_name), 'customer 1') THEN 0.5 ELSE 0.0 END::double AS score FROM customer")
def name_match_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", tx.name_match(F.col("c_name"), "customer 1").alias("score"))


@query("text_normalised", r"SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace(regexp_replace(text, 'https?://[^ \n\t]+', ' ', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', ' ', 'g')), '[ \n\t\r]+', ' ', 'g'))) AS digest FROM documents")
def text_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normalised(F.col("text"))).alias("digest"))


_BARE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?i)<br */?>', chr(10), 'g'), '(?i)</?(p|div)[^>]*>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g')"
for _entity, _char in tx.ENTITIES.items():
    _BARE = f"replace({_BARE}, '{_entity}', '{_char}')"


@query("html_text", f"SELECT page_id, md5(regexp_replace(regexp_replace({_BARE}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')) AS digest FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.html_text(F.col("html"))).alias("digest"))


@query("term_frequencies", "SELECT term, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM conversations) WHERE length(term) >= 3 GROUP BY term ORDER BY n DESC, term LIMIT 100")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "conversations").select(F.explode(tx.words(F.col("text"), 3)).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(100)


@query("identifier_words", "SELECT c_custkey, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(c_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g')), '[ _.#-]+'), lambda w: length(w) > 0), ' ') AS words FROM customer".replace("\\\\", "\\"))
def identifier_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(tx.identifier_words(F.col("c_name")), " ").alias("words"))


@query("name_jaccard", "WITH g AS (SELECT p_partkey, list_distinct(list_transform(range(1, greatest(length(s) - 1, 1)::bigint), lambda k: substr(s, k, 3))) AS grams FROM (SELECT p_partkey, regexp_replace(lower(p_name), '[ \\n\\t\\r]+', '', 'g') AS s FROM part)), q AS (SELECT grams AS q FROM g WHERE p_partkey = 1) SELECT p_partkey, round(len(list_intersect(grams, q)) / len(list_distinct(list_concat(grams, q))), 6) AS similarity FROM g, q".replace("\\\\", "\\"))
def name_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", tx.char_ngrams(F.col("p_name")).alias("grams"))
    wanted = F.broadcast(parts.where("p_partkey = 1").select(F.col("grams").alias("q")).limit(1))
    return parts.join(wanted).select("p_partkey", F.round(tx.jaccard(F.col("grams"), F.col("q")), 6).alias("similarity"))


def _event_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which event type directly follows which, for any user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"))
    return steps.where("dst IS NOT NULL").select("src", "dst").distinct()


_STEPS = "steps AS (SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"
_PATHS = f"WITH RECURSIVE {_STEPS}, p AS (SELECT [event_type] AS path, 0 AS hops FROM (SELECT DISTINCT event_type FROM events) UNION ALL SELECT list_append(path, dst), hops + 1 FROM p JOIN steps ON path[-1] = src WHERE hops < 3 AND NOT list_contains(path, dst))"


@query("simple_paths", f"{_PATHS} SELECT array_to_string(path, '>') AS path, hops FROM p WHERE hops > 0")
def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _event_graph(spark, sf_dir)
    starts = table(spark, sf_dir, "events").select(F.col("event_type").alias("node")).distinct()
    return graph.simple_paths(starts, steps, 3).select(F.array_join("path", ">").alias("path"), "hops")


@query("cycles", f"{_PATHS} SELECT DISTINCT array_to_string(list_append(path, dst), '>') AS cycle, hops + 1 AS hops FROM p JOIN steps ON path[-1] = src AND path[1] = dst WHERE path[1] = list_min(path)")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(_event_graph(spark, sf_dir), 4).select(F.array_join("cycle", ">").alias("cycle"), "hops")


def _supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("supplies").alias("type")).distinct()


_SUPPLY = "e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, 'supplies' AS type FROM lineitem)"


_KINDS = "CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'R' THEN 'contains' ELSE 'in_namespace' END"


@query("edges_with_inverses", f"WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, {_KINDS} AS type FROM lineitem) SELECT src, dst, type, false AS is_inverse, NULL::varchar AS original_type FROM e UNION ALL SELECT dst, src, CASE type WHEN 'calls' THEN 'called_by' ELSE 'namespace_contains' END, true, type FROM e WHERE type <> 'contains'")
def edges_with_inverses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.expr(_KINDS).alias("type"))
    return edges.with_inverses(rows.distinct())


@query("reach_two_hops", f"WITH {_SUPPLY}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), h1 AS (SELECT DISTINCT dst AS node FROM b WHERE src = 's1'), h2 AS (SELECT DISTINCT b.dst AS node FROM h1 JOIN b ON h1.node = b.src) SELECT 's1' AS seed, node, min(depth) AS depth FROM (SELECT 's1' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY node")
def reach_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _supply(spark, sf_dir).select("src", "dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.reach(spark.createDataFrame([("s1",)], "node string"), both, 2)


@query("components_of_trade", "WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS other FROM b UNION SELECT r.node, b.b FROM r JOIN b ON r.other = b.a) SELECT node, min(other) AS component FROM r GROUP BY node")
def components_of_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    return graph.label_components(e)


@query(
    "evidence_aggregation",
    """WITH e AS (SELECT l_suppkey AS supp, l_partkey AS part, CASE l_returnflag WHEN 'A' THEN 4 WHEN 'R' THEN 3 ELSE 2 END AS precedence, round(1 - l_discount * 5, 2) AS confidence, l_linenumber AS age_days FROM lineitem),
    t AS (SELECT supp, part, max(precedence) AS precedence, count(*) AS pieces, avg(age_days) AS age, min(confidence) AS lowest, max(confidence) AS highest, greatest(0, 1 - var_pop(confidence)) AS consensus FROM e GROUP BY supp, part), b AS (SELECT e.supp, e.part, max(confidence) AS base FROM e JOIN t ON e.supp = t.supp AND e.part = t.part AND e.precedence = t.precedence GROUP BY e.supp, e.part)
    SELECT t.supp, t.part, pieces, precedence, floor(least(1.0::double, (base + least(0.1::double, 0.02::double * (pieces - 1)) + CASE precedence WHEN 4 THEN 0.1::double WHEN 3 THEN 0.05::double ELSE 0.02::double END) * greatest(0, 1 - 0.01::double * age)) * 1000 + 0.5) / 1000 AS confidence, lowest, highest, round(consensus, 6) AS consensus FROM t JOIN b ON t.supp = b.supp AND t.part = b.part""",
)
def evidence_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    precedence = F.when(F.col("l_returnflag") == "A", 4).when(F.col("l_returnflag") == "R", 3).otherwise(2)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supp"), F.col("l_partkey").alias("part"), precedence.alias("precedence"), F.round(1 - F.col("l_discount") * 5, 2).alias("confidence"), F.col("l_linenumber").alias("age_days"))
    return edges.aggregate_evidence(rows, ["supp", "part"])


@query("edge_strength", """SELECT l_suppkey AS supp, l_partkey AS part, round(least(1.0, greatest(0.0, 0.4 * avg(1 - l_discount) + 0.3 * CASE WHEN count(*) >= 3 THEN 1.0 WHEN count(*) = 2 THEN 0.6 ELSE 0.3 END + 0.2 * max(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.5 END) + 0.1 * CASE WHEN max(l_shipdate) >= TIMESTAMP '1998-01-01' THEN 1.0 ELSE 0.2 END)), 4) AS strength FROM lineitem GROUP BY l_suppkey, l_partkey""")
def edge_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supp"), F.col("l_partkey").alias("part")).agg(F.avg(1 - F.col("l_discount")).alias("semantic"), F.count("*").alias("n"), F.max(F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.5)).alias("proximity"), F.max("l_shipdate").alias("last"))
    usage = F.when(F.col("n") >= 3, 1.0).when(F.col("n") == 2, 0.6).otherwise(0.3)
    recency = F.when(F.col("last") >= F.lit("1998-01-01").cast("timestamp_ntz"), 1.0).otherwise(0.2)
    return per.select("supp", "part", F.round(edges.strength(F.col("semantic"), usage, F.col("proximity"), recency), 4).alias("strength"))


@query("first_wins_dedup", "SELECT p_partkey, p_name, p_type FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_brand), lower(p_type) ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.first_wins(table(spark, sf_dir, "part"), ["p_brand", "p_type"], ["p_partkey"]).select("p_partkey", "p_name", "p_type")
