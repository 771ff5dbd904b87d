"""Queries of statistics and of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import statistics as st
from quarry.plans.registry import query
from quarry.sources.tables import table


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_brand").alias("language"), F.col("p_size").cast("string").alias("path"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey >= 2").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"), F.when(F.col("p_size") % 2 == 0, "modifies").otherwise("calls").alias("type"))


_E = "e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst, CASE WHEN p_size % 2 = 0 THEN 'modifies' ELSE 'calls' END AS type FROM part WHERE p_partkey >= 2)"


@query("component_detail", f"WITH {_E} SELECT p_partkey AS id, (SELECT count(*) FROM e WHERE dst = p_partkey) AS incoming, (SELECT count(*) FROM e WHERE src = p_partkey) AS outgoing, coalesce((SELECT count(*) FROM e WHERE type = 'calls' AND (src = p_partkey OR dst = p_partkey)), 0) AS calls FROM part")
def component_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = st.component_detail(_components(spark, sf_dir), _edges(spark, sf_dir))
    return found.select("id", "incoming", "outgoing", F.coalesce(F.col("by_type")["calls"], F.lit(0)).alias("calls"))


@query("language_insights", f"WITH {_E}, k AS (SELECT p_brand AS b, count(*) AS m, count(*) FILTER (type = 'calls') AS calls FROM e JOIN part ON p_partkey = src GROUP BY p_brand) SELECT p_brand AS language, count(*) AS n, count(DISTINCT p_size) AS files, coalesce(nullif(any_value(calls), 0), 0) AS calls, round(coalesce(any_value(m), 0)::double / count(*), 2) AS edges_per_component, count(*) FILTER (p_type = 'ECONOMY') AS economy FROM part LEFT JOIN k ON b = p_brand GROUP BY p_brand")
def language_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = st.language_insight(_components(spark, sf_dir), _edges(spark, sf_dir))
    return found.select("language", "n", "files", F.coalesce(F.col("edge_types")["calls"], F.lit(0)).alias("calls"), "edges_per_component", F.coalesce(F.col("types")["ECONOMY"], F.lit(0)).alias("economy"))


_BUCKET = "CASE WHEN c >= 0.9 THEN '0.9-1.0' WHEN c >= 0.8 THEN '0.8-0.9' WHEN c >= 0.7 THEN '0.7-0.8' WHEN c >= 0.6 THEN '0.6-0.7' WHEN c >= 0.5 THEN '0.5-0.6' ELSE '0.0-0.5' END"


@query("evidence_statistics", f"WITH v AS (SELECT l_returnflag AS p, l_linestatus AS s, round(1 - l_discount * 6, 2) AS c FROM lineitem) SELECT kind, value, count(*) AS n, round(avg(c), 6) AS mean FROM (SELECT 'precedence' AS kind, p AS value, c FROM v UNION ALL SELECT 'source', s, c FROM v UNION ALL SELECT 'bucket', {_BUCKET}, c FROM v) GROUP BY kind, value")
def evidence_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.evidence_statistics(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("precedence"), F.col("l_linestatus").alias("source"), F.round(1 - F.col("l_discount") * 6, 2).alias("confidence")))


@query("rule_totals", "SELECT o_orderpriority AS type, o_orderstatus = 'O' AS active, count(*) AS n FROM orders GROUP BY ALL")
def rule_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.rule_totals(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("type"), (F.col("o_orderstatus") == "O").alias("active")))


@query("error_histogram", "SELECT props AS error, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY props ORDER BY n DESC, error LIMIT 5")
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.error_histogram(table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("props").alias("error")))


@query("embedded_entities", "SELECT 'document' AS entity_type, count(*) AS n, count(DISTINCT vec_id) AS embedded FROM documents LEFT JOIN embeddings ON vec_id = doc_id AND label < 5 UNION ALL SELECT 'part', count(*), count(DISTINCT vec_id) FROM part LEFT JOIN embeddings ON vec_id = p_partkey AND label >= 5")
def embedded_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.when(F.col("label") < 5, "document").otherwise("part").alias("entity_type"), F.col("vec_id").alias("entity_id"))
    return st.embedded({"document": table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "part": _components(spark, sf_dir)}, vectors)


@query("project_row", "SELECT (SELECT count(DISTINCT p_size) FROM part) AS files, (SELECT count(*) FROM part) AS components, (SELECT count(*) FROM orders) AS tasks, (SELECT count(*) FROM part WHERE p_brand = 'Brand#13') AS thirteen")
def project_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _components(spark, sf_dir)
    return st.project_row({"components": rows, "tasks": table(spark, sf_dir, "orders")}, rows).select("files", "components", "tasks", F.coalesce(F.col("languages")["Brand#13"], F.lit(0)).alias("thirteen"))


@query("task_code_links", "SELECT o_orderkey AS id, count(l_orderkey) AS links, count(*) FILTER (1 - l_discount * 3 >= 0.8) AS sure, round(avg(1 - l_discount * 3), 6) AS mean_confidence FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def task_code_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), (1 - F.col("l_discount") * 3).alias("confidence"))
    found = st.task_links(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), links)
    return found.select("id", "links", "sure", F.round("mean_confidence", 6).alias("mean_confidence"))


@query("pattern_scores", "SELECT id, pattern, round(score, 6)::double AS score FROM (SELECT p_partkey AS id, 'widget' AS pattern, 0.6 * contains(p_name, 'widget')::int + 0.3 * (p_size > 25)::int AS score FROM part UNION ALL SELECT p_partkey, 'cold', 0.4 * contains(p_name, 'cold')::int + 0.3 * (p_type = 'ECONOMY')::int FROM part) WHERE score > 0.5")
def pattern_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    named = lambda w: F.contains("p_name", F.lit(w))
    patterns = {"widget": [("name", named("widget"), 0.6), ("large", F.col("p_size") > 25, 0.3)], "cold": [("name", named("cold"), 0.4), ("type", F.col("p_type") == "ECONOMY", 0.3)]}
    return st.pattern_scores(rows, patterns).select("id", "pattern", "score")


@query("simple_document_query", "SELECT item_id, contains(lower(text), 'the') AND contains(lower(text), 'ion') AS both, NOT contains(lower(text), 'wh') AS neither, contains(lower(text), 'hand') AS plain FROM benchmark")
def simple_document_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", st.simple_query("The and ion", "text").alias("both"), st.simple_query("x not wh", "text").alias("neither"), st.simple_query("hand", "text").alias("plain"))


@query("semantic_edges", f"WITH {_E} SELECT type = 'modifies' AS semantic, count(*) AS n FROM e GROUP BY ALL")
def semantic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    semantic, structural = st.split_semantic(_edges(spark, sf_dir))
    return semantic.withColumn("semantic", F.lit(True)).unionByName(structural.withColumn("semantic", F.lit(False))).groupBy("semantic").agg(F.count("*").alias("n"))


@query("texts_cleaned", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'), '<[^>]*>', '', 'g')), '[^a-z0-9_\s]|_', ' ', 'g'), '[0-9]+', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents")
def texts_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters beyond ASCII count as punctuation, as in the patterns of words."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.cleaned(F.col("text"), html=True, punctuation=True, numbers=True)).alias("digest"))


@query("token_counts", "SELECT conv_id, turn, ceil(length(text) / 4.0)::bigint AS gpt, ceil(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3::double)::bigint AS bert, length(text) AS chars FROM conversations")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", tx.token_count(F.col("text")).alias("gpt"), tx.token_count(F.col("text"), "bert").alias("bert"), tx.token_count(F.col("text"), "char").alias("chars"))


@query("word_bigrams", "WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '([a-z0-9_]+(?:-[a-z0-9_]+)*)', 1) AS ws FROM benchmark) SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(ws)::bigint), lambda k: ws[k] || ' ' || ws[k + 1])) AS gram FROM w) GROUP BY gram")
def word_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    grams = tx.word_ngrams(tx.tokens(F.col("text"), lower=True), 2)
    return rows.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
