"""Queries of reranking, discovery, terms, edge names, and rule matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import terms
from quarry.functions import vector as vec
from quarry.operators import context, discovery, edges, rerank, rules
from quarry.plans.registry import query
from quarry.sources.tables import table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as results of a search."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, "class").when(F.col("p_size") % 3 == 1, "method").otherwise("note").alias("type"),
        F.when(F.col("p_size") % 5 == 0, "rule").otherwise("component").alias("entity_type"), (F.col("p_size") / 50).alias("similarity"), F.col("p_type").alias("content"),
        F.when(F.col("p_partkey") % 11 == 0, "node_modules/x.js").otherwise("src/x.js").alias("path"), (F.col("p_partkey") % 100).cast("double").alias("days"), (F.col("p_partkey") % 30).alias("edges"),
        (F.col("p_size") / 100).alias("acceptance"), F.lit(0.5).alias("effectiveness"), F.col("p_size").alias("uses"), F.when(F.col("p_partkey") % 2 == 0, (F.col("p_partkey") % 120).cast("double")).alias("days_unused"),
    )


_ITEMS = """i AS (SELECT p_partkey AS id, lower(p_name) AS name, CASE p_size % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'method' ELSE 'note' END AS type, CASE WHEN p_size % 5 = 0 THEN 'rule' ELSE 'component' END AS et, p_size / 50.0::double AS sim,
    p_type AS content, p_partkey % 11 = 0 AS noisy, p_partkey % 100 AS days, p_partkey % 30 AS edges, p_size / 100.0::double AS acc, p_size AS uses, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 120 END AS unused FROM part)"""
_NAMED = "CASE WHEN name = 'small widget' THEN {exact} * CASE type WHEN 'class' THEN 1.3 WHEN 'method' THEN 1.1 ELSE 1.0 END WHEN contains(name, 'small widget') THEN {partial} ELSE (contains(name, 'small')::int + contains(name, 'widget')::int) / 2.0::double * {partial} END"
_RECENT = "CASE WHEN days < 7 THEN 0.1 WHEN days < 30 THEN 0.05 WHEN days < 90 THEN 0.02 ELSE 0 END"
_EDGES = "CASE WHEN edges = 0 THEN 0 ELSE least(0.2, log10(edges + 1) * 0.1) END"
_ANALYTICS = "CASE WHEN et = 'rule' THEN (acc + 0.5 + least(1, uses / 50.0) + CASE WHEN unused IS NULL THEN 0 WHEN unused < 7 THEN 1 WHEN unused < 30 THEN 0.6 WHEN unused < 90 THEN 0.3 ELSE 0.1 END) / 4 ELSE 0 END"


@query("rerank_default", f"WITH {_ITEMS} SELECT id, round(0.6 * sim + 0.2 * ({_NAMED.format(exact=1.0, partial=0.3)}) + 0.1 * CASE WHEN type = 'class' THEN 0.15 ELSE 0 END + 0.05 * {_RECENT} + 0.05 * {_EDGES}, 8)::double AS score FROM i")
def rerank_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.reranked(_items(spark, sf_dir), "Small Widget").select("id", F.round("final_score", 8).alias("score"))


@query("rerank_components", f"WITH {_ITEMS}, s AS (SELECT id, noisy, (0.45 * sim + 0.3 * ({_NAMED.format(exact=0.8, partial=0.2)}) + 0.2 * CASE WHEN type IN ('class', 'method') THEN 0.3 ELSE 0 END + 0.05 * {_RECENT} + 0.05 * {_EDGES}) * CASE et WHEN 'rule' THEN 0.3 ELSE 1.0 END AS score FROM i) SELECT id, round(CASE WHEN noisy THEN greatest(0, score - 0.25) ELSE score END, 8)::double AS score FROM s ORDER BY CASE WHEN noisy THEN greatest(0, score - 0.25) ELSE score END DESC, id LIMIT 50")
def rerank_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rerank.reranked(_items(spark, sf_dir), "Small Widget", rerank.COMPONENTS).orderBy(F.desc("final_score"), "id").limit(50)
    return ranked.select("id", F.round("final_score", 8).alias("score"))


@query(
    "rerank_dual_channel",
    f"""WITH {_ITEMS}, z AS (SELECT *, 0.5 + 0.5 * tanh(coalesce((sim - avg(sim) OVER (PARTITION BY et)) / nullif(stddev_samp(sim) OVER (PARTITION BY et), 0), 0) / 2) AS zs, list_distinct(list_filter(regexp_split_to_array(lower(name || ' ' || content), '[^a-z0-9]+'), lambda w: length(w) > 1)) AS own FROM i),
    o AS (SELECT *, len(list_intersect(own, ['economy', 'widget']))::double AS k FROM z), s AS (SELECT id, noisy, CASE et WHEN 'rule' THEN 0.8 * (0.4 * zs + 0.3 * k / (len(own) + 2 - k) + 0.3 * {_ANALYTICS} + 0.05 * {_RECENT} + 0.05 * {_EDGES}) ELSE 0.6 * zs + 0.2 * ({_NAMED.format(exact=0.25, partial=0.1)}) + 0.2 * k / (len(own) + 2 - k) + 0.05 * {_RECENT} + 0.05 * {_EDGES} END AS score FROM o)
    SELECT id, round(CASE WHEN noisy THEN greatest(0, score - 0.2) ELSE score END, 7)::double AS score FROM s""",
)
def rerank_dual_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rerank.reranked(_items(spark, sf_dir), "small widget", rerank.with_boosts(rerank.DUAL_CHANNEL, context="economy Widget"))
    return found.select("id", F.round("final_score", 7).alias("score"))


@query(
    "rerank_by_factors",
    f"""WITH {_ITEMS} SELECT id, round(sim + CASE WHEN name = 'small' THEN 1.0 WHEN contains(name, 'small') THEN 0.5 * 0.8 ELSE 0 END * CASE type WHEN 'class' THEN 2.0 ELSE 1.0 END + 0.3 * contains(lower(content), 'small')::int
    + CASE WHEN days <= 50 THEN 0.2 * exp(-2.0::double * days / 50) ELSE 0 END + ln(1 + uses * 0.1::double) + 0.01::double * edges, 8)::double AS score FROM i""",
)
def rerank_by_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = rerank.Factors(name=(1.0, 0.5, 0.3), name_by_type={"class": 2.0}, content=0.3, content_fields={"content": 1.0}, temporal=(0.2, 50.0, "exponential"), popularity=(0.1, 0.0, "log"), custom={"edges": (F.col("edges").cast("double"), 0.01)})
    rows = _items(spark, sf_dir).drop("edges").join(_items(spark, sf_dir).select("id", "edges"), "id").withColumn("popularity", F.lit(0.0))
    return rerank.rerank_by_factors(rows, "Small", f).select("id", F.round("final_score", 8).alias("score"))


_SYN = ", ".join(f"('{k}', '{t}', {i}, 0.9)" for k, v in discovery.SYNONYMS.items() for i, t in enumerate(v)) + ", " + ", ".join(f"('{k}', '{t}', {i}, 0.7)" for k, v in discovery.CONCEPTS.items() for i, t in enumerate(v))


@query("query_expansion", f"WITH d(key, term, k, score) AS (VALUES {_SYN}), q AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN ['parse', 'function', 'handler'] WHEN 1 THEN ['db', 'config'] ELSE ['search', 'index'] END AS ws FROM part), w AS (SELECT id, unnest(ws) AS key, generate_subscripts(ws, 1) AS pos FROM q), b AS (SELECT id, term, min(struct_pack(cost := -score, pos := pos, k := k)) AS best FROM w JOIN d USING (key) GROUP BY id, term), r AS (SELECT id, term, -best.cost AS score, row_number() OVER (PARTITION BY id ORDER BY best) AS place FROM b) SELECT id, term, score::double AS score, place FROM r WHERE place <= 6")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_size") % 3 == 0, "parse theFunction, handler").when(F.col("p_size") % 3 == 1, "db.config").otherwise("search (index)")
    # a small file is read by few tasks, but a row costs much
    asked = table(spark, sf_dir, "part").repartition("p_partkey").select(F.col("p_partkey").alias("id"), text.alias("query"))
    return discovery.expanded(asked, 6).select("id", "term", "score", "place")


@query("suggested_terms", f"WITH {_ITEMS} SELECT name AS term, string_agg(DISTINCT type, ', ' ORDER BY type) AS types, count(*) AS n, round(avg(sim), 6) AS score FROM i WHERE sim >= 0.3 AND name <> 'small widget' GROUP BY name ORDER BY n DESC, avg(sim) DESC, term LIMIT 10")
def suggested_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = discovery.relevant(_items(spark, sf_dir).withColumn("documented", F.lit(False)), 0.3)
    return discovery.suggested_terms(rows, "Small Widget").select("term", "types", "n", F.round("score", 6).alias("score"))


@query("related_concepts", "WITH v AS (SELECT unnest(string_split(lower(p_name), ' ')) AS concept, 1.0 AS w FROM part UNION ALL SELECT unnest(string_split(lower(p_type), ' ')), 0.5 FROM part UNION ALL SELECT lower(p_brand)[1:5], 2.0 FROM part UNION ALL SELECT split_part(lower(p_brand), '#', 2), 2.0 FROM part) SELECT concept, sum(w)::double AS weight FROM v WHERE concept <> 'widget' AND (length(concept) >= 3 OR w = 2.0) GROUP BY concept ORDER BY weight DESC, concept LIMIT 15")
def related_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.when(F.length("p_type") > 3, F.col("p_type")).alias("content"), F.array("p_brand").alias("tags"), F.lit("").alias("path"))
    return discovery.related_concepts(rows, "Widget")


_STOP = "', '".join(terms.STOP_WORDS)


@query("key_terms", f"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(regexp_replace(lower(text), '[^\\w\\s]', ' ', 'g'), '\\s+')) AS term FROM benchmark) WHERE length(term) > 3 AND term NOT IN ('{_STOP}') GROUP BY term")
def key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = terms.words_of_text(F.col("text"), 3, terms.STOP_WORDS)
    return table(spark, sf_dir, "benchmark").select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("item_keywords", f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ('{_STOP}')))), ' ') AS words FROM benchmark")
def item_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(terms.keywords(F.col("text"))), " ").alias("words"))


@query("path_concepts", "SELECT c_custkey, 'customer group' || CASE WHEN c_custkey >= 100 THEN ' ' || c_custkey ELSE '' END AS concepts FROM customer")
def path_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("src/CustomerGroup/"), F.col("c_custkey").cast("string"), F.lit("/customer_of.test"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(terms.path_concepts(path, (*terms.STOP_WORDS, "src")), " ").alias("concepts"))


@query("query_sections", "SELECT c_custkey, 'find ' || c_mktsegment AS q, c_name AS ctx, 'a|b c' AS topics FROM customer")
def query_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("User Query: find "), "c_mktsegment", F.lit("\nSystem Context: "), "c_name", F.lit("\nTopics: a, b c,"))
    s = terms.query_sections(text)
    return table(spark, sf_dir, "customer").select("c_custkey", s["query"].alias("q"), s["context"].alias("ctx"), F.array_join(s["topics"], "|").alias("topics"))


_RAW = "CASE p_size % 6 WHEN 0 THEN 'Invokes' WHEN 1 THEN 'inherits_from' WHEN 2 THEN '' WHEN 3 THEN 'module-contains-class' WHEN 4 THEN 'has' ELSE 'custom' END"
_CANON = "CASE p_size % 6 WHEN 0 THEN 'calls' WHEN 1 THEN 'extends' WHEN 2 THEN 'references' WHEN 3 THEN 'namespace-contains-class' WHEN 4 THEN 'contains' ELSE 'custom' END"


@query("edges_normalised", f"WITH b AS (SELECT p_brand AS src, p_type AS dst, {_CANON} AS type FROM part), v AS (SELECT dst AS src, src AS dst, CASE type WHEN 'calls' THEN 'called_by' WHEN 'extends' THEN 'extended_by' WHEN 'references' THEN 'referenced_by' WHEN 'namespace-contains-class' THEN 'class-belongs-to-namespace' END AS type FROM b) SELECT DISTINCT src, dst, type FROM (SELECT * FROM b UNION ALL SELECT * FROM v WHERE type IS NOT NULL)")
def edges_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst"), F.expr(_RAW).alias("type"))
    return edges.normalised(rows).select("src", "dst", "type")


@query("edges_found", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_suppkey = 3 OR l_suppkey + 1 = 3) AND l_returnflag IN ('A', 'R')")
def edges_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("src"), (F.col("l_suppkey") + 1).cast("string").alias("resolved_src"), F.col("l_partkey").cast("string").alias("dst"), F.col("l_returnflag").alias("type"))
    return edges.find(rows, src="3", types=("A", "R")).select("l_orderkey", "l_linenumber")


@query("edges_by_direction", f"WITH b AS (SELECT DISTINCT p_brand AS src, p_type AS dst, {_CANON} AS type FROM part) SELECT dst AS src, src AS dst, 'called_by' AS type FROM b WHERE type = 'calls'")
def edges_by_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst"), edges.canonical_type(F.expr(_RAW)).alias("type")).distinct()
    return edges.of_type_or_inverse(edges.by_direction(edges.with_inverses(rows), original=False), "calls").select("src", "dst", "type")


@query("edge_strengths", "SELECT l_orderkey, l_linenumber, round(0.4 * CASE l_returnflag WHEN 'A' THEN 0.9 WHEN 'R' THEN 1.0 ELSE 0.5 END + 0.3 * CASE WHEN q = 0 THEN 0.0 WHEN q = 1 THEN 0.3 WHEN q < 5 THEN 0.5 WHEN q < 10 THEN 0.7 WHEN q < 50 THEN 0.85 ELSE 1.0 END + 0.2 * CASE WHEN s % 10 = p % 10 THEN CASE WHEN abs(s - p) < 50 THEN 1.0 WHEN abs(s - p) < 200 THEN 0.8 WHEN abs(s - p) < 500 THEN 0.6 ELSE 0.4 END WHEN s % 10 // 5 = p % 10 // 5 THEN 0.7 ELSE 0.5 END + 0.1 * 0.5, 6)::double AS strength FROM (SELECT *, l_quantity::int AS q, l_suppkey AS s, l_partkey AS p FROM lineitem)")
def edge_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "R", "extends").otherwise("other")
    rows = line.select("l_orderkey", "l_linenumber", F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), kind.alias("type"), F.col("l_quantity").cast("int").alias("uses"), F.lit(None).cast("double").alias("days"))

    def ends(name: str, key: str, mark: str) -> DataFrame:
        at = F.concat(F.lit("src/"), F.expr(f"{key} % 10 div 5").cast("string"), F.lit("/"), F.expr(f"{key} % 10").cast("string"), F.lit(".ts"))
        return table(spark, sf_dir, name).select(F.concat(F.lit(mark), key).alias("id"), at.alias("path"), F.col(key).alias("line"))

    return edges.with_strength(rows, ends("supplier", "s_suppkey", "s").unionByName(ends("part", "p_partkey", "p"))).select("l_orderkey", "l_linenumber", "strength")


@query("edges_matching", "SELECT event_id FROM events WHERE contains(event_type, 'err') OR contains(props, '77')")
def edges_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.matching(table(spark, sf_dir, "events").withColumnRenamed("event_type", "type").withColumnRenamed("props", "metadata"), "77").select("event_id").unionByName(
        edges.matching(table(spark, sf_dir, "events").where("NOT contains(props, '77')").withColumnRenamed("event_type", "type").withColumnRenamed("props", "metadata"), "ERR").select("event_id")
    )


@query("richest_items", "SELECT id, digest FROM (SELECT p_partkey AS id, md5(p_name) AS digest, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY length(p_name) + length(p_type) DESC, p_partkey) AS n FROM part) WHERE n = 1")
def richest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.richest(table(spark, sf_dir, "part"), ["p_brand", "p_size"], ["p_name", "p_type"], ["p_partkey"]).select(F.col("p_partkey").alias("id"), F.md5("p_name").alias("digest"))


def _rules(spark: SparkSession) -> DataFrame:
    schema = "id string, priority int, component_types array<string>, files array<string>, languages array<string>, patterns array<string>, layers array<string>, domains array<string>, least_complexity int, most_complexity int, wants_edges boolean"
    return spark.createDataFrame([("r1", 7, ["class"], ["src/**"], ["ts"], ["wid.et"], ["utility"], [], 2, None, True), ("r2", 3, ["note", "method"], ["**/*.js", "lib/*"], [], ["^cold"], [], ["admin"], None, 3, None)], schema)


_MATCH = """s AS (SELECT p_partkey AS id, p_name AS name, CASE p_size % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'method' ELSE 'note' END AS type, p_partkey % 30 AS e, CASE p_size % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END + least(3, (p_partkey % 30) / 5.0::double) AS c FROM part), k AS (SELECT *, floor(c + 0.5) AS cx FROM s),
    m AS (SELECT id, 'r1' AS rule, 7 AS priority, 0.3 * (type = 'class')::int + 0.2 * (id % 11 <> 0)::int + 0.1 + 0.2 * regexp_matches(name, 'wid.et')::int + 0.1 * (cx >= 2)::int + 0.1 * (e > 0)::int AS score, e, true AS hit FROM k UNION ALL
    SELECT id, 'r2', 3, 0.3 * (type <> 'class')::int + 0.2 + 0.2 * regexp_matches(name, '^cold')::int + 0.1 * (cx <= 3)::int, e, true FROM k)"""


@query("rule_matches", f"WITH {_MATCH} SELECT id AS component_id, rule AS rule_id, round(least(1.0, score * CASE WHEN priority > 5 THEN 1.1 ELSE 1 END * CASE WHEN e > 0 THEN 1.05 ELSE 1 END), 8)::double AS confidence FROM m")
def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.match_scores(_items(spark, sf_dir).withColumn("language", F.lit("ts")).withColumn("code", F.lit(None).cast("string")), _rules(spark))
    return found.select("component_id", "rule_id", F.round("confidence", 8).alias("confidence"))


@query("rules_applicable", f"WITH {_MATCH}, x AS (SELECT id, rule, priority, least(1.0, score * CASE WHEN priority > 5 THEN 1.1 ELSE 1 END * CASE WHEN e > 0 THEN 1.05 ELSE 1 END) AS c FROM m) SELECT id AS component_id, rule AS rule_id, row_number() OVER (PARTITION BY id ORDER BY priority DESC, c DESC, rule) AS place FROM x WHERE c >= 0.55")
def rules_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.match_scores(_items(spark, sf_dir).withColumn("language", F.lit("ts")).withColumn("code", F.lit(None).cast("string")), _rules(spark))
    return rules.applicable(found, 0.55).select("component_id", "rule_id", "place")


@query("file_triggers", "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 0.7 ELSE 0.6 END::double AS sure, CASE p_size % 3 WHEN 0 THEN 0.9 ELSE 0.7 END::double AS typed FROM part")
def file_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = F.array(F.lit("src/**"), F.lit("**/*.md"), F.lit("node_modules/*.js"))
    rows = _items(spark, sf_dir)
    return rows.select(F.col("id").alias("p_partkey"), F.round(rules.file_trigger(patterns, F.col("path")), 6).alias("sure"), rules.type_trigger(F.array(F.lit("class"), F.lit("*")), F.col("type")).alias("typed"))


@query("conflicting_rules", "WITH t AS (SELECT p_brand || p_size AS trigger, p_name AS guidance, min(p_partkey) AS id, count(*) AS members FROM part GROUP BY ALL) SELECT f AS a, id AS b, members FROM (SELECT *, min(id) OVER (PARTITION BY trigger) AS f FROM t) WHERE id <> f")
def conflicting_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.conflicts(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.col("p_size").cast("string")).alias("trigger"), F.col("p_name").alias("guidance")))


@query("workflow_transitions", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'start' ELSE 'anything' END AS transition FROM orders WHERE o_orderpriority LIKE '1%'")
def workflow_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = spark.createDataFrame([(1, "start", "O", "done"), (2, "never", "X", "any"), (3, "anything", "*", "done")], "place int, transition string, `from` string, `to` string")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("current"), F.when(F.col("o_orderpriority").startswith("1"), "done").otherwise("open").alias("target"))
    return rules.transitions(rows, flow)


def _context(spark: SparkSession, sf_dir: str) -> context.Context:
    items = _items(spark, sf_dir).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), "name", "type", F.lit("ts").alias("language"), "path", "content", F.col("similarity").alias("score"))
    e = table(spark, sf_dir, "part").where("p_partkey >= 2").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.expr("p_partkey div 2").cast("string")).alias("dst"), F.when(F.col("p_size") % 2 == 0, "calls").otherwise("contains").alias("type"))
    return context.Context(items, e)


@query("context_filtered", "WITH k AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_size % 3 < 2 AND p_size >= 25) SELECT 'p' || p_partkey AS src, 'p' || p_partkey // 2 AS dst FROM part WHERE p_partkey >= 2 AND 'p' || p_partkey IN (FROM k) AND 'p' || p_partkey // 2 IN (FROM k)")
def context_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = context.chained(_context(spark, sf_dir), {"type": (5, context.filtered(types=("class", "method"))), "score": (1, context.relevant(0.5, 0.0))})
    return found.edges.select("src", "dst")


@query("context_focused", "SELECT 'p' || p_partkey AS id, CASE WHEN p_partkey = 5 THEN p_type ELSE p_type || ' ...' END AS content FROM part WHERE p_partkey = 5 OR (p_partkey >= 2 AND p_size % 2 = 0) OR p_partkey IN (SELECT p_partkey // 2 FROM part WHERE p_partkey >= 2 AND p_size % 2 = 0)")
def context_focused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.focused(_context(spark, sf_dir), ["p5"], ["calls"]).items.select("id", "content")


@query("context_text", "SELECT 'p' || p_partkey AS id, md5(CASE p_size % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'method' ELSE 'note' END || ' ' || p_name || chr(10) || p_type) AS digest FROM part")
def context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.FORMATS["text"](_context(spark, sf_dir).items).select("id", F.md5("body").alias("digest"))


@query("vector_distances_strict", "SELECT a.vec_id, 'Infinity'::double AS other_length, round(list_distance(a.embedding::double[], b.embedding::double[]), 5) AS same FROM embeddings a, embeddings b WHERE b.vec_id = 1")
def vector_distances_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = F.broadcast(rows.where("vec_id = 1").select(F.col("v").alias("q")).limit(1))
    return rows.join(q).select("vec_id", vec.euclidean(F.col("v"), F.slice("q", 1, 3)).alias("other_length"), F.round(vec.euclidean(F.col("v"), F.col("q")), 5).alias("same"))
