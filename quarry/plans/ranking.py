"""Queries that score, classify, tag and shorten items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import ranking as rk
from quarry.plans.registry import query
from quarry.sources.tables import table


def _sql_any(texts: tuple[str, ...], needles: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"coalesce(contains({t}, '{n}'), false)" for t in texts for n in needles) + ")"


@query("layer_and_domain", "SELECT page_id, CASE " + " ".join(f"WHEN {_sql_any(('lower(url)',), p)} OR {_sql_any(('lower(title)',), n)} THEN '{k}'" for k, (p, n) in rk.LAYERS.items()) + " END AS layer, CASE " + " ".join(f"WHEN {_sql_any(('lower(url)', 'lower(html)'), n)} THEN '{k}'" for k, n in rk.DOMAINS.items()) + " END AS domain FROM (SELECT *, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages)")
def layer_and_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", rk.architectural_layer(F.col("url"), title).alias("layer"), rk.business_domain(F.col("url"), title, F.col("html")).alias("domain"))


@query("tags_of_texts", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(text, '#(\\w+)', 1), lambda x: lower(x)), list_filter(['" + "', '".join(rk.TERMS) + "'], lambda t: contains(lower(text), t))))), ',') AS tags, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_sql_any(('text',), n)} THEN '{k}' END" for k, n in rk.PATTERNS.items()) + "], lambda x: x IS NOT NULL), ',') AS patterns FROM documents")
def tags_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(rk.auto_tags(text)), ",").alias("tags"), F.array_join(rk.pattern_tags(text), ",").alias("patterns"))


@query("specifier_classes", "SELECT class, count(*) AS n FROM (SELECT CASE WHEN s = '' OR s LIKE '{%' OR s LIKE '[%' OR s LIKE '%class:%' OR s LIKE '%file:%' THEN 'junk' WHEN contains(s, chr(92)) AND NOT contains(s, '/') THEN 'namespace' WHEN contains(s, chr(92)) OR s LIKE './%' OR s LIKE '../%' OR s LIKE '/%' THEN 'path' WHEN contains(s, chr(10)) OR contains(s, chr(13)) THEN 'junk' ELSE 'bare' END AS class FROM (SELECT trim(unnest(list_concat(regexp_extract_all(html, '\\w+=\"([^\"]*)\"', 1), [regexp_replace(url, '^https?://[^/]*', ''), replace(url, '/', chr(92)), url]))) AS s FROM pages)) GROUP BY class")
def specifier_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributes = F.regexp_extract_all("html", F.lit('\\w+="([^"]*)"'), F.lit(1))
    specs = F.concat(attributes, F.array(F.regexp_replace("url", "^https?://[^/]*", ""), F.replace("url", F.lit("/"), F.lit("\\")), F.col("url")))
    return table(spark, sf_dir, "pages").select(F.explode(specs).alias("s")).groupBy(rk.specifier_class(F.col("s")).alias("class")).agg(F.count("*").alias("n"))


@query("name_similarity", "SELECT p_partkey, a = b AS exact, CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.8 ELSE 0.0 END::double AS partial, round(CASE WHEN a = b THEN 1.0 ELSE len(list_intersect(x, y))::double / len(list_distinct(list_concat(x, y))) END, 6)::double AS fuzzy FROM (SELECT *, list_distinct(string_split_regex(a, '\\s+')) AS x, list_distinct(string_split_regex(b, '\\s+')) AS y FROM (SELECT p.p_partkey, trim(lower(p.p_name)) AS a, trim(lower(q.p_name)) AS b FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1))")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("after"))
    found = part.join(after, "p_partkey").select("p_partkey", rk.text_similarity(F.col("p_name"), F.col("after")).alias("s"))
    return found.select("p_partkey", "s.exact", "s.partial", F.round("s.fuzzy", 6).alias("fuzzy"))


@query("text_highlights", "SELECT doc_id, array_to_string(list_transform((list_filter(list_filter(string_split_regex(text, '[.!?]+'), lambda s: trim(s) <> ''), lambda s: contains(lower(s), 'market') OR contains(lower(s), 'data')))[1:3], lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), '|') AS hits FROM documents")
def text_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(rk.highlights(F.col("text"), ["Market", "data"]), "|").alias("hits"))


@query("summaries", "SELECT conv_id, turn, CASE WHEN length(text) <= 60 THEN text ELSE CASE WHEN said = '' THEN substr(text, 1, 57) ELSE said END || '...' END AS summary FROM (SELECT *, coalesce(array_to_string(list_transform(list_filter(list_transform(s, lambda x, i: {'x': x, 'upto': list_sum(list_transform(s[1:i], lambda y: length(y) + 1))}), lambda z: z.upto <= 57), lambda z: z.x || '.'), ''), '') AS said FROM (SELECT *, string_split_regex(text, '[.!?]+') AS s FROM conversations))")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rk.summarised(F.col("text"), 60).alias("summary"))


@query("tokens_by_form", "SELECT doc_id, " + ", ".join(f"ceil(length(coalesce(text, '')) / {c}::double)::bigint AS as_{f}" for f, c in rk.CHARS_PER_TOKEN.items()) + " FROM documents")
def tokens_by_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[rk.estimated_tokens(F.col("text"), f).alias(f"as_{f}") for f in rk.CHARS_PER_TOKEN])


@query("item_relevance", "SELECT p_partkey, round(CASE WHEN p_size > 25 THEN 8.0 ELSE 5.0 END * CASE WHEN lower(p_name) = 'steel part' THEN 5 ELSE 1 END + " + " + ".join(f"CASE WHEN contains(lower({c}), '{k}') THEN {w} ELSE 0 END" for k in ("steel", "part") for c, w in (("p_name", 2.0), ("p_type", 1.0), ("p_brand", 0.1))) + ", 6)::double AS relevance FROM part")
def item_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("p_size") > 25, 8.0).otherwise(5.0)
    score = rk.relevance(weight, F.col("p_name"), F.col("p_type"), F.col("p_brand"), "Steel Part", ["steel", "part"])
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("relevance"))


@query("edge_importance", "SELECT id, round(0.6 * least(count(*) / 10.0::double, 1) + 0.4 * least(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / 5.0::double, 1), 6)::double AS importance FROM (SELECT l_suppkey AS id, l_returnflag FROM lineitem UNION ALL SELECT -l_partkey, l_returnflag FROM lineitem) GROUP BY id")
def edge_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.explode(F.array("l_suppkey", -F.col("l_partkey"))).alias("id"), "l_returnflag")
    score = rk.importance(F.count("*"), F.count(F.when(F.col("l_returnflag") == "R", 1)))
    return edges.groupBy("id").agg(F.round(score, 6).alias("importance"))


_BREAKS = rk.KEYWORD_BREAKS.replace("'", "''")


@query("keywords_of_texts", f"SELECT item_id, n AS place, word FROM (SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, min(pos)) AS n FROM (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT item_id, string_split_regex(lower(text), '{_BREAKS}') AS w FROM benchmark)) WHERE length(word) > 2 AND word NOT IN {rk.KEYWORD_STOPS} GROUP BY item_id, word) WHERE n <= 10")
def keywords_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(F.lower("text"), rk.KEYWORD_BREAKS)).alias("at", "word"))
    counted = words.where((F.length("word") > 2) & ~F.col("word").isin(*rk.KEYWORD_STOPS)).groupBy("item_id", "word").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("n"), "first")).cast("long")
    return counted.select("item_id", place.alias("place"), "word").where("place <= 10")


@query("rule_confidences", "SELECT user_id, round(least(0.5 * (0.8 + 0.2 * avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END)) * CASE WHEN count(*) > 10 THEN 1.05 ELSE 1 END, 1), 6)::double AS confidence FROM events GROUP BY user_id")
def rule_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.avg(F.when(F.col("event_type") == "error", 0.0).otherwise(1.0))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(rk.rule_confidence(good, F.count("*")), 6).alias("confidence"))


@query("tag_classes", "SELECT tag, CASE WHEN tag LIKE 'auto:%' OR tag LIKE 'lang:%' OR tag LIKE 'type:%' OR tag LIKE '%generated%' THEN 'auto' WHEN tag LIKE 'context:%' OR tag LIKE 'location:%' OR tag LIKE '%session%' OR tag LIKE '%temp%' THEN 'contextual' WHEN tag IS NOT NULL THEN 'stable' END AS class, count(*) AS n FROM (SELECT 'lang:' || lang AS tag FROM documents UNION ALL SELECT source FROM documents UNION ALL SELECT 'context:' || source FROM documents) GROUP BY tag")
def tag_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(F.concat(F.lit("lang:"), "lang"), "source", F.concat(F.lit("context:"), "source"))
    return table(spark, sf_dir, "documents").select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).select("tag", rk.tag_class(F.col("tag")).alias("class"), "n")


@query("rendered_templates", "SELECT o_orderkey, 'task ' || o_orderkey || ': ' || CASE WHEN o_orderstatus = 'F' THEN '{{intent}}' ELSE o_orderpriority END AS body FROM orders")
def rendered_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"task_id": F.col("o_orderkey").cast("string"), "intent": F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))}
    return table(spark, sf_dir, "orders").select("o_orderkey", rk.rendered(F.lit("task {{task_id}}: {{intent}}"), values).alias("body"))


@query("hash_vectors", "SELECT item_id, list_transform(raw, lambda x: round(x / sqrt(list_sum(list_transform(raw, lambda y: y * y))), 6)) AS v FROM (SELECT item_id, list_transform(range(16), lambda k: ('0x' || substr(sha256(text), 4 * k + 1, 4))::int / 32767.5::double - 1) AS raw FROM benchmark)")
def hash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.transform(rk.hash_vector(F.col("text")), lambda x: F.round(x, 6)).alias("v"))


@query("pattern_mining", "SELECT * FROM (SELECT user_id, 'factory' AS pattern, 0.8::double AS confidence FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'purchase') >= 2 UNION ALL SELECT user_id, 'observer', 0.85 FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'signup') > 0 AND count(*) FILTER (event_type = 'view') > 0)")
def pattern_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    def times(kind: str):
        return F.count(F.when(F.col("event_type") == kind, 1))

    found = F.array(F.when(F.col("made") >= 2, F.struct(F.lit("factory").alias("pattern"), F.lit(0.8).alias("confidence"))), F.when((F.col("joined") > 0) & (F.col("seen") > 0), F.struct(F.lit("observer").alias("pattern"), F.lit(0.85).alias("confidence"))))
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(times("purchase").alias("made"), times("signup").alias("joined"), times("view").alias("seen"))
    return users.select("user_id", F.explode(F.array_compact(found)).alias("p")).select("user_id", "p.pattern", "p.confidence")


@query("edge_endpoints", "SELECT l_orderkey, l_linenumber, coalesce(nullif(CASE WHEN l_returnflag = 'A' THEN '' ELSE p_name END, ''), split_part('part|' || l_partkey, '|', -1)) AS target FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10")
def edge_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    resolved = F.when(F.col("l_returnflag") == "A", "").otherwise(F.col("p_name"))
    last = F.element_at(F.split(F.concat(F.lit("part|"), F.col("l_partkey").cast("string")), r"\|"), -1)
    return table(spark, sf_dir, "lineitem").join(known, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.coalesce(F.nullif(resolved, F.lit("")), last).alias("target"))
