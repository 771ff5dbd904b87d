"""Queries as SQL over DataFrames: analytics, joins, hierarchies, windows and incremental processing.

Each text runs in Spark (tables as DataFrames) and, word for word, in other engines with the same tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.registry import query
from quarry.sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_NAME = re.compile(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b")


def _sql(name: str, text: str, other: str | None = None) -> None:
    """Registers a query of SQL text; `other` is the text for engines of another dialect."""
    names = sorted({m[2] for m in _NAME.finditer(text)})
    spark_text = _NAME.sub(lambda m: f"{m[1]} {{{m[2]}}}", text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(spark_text, **{n: table(spark, sf_dir, n) for n in names})

    run.__name__ = name
    query(name, other or text)(run)


# Aggregations and statistics.
_sql("counts_by_type", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
_sql("language_breakdown", "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL AND lang <> '' GROUP BY lang")
_sql("distinct_sources", "SELECT count(DISTINCT source) AS sources, count(*) AS documents, count(DISTINCT lang) AS langs FROM documents")
_sql("top_types", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
_sql("embeddings_by_type", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
_sql("dashboard", "SELECT (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM lineitem) AS edges, (SELECT count(*) FROM documents) AS docs, (SELECT count(DISTINCT lang) FROM documents) AS langs, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM conversations) AS turns")
_sql("rule_analytics", """SELECT u.user_id, count(e.event_id) AS uses, sum(CASE WHEN e.event_type = 'purchase' THEN 1 ELSE 0 END) AS accepted, sum(CASE WHEN e.event_type = 'error' THEN 1 ELSE 0 END) AS rejected,
    round(sum(e.value), 2) AS total_value, CASE WHEN count(e.event_id) = 0 THEN 0.0 ELSE round(CAST(sum(CASE WHEN e.event_type = 'purchase' THEN 1 ELSE 0 END) AS double) / count(e.event_id), 4) END AS rate
    FROM (SELECT DISTINCT user_id FROM events) AS u LEFT JOIN (SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('purchase', 'error', 'click')) AS e ON u.user_id = e.user_id GROUP BY u.user_id""")
_sql("usage_decay", "SELECT user_id, CAST(floor(count(*) * power(CAST(0.98 AS double), CAST(count(DISTINCT event_type) AS double))) AS bigint) AS decayed, count(*) AS usage FROM events GROUP BY user_id")
_sql("degree_stats", "SELECT round(avg(degree), 6) AS avg_degree, max(degree) AS max_degree, min(degree) AS min_degree FROM (SELECT l_suppkey, count(DISTINCT l_partkey) AS degree FROM lineitem GROUP BY l_suppkey) AS d")
_sql("cohesion_coupling", """WITH e AS (SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
    m AS (SELECT n_nationkey, n_regionkey FROM nation), t AS (SELECT a.n_regionkey AS sr, b.n_regionkey AS dr FROM e JOIN m AS a ON e.src = a.n_nationkey JOIN m AS b ON e.dst = b.n_nationkey),
    n AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey), i AS (SELECT sr, count(*) AS inside FROM t WHERE sr = dr GROUP BY sr), x AS (SELECT r, count(*) AS across FROM (SELECT sr AS r FROM t WHERE sr <> dr UNION ALL SELECT dr FROM t WHERE sr <> dr) AS u GROUP BY r), a AS (SELECT count(*) AS total FROM t)
    SELECT r_name, round(CAST(coalesce(inside, 0) AS double) / (n * (n - 1)), 6) AS cohesion, round(CAST(coalesce(across, 0) AS double) / total, 6) AS coupling FROM region JOIN n ON n.n_regionkey = r_regionkey LEFT JOIN i ON i.sr = r_regionkey LEFT JOIN x ON x.r = r_regionkey CROSS JOIN a""")
_sql("confidence_histogram", "SELECT CAST(floor(l_discount * 100 / 2) AS bigint) AS bucket, l_returnflag, count(*) AS n FROM lineitem GROUP BY CAST(floor(l_discount * 100 / 2) AS bigint), l_returnflag")
_sql("completion_share", "SELECT o_custkey, count(*) AS children, CAST(round(100.0 * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*)) AS bigint) AS done_percent FROM orders GROUP BY o_custkey")
_sql("rollup_by_region_nation", "SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
_sql("language_insight", "SELECT lang, count(*) AS docs, count(DISTINCT source) AS sources, round(avg(n_chars), 2) AS mean_chars, max(n_chars) AS longest, sum(CASE WHEN n_chars < 200 THEN 1 ELSE 0 END) AS short_docs FROM documents GROUP BY lang")

# Joins.
_sql("stale_embeddings", "SELECT d.doc_id FROM documents AS d LEFT JOIN embeddings AS e ON d.doc_id = e.vec_id WHERE e.vec_id IS NULL OR e.label <> d.n_chars % 10")
_sql("orphan_edges", "SELECT 'missing_document' AS problem, l.doc_id AS id FROM labels AS l LEFT JOIN documents AS d ON l.doc_id = d.doc_id WHERE d.doc_id IS NULL UNION ALL SELECT 'missing_label', d.doc_id FROM documents AS d LEFT JOIN labels AS l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL")
_sql("tasks_of_done_parents", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND o_orderstatus <> 'F' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 50")
_sql("late_materialisation", "SELECT t.vec_id, t.label, d.lang, d.source FROM (SELECT vec_id, label FROM embeddings ORDER BY label DESC, vec_id LIMIT 50) AS t JOIN documents AS d ON t.vec_id = d.doc_id")
_sql("name_to_id_first_wins", "SELECT p_name, min(p_partkey) AS id FROM part GROUP BY p_name")
_sql("containment_edges", "SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'owns' ELSE 'contains' END AS type, c_custkey AS parent, o_orderkey AS child FROM customer JOIN orders ON c_custkey = o_custkey")
_sql("range_containment", "SELECT p.p_partkey, b.low, b.high FROM part AS p JOIN (SELECT low, low + 4 AS high, (low + k) AS at FROM (SELECT DISTINCT p_size AS low FROM part) AS s CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) AS ks) AS b ON p.p_size = b.at WHERE p.p_retailprice > 1500")
_sql("smallest_enclosing_interval", "SELECT p_partkey, low, high FROM (SELECT p_partkey, low, high, row_number() OVER (PARTITION BY p_partkey ORDER BY high - low, low) AS n FROM part JOIN (SELECT low, high, low + k AS at FROM (SELECT p_size AS low, p_size + 1 + p_size % 7 AS high FROM part GROUP BY p_size) AS i CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) AS ks WHERE low + k < high) AS b ON p_size = b.at) AS r WHERE n = 1")
_sql("cross_language_edges", "SELECT a.lang AS from_lang, b.lang AS to_lang, count(*) AS n FROM (SELECT source, lang FROM documents) AS a JOIN (SELECT DISTINCT source, lang FROM documents) AS b ON a.source = b.source WHERE a.lang <> b.lang GROUP BY a.lang, b.lang")
# By default a small file is broadcast, and the few tasks that read the other side then make all pairs.
_sql("rule_conflicts", "SELECT /*+ MERGE(a, b) */ a.p_partkey AS a, b.p_partkey AS b FROM part AS a JOIN part AS b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size WHERE a.p_partkey < b.p_partkey AND a.p_name <> b.p_name", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part AS a JOIN part AS b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size WHERE a.p_partkey < b.p_partkey AND a.p_name <> b.p_name")
_sql("bidirectional_links", "SELECT s_suppkey AS a, p_partkey AS b FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 45 UNION SELECT s_suppkey, p_partkey FROM part JOIN supplier ON p_size = s_suppkey")
_sql("longest_prefix_match", "SELECT p_partkey, prefix FROM (SELECT p_partkey, prefix, row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC, prefix) AS n FROM part JOIN (SELECT DISTINCT substr(p_type, 1, k) AS prefix FROM part CROSS JOIN (SELECT 4 AS k UNION ALL SELECT 8 UNION ALL SELECT 12) AS ks) AS q ON substr(p_type, 1, length(prefix)) = prefix AND substr(p_type, 1, 4) = substr(prefix, 1, 4)) AS r WHERE n = 1")
_sql("json_filter", "SELECT event_id, CAST(get_json_object(props, '$.k') AS bigint) AS k FROM events WHERE CAST(get_json_object(props, '$.k') AS bigint) >= 50", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS bigint) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS bigint) >= 50")
_sql("unresolved_targets", "SELECT event_id FROM events WHERE event_type LIKE 'err%' AND (props IS NULL OR get_json_object(props, '$.k') <> '1')", "SELECT event_id FROM events WHERE event_type LIKE 'err%' AND (props IS NULL OR json_extract_string(props, '$.k') <> '1')")

# Filters, limits and sets.
_sql("page_with_total", "SELECT o_orderkey, total, total > 60 AS has_more FROM (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 40) AS t CROSS JOIN (SELECT count(*) AS total FROM orders WHERE o_orderpriority = '1-URGENT') AS c")
_sql("degradation_candidates", "SELECT user_id, last_used, uses FROM (SELECT user_id, max(ts) AS last_used, count(*) AS uses, avg(value) AS effectiveness FROM events GROUP BY user_id) AS r WHERE uses < 60 OR effectiveness < 40")
_sql("next_tasks", "SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 25")
_sql("path_filter", "SELECT page_id, url FROM pages WHERE (url LIKE '%a%' OR url LIKE '%news%') AND url NOT LIKE '%admin%'")
_sql("split_budget", "SELECT * FROM (SELECT 'part' AS kind, p_partkey AS id FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5) AS a UNION ALL SELECT * FROM (SELECT 'customer', c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) AS b UNION ALL SELECT * FROM (SELECT 'supplier', s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5) AS c")
_sql("neighbour_union", "SELECT l_partkey AS id FROM lineitem WHERE l_suppkey = 1 UNION SELECT l_partkey FROM lineitem WHERE l_suppkey = 2")
_sql("drift_lost_and_new", "SELECT 'lost' AS kind, user_id FROM (SELECT user_id FROM events WHERE event_type = 'signup' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase') AS a UNION ALL SELECT 'new', user_id FROM (SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'signup') AS b")
_sql("id_short_circuit", "SELECT doc_id, lang, CAST(1 AS double) AS score FROM documents WHERE doc_id = 42")
_sql("min_retention_filter", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= (SELECT least(1900, min(p_retailprice)) FROM (SELECT p_retailprice FROM part ORDER BY p_retailprice DESC LIMIT 20) AS t)")

# Windows.
_sql("type_cap", "SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) AS t WHERE n <= 3")
_sql("token_budget_prefix", "SELECT doc_id, n_chars, running FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) AS t WHERE running <= 4000", "SELECT doc_id, n_chars, CAST(running AS bigint) AS running FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) AS t WHERE running <= 4000")
_sql("max_confidence_dedup", "SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM (SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_discount DESC, l_orderkey, l_linenumber) AS n FROM lineitem) AS t WHERE n = 1")
_sql("top_evidence_per_edge", "SELECT l_suppkey, l_partkey, l_orderkey, n FROM (SELECT l_suppkey, l_partkey, l_orderkey, CAST(row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS int) AS n FROM lineitem) AS t WHERE n <= 2")
_sql("previous_row_dependency", "SELECT conv_id, turn, previous_turn FROM (SELECT conv_id, turn, role, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_turn FROM conversations) AS t WHERE role = 'assistant' AND previous_turn IS NOT NULL")
_sql("topic_recency", "SELECT user_id, round(count(*) - date_diff(SECOND, date_trunc('SECOND', max(ts)), TIMESTAMP_NTZ '2025-01-01 00:00:00') / CAST(1000 AS double), 6) AS score FROM events GROUP BY user_id ORDER BY score DESC, user_id LIMIT 20", "SELECT user_id, round(count(*) - date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2025-01-01 00:00:00') / CAST(1000 AS double), 6) AS score FROM events GROUP BY user_id ORDER BY score DESC, user_id LIMIT 20")
_sql("session_topics", "SELECT user_id, CAST(session AS bigint) AS session, count(*) AS n, min(ts) AS started FROM (SELECT user_id, ts, sum(CASE WHEN gap IS NULL OR gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT user_id, ts, event_id, timestampdiff(SECOND, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM events) AS g) AS s GROUP BY user_id, session", "SELECT user_id, CAST(session AS bigint) AS session, count(*) AS n, min(ts) AS started FROM (SELECT user_id, ts, sum(CASE WHEN gap IS NULL OR gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT user_id, ts, event_id, trunc(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS gap FROM events) AS g) AS s GROUP BY user_id, session")
_sql("running_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS mean_so_far FROM events")

# Hierarchies and dependency graphs.
_sql("members_of_region", "SELECT 'nation' AS kind, CAST(n_nationkey AS bigint) AS id, 1 AS depth FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'customer', c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'order', o_orderkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
_sql("order_places", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders")
_sql("effort_of_customers", "SELECT o_custkey, count(*) AS steps, round(sum(o_totalprice), 2) AS effort FROM orders GROUP BY o_custkey")
_sql("orders_behind_open_ones", "SELECT o_orderkey FROM (SELECT o_orderkey, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) AS t WHERE before IS NOT NULL AND before <> 'F'")
_sql("places_of_customers", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")

# Upserts and incremental processing.
_sql("upsert_last_wins", "SELECT user_id, event_type, value FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) AS t WHERE n = 1")
_sql("cascading_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal < 0 AND s_suppkey = l_suppkey)")
_sql("bulk_patch", "SELECT c_custkey, coalesce(p.total, c_acctbal) AS balance FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) AS p ON c_custkey = p.o_custkey")
_sql("content_hash", "SELECT doc_id, sha2(text, 256) AS content_hash FROM documents", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
_sql("token_estimates", "SELECT doc_id, CAST(ceil(char_length(text) / 4.0) AS bigint) AS tokens, char_length(text) AS chars FROM documents", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS bigint) AS tokens, length(text) AS chars FROM documents")
_sql("merged_notes", "SELECT conv_id, md5(array_join(transform(array_sort(collect_list(struct(turn, text))), x -> x.text), '|')) AS digest, max(turn) AS last_turn FROM conversations GROUP BY conv_id", "SELECT conv_id, md5(string_agg(text, '|' ORDER BY turn, text)) AS digest, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
_sql("sliding_chunks", "SELECT item_id, CAST(k AS bigint) AS chunk, substr(text, CAST(k * 80 + 1 AS int), 100) AS body FROM (SELECT item_id, text, explode(sequence(0, CAST(floor((greatest(char_length(text), 1) - 1) / 80) AS int))) AS k FROM benchmark) AS t", "SELECT item_id, CAST(k AS bigint) AS chunk, substr(text, k * 80 + 1, 100) AS body FROM (SELECT item_id, text, unnest(range(0, CAST(floor((greatest(length(text), 1) - 1) / 80) AS bigint) + 1)) AS k FROM benchmark) AS t")
_sql("tumbling_windows", "SELECT date_trunc('HOUR', ts) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY date_trunc('HOUR', ts), event_type")
