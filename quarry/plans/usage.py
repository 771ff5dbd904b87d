"""Queries of scopes and flows: lines of code are lines of orders, statements are events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import usage
from quarry.plans.registry import query
from quarry.sources.tables import table

_WHERE = "l_orderkey % 40"
_LINES = f"""s AS (SELECT {_WHERE} AS f, row_number() OVER (PARTITION BY {_WHERE} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line, l_orderkey AS o, l_partkey AS p, l_suppkey AS q FROM lineitem),
    l AS (SELECT 'f' || f || '.py' AS file, line, CASE o % 11 WHEN 0 THEN 'class C' || p % 5 WHEN 1 THEN '  def m' || p % 9 || '(self):' WHEN 2 THEN 'def m' || q % 9 || ' (x):' WHEN 3 THEN '  # nothing'
      WHEN 4 THEN '    self.run' || p % 3 || '(m' || q % 9 || '(v' || p % 6 || '))' WHEN 5 THEN '    m' || p % 12 || '(a.b' || q % 3 || ', v' || q % 6 || ')' ELSE '  v' || p % 8 || ' = obj.field' || q % 4 || ' and v' || q % 8 END AS text FROM s)"""
_SCOPED = f"""{_LINES}, n AS (SELECT *, nullif(regexp_extract(text, '^class\\s+(\\w+)', 1), '') AS c, nullif(regexp_extract(text, '^\\s*def\\s+(\\w+)\\s*\\(', 1), '') AS m FROM l),
    z AS (SELECT *, last_value(c IGNORE NULLS) OVER w AS class, nullif(last_value(CASE WHEN c IS NOT NULL THEN '' ELSE m END IGNORE NULLS) OVER w, '') AS method FROM n WINDOW w AS (PARTITION BY file ORDER BY line))"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    of = lambda *parts: "concat(" + ", ".join(parts) + ")"
    text = F.expr(f"""CASE l_orderkey % 11 WHEN 0 THEN {of("'class C'", "l_partkey % 5")} WHEN 1 THEN {of("'  def m'", "l_partkey % 9", "'(self):'")} WHEN 2 THEN {of("'def m'", "l_suppkey % 9", "' (x):'")} WHEN 3 THEN '  # nothing'
        WHEN 4 THEN {of("'    self.run'", "l_partkey % 3", "'(m'", "l_suppkey % 9", "'(v'", "l_partkey % 6", "'))'")} WHEN 5 THEN {of("'    m'", "l_partkey % 12", "'(a.b'", "l_suppkey % 3", "', v'", "l_suppkey % 6", "')'")}
        ELSE {of("'  v'", "l_partkey % 8", "' = obj.field'", "l_suppkey % 4", "' and v'", "l_suppkey % 8")} END""")
    order = F.expr("row_number() OVER (PARTITION BY l_orderkey % 40 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)")
    return rows.select(F.expr("concat('f', l_orderkey % 40, '.py')").alias("file"), order.alias("line"), text.alias("text"))


@query("lines_scoped", f"WITH {_SCOPED} SELECT file, line, CASE WHEN c IS NOT NULL THEN 'class' WHEN m IS NOT NULL THEN 'method' END AS opens, class, method FROM z")
def lines_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and the method of each line; 40 files, however long."""
    return usage.scoped(_lines(spark, sf_dir), usage.PYTHON, chunks=16).select("file", "line", "opens", "class", "method")


@query("usage_edges", f"""WITH {_SCOPED}, k AS (SELECT DISTINCT file, 'f' || hash_ AS x, name, kind, id FROM (SELECT file, '' AS hash_, n AS name, k AS kind, file || ':' || n AS id FROM (SELECT DISTINCT file FROM l), (SELECT 'm' || unnest(range(10)) AS n, 'callable' AS k UNION ALL SELECT 'v' || unnest(range(6)), 'variable'))),
    i AS (SELECT z.*, k.id AS src FROM z JOIN k ON k.file = z.file AND k.name = z.method AND k.kind = 'callable' WHERE c IS NULL AND m IS NULL),
    f AS (SELECT *, 'function_call' AS usage, unnest(regexp_extract_all(text, '(\\w+)\\s*\\(', 1)) AS name FROM i UNION ALL SELECT *, 'variable_reference', unnest(regexp_extract_all(text, '\\w+')) FROM i),
    a AS (SELECT *, 'method_call' AS usage, unnest(regexp_extract_all(text, '(\\w+)\\.(\\w+)\\s*\\(', 1)) || '.' || unnest(regexp_extract_all(text, '(\\w+)\\.(\\w+)\\s*\\(', 2)) AS dst FROM i
      UNION ALL SELECT *, 'property_access', unnest(list_transform(regexp_extract_all(text, '\\w+\\.\\w+\\s*\\(?'), lambda x: CASE WHEN x LIKE '%(' THEN substr(rtrim(x, '('), 1, length(rtrim(x, '(')) - 1) ELSE rtrim(x) END)) FROM i)
    SELECT DISTINCT src, k.id AS dst, CASE usage WHEN 'function_call' THEN 'calls' ELSE 'uses' END AS type, usage, line, class, method FROM f JOIN k ON k.file = f.file AND k.name = f.name AND k.kind = CASE usage WHEN 'function_call' THEN 'callable' ELSE 'variable' END
      WHERE (usage = 'variable_reference' OR k.id <> src) AND (usage = 'function_call' OR (f.name <> method AND f.name <> 'and'))
    UNION ALL SELECT DISTINCT src, 'UNRESOLVED:' || dst, CASE usage WHEN 'method_call' THEN 'calls' ELSE 'uses' END, usage, line, class, method FROM a""")
def usage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, members and variables of each method's lines."""
    lines = _lines(spark, sf_dir)
    names = F.concat(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.struct(F.concat(F.lit("m"), k.cast("string")).alias("name"), F.lit("method").alias("type"))), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.struct(F.concat(F.lit("v"), k.cast("string")).alias("name"), F.lit("variable").alias("type"))))
    components = lines.select("file").distinct().select("file", F.explode(names).alias("x")).select("file", F.concat_ws(":", "file", "x.name").alias("id"), "x.*", F.lit(0).alias("place"))
    return usage.usage_edges(lines, components, usage.PYTHON, chunks=16)


_KINDS = "['derives', 'returns', 'passes', 'read', 'write', 'modify', 'transforms', 'awaits', 'observes', 'other']"


@query("flow_edges", f"""WITH e AS (SELECT event_id AS seq, CASE WHEN user_id % 4 > 0 THEN user_id END AS scope, {_KINDS}[1 + event_id % 10] AS kind, 'c' || user_id % 30 AS a, CASE WHEN event_id % 13 > 0 THEN 'c' || (event_id // 10) % 25 END AS b FROM events),
    f AS (SELECT *, kind IN ('derives', 'passes', 'transforms') AS back FROM e WHERE kind <> 'other' AND b IS NOT NULL AND (scope IS NOT NULL OR kind IN ('transforms', 'awaits', 'observes')))
    SELECT CASE WHEN back THEN b ELSE a END AS src, CASE WHEN back THEN a ELSE b END AS dst, CASE kind WHEN 'derives' THEN 'derives_from' WHEN 'returns' THEN 'returns_from' WHEN 'passes' THEN 'passes_to' WHEN 'read' THEN 'reads_from' WHEN 'write' THEN 'writes_to' WHEN 'modify' THEN 'modifies' WHEN 'transforms' THEN 'transforms_data' ELSE kind END AS type, min(seq) AS seq FROM f GROUP BY ALL""")
def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of statements, each once."""
    kinds = F.array(*(F.lit(k) for k in ("derives", "returns", "passes", "read", "write", "modify", "transforms", "awaits", "observes", "other")))
    c = lambda n: F.concat(F.lit("c"), n.cast("string"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.when(F.col("user_id") % 4 > 0, F.col("user_id")).alias("scope"), F.get(kinds, (F.col("event_id") % 10).cast("int")).alias("kind"), c(F.col("user_id") % 30).alias("at"), F.when(F.col("event_id") % 13 > 0, c(F.expr("(event_id div 10) % 25"))).alias("other"))
    return usage.flow_edges(rows)


@query("variable_flows", """WITH RECURSIVE a AS (SELECT event_id AS seq, 1 + user_id % 40 AS scope, 'n' || user_id % 3 AS name, event_type, 'c' || event_id % 50 AS node FROM events),
    up AS (SELECT scope, scope AS around, 0 AS level FROM (SELECT DISTINCT scope FROM a) UNION ALL SELECT scope, around // 2, level + 1 FROM up WHERE around // 2 > 0 AND around // 2 IN (SELECT scope FROM a)),
    w AS (SELECT seq, scope AS around, name, node AS writer FROM a WHERE event_type = 'purchase'), r AS (SELECT a.seq, around, name, level, node FROM a JOIN up USING (scope) WHERE event_type <> 'purchase'),
    j AS (SELECT r.seq, r.node, r.name, level, writer FROM r ASOF JOIN w ON r.around = w.around AND r.name = w.name AND r.seq > w.seq)
    SELECT src, dst, 'uses_field' AS type, name, min(seq) AS seq FROM (SELECT seq, node AS dst, name, arg_min(writer, level) AS src FROM j GROUP BY ALL) GROUP BY ALL""")
def variable_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write that each read sees, in the innermost scope around it that has one."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 40 + 1).alias("scope"), F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("name"), F.when(F.col("event_type") == "purchase", "write").otherwise("read").alias("kind"), F.concat(F.lit("c"), (F.col("event_id") % 50).cast("string")).alias("node"))
    scopes = rows.select("scope").distinct().select("scope", F.expr("scope div 2").alias("parent"))
    return usage.variable_flows(rows, scopes, chunks=16)
