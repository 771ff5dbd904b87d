"""Queries of references, edges' ends and structural patterns: components are parts, files are seven folders of thirty, edges are parts too.

The SQL spells out what each kind of specifier comes to, where the operators fold paths and try endings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import chunking as ch
from quarry.functions import entities as en
from quarry.functions import ranking as rk
from quarry.operators import boolean_search, context, mining, references, task_graph
from quarry.plans.registry import query
from quarry.sources.tables import table

_EXT = "CASE p_partkey % 30 % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '/index.js' END"
_C = f"""c AS (SELECT 'c' || p_partkey AS id, p_partkey AS k, 'N' || p_partkey % 60 AS name, CASE p_size % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 2 THEN 'property' WHEN 3 THEN 'function' ELSE 'file' END AS type,
    'src/m' || p_partkey % 7 || '/f' || p_partkey % 30 || {_EXT} AS path, CASE p_partkey % 30 % 3 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' ELSE 'javascript' END AS language,
    CASE WHEN p_partkey % 5 <> 0 THEN 'c' || p_partkey // 4 END AS parent_id, p_partkey % 97 AS start_line, p_partkey % 97 + p_size AS end_line FROM part)"""


def _c(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    ext = F.expr("CASE k % 30 % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '/index.js' END")
    return rows.select(
        F.expr("concat('c', k)").alias("id"),
        "k",
        F.expr("concat('N', k % 60)").alias("name"),
        F.expr("CASE p_size % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 2 THEN 'property' WHEN 3 THEN 'function' ELSE 'file' END").alias("type"),
        F.concat(F.expr("concat('src/m', k % 7, '/f', k % 30)"), ext).alias("path"),
        F.expr("CASE k % 30 % 3 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' ELSE 'javascript' END").alias("language"),
        F.expr("CASE WHEN k % 5 <> 0 THEN concat('c', k div 4) END").alias("parent_id"),
        F.expr("CAST(k % 97 AS int)").alias("start_line"),
        F.expr("CAST(k % 97 + p_size AS int)").alias("end_line"),
    )


@query("name_and_path_ids", f"WITH {_C} SELECT 'name' AS kind, name AS at, arg_min(id, (start_line, id)) AS id FROM c GROUP BY name UNION ALL SELECT 'path', path, arg_min(id, (start_line, id)) FROM c WHERE type = 'file' GROUP BY path")
def name_and_path_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row in an order wins, by name and by path."""
    c, order = _c(spark, sf_dir), ("start_line", "id")
    names = references.first_by(c, "name", "id", order).select(F.lit("name").alias("kind"), F.col("name").alias("at"), "id")
    return names.unionByName(references.first_by(c, "path", "id", order, F.col("type") == "file").select(F.lit("path").alias("kind"), F.col("path").alias("at"), "id"))


@query("parent_edges", f"""WITH {_C} SELECT p.id AS src, c.id AS dst, CASE WHEN p.type = 'class' AND c.type = 'method' THEN 'class-contains-method' WHEN p.type = 'class' AND c.type = 'property' THEN 'class-contains-property' WHEN p.type = 'file' AND c.type = 'class' THEN 'file-contains-class?' ELSE 'contains' END AS type FROM c JOIN c p ON p.id = c.parent_id""".replace("WHEN p.type = 'file' AND c.type = 'class' THEN 'file-contains-class?' ", ""))
def parent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.parent_edges(_c(spark, sf_dir))


@query("lines_contained", f"""WITH {_C}, b AS (SELECT * FROM c WHERE type = 'class'), m AS (SELECT c.id AS dst, c.type AS inner_, b.id AS src, row_number() OVER (PARTITION BY c.id ORDER BY b.end_line - b.start_line, b.start_line, b.id) AS n
    FROM c JOIN b ON b.path = c.path AND b.id <> c.id AND c.start_line >= b.start_line AND c.end_line <= b.end_line AND NOT (c.start_line = b.start_line AND c.end_line = b.end_line) WHERE c.parent_id IS NULL AND c.type <> 'file')
    SELECT src, dst, CASE inner_ WHEN 'method' THEN 'class-contains-method' WHEN 'property' THEN 'class-contains-property' ELSE 'contains' END AS type FROM m WHERE n = 1""")
def lines_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each member to the smallest container whose lines enclose its own."""
    return references.containment(_c(spark, sf_dir))


@query("files_contain", f"WITH {_C}, f AS (SELECT path, min(id) AS src FROM c WHERE type = 'file' GROUP BY path) SELECT src, id AS dst, 'contains' AS type FROM c JOIN f USING (path) WHERE type <> 'file' AND parent_id IS NULL AND k % 3 <> 0")
def files_contain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files contain what nothing else does."""
    c = _c(spark, sf_dir)
    return references.file_contains(c, c.where("k % 3 = 0").select(F.col("id").alias("dst")))


@query("cross_language_ends", f"WITH {_C}, e AS (SELECT 'c' || p_partkey AS src, CASE WHEN p_partkey % 4 = 0 THEN 'RESOLVE:x' ELSE 'c' || p_partkey // 2 END AS dst, CASE WHEN p_partkey % 4 = 0 THEN 'c' || p_partkey // 3 END AS resolved FROM part) SELECT src, b.id AS dst, 'uses' AS type, a.language AS from_language, b.language AS to_language FROM e JOIN c a ON a.id = src JOIN c b ON b.id = coalesce(resolved, dst) WHERE a.language <> b.language")
def cross_language_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "part").selectExpr("concat('c', p_partkey) AS src", "CASE WHEN p_partkey % 4 = 0 THEN 'RESOLVE:x' ELSE concat('c', p_partkey div 2) END AS dst", "CAST(NULL AS string) AS resolved_src", "CASE WHEN p_partkey % 4 = 0 THEN concat('c', p_partkey div 3) END AS resolved_dst", "'uses' AS type")
    return mining.cross_language(e, _c(spark, sf_dir))


@query("targets_unresolved", "SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 > 0 AND p_partkey % 7 IN (0, 2, 4)")
def targets_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RESOLVE: without an id, and not known to be external; metadata that doesn't say leaves an edge out."""
    said = F.expr("CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '{}' WHEN 2 THEN '{\"isExternal\": false}' WHEN 3 THEN '{\"isExternal\": true}' WHEN 4 THEN '{\"isExternal\": 0}' WHEN 5 THEN '{\"isExternal\": 1}' ELSE '{\"isExternal\": null}' END")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'RESOLVE:x' ELSE 'c1' END").alias("dst"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'c2' END").alias("resolved_dst"), said.alias("metadata"))
    return mining.unresolved(rows).select("id")


_S = """CASE k % 9 WHEN 0 THEN './f' || k % 30 WHEN 1 THEN 'react' WHEN 2 THEN 'os' WHEN 3 THEN '{junk}' WHEN 4 THEN '../m' || k % 5 || '/f' || k % 30 || '.ts' WHEN 5 THEN './nowhere' WHEN 6 THEN 'App\\Model' WHEN 7 THEN './none/N' || k % 70 ELSE ' "./f3"; ' END"""


@query("targets_resolved", f"""WITH {_C}, e AS (SELECT k AS id, CASE WHEN k % 11 = 0 THEN 'gone' ELSE id END AS src, path, language, {_S} AS spec, CASE WHEN k % 9 = 5 THEN 'N' || k % 80 END AS imported, k FROM c),
    by_path AS (SELECT path, arg_min(id, ((type <> 'file')::int, id)) AS id FROM c GROUP BY path), by_name AS (SELECT name, arg_min(id, ((type = 'file')::int, id)) AS id FROM c GROUP BY name),
    w AS (SELECT e.*, 'src/m' || k % 7 || CASE WHEN language = 'javascript' THEN '/f' || k % 30 ELSE '' END AS folder FROM e),
    t AS (SELECT w.*, CASE k % 9 WHEN 0 THEN folder || '/f' || k % 30 WHEN 4 THEN CASE WHEN language = 'javascript' THEN 'src/m' || k % 7 ELSE 'src' END || '/m' || k % 5 || '/f' || k % 30 || '.ts' WHEN 8 THEN folder || '/f3' END AS place FROM w),
    r AS (SELECT t.*, coalesce(p0.id, p1.id, p2.id, p3.id) AS hit, n.id AS named FROM t LEFT JOIN by_path p0 ON p0.path = place LEFT JOIN by_path p1 ON p1.path = place || '.ts' LEFT JOIN by_path p2 ON p2.path = place || '.py' LEFT JOIN by_path p3 ON p3.path = place || '/index.js'
      LEFT JOIN by_name n ON n.name = CASE k % 9 WHEN 5 THEN imported WHEN 7 THEN 'N' || k % 70 WHEN 0 THEN 'f' || k % 30 WHEN 8 THEN 'f3' END)
    SELECT id, CASE WHEN src = 'gone' THEN 'unresolved' WHEN k % 9 = 3 THEN 'skippedJunk' WHEN k % 9 IN (1, 2) THEN CASE WHEN language <> 'python' OR k % 9 = 2 THEN 'resolved' ELSE 'skippedExternal' END WHEN k % 9 = 6 OR coalesce(hit, named) IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS status,
      CASE WHEN src = 'gone' OR k % 9 = 3 THEN NULL WHEN k % 9 IN (1, 2) THEN CASE WHEN language <> 'python' THEN 'external:npm:' || spec WHEN k % 9 = 2 THEN 'external:stdlib:python:os' END WHEN k % 9 = 6 THEN 'external:composer:App\\Model' ELSE coalesce(hit, named) END AS resolved_dst FROM r""")
def targets_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifiers of nine kinds, from unknown sources as well."""
    c = _c(spark, sf_dir)
    spec = F.expr("""CASE k % 9 WHEN 0 THEN concat('./f', k % 30) WHEN 1 THEN 'react' WHEN 2 THEN 'os' WHEN 3 THEN '{junk}' WHEN 4 THEN concat('../m', k % 5, '/f', k % 30, '.ts') WHEN 5 THEN './nowhere' WHEN 6 THEN 'App\\\\Model' WHEN 7 THEN concat('./none/N', k % 70) ELSE ' "./f3"; ' END""")
    e = c.select(F.col("k").alias("id"), F.when(F.col("k") % 11 == 0, "gone").otherwise(F.col("id")).alias("src"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("RESOLVE:"), spec)).otherwise(spec).alias("dst"), F.expr("CASE WHEN k % 9 = 5 THEN concat('N', k % 80) END").alias("imported"))
    return references.resolve_targets(e, c).select("id", "status", "resolved_dst")


@query("sources_resolved", f"""WITH {_C}, by_path AS (SELECT path, min(id) AS id FROM c GROUP BY path), by_name AS (SELECT name, min(id) AS id FROM c GROUP BY name),
    r AS (SELECT k, p.id AS placed, n.id AS named FROM c LEFT JOIN by_path p ON k % 6 = 0 AND p.path = 'src/m' || k % 7 || '/f' || k % 30 || '.ts' LEFT JOIN by_name n ON n.name = CASE k % 6 WHEN 2 THEN 'N' || k % 70 WHEN 3 THEN 'N' || k % 70 END)
    SELECT k AS id, CASE WHEN k % 13 = 0 OR k % 6 IN (1, 3) THEN 'external' WHEN k % 6 = 0 AND placed IS NOT NULL OR k % 6 = 2 AND named IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS status,
      CASE WHEN k % 13 = 0 THEN NULL WHEN k % 6 = 0 THEN placed WHEN k % 6 IN (2, 3) THEN named END AS resolved_src FROM r""")
def sources_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _c(spark, sf_dir)
    src = F.expr("""CASE k % 6 WHEN 0 THEN concat('RESOLVE:/src/m', k % 7, '/f', k % 30, '.ts') WHEN 1 THEN 'RESOLVE:react' WHEN 2 THEN concat('RESOLVE:./none/N', k % 70) WHEN 3 THEN concat('EXTERNAL:lib/N', k % 70, '.js') WHEN 4 THEN 'plain' ELSE 'RESOLVE:{junk}' END""")
    e = c.select(F.col("k").alias("id"), src.alias("src"), F.col("id").alias("dst"), (F.col("k") % 13 == 0).alias("is_external"))
    return references.resolve_sources(e, c).select("id", "status", "resolved_src")


@query("calls_by_name", f"""WITH {_C}, d AS (SELECT *, CASE WHEN k % 4 > 0 THEN 'N' || (k + 30) % 60 || ' (1); N' || k % 60 || '(); if (x)' END AS code FROM c)
    SELECT DISTINCT a.id AS src, b.id AS dst, 'calls' AS type, 0.5::double AS confidence FROM d a JOIN d b ON a.path = b.path AND a.id <> b.id AND regexp_matches(a.code, '\\b' || b.name || '\\s*\\(')""")
def calls_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component calls what stands before a bracket in its code."""
    code = F.expr("CASE WHEN k % 4 > 0 THEN concat('N', (k + 30) % 60, ' (1); N', k % 60, '(); if (x)') END")
    return references.call_edges(_c(spark, sf_dir).withColumn("code", code))


@query("inheritance", f"WITH {_C}, n AS (SELECT name, min(id) AS id FROM c GROUP BY name), a AS (SELECT id, 'N' || k % 75 AS name, 'extends' AS type FROM c WHERE type = 'class' UNION ALL SELECT id, 'Api' || k % 3, 'implements' FROM c WHERE type = 'class' AND k % 2 = 0) SELECT a.id AS src, coalesce(n.id, 'RESOLVE:' || name) AS dst, type FROM a LEFT JOIN n USING (name)")
def inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _c(spark, sf_dir).withColumn("extends", F.expr("CASE WHEN type = 'class' THEN array(concat('\\\\N', k % 75)) END")).withColumn("implements", F.expr("CASE WHEN type = 'class' AND k % 2 = 0 THEN array(concat('Api', k % 3)) END"))
    return references.inheritance_edges(names)


@query("class_bases", f"""WITH {_C}, d AS (SELECT id, k, 'C' || k AS name, 'm' || k % 7 AS module FROM c), s AS (SELECT name, min(id) AS id FROM d GROUP BY name HAVING count(*) = 1)
    SELECT d.id AS src, CASE k % 4 WHEN 0 THEN coalesce(f.id, 'RESOLVE:m' || (k // 2) % 7 || '.C' || k // 2) WHEN 1 THEN coalesce(s.id, 'RESOLVE:C' || k // 3) ELSE coalesce(t.id, 'RESOLVE:x.C' || k * 3) END AS dst
    FROM d LEFT JOIN d f ON k % 4 = 0 AND f.name = 'C' || k // 2 LEFT JOIN s ON k % 4 = 1 AND s.name = 'C' || k // 3 LEFT JOIN s t ON k % 4 = 2 AND t.name = 'C' || k * 3 WHERE k % 4 <> 3""".replace("FROM d LEFT JOIN d f", "FROM d LEFT JOIN (SELECT id, name FROM d) f"))
def class_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By full name, within the module, by a short name that is unique; object is no base."""
    bases = F.expr("CASE k % 4 WHEN 0 THEN array(concat('m', (k div 2) % 7, '.C', k div 2)) WHEN 1 THEN array(concat('C', k div 3), 'object') WHEN 2 THEN array(concat('x.C', k * 3)) ELSE array('object') END")
    return references.class_bases(_c(spark, sf_dir).select("id", F.expr("concat('C', k)").alias("name"), F.expr("concat('m', k % 7)").alias("module"), bases.alias("bases")))


@query("qualified_names", f"WITH {_C}, q AS (SELECT 'App\\N' || k % 60 AS fqn, min(id) AS id FROM c GROUP BY 1), a AS (SELECT id, 'App\\N' || k % 80 AS fqn, 'extends' AS type FROM c UNION ALL SELECT id, 'Gone', 'uses_trait' FROM c WHERE k % 2 = 0) SELECT a.id AS src, coalesce(q.id, 'UNRESOLVED:' || fqn) AS dst, type FROM a LEFT JOIN q USING (fqn)")
def qualified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _c(spark, sf_dir).select("id", F.expr("concat('\\\\App\\\\N', k % 60)").alias("fqn"), F.expr("array(concat(CASE WHEN k % 3 = 0 THEN '\\\\' ELSE '' END, 'App\\\\N', k % 80))").alias("parents"), F.expr("CASE WHEN k % 2 = 0 THEN array('Gone') END").alias("traits"))
    return references.qualified_edges(rows, {"parents": "extends", "traits": "uses_trait"})


@query("python_imports", """WITH i AS (SELECT p_partkey AS id, 'pkg/s' || p_partkey % 5 || '/a.py' AS path, p_partkey % 6 AS n, p_partkey % 9 AS m FROM part), f AS (SELECT DISTINCT 'pkg/s' || p_partkey % 5 || '/b' || p_partkey % 7 || '.py' AS path FROM part)
    SELECT id, CASE WHEN n = 0 THEN 'stdlib' WHEN n IN (1, 2) AND m < 7 OR n = 3 OR n = 5 THEN 'local' ELSE 'unresolved' END AS kind,
      CASE n WHEN 0 THEN 'os.path' WHEN 1 THEN CASE WHEN m < 7 THEN 'pkg/s' || id % 5 || '/b' || m || '.py' ELSE 'UNRESOLVED:b' || m END WHEN 2 THEN CASE WHEN m < 7 THEN 'pkg/s' || (id + 1) % 5 || '/b' || m || '.py' ELSE 'UNRESOLVED:s' || (id + 1) % 5 || '.b' || m END WHEN 3 THEN 'lib/__init__.py' WHEN 4 THEN 'UNRESOLVED:numpy' ELSE 'pkg/__init__.py' END AS target FROM i""")
def python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard modules, neighbours, relative ones, packages by their __init__.py, and strangers."""
    part = table(spark, sf_dir, "part")
    imports = part.selectExpr("p_partkey AS id", "concat('pkg/s', p_partkey % 5, '/a.py') AS path", "CASE p_partkey % 6 WHEN 0 THEN 'os.path' WHEN 1 THEN concat('b', p_partkey % 9) WHEN 2 THEN concat('s', (p_partkey + 1) % 5, '.b', p_partkey % 9) WHEN 3 THEN 'lib' WHEN 4 THEN 'numpy' ELSE '' END AS module", "CASE p_partkey % 6 WHEN 2 THEN 2 WHEN 5 THEN 2 ELSE 0 END AS level")
    known = part.selectExpr("concat('pkg/s', p_partkey % 5, '/b', p_partkey % 7, '.py') AS path").unionByName(part.selectExpr("CASE WHEN p_partkey % 2 = 0 THEN 'lib/__init__.py' ELSE 'pkg/__init__.py' END AS path"))
    return references.python_imports(imports, known)


@query("namespaces_by_prefix", "SELECT DISTINCT 'App\\M' || p_partkey % 9 || '\\X' || p_partkey % 40 AS name, CASE WHEN p_partkey % 9 < 5 THEN 'App\\M' || p_partkey % 9 || '\\' ELSE 'App\\' END AS prefix, CASE WHEN p_partkey % 9 < 5 THEN 'src/m' || p_partkey % 9 ELSE 'src' END AS target FROM part")
def namespaces_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    names = part.selectExpr("concat('App\\\\M', p_partkey % 9, '\\\\X', p_partkey % 40) AS name").unionByName(part.selectExpr("concat('Other\\\\', p_partkey) AS name")).distinct()
    prefixes = part.selectExpr("concat('App\\\\M', p_partkey % 5, '\\\\') AS prefix", "concat('src/m', p_partkey % 5) AS target").unionByName(part.selectExpr("'App\\\\' AS prefix", "'src' AS target")).distinct()
    return references.longest_prefix(names, prefixes)


@query("documents_to_code", f"""WITH {_C}, f AS (SELECT path, arg_min(id, ((type <> 'file')::int, id)) AS id FROM c GROUP BY path), n AS (SELECT name, min(id) AS id FROM c GROUP BY name), a AS (SELECT path, lower(name) AS anchor, min(id) AS id FROM c GROUP BY ALL),
    l AS (SELECT 'd' || k AS src, k, path, name FROM c) SELECT src, 'c' || k AS dst, 'documents' AS type, 0.95::double AS confidence, 1 AS way FROM l WHERE k % 5 = 0 UNION ALL SELECT src, n.id, 'documents', 0.8, 2 FROM l JOIN n USING (name) WHERE k % 5 = 1 UNION ALL SELECT src, n.id, 'documents', 0.8, 3 FROM l JOIN n USING (name) WHERE k % 5 = 2
    UNION ALL SELECT src, a.id, 'documents', 0.8, 4 FROM l JOIN a ON a.path = l.path AND a.anchor = lower(l.name) WHERE k % 5 = 3 UNION ALL SELECT src, f.id, 'documents', 0.8, 5 FROM l JOIN f ON f.path = l.path WHERE k % 5 = 4""")
def documents_to_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five ways from a link to a component."""
    c = _c(spark, sf_dir)
    url = F.expr("CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN name WHEN 2 THEN name WHEN 3 THEN concat('../', path, '#', upper(name)) ELSE concat('../', path) END")
    links = c.select(F.expr("concat('d', k)").alias("src"), F.expr("concat('docs/d', k, '.md')").alias("path"), url.alias("url"), F.expr("CASE WHEN k % 5 = 0 THEN id END").alias("target_id"), F.expr("CASE k % 5 WHEN 1 THEN 'index_entry' WHEN 2 THEN 'index_list' ELSE 'link' END").alias("kind"))
    return references.doc_links(links, c)


@query("names_mentioned", f"WITH {_C}, n AS (SELECT name, min(id) AS id FROM c GROUP BY name) SELECT DISTINCT 't' || k AS src, n.id AS dst, 'uses' AS type FROM c JOIN n ON n.name IN ('N' || k % 90, 'N' || k % 7)")
def names_mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template variables to the components of their names."""
    c = _c(spark, sf_dir)
    texts = c.select(F.expr("concat('t', k)").alias("id"), F.expr("concat('say {{ N', k % 90, ' }} and {{N', k % 7, '}} or {{none}}')").alias("text"))
    return references.mentions(texts, r"\{\{\s*(\w+)\s*\}\}", c, "uses")


@query("imports_targeted", f"""WITH {_C}, p AS (SELECT DISTINCT path FROM c) SELECT k AS id, CASE k % 4 WHEN 0 THEN 'path' WHEN 1 THEN 'bare' WHEN 2 THEN 'path' ELSE 'bare' END AS class, k % 4 = 1 AND c.language IN ('typescript', 'javascript') AS is_stdlib,
    CASE k % 4 WHEN 0 THEN CASE WHEN a.path IS NOT NULL THEN a.path ELSE './f' || k % 30 END WHEN 1 THEN CASE WHEN c.language = 'python' THEN 'module:' ELSE 'stdlib:' END || 'node:fs' WHEN 2 THEN CASE WHEN b.path IS NOT NULL THEN b.path ELSE '/dist/m' || k % 7 || '/f' || k % 30 || '.js' END ELSE 'module:flask' END AS target
    FROM c LEFT JOIN p a ON k % 4 = 0 AND k % 30 % 3 IN (0, 2) AND a.path = CASE WHEN k % 30 % 3 = 0 THEN c.path END LEFT JOIN p b ON k % 4 = 2 AND b.path = 'src/m' || k % 7 || '/f' || k % 30 || '.ts'""")
def imports_targeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with endings tried and dist read as src, standard and other modules."""
    c = _c(spark, sf_dir)
    spec = F.expr("CASE k % 4 WHEN 0 THEN concat('./f', k % 30) WHEN 1 THEN 'node:fs' WHEN 2 THEN concat('/dist/m', k % 7, '/f', k % 30, '.js') ELSE 'flask' END")
    return references.import_targets(c.select(F.col("k").alias("id"), F.col("path").alias("src_path"), "language", spec.alias("specifier")), c.select("path")).select("id", "class", "is_stdlib", "target")


@query("structural_patterns", """WITH m AS (SELECT p_partkey AS k, 'k' || p_partkey % 50 AS owner, CASE p_size % 6 WHEN 0 THEN 'getInstance' WHEN 1 THEN 'onSubscribe' WHEN 2 THEN 'emitAll' WHEN 3 THEN 'createThing' ELSE 'run' END AS name FROM part),
    f AS (SELECT 'm' || k AS component, 'factory' AS pattern, 0.8::double AS confidence, ['k' || k % 7, 'k' || k % 11] AS members FROM m WHERE name = 'createThing' AND k % 2 = 0),
    s AS (SELECT owner AS component, 'singleton', 0.9, list('m' || k) FROM m WHERE k % 50 % 2 = 0 GROUP BY owner HAVING bool_or(name = 'getInstance')),
    o AS (SELECT owner, 'observer', 0.85, list('m' || k) FROM m WHERE name IN ('onSubscribe', 'emitAll') GROUP BY owner HAVING count(DISTINCT name) = 2)
    SELECT component, pattern, confidence, array_to_string(list_sort(members), ',') AS members FROM (FROM f UNION ALL FROM s UNION ALL FROM o)""")
def structural_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factories, singletons and observers by what their edges say."""
    part = table(spark, sf_dir, "part")
    methods = part.selectExpr("concat('m', p_partkey) AS id", "CASE p_size % 6 WHEN 0 THEN 'getInstance' WHEN 1 THEN 'onSubscribe' WHEN 2 THEN 'emitAll' WHEN 3 THEN 'createThing' ELSE 'run' END AS name", "'method' AS type")
    owners = part.selectExpr("concat('k', p_partkey % 50) AS id", "concat('Klass', p_partkey % 50) AS name", "CASE WHEN p_partkey % 50 % 2 = 0 THEN 'class' ELSE 'module' END AS type").distinct()
    belongs = part.selectExpr("concat('m', p_partkey) AS src", "concat('k', p_partkey % 50) AS dst", "'belongs_to' AS type")
    creates = part.selectExpr("concat('m', p_partkey) AS src", "explode(CASE WHEN p_partkey % 2 = 0 THEN array(concat('k', p_partkey % 7), concat('k', p_partkey % 11)) ELSE array(concat('k', p_partkey % 7)) END) AS dst", "'creates' AS type")
    return mining.structural_patterns(methods.unionByName(owners), belongs.unionByName(creates)).withColumn("members", F.array_join("members", ","))


@query("rules_analysed", """WITH n AS (SELECT max(ts) AS now FROM events), r AS (SELECT user_id AS id, count(*) AS usage_count, max(ts) FILTER (event_type = 'click') AS last_used FROM events GROUP BY user_id),
    a AS (SELECT e.user_id AS id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS acc, count(*) FILTER (event_type = 'view') AS mod, count(*) FILTER (event_type = 'error') AS rej, avg(value) AS f FROM events e, n WHERE ts >= now - INTERVAL 2 DAY AND user_id % 9 > 0 GROUP BY 1),
    k AS (SELECT id, count(*) AS c FROM (SELECT event_id, user_id AS id FROM events WHERE event_type = 'error' UNION SELECT event_id, event_id % 20 FROM events WHERE event_type = 'error') GROUP BY id)
    SELECT r.id, usage_count, coalesce(c, 0) AS conflicts, coalesce(a.n, 0) AS applications, coalesce(acc, 0) AS accepted, coalesce(mod, 0) AS modified, coalesce(rej, 0) AS rejected, round(f, 6) AS feedback, round(acc / a.n, 6) AS acceptance, CAST(floor(date_diff('microsecond', last_used, now) / 86400000000) AS BIGINT) AS days_since
    FROM r LEFT JOIN a USING (id) LEFT JOIN k USING (id), n""")
def rules_analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of all users, also those without an application in the last two days; conflicts by either end."""
    events = table(spark, sf_dir, "events")
    rules = events.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("usage_count"), F.lit(0.0).alias("effectiveness"), F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("last_used"))
    action = F.expr("CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'view' THEN 'modified' WHEN 'error' THEN 'rejected' ELSE 'none' END")
    now = events.agg(F.max("ts").alias("now")).first()["now"]
    applied = events.where("user_id % 9 > 0").select(F.col("event_id").alias("id"), F.col("user_id").alias("rule_id"), action.alias("action"), F.col("value").alias("feedback"), F.col("ts").alias("applied_at"))
    relations = events.where("event_type = 'error'").selectExpr("user_id AS parent", "event_id % 20 AS child", "'conflicts' AS type")
    found = mining.rule_analytics(rules, applied, relations, F.lit(now), 2)
    return found.select("id", "usage_count", "conflicts", "applications", "accepted", "modified", "rejected", F.round("feedback", 6).alias("feedback"), F.round("acceptance", 6).alias("acceptance"), "days_since")


@query("blocking_scripts", "WITH s AS (SELECT event_id AS id, user_id AS doc FROM events WHERE event_type NOT IN ('view', 'error')) SELECT id AS src, dst FROM (SELECT id, lag(id) OVER (PARTITION BY doc ORDER BY id) AS dst FROM s) WHERE dst IS NOT NULL")
def blocking_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("user_id AS doc", "event_id AS id", "ts AS place", "event_type = 'view' AS is_async", "CASE WHEN event_type = 'error' THEN true END AS is_defer")
    return mining.blocking_scripts(rows)


@query("results_filtered", "SELECT p_partkey AS id FROM part WHERE p_size % 3 = 0 OR (p_size % 5 IN (0, 1) AND p_partkey % 30 % 3 = 0 AND (p_partkey % 7 IN (1, 2)) AND p_partkey % 30 NOT IN (3, 30))")
def results_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _c(spark, sf_dir).join(table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "CASE WHEN p_size % 3 = 0 THEN 'task' ELSE 'component' END AS entity_type"), "k")
    return rows.where(mining.search_filter(("class", "method"), ("typescript",), ("/m1/", "m2/f"), ("/f3.",))).select(F.col("k").alias("id"))


@query("search_by_modifiers", f"WITH {_C} SELECT id FROM c WHERE (name = 'N7' OR name ILIKE '%n1_%') AND lower(language) = 'typescript' AND NOT lower(type) = 'file' OR contains(lower(path), 'm3/f4') AND contains(lower(name), 'n4')")
def search_by_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = "(exact:N7 OR like:'n1_') lang:TypeScript NOT type:FILE or file:\"m3/F4\" n4"
    return _c(spark, sf_dir).where(boolean_search.compile_query(asked, ["name"])).select("id")


_TEXTS = "SELECT doc_id, text FROM documents WHERE text IS NOT NULL"


@query("segments_overlapping", "SELECT doc_id, CAST(k AS BIGINT) AS k, substr(text, CAST(k * 150 + 1 AS BIGINT), 200) AS piece FROM (SELECT doc_id, text, unnest(range(CAST(greatest(1, ceil((length(text) - 50) / 150.0)) AS BIGINT))) AS k FROM documents WHERE length(text) > 0)")
def segments_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of 200 characters that share 50 with the next; the one that reaches the end is the last."""
    pieces = ch.large_segment(F.col("text"), 200, 50, whole_words=False)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pieces).alias("k", "piece")).withColumn("k", F.col("k").cast("long"))


@query("paragraphs_packed", """WITH RECURSIVE p AS (SELECT conv_id, turn, generate_subscripts(ps, 1) AS k, unnest(ps) AS t FROM (SELECT conv_id, turn, list_filter(string_split(replace(text, '. ', chr(10) || chr(10)), chr(10) || chr(10)), lambda x: length(trim(x)) >= 5 AND length(x) <= 300) AS ps FROM conversations WHERE text IS NOT NULL)),
    w AS (SELECT conv_id, turn, 0::bigint AS k, 0::bigint AS chunk, 0::bigint AS size FROM p WHERE k = 1 UNION ALL SELECT p.conv_id, p.turn, p.k, CASE WHEN w.size + length(t) + 2 <= 300 OR w.size = 0 THEN chunk ELSE chunk + 1 END, CASE WHEN w.size = 0 THEN length(t) WHEN w.size + length(t) + 2 <= 300 THEN w.size + 2 + length(t) ELSE length(t) END FROM w JOIN p ON p.conv_id = w.conv_id AND p.turn = w.turn AND p.k = w.k + 1)
    SELECT w.conv_id, w.turn, chunk, trim(string_agg(t, chr(10) || chr(10) ORDER BY w.k)) AS text FROM w JOIN p ON p.conv_id = w.conv_id AND p.turn = w.turn AND p.k = w.k GROUP BY ALL""")
def paragraphs_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs (sentences, here) packed in order into chunks of 300 characters."""
    parts = F.filter(F.split(F.replace("text", F.lit(". "), F.lit("\n\n")), "\n\n"), lambda x: F.length(x) <= 300)
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.array_join(parts, "\n\n").alias("text"))
    return rows.select("conv_id", "turn", F.posexplode(ch.paragraph_chunks(F.col("text"), 300, 5)).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("long"))


@query("note_errors", """SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN turn % 5 = 0 THEN 'Title is required' END, CASE WHEN coalesce(trim(text), '') = '' THEN 'Content is required' END, CASE WHEN length(text) > 50000 THEN 'Content exceeds maximum length (50,000 characters)' END,
    CASE WHEN role <> 'user' THEN 'Invalid note type' END, CASE WHEN turn % 3 = 1 THEN 'Invalid entity type in entity links' END], lambda x: x IS NOT NULL), ';') AS errors FROM conversations""")
def note_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.array(F.struct(F.when(F.col("turn") % 3 == 1, "task").otherwise("file").alias("type"), F.lit("x").alias("id")))
    rows = table(spark, sf_dir, "conversations")
    found = en.note_errors(F.when(F.col("turn") % 5 > 0, "A title"), F.col("text"), F.when(F.col("role") == "user", "note").otherwise(F.col("role")), link)
    return rows.select("conv_id", "turn", F.array_join(found, ";").alias("errors"))


@query("rule_configurations", """SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN p_size % 10 = 0 THEN 'Rule name is required' END, CASE WHEN p_size % 4 = 3 THEN 'Rule type is required' END, CASE WHEN p_size % 4 = 0 AND p_partkey % 2 = 0 AND p_partkey % 3 > 0 THEN 'Automation rules with auto_apply must have a code_template' END,
    CASE WHEN p_size % 4 = 1 AND p_partkey % 3 = 0 THEN 'Constraint rules must have a validation_script' END, CASE WHEN p_size > 40 THEN 'Confidence threshold must be between 0 and 1' END, CASE WHEN p_partkey % 12 IN (0, 11) THEN 'Priority must be between 1 and 10' END, CASE WHEN p_partkey % 2 = 0 THEN 'Entity ID is required' END], lambda x: x IS NOT NULL), ';') AS errors FROM part""")
def rule_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(size % 4 == 0, "automation").when(size % 4 == 1, "constraint").when(size % 4 == 2, "pattern")
    found = en.rule_configuration_errors(F.when(size % 10 > 0, F.col("p_name")), kind, k % 2 == 0, F.when(k % 3 == 0, "code"), F.when(k % 3 > 0, "check"), size / 40, k % 12)
    return table(spark, sf_dir, "part").select(k.alias("id"), F.array_join(F.concat(found, en.application_errors(F.col("p_type"), F.when(k % 2 > 0, "c1"))), ";").alias("errors"))


_FENCE = "chr(96) || chr(96) || chr(96)"


@query("markdown_checked", f"""WITH d AS (SELECT p_partkey AS id, p_partkey % 6 AS n FROM part) SELECT id, CASE n WHEN 0 THEN 'Unclosed code block detected (' || {_FENCE} || ' fence count is odd);mermaid block starting at L2 not closed with ' || {_FENCE} WHEN 1 THEN 'Mermaid block L4: missing or unknown diagram type;L5: Use Mermaid %% comments instead of //'
    WHEN 2 THEN 'L3: erDiagram does not support array syntax like string[];L4: Non-ASCII character in Mermaid (use ASCII arrows like --> or -.->)' WHEN 3 THEN 'Excalidraw block L2: invalid JSON' WHEN 4 THEN '' ELSE 'Mermaid block L2: missing or unknown diagram type' END AS errors FROM d""")
def markdown_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = "```"
    texts = [f"id {{}}\n{f}mermaid\ngraph TD\n  a-->b", f"id {{}}\n{f} Mermaid \n\n pie chart? no\n a // b, http://x.y//z\n{f}\n".replace("pie chart? no", "circle"), f"{f}mermaid\nerDiagram\n  id{{}} string[]\n  a → b\n{f}", f"{f}excalidraw\n{{{{'id': {{}}\n{f}", f"{f}excalidraw\n{{{{\"id\": {{}}}}}}\n{f}\n{f}mermaid\npie\n{f}", f"{f}mermaid\n{f}\n id {{}}"]
    text = F.lit(None).cast("string")
    for k, t in enumerate(texts):
        head, tail = t.format("@").split("@")
        text = F.when(F.col("p_partkey") % 6 == k, F.concat(F.lit(head), F.col("p_partkey").cast("string"), F.lit(tail))).otherwise(text)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(en.markdown_errors(text), ";").alias("errors"))


@query("item_priorities", f"""WITH {_C}, d AS (SELECT id, count(*) AS n FROM (SELECT 'c' || p_partkey AS id FROM part WHERE p_partkey > 0 UNION ALL SELECT 'c' || p_partkey // 3 FROM part WHERE p_partkey > 0) GROUP BY id)
    SELECT k AS id, round((1 + coalesce(d.n, 0) * 0.1::double) * CASE WHEN k % 4 > 0 THEN (k % 4) / 4.0::double ELSE 1 END * CASE type WHEN 'class' THEN 10 WHEN 'method' THEN 6 WHEN 'property' THEN 5 WHEN 'function' THEN 8 ELSE 3 END * CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN 1.5 ELSE 1 END * CASE WHEN d.n > 5 THEN 1.2 ELSE 1 END, 6)::double AS code,
      round((1 + coalesce(d.n, 0) * 0.1::double) * CASE type WHEN 'class' THEN 9 WHEN 'method' THEN 6 ELSE 1 END * CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END * CASE WHEN k % 2 = 0 THEN 1.5 ELSE 1 END * CASE WHEN k % 11 = 0 THEN 1.3 ELSE 1 END, 6)::double AS document FROM c LEFT JOIN d USING (id)""")
def item_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = _c(spark, sf_dir), F.col("k")
    edges = c.where("k > 0").select(F.col("id").alias("src"), F.expr("concat('c', k div 3)").alias("dst"), F.lit("uses").alias("type"))
    rows = context.with_degree(context.Context(c, edges))
    code = context.code_priority(F.col("type"), F.col("degree"), F.when(k % 4 > 0, (k % 4) / 4.0), k % 5 == 0, F.when(k % 7 == 0, "public"))
    kind = F.when(F.col("type") == "class", "readme").when(F.col("type") == "method", "section").otherwise("other")
    document = context.document_priority(kind, F.col("degree"), F.lit(None).cast("double"), k % 3 == 0, k % 2 == 0, F.when(k % 11 == 0, "x\n## Table of Contents"))
    return rows.select(k.alias("id"), F.round(code, 6).alias("code"), F.round(document, 6).alias("document"))


@query("normal_vectors", """WITH g AS (SELECT p_partkey AS id, b, j, sha256(p_name || p_partkey || '#' || b) AS d FROM part, (SELECT unnest(range(3)) AS b), (SELECT unnest(range(4)) AS j)),
    u AS (SELECT id, b, j, (('0x' || substr(d, CAST(16 * j + 1 AS BIGINT), 8))::bigint + 1) / 4294967296.0::double AS u1, ('0x' || substr(d, CAST(16 * j + 9 AS BIGINT), 8))::bigint / 4294967296.0::double AS u2 FROM g),
    v AS (SELECT id, b * 8 + j * 2 AS pos, sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) AS x FROM u UNION ALL SELECT id, b * 8 + j * 2 + 1, sqrt(-2 * ln(u1)) * sin(2 * pi() * u2) FROM u)
    SELECT id, CAST(pos AS INTEGER) AS pos, round(x / (sqrt(sum(x * x) OVER (PARTITION BY id)) + 1e-12), 8) AS x FROM (SELECT * FROM v WHERE pos < 20)""")
def normal_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a small file is read by few tasks, but a row costs much
    rows = table(spark, sf_dir, "part").repartition("p_partkey").select(F.col("p_partkey").alias("id"), F.posexplode(rk.normal_vector(F.concat("p_name", F.col("p_partkey").cast("string")), 20)).alias("pos", "x"))
    return rows.select("id", "pos", F.round("x", 8).alias("x"))


@query("task_blocking", "WITH n AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey // 2 >= 1 UNION SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey // 3 >= 1), o AS (SELECT p_partkey AS node FROM part WHERE p_size > 10) SELECT src AS node, count(*) AS waiting FROM n WHERE src IN (FROM o) AND dst IN (FROM o) GROUP BY src")
def task_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    tasks = part.select(F.col("p_partkey").cast("long").alias("node"), (F.col("p_size") <= 10).alias("done"))
    needs = part.select(F.explode(F.expr("array(p_partkey div 2, p_partkey div 3)")).alias("src"), F.col("p_partkey").cast("long").alias("dst")).where("src >= 1")
    return task_graph.blocking(tasks, needs)


@query("tree_in_order", """WITH RECURSIVE n AS (SELECT p_partkey AS node, p_partkey // 2 AS parent, p_size AS o FROM part WHERE p_size % 7 <> 0 AND p_partkey > 0), s AS (SELECT n.node, p.node AS parent, n.o, row_number() OVER (PARTITION BY p.node ORDER BY n.o, n.node) AS sibling FROM n LEFT JOIN n p ON p.node = n.parent),
    t AS (SELECT node, parent, sibling, 0::bigint AS depth, [sibling] AS path FROM s WHERE parent IS NULL UNION ALL SELECT s.node, s.parent, s.sibling, t.depth + 1, list_append(t.path, s.sibling) FROM t JOIN s ON s.parent = t.node),
    z AS (SELECT a.node, count(*) AS size FROM t a JOIN t b ON b.path[1:len(a.path)] = a.path GROUP BY a.node) SELECT node, parent, sibling, depth, row_number() OVER (ORDER BY path) - 1 AS place, size FROM t JOIN z USING (node)""")
def tree_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preorder with siblings by size; a parent that is absent makes roots."""
    rows = table(spark, sf_dir, "part").where("p_size % 7 <> 0 AND p_partkey > 0").select(F.col("p_partkey").cast("long").alias("node"), F.expr("p_partkey div 2").alias("parent"), F.col("p_size").alias("o"))
    return task_graph.tree_order(rows, ["o"])
