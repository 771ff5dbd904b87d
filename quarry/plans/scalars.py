"""Queries of functions over JSON, links, maps, paths and words; the SQL says what they come to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import chunking as ch
from quarry.functions import entities as en
from quarry.functions import terms
from quarry.functions import text as tx
from quarry.functions import vector as vec
from quarry.operators import mining, references
from quarry.operators import entities as ops
from quarry.plans.cascades import _c
from quarry.plans.registry import query
from quarry.sources import exports
from quarry.sources.tables import table

_LINKS = "links AS (SELECT p_partkey AS id, [{'type': CASE p_size % 2 WHEN 0 THEN 'task' ELSE 'note' END, 'id': 'x' || p_partkey % 9}, {'type': 'note', 'id': 'x1'}] AS l FROM part)"


@query("json_safely", "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_partkey::varchar WHEN 1 THEN 'raw:{p' || p_partkey WHEN 2 THEN NULL ELSE 'text' END AS found FROM part")
def json_safely(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects as they are, what isn't JSON as raw text, nothing as null."""
    text = F.expr("CASE p_size % 4 WHEN 0 THEN concat('{\"k\": ', p_partkey, '}') WHEN 1 THEN concat('{p', p_partkey) WHEN 2 THEN '' ELSE '\"text\"' END")
    v = ops.safe_json(text)
    k, raw, whole = (F.try_variant_get(v, at, "string") for at in ("$.k", "$.raw", "$"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.coalesce(k, F.concat(F.lit("raw:"), raw), F.when(F.col("p_size") % 4 == 3, whole)).alias("found"))


@query("links_held", f"WITH {_LINKS} SELECT id, len(list_filter(l, lambda x: x.type = 'task')) > 0 AS any_task, len(list_filter(l, lambda x: x.type = 'note' AND x.id = 'x1')) > 0 AS note_1, len(l) + CASE WHEN list_contains(l, {{'type': 'task', 'id': 'x3'}}) THEN 0 ELSE 1 END AS linked, len(list_filter(l, lambda x: NOT (x.type = 'note' AND x.id = 'x1'))) AS unlinked FROM links")
def links_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment in an array of links, one more link, one less."""
    s = lambda t, i: F.struct(t.alias("type"), i.alias("id"))
    links = F.array(s(F.when(F.col("p_size") % 2 == 0, "task").otherwise("note"), F.expr("concat('x', p_partkey % 9)")), s(F.lit("note"), F.lit("x1")))
    size = lambda x: F.size(x).cast("long")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), en.has_link(links, "task").alias("any_task"), en.has_link(links, "note", "x1").alias("note_1"), size(en.linked(links, F.lit("task"), F.lit("x3"))).alias("linked"), size(en.unlinked(links, F.lit("note"), F.lit("x1"))).alias("unlinked"))


@query("maps_merged", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN NULL ELSE concat_ws(',', CASE WHEN p_size % 3 > 0 THEN 'a=' || CASE WHEN p_partkey % 2 = 1 THEN p_brand ELSE p_size::varchar END WHEN p_partkey % 2 = 1 THEN 'a=' || p_brand END, CASE WHEN p_size % 3 > 0 THEN 'b=1' END) END AS pairs FROM part")
def maps_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values win; nothing and nothing is null."""
    old = F.when(F.col("p_size") % 3 > 0, F.create_map(F.lit("a"), F.col("p_size").cast("string"), F.lit("b"), F.lit("1")))
    new = F.when(F.col("p_partkey") % 2 == 1, F.create_map(F.lit("a"), F.col("p_brand")))
    pairs = F.transform(F.array_sort(F.map_entries(en.merged_maps(old, new))), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(pairs, ",").alias("pairs"))


@query("paths_in_project", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'src/f' || p_partkey || '.ts' WHEN 1 THEN 'lib/f' || p_partkey ELSE 'other/f' || p_partkey END AS path FROM part")
def paths_in_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('C:\\\\p\\\\src\\\\f', p_partkey, '.ts') WHEN 1 THEN concat('C:/p/lib/f', p_partkey) ELSE concat('other/f', p_partkey) END")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), en.project_path(path, "C:\\p").alias("path"))


@query("common_words", "SELECT item_id, count(*) FILTER (length(w) < 3 OR w IN ('" + "', '".join(terms.STOP_WORDS) + "')) AS common, count(*) AS words FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark) GROUP BY item_id")
def common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("w"))
    return rows.groupBy("item_id").agg(F.count_if(terms.is_common(F.col("w"))).alias("common"), F.count("*").alias("words"))


@query("subwords", "SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'BUILD|ING' WHEN 'FURNITURE' THEN 'F|U|R|N|I|T|U|R|E' WHEN 'MACHINERY' THEN 'MACHINE|R|Y' WHEN 'HOUSEHOLD' THEN 'HOUSE|HOLD' ELSE 'AUTO|M|O|B|I|L|E' END || '|x|' || c_custkey % 10 AS tokens FROM customer")
def subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedily the longest known beginnings, else single characters."""
    text = F.concat("c_mktsegment", F.lit(" x "), (F.col("c_custkey") % 10).cast("string"))
    known = ["BUILD", "ING", "MACHINE", "MACH", "HOUSE", "HOLD", "AUTO", "AUT"]
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array_join(ch.subwords(text, known), "|").alias("tokens"))


@query("statuses_summed", "SELECT CASE WHEN p_partkey % 9 = 3 THEN 'skippedJunk' WHEN p_partkey % 9 = 6 THEN 'resolved' WHEN p_partkey % 30 % 3 = 1 THEN 'skippedExternal' ELSE 'resolved' END AS status, count(*) AS n FROM part GROUP BY 1")
def statuses_summed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _c(spark, sf_dir)
    spec = F.expr("CASE k % 9 WHEN 3 THEN '{junk}' WHEN 6 THEN 'App\\\\Model' ELSE 'react' END")
    e = c.select(F.col("k").alias("id"), F.col("id").alias("src"), spec.alias("dst"), F.lit(None).cast("string").alias("imported"))
    return references.status_summary(references.resolve_targets(e, c))


@query("bundle_sections", "SELECT 'all' AS bundle_id, lang AS section_type, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'long', lang, count(*) FROM documents WHERE n_chars > 1000 GROUP BY lang")
def bundle_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("section_type"), "n_chars")
    return exports.sections(exports.attached({"all": docs, "long": docs.where("n_chars > 1000")}))


@query("cosine_strictly", "SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_strictly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return rows.join(other, "vec_id").select(F.col("vec_id").alias("id"), F.round(vec.cosine_strict(F.col("v"), F.col("w")), 6).alias("score"))


@query("spaces_normalised", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))) AS digest FROM documents")
def spaces_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.spaces_normalised(F.col("text"))).alias("digest"))


@query("entities_of_ids", "SELECT CASE o_orderkey % 4 WHEN 0 THEN 'task' WHEN 1 THEN 'note' ELSE 'none' END AS kind, count(*) AS n FROM orders GROUP BY 1")
def entities_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are ids of tasks, notes or rules are looked up, others searched."""
    asked = F.expr("CASE o_orderkey % 4 WHEN 0 THEN concat(' task_', o_orderkey) WHEN 1 THEN concat('note_', o_orderkey) WHEN 2 THEN concat('component_', o_orderkey) ELSE 'rule_ of thumb' END")
    return table(spark, sf_dir, "orders").groupBy(F.coalesce(mining.entity_of(asked), F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))
