"""Queries of file listings: files are documents by source and language, some with names that begin with . or _, many of one time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.registry import query
from quarry.sources import files
from quarry.sources.tables import table

_FILES = """f AS (SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || CASE doc_id % 5 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE '' END || 'd' || doc_id
      || CASE doc_id % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.test.py' WHEN 2 THEN '.log' ELSE '.md' END AS relative, n_chars * 300 AS size, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (doc_id % 7) AS modified FROM documents)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda c: F.coalesce(c, F.lit("none"))
    mark = F.when(F.col("doc_id") % 5 == 0, "_").when(F.col("doc_id") % 5 == 1, ".").otherwise("")
    kind = F.when(F.col("doc_id") % 4 == 0, ".ts").when(F.col("doc_id") % 4 == 1, ".test.py").when(F.col("doc_id") % 4 == 2, ".log").otherwise(".md")
    name = F.concat_ws("/", of("source"), of("lang"), F.concat(mark, F.lit("d"), F.col("doc_id").cast("string"), kind))
    at = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(CAST(doc_id % 7 AS int))")
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("relative"), (F.col("n_chars") * 300).alias("size"), at.alias("modified"))


@query("files_reconciled", f"WITH {_FILES} SELECT relative, CAST((row_number() OVER (ORDER BY modified, relative) - 1) // 40 AS INTEGER) AS batch FROM f WHERE modified > TIMESTAMP '2024-01-02' AND modified <= TIMESTAMP '2024-01-06' ORDER BY modified, relative LIMIT 120")
def files_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, each from the mark of the one before."""
    listing, edge = _files(spark, sf_dir), F.expr("timestamp'2024-01-06 00:00:00'")
    mark, out = (files.mark_of(listing.where("modified = timestamp'2024-01-02 00:00:00'"))), None
    for k in range(3):
        taken = files.to_reconcile(listing, mark, 40, edge)
        mark = files.mark_of(taken, mark)
        part = taken.select("relative", F.lit(k).alias("batch"))
        out = part if out is None else out.unionByName(part)
    return out


@query("files_changed", f"WITH {_FILES} SELECT relative, CASE WHEN doc_id % 3 = 0 THEN 'add' WHEN doc_id % 11 = 0 THEN 'unlink' ELSE 'change' END AS change FROM f WHERE NOT (doc_id % 3 = 0 AND doc_id % 11 = 0) AND (doc_id % 3 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0) AND ((doc_id % 11 = 0 AND doc_id % 3 <> 0) OR modified <= TIMESTAMP '2024-01-05')")
def files_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between two listings, files of the last days left for later."""
    now = _files(spark, sf_dir)
    before = now.where("doc_id % 3 <> 0").withColumn("size", F.when(F.col("doc_id") % 13 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return files.changes(before, now.where("doc_id % 11 <> 0"), F.expr("timestamp'2024-01-05 00:00:00'"))


@query("files_ignored", f"""WITH {_FILES}, r AS (SELECT * FROM (VALUES (1, '', '%.log', false), (2, 'src1', 'src1/en/%', false), (3, 'src1/en', 'src1/en/.%.log', true), (4, 'src2', 'src2/%/#_%', false), (5, '', '%/d_.%', true)) AS t(n, base, pattern, back))
    SELECT relative, coalesce((SELECT NOT back FROM r WHERE (base = '' OR starts_with(relative, base || '/')) AND relative LIKE pattern ESCAPE '#' ORDER BY n DESC LIMIT 1), false) AS ignored FROM f""")
def files_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By lines of ignore files of several folders; the last that matches decides."""
    rules = [("", "*.log"), ("src1", "/en"), ("src1/en", "!.*.log"), ("src2", "*/_*"), ("", "!d?.*")]
    return _files(spark, sf_dir).select("relative", files.is_ignored_below(F.col("relative"), rules).alias("ignored"))


@query("files_classified", f"WITH {_FILES} SELECT relative, CASE WHEN relative LIKE '%.log' THEN 'ignored' WHEN size > 1048576 THEN 'oversize' WHEN relative LIKE '%.test.%' THEN 'ignored' ELSE 'accepted' END AS verdict FROM f")
def files_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.classified(_files(spark, sf_dir), ["*.log"]).select("relative", "verdict")
