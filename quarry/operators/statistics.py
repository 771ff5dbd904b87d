"""Statistics over components, edges, rules and errors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Edge types that tell what data do.
SEMANTIC_TYPES = ("uses_field", "transforms_data", "passes_to", "returns_from", "reads_from", "writes_to", "derives_from", "modifies", "awaits", "yields", "observes_pattern")
# End of fixed values.


def split_semantic(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Semantic and structural edges; a null type is structural."""
    semantic = F.coalesce(F.col("type").isin(*SEMANTIC_TYPES), F.lit(False))
    return edges.where(semantic), edges.where(~semantic)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, type, incoming, outgoing): edges of each node by type."""
    ends = edges.select(F.col("src").alias("node"), "type", F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("node"), "type", F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node", "type").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))


def component_detail(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Components with incoming, outgoing and all edges, and a map of their numbers by type."""
    per = degrees(edges)
    total = per.groupBy(F.col("node").alias("id")).agg(F.sum("incoming").alias("incoming"), F.sum("outgoing").alias("outgoing"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", (F.col("incoming") + F.col("outgoing")).alias("n"))))).alias("by_type"))
    joined = components.join(total, "id", "left").withColumn("incoming", F.coalesce("incoming", F.lit(0))).withColumn("outgoing", F.coalesce("outgoing", F.lit(0)))
    return joined.withColumn("edges", F.col("incoming") + F.col("outgoing"))


def language_insight(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(language, n, files, types, edge_types, edges_per_component): maps of numbers by type, edges from components of the language."""
    own = components.select(F.col("id").alias("src"), "language")
    of = edges.join(own, "src").groupBy("language", "type").agg(F.count("*").alias("n"))
    edge_types = of.groupBy("language").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("edge_types"), F.sum("n").alias("edges"))
    types = components.groupBy("language", "type").agg(F.count("*").alias("n")).groupBy("language").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"), F.sum("n").alias("n"))
    paths = components.groupBy("language").agg(F.count_distinct("path").alias("files"))
    rows = types.join(paths, "language").join(edge_types, "language", "left")
    return rows.select("language", "n", "files", "types", "edge_types", F.round(F.coalesce("edges", F.lit(0)) / F.col("n"), 2).alias("edges_per_component"))


def confidence_bucket(confidence: Column) -> Column:
    """The range of a confidence: tenths from .5 on, and all below."""
    out = F.lit("0.0-0.5")
    for low in (0.5, 0.6, 0.7, 0.8, 0.9):
        out = F.when(confidence >= low, f"{low:.1f}-{low + 0.1:.1f}").otherwise(out)
    return out


def evidence_statistics(evidence: DataFrame) -> DataFrame:
    """(kind, value, n, mean) of evidence (source, precedence, confidence): numbers and mean confidence by precedence, bucket and source."""
    kinds = {"precedence": F.col("precedence").cast("string"), "bucket": confidence_bucket(F.col("confidence")), "source": F.col("source")}
    rows = evidence.select("confidence", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])).alias("x"))
    return rows.groupBy("x.kind", "x.value").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))


def rule_totals(rules: DataFrame) -> DataFrame:
    return rules.groupBy("type", "active").agg(F.count("*").alias("n"))


def error_histogram(errors: DataFrame, column: str = "error", most: int = 5) -> DataFrame:
    """The most frequent errors."""
    return errors.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most)


def embedded(frames: Mapping[str, DataFrame], embeddings: DataFrame, key: str = "id") -> DataFrame:
    """(entity_type, n, embedded): rows of each entity frame, and how many have an embedding (entity_type, entity_id)."""
    out = None
    for name, frame in frames.items():
        there = embeddings.where(F.col("entity_type") == name).select(F.col("entity_id").alias(key), F.lit(1).alias("one")).distinct()
        part = frame.select(key).join(there, key, "left").agg(F.count("*").alias("n"), F.count("one").alias("embedded")).select(F.lit(name).alias("entity_type"), "n", "embedded")
        out = part if out is None else out.unionByName(part)
    return out


def project_row(counts: Mapping[str, DataFrame], components: DataFrame) -> DataFrame:
    """One row: the number of rows of each frame, of files, and a map of components by language."""
    languages = components.where("language <> ''").groupBy("language").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"))
    out = components.agg(F.count_distinct("path").alias("files")).join(F.broadcast(languages))
    for name, frame in counts.items():
        out = out.join(F.broadcast(frame.agg(F.count("*").alias(name))))
    return out


def task_links(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """Tasks with the number of their code links (task_id, confidence), how many are sure (.8 or more), and the mean confidence."""
    per = links.groupBy(F.col("task_id").alias("id")).agg(F.count("*").alias("links"), F.count_if(F.col("confidence") >= 0.8).alias("sure"), F.avg("confidence").alias("mean_confidence"))
    return tasks.join(per, "id", "left").withColumn("links", F.coalesce("links", F.lit(0))).withColumn("sure", F.coalesce("sure", F.lit(0)))


def pattern_scores(items: DataFrame, patterns: Mapping[str, Sequence[tuple[str, Column, float]]], least: float = 0.5) -> DataFrame:
    """(id, pattern, score, evidence) of items: for each pattern the weights of the evidence that holds, kept above `least`."""
    found = []
    for name, evidence in patterns.items():
        score = F.lit(0.0)
        for _, holds, weight in evidence:
            score += F.when(F.coalesce(holds, F.lit(False)), weight).otherwise(0.0)
        told = F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), text) for text, holds, _ in evidence]))
        found.append(F.struct(F.lit(name).alias("pattern"), F.round(score, 6).alias("score"), told.alias("evidence")))
    return items.select("id", F.explode(F.array(*found)).alias("p")).select("id", "p.*").where(F.col("score") > least)


def simple_query(query: str, *columns: str) -> Column:
    """A documentation query of one operator: the first of and, or, not that it holds; no mixing."""
    low = query.lower()

    def holds(term: str) -> Column:
        out = F.lit(False)
        for c in columns:
            out |= F.coalesce(F.contains(F.lower(c), F.lit(term.strip())), F.lit(False))
        return out

    if " and " in low:
        out = F.lit(True)
        for term in low.split(" and "):
            out &= holds(term)
        return out
    if " or " in low:
        out = F.lit(False)
        for term in low.split(" or "):
            out |= holds(term)
        return out
    return ~holds(low.split(" not ")[1]) if " not " in low else holds(low)
