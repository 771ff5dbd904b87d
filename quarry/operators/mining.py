"""What edges and their owners tell: structural patterns, unresolved ends, rules' use, blocking scripts, search filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.references import containment_type


def _has(name: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out |= F.lower(name).contains(p)
    return F.coalesce(out, F.lit(False))


def structural_patterns(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, pattern, confidence, members) of components (id, name, type) and edges (src, dst, type).

    factory (.8): named so, or a method that is named after creating, with two edges or more to what it creates, its members.
    singleton (.9): a class to which a method belongs that is called getInstance or instance; members are all its methods.
    observer (.85): a class or other component with a method to subscribe and one to publish, its members; a method counts for the first owner (least id).
    """
    owned = edges.where("type = 'belongs_to'").select("src", "dst").distinct()
    methods = components.where("type = 'method'").select(F.col("id").alias("src"), F.col("name").alias("method"))
    creators = components.where(_has(F.col("name"), "factory") | ((F.col("type") == "method") & _has(F.col("name"), "create"))).select(F.col("id").alias("src"))
    made = edges.where("type = 'creates'").join(creators, "src").groupBy(F.col("src").alias("component")).agg(F.array_sort(F.collect_list("dst")).alias("members")).where(F.size("members") >= 2)
    classes = components.where("type = 'class'").select(F.col("id").alias("dst"))
    mine = owned.join(methods, "src").join(classes, "dst").groupBy(F.col("dst").alias("component")).agg(F.array_sort(F.collect_list("src")).alias("members"), F.bool_or(F.lower("method").isin("getinstance", "instance")).alias("one")).where("one").drop("one")
    hears, tells = _has(F.col("method"), "subscribe", "addlistener"), _has(F.col("method"), "publish", "emit")
    first = owned.groupBy("src").agg(F.min("dst").alias("dst")).join(methods, "src").where(hears | tells).join(components.select(F.col("id").alias("dst")), "dst")
    both = first.groupBy(F.col("dst").alias("component")).agg(F.array_sort(F.collect_list("src")).alias("members"), F.bool_or(hears).alias("hears"), F.bool_or(tells).alias("tells")).where("hears AND tells").drop("hears", "tells")
    parts = [rows.select("component", F.lit(name).alias("pattern"), F.lit(sure).alias("confidence"), "members") for rows, name, sure in ((made, "factory", 0.8), (mine, "singleton", 0.9), (both, "observer", 0.85))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def unresolved(edges: DataFrame, end: str = "dst") -> DataFrame:
    """Edges whose target (or, with src, source) is still RESOLVE:, without a resolved id, and not known to be external.

    metadata is JSON. Without metadata an edge counts; with metadata that says nothing of isExternal, or says null, it doesn't.
    """
    said = F.get_json_object("metadata", "$.isExternal")
    outside = F.when(F.lower(said).isin("true", "1"), True).when(said.isNotNull(), False)
    return edges.where(F.col(end).startswith("RESOLVE:") & F.col(f"resolved_{end}").isNull() & (F.col("metadata").isNull() | F.coalesce(~outside, F.lit(False))))


def rule_analytics(rules: DataFrame, applications: DataFrame, relations: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Rules (id, usage_count, effectiveness, last_used) with their conflicts and what became of them in the last days.

    applications: id, rule_id, action, feedback, applied_at, of which those since the cutoff count: a rule
    without any stays, with counts of 0 (sums null). relations: parent, child, type. The rate is null without
    applications, days_since without a last use.
    """
    cutoff = now - F.make_dt_interval(F.lit(days))
    recent = applications.where(F.col("applied_at") >= cutoff).groupBy(F.col("rule_id").alias("id")).agg(F.count_distinct("id").alias("applications"), *(F.sum(F.when(F.col("action") == a, 1).otherwise(0)).alias(a) for a in ("accepted", "modified", "rejected")), F.avg("feedback").alias("feedback"))
    ends = F.array_distinct(F.array("parent", "child"))
    conflicts = relations.where("type = 'conflicts'").select(F.explode(ends).alias("id")).groupBy("id").agg(F.count("*").alias("conflicts"))
    rows = rules.join(recent, "id", "left").join(conflicts, "id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    since = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_used").cast("timestamp"))) / 86_400_000_000)
    return rows.select("id", "usage_count", "effectiveness", "last_used", count("conflicts"), count("applications"), *(count(a) for a in ("accepted", "modified", "rejected")), "feedback", F.when(F.col("applications") > 0, F.col("accepted") / F.col("applications")).alias("acceptance"), since.alias("days_since"))


def blocking_scripts(scripts: DataFrame) -> DataFrame:
    """(src, dst) of scripts (doc, id, place, is_async, is_defer): each that blocks depends on the one that blocks before it.

    Scripts that are async or deferred neither wait nor are waited for.
    """
    free = F.coalesce(F.col("is_async"), F.lit(False)) | F.coalesce(F.col("is_defer"), F.lit(False))
    before = F.lag("id").over(Window.partitionBy("doc").orderBy("place", "id"))
    return scripts.where(~free).select(F.col("id").alias("src"), before.alias("dst")).where("dst IS NOT NULL")


def search_filter(types: Sequence[str] = (), languages: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Which results (entity_type, type, language, path) stay: all that aren't components, and components of the types and languages
    whose path holds one of `include` and none of `exclude`; an empty list asks for nothing."""
    holds = lambda parts: F.exists(F.array(*(F.lit(p) for p in parts)), lambda p: F.contains(F.coalesce("path", F.lit("")), p))
    out = F.lit(True)
    for column, wanted in (("type", types), ("language", languages)):
        if wanted:
            out &= F.coalesce(F.col(column).isin(*wanted), F.lit(False))
    if include:
        out &= holds(include)
    if exclude:
        out &= ~holds(exclude)
    return F.when(F.col("entity_type") != "component", True).otherwise(out)


def entity_of_id(text: str) -> str | None:
    """task, note or rule for a text that is the id of one, else None: such a search is a point lookup."""
    kind, mark, rest = text.strip().partition("_")
    return kind if mark and rest and kind in ("task", "note", "rule") and not rest.split()[1:] else None


def entity_of(text: Column) -> Column:
    """As entity_of_id, of a column."""
    return F.nullif(F.regexp_extract(F.trim(text), r"^(task|note|rule)_\S+$", 1), F.lit(""))


def cross_language(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(src, dst, type, from_language, to_language) of edges whose ends, resolved or not, are components of different languages."""
    end = lambda name: components.select(F.col("id").alias(name), F.col("language").alias(f"{name}_language"))
    ends = edges.select(F.coalesce("resolved_src", "src").alias("src"), F.coalesce("resolved_dst", "dst").alias("dst"), "type")
    both = ends.join(end("src"), "src").join(end("dst"), "dst").where("src_language <> dst_language")
    return both.select("src", "dst", "type", F.col("src_language").alias("from_language"), F.col("dst_language").alias("to_language"))


def parent_edges(components: DataFrame) -> DataFrame:
    """(src, dst, type): from each parent to its children, by the types of both; children of unknown parents give nothing."""
    parents = components.select(F.col("id").alias("src"), F.col("type").alias("outer"))
    children = components.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.col("type").alias("inner"))
    return children.join(parents, "src").select("src", "dst", containment_type(F.col("outer"), F.col("inner")).alias("type"))
