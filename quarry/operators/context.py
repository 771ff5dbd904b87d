"""Context of a question as frames: items and edges through a chain of processors, packed to a budget and written out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import entities, graph, ordered

# Priorities of types, and edge types that only say where things stand.
TYPE_PRIORITY = {"class": 10, "interface": 9, "function": 8, "method": 7, "property": 5, "variable": 4, "file": 3}
HIERARCHY = ("contains", "belongs_to", "class-contains-method", "class-contains-property", "namespace-contains-class")
# Scores of types of code and of documents; other types score 1.
CODE_SCORES = {"class": 10.0, "interface": 9.0, "function": 8.0, "method": 6.0, "enum": 7.0, "module": 9.0, "namespace": 8.0, "property": 5.0, "variable": 4.0, "file": 3.0}
DOCUMENT_SCORES = {"document": 8.0, "chapter": 7.0, "section": 6.0, "article": 5.0, "page": 5.0, "paragraph": 3.0, "note": 4.0, "readme": 9.0, "markdown": 4.0, "text": 2.0}
# End of fixed values.


@dataclass(frozen=True)
class Context:
    """items (id, name, type, language, path, content, score) and edges (src, dst, type)."""

    items: DataFrame
    edges: DataFrame


Processor = Callable[[Context], Context]


def chained(context: Context, processors: Mapping[str, tuple[int, Processor]], can: Callable[[str], bool] = lambda _: True) -> Context:
    """The context through all processors that can, the highest priority first."""
    for name, (_, process) in sorted(processors.items(), key=lambda kv: (-kv[1][0], kv[0])):
        if can(name):
            context = process(context)
    return context


def with_items(context: Context, items: DataFrame) -> Context:
    """The context of these items, without the edges of others."""
    ids = items.select("id").distinct()
    kept = context.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Context(items, kept.select(*context.edges.columns))


def filtered(types: Sequence[str] = (), languages: Sequence[str] = (), path: str | None = None, without: Sequence[str] = ()) -> Processor:
    def run(context: Context) -> Context:
        items = context.items
        if types:
            items = items.where(F.col("type").isin(*types))
        if languages:
            items = items.where(F.col("language").isin(*languages))
        if path:
            items = items.where(F.contains("path", F.lit(path)))
        return with_items(context, items.where(~F.col("type").isin(*without)) if without else items)

    return run


def relevant(least: float, share: float = 0.2) -> Processor:
    """Drops items under a score, but keeps a share of the best, and the edges that lose an end."""
    return lambda context: with_items(context, entities.retained(context.items, "score", least, share))


def expanded(seeds: DataFrame, components: DataFrame, edges: DataFrame, depth: int = 2) -> Context:
    """The seeds and what is around them; items score by how near they are."""
    near = graph.expanded_context(seeds, edges, depth)
    items = components.join(near, components["id"] == near["node"]).drop("node").withColumn("score", 1 / (1 + F.col("depth"))).drop("depth")
    return with_items(Context(items, edges.select("src", "dst", "type")), items)


def item_priority(type_: Column, exported: Column, degree: Column) -> Column:
    """By type, half more for what is exported, and up to twice by degree."""
    base = F.lit(2)
    for name, value in TYPE_PRIORITY.items():
        base = F.when(type_ == name, value).otherwise(base)
    return base * F.when(F.coalesce(exported, F.lit(False)), 1.5).otherwise(1.0) * (1 + F.least(F.coalesce(degree, F.lit(0)) / 10, F.lit(1.0)))


def _base_priority(type_: Column, degree: Column, relevance: Column, scores: Mapping[str, float]) -> Column:
    """1 and a tenth for each edge, times the relevance where there is one (not 0), times the type's score."""
    kind = F.lit(1.0)
    for name, value in scores.items():
        kind = F.when(type_ == name, value).otherwise(kind)
    return (1 + F.coalesce(degree, F.lit(0)) * 0.1) * F.when(F.coalesce(relevance, F.lit(0.0)) != 0, relevance).otherwise(1.0) * kind


def code_priority(type_: Column, degree: Column, relevance: Column, exported: Column, visibility: Column) -> Column:
    """Half more for what is exported or public, a fifth more with over five edges."""
    seen = F.coalesce(exported, F.lit(False)) | F.coalesce(visibility == "public", F.lit(False))
    return _base_priority(type_, degree, relevance, CODE_SCORES) * F.when(seen, 1.5).otherwise(1.0) * F.when(F.coalesce(degree, F.lit(0)) > 5, 1.2).otherwise(1.0)


def document_priority(type_: Column, degree: Column, relevance: Column, heading: Column, summary: Column, content: Column) -> Column:
    """Twice for a heading, half more for an introduction or summary, 1.3 with a table of contents."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    contents = yes(F.contains(content, F.lit("## Table of Contents")))
    return _base_priority(type_, degree, relevance, DOCUMENT_SCORES) * F.when(yes(heading), 2.0).otherwise(1.0) * F.when(yes(summary), 1.5).otherwise(1.0) * F.when(contents, 1.3).otherwise(1.0)


def with_degree(context: Context) -> DataFrame:
    """The items with `degree`, the number of edges at either end of which they stand; a loop counts once."""
    ends = context.edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return context.items.join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def packed(context: Context, budget: int, chars_per_token: float = 3.5) -> Context:
    """Items by type priority, score and id, as many as fit into the budget of tokens (20 % overhead); the edges between them. Items without a score come last."""
    tokens = F.ceil(F.length(F.coalesce("content", F.lit(""))) / chars_per_token * 1.2).cast("long")
    base = F.lit(2)
    for name, value in TYPE_PRIORITY.items():
        base = F.when(F.col("type") == name, value).otherwise(base)
    rows = context.items.withColumn("_rank", -base).withColumn("_worse", -F.col("score")).withColumn("_tokens", tokens)
    kept = ordered.within_budget(rows, [], ["_rank", "_worse", "id"], "_tokens", budget)
    return with_items(context, kept.select(*context.items.columns))


def focused(context: Context, focus: Sequence[str], types: Sequence[str] = ()) -> Context:
    """A lens: no hierarchy edges, only the asked types, the items they join; all but the focus lose their bodies."""
    edges = context.edges.where(~F.col("type").isin(*HIERARCHY))
    if types:
        edges = edges.where(F.col("type").isin(*types))
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().unionByName(context.items.where(F.col("id").isin(*focus)).select("id")).distinct()
    items = context.items.join(ids, "id", "left_semi")
    bare = F.concat(F.element_at(F.split(F.coalesce("content", F.lit("")), "\n"), 1), F.lit(" ..."))
    return Context(items.withColumn("content", F.when(F.col("id").isin(*focus), F.col("content")).otherwise(bare)), edges)


def lens_stats(context: Context) -> DataFrame:
    """One row: items, edges and edge types."""
    e = context.edges.agg(F.count("*").alias("edges"), F.count_distinct("type").alias("edge_types"))
    return context.items.agg(F.count("*").alias("items")).join(F.broadcast(e))


def code_summary(code: Column, head: int = 5, tail: int = 3) -> Column:
    """The first and last lines of a code that has more, with a mark between."""
    lines = F.split(code, "\n")
    middle = F.concat(F.lit("// ... ("), (F.size(lines) - head - tail).cast("string"), F.lit(" lines omitted) ..."))
    return F.when(F.size(lines) <= head + tail, code).otherwise(F.array_join(F.concat(F.slice(lines, 1, head), F.array(middle), F.slice(lines, -tail, tail)), "\n"))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def first_paragraphs(text: Column, most: int = 3) -> Column:
    parts = F.split(text, r"\n\s*\n")
    return F.when(F.size(parts) > most, F.concat(F.array_join(F.slice(parts, 1, most), "\n\n"), F.lit("\n\n..."))).otherwise(text)


def outline(text: Column) -> Column:
    """The headings of a Markdown text."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^#{1,6}\s")), "\n")


def short_list(text: Column, most: int = 5) -> Column:
    """A text whose list items beyond `most` give way to a count."""
    lines = F.split(text, "\n")
    items = F.filter(lines, lambda x: x.rlike(r"^\s*[-*]\s"))
    kept = F.concat(F.slice(items, 1, most), F.array(F.concat(F.lit("... and "), (F.size(items) - most).cast("string"), F.lit(" more"))))
    return F.when(F.size(items) > most, F.array_join(F.concat(F.filter(lines, lambda x: ~x.rlike(r"^\s*[-*]\s")), kept), "\n")).otherwise(text)


#: Reductions by name; callers add theirs.
REDUCTIONS: dict[str, Callable[[Column], Column]] = {"code": code_summary, "docs": lambda t: truncated(t, 200), "paragraphs": first_paragraphs, "outline": outline, "list": short_list}


def reduced(context: Context, by_type: Mapping[str, str]) -> Context:
    """Contents shortened by the reduction of their item's type."""
    content = F.col("content")
    out = content
    for type_, name in by_type.items():
        out = F.when(F.col("type") == type_, REDUCTIONS[name](content)).otherwise(out)
    return Context(context.items.withColumn("content", out), context.edges)


def as_json(items: DataFrame) -> DataFrame:
    return items.select("id", F.to_json(F.struct("*")).alias("body"))


def as_markdown(items: DataFrame) -> DataFrame:
    fence = F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n```"))
    return items.select("id", F.concat(F.lit("## "), F.col("name"), F.lit(" ("), F.col("type"), F.lit(")\n\n"), fence).alias("body"))


def as_text(items: DataFrame) -> DataFrame:
    return items.select("id", F.concat_ws("\n", F.concat_ws(" ", "type", "name"), "content").alias("body"))


#: Output forms by name.
FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {"json": as_json, "markdown": as_markdown, "text": as_text}

# Words and their short forms; each form is unique, so texts come back exactly.
SHORT_WORDS = {"function": "fn", "class": "cl", "interface": "if", "method": "me", "property": "pr", "variable": "va", "const": "co", "return": "re", "import": "im", "export": "ex"}
# End of fixed values.


def compressed(text: Column) -> Column:
    """A text with its long words as ~ and a short form; ~ itself is doubled."""
    out = F.replace(text, F.lit("~"), F.lit("~~"))
    for word, short in SHORT_WORDS.items():
        out = F.regexp_replace(out, rf"\b{word}\b", f"~{short};")
    return out


def decompressed(text: Column) -> Column:
    out = F.replace(text, F.lit("~~"), F.lit("\u0001"))
    for word, short in SHORT_WORDS.items():
        out = F.replace(out, F.lit(f"~{short};"), F.lit(word))
    return F.replace(out, F.lit("\u0001"), F.lit("~"))


def generated(components: DataFrame, edges: DataFrame, seeds: DataFrame, budget: int, depth: int = 2, processors: Mapping[str, tuple[int, Processor]] | None = None, form: str = "markdown") -> DataFrame:
    """(id, body) of the context of some seeds (node): expanded, processed, packed and written out."""
    context = chained(expanded(seeds, components, edges, depth), processors or {})
    return FORMATS[form](packed(context, budget).items)


def instantiated(template: DataFrame, instance: str) -> DataFrame:
    """Notes and rules of a template tree (path, parent_path, kind, title, content): ids and parents made of the instance and the paths."""
    name = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.col("kind") if c == "path" else F.lit("note"), F.lit("_"), F.substring(F.sha2(F.concat(F.lit(instance + "/"), F.col(c)), 256), 1, 16)))
    return template.select(name("path").alias("id"), name("parent_path").alias("parent_id"), "kind", "title", "content")
