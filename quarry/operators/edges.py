"""Edge frames (src, dst, type, ...): lookups, normalisation, inversion, evidence, strength."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Types and their inverses, and the names that stand for a type.
ONE_WAY_INVERSES = {
    "extends": "extended_by",
    "implements": "implemented_by",
    "imports": "imported_by",
    "exports": "exported_by",
    "instantiates": "instantiated_by",
    "calls": "called_by",
    "uses": "used_by",
    "decorates": "decorated_by",
    "references": "referenced_by",
    "uses_trait": "trait_used_by",
    "in_namespace": "namespace_contains",
}
NO_INVERSE = ("contains", "belongs_to", "composes", "wraps", "inherits", "overrides", "throws", "catches", "reads", "writes", "sends_to", "defers", "listens_to", "accesses", "modifies", "includes", "delegates_to", "factory_for")
MEMBERSHIP = {
    "class-contains-method": "method-belongs-to-class",
    "class-contains-property": "property-belongs-to-class",
    "class-contains-constructor": "constructor-belongs-to-class",
    "class-contains-member": "member-belongs-to-class",
    "interface-contains-method": "method-belongs-to-interface",
    "interface-contains-property": "property-belongs-to-interface",
    "interface-contains-member": "member-belongs-to-interface",
    "namespace-contains-class": "class-belongs-to-namespace",
    "namespace-contains-interface": "interface-belongs-to-namespace",
    "namespace-contains-member": "member-belongs-to-namespace",
}
SYNONYMS = {
    "class-contains-method": ("class_contains_method", "classmethod"),
    "class-contains-property": ("class_contains_property", "classproperty", "class-contains-field", "class_contains_field"),
    "class-contains-constructor": ("class_contains_constructor",),
    "class-contains-member": ("class_contains_member", "classmember"),
    "interface-contains-method": ("interface_contains_method",),
    "interface-contains-property": ("interface_contains_property", "interface-contains-field"),
    "interface-contains-member": ("interface_contains_member",),
    "namespace-contains-class": ("namespace_contains_class", "module-contains-class", "package-contains-class"),
    "namespace-contains-interface": ("namespace_contains_interface", "module-contains-interface"),
    "namespace-contains-function": ("module-contains-function", "package-contains-function"),
    "namespace-contains-member": ("namespace_contains_member", "module-contains-member"),
    "contains": ("file-contains-component", "file_contains_component", "includes", "has"),
    "extends": ("inherits", "inherits_from", "subclass_of", "derives_from"),
    "implements": ("realizes", "conforms_to"),
    "overrides": ("redefines", "overloads"),
    "imports": ("imports_from", "uses_module", "requires"),
    "exports": ("exports_to", "provides"),
    "imported_by": ("required_by",),
    "exported_by": ("provided_by",),
    "calls": ("invokes", "executes", "calls_function", "calls_method"),
    "called_by": ("invoked_by", "executed_by"),
    "instantiates": ("creates", "constructs", "calls_constructor"),
    "reads": ("accesses", "gets", "reads_from"),
    "writes": ("modifies", "sets", "writes_to", "mutates"),
    "returns": ("yields", "produces"),
    "accepts": ("receives", "takes", "parameters"),
    "references": ("refers_to", "mentions", ""),
    "uses": ("depends_on", "utilizes"),
    "used_by": ("dependency_of",),
    "documents": ("describes", "annotates"),
    "explains": ("clarifies", "comments"),
    "belongs_to": ("contained_by", "member_of", "child_of"),
    "extended_by": ("inherited_by", "subclassed_by"),
    "implemented_by": ("realized_by",),
}
SEMANTIC_WEIGHTS = {
    "calls": 0.9,
    "called_by": 0.9,
    "extends": 1.0,
    "extended_by": 1.0,
    "implements": 0.95,
    "implemented_by": 0.95,
    "transforms_data": 0.85,
    "passes_to": 0.8,
    "returns_from": 0.8,
    "modifies": 0.75,
    "uses_field": 0.7,
    "reads_from": 0.65,
    "writes_to": 0.7,
    "derives_from": 0.75,
    "imports": 0.5,
    "imported_by": 0.5,
    "depends_on": 0.5,
    "awaits": 0.7,
    "yields": 0.65,
    "observes": 0.75,
}
LENSES = {
    "callers": (("calls", "called_by"), "in"),
    "callees": (("calls",), "out"),
    "inheritance": (("extends", "extended_by", "implements", "implemented_by"), "both"),
    "data_flow": (("uses_field", "transforms_data", "passes_to", "returns_from", "reads_from", "writes_to", "derives_from", "modifies"), "both"),
    "dependents": (("imports", "imported_by", "depends_on"), "in"),
    "dependencies": (("imports", "depends_on"), "out"),
}
# End of fixed values.
#: Inverse types of the canonical types, both ways.
INVERSES = ONE_WAY_INVERSES | {v: k for k, v in ONE_WAY_INVERSES.items()}
#: Inverses that normalisation adds: membership, and a type and its inverse but for instances, decorators and traits.
CANONICAL_INVERSES = (
    {k: v for a, b in MEMBERSHIP.items() for k, v in ((a, b), (b, a))}
    | {k: v for a, b in ONE_WAY_INVERSES.items() if a in ("extends", "implements", "imports", "exports", "calls", "uses", "references") for k, v in ((a, b), (b, a))}
    | {"includes": "included_by", "included_by": "includes"}
)


def mapped(column: Column, table: Mapping[str, str], otherwise: Column) -> Column:
    out = otherwise
    for k, v in reversed(table.items()):
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def map_table(table: Mapping[str, str]) -> Column:
    """A constant map column, for tables of many entries."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _either(edges: DataFrame, end: str) -> list[Column]:
    return [F.col(end), *([F.col(f"resolved_{end}")] if f"resolved_{end}" in edges.columns else [])]


def find(edges: DataFrame, src: str | None = None, dst: str | None = None, types: Sequence[str] | None = None) -> DataFrame:
    """Edges whose raw or resolved ends are these, of any of the types; no hidden limit."""
    out = edges
    for end, wanted in (("src", src), ("dst", dst)):
        if wanted is not None:
            hit = F.lit(False)
            for c in _either(edges, end):
                hit |= F.coalesce(c == wanted, F.lit(False))
            out = out.where(hit)
    return out if types is None else out.where(F.col("type").isin(*types))


def one_hop(edges: DataFrame, node: str, direction: str = "both", types: Sequence[str] | None = None) -> DataFrame:
    """Edges of a node: out, in, or both (each edge once)."""
    wanted = {"out": F.col("src") == node, "in": F.col("dst") == node, "both": (F.col("src") == node) | (F.col("dst") == node)}[direction]
    out = edges.where(wanted)
    return out if types is None else out.where(F.col("type").isin(*types))


def lens(edges: DataFrame, node: str, name: str) -> DataFrame:
    """One-hop edges of a node through a lens: callers, callees, inheritance, data_flow, dependents or dependencies."""
    types, direction = LENSES[name]
    return one_hop(edges, node, direction, types)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key (compared in lower case): the first in `order`."""
    window = Window.partitionBy(*[F.lower(F.col(k).cast("string")) for k in keys]).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def richest(items: DataFrame, keys: list[str], texts: list[str], order: list[str], metadata: str | None = None) -> DataFrame:
    """One row per key: that with the longest texts together (ties: `order`); metadata maps are merged, the kept row's values win."""
    size = F.lit(0)
    for t in texts:
        size += F.coalesce(F.length(F.col(t)), F.lit(0))
    best = F.min_by(F.struct("*"), F.struct((-size).alias("size"), *order)).alias("row")
    if metadata is None:
        return items.groupBy(*keys).agg(best).select("row.*")
    entries = items.select(*keys, F.explode(F.map_entries(metadata)).alias("e"), F.struct(size.alias("size"), *order).alias("rank"))
    merged = entries.groupBy(*keys, F.col("e.key").alias("_entry")).agg(F.max_by("e.value", "rank").alias("_value"))
    maps = merged.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_entry", "_value")))).alias("merged"))
    kept = items.groupBy(*keys).agg(best).select("row.*")
    return kept.join(maps, keys, "left").withColumn(metadata, F.coalesce("merged", metadata)).select(*items.columns)


def with_inverses(edges: DataFrame, inverses: Mapping[str, str] = INVERSES, no_inverse: Sequence[str] = NO_INVERSE) -> DataFrame:
    """Edges and the inverse of each whose type has one; `is_inverse` tells them apart, `original_type` where an inverse comes from."""
    table = {k: v for k, v in inverses.items() if k not in no_inverse}
    inverse = edges.where(F.col("type").isin(*table)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), map_table(table)[F.col("type")].alias("type"), F.lit(True).alias("is_inverse"), F.col("type").alias("original_type"))
    return edges.select("src", "dst", "type", F.lit(False).alias("is_inverse"), F.lit(None).cast("string").alias("original_type")).unionByName(inverse)


def by_direction(edges: DataFrame, original: bool = True, inverse: bool = True) -> DataFrame:
    """Edges that are originals, inverses or both; a null is_inverse is an original."""
    flag = F.coalesce(F.col("is_inverse"), F.lit(False))
    return edges.where((F.lit(original) & ~flag) | (F.lit(inverse) & flag))


def of_type_or_inverse(edges: DataFrame, type_: str, inverses: Mapping[str, str] = INVERSES) -> DataFrame:
    return edges.where(F.col("type").isin(*{type_, inverses.get(type_, type_)}))


def canonical_type(type_: Column) -> Column:
    """The canonical type of any of its names; unknown names stay, in lower case; null and empty are references."""
    low = F.lower(F.trim(F.coalesce(type_, F.lit(""))))
    return F.coalesce(map_table({s: k for k, names in SYNONYMS.items() for s in names})[low], low)


def normalised(edges: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Edges of canonical types with their canonical inverses, one of each (src, type, dst) in lower case; edges before inverses, then `order`."""
    base = edges.withColumn("type", canonical_type(F.col("type"))).withColumn("is_inverse", F.lit(False))
    inverse = base.where(F.col("type").isin(*CANONICAL_INVERSES))
    swapped = inverse.select(*[{"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst"), "type": map_table(CANONICAL_INVERSES)[F.col("type")].alias("type"), "is_inverse": F.lit(True).alias("is_inverse")}.get(c, F.col(c)) for c in base.columns])
    return first_wins(base.unionByName(swapped), ["src", "type", "dst"], ["is_inverse", *order, "src", "dst"])


# Order and boosts of the sources of evidence.
PRECEDENCE = {"initial": 1, "basic": 2, "structural": 3, "semantic": 4}
BOOSTS = {2: 0.02, 3: 0.05, 4: 0.1}
# End of fixed values.


def aggregate_evidence(evidence: DataFrame, keys: list[str], boosts: Mapping[int, float] = BOOSTS) -> DataFrame:
    """Confidence of an edge from its evidence (precedence, confidence, age_days).

    Base is the best confidence in the highest precedence; .02 for each further piece (at most .1)
    and the boost of that precedence are added; 1 % a day of the mean age is taken off, down to 0;
    at most 1, to 3 places. consensus is 1 less the variance of all confidences, at least 0.
    """
    top = evidence.groupBy(*keys).agg(
        F.max(F.struct("precedence", "confidence")).alias("best"),
        F.count("*").alias("pieces"),
        F.avg("age_days").alias("age"),
        F.min("confidence").alias("lowest"),
        F.max("confidence").alias("highest"),
        F.greatest(F.lit(0.0), 1 - F.var_pop("confidence")).alias("consensus"),
    )
    boost = F.lit(0.0)
    for level, value in boosts.items():
        boost = F.when(F.col("best.precedence") == level, F.lit(value)).otherwise(boost)
    raw = F.col("best.confidence") + F.least(F.lit(0.1), 0.02 * (F.col("pieces") - 1)) + boost
    decayed = raw * F.greatest(F.lit(0.0), 1 - 0.01 * F.col("age"))
    final = F.floor(F.least(F.lit(1.0), decayed) * 1000 + 0.5) / 1000
    return top.select(*keys, "pieces", F.col("best.precedence").alias("precedence"), final.alias("confidence"), "lowest", "highest", F.round("consensus", 6).alias("consensus"))


def proximity(a_path: Column, a_line: Column, b_path: Column, b_line: Column) -> Column:
    """Of two places: by distance in lines within a file, then by shared folder or parent folder; unknown .5."""
    folder = lambda p: F.regexp_replace(p, "/?[^/]*$", "")
    gap = F.abs(a_line - b_line)
    same = F.when(gap.isNull(), 0.9).when(gap < 50, 1.0).when(gap < 200, 0.8).when(gap < 500, 0.6).otherwise(0.4)
    return F.when(a_path.isNull() | b_path.isNull(), 0.5).when(a_path == b_path, same).when(folder(a_path) == folder(b_path), 0.7).when(folder(folder(a_path)) == folder(folder(b_path)), 0.5).otherwise(0.3)


def usage_score(uses: Column) -> Column:
    return F.when(F.coalesce(uses, F.lit(0)) == 0, 0.0).when(uses == 1, 0.3).when(uses < 5, 0.5).when(uses < 10, 0.7).when(uses < 50, 0.85).otherwise(1.0)


def recency_score(days: Column) -> Column:
    """By days since the last access; unknown .5."""
    return F.when(days.isNull(), 0.5).when(days < 1, 1.0).when(days < 7, 0.8).when(days < 30, 0.6).when(days < 90, 0.4).otherwise(0.2)


def semantic_weight(type_: Column) -> Column:
    return F.coalesce(map_table({k: str(v) for k, v in SEMANTIC_WEIGHTS.items()})[type_].cast("double"), F.lit(0.5))


def with_strength(edges: DataFrame, items: DataFrame) -> DataFrame:
    """Edges (src, dst, type, uses, days) with `strength`, by the places of their ends (items: id, path, line)."""
    a = items.select(F.col("id").alias("src"), F.col("path").alias("a_path"), F.col("line").alias("a_line"))
    b = items.select(F.col("id").alias("dst"), F.col("path").alias("b_path"), F.col("line").alias("b_line"))
    near = proximity(F.col("a_path"), F.col("a_line"), F.col("b_path"), F.col("b_line"))
    score = strength(semantic_weight(F.col("type")), usage_score(F.col("uses")), near, recency_score(F.col("days")))
    return edges.join(a, "src", "left").join(b, "dst", "left").select(*edges.columns, F.round(score, 6).alias("strength"))


def strength(semantic: Column, usage: Column, proximity: Column, recency: Column) -> Column:
    """.4 semantic + .3 usage + .2 proximity + .1 recency, in 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.4 * semantic + 0.3 * usage + 0.2 * proximity + 0.1 * recency))


def matching(edges: DataFrame, text: str) -> DataFrame:
    """Edges whose type or metadata (JSON text) holds the text, in any case."""
    low = text.lower()
    return edges.where(F.coalesce(F.contains(F.lower("type"), F.lit(low)), F.lit(False)) | F.coalesce(F.contains(F.lower("metadata"), F.lit(low)), F.lit(False)))


def type_frame(spark: SparkSession, table: Mapping[str, str], names: tuple[str, str] = ("type", "inverse")) -> DataFrame:
    """A table of types as a frame, for joins."""
    return spark.createDataFrame(list(table.items()), f"{names[0]} string, {names[1]} string")
