"""Reranking of results by named factors that add up to one score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import ranking as rk
from quarry.functions import vector as vec

# Factors of names, days and presets.
NAME_FACTORS = {"class": 1.3, "interface": 1.2, "function": 1.1, "method": 1.1}
NOISY_PATHS = ("coverage/", "coverage-integration/", "lcov-report/", "node_modules/")


@dataclass(frozen=True)
class Config:
    """Weights of the factors and amounts of the boosts; per_type overrides weights by entity type."""

    similarity: float = 0.6
    name_match: float = 0.2
    type_boost: float = 0.1
    recency: float = 0.05
    relationships: float = 0.05
    context_overlap: float = 0.0
    analytics: float = 0.0
    exact_name: float = 1.0
    partial_name: float = 0.3
    preferred_types: tuple[str, ...] = ("function", "class", "interface")
    type_amount: float = 0.15
    entity_weights: Mapping[str, float] = field(default_factory=dict)
    noisy_paths: tuple[str, ...] = ()
    noisy_amount: float = 0.2
    context: str = ""
    per_type_z: bool = False
    per_type: Mapping[str, Mapping[str, float]] = field(default_factory=dict)


DEFAULT = Config()
DUAL_CHANNEL = Config(
    name_match=0.15, type_boost=0.0, context_overlap=0.15, analytics=0.15, exact_name=0.25, partial_name=0.1, preferred_types=(), type_amount=0.0,
    entity_weights={"component": 1.0, "task": 0.7, "note": 0.6, "rule": 0.8}, per_type_z=True, noisy_paths=NOISY_PATHS,
    per_type={"component": {"similarity": 0.6, "name_match": 0.2, "context_overlap": 0.2, "analytics": 0.0}, "rule": {"similarity": 0.4, "analytics": 0.3, "context_overlap": 0.3, "name_match": 0.0}},
)
COMPONENTS = Config(
    similarity=0.45, name_match=0.3, type_boost=0.2, exact_name=0.8, partial_name=0.2, preferred_types=("function", "class", "interface", "method"), type_amount=0.3,
    entity_weights={"component": 1.0, "task": 0.4, "note": 0.3, "rule": 0.3}, noisy_paths=(*NOISY_PATHS, "vendor/"), noisy_amount=0.25,
)
UNIVERSAL = Config(
    similarity=0.65, name_match=0.25, exact_name=0.6, partial_name=0.1, preferred_types=("class", "interface", "function", "method"), type_amount=0.2,
    entity_weights={"component": 1.0, "task": 0.6, "note": 0.5, "rule": 0.5}, noisy_paths=(*NOISY_PATHS, "vendor/"),
)
# End of fixed values.
FACTORS = ("similarity", "name_match", "type_boost", "recency", "relationships", "context_overlap", "analytics")
#: What the server form of a weight 0 stands for, with zero_means_default.
_WEIGHTS = {f: getattr(DEFAULT, f) for f in FACTORS}


def by_kind(kind: Column, table: Mapping[str, float], otherwise: float | Column) -> Column:
    """The table's value of a kind."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for k, v in reversed(table.items()):
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def split_words(text: Column) -> Column:
    """Lower-cased alphanumeric words of two or more characters, split at case changes."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: F.length(w) > 1)


def recency_step(days: Column, steps: Sequence[tuple[float, float]] = ((7, 0.1), (30, 0.05), (90, 0.02)), otherwise: float = 0.0) -> Column:
    """The value of the first step that the days are under; null days give 0."""
    out = F.lit(otherwise)
    for limit, value in reversed(list(steps)):
        out = F.when(days < limit, F.lit(value)).otherwise(out)
    return F.when(days.isNull(), F.lit(0.0)).otherwise(out)


def name_score(name: Column, kind: Column, query: str, exact: float, partial: float) -> Column:
    """Equal but for separators: exact times a factor by kind; holds the query: partial; else partial by the share of words."""
    q = F.lit(query.lower())
    low = F.lower(name)
    bare_q, bare = F.regexp_replace(q, "[^a-z0-9]", ""), F.regexp_replace(low, "[^a-z0-9]", "")
    same = ((bare_q != "") & (bare == bare_q)) | (low == q)
    wanted, words = split_words(q), split_words(low)
    hits = F.size(F.filter(wanted, lambda w: F.exists(words, lambda n: F.contains(n, w) | F.contains(w, n))))
    shared = F.when(hits > 0, hits / F.size(wanted) * F.lit(partial)).otherwise(0.0)
    score = F.when(same, F.lit(exact) * by_kind(F.lower(F.coalesce(kind, F.lit(""))), NAME_FACTORS, 1.0)).when(F.contains(low, q), F.lit(partial)).otherwise(shared)
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(0.0)).otherwise(score)


def _unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(x.cast("double"), F.lit(0.0))))


def standardised(items: DataFrame) -> DataFrame:
    """Items with similarity as squashed z-scores of their entity type; its mean and deviation come from one aggregate."""
    group = F.coalesce("entity_type", "type", F.lit("unknown"))
    value = F.coalesce("similarity", F.lit(0.0))
    stats = items.groupBy(group.alias("z_group")).agg(F.avg(value).alias("z_mean"), F.stddev_samp(value).alias("z_std"))
    z = F.coalesce((value - F.col("z_mean")) / F.nullif(F.coalesce("z_std", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    return items.withColumn("z_group", group).join(stats, "z_group").withColumn("similarity", vec.squashed(z)).drop("z_group", "z_mean", "z_std")


def reranked(items: DataFrame, query: str, config: Config = DEFAULT, zero_means_default: bool = False) -> DataFrame:
    """Items with the columns of FACTORS and `final_score`.

    Items: name, type, entity_type, similarity, content, path, days (since the update), edges (their
    number), and for rules acceptance, effectiveness, uses and days_unused. Missing values count as
    none. The caller orders by final_score and an id of its own.
    """
    if config.per_type_z:
        items = standardised(items)
    context = split_words(F.lit(config.context.lower()))
    own = F.array_distinct(split_words(F.lower(F.concat_ws(" ", "name", "content"))))
    asked = F.array_distinct(context)
    both = F.size(F.array_intersect(asked, own))
    overlap = F.when((F.size(asked) == 0) | (F.size(own) == 0), F.lit(0.0)).otherwise(both / (F.size(asked) + F.size(own) - both))
    used = F.when(F.col("days_unused").isNull(), F.lit(0.0)).otherwise(recency_step(F.col("days_unused"), ((7, 1.0), (30, 0.6), (90, 0.3)), 0.1))
    analytics = F.least(F.lit(1.0), (_unit(F.col("acceptance")) + _unit(F.col("effectiveness")) + _unit(F.col("uses") / 50) + used) / 4)
    edges = F.coalesce("edges", F.lit(0))
    factors = {
        "similarity": F.coalesce("similarity", F.lit(0.0)),
        "name_match": name_score(F.col("name"), F.col("type"), query, config.exact_name, config.partial_name),
        "type_boost": F.when(F.col("type").isin(*config.preferred_types), F.lit(config.type_amount)).otherwise(0.0) if config.preferred_types else F.lit(0.0),
        "recency": recency_step(F.col("days")),
        "relationships": F.when(edges == 0, F.lit(0.0)).otherwise(F.least(F.lit(0.2), F.log10(edges + 1) * 0.1)),
        "context_overlap": overlap,
        "analytics": F.when(F.coalesce("entity_type", "type") == "rule", analytics).otherwise(0.0),
    }
    out = items.select("*", *[v.cast("double").alias(f"factor_{k}") for k, v in factors.items()])
    total = F.lit(0.0)
    for f in FACTORS:
        plain = getattr(config, f)
        weights = {kind: w[f] for kind, w in config.per_type.items() if f in w}
        if zero_means_default:
            plain, weights = plain or _WEIGHTS[f], {k: w or _WEIGHTS[f] for k, w in weights.items()}
        total += F.col(f"factor_{f}") * by_kind(F.col("entity_type"), weights, plain)
    total *= by_kind(F.col("entity_type"), {k: max(0.0, w) for k, w in config.entity_weights.items()}, 1.0)
    hits = F.lit(0)
    for p in config.noisy_paths:
        hits += F.coalesce(F.contains(F.lower("path"), F.lit(p)), F.lit(False)).cast("int")
    return out.withColumn("final_score", F.when(hits > 0, F.greatest(F.lit(0.0), total - hits * config.noisy_amount)).otherwise(total))


@dataclass(frozen=True)
class Factors:
    """The library reranker's factors; None leaves one out. custom: name to (column, weight)."""

    base: str | float = "similarity"
    semantic: float | None = None
    name: tuple[float, float, float] | None = None
    name_by_type: Mapping[str, float] = field(default_factory=dict)
    content: float | None = None
    content_fields: Mapping[str, float] = field(default_factory=lambda: {"content": 1.0, "description": 1.0, "documentation": 1.0})
    tags: float | None = None
    tag_weights: Mapping[str, float] = field(default_factory=dict)
    edges: tuple[float, float] | None = None
    edge_weights: Mapping[str, float] = field(default_factory=dict)
    temporal: tuple[float, float, str] | None = None
    popularity: tuple[float, float, str] | None = None
    custom: Mapping[str, tuple[Column, float]] = field(default_factory=dict)


def _holding(texts: Column, term: str) -> Column:
    return F.filter(texts, lambda x: F.contains(x, F.lit(term)))


def factor_columns(query: str, f: Factors, vector: Column | None = None) -> dict[str, Column]:
    """The named score columns over items (similarity, embedding, name, type, content, description, documentation, tags, edges array of (type, weight), days, uses, popularity)."""
    low, asked = query.lower(), [t for t in query.lower().split() if t]
    out = {"base": F.coalesce("similarity", F.lit(0.0)) if f.base == "similarity" else F.lit(float(0 if f.base == "zero" else f.base))}
    if f.semantic is not None and vector is not None:
        out["semantic"] = F.when(F.col("embedding").isNull(), F.lit(0.0)).otherwise(vec.cosine(vector, F.col("embedding")) * f.semantic)
    if f.name is not None and low:
        exact, partial, fuzzy = f.name
        s = rk.text_similarity(F.col("name"), F.lit(low))
        score = F.when(s["exact"], F.lit(exact)).when(s["partial"] > 0, s["partial"] * partial).when(s["fuzzy"] > 0.3, s["fuzzy"] * fuzzy).otherwise(0.0)
        out["name"] = F.when(F.coalesce("name", F.lit("")) == "", F.lit(0.0)).otherwise(score * by_kind(F.col("type"), f.name_by_type, 1.0))
    if f.content is not None and asked:
        score = F.lit(0.0)
        for column, boost in f.content_fields.items():
            hits = F.lit(0)
            for t in asked:
                hits += F.coalesce(F.contains(F.lower(column), F.lit(t)), F.lit(False)).cast("int")
            score += hits / len(asked) * (f.content * boost)
        out["content"] = score
    if f.tags is not None and asked:
        score = F.lit(0.0)
        low_tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
        for t in asked:
            score += F.aggregate(_holding(low_tags, t), F.lit(0.0), lambda acc, g: acc + f.tags * by_kind(g, f.tag_weights, 1.0))
        out["tags"] = score
    if f.edges is not None:
        each, most = f.edges
        score = F.aggregate(F.col("edges"), F.lit(0.0), lambda acc, e: acc + each * by_kind(e["type"], f.edge_weights, 1.0) * F.coalesce(F.nullif(e["weight"], F.lit(0.0)), F.lit(1.0)))
        out["edges"] = F.coalesce(F.least(score, F.lit(most)), F.lit(0.0))
    if f.temporal is not None:
        boost, window, decay = f.temporal
        x = F.col("days") / window
        shape = {"linear": 1 - x, "exponential": F.exp(-2 * x), "logarithmic": 1 - F.log1p(x)}[decay]
        out["temporal"] = F.when(F.col("days") <= window, shape * boost).otherwise(0.0)
    if f.popularity is not None:
        uses, popular, shape = f.popularity
        raw = F.coalesce("uses", F.lit(0)) * uses + F.coalesce("popularity", F.lit(0.0)) * popular
        out["popularity"] = {"log": F.log1p(raw), "sqrt": F.sqrt(raw)}.get(shape, raw)
    for name, (column, weight) in f.custom.items():
        out[f"custom_{name}"] = column * weight
    return out


def rerank_by_factors(items: DataFrame, query: str, factors: Factors, vector: Column | None = None, mode: str = "additive") -> DataFrame:
    """Items with `breakdown` (struct of the factors' scores) and `final_score`; mode `weighted` is the same sum."""
    if mode not in ("additive", "weighted"):
        raise ValueError(f"mode {mode!r} isn't defined")
    columns = factor_columns(query, factors, vector)
    total = F.lit(0.0)
    for c in columns:
        total += F.col(f"breakdown.{c}")
    return items.select("*", F.struct(*[v.cast("double").alias(k) for k, v in columns.items()]).alias("breakdown")).withColumn("final_score", total)


def with_boosts(config: Config, **changes) -> Config:
    """A preset with some of its values changed."""
    return replace(config, **changes)
