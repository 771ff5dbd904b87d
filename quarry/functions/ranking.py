"""Column functions that score, classify and tag named items with text."""

from __future__ import annotations

import math

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds by the substrings that name them, in order of precedence.
LAYERS = {
    "controller": (("controller",), ("controller",)),
    "service": (("service",), ("service",)),
    "data": (("repository", "dao"), ("repository",)),
    "model": (("model", "entity"), ("model",)),
    "presentation": (("view", "component"), ("view",)),
    "middleware": (("middleware",), ("middleware",)),
    "utility": (("util", "helper"), ("util",)),
}
DOMAINS = {
    "auth": ("auth", "login", "user", "session", "token", "security"),
    "payment": ("payment", "billing", "invoice", "transaction", "money"),
    "notification": ("notification", "email", "message", "alert", "notify"),
    "analytics": ("analytics", "metrics", "tracking", "stats", "report"),
    "admin": ("admin", "management", "dashboard", "configuration"),
    "api": ("api", "endpoint", "route", "controller", "rest"),
    "data": ("database", "storage", "persistence", "repository", "dao"),
}
TERMS = ("bug", "todo", "fixme", "hack", "performance", "security", "refactor", "optimize", "test", "documentation", "api", "database", "frontend", "backend", "ui", "ux")
PATTERNS = {"Factory": ("Factory", "create"), "Observer": ("Observer", "subscribe"), "Singleton": ("getInstance", "Singleton"), "Builder": ("Builder", "build")}
CHARS_PER_TOKEN = {"json": 3.5, "markdown": 4.0, "index": 4.0, "text": 4.5}
KEYWORD_STOPS = ("the", "and", "for", "with", "from", "into")
KEYWORD_BREAKS = r"""[\s.,;:!?"'()\[\]{}/\\|<>+=\-*&^%$#@~`]+"""
# End of fixed values.


def any_contains(texts: Sequence[Column], needles: Sequence[str]) -> Column:
    """Whether one of the texts holds one of the needles; null texts hold none."""
    found = F.lit(False)
    for t in texts:
        for n in needles:
            found |= F.coalesce(F.contains(t, F.lit(n)), F.lit(False))
    return found


def first_kind(cases: Mapping[str, Column]) -> Column:
    """The first kind whose condition holds, else null."""
    out = F.lit(None).cast("string")
    for kind, holds in reversed(cases.items()):
        out = F.when(holds, kind).otherwise(out)
    return out


def architectural_layer(path: Column, name: Column) -> Column:
    path, name = F.lower(path), F.lower(name)
    return first_kind({k: any_contains([path], in_path) | any_contains([name], in_name) for k, (in_path, in_name) in LAYERS.items()})


def business_domain(path: Column, name: Column, code: Column) -> Column:
    texts = [F.lower(path), F.lower(name), F.lower(code)]
    return first_kind({k: any_contains(texts, needles) for k, needles in DOMAINS.items()})


def pattern_tags(name: Column) -> Column:
    """Design patterns that a name tells of, in fixed order."""
    return F.array_compact(F.array(*[F.when(any_contains([name], needles), kind) for kind, needles in PATTERNS.items()]))


def auto_tags(text: Column) -> Column:
    """Hash tags, lower-cased, then the fixed terms that the text holds; each once."""
    hashed = F.transform(F.regexp_extract_all(text, F.lit(r"#(\w+)"), F.lit(1)), F.lower)
    terms = F.array_compact(F.array(*[F.when(F.contains(F.lower(text), F.lit(t)), t) for t in TERMS]))
    return F.array_distinct(F.concat(hashed, terms))


def specifier_class(spec: Column) -> Column:
    """junk, namespace, path or bare; null and empty specifiers are junk."""
    s = F.trim(F.coalesce(spec, F.lit("")))
    marked = s.startswith("{") | s.startswith("[") | any_contains([s], ("class:", "file:"))
    back = F.contains(s, F.lit("\\"))
    return (
        F.when((s == "") | marked, "junk")
        .when(back & ~F.contains(s, F.lit("/")), "namespace")
        .when(back | s.rlike(r"^(\./|\.\./|/)"), "path")
        .when(s.rlike("[\n\r]"), "junk")
        .otherwise("bare")
    )


def text_similarity(a: Column, b: Column) -> Column:
    """Struct of exact, partial (0.8 if one holds the other) and fuzzy (Jaccard of words) similarity."""
    a, b = F.trim(F.lower(a)), F.trim(F.lower(b))
    x, y = F.array_distinct(F.split(a, r"\s+")), F.array_distinct(F.split(b, r"\s+"))
    partial = F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.8).otherwise(0.0)
    fuzzy = F.when(a == b, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
    return F.struct((a == b).alias("exact"), partial.alias("partial"), fuzzy.alias("fuzzy"))


def highlights(text: Column, terms: Sequence[str], most: int = 3) -> Column:
    """The first sentences that hold a term."""
    sentences = F.filter(F.split(text, "[.!?]+", -1), lambda s: F.trim(s) != "")
    hits = F.filter(sentences, lambda s: any_contains([F.lower(s)], [t.lower() for t in terms]))
    return F.transform(F.slice(hits, 1, most), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))


def summarised(text: Column, most: int) -> Column:
    """Texts over `most` characters: whole sentences that fit, or else the head, with dots."""
    start = F.struct(F.lit("").alias("said"), F.lit(True).alias("open"))

    def add(acc: Column, s: Column) -> Column:
        fits = acc["open"] & (F.length(acc["said"]) + F.length(s) + 1 <= most - 3)
        return F.struct(F.when(fits, F.concat(acc["said"], s, F.lit("."))).otherwise(acc["said"]).alias("said"), fits.alias("open"))

    said = F.aggregate(F.split(text, "[.!?]+", -1), start, add, lambda acc: acc["said"])
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(said == "", F.substring(text, 1, most - 3)).otherwise(said), F.lit("...")))


def estimated_tokens(text: Column, form: str) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(CHARS_PER_TOKEN[form])).cast("long")


def relevance(kind_weight: Column, name: Column, doc: Column, code: Column, query: str, keywords: Sequence[str]) -> Column:
    """Weight of the kind, five times for the exact name; 2, 1 and 0.1 a keyword in name, documentation and code."""
    score = F.when(F.lower(name) == query.lower(), kind_weight * 5.0).otherwise(kind_weight)
    for k in keywords:
        for text, points in ((name, 2.0), (doc, 1.0), (code, 0.1)):
            score += F.when(any_contains([F.lower(text)], [k]), points).otherwise(0.0)
    return score if keywords else kind_weight


def importance(degree: Column, important: Column) -> Column:
    return 0.6 * F.least(degree / 10, F.lit(1.0)) + 0.4 * F.least(important / 5, F.lit(1.0))


def rule_confidence(effectiveness: Column, uses: Column) -> Column:
    base = 0.5 * (0.8 + 0.2 * effectiveness)
    return F.least(F.when(uses > 10, base * 1.05).otherwise(base), F.lit(1.0))


def tag_class(tag: Column) -> Column:
    auto = tag.rlike("^(auto|lang|type):") | F.contains(tag, F.lit("generated"))
    contextual = tag.rlike("^(context|location):") | any_contains([tag], ("session", "temp"))
    return first_kind({"auto": auto, "contextual": contextual, "stable": tag.isNotNull()})


def rendered(template: Column, values: Mapping[str, Column]) -> Column:
    """The template with each {{key}} replaced; null and empty values leave it."""
    for key, value in values.items():
        template = F.when(F.coalesce(value, F.lit("")) == "", template).otherwise(F.replace(template, F.lit("{{" + key + "}}"), value))
    return template


def hash_vector(text: Column, size: int = 16) -> Column:
    """Unit vector of `size` (up to 16) values from the SHA-256 of the text: equal texts, equal vectors."""
    digest = F.sha2(text, 256)
    raw = F.array(*[F.conv(F.substring(digest, 4 * k + 1, 4), 16, 10).cast("double") / 32767.5 - 1 for k in range(size)])
    return _unit(raw, 0.0)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: a lambda computes what it names from outside anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _unit(raw: Column, least: float) -> Column:
    """The array divided by its length (and `least`)."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)) + least
    return _bound(raw, lambda v: _bound(norm(v), lambda n: F.transform(v, lambda x: x / n)))


def normal_vector(text: Column, size: int = 384, normalise: bool = True) -> Column:
    """Vector of `size` values drawn from the normal distribution by SHA-256 of the text: equal texts, equal vectors; null for null.

    Each digest of the text and a number gives four pairs of uniform values, and these (Box and Muller)
    four pairs of normal ones.
    """
    number = lambda digest, k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("double")

    def two(digest: Column, j: Column) -> Column:
        pair = F.struct(F.sqrt(-2 * F.log((number(digest, 2 * j) + 1) / 4294967296.0)).alias("r"), (2 * math.pi * number(digest, 2 * j + 1) / 4294967296.0).alias("a"))
        return _bound(pair, lambda p: F.array(p["r"] * F.cos(p["a"]), p["r"] * F.sin(p["a"])))

    def eight(k: Column) -> Column:
        digest = F.sha2(F.concat(text, F.lit("#"), k.cast("string")), 256)
        return _bound(digest, lambda d: F.flatten(F.transform(F.array(*(F.lit(j) for j in range(4))), lambda j: two(d, j))))

    raw = F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(-(-size // 8) - 1)), eight)), 1, size)
    return F.when(text.isNotNull(), _unit(raw, 1e-12) if normalise else raw)
