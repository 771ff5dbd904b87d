"""Matching of rules to components: triggers, scores, applicable rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import ranking as rk

# Weight of a component's type in its complexity.
TYPE_COMPLEXITY = {"class": 3, "function": 2, "method": 2, "interface": 1, "variable": 1, "property": 1}
# End of fixed values.


def glob_pattern(pattern: Column) -> Column:
    """The regular expression of a glob: ** any depth, * and ? within a part."""
    out = F.regexp_replace(pattern, r"([.+^$(){}|\[\]\\])", r"\\$1")
    out = F.regexp_replace(out, r"\*\*/", "\u0001")
    out = F.regexp_replace(out, r"\*\*", "\u0002")
    out = F.regexp_replace(F.regexp_replace(out, r"\*", "[^/]*"), r"\?", "[^/]")
    out = F.replace(F.replace(out, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("\u0002"), F.lit(".*"))
    return F.concat(F.lit("^"), out, F.lit("$"))


def matches_glob(path: Column, pattern: Column) -> Column:
    return F.coalesce(F.regexp_like(path, glob_pattern(pattern)), F.lit(False))


def type_trigger(types: Column, type_: Column) -> Column:
    """.9 where the type is named, .7 for a wildcard, else 0."""
    return F.when(F.array_contains(types, type_), 0.9).when(F.array_contains(types, "*"), 0.7).otherwise(0.0)


def file_trigger(patterns: Column, path: Column) -> Column:
    """The surest matching pattern: .5, .1 for each folder (at most .3), .1 for a dot and .1 without wildcards."""
    hits = F.filter(patterns, lambda p: matches_glob(path, p))
    slashes = lambda p: F.length(p) - F.length(F.replace(p, F.lit("/")))
    sure = F.transform(hits, lambda p: F.least(F.lit(1.0), 0.5 + F.least(slashes(p) * 0.1, F.lit(0.3)) + F.when(F.contains(p, F.lit(".")), 0.1).otherwise(0.0) + F.when(p.rlike(r"[*?]"), 0.0).otherwise(0.1)))
    return F.coalesce(F.array_max(sure), F.lit(0.0))


def relationship_trigger(wanted: Column, types: Column, aliases: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Share of the wanted edge types (or an alias of one) that a component has."""
    names = lambda t: t
    if aliases:
        table = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(F.lit(k), *[F.lit(a) for a in v]))])
        hit = lambda t: F.arrays_overlap(F.coalesce(table[t], F.array(names(t))), types)
    else:
        hit = lambda t: F.array_contains(types, t)
    return F.when(F.size(wanted) > 0, F.size(F.filter(wanted, hit)) / F.size(wanted)).otherwise(0.0)


#: Triggers by name: columns of the rule and the component to a confidence. Callers add their own.
TRIGGERS: dict[str, Callable[[], Column]] = {
    "type": lambda: type_trigger(F.col("r.component_types"), F.col("c.type")),
    "file": lambda: file_trigger(F.col("r.files"), F.col("c.path")),
}


def complexity(type_: Column, code: Column, edges: Column) -> Column:
    """By type, lines of code over 10 (at most 5) and edges over 5 (at most 3), to the nearest whole."""
    base = F.lit(1)
    for name, value in TYPE_COMPLEXITY.items():
        base = F.when(type_ == name, value).otherwise(base)
    lines = F.when(F.coalesce(code, F.lit("")) != "", F.least(F.lit(5.0), F.size(F.split(code, "\n")) / 10)).otherwise(0.0)
    return F.floor(base + lines + F.least(F.lit(3.0), F.coalesce(edges, F.lit(0)) / 5) + 0.5)


#: Parts that rules without anything to look up are dealt to, so that no task meets all components.
_ANYWHERE = 16


def glob_key(pattern: Column) -> Column:
    """(kind, value) that the path of every match of a glob has: the path itself, its first folder, its extension, or nothing."""
    literal = F.regexp_extract(pattern, r"^([^*?/]+)/", 1)
    ending = F.regexp_extract(pattern, r"\.([^.*?/]+)$", 1)
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    return F.when(~pattern.rlike("[*?]"), key("path", pattern)).when(literal != "", key("top", literal)).when(ending != "", key("ext", ending)).otherwise(key("any", F.lit("")))


def pattern_key(pattern: Column) -> Column:
    """(kind, value): three letters that every match of a regular expression holds, in lower case, or nothing.

    They are found in patterns of literals and the signs . * + ? ^ $ only; others may match anywhere.
    """
    runs = F.split(F.regexp_replace(F.regexp_replace(pattern, ".[?*]", "\u0001"), "[.+^$]", "\u0001"), "\u0001")
    longest = F.array_max(F.transform(runs, lambda x: F.struct(F.length(x).alias("n"), x.alias("run"))))["run"]
    known = pattern.rlike(r"^\^?[\w .*+?$/-]*$") & (F.length(longest) >= 3)
    return F.when(known, F.struct(F.lit("gram").alias("kind"), F.lower(F.substring(longest, 1, 3)).alias("value"))).otherwise(F.struct(F.lit("anything").alias("kind"), F.lit("").alias("value")))


def rule_index(rules: DataFrame) -> DataFrame:
    """(rule_id, what, kind, value, test): a row for each trigger of each rule, by what a component has to have for it to hold.

    A `test` is the glob or regular expression that is left to try on those that have it.
    """
    plain = lambda what, column: F.transform(F.array_distinct(F.coalesce(column, F.array().cast("array<string>"))), lambda x: F.struct(F.lit(what).alias("what"), F.lit(what).alias("kind"), x.alias("value"), F.lit(None).cast("string").alias("test"), F.lit(0).alias("n")))
    tried = lambda what, column, key: F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(what).alias("what"), key(x)["kind"].alias("kind"), key(x)["value"].alias("value"), x.alias("test"), i.alias("n")))
    rows = F.concat(plain("component_type", F.col("component_types")), plain("language", F.col("languages")), plain("layer", F.col("layers")), plain("domain", F.col("domains")), tried("file_pattern", F.col("files"), glob_key), tried("pattern", F.col("patterns"), pattern_key))
    return rules.select(F.col("id").alias("rule_id"), F.explode(rows).alias("x")).select("rule_id", "x.*").where("kind IS NOT NULL AND value IS NOT NULL")


def _hits(components: DataFrame, index: DataFrame) -> DataFrame:
    """(component_id, rule_id, what): a row for each trigger that holds, looked up by equality and tried only where that finds them."""
    path = F.col("path")
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    ext, top = F.nullif(F.regexp_extract(path, r"\.([^./]+)$", 1), F.lit("")), F.nullif(F.regexp_extract(path, "^([^/]+)/", 1), F.lit(""))
    slot = F.pmod(F.xxhash64("id"), F.lit(_ANYWHERE))
    keys = F.array(key("component_type", F.col("type")), key("language", F.col("language")), key("layer", F.col("layer")), key("domain", F.col("domain")), key("path", path), key("top", top), key("ext", ext), key("any", slot))
    # the rules that may hold anywhere stand in each slot, a component in one of them
    slots = F.sequence(F.lit(0), F.lit(_ANYWHERE - 1)).cast("array<string>")
    index = index.select("rule_id", "what", "kind", "test", "n", F.explode(F.when(F.col("kind").isin("any", "anything"), slots).otherwise(F.array("value"))).alias("value"))
    small = components.select("id", "path", F.explode(keys).alias("k")).select("id", "path", "k.*").where("value IS NOT NULL")
    looked_up = small.join(index, ["kind", "value"]).where(F.col("test").isNull() | matches_glob(F.col("path"), F.col("test")))
    found = looked_up.select(F.col("id").alias("component_id"), "rule_id", "what")

    text = F.lower(F.concat_ws("\n", "name", "code"))
    wanted = index.where("kind = 'gram'").select("value").distinct()
    grams = components.select("id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1)))).alias("value")).join(wanted, "value", "left_semi").withColumn("kind", F.lit("gram"))
    anything = components.select("id", slot.cast("string").alias("value"), F.lit("anything").alias("kind"))
    maybe = grams.unionByName(anything).join(index.where("what = 'pattern'"), ["kind", "value"]).select("id", "rule_id", "test", "n")
    hit = lambda c: F.coalesce(F.regexp_like(c, F.concat(F.lit("(?i)"), F.col("test"))), F.lit(False))
    named = maybe.join(components.select("id", "name", "code"), "id").where(hit("name") | hit("code"))
    return found.unionByName(named.select(F.col("id").alias("component_id"), "rule_id", F.lit("pattern").alias("what")))


def match_scores(components: DataFrame, rules: DataFrame) -> DataFrame:
    """(component_id, rule_id, priority, confidence, triggers) of each component and rule with a trigger that holds.

    components: id (unique), type, path, language, name, code, edges. rules: id (unique), priority, component_types,
    files, languages, patterns, layers, domains (arrays) and least_complexity, most_complexity,
    wants_edges. An index of the rules' triggers is joined by equality, so that a component meets the
    rules that may hold for it and no others; patterns without three letters to look up meet all.
    """
    placed = components.select("id", "type", "path", "language", "name", "code", "edges", rk.architectural_layer(F.col("path"), F.col("name")).alias("layer"), rk.business_domain(F.col("path"), F.col("name"), F.col("code")).alias("domain"))
    weights = {"component_type": 0.3, "file_pattern": 0.2, "language": 0.1, "pattern": 0.2, "layer": 0.25, "domain": 0.15}
    # dealt by component once, for the counts and for the join with what is known of it
    hits = _hits(placed, rule_index(rules)).repartition("component_id").groupBy("component_id", "rule_id").agg(*(F.count_if(F.col("what") == w).alias(w) for w in weights))
    facts = components.select(F.col("id").alias("component_id"), "edges", complexity(F.col("type"), F.col("code"), F.col("edges")).alias("complexity"))
    both = hits.join(facts, "component_id").join(rules.select(F.col("id").alias("rule_id"), "priority", "least_complexity", "most_complexity", "wants_edges"), "rule_id")
    score = F.lit(0.0)
    for name, weight in weights.items():
        score += F.col(name) * weight
    for holds in (F.col("complexity") >= F.col("least_complexity"), F.col("complexity") <= F.col("most_complexity"), F.col("wants_edges") & (F.col("edges") > 0)):
        score += F.when(holds, 0.1).otherwise(0.0)
    score *= F.when(F.col("priority") > 5, 1.1).otherwise(1.0) * F.when(F.col("complexity") > 10, 0.9).otherwise(1.0) * F.when(F.col("edges") > 0, 1.05).otherwise(1.0)
    named = F.array_compact(F.array(*[F.when(F.col(name) > 0, name) for name in weights]))
    return both.select("component_id", "rule_id", "priority", F.least(F.lit(1.0), score).alias("confidence"), named.alias("triggers"))


def applicable(scores: DataFrame, least: float = 0.5, most: int = 10) -> DataFrame:
    """The rules of each component of at least `least`, by priority and then confidence, at most `most`."""
    w = Window.partitionBy("component_id").orderBy(F.desc("priority"), F.desc("confidence"), "rule_id")
    return scored_places(scores.where(F.col("confidence") >= least), w).where(F.col("place") <= most)


def scored_places(scores: DataFrame, w: Window) -> DataFrame:
    return scores.withColumn("place", F.row_number().over(w))


def auto_executable(confidence: Column, auto_apply: Column) -> Column:
    return F.coalesce(auto_apply, F.lit(False)) & (confidence > 0.9)


def conflicts(rules: DataFrame) -> DataFrame:
    """(a, b) of rules (id, trigger, guidance) with the same trigger and different guidance.

    Of each trigger, the first rule of each other guidance stands for it against the first of all,
    and copies of a guidance are told by `members`: no group is expanded into all pairs.
    """
    texts = rules.groupBy("trigger", "guidance").agg(F.min("id").alias("id"), F.count("*").alias("members"))
    w = Window.partitionBy("trigger").orderBy("id")
    first = texts.withColumn("a", F.first("id").over(w))
    return first.where("id <> a").select("a", F.col("id").alias("b"), "members")


def transitions(tasks: DataFrame, flow: DataFrame) -> DataFrame:
    """(id, transition) of tasks (id, current, target): the first row of flow (place, transition, from, to) that allows it; * and any are wildcards."""
    ends = lambda a, b: (F.col(a) == F.col(b)) | F.col(b).isin("*", "any")
    met = tasks.join(flow, ends("current", "from") & ends("target", "to"))
    return met.groupBy("id").agg(F.min_by("transition", "place").alias("transition"))


def requirement_errors(tasks: DataFrame, children: DataFrame, least_children: int = 0, child_status: str | None = None, sections: Sequence[str] = ()) -> DataFrame:
    """(id, errors): what a workflow still asks of tasks (id, description): sections, a number of children, a status of all of them."""
    counts = children.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == (child_status or "")).alias("ready"))
    rows = tasks.join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("ready", F.coalesce("ready", F.lit(0)))
    wrong = [F.when(~F.coalesce(F.col("description").rlike(rf"(?im)^#+\s*{re.escape(s)}\b"), F.lit(False)), F.lit(f"Missing section: {s}")) for s in sections]
    wrong.append(F.when(F.col("n") < least_children, F.lit(f"At least {least_children} children are required")))
    if child_status is not None:
        wrong.append(F.when(F.col("ready") < F.col("n"), F.lit(f"All children have to be {child_status}")))
    return rows.select("id", F.array_compact(F.array(*wrong)).alias("errors"))


def condition(column: Column, operator: str, value) -> Column:
    """A workflow condition as a predicate: equals, not_equals, contains, exists or in; nulls hold only for not_equals."""
    tests = {"equals": lambda: column == value, "not_equals": lambda: ~column.eqNullSafe(F.lit(value)), "contains": lambda: F.contains(F.lower(column), F.lit(str(value).lower())), "exists": lambda: column.isNotNull(), "in": lambda: column.isin(*value)}
    return F.coalesce(tests[operator](), F.lit(False))
