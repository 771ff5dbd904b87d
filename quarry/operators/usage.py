"""Usage and data-flow edges from tables of lines and of statements: scopes carried forward, reads joined to the last write."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import ordered
from quarry.sources.written import settled

# What opens a class or a method, what a line calls and reads, and names that aren't variables.
PYTHON_WORDS = "False None True and as assert break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
SUPERGLOBALS = "GLOBALS _SERVER _GET _POST _FILES _COOKIE _SESSION _REQUEST _ENV argc argv php_errormsg http_response_header".split()


@dataclass(frozen=True)
class Dialect:
    """Patterns of a language; `member` and `static` have the owner and the name as their groups, `joint` is written between them."""

    opens_class: str
    opens_method: str
    call: str
    member: str
    member_call: str
    static_call: str | None
    owner: str
    joint: str
    variable: str
    not_variables: Sequence[str]
    trimmed: bool


PYTHON = Dialect(r"^class\s+(\w+)", r"^\s*def\s+(\w+)\s*\(", r"(\w+)\s*\(", r"(\w+)\.(\w+)(?!\s*\()", r"(\w+)\.(\w+)\s*\(", None, "", ".", r"\b(\w+)\b", PYTHON_WORDS, False)
PHP = Dialect(r"^class\s+(\w+)", r"function\s+(\w+)\s*\(", r"(\w+)\s*\(", r"\$(\w+)->(\w+)(?!\s*\()", r"\$(\w+)->(\w+)\s*\(", r"(\w+)::(\w+)\s*\(", "$", "->", r"\$(\w+)", SUPERGLOBALS, True)
# End of fixed values.


def scoped(lines: DataFrame, dialect: Dialect, chunks: int | None = None) -> DataFrame:
    """Lines (file, line, text) with `opens` (class, method or null) and the class and method they stand in.

    The last class line before a line, and the last method line since then, whatever the size of a file; a class
    line ends the method. Null texts open nothing.
    """
    text = F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")) if dialect.trimmed else F.col("text")
    named = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    rows = lines.select("file", "line", text.alias("text"), named(dialect.opens_class).alias("class"), named(dialect.opens_method).alias("own"))
    opens = F.when(F.col("class").isNotNull(), "class").when(F.col("own").isNotNull(), "method")
    rows = rows.select("file", "line", "text", opens.alias("opens"), "class", F.when(F.col("class").isNotNull(), "").otherwise(F.col("own")).alias("method"))
    placed = ordered.placed(rows, [F.struct("file"), "line"], "lines", chunks)
    found = ordered.carried(placed, ["file"], ["class", "method"])
    return found.select("file", "line", "text", "opens", "class", F.nullif("method", F.lit("")).alias("method"))


def usage_edges(lines: DataFrame, components: DataFrame, dialect: Dialect, chunks: int | None = None) -> DataFrame:
    """(src, dst, type, usage, line, class, method): what the lines of each method call, read and use.

    components: file, id, name, type, place; of a file's components of one name the first by place counts. Lines outside of a known
    method give nothing, nor do the lines that open one. Calls and variables end at components of the
    file; members and statics at `UNRESOLVED:` and their text. A member that is called is a read as well,
    of all but its last letter: the pattern gives way until no bracket follows.
    """
    known = components.groupBy("file", "name", F.when(F.col("type") == "variable", "variable").when(F.col("type").isin("method", "function"), "callable").alias("kind")).agg(F.min_by("id", F.struct("place", "id")).alias("id")).where("kind IS NOT NULL")
    known = settled(known, "known")  # as a table, its size is known: lines stay where they are while it is small
    callables, variables = known.where("kind = 'callable'").drop("kind"), known.where("kind = 'variable'").drop("kind")
    inside = scoped(lines, dialect, chunks).where("opens IS NULL AND method IS NOT NULL")
    inside = inside.join(callables.select("file", F.col("name").alias("method"), F.col("id").alias("src")), ["file", "method"])
    all_ = lambda pattern, k: F.regexp_extract_all("text", F.lit(pattern), F.lit(k))

    def named(kind: str, pattern: str) -> Column:
        return F.transform(all_(pattern, 1), lambda x: F.struct(F.lit(kind).alias("usage"), x.alias("name"), F.lit(None).cast("string").alias("dst")))

    def members(kind: str, pattern: str, owner: str, joint: str) -> Column:
        dst = lambda o, m: F.concat(F.lit(f"UNRESOLVED:{owner}"), o, F.lit(joint), m)
        return F.zip_with(all_(pattern, 1), all_(pattern, 2), lambda o, m: F.struct(F.lit(kind).alias("usage"), F.lit(None).cast("string").alias("name"), dst(o, m).alias("dst")))

    parts = [named("function_call", dialect.call), members("method_call", dialect.member_call, dialect.owner, dialect.joint), members("property_access", dialect.member, dialect.owner, dialect.joint), named("variable_reference", dialect.variable)]
    if dialect.static_call:
        parts.append(members("static_method_call", dialect.static_call, "", "::"))
    found = inside.select("file", "line", "class", "method", "src", F.explode(F.array_distinct(F.concat(*parts))).alias("x")).select("file", "line", "class", "method", "src", "x.*")
    to = lambda rows: rows.select("file", "name", F.col("id").alias("to"))
    calls = found.where("usage = 'function_call'").join(to(callables), ["file", "name"]).where("to <> src")
    uses = found.where((F.col("usage") == "variable_reference") & ~F.col("name").isin(*dialect.not_variables) & (F.col("name") != F.col("method"))).join(to(variables), ["file", "name"])
    ends = calls.unionByName(uses).withColumn("dst", F.col("to")).drop("to").unionByName(found.where("dst IS NOT NULL"))
    type_ = F.when(F.col("usage").isin("property_access", "variable_reference"), "uses").otherwise("calls")
    return ends.select("src", "dst", type_.alias("type"), "usage", "line", "class", "method").distinct()


# The edge that a statement of each kind gives, and whether it goes from `other` to `at` (or back).
FLOWS = {"derives": ("derives_from", True), "returns": ("returns_from", False), "passes": ("passes_to", True), "read": ("reads_from", False), "write": ("writes_to", False), "modify": ("modifies", False), "transforms": ("transforms_data", True), "awaits": ("awaits", False), "observes": ("observes", False)}
# Kinds that count outside of a scope as well.
FREE = ("transforms", "awaits", "observes")
# End of fixed values.


def flow_edges(statements: DataFrame) -> DataFrame:
    """(src, dst, type, seq) of statements (seq, scope, kind, at, other): one edge for each source, target and type, the first by seq.

    derives, passes and transforms lead from `other` to `at`; returns, reads, writes, modifications, awaits and
    observations from `at` to `other`. Without a scope, only transforms, awaits and observes count; without
    one of its ends a statement gives nothing.
    """
    kind = F.col("kind")
    type_, into = F.lit(None).cast("string"), F.lit(False)
    for name, (edge, flag) in FLOWS.items():
        type_, into = F.when(kind == name, edge).otherwise(type_), F.when(kind == name, F.lit(flag)).otherwise(into)
    rows = statements.where(F.col("scope").isNotNull() | kind.isin(*FREE)).where("at IS NOT NULL AND other IS NOT NULL")
    edges = rows.select(F.when(into, F.col("other")).otherwise(F.col("at")).alias("src"), F.when(into, F.col("at")).otherwise(F.col("other")).alias("dst"), type_.alias("type"), "seq")
    return edges.where("type IS NOT NULL").groupBy("src", "dst", "type").agg(F.min("seq").alias("seq"))


def enclosing_scopes(scopes: DataFrame, deepest: int = 256) -> DataFrame:
    """(scope, around, level): each scope (scope, parent) with itself at 0 and all around it; parents that aren't scopes end the way."""
    step = settled(scopes.select("scope", "parent").dropDuplicates(["scope"]).select("scope", F.col("scope").alias("around"), "parent", F.lit(0).alias("level")), "scopes")
    out, up = step, scopes.dropDuplicates(["scope"]).select(F.col("scope").alias("parent"), F.col("parent").alias("next"))
    for level in range(1, deepest + 1):
        step = settled(step.join(up, "parent").select("scope", F.col("parent").alias("around"), F.col("next").alias("parent"), F.lit(level).alias("level")), "scopes")
        if step.isEmpty():
            return out.select("scope", "around", "level")
        out = out.unionByName(step)
    raise ValueError(f"scopes lie deeper than {deepest}: do they go round?")


def variable_flows(accesses: DataFrame, scopes: DataFrame, chunks: int | None = None) -> DataFrame:
    """(src, dst, type, name, seq): an edge from the last write that each read sees to the reader, one for each source, target and name.

    accesses: seq (unique), scope, name, kind (read or write), node. A read sees the last write of its name before it in the innermost scope around it
    that has one; reads that see none give nothing. seq of an edge is its first read. Accesses of one name in one scope may be any share of the rows.
    """
    writes = accesses.where("kind = 'write'").select("seq", F.col("scope").alias("around"), "name", F.col("node").alias("writer"), F.lit(None).cast("long").alias("read"), F.lit(None).cast("int").alias("level"))
    reads = accesses.where("kind = 'read'").join(enclosing_scopes(scopes), "scope").select("seq", "around", "name", F.lit(None).cast("string").alias("writer"), F.col("seq").alias("read"), "level")
    rows = ordered.placed(writes.unionByName(reads), [F.struct("around", "name"), "seq", F.col("read").asc_nulls_first()], "accesses", chunks)
    seen = ordered.carried(rows, ["around", "name"], ["writer"]).where("read IS NOT NULL AND writer IS NOT NULL")
    nearest = seen.groupBy("read").agg(F.min_by("writer", "level").alias("src"))
    ends = accesses.where("kind = 'read'").select(F.col("seq").alias("read"), F.col("node").alias("dst"), "name")
    found = nearest.join(ends, "read").groupBy("src", "dst", "name").agg(F.min("read").alias("seq"))
    return found.select("src", "dst", F.lit("uses_field").alias("type"), "name", "seq")
