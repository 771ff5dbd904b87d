"""Resolution of the raw ends of edges: classes of specifiers, standard libraries, paths and names.

Each step of a cascade is a left join; the first that hits decides. Names and paths are looked up
in tables with one row a key (the first component of each), so joins never multiply edges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import entities as en
from quarry.functions import ranking as rk
from quarry.sources.written import settled

# Symbols and prefixes of standard libraries.
NODE = ("assert buffer child_process cluster console constants crypto dgram dns domain events fs http http2 https inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder timers tls trace_events tty url util v8 vm worker_threads zlib").split()
PYTHON = ("sys os re json typing asyncio functools collections dataclasses enum abc logging pathlib itertools subprocess threading http urllib datetime inspect types math random").split()
PHP = ("\\JsonSerializable", "\\Throwable", "\\Exception", "\\RuntimeException")
SYMBOLS: Mapping[str, Sequence[str]] = {"typescript": NODE, "javascript": NODE, "python": PYTHON, "php": PHP}
PREFIXES = {"php": ("PhpParser\\",), "java": ("java.", "javax.", "jakarta."), "csharp": ("System.",), "c#": ("System.",), "cs": ("System.",)}
CONTAINMENT = {("class", "method"): "class-contains-method", ("class", "property"): "class-contains-property", ("class", "constructor"): "class-contains-constructor", ("interface", "method"): "interface-contains-method", ("interface", "property"): "interface-contains-property", ("namespace", "class"): "namespace-contains-class", ("namespace", "interface"): "namespace-contains-interface", ("namespace", "function"): "namespace-contains-function"}
# End of fixed values.


def is_stdlib(language: Column, specifier: Column) -> Column:
    """Whether a specifier is of a language's standard library: by symbol (node: apart) or by prefix."""
    lang, spec = F.lower(language), F.regexp_replace(specifier, "^node:", "")
    hit = F.lit(False)
    for name, symbols in SYMBOLS.items():
        hit |= (lang == name) & spec.isin(*symbols)
    for name, prefixes in PREFIXES.items():
        for p in prefixes:
            hit |= (lang == name) & specifier.startswith(p)
    return F.coalesce(hit, F.lit(False))


def sanitised(specifier: Column) -> Column:
    """A specifier without quotes, semicolons and white space around it."""
    return F.regexp_replace(F.trim(F.coalesce(specifier, F.lit(""))), r"""^["'`\s]+|["'`;\s]+$""", "")


def first_by(components: DataFrame, key: str, name: str, order: Sequence[str] = ("id",), where: Column | None = None) -> DataFrame:
    """(key, name): the id of the first component of each key."""
    rows = components if where is None else components.where(where)
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("id", F.struct(*order)).alias(name))


def resolved_path(folder_of: Column, specifier: Column) -> Column:
    return en.link_target(folder_of, specifier)["path"]


def resolve_targets(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges (id, src, dst, imported) with `status` and `resolved_dst`.

    The specifier is dst without RESOLVE:. junk is skipped. A bare name of a TypeScript or
    JavaScript source is an npm module, of its language's standard library a stdlib module, else
    external; a namespace is a composer module. A path is looked up relative to the source's
    folder, as it is, with the usual extensions, and as an index (a file before its components); then
    the imported name, or the last part of the target (a file after others); else unresolved.
    """
    source = components.select(F.col("id").alias("src"), F.col("path").alias("src_path"), F.lower("language").alias("lang"))
    rows = edges.join(source, "src", "left").withColumn("spec", sanitised(F.regexp_replace("dst", "^RESOLVE:", "")))
    rows = rows.withColumn("kind", rk.specifier_class(F.col("spec"))).withColumn("at", F.when(F.col("kind") == "path", resolved_path(F.col("src_path"), F.col("spec"))))
    paths = components.where("path IS NOT NULL").groupBy("path").agg(F.min_by("id", F.struct((F.col("type") != "file").cast("int").alias("n"), "id")).alias("by_path"))
    tried = rows.select("id", F.posexplode(F.array(F.col("at"), *[F.concat("at", F.lit(e)) for e in (".ts", ".tsx", ".js", ".py", ".php", "/index.ts", "/index.js")])).alias("n", "path")).where("path IS NOT NULL")
    found = tried.join(paths, "path").groupBy("id").agg(F.min_by("by_path", "n").alias("by_path"), F.min_by("path", "n").alias("found_path"))
    rows = rows.join(found, "id", "left")
    name = F.coalesce(F.col("imported"), F.element_at(F.split(F.col("spec"), "[.:/]"), -1))
    rows = rows.withColumn("wanted", F.when(F.col("kind") == "path", name))
    names = components.groupBy(F.col("name").alias("wanted")).agg(F.min_by("id", F.struct((F.col("type") == "file").cast("int").alias("n"), "id")).alias("by_name"))
    rows = rows.join(names, "wanted", "left")
    bare_ts = (F.col("kind") == "bare") & F.col("lang").isin("typescript", "javascript")
    std = is_stdlib(F.col("lang"), F.col("spec"))
    external = (
        F.when(bare_ts, F.concat(F.lit("external:npm:"), "spec"))
        .when((F.col("kind") == "bare") & std, F.concat(F.lit("external:stdlib:"), "lang", F.lit(":"), "spec"))
        .when(F.col("kind") == "namespace", F.concat(F.lit("external:composer:"), "spec"))
    )
    known = F.col("src_path").isNotNull() | F.col("lang").isNotNull()
    status = (
        F.when(~known, "unresolved")
        .when(F.col("kind") == "junk", "skippedJunk")
        .when(external.isNotNull(), "resolved")
        .when(F.col("kind") == "bare", "skippedExternal")
        .when(F.coalesce("by_path", "by_name").isNotNull(), "resolved")
        .otherwise("unresolved")
    )
    resolved = F.when(F.col("status") == "resolved", F.coalesce(external, F.col("by_path"), F.col("by_name")))
    return rows.withColumn("status", status).withColumn("resolved_dst", resolved).select(*edges.columns, "status", "resolved_dst")


def resolve_sources(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges (id, src, dst, is_external) with `status` and `resolved_src`.

    External edges stay so. RESOLVE: and a bare name is external, junk unresolved; a path is looked
    up from the target's folder, then its last part by name. EXTERNAL: takes the first component of
    the file's name, where there is one.
    """
    target = components.select(F.col("id").alias("dst"), F.col("path").alias("dst_path"))
    rows = edges.join(target, "dst", "left").withColumn("spec", sanitised(F.regexp_replace("src", "^(RESOLVE|EXTERNAL):", "")))
    kind = rk.specifier_class(F.col("spec"))
    asked, outside = F.col("src").startswith("RESOLVE:"), F.col("src").startswith("EXTERNAL:")
    rows = rows.withColumn("kind", kind).withColumn("at", F.when(asked & (kind == "path"), resolved_path(F.col("dst_path"), F.col("spec"))))
    last = F.element_at(F.split(F.col("spec"), r"[\\/]"), -1)
    rows = rows.withColumn("simple", F.when(outside, F.element_at(F.split(last, r"\."), 1)).otherwise(last))
    rows = rows.join(first_by(components, "path", "by_path").withColumnRenamed("path", "at"), "at", "left").join(first_by(components, "name", "by_name").withColumnRenamed("name", "simple"), "simple", "left")
    own = F.coalesce("by_path", "by_name")
    status = (
        F.when(F.coalesce(F.col("is_external"), F.lit(False)) | outside, "external")
        .when(asked & (F.col("kind") == "bare"), "external")
        .when(asked & (F.col("kind") != "junk") & own.isNotNull(), "resolved")
        .otherwise("unresolved")
    )
    resolved = F.when(F.col("status") == "resolved", own).when(outside & ~F.coalesce(F.col("is_external"), F.lit(False)), F.col("by_name"))
    return rows.withColumn("status", status).withColumn("resolved_src", resolved).select(*edges.columns, "status", "resolved_src")


def status_summary(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("status").agg(F.count("*").alias("n"))


def import_targets(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges (id, src_path, language, specifier) with `class`, `is_stdlib`, `target`: a file's path (dist read as src), module:name, or the specifier."""
    spec = sanitised(F.col("specifier"))
    rows = edges.withColumn("spec", spec).withColumn("class", rk.specifier_class(spec)).withColumn("is_stdlib", is_stdlib(F.col("language"), spec))
    rows = rows.withColumn("at", F.when(F.col("class") == "path", resolved_path(F.col("src_path"), F.col("spec"))))
    probes = F.array(F.col("at"), *[F.concat("at", F.lit(e)) for e in (".ts", ".js", "/index.ts", "/index.js")], F.regexp_replace("at", "(^|/)dist/", "$1src/"), F.regexp_replace(F.regexp_replace("at", "(^|/)dist/", "$1src/"), r"\.js$", ".ts"))
    tried = rows.select("id", F.posexplode(probes).alias("n", "path")).where("path IS NOT NULL")
    found = tried.join(files.select("path").distinct(), "path").groupBy("id").agg(F.min_by("path", "n").alias("file"))
    out = rows.join(found, "id", "left")
    target = F.coalesce(F.col("file"), F.when(F.col("class").isin("bare", "namespace"), F.concat(F.when(F.col("is_stdlib"), "stdlib:").otherwise("module:"), "spec")), F.col("spec"))
    return out.withColumn("target", target).select(*edges.columns, "class", "is_stdlib", "target")


def _typed(names: Column, field: str, kind: str) -> Column:
    """Names (without a leading backslash) as structs with a type."""
    return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.struct(F.regexp_replace(n, r"^\\", "").alias(field), F.lit(kind).alias("type")))


def call_edges(components: DataFrame) -> DataFrame:
    """(src, dst, type, confidence): a component calls each other one of its file whose name (2 or more letters) stands before a parenthesis in its code.

    Codes are cut to their call words and joined on the name, instead of one pattern for each pair. The pairs may be far more than
    the components, so they leave the join as they are: a pair comes twice only where an id has several names or files, and
    those alone are told apart behind it. The join is kept from broadcasting, which would leave all pairs to the few tasks that read a small file.
    """
    words = components.select(F.col("id").alias("src"), "path", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"\b([A-Za-z_]\w+)\s*\("), F.lit(1)))).alias("name")).distinct()
    named = components.where(F.length("name") >= 2).select(F.col("id").alias("dst"), "path", "name").distinct()
    named = named.withColumn("n", F.count("*").over(Window.partitionBy("dst")))
    pairs = lambda to: words.join(to.hint("merge"), ["path", "name"]).where("src <> dst").select("src", "dst")
    found = pairs(named.where("n = 1")).unionByName(pairs(named.where("n > 1")).distinct())
    return found.select("src", "dst", F.lit("calls").alias("type"), F.lit(0.5).alias("confidence"))


def inheritance_edges(components: DataFrame) -> DataFrame:
    """(src, dst, type) of components (id, name, extends, implements arrays): to the first component of the name, else RESOLVE:name."""
    asked = components.select(F.col("id").alias("src"), F.explode(F.concat(*[_typed(F.col(c), "name", c) for c in ("extends", "implements")])).alias("x"))
    known = first_by(components, "name", "dst")
    return asked.select("src", "x.name", "x.type").join(known, "name", "left").select("src", F.coalesce("dst", F.concat(F.lit("RESOLVE:"), "name")).alias("dst"), "type")


def class_bases(components: DataFrame, skip: Sequence[str] = ("object",)) -> DataFrame:
    """(src, dst) of classes (id, name, module, bases): by full name, then within the module, then by a short name that is unique, else RESOLVE:."""
    asked = components.select(F.col("id").alias("src"), F.col("module").alias("own"), F.explode("bases").alias("base")).where(~F.col("base").isin(*skip))
    full = components.groupBy(F.concat_ws(".", "module", "name").alias("full")).agg(F.min("id").alias("hit"))
    short = components.groupBy("name").agg(F.min("id").alias("by_short"), F.count("*").alias("n")).where("n = 1").select("name", "by_short")
    rows = asked.join(full.select(F.col("full").alias("base"), F.col("hit").alias("by_full")), "base", "left")
    rows = rows.withColumn("qualified", F.concat_ws(".", "own", "base")).join(full.select(F.col("full").alias("qualified"), F.col("hit").alias("by_module")), "qualified", "left")
    rows = rows.withColumn("name", F.element_at(F.split("base", r"\."), -1)).join(short, "name", "left")
    return rows.select("src", F.coalesce("by_full", "by_module", "by_short", F.concat(F.lit("RESOLVE:"), "base")).alias("dst"))


def qualified_edges(components: DataFrame, uses: Mapping[str, str]) -> DataFrame:
    """(src, dst, type) of components (id, fqn, and arrays of names): each array's names to the component of that full name, else UNRESOLVED:."""
    arrays = [_typed(F.col(column), "fqn", kind) for column, kind in uses.items()]
    asked = components.select(F.col("id").alias("src"), F.explode(F.concat(*arrays)).alias("x")).select("src", "x.*")
    known = components.groupBy(F.regexp_replace("fqn", r"^\\", "").alias("fqn")).agg(F.min("id").alias("dst"))
    return asked.join(known, "fqn", "left").select("src", F.coalesce("dst", F.concat(F.lit("UNRESOLVED:"), "fqn")).alias("dst"), "type")


def python_imports(imports: DataFrame, files: DataFrame, roots: Sequence[str] = ("",)) -> DataFrame:
    """(id, kind, target) of imports (id, path, module, level): stdlib, a local .py or package, else UNRESOLVED:.

    A relative import goes up level - 1 folders from its file; others are tried in the file's folder
    and the roots; a module before its package's __init__.py.
    """
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    up = F.array_join(F.slice(F.split(folder, "/"), 1, F.greatest(F.size(F.split(folder, "/")) - (F.col("level") - 1), F.lit(0))), "/")
    inner = F.replace("module", F.lit("."), F.lit("/"))
    bases = F.when(F.col("level") > 0, F.array(up)).otherwise(F.concat(F.array(folder), F.array(*[F.lit(r) for r in roots])))
    files_of = F.flatten(F.transform(bases, lambda b: F.transform(F.array(F.lit(".py"), F.lit("/__init__.py")), lambda e: F.concat(F.regexp_replace(F.concat_ws("/", F.nullif(b, F.lit("")), F.nullif(inner, F.lit(""))), "^/", ""), e))))
    tried = imports.select("id", F.posexplode(files_of).alias("n", "path"))
    found = tried.join(files.select("path").distinct(), "path").groupBy("id").agg(F.min_by("path", "n").alias("file"))
    std = (F.col("level") == 0) & is_stdlib(F.lit("python"), F.element_at(F.split("module", r"\."), 1))
    rows = imports.join(found, "id", "left")
    return rows.select("id", F.when(std, "stdlib").when(F.col("file").isNotNull(), "local").otherwise("unresolved").alias("kind"), F.when(std, F.col("module")).otherwise(F.coalesce("file", F.concat(F.lit("UNRESOLVED:"), "module"))).alias("target"))


def file_contains(components: DataFrame, contained: DataFrame) -> DataFrame:
    """(src, dst, type): a file contains each of its components that has no parent and that nothing contains yet."""
    files = first_by(components, "path", "src", where=F.col("type") == "file")
    free = components.where("type <> 'file' AND parent_id IS NULL").join(contained.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    return free.join(files, "path").select("src", F.col("id").alias("dst"), F.lit("contains").alias("type"))


def containment_type(parent: Column, child: Column) -> Column:
    out = F.lit("contains")
    for (a, b), kind in CONTAINMENT.items():
        out = F.when((parent == a) & (child == b), kind).otherwise(out)
    return out


def containment(components: DataFrame, width: int = 64) -> DataFrame:
    """(src, dst, type): each component to the container of its file with the fewest lines that encloses it.

    Containers are dealt to the bins of `width` lines that they cover and a member looks only into
    the bin of its first line, so the join is on file and bin. Containers of the same lines meet as one, with their two
    least ids, and so do members; a number holds the lines and the start of a container, so that the least of them is kept
    while the join runs and nothing it makes is sorted. An id of several rows is met by itself, as no container holds its own id.
    """
    boxes = components.where("type IN ('class', 'interface', 'namespace', 'module')")
    kinds = boxes.groupBy("path", F.col("start_line").alias("a"), F.col("end_line").alias("b"), F.col("id").alias("src")).agg(F.min("type").alias("outer"))
    ranked = kinds.withColumn("n", F.row_number().over(Window.partitionBy("path", "a", "b").orderBy("src"))).where("n <= 2")
    spans = ranked.groupBy("path", "a", "b").agg(F.array_sort(F.collect_list(F.struct("src", "outer"))).alias("ids"))
    spans = settled(spans, "spans")
    dealt = spans.select("path", "a", "b", F.col("ids")[0]["src"].alias("least"), (F.size("ids") > 1).alias("more"), F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width))).alias("bin"))
    several = components.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("dst"), F.col("id").alias("own"))
    rows = components.where("parent_id IS NULL AND type <> 'file'").select(F.col("id").alias("dst"), "path", F.col("type").alias("inner"), "start_line", "end_line").join(several, "dst", "left")
    at = ["path", "start_line", "end_line"]
    asked = rows.select(*at, "own").distinct().withColumn("bin", F.floor(F.col("start_line") / width))
    met = asked.join(dealt.hint("merge"), ["path", "bin"]).where("start_line >= a AND end_line <= b AND NOT (start_line = a AND end_line = b) AND (own IS NULL OR more OR own <> least)")
    order = (F.col("b").cast("long") - F.col("a")) * F.lit(1 << 32) + F.col("a") + F.lit(1 << 31)
    best = met.groupBy(*at, "own").agg(F.min(order).alias("order"))
    start = F.pmod("order", F.lit(1 << 32)) - F.lit(1 << 31)
    best = best.select(*at, "own", start.alias("a"), (start + F.shiftright("order", 32)).alias("b")).join(spans, ["path", "a", "b"])
    same = [rows[c] == best[c] for c in at] + [rows["own"].eqNullSafe(best["own"])]
    found = rows.join(best, same).select("dst", "inner", "a", "b", F.get(F.filter("ids", lambda x: x["src"] != F.col("dst")), F.lit(0)).alias("x")).where("x IS NOT NULL")
    best = found.groupBy("dst").agg(F.min_by(F.struct("x.src", "x.outer", "inner"), F.struct((F.col("b") - F.col("a")).alias("span"), "a", "x.src")).alias("x"))
    return best.select("x.src", "dst", containment_type(F.col("x.outer"), F.col("x.inner")).alias("type"))


def longest_prefix(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(name, prefix, target): the longest prefix (prefix, target) of each name, by equality on the prefix of each length there is."""
    lengths = [r["n"] for r in prefixes.select(F.length("prefix").alias("n")).distinct().orderBy("n").collect()]  # as many as there are lengths
    cuts = names.select("name", F.explode(F.array(*[F.when(F.length("name") >= n, F.substring("name", 1, n)) for n in lengths])).alias("prefix")).where("prefix IS NOT NULL")
    return cuts.join(prefixes, "prefix").groupBy("name").agg(F.max_by(F.struct("prefix", "target"), F.length("prefix")).alias("x")).select("name", "x.*")


def doc_links(links: DataFrame, components: DataFrame) -> DataFrame:
    """(src, dst, type, confidence) of links of documents (src, path, url, target_id, kind): the best of five ways to a component.

    An explicit id (.95), then by index entry and index list (the name in url, .8), anchor (name in the
    file, .8) and path (the file, .8). One edge for each link and component.
    """
    rows = links.withColumn("t", en.link_target(F.col("path"), F.col("url"))).withColumn("file", F.col("t.path")).withColumn("anchor", F.col("t.anchor"))
    ids = components.select(F.col("id").alias("dst"), F.col("id").alias("target_id"))
    names = first_by(components, "name", "dst").withColumnRenamed("name", "url")
    anchors = components.groupBy(F.col("path").alias("file"), F.lower("name").alias("anchor")).agg(F.min("id").alias("dst"))
    files = components.groupBy(F.col("path").alias("file")).agg(F.min_by("id", F.struct((F.col("type") != "file").cast("int").alias("n"), "id")).alias("dst"))
    ways = [
        rows.where("target_id IS NOT NULL").join(ids, "target_id").select("src", "dst", F.lit(1).alias("way"), F.lit(0.95).alias("confidence")),
        rows.where("kind = 'index_entry'").join(names, "url").select("src", "dst", F.lit(2).alias("way"), F.lit(0.8).alias("confidence")),
        rows.where("kind = 'index_list'").join(names, "url").select("src", "dst", F.lit(3).alias("way"), F.lit(0.8).alias("confidence")),
        rows.where("anchor IS NOT NULL").withColumn("anchor", F.lower("anchor")).join(anchors, ["file", "anchor"]).select("src", "dst", F.lit(4).alias("way"), F.lit(0.8).alias("confidence")),
        rows.where("kind = 'link' AND anchor IS NULL").join(files, "file").select("src", "dst", F.lit(5).alias("way"), F.lit(0.8).alias("confidence")),
    ]
    every = ways[0]
    for w in ways[1:]:
        every = every.unionByName(w)
    best = every.groupBy("src", "dst").agg(F.min_by("confidence", "way").alias("confidence"), F.min("way").alias("way"))
    return best.select("src", "dst", F.lit("documents").alias("type"), "confidence", "way")


def mentions(texts: DataFrame, pattern: str, definitions: DataFrame, type_: str) -> DataFrame:
    """(src, dst, type): texts (id, text) to the first definition (id, name) of each name that a pattern's group finds in them.

    With patterns of template variables, endpoints, style classes and tables these are the joins across languages.
    """
    found = texts.select(F.col("id").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("name"))
    return found.join(first_by(definitions, "name", "dst"), "name").where("src <> dst").select("src", "dst", F.lit(type_).alias("type"))
