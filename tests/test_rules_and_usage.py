"""The rule index against meeting every rule, usage edges of both dialects, flows against plain Python."""

import random
import re

from pyspark.sql import functions as F

from quarry.operators import rules, usage


def _glob(pattern):
    out = re.escape(pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return re.compile(f"^{out}$")


def test_index_finds_what_meeting_every_rule_finds(spark):
    r = random.Random(5)
    paths = ["src/a.ts", "src/sub/b.test.ts", "lib/x.js", "README.md", None, "src/controllers/user.py", "x+y/(z).c"]
    names = ["WidgetStore", "wid.et", "cold start", None, "ab", "parseJson", "Über"]
    parts = [(k, r.choice(["class", "method", None]), r.choice(paths), r.choice(["ts", "py", None]), r.choice(names), r.choice([None, "return widget()", "x" * 50, "zażółć"]), r.choice([0, 3, None])) for k in range(120)]
    globs = ["src/**", "**/*.js", "*.md", "**", "lib/x.js", "s?c/*.ts", "x+y/*", "*/sub/*.test.ts", "**/user.*"]
    tests = ["wid.et", "^cold", "ab?", "pars+eJ", "a|b", "Store$", "[wW]id", "", "(ret)urn", "x*"]
    pick = lambda xs, n: r.choice([None, [], r.choices(xs, k=n)])
    made = [(f"r{k}", r.choice([3, 7]), pick(["class", "method", "class"], 2), pick(globs, 2), pick(["ts", "py"], 2), pick(tests, 2), None, pick(["user", "content"], 1), 2, None, True) for k in range(40)]
    c = spark.createDataFrame(parts, "id int, type string, path string, language string, name string, code string, edges int")
    rule = spark.createDataFrame(made, "id string, priority int, component_types array<string>, files array<string>, languages array<string>, patterns array<string>, layers array<string>, domains array<string>, least_complexity int, most_complexity int, wants_edges boolean")
    got = {(x.component_id, x.rule_id): set(x.triggers) - {"domain"} for x in rules.match_scores(c, rule).collect()}
    want = {}
    for i, type_, path, language, name, code, _ in parts:
        for rid, _, types, files, languages, patterns, *_ in made:
            hit = {"component_type": type_ is not None and type_ in (types or []), "language": language is not None and language in (languages or []), "file_pattern": path is not None and any(_glob(g).match(path) for g in files or []), "pattern": any(re.search(f"(?i){p}", t) for p in patterns or [] for t in (name, code) if t is not None)}
            if any(hit.values()):
                want[i, rid] = {k for k, v in hit.items() if v}
    assert {k: v for k, v in got.items() if v} == want
    plan = rules.match_scores(c, rule)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join (Inner|Cross)\s*$", plan, re.M) and "Cross" not in plan


PHP_LINES = ["<?php", "class A extends B {", "  public function run($x) {", "    $this->go($x);", "    helper(1); Foo::make();", "    $y = $this->size;", "  function go() {", "  echo $_GET; $x; run();", "class B {", "  helper();", "function run() {", "  go();", None]


def test_usage_edges_of_php(spark):
    lines = spark.createDataFrame([("f", k, t) for k, t in enumerate(PHP_LINES)] + [("other", 0, "  go();")], "file string, line int, text string")
    parts = spark.createDataFrame([("f", "m:run", "run", "method", 1), ("f", "m:run2", "run", "function", 2), ("f", "m:go", "go", "method", 1), ("f", "h", "helper", "function", 1), ("f", "v:x", "x", "variable", 1), ("other", "o:go", "go", "function", 1)], "file string, id string, name string, type string, place int")
    got = {(r.src, r.dst, r.type, r.usage, r.line, r["class"], r.method) for r in usage.usage_edges(lines, parts, usage.PHP, chunks=3).collect()}
    run, go = ("A", "run"), ("A", "go")
    assert got == {
        ("m:run", "m:go", "calls", "function_call", 3, *run), ("m:run", "UNRESOLVED:$this->go", "calls", "method_call", 3, *run), ("m:run", "UNRESOLVED:$this->g", "uses", "property_access", 3, *run), ("m:run", "v:x", "uses", "variable_reference", 3, *run),
        ("m:run", "h", "calls", "function_call", 4, *run), ("m:run", "UNRESOLVED:Foo::make", "calls", "static_method_call", 4, *run),
        ("m:run", "UNRESOLVED:$this->size", "uses", "property_access", 5, *run),
        ("m:go", "v:x", "uses", "variable_reference", 7, *go), ("m:go", "m:run", "calls", "function_call", 7, *go),
        ("m:run", "m:go", "calls", "function_call", 11, "B", "run"),
    }
    assert usage.usage_edges(lines.limit(0), parts, usage.PHP).count() == 0


def test_flows_against_plain_python(spark):
    r = random.Random(9)
    parents = {1: None, 2: 1, 3: 2, 4: 1, 5: 99, 6: 3}
    rows = [(k, r.choice([*parents, None]), r.choice(["a", "b", None]), r.choice(["read", "write", "write", None]), f"n{r.randrange(6)}") for k in range(300)]
    df = spark.createDataFrame(rows, "seq long, scope int, name string, kind string, node string")
    scopes = spark.createDataFrame([*parents.items(), (2, 1)], "scope int, parent int")
    want = {}
    for seq, scope, name, kind, node in rows:
        at = scope if kind == "read" and name is not None else None
        while at in parents:
            seen = [w for w in rows if w[3] == "write" and w[1] == at and w[2] == name and w[0] < seq]
            if seen:
                want.setdefault((seen[-1][4], node, name), seq)
                break
            at = parents[at]
    got = {(x.src, x.dst, x.name): x.seq for x in usage.variable_flows(df.repartition(4), scopes, chunks=5).where("name IS NOT NULL").collect()}
    assert got == want
    statements = spark.createDataFrame([(1, "s", "derives", "v", "w"), (2, "s", "derives", "v", "w"), (3, None, "read", "v", "w"), (4, None, "awaits", "v", "w"), (5, "s", "modify", None, "w"), (6, "s", "what", "v", "w"), (7, "s", "read", "v", "w")], "seq long, scope string, kind string, at string, other string")
    assert {tuple(x) for x in usage.flow_edges(statements).collect()} == {("w", "v", "derives_from", 1), ("v", "w", "awaits", 4), ("v", "w", "reads_from", 7)}
    assert usage.variable_flows(df.limit(0), scopes.limit(0)).count() == 0 and usage.scoped(spark.createDataFrame([("f", 1, None)], "file string, line int, text string"), usage.PHP).where(F.col("opens").isNull()).count() == 1
