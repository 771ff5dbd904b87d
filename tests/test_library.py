"""Operators over literal frames: expected values are worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import chunking as ch
from quarry.functions import entities as en
from quarry.functions import terms
from quarry.functions import vector as vec
from quarry.operators import boolean_search, context, discovery, edges, graph, references, rerank, rules
from quarry.operators import entities as ops
from quarry.sources import exports, files, walk
from quarry.streaming import rules as streaming_rules
from quarry.streaming import upkeep


def _one(spark, value):
    return spark.range(1).select(value.alias("x")).first().x


def test_large_segments_stop_at_the_end(spark):
    text = F.lit("x" * 1000)
    assert [len(x) for x in _one(spark, ch.large_segment(text, 300))] == [300, 300, 300, 250]
    assert len(_one(spark, ch.large_segment(text, 300, compat=True))) == 54
    words = " ".join(["word"] * 40)
    got = _one(spark, ch.large_segment(F.lit(words), 50, 10))
    assert all(len(x) <= 50 for x in got) and got[0] == words[:49]


def _sentences(text, most, overlap=50):
    import re

    def large(segment):
        out, start = [], 0
        while start < len(segment):
            end = min(start + most, len(segment))
            if end < len(segment):
                space = segment.rfind(" ", 0, end + 1)
                if space > start + most * 0.5:
                    end = space
            out.append(segment[start:end])
            if end >= len(segment):
                break
            start = max(start + 1, end - overlap)
        return out

    if not text or len(text) <= most:
        return [text] if text else []
    least, out, now = most // 4, [], ""
    for s in [x for x in re.split(r"[.!?]+\s+", text) if x]:
        if len(now) + len(s) <= most:
            now += (" " if now else "") + s
            continue
        if len(now) >= least:
            out.append(now.strip())
            now = now[-overlap:] + " " if len(now) > overlap else ""
        if len(s) > most:
            pieces = large(s)
            out += pieces[:-1]
            now = pieces[-1]
        else:
            now += s
    if len(now) >= least:
        out.append(now.strip())
    elif out and now.strip():
        out[-1] += " " + now.strip()
    return out


def test_sentence_and_paragraph_chunks(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("text", ch.sentence_chunks(F.col("text"), 120, 30).alias("c")).collect()
    texts = [r.text for r in rows if r.text]
    assert any(len(t) > 120 for t in texts)
    for r in rows:
        assert r.c == _sentences(r.text, 120, 30)
    text = "First one. Second one! Third? Fourth."
    assert _one(spark, ch.sentence_chunks(F.lit(text), 20, 5)) == _sentences(text, 20, 5)
    assert _one(spark, ch.sentence_chunks(F.lit(""), 20)) == [] and _one(spark, ch.sentence_chunks(F.lit(None).cast("string"), 20)) == []
    paragraphs = "\n\n".join(["a" * 60, "b" * 60, "short", "c" * 130])
    assert _one(spark, ch.paragraph_chunks(F.lit(paragraphs), 130)) == ["a" * 60 + "\n\n" + "b" * 60, "c" * 130]
    assert _one(spark, ch.sliding_chunks(F.lit("abcdefghij"), 4, 3)) == ["abcd", "defg", "ghij"]


def test_semantic_chunks_and_subwords(spark):
    s = F.array(*[F.lit(x) for x in ("a", "b", "c")])
    v = F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.9), F.lit(0.1)), F.array(F.lit(0.0), F.lit(1.0)))
    assert _one(spark, ch.semantic_chunks(s, v, 100, 0.8)) == ["a. b.", "c."]
    assert _one(spark, ch.semantic_chunks(s, v, 100, 0.8, similarity=lambda a, b: F.lit(1.0))) == ["a. b. c."]
    assert _one(spark, ch.subwords(F.lit("unhappy happy zzun"), ["un", "happy", "hap"])) == ["un", "happy", "happy", "z", "z", "un"]


def test_boolean_not_takes_a_primary(spark):
    for bad in ("NOT NOT x", "NOT", "a NOT AND b"):
        with pytest.raises(boolean_search.QueryError):
            boolean_search.compile_query(bad, ["name"])


def test_vector_length_rules(spark):
    a, b = F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))
    assert _one(spark, vec.euclidean(a, b)) == math.inf and _one(spark, vec.manhattan(b, F.array(F.lit(3.0), F.lit(0.0)))) == 4
    with pytest.raises(Exception, match="different lengths"):
        _one(spark, vec.manhattan(a, b, strict=True))
    with pytest.raises(Exception, match="one length"):
        _one(spark, vec.cosine_strict(a, b))
    assert _one(spark, vec.cosine_strict(F.array(F.lit(0.0)), F.array(F.lit(2.0)))) == 0


EDGES = [("a", "b", "imports"), ("b", "c", "imports"), ("c", "a", "imports"), ("c", "d", "calls"), ("x", "y", "uses")]


def test_graph_walks(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string, type string")
    path = graph.shortest_path(e, "a", "d").first()
    assert (path.path, path.types, path.hops) == (["a", "b", "c", "d"], ["imports", "imports", "calls"], 3)
    assert graph.shortest_path(e, "a", "y").count() == 0 and graph.shortest_path(e, "a", "d", 2).count() == 0
    assert graph.shortest_path(e, "a", "a").first().hops == 0
    seed = spark.createDataFrame([("a",)], "node string")
    nodes, kept, cycles = graph.walk(seed, e, 3, "out")
    assert {r.node: r.depth for r in nodes.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {tuple(r.cycle) for r in cycles.collect()} == {("a", "b", "c", "a")} and kept.count() == 3
    assert {tuple(r.cycle) for r in graph.cycles(e, 4, graph.DEPENDENCIES).collect()} == {("a", "b", "c", "a")}
    assert {r.node: r.others for r in graph.adjacency(e).collect()} == {"a": ["b"], "b": ["c"], "c": ["a"], "x": ["y"]}
    assert {r.node: r.depth for r in graph.closure(e, seed).collect()} == {"b": 1, "c": 2, "a": 3, "d": 3}
    asked = spark.createDataFrame([("d", "a"), ("a", "d"), ("x", "x")], "src string, dst string")
    assert {(r.src, r.dst): r.closes for r in graph.would_cycle(e, asked).collect()} == {("d", "a"): True, ("a", "d"): False, ("x", "x"): True}
    with pytest.raises(ValueError, match="cycle"):
        graph.longest_depths(spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a")], "src string, dst string"))
    assert [r.hops for r in graph.paths_between(e, "a", "d").collect()] == [3]


def test_components_of_long_chains(spark):
    chain = [(f"n{k:03}", f"n{k + 1:03}") for k in range(60)] + [("z1", "z2")]
    e = spark.createDataFrame(chain, "src string, dst string")
    assert {r.component for r in graph.label_components(e).collect()} == {"n000", "z1"}
    row = graph.component_count(spark.createDataFrame([("n000",), ("z1",), ("alone",)], "node string"), e).first()
    assert (row.components, row.isolated) == (3, 1)


def test_cohesion_by_hand(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "d")], "src string, dst string")
    m = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c"), ("h", "d")], "group string, node string")
    got = {r.group: (r.cohesion, r.coupling) for r in graph.cohesion(m, e).collect()}
    assert got == {"g": (1.0, 0.25), "h": (0.5, 0.25)}


def test_edge_names_and_richest(spark):
    rows = spark.createDataFrame([("A", "b", "Inherits_From"), ("a", "B", "extends"), ("a", "c", None), ("a", "d", "file-contains-component")], "src string, dst string, type string")
    got = {(r.src.lower(), r.type, r.dst.lower()) for r in edges.normalised(rows).collect()}
    assert got == {("a", "extends", "b"), ("b", "extended_by", "a"), ("a", "references", "c"), ("c", "referenced_by", "a"), ("a", "contains", "d")}
    assert len(edges.INVERSES) == 22 and len(edges.NO_INVERSE) == 18
    items = spark.createDataFrame([(1, "k", "long text", {"a": "1", "b": "1"}), (2, "k", "short", {"b": "2", "c": "2"})], "id int, key string, text string, meta map<string,string>")
    kept = edges.richest(items, ["key"], ["text"], ["id"], "meta").first()
    assert kept.id == 1 and kept.meta == {"a": "1", "b": "1", "c": "2"}


def test_rerank_by_hand(spark):
    schema = "id int, name string, type string, entity_type string, similarity double, content string, path string, days double, edges int, acceptance double, effectiveness double, uses int, days_unused double"
    rows = [(1, "getUserById", "function", "component", 0.5, None, None, None, None, None, None, None, None), (2, "getUser", "class", "component", 0.6, None, "x/coverage/y", 3.0, 9, None, None, None, None), (3, "user", "note", "rule", 0.7, None, None, 40.0, None, 0.8, 0.6, 100, 5.0)]
    got = {r.id: r for r in rerank.reranked(spark.createDataFrame(rows, schema), "getUserById", rerank.with_boosts(rerank.DEFAULT, noisy_paths=("coverage/",), analytics=0.5)).collect()}
    assert got[1].final_score == pytest.approx(0.6 * 0.5 + 0.2 * 1.1 + 0.1 * 0.15) and max(got.values(), key=lambda r: r.final_score).id == 3
    assert got[2].final_score == pytest.approx(0.6 * 0.6 + 0.2 * 0.3 + 0.1 * 0.15 + 0.05 * 0.1 + 0.05 * 0.1 - 0.2)
    assert got[3].final_score == pytest.approx(0.6 * 0.7 + 0.2 * 0.3 + 0.05 * 0.02 + 0.5 * (0.8 + 0.6 + 1 + 1) / 4)
    with pytest.raises(ValueError, match="multiplicative"):
        rerank.rerank_by_factors(spark.range(1), "q", rerank.Factors(), mode="multiplicative")


def test_factor_reranker_by_hand(spark):
    rows = spark.createDataFrame([(1, 0.5, "Alpha", "class", "alpha beta", None, None, ["Alpha-x"], [("calls", 2.0), ("uses", None)], 10.0, 3, 1.0)], "id int, similarity double, name string, type string, content string, description string, documentation string, tags array<string>, edges array<struct<type:string,weight:double>>, days double, uses int, popularity double")
    f = rerank.Factors(name=(1.0, 0.5, 0.2), content=0.4, tags=0.3, edges=(0.1, 0.25), edge_weights={"calls": 1.5}, temporal=(1.0, 20.0, "linear"), popularity=(1.0, 1.0, "sqrt"), custom={"two": (F.lit(2.0), 0.5)})
    b = rerank.rerank_by_factors(rows, "alpha gamma", f).first()
    assert b.breakdown.asDict() == pytest.approx({"base": 0.5, "name": 0.5 * 0.8, "content": 0.2, "tags": 0.3, "edges": 0.25, "temporal": 0.5, "popularity": 2.0, "custom_two": 1.0})
    assert b.final_score == pytest.approx(sum(b.breakdown.asDict().values()))


def test_discovery_parts(spark):
    items = spark.createDataFrame([(1, "1", "UserStore", "class", "stores users", ["db"], "src/user/Store.ts", True, 2, 0.9), (2, "2", "userstore", "function", None, None, None, False, 0, 0.5), (3, "3", "other", None, None, None, None, False, 0, 0.1)], "place int, id string, name string, type string, content string, tags array<string>, path string, documented boolean, edges int, similarity double")
    e = spark.createDataFrame([("1", "2", "calls"), ("1", "2", "calls"), ("2", "9", "uses")], "src string, dst string, type string")
    got = discovery.discovered(items, e, "user")
    first = got["terms"].first()
    assert (first.term, first.types, first.n, first.score) == ("userstore", "class, function", 2, pytest.approx(0.7)) and "Has documentation, Class definition, Name contains query, Has 2 relationships" in first.relevance
    weights = {r.concept: r.weight for r in got["concepts"].collect()}
    assert weights["store"] == 1.5 and weights["db"] == 2 and "user" not in weights
    assert [(r.source, r.target, r.type) for r in got["references"].collect()] == [("UserStore", "2", "calls"), ("userstore", "9", "uses")]


def test_references_cascade(spark):
    components = spark.createDataFrame([("f1", "a.ts", "file", "src/a.ts", "typescript"), ("f2", "b.ts", "file", "src/b.ts", "typescript"), ("c1", "Thing", "class", "src/b.ts", "typescript"), ("p1", "m.py", "file", "m.py", "python")], "id string, name string, type string, path string, language string")
    e = spark.createDataFrame([(1, "f1", "RESOLVE:./b", "Thing"), (2, "f1", "react", None), (3, "p1", "os", None), (4, "p1", "numpy", None), (5, "f1", "{junk}", None), (6, "f1", "./nowhere", "Nothing"), (7, "f1", "App\\Model", None), (8, "gone", "./b", None), (9, "f1", "./nowhere", "Thing")], "id int, src string, dst string, imported string")
    got = {r.id: (r.status, r.resolved_dst) for r in references.resolve_targets(e, components).collect()}
    assert got == {1: ("resolved", "f2"), 2: ("resolved", "external:npm:react"), 3: ("resolved", "external:stdlib:python:os"), 4: ("skippedExternal", None), 5: ("skippedJunk", None), 6: ("unresolved", None), 7: ("resolved", "external:composer:App\\Model"), 8: ("unresolved", None), 9: ("resolved", "c1")}
    s = spark.createDataFrame([(1, "RESOLVE:./b.ts", "f1", None), (2, "RESOLVE:react", "f1", None), (3, "EXTERNAL:lib/Thing.js", "f1", None), (4, "plain", "f1", None), (5, "RESOLVE:./x/Thing", "f1", None), (6, "any", "f1", True)], "id int, src string, dst string, is_external boolean")
    got = {r.id: (r.status, r.resolved_src) for r in references.resolve_sources(s, components).collect()}
    assert got == {1: ("resolved", "c1"), 2: ("external", None), 3: ("external", "c1"), 4: ("unresolved", None), 5: ("resolved", "c1"), 6: ("external", None)}


def test_reference_joins(spark):
    schema = "id string, name string, type string, path string, parent_id string, start_line int, end_line int, code string, extends array<string>, implements array<string>, fqn string, uses array<string>, module string, bases array<string>"
    rows = [("k", "Klass", "class", "a.py", None, 1, 50, "", ["Base"], ["Api"], "\\App\\Klass", ["\\App\\Tool", "Gone"], "m", ["Base", "object", "n.Other"]), ("m1", "run", "method", "a.py", None, 5, 9, "helper(1); run(2)", None, None, "x", None, "m", None), ("m2", "helper", "function", "a.py", None, 60, 70, "run ()", None, None, "y", None, "m", None), ("b", "Base", "class", "b.py", None, 1, 3, "", None, None, "\\App\\Tool", None, "m", None), ("f", "a.py", "file", "a.py", None, 1, 99, "", None, None, "z", None, None, None)]
    c = spark.createDataFrame(rows, schema)
    assert {(r.src, r.dst) for r in references.call_edges(c).collect()} == {("m1", "m2"), ("m2", "m1")}
    assert {(r.src, r.dst, r.type) for r in references.inheritance_edges(c).collect()} == {("k", "b", "extends"), ("k", "RESOLVE:Api", "implements")}
    assert {(r.src, r.dst, r.type) for r in references.qualified_edges(c, {"uses": "uses_trait"}).collect()} == {("k", "b", "uses_trait"), ("k", "UNRESOLVED:Gone", "uses_trait")}
    assert {(r.src, r.dst) for r in references.class_bases(c.where("bases IS NOT NULL").unionByName(c.where("id = 'b'"))).collect()} == {("k", "b"), ("k", "RESOLVE:n.Other")}
    inside = references.containment(c)
    assert {(r.src, r.dst, r.type) for r in inside.collect()} == {("k", "m1", "class-contains-method")}
    assert {(r.src, r.dst) for r in references.file_contains(c, inside).collect()} == {("f", "k"), ("f", "m2")}
    prefixes = spark.createDataFrame([("App\\", "src"), ("App\\Model\\", "src/model")], "prefix string, target string")
    names = spark.createDataFrame([("App\\Model\\User",), ("App\\X",), ("Other",)], "name string")
    assert {(r.name, r.target) for r in references.longest_prefix(names, prefixes).collect()} == {("App\\Model\\User", "src/model"), ("App\\X", "src")}
    imports = spark.createDataFrame([(1, "pkg/a.py", "os.path", 0), (2, "pkg/a.py", "b", 0), (3, "pkg/sub/c.py", "b", 2), (4, "pkg/a.py", "lib", 0), (5, "pkg/a.py", "nope.x", 0)], "id int, path string, module string, level int")
    known = spark.createDataFrame([("pkg/b.py",), ("lib/__init__.py",)], "path string")
    got = {r.id: (r.kind, r.target) for r in references.python_imports(imports, known).collect()}
    assert got == {1: ("stdlib", "os.path"), 2: ("local", "pkg/b.py"), 3: ("local", "pkg/b.py"), 4: ("local", "lib/__init__.py"), 5: ("unresolved", "UNRESOLVED:nope.x")}
    targets = spark.createDataFrame([(1, "src/a.ts", "typescript", "./b.js"), (2, "src/a.ts", "typescript", "node:fs"), (3, "src/a.ts", "typescript", "../dist/c.js"), (4, "a.py", "python", "flask")], "id int, src_path string, language string, specifier string")
    there = spark.createDataFrame([("src/b.js",), ("src/c.ts",)], "path string")
    assert {r.id: r.target for r in references.import_targets(targets, there).collect()} == {1: "src/b.js", 2: "stdlib:node:fs", 3: "src/c.ts", 4: "module:flask"}
    links = spark.createDataFrame([("d1", "docs/x.md", "../a.py#RUN", None, "link"), ("d2", "docs/x.md", "../b.py", None, "link"), ("d3", "docs/x.md", "helper", None, "index_entry"), ("d4", "docs/x.md", "", "k", "link")], "src string, path string, url string, target_id string, kind string")
    assert {(r.src, r.dst, r.confidence) for r in references.doc_links(links, c).collect()} == {("d1", "m1", 0.8), ("d2", "b", 0.8), ("d3", "m2", 0.8), ("d4", "k", 0.95)}
    assert {(r.src, r.dst) for r in references.mentions(spark.createDataFrame([("t", "uses {{ Base }} and {{none}}")], "id string, text string"), r"\{\{\s*(\w+)\s*\}\}", c, "uses").collect()} == {("t", "b")}


def test_entity_functions(spark):
    assert [_one(spark, en.effort_hours(F.lit(x))) for x in ("3h", "2d", "1w", "x", None)] == [3, 16, 40, 0, 0]
    assert [_one(spark, en.effort_text(F.lit(x))) for x in (7, 12, 60)] == ["7h", "2d", "2w"]
    links = F.array(F.struct(F.lit("component").alias("type"), F.lit("c2").alias("id")), F.struct(F.lit("task").alias("type"), F.lit("c1").alias("id")))
    assert not _one(spark, en.has_link(links, "component", "c1")) and _one(spark, en.has_link(links, "task", "c1")) and _one(spark, en.has_link(links, id_="c2"))
    assert len(_one(spark, en.linked(links, F.lit("task"), F.lit("c1")))) == 2 and len(_one(spark, en.linked(links, F.lit("x"), F.lit("y")))) == 3 and len(_one(spark, en.unlinked(links, F.lit("task"), F.lit("c1")))) == 1
    m = lambda **kv: F.create_map(*[F.lit(x) for p in kv.items() for x in p])
    assert _one(spark, en.merged_maps(m(a="1", b="1"), m(b="2"))) == {"a": "1", "b": "2"} and _one(spark, en.merged_maps(F.lit(None).cast("map<string,string>"), F.lit(None).cast("map<string,string>"))) is None
    assert _one(spark, en.link_target(F.lit("docs/a/x.md"), F.lit("../../src/y.ts#top"))).asDict() == {"path": "src/y.ts", "anchor": "top"}
    assert _one(spark, en.link_target(F.lit("docs/x.md"), F.lit("../../up.md"))).path == "../up.md" and _one(spark, en.link_target(F.lit("docs/x.md"), F.lit("#here"))).path == "docs/x.md"
    assert _one(spark, en.without_json_comments(F.lit('{"u": "http://x" /* c */} // end'))) == '{"u": "http://x" } '
    assert _one(spark, en.project_path(F.lit("C:\\p\\src\\a.ts"), "C:\\p")) == "src/a.ts"
    text = "a\n```mermaid\n\nnonsense\n```\n```mermaid\npie title\n```\n```"
    assert _one(spark, en.markdown_errors(F.lit(text))) == ["Unclosed code block detected (``` fence count is odd)", "Mermaid block L4: missing or unknown diagram type"]
    assert _one(spark, en.rule_errors(F.lit(" "), F.lit("x"), F.lit("g"), F.lit(11), F.lit(0.5), F.lit("merge"))) == ["Name is required", "Invalid rule type", "Priority must be between 1 and 10"]
    assert _one(spark, en.dependency_errors(F.lit("a"), F.lit("a"), F.lit("blocks"))) == ["A task cannot depend on itself"]
    words, patterns = {"backend": ["api", "database"], "frontend": ["button"]}, {"backend": r"\.sql$", "frontend": r"\.tsx$"}
    assert _one(spark, en.work_context(F.array(F.lit("Backend")), F.lit("an API"), F.array(F.lit("x.tsx")), words, patterns)).asDict() == {"type": "backend", "confidence": pytest.approx(12 / 15)}
    assert _one(spark, en.work_context(F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.lit(None).cast("array<string>"), words, patterns)).asDict() == {"type": "full-stack", "confidence": 0.3}
    assert _one(spark, en.component_text(F.lit("run"), F.lit("function"), F.lit(None), F.lit("does  it"), F.lit(""), F.lit("/** doc */\nx"))) == "run function does it /** doc */ /** doc */ x"
    assert _one(spark, terms.is_common(F.lit("The"))) and not _one(spark, terms.is_common(F.lit("graph")))
    assert str(_one(spark, F.to_json(ops.safe_json(F.lit("{bad"))))) == '{"raw":"{bad"}' and _one(spark, F.to_json(ops.safe_json(F.lit('{"a":1}')))) == '{"a":1}'


def test_rule_parts(spark):
    globs = [("src/a.ts", "src/*.ts", True), ("src/x/a.ts", "src/*.ts", False), ("src/x/a.ts", "src/**/*.ts", True), ("src/a.ts", "src/**/*.ts", True), ("a+b.ts", "a+b.ts", True), ("ab.ts", "a?.ts", True)]
    rows = spark.createDataFrame(globs, "path string, pattern string, want boolean")
    assert rows.where(rules.matches_glob(F.col("path"), F.col("pattern")) != F.col("want")).count() == 0
    tasks = spark.createDataFrame([("t1", "# Steps\nx"), ("t2", None)], "id string, description string")
    children = spark.createDataFrame([("t1", "done"), ("t1", "todo")], "parent_id string, status string")
    got = {r.id: r.errors for r in rules.requirement_errors(tasks, children, 1, "done", ["Steps"]).collect()}
    assert got == {"t1": ["All children have to be done"], "t2": ["Missing section: Steps", "At least 1 children are required"]}
    assert _one(spark, rules.condition(F.lit(None).cast("string"), "not_equals", "x")) and not _one(spark, rules.condition(F.lit(None).cast("string"), "equals", "x"))
    wanted, has = F.array(F.lit("calls"), F.lit("extends")), F.array(F.lit("invoke"))
    assert _one(spark, rules.relationship_trigger(wanted, has, {"calls": ["invoke"]})) == 0.5


def test_contexts(spark):
    items = spark.createDataFrame([("a", "A", "class", "ts", "a.ts", "x" * 35, 1.0), ("b", "B", "function", "ts", "b.ts", "y" * 350, 0.5), ("c", "C", "variable", "ts", "c.ts", "z" * 35, 0.4)], "id string, name string, type string, language string, path string, content string, score double")
    e = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "contains")], "src string, dst string, type string")
    seeds = spark.createDataFrame([("a",)], "node string")
    got = {r.id: r.body for r in context.generated(items.drop("score"), e, seeds, 30, 2, form="text").collect()}
    assert got == {"a": "class A\n" + "x" * 35, "c": "variable C\n" + "z" * 35}
    text = "function f() { return ~class; }"
    assert _one(spark, context.decompressed(context.compressed(F.lit(text)))) == text
    code = "\n".join(str(k) for k in range(20))
    assert _one(spark, context.code_summary(F.lit(code))).split("\n") == ["0", "1", "2", "3", "4", "// ... (12 lines omitted) ...", "17", "18", "19"]
    assert _one(spark, context.short_list(F.lit("t\n- a\n- b\n- c"), 2)) == "t\n- a\n- b\n... and 1 more" and _one(spark, context.outline(F.lit("# A\nx\n## B"))) == "# A\n## B"
    template = spark.createDataFrame([("root", None, "note", "R", ""), ("root/x", "root", "rule", "X", "")], "path string, parent_path string, kind string, title string, content string")
    made = {r.title: r for r in context.instantiated(template, "kb1").collect()}
    assert made["X"].parent_id == made["R"].id and made["R"].parent_id is None and made["X"].id.startswith("rule_")


def test_files_and_exports(spark, tmp_path):
    (tmp_path / "src").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    for name, size in {"src/a.ts": 10, "src/b.test.ts": 10, "src/big.ts": 5000, "out/x.js": 3, "src/keep.log": 1, "src/p.bin": 1}.items():
        (tmp_path / name).write_text("x" * size)
    seen = files.classified(walk.listed(spark, str(tmp_path)), ["# c", "out/", "*.log", "!keep.log"], most_bytes=1000)
    assert {r.relative: r.verdict for r in seen.collect()} == {"src/a.ts": "accepted", "src/b.test.ts": "ignored", "src/big.ts": "oversize", "out/x.js": "ignored", "src/keep.log": "unsupported", "src/p.bin": "unsupported"}
    assert files.scan_summary(seen).first().asDict() == {"scanned": 6, "ignored": 2, "oversize": 1, "accepted": 1}
    assert files.classified(spark.createDataFrame([("x/__tests__/c.ts", 1)], "relative string, size int")).first().verdict == "ignored"
    before = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "relative string, size int, modified int")
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "relative string, size int, modified int")
    assert {r.relative: r.change for r in files.changes(before, now).collect()} == {"b": "change", "c": "unlink", "d": "add"}
    c, e = spark.createDataFrame([("a", 1)], "id string, n int"), spark.createDataFrame([("a", "b")], "src string, dst string")
    exports.export_graph(c, e, str(tmp_path / "graph"))
    back = exports.import_graph(spark, str(tmp_path / "graph"), c.schema, e.schema)
    assert back[0].collect() == c.collect() and back[1].collect() == e.collect()


def test_subtree_import(spark):
    schema = "id string, parent_id string, title string"
    source = spark.createDataFrame([("s", None, "Root"), ("s1", "s", "One"), ("s2", "s1", "Two"), ("other", None, "Else")], schema)
    old = spark.createDataFrame([("o", None, "Root"), ("o1", "o", "One")], schema)
    tree = exports.export_subtree(source, "s")
    assert {r.id: r.depth for r in tree.collect()} == {"s": 0, "s1": 1, "s2": 2}
    kept = {r.title: r for r in exports.import_subtree(old, tree, "x").collect()}
    assert len(kept) == 3 and kept["Two"].parent_id == "o1" and kept["One"].id == "o1"
    twice = exports.import_subtree(old, tree, "x", "duplicate").collect()
    assert len(twice) == 5 and len({r.id for r in twice}) == 5
    assert exports.import_subtree(old, tree, "x", "overwrite").count() == 3
    assert exports.library_id(spark.createDataFrame([("b1", "React DOM"), ("b2", "react")], "bundle_id string, name string"), "React").first().bundle_id == "b2"


def test_upsert_patch_and_budget(spark):
    old = spark.createDataFrame([(1, "a", {"k": "1"}, 0), (2, "b", None, 0)], "id int, name string, meta map<string,string>, at int")
    batch = spark.createDataFrame([(1, "x", {"z": "2"}, 1), (1, "y", None, 2), (3, "c", None, 1)], "id int, name string, meta map<string,string>, at int")
    got = {r.id: r for r in ops.upserted(old, batch, ["id"], "at", maps=["meta"]).collect()}
    assert got[1].name == "x" and got[1].meta == {"k": "1", "z": "2"} and got[2].name == "b" and got[3].name == "c"
    last = {r.id: r.name for r in ops.upserted(old, batch, ["id"], "at", first_in_batch=False).collect()}
    assert last == {1: "y", 2: "b", 3: "c"} and ops.cleared(old).count() == 0
    rows = spark.createDataFrame([("g", 1, 6), ("g", 2, 6), ("g", 3, 4), ("h", 1, 11)], "g string, k int, n long")
    assert {(r.g, r.k) for r in ops.within_budget(rows, "g", ["k"], "n", 10).collect()} == {("g", 1), ("g", 3)}
    assert ops.limit_between(None) == 20 and ops.limit_between(5000) == 1000 and ops.limit_between(0) == 1
    assert ops.view(old.withColumn("title", F.lit("t")), "titles").columns == ["id", "title"]


def test_streams(spark, tmp_path):
    source = tmp_path / "events"
    schema = "rule_id string, user_action string, feedback_score int, applied_at timestamp"
    spark.sql("SELECT 'r' AS rule_id, a AS user_action, CAST(s AS int) AS feedback_score, timestamp'2024-01-01' AS applied_at FROM VALUES ('accepted', 5), ('rejected', 1), ('modified', 3) AS t(a, s)").write.json(str(source))
    streaming_rules.rule_metrics(spark.readStream.schema(schema).json(str(source))).writeStream.format("memory").queryName("metrics").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    row = spark.table("metrics").first()
    assert (row.uses, row.accepted, row.rejected, row.acceptance, row.feedback) == (3, 1, 1, 0.5, 3.0)


def test_topic_sessions_as_stream(spark, tmp_path):
    source = tmp_path / "searches"
    spark.sql("SELECT * FROM VALUES (1L, timestamp'2024-01-01 00:00:00', 'search', 'a'), (1L, timestamp'2024-01-01 00:01:00', 'search', 'b'), (1L, timestamp'2024-01-01 00:02:00', 'lock', null), (1L, timestamp'2024-01-01 00:03:00', 'search', 'c'), (2L, timestamp'2024-01-01 00:00:00', 'search', 'z') AS t(session, ts, action, topic)").coalesce(1).write.json(str(source))
    stream = spark.readStream.schema("session long, ts timestamp, action string, topic string").json(str(source))
    got = []
    upkeep.topic_sessions(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    state = {r.session: (r.topic, r.searches, r.locked) for r in got}
    assert state == {1: ("b", 2, True), 2: ("z", 1, False)}


def test_upkeep_batches(spark):
    e = spark.createDataFrame([("n", ["auto:x", "context:y", "z"], [("file", "f1")], 0), ("m", ["auto:x", "z"], [("file", "f2")], 100)], "id string, tags array<string>, links array<struct<type:string,id:string>>, day int").withColumn("updated_at", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, day)"))
    hashes = spark.createDataFrame([("f1", "a", "a"), ("f2", "a", "b")], "path string, old_hash string, new_hash string")
    got = {r.id: (r.kept, r.expired) for r in upkeep.expired(e, hashes, F.expr("timestamp'2024-02-01'")).collect()}
    assert got == {"n": (["auto:x", "z"], 1), "m": (["z"], 1)}
    tries = []

    def job():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("not yet")

    assert upkeep.with_retries(job) == 3


def test_text_functions_by_hand(spark):
    from quarry.functions import text as tx

    assert _one(spark, tx.contractions_expanded(F.lit("I can't, won't, didn't; It's what they'll"))) == "I cannot, will not, did not; it is what they will"
    assert _one(spark, tx.punctuation_cleaned(F.lit("Wait!!! what ,now .then\nend;"))) == "Wait! what,now. then\nend"
    assert _one(spark, tx.tokens(F.lit("Dr. Who came. He left! ok"), "sentence")) == ["Dr. Who came.", "He left! ok"]
    assert _one(spark, tx.tokens(F.lit("well-known a b2"), least=2)) == ["well-known", "b2"] and _one(spark, tx.tokens(F.lit("a-b"), hyphens=False)) == ["a", "b"]
    assert _one(spark, tx.tokens(F.lit("x|y"), "custom", custom=lambda t: F.split(t, "[|]"))) == ["x", "y"]
    assert _one(spark, tx.cleaned(F.lit("See https://x.y `code` 12 me@a.bc <b>Bold</b>"), emails=True, html=True, code=True, numbers=True, stop_words=["see"])) == "bold"
    assert _one(spark, tx.compatible(F.lit("ﬁne ②"))) == "fine 2" and _one(spark, tx.entities_decoded(F.lit("&amp;lt; &copy;"))) == "&lt; ©"
    assert _one(spark, tx.word_ngrams(F.array(F.lit("a")), 2)) == [] and _one(spark, tx.spaces_normalised(F.lit(" a  b \n c "))) == "a b\nc"
    with pytest.raises(ValueError, match="at least 1"):
        tx.word_ngrams(F.array(F.lit("a")), 0)


def test_bundles_snapshots_and_summaries(spark, tmp_path):
    from quarry.operators import statistics as st

    docs = spark.createDataFrame([("1", "guide"), ("2", "guide"), ("3", "api")], "doc_id string, section_type string")
    both = exports.attached({"a": docs, "b": docs.where("doc_id = '3'")})
    assert [(r.bundle_id, r.section_type, r.n) for r in exports.sections(both).collect()] == [("a", "guide", 2), ("a", "api", 1), ("b", "api", 1)]
    exports.export_snapshot({"docs": docs}, str(tmp_path))
    assert sorted(exports.import_snapshot(spark, str(tmp_path), {"docs": docs.schema})["docs"].collect()) == sorted(docs.collect())
    statuses = spark.createDataFrame([("resolved",), ("resolved",), ("unresolved",)], "status string")
    assert {r.status: r.n for r in references.status_summary(statuses).collect()} == {"resolved": 2, "unresolved": 1}
    assert [_one(spark, st.confidence_bucket(F.lit(x))) for x in (0.2, 0.5, 0.95, 1.0)] == ["0.0-0.5", "0.5-0.6", "0.9-1.0", "0.9-1.0"]
    assert _one(spark, context.item_priority(F.lit("class"), F.lit(True), F.lit(20))) == 30
