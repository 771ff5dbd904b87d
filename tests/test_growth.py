"""Steps whose cost has to stay in proportion: their results against plain Python, and what their plans must not hold."""

import random

from pyspark.sql import functions as F

from quarry.functions import chunking as ch
from quarry.functions import ranking as rk
from quarry.operators import discovery, graph, references, usage
from quarry.plans import registry
from tests import oracle


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _part(spark, folder, keys, sizes):
    rows = [(k, f"name {k}", f"Brand#{k % 3}", "SMALL TIN", sizes(k), float(k)) for k in keys]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{folder}/part.parquet/*.parquet')")
    return con


def test_normal_vectors_hash_a_text_once_for_eight_values(spark):
    rows = spark.range(3).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("t"))
    got = rows.select(rk.normal_vector(F.col("t"), 20).alias("v"))
    assert all(abs(sum(x * x for x in r.v) - 1) < 1e-9 and len(r.v) == 20 for r in got.collect())
    assert _optimized(got).count("sha2(") == 1


def test_new_ids_that_are_taken_already(spark, tmp_path):
    con = _part(spark, tmp_path, [1, 2, 3, 4, 1_000_001, 1_000_002, 1_000_003], lambda k: {1: 50, 2: 50, 3: 50, 4: 50, 1_000_001: 44, 1_000_002: 48, 1_000_003: 7}[k])
    assert oracle.difference(registry.queries()["components_upserted"](spark, str(tmp_path)), con, registry.oracle_sql()["components_upserted"]) == ""


def test_rule_conflicts_are_shuffled(spark):
    assert "Broadcast" not in _plan(registry.queries()["rule_conflicts"](spark, "/root/testdata/sf0.001"))


def test_even_pieces_are_cut_from_parts_of_the_text(spark):
    texts = [None, "", "ab", "ż" * 200, "x" * 201, *("".join(chr(97 + k % 26) for k in range(n)) for n in (350, 351, 4799, 4800, 4801, 4850, 4851, 4999, 20_003))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")

    def plain(t, most, overlap):
        if t is None:
            return None
        out, at = [], 0
        while at < len(t):
            out.append(t[at : at + most])
            at = len(t) if at + most >= len(t) else at + max(1, most - overlap)
        return out

    for most, overlap in ((200, 50), (7, 0), (20, 19)):
        got = {r.k: r.p for r in df.select("k", ch.large_segment(F.col("t"), most, overlap, whole_words=False).alias("p")).collect()}
        assert got == {k: plain(t, most, overlap) for k, t in enumerate(texts)}
    assert "aggregate(" not in _optimized(df.select(ch.large_segment(F.col("t"), 200, 50, whole_words=False)))


def test_expansion_moves_no_terms(spark):
    asked = spark.createDataFrame([(1, "Function method"), (2, None), (3, "nothing"), (4, "db cache"), (4, "db cache")], "id int, query string")
    found = discovery.expanded(asked, 3, wanted=lambda t: t != "func")
    assert [(r.term, r.source, r.score, r.place) for r in found.where("id = 1").orderBy("place").collect()] == [("method", "synonym", 0.9, 1), ("procedure", "synonym", 0.9, 2), ("routine", "synonym", 0.9, 3)]
    assert {r.id for r in found.collect()} == {1, 4}
    assert "Exchange" not in _plan(found)


def test_labels_never_pass_through_the_driver(spark, monkeypatch):
    plans, write = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df, name="round": plans.append(_plan(df)) or write(df, name))
    edges = spark.createDataFrame([(k, k // 2) for k in range(1, 40)], "src int, dst int")
    assert graph.component_count(spark.range(45).select(F.col("id").cast("int").alias("node")), edges).first()[:] == (6, 5)
    assert plans and not any("Broadcast" in p for p in plans)


def test_calls_leave_the_join_as_they_are(spark):
    r = random.Random(3)
    rows = [(f"i{k % 50}", r.choice(["p", "q"]), r.choice(["aa", "bb", "cc", "d"]), r.choice(["aa(bb (", "cc(); d()", None, "aa(aa("])) for k in range(80)]
    c = spark.createDataFrame(rows, "id string, path string, name string, code string")
    want = sorted({(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[0] != b[0] and len(b[2]) > 1 and a[3] and (b[2] + "(" in a[3] or b[2] + " (" in a[3])})
    found = references.call_edges(c)
    assert sorted((x.src, x.dst) for x in found.collect()) == want
    # pairs of ids with one name are in no aggregate, and no join waits for one broadcast side
    once = _optimized(found).split("Union")[1].split("Join")[0]
    assert "Aggregate" not in once and "Broadcast" not in _plan(found)


def test_containment_meets_equal_lines_once(spark):
    r = random.Random(9)
    rows = []
    for k in range(300):
        a = r.choice([0, 1, 5, 60, 63, 64, 70, 130])
        rows.append((f"i{r.choice([k, k % 40])}", r.choice("pq"), r.choice(["class", "module", "method", "property", "file"]), r.choice([None, None, "x"]), a, a + r.choice([0, 3, 9, 70, 200])))
    kinds = {}
    rows = [x for x in rows if kinds.setdefault(x[0], x[2]) == x[2]]
    c = spark.createDataFrame(rows, "id string, path string, type string, parent_id string, start_line int, end_line int")
    want = {}
    for i, p, t, parent, s, e in rows:
        if parent is None and t != "file":
            fits = [(b - a, a, src) for src, q, u, _, a, b in rows if u in ("class", "module") and q == p and src != i and s >= a and e <= b and (s, e) != (a, b)]
            if fits:
                want[i] = min([want[i], min(fits)] if i in want else [min(fits)])
    found = references.containment(c)
    assert {x.dst: x.src for x in found.collect()} == {i: w[2] for i, w in want.items()}
    # what the join of bins makes goes into a hash table of distinct lines, not into a sort of all pairs
    joined = _plan(found).split("bin")[0]
    assert joined.count("SortAggregate") <= 2 and "min(((" in _optimized(found)


def test_ways_end_within_their_bound(spark):
    long = [(f"n{k}", f"n{k + 1}", "x") for k in range(7)] + [("a", "b", "x")]
    edges = spark.createDataFrame(long, "src string, dst string, type string")
    assert [graph.flow_complexity(edges, 2, within=w).first()["depth"] for w in (3, 7, 9, None)] == [3, 7, 7, 7]
    assert graph.closure(edges, edges.limit(0).select(F.col("src").alias("node")), within=2).count() == 0


def test_usage_of_a_line_is_told_apart_in_the_line(spark):
    lines = spark.createDataFrame([("f", 1, "def m1(x):"), ("f", 2, "  m2(v1, v1) + m2(v1)")], "file string, line int, text string")
    parts = spark.createDataFrame([("f", "a", "m1", "method", 0), ("f", "b", "m2", "method", 0), ("f", "c", "v1", "variable", 0)], "file string, id string, name string, type string, place int")
    found = usage.usage_edges(lines, parts, usage.PYTHON)
    assert sorted((x.src, x.dst, x.usage) for x in found.collect()) == [("a", "b", "function_call"), ("a", "c", "variable_reference")]
    assert "array_distinct" in _optimized(found)


def test_pairs_that_are_edges_need_no_tree(spark, monkeypatch):
    def no_tree(*_):
        raise AssertionError("a tree was built")

    monkeypatch.setattr(graph.task_graph, "tree_order", no_tree)
    edges = spark.createDataFrame([(k, k // 2) for k in range(2, 12)], "src int, dst int")
    asked = spark.createDataFrame([(1, 2), (5, 11), (4, 5), (7, 7)], "src int, dst int")
    assert {(x.src, x.dst): x.closes for x in graph.would_cycle(edges, asked).collect()} == {(1, 2): True, (5, 11): True, (4, 5): False, (7, 7): True}


def test_ways_are_followed_to_their_end(spark, tmp_path):
    """Before, the query and its SQL ended ways after 40 hops."""
    con = _part(spark, tmp_path, [41, *(40 << k for k in range(50))], lambda k: 1)
    found = registry.queries()["graph_flow_complexity"](spark, str(tmp_path))
    assert found.first()["depth"] > 50
    assert oracle.difference(found, con, registry.oracle_sql()["graph_flow_complexity"]) == ""


def test_longest_way_of_many_roots(spark):
    r = random.Random(11)
    links = {(a, b) for a in range(20) for b in range(20) if r.random() < 0.08 and (a < b or r.random() < 0.2)} | {(100 + k, r.randrange(20)) for k in range(30)} | {(100, 200), *((200 + k, 201 + k) for k in range(8)), (205, 201)}
    ends = {b for _, b in links}
    roots, want = sorted({a for a, _ in links} - ends), 0
    for root in roots:
        seen, front, hop = set(), {root}, 0
        while front := {b for a, b in links if a in front} - seen:
            seen, hop = seen | front, hop + 1
        want = max(want, hop)
    edges = spark.createDataFrame(sorted(links), "src int, dst int")
    found = graph._longest_way(edges, spark.createDataFrame([(a,) for a in roots], "node int"), leap=3, direct=0, first=1)
    assert found.first()["depth"] == want >= 9
