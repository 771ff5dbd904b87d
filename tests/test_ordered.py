"""Orders without a task that holds a group: against plain Python, with ties, nulls and one group over all chunks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import context, ordered
from quarry.operators import entities as ops
from quarry.sources.keyed import KeyedTable
from quarry.sources.manifest import Conflict


def _greedy(rows, budget):
    used, kept = 0, []
    for r in rows:
        if used + (r[2] or 0) <= budget:
            used, kept = used + (r[2] or 0), [*kept, r[3]]
    return kept


@pytest.mark.parametrize(("seed", "most", "budget"), [(1, 9, 100), (2, 100, 1000), (3, 1000, 5000), (4, 3, 0), (5, 60, 127)])
def test_budget_by_rounds_is_the_greedy_one(spark, seed, most, budget):
    r = random.Random(seed)
    rows = [(None if k % 97 == 0 else r.choice("ab"), r.choice([None, *range(400)]), r.choice([None, 0, *range(1, most)]), k) for k in range(1200)]
    rows += [("c", k, s, 10_000 + k) for k, s in enumerate(x for n in range(60) for x in (1, max(0, budget - n)))]  # many rounds if each took one row
    df = spark.createDataFrame(rows, "g string, k int, n int, id int").repartition(5)
    want = {}
    for g in (None, "a", "b", "c"):
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is None, x[1] or 0, x[2] or 0))
        want[g] = sorted((x[1] is None, x[1] or 0, x[2] or 0) for x in mine if x[3] in set(_greedy(mine, budget)))
    for folded in (0, 300):
        got = ordered.within_budget(df, ["g"], ["k"], "n", budget, folded, chunks=6).collect()
        assert {g: sorted((x.k is None, x.k or 0, x.n or 0) for x in got if x.g == g) for g in want} == want, folded


def test_budget_takes_one_of_two_ties(spark):
    df = spark.createDataFrame([("g", 1, 60), ("g", 1, 60), ("g", 2, 50), ("g", 3, 40)], "g string, k int, n int")
    for folded in (0, 100):
        assert sorted(r.n for r in ordered.within_budget(df, ["g"], ["k"], "n", 100, folded).collect()) == [40, 60]
    assert ordered.within_budget(df.limit(0), ["g"], ["k"], "n", 100).count() == 0 and ordered.within_budget(df, [], ["k"], "n", -1).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 150, 299, 305, 400, 500])
def test_best_rows(spark, n):
    r = random.Random(n)
    rows = [(k, r.choice([None, float("nan"), float("inf"), -float("inf"), 1e300, -1e300, 5e-324, 0.0, *(r.gauss(0, 1) for _ in range(20))])) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, score double").repartition(4)
    rank = lambda x: (x[1] is None or math.isnan(x[1]), -(x[1] if x[1] is not None and not math.isnan(x[1]) else 0), x[0])
    assert sorted(x.id for x in ordered.best_rows(df, "score", n, ["id"]).collect()) == sorted(x[0] for x in sorted(rows, key=rank)[:n])


def test_retained_keeps_a_share(spark):
    df = spark.createDataFrame([(k, 1.0 if k < 50 else None) for k in range(100)], "id int, score double")
    assert sorted(r.id for r in ops.retained(df, "score", 2.0, 0.3).collect()) == list(range(30))
    assert ops.retained(df, "score", 1.0, 0.3).count() == 50 and ops.retained(df, "score", 2.0, 0.7).count() == 70 and ops.retained(df.limit(0), "score", 1, 0.5).count() == 0


def test_context_keeps_items_without_a_score(spark):
    items = spark.createDataFrame([("a", "A", "class", "ts", "p", "x" * 35, None), ("b", "B", "class", "ts", "p", "x" * 35, 0.5), ("c", "C", "file", "ts", "p", None, None)], "id string, name string, type string, language string, path string, content string, score double")
    edges = spark.createDataFrame([("a", "b", "uses"), ("b", "c", "uses")], "src string, dst string, type string")
    assert {r.id for r in context.packed(context.Context(items, edges), 1000).items.collect()} == {"a", "b", "c"}
    one = context.packed(context.Context(items, edges), 12)
    assert {r.id for r in one.items.collect()} == {"b", "c"} and one.edges.count() == 1


def test_carried_over_chunks(spark):
    rows = [("f", k, f"C{k}" if k % 100 == 0 and k else None) for k in range(1000)] + [("g", k, None) for k in range(5)] + [(None, 1, "N"), (None, 2, None)]
    df = ordered.placed(spark.createDataFrame(rows, "f string, k int, c string").repartition(3), [F.struct("f"), "k"], chunks=5)
    assert df.select("chunk").distinct().count() > 1
    got = {(r.f, r.k): r.c for r in ordered.carried(df, ["f"], ["c"]).collect()}
    assert got == {(f, k): {"f": f"C{k // 100 * 100}" if k >= 100 else None, "g": None, None: "N"}[f] for f, k, _ in rows}


def test_upsert_of_odd_rows(spark):
    schema = "id int, name string, at int"
    old = spark.createDataFrame([(1, "a", 0), (None, "null", 0)], schema)
    batch = spark.createDataFrame([(1, "x", None), (2, "b", None), (2, "c", 5), (3, "t", 1), (3, "s", 1), (None, "n", 1)], schema)
    got = {r.id: r.name for r in ops.upserted(old, batch, ["id"], "at").collect()}
    assert got == {1: "x", 2: "c", 3: "s", None: "n"}
    last = {r.id: r.name for r in ops.upserted(old, batch, ["id"], "at", first_in_batch=False).collect()}
    assert last == {1: "x", 2: "c", 3: "t", None: "n"}
    vectors = spark.createDataFrame([(1, "note", [1.0]), (1, "task", [2.0])], "id int, type string, v array<double>").withColumn("at", F.lit(0))
    new = spark.createDataFrame([(1, "task", [3.0], 1), (2, "task", [4.0], 1)], vectors.schema)
    assert {(r.id, r.type): r.v for r in ops.upserted(vectors, new, ["id", "type"], "at").collect()} == {(1, "note"): [1.0], (1, "task"): [3.0], (2, "task"): [4.0]}


def test_patches_of_one_key_come_one_after_the_other(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "c", "z")], "id int, name string, note string")
    patches = spark.createDataFrame([(1, "p", True, None, False, 1), (1, None, False, "q", True, 2), (1, "r", True, None, False, 3), (2, None, True, "w", None, 1), (None, "n", True, "n", True, 1), (9, "n", True, "n", True, 1)], "id int, name string, set_name boolean, note string, set_note boolean, at int")
    assert {r.id: (r.name, r.note) for r in ops.patched(rows, patches, order="at").collect()} == {1: ("r", "q"), 2: (None, "y"), None: ("c", "z")}


def test_subtree_of_a_cycle_has_its_root_once(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b")], "id string, parent_id string")
    assert {r.id: r.depth for r in ops.subtree(rows, "a").collect()} == {"a": 0, "b": 1, "c": 2}
    assert ops.subtree(rows, "a").count() == 3


def test_keyed_table_rewrites_touched_buckets_only(spark, tmp_path):
    schema = "id int, type string, name string, at int"
    at = f"file://{tmp_path}/table"
    one = KeyedTable(spark, at, schema, ["id", "type"], 16)
    assert one.read().count() == 0
    one.upsert(spark.createDataFrame([(k, "t", f"n{k}", 0) for k in range(200)], schema), "at")
    before = one.paths()
    one.upsert(spark.createDataFrame([(7, "t", "seven", 1), (7, "t", "late", 2), (7, "u", "other", 1), (None, "t", "none", 1)], schema), "at")
    after = one.paths()
    assert 1 <= sum(before.get(b) != p for b, p in after.items()) <= 3
    rows = {(r.id, r.type): r.name for r in KeyedTable(spark, at, schema, ["id", "type"], 16).read().collect()}
    assert len(rows) == 202 and rows[7, "t"] == "seven" and rows[7, "u"] == "other" and rows[None, "t"] == "none" and rows[8, "t"] == "n8"
    held = one.read()
    one.patch(spark.createDataFrame([(8, "t", None, True)], "id int, type string, name string, set_name boolean"))
    assert held.count() == 202  # a reader keeps its version
    one.delete(spark.createDataFrame([(k, "t") for k in range(150)], "id int, type string"))
    left = {(r.id, r.type): r.name for r in one.read().collect()}
    assert len(left) == 52 and (8, "t") not in left and left[199, "t"] == "n199"
    one.delete(spark.createDataFrame([(k, "t") for k in range(200)], "id int, type string"))
    assert {(r.id, r.type) for r in one.read().collect()} == {(7, "u"), (None, "t")}
    one.upsert(spark.createDataFrame([], schema), "at")
    two = KeyedTable(spark, at, schema, ["id", "type"], 16)
    version, value = two._manifest.latest()
    one._manifest.commit(version, value)
    with pytest.raises(Conflict):
        two._manifest.commit(version, value)
