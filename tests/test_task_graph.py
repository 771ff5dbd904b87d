"""Task graphs and trees on small literal frames."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import task_graph as tg

EDGES = "src string, dst string"


def _nodes(spark, efforts):
    return spark.createDataFrame(list(efforts.items()), "node string, effort double")


def test_schedule_of_a_diamond(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d"), ("a", "b"), ("q", "d")], EDGES)
    got = {r.node: (r.level, r.finish, r.via) for r in tg.schedule(_nodes(spark, {"a": 1.0, "b": 2.0, "c": 5.0, "d": None, "e": 3.0}), e).collect()}
    assert got == {"a": (0, 1.0, None), "b": (1, 3.0, "a"), "c": (1, 6.0, "a"), "d": (2, 6.0, "c"), "e": (0, 3.0, None)}
    path = tg.critical_path(_nodes(spark, {"a": 1.0, "b": 2.0, "c": 5.0, "d": 1.0}), e).orderBy("step").collect()
    assert [(r.step, r.node) for r in path] == [(0, "d"), (1, "c"), (2, "a")]


def test_schedule_against_recursion(spark):
    rng = random.Random(5)
    efforts = {f"n{k:02}": float(rng.randrange(4)) for k in range(30)}
    names = sorted(efforts)
    links = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.12]
    before = {n: sorted(a for a, b in links if b == n) for n in names}
    want = {}
    for n in names:
        via = min(before[n], key=lambda a: (-want[a][1], a), default=None)
        want[n] = (max((want[a][0] + 1 for a in before[n]), default=0), efforts[n] + (want[via][1] if via else 0), via)
    got = {r.node: (r.level, r.finish, r.via) for r in tg.schedule(_nodes(spark, efforts), spark.createDataFrame(links, EDGES)).collect()}
    assert got == want


def test_cycles_and_empty_graphs(spark):
    nodes = _nodes(spark, {"a": 1.0, "b": 1.0, "c": 1.0})
    with pytest.raises(tg.CycleError):
        tg.schedule(nodes, spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], EDGES))
    none = spark.createDataFrame([], EDGES)
    assert tg.schedule(nodes.limit(0), none).count() == 0
    assert tg.critical_path(nodes.limit(0), none).count() == 0
    assert {r.level for r in tg.schedule(nodes, none).collect()} == {0}


def test_blocked(spark):
    tasks = spark.createDataFrame([("a", True), ("b", False), ("c", None), ("d", False), ("e", True)], "node string, done boolean")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "d"), ("b", "d"), ("x", "b"), ("b", "e")], EDGES)
    assert {r.node: r.blockers for r in tg.blocked(tasks, e).collect()} == {"c": 1, "d": 2}


def test_tree_places(spark):
    rows = spark.createDataFrame([(k, k - 1 if k % 40 else None) for k in range(100)] + [(200, 999), (201, 200), (None, 3)], "node int, parent int")
    got = {r.node: (r.root, r.depth) for r in tg.tree_places(rows).collect()}
    assert got == {k: (k - k % 40, k % 40) for k in range(100)} | {200: (200, 0), 201: (200, 1)}
    for loop in ([(1, 2), (2, 1)], [(1, 1)], [(1, 2), (2, 3), (3, 1), (4, 1)]):
        with pytest.raises(tg.CycleError):
            tg.tree_places(spark.createDataFrame(loop, "node int, parent int"))
    assert tg.tree_places(rows.limit(0)).count() == 0


def test_snippets(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc\nd\nHit e\nf\ng\nh\ni"), (2, "x\ny"), (3, None), (4, "hit")], "id int, text string")
    got = {r.id: (r.s.reason, r.s.line, r.s.snippet) for r in rows.select("id", tx.snippet(F.col("text"), "hit", 1).alias("s")).collect()}
    assert got == {1: ("match", 5, "d\nHit e\nf"), 2: ("head", 1, "x\ny"), 3: ("none", None, None), 4: ("match", 1, "hit")}
