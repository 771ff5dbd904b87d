"""Trees in order, reachability and critical paths against plain Python, on odd and hot graphs."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.operators import task_graph as tg


def _walk(rows):
    names = {n for n, _, _ in rows}
    children = {}
    for n, p, o in rows:
        children.setdefault(p if p in names else None, []).append(((o is None, o or 0, n), n))
    out = []

    def visit(at, depth):
        for k, (_, n) in enumerate(sorted(children.get(at, []))):
            place = len(out)
            out.append(n)
            size = visit(n, depth + 1)
            found[n] = (at, k + 1, depth, place, size)
        return 1 + sum(found[c][4] for _, c in children.get(at, []))

    found = {}
    visit(None, 0)
    return found


@pytest.mark.parametrize("chunks", [None, 4])
def test_tree_order(spark, chunks):
    r = random.Random(3)
    rows = [(k, r.choice([None, *range(k)]) if k else None, r.choice([None, 1, 2, 3])) for k in range(60)]
    rows += [(100 + k, 99 + k, None) for k in range(80)] + [(300 + k, 5, k % 7) for k in range(60)]  # an orphan's chain, and a hub
    df = spark.createDataFrame(rows, "node int, parent int, o int")
    got = {x.node: (x.parent, x.sibling, x.depth, x.place, x.size) for x in tg.tree_order(df.unionByName(df.limit(3)), ["o"], chunks).collect()}
    assert got == _walk(rows)
    assert tg.tree_order(df.limit(0), ["o"]).count() == 0


def test_tree_order_refuses_cycles(spark):
    for loop in ([(1, 2), (2, 1)], [(1, 1)], [(1, None), (2, 3), (3, 2)]):
        with pytest.raises(tg.CycleError):
            tg.tree_order(spark.createDataFrame(loop, "node int, parent int")).count()


def test_critical_path_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(k, float(k % 3)) for k in range(23)], "node int, effort double")
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(21, 22)], "src int, dst int")
    rows = sorted((r.step, r.node) for r in tg.critical_path(nodes, edges).collect())
    assert rows == [(k, 20 - k) for k in range(21)]


@pytest.mark.parametrize("cyclic", [False, True])
def test_reachable(spark, cyclic):
    r = random.Random(7)
    links = {(a, b) for a in range(40) for b in range(40) if r.random() < 0.03 and (a < b or (cyclic and r.random() < 0.3))}
    links |= {(50, k) for k in range(60, 90)} | {(k, 51) for k in range(60, 90)} | {(30, 50)}  # a hub
    reach = {a: {a} for a in range(100)}
    for _ in range(100):
        for a, b in links:
            for seen in reach.values():
                if a in seen:
                    seen.add(b)
    pairs = [(a, b) for a in range(0, 100, 3) for b in range(0, 100, 2)] + [(None, 3), (3, None), (3, 3), (3, 3)]
    got = {(x.src, x.dst): x.reaches for x in graph.reachable(spark.createDataFrame(sorted(links), "src int, dst int"), spark.createDataFrame(pairs, "src int, dst int")).collect()}
    assert got == {(a, b): b in reach[a] for a, b in pairs if a is not None and b is not None}


def test_peeled_levels(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z"), ("c", "z")], "src string, dst string")
    assert {r.node: r.level for r in graph.peeled(edges).collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "z": None}
    assert graph.peeled(edges.limit(0)).count() == 0 and graph.would_cycle(edges.limit(0), edges).where(F.col("closes")).count() == 0
