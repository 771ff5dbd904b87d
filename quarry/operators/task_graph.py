"""Order, critical path and blocked tasks of any prerequisite graph, and depths of any parent tree.

Edges are (src, dst): src comes before dst. Each round is a shuffle join on node ids over the nodes
that still wait, so hot nodes only cost a partial count; the number of rounds is the graph's depth
(schedule) or its logarithm (tree_places).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import ordered
from quarry.sources.written import settled


class CycleError(ValueError):
    """A graph that has no order."""


def schedule(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, finish, via) of each node of nodes (node, effort).

    level: hops of the longest chain of prerequisites before it. finish: its effort and that of the
    dearest chain before it. via: the prerequisite that this chain ends with (null: none; ties: the
    least). Null efforts count 0; edges with an end that is no node, and repeated edges, are ignored.
    """
    efforts = nodes.groupBy("node").agg(F.max(F.coalesce(F.col("effort").cast("double"), F.lit(0.0))).alias("effort"))
    known = efforts.select("node")
    links = edges.select("src", "dst").distinct()
    links = links.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    links = settled(links, "links")
    needs = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("needs"))
    kind = dict(efforts.dtypes)["node"]
    start = efforts.join(needs, "node", "left").select("node", "effort", F.coalesce("needs", F.lit(0)).alias("needs"), F.lit(None).cast(f"struct<finish:double,via:{kind}>").alias("best"))
    now, level, done = settled(start, "waiting"), 0, None
    while True:
        ready = now.where("needs = 0").select("node", F.lit(level).alias("level"), (F.col("effort") + F.coalesce("best.finish", F.lit(0.0))).alias("finish"), F.col("best.via").alias("via"))
        done = ready if done is None else done.unionByName(ready)
        left = now.agg(F.count_if(F.col("needs") > 0).alias("waiting"), F.count_if(F.col("needs") == 0).alias("ready")).first()
        if not left["waiting"]:
            return done
        if not left["ready"]:
            raise CycleError("the nodes that still wait form or follow a cycle")
        came = ready.join(links, ready["node"] == links["src"]).groupBy("dst").agg(F.count("*").alias("n"), F.max("finish").alias("f"), F.min(F.struct((-F.col("finish")).alias("cost"), F.col("node").alias("via"))).alias("b"))
        arrived = came.select("dst", "n", F.struct(F.col("f").alias("finish"), F.col("b.via").alias("via")).alias("found"))
        better = F.col("best").isNull() | (F.col("found.finish") > F.col("best.finish")) | ((F.col("found.finish") == F.col("best.finish")) & (F.col("found.via") < F.col("best.via")))
        waiting = now.where("needs > 0")
        step = waiting.join(arrived, waiting["node"] == arrived["dst"], "left")
        best = F.when(F.col("found").isNotNull() & better, F.col("found")).otherwise(F.col("best"))
        now = settled(step.select("node", "effort", (F.col("needs") - F.coalesce("n", F.lit(0))).alias("needs"), best.alias("best")), "waiting")
        level += 1


def critical_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(step, node, finish): the dearest chain, from its last task (step 0) back; ties: the least node.

    By pointer doubling over `via`: each round knows the task 2^k before each, so that the part of the
    path that is known doubles.
    """
    planned = settled(schedule(nodes, edges), "planned")
    path = settled(planned.orderBy(F.desc("finish"), "node").limit(1).select("node", F.lit(0).alias("step")), "path")
    jump, length = planned.where("via IS NOT NULL").select(F.col("node").alias("at"), F.col("via").alias("to")), 1
    while True:
        more = path.join(jump, path["node"] == jump["at"]).select(F.col("to").alias("node"), (F.col("step") + length).alias("step"))
        if more.isEmpty():
            return path.join(planned, "node").select("step", "node", "finish")
        path = settled(path.unionByName(more), "path")
        next_ = jump.select(F.col("at").alias("mid"), F.col("to").alias("end"))
        jump, length = settled(jump.join(next_, jump["to"] == next_["mid"]).select("at", F.col("end").alias("to")), "jump"), 2 * length


def blocked(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, blockers): tasks (node, done) that aren't done and wait for at least one that isn't.

    A null `done` counts as not done. Edges from unknown tasks block nothing.
    """
    open_ = tasks.where(~F.coalesce(F.col("done"), F.lit(False))).select("node").distinct()
    links = edges.select("src", "dst").distinct()
    held = links.join(open_.withColumnRenamed("node", "src"), "src", "left_semi").groupBy("dst").agg(F.count("*").alias("blockers"))
    return open_.join(held, open_["node"] == held["dst"]).select("node", "blockers")


def blocking(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, waiting): tasks (node, done) that aren't done and that others wait for which aren't done either: the twin of blocked()."""
    return blocked(tasks, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("blockers", "waiting")


def tree_places(nodes: DataFrame) -> DataFrame:
    """(node, root, depth) of each distinct node of nodes (node, parent), by pointer doubling.

    A null or unknown parent makes a root, at depth 0. Of repeated nodes the least parent counts.
    """
    given = nodes.where("node IS NOT NULL").groupBy("node").agg(F.min("parent").alias("parent"))
    names = given.select(F.col("node").alias("known"))
    found = given.join(names, given["parent"] == names["known"], "left")
    now = settled(found.select("node", F.coalesce("known", "node").alias("root"), F.col("known").isNotNull().cast("int").alias("depth")), "tree")
    total, jump = now.count(), 1
    while True:
        up = now.select(F.col("node").alias("at"), F.col("root").alias("next"), F.col("depth").alias("more"))
        moved = settled(now.join(up, now["root"] == up["at"]).select("node", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")), "tree")
        now = moved.select("node", "root", "depth")
        if moved.where("moved").isEmpty():
            return now
        jump *= 2
        if jump > 2 * total:
            raise CycleError("a node is its own ancestor")


def tree_order(nodes: DataFrame, order: Sequence[str] = (), chunks: int | None = None) -> DataFrame:
    """(node, parent, sibling, depth, place, size) of each distinct node of nodes (node, parent) and columns to order siblings by.

    place: from 0, each node before its children, siblings in order (nulls last; ties: the least node).
    sibling: from 1 among the children of a parent, or among the roots. size: nodes in the subtree. Null or unknown parents make roots,
    whose parent is null here. Of repeated nodes the least parent counts, then the least in order.

    An Euler tour enters each node before its children and leaves it after them; pointer doubling counts,
    from each step of the tour, what is still to be entered. Rounds grow with the logarithm of the
    number of nodes, whatever the depth or the number of children.
    """
    given = nodes.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("parent", *order)).alias("x")).select("node", "x.*")
    names = given.select(F.col("node").alias("known"))
    rows = given.join(names, given["parent"] == names["known"], "left").drop("parent").withColumnRenamed("known", "parent")
    rows = ordered.placed(rows, [F.struct("parent"), *ordered.nulls_last(order), "node"], "siblings", chunks)
    rows = settled(ordered.following(ordered.numbered(rows, ["parent"], "sibling"), ["parent"], "node", "after").select("node", "parent", "sibling", "after"), "siblings")
    first = rows.where("sibling = 1 AND parent IS NOT NULL").select(F.col("parent").alias("node"), F.col("node").alias("child"))
    # a step is (node, entering); null as the next step ends the tour
    enter = rows.join(first, "node", "left").select("node", F.lit(True).alias("enters"), F.coalesce("child", "node").alias("next"), F.col("child").isNotNull().alias("next_enters"))
    leave = rows.select("node", F.lit(False).alias("enters"), F.coalesce("after", "parent").alias("next"), F.col("after").isNotNull().alias("next_enters"))
    tour = settled(enter.unionByName(leave).select("*", F.col("enters").cast("long").alias("n"), F.when(F.col("enters"), 1).otherwise(-1).cast("long").alias("d")), "tour")
    total, jump = rows.count(), 1
    while True:
        ahead = tour.select(F.col("node").alias("at"), F.col("enters").alias("at_enters"), F.col("next").alias("then"), F.col("next_enters").alias("then_enters"), F.col("n").alias("more"), F.col("d").alias("deeper"))
        joined = tour.join(ahead, (tour["next"] == ahead["at"]) & (tour["next_enters"] == ahead["at_enters"]), "left")
        tour = settled(joined.select("node", "enters", F.col("then").alias("next"), F.col("then_enters").alias("next_enters"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), (F.col("d") + F.coalesce("deeper", F.lit(0))).alias("d")), "tour")
        if tour.where("next IS NOT NULL").isEmpty():
            break
        jump *= 2
        if jump > 4 * total:
            raise CycleError("a node is its own ancestor")
    ends = tour.groupBy("node").agg(F.max(F.when(F.col("enters"), F.col("n"))).alias("to_come"), F.max(F.when(~F.col("enters"), F.col("n"))).alias("left"), F.max(F.when(F.col("enters"), -F.col("d"))).alias("depth"))
    return rows.join(ends, "node").select("node", "parent", F.col("sibling").cast("long").alias("sibling"), "depth", (F.lit(total) - F.col("to_come")).alias("place"), (F.col("to_come") - F.col("left")).alias("size"))
