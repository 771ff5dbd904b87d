"""Graph operators over edge frames (src, dst, type). Each level is a join; depth bounds the levels.

Levels are written tables in the shared folder, so plans stay short and a lost executor costs no
level; the edges are read once per level and not built anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import task_graph
from quarry.sources.written import settled


def _directed(edges: DataFrame, direction: str) -> DataFrame:
    """(at, next, src, dst, type): the steps that edges allow out, in, or both ways."""
    kind = F.col("type") if "type" in edges.columns else F.lit(None).cast("string")
    out = edges.select(F.col("src").alias("at"), F.col("dst").alias("next"), "src", "dst", kind.alias("type"))
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("next"), "src", "dst", kind.alias("type"))
    return {"out": out, "in": back, "both": out.unionByName(back.where("src <> dst"))}[direction].distinct()


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reach(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth): least number of hops to each node within `depth`; seeds are at 0."""
    frontier = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth"))
    steps = settled(edges.select("src", "dst"), "steps")
    seen = frontier
    for level in range(1, depth + 1):
        step = frontier.join(steps, frontier["node"] == steps["src"]).select("seed", F.col("dst").alias("node")).distinct()
        frontier = settled(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(level)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def chain(seeds: DataFrame, edges: DataFrame, depth: int = 2, direction: str = "out") -> DataFrame:
    """(seed, src, dst, type, depth, path): the edges of a breadth-first walk from each seed.

    Each node is expanded once, at its least depth; of its ways there, the least path is kept.
    """
    steps = settled(_directed(edges, direction), "steps")
    frontier = seeds.select(F.col("node").alias("seed"), "node", F.array("node").alias("path"))
    seen, found = frontier.select("seed", "node"), None
    for level in range(1, depth + 1):
        taken = frontier.join(steps, frontier["node"] == steps["at"]).select("seed", "src", "dst", "type", "next", F.lit(level).alias("depth"), F.concat("path", F.array("next")).alias("path"))
        taken = settled(taken, "chain")
        found = taken if found is None else found.unionByName(taken)
        new = taken.groupBy("seed", F.col("next").alias("node")).agg(F.min("path").alias("path"))
        frontier = settled(new.join(seen, ["seed", "node"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier.select("seed", "node"))
    return found.drop("next")


def walk(seed: DataFrame, edges: DataFrame, depth: int = 3, direction: str = "both") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, depth), edges (src, dst, type) and cycles (cycle) within `depth` hops of the nodes of seed.

    A step back onto its own path closes a cycle and is not followed; each node is followed once,
    at its least depth and by its least path.
    """
    steps = settled(_directed(edges, direction), "steps")
    frontier = seed.select("node", F.array("node").alias("path"))
    nodes = frontier.select("node", F.lit(0).alias("depth"))
    kept, cycles = [], []
    for level in range(1, depth + 1):
        taken = settled(frontier.join(steps, frontier["node"] == steps["at"]).select("path", "next", "src", "dst", "type"), "walk")
        closing = F.array_contains("path", F.col("next"))
        cycles.append(taken.where(closing).select(F.concat("path", F.array("next")).alias("cycle")))
        going = taken.where(~closing)
        kept.append(going.select("src", "dst", "type"))
        new = going.groupBy(F.col("next").alias("node")).agg(F.min(F.concat("path", F.array("next"))).alias("path"))
        frontier = settled(new.join(nodes, "node", "left_anti"), "frontier")
        nodes = nodes.unionByName(frontier.select("node", F.lit(level).alias("depth")))
    return nodes, _all(kept).distinct(), _all(cycles).distinct()


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ego(seed: DataFrame, edges: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, depth) within `depth` hops either way, and the edges of the hops (each once)."""
    nodes, kept, _ = walk(seed, edges, depth)
    return nodes, kept


def shortest_path(edges: DataFrame, source: str, target: str, most: int = 5) -> DataFrame:
    """(path, types, hops): one row with the least of the shortest directed paths of at most `most` hops, or none.

    types holds the least edge type of each hop. The walk ends with the level that meets the target.
    """
    steps = settled(edges.groupBy("src", "dst").agg(F.min("type").alias("type")), "steps")
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(source, [source], [])], "node string, path array<string>, types array<string>")
    seen = frontier.select("node")
    for hops in range(most + 1):
        hit = frontier.where(F.col("node") == target)
        if not hit.isEmpty():
            return hit.orderBy("path").limit(1).select("path", "types", F.lit(hops).alias("hops"))
        if hops == most:
            break
        taken = frontier.join(steps, frontier["node"] == steps["src"]).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("types", F.array("type")).alias("types"))
        best = taken.groupBy("node").agg(F.min(F.struct("path", "types")).alias("b")).select("node", "b.path", "b.types")
        frontier = settled(best.join(seen, "node", "left_anti"), "frontier")
        seen = seen.unionByName(frontier.select("node"))
    return frontier.limit(0).select("path", "types", F.lit(0).alias("hops"))


def simple_paths(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(path, hops): all paths without a repeated node, of 1..depth hops, from the nodes of start."""
    now = start.select(F.array("node").alias("path"))
    steps, out = settled(edges.select("src", "dst").distinct(), "steps"), None
    for hops in range(1, depth + 1):
        last = F.element_at("path", -1)
        now = settled(now.join(steps, last == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")), "paths")
        part = now.withColumn("hops", F.lit(hops))
        out = part if out is None else out.unionByName(part)
    return out


def paths_between(edges: DataFrame, source: str, target: str, depth: int = 5) -> DataFrame:
    """(path, hops): all simple paths of at most `depth` hops from one node to another."""
    start = edges.sparkSession.createDataFrame([(source,)], "node string")
    return simple_paths(start, edges, depth).where(F.element_at("path", -1) == target)


def cycles(edges: DataFrame, depth: int, types: Sequence[str] | None = None) -> DataFrame:
    """(cycle, hops): simple cycles of at most `depth` hops over edges of the types, once each: they begin at their least node."""
    if types is not None:
        edges = edges.where(F.col("type").isin(*types))
    steps = settled(edges.select("src", "dst").distinct(), "steps")
    loops = steps.where("src = dst").select(F.array("src", "dst").alias("cycle"), F.lit(1).alias("hops"))
    now, out = steps.select(F.col("src").alias("node")).distinct().select(F.array("node").alias("path")), loops
    for hops in range(2, depth + 1):
        # a path never goes below its first node, so each cycle is walked once
        going = now.join(steps, F.element_at("path", -1) == F.col("src")).where((F.col("dst") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("dst")))
        now = settled(going.select(F.concat("path", F.array("dst")).alias("path")), "paths")
        closed = now.join(steps, (F.element_at("path", -1) == F.col("src")) & (F.element_at("path", 1) == F.col("dst")))
        out = out.unionByName(closed.select(F.concat("path", F.array("dst")).alias("cycle"), F.lit(hops).alias("hops")))
    return out


#: Edge types that make a dependency.
DEPENDENCIES = ("imports", "uses", "depends_on", "requires")


def adjacency(edges: DataFrame, types: Sequence[str] = DEPENDENCIES, reverse: bool = False) -> DataFrame:
    """(node, others): the sorted distinct dependencies of each node, or with reverse its dependents."""
    kept = edges.where(F.col("type").isin(*types))
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return kept.groupBy(F.col(a).alias("node")).agg(F.array_sort(F.collect_set(b)).alias("others"))


def closure(edges: DataFrame, seeds: DataFrame, most: int = 1_000_000, within: int | None = None) -> DataFrame:
    """(seed, node, depth): all that seeds reach, themselves left out unless a cycle leads back; as many levels as it takes.

    Cycles end by themselves: a pair is followed once. Fails after `most` levels; ends without failing after `within` hops, where given.
    """
    steps = settled(edges.select("src", "dst").distinct(), "steps")
    frontier = seeds.select(F.col("node").alias("seed"), "node")
    seen = None
    for level in range(1, (most if within is None else min(most, within)) + 1):
        step = frontier.join(steps, frontier["node"] == steps["src"]).select("seed", F.col("dst").alias("node")).distinct()
        new = step if seen is None else step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        new = settled(new.withColumn("depth", F.lit(level)), "closure")
        if new.isEmpty():
            return new if seen is None else seen
        seen = new if seen is None else settled(seen.unionByName(new), "closed") if level % 8 == 0 else seen.unionByName(new)
        frontier = new.select("seed", "node")
    if within is not None and within <= most and seen is not None:
        return seen
    raise ValueError(f"the closure has over {most} levels")


def peeled(edges: DataFrame) -> DataFrame:
    """(node, level) of edges (src, dst): hops of the longest chain that ends at a node; null on a cycle and after one.

    Rounds of Kahn's kind: each takes away the nodes that nothing left leads to. Their edges go too while they are a quarter
    of those that are left or more, so that a round reads what waits and not the whole graph.
    """
    links = settled(edges.select("src", "dst").distinct(), "links")
    needs = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("needs"))
    nodes = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).distinct()
    waiting, level, done = settled(nodes.join(needs, "node", "left").na.fill(0, ["needs"]), "waiting"), 0, None
    kept = waiting.count()
    while True:
        ready = waiting.where("needs = 0").select("node", F.lit(level).alias("level"))
        if ready.isEmpty():
            rest = waiting.select("node", F.lit(None).cast("int").alias("level"))
            return rest if done is None else done.unionByName(rest)
        done = ready if done is None else settled(done.unionByName(ready), "levels") if level % 16 == 15 else done.unionByName(ready)
        met = ready.join(links, ready["node"] == links["src"]).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
        waiting, level = settled(waiting.where("needs > 0").join(met, "node", "left").select("node", (F.col("needs") - F.coalesce("n", F.lit(0))).alias("needs")), "waiting"), level + 1
        left = waiting.count()
        if left * 4 <= kept * 3:
            links, kept = settled(links.join(waiting.select(F.col("node").alias("src")), "src", "left_semi"), "links"), left


def _in_tree(open_: DataFrame, edges: DataFrame, levels: DataFrame) -> DataFrame:
    """Pairs with `inside`: whether dst lies below src in a tree of one edge into each node, from a level to the next."""
    at = lambda end: levels.select(F.col("node").alias(end), F.col("level").alias(f"{end}_level"))
    up = edges.join(at("src"), "src").join(at("dst"), "dst").where("src_level + 1 = dst_level").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
    forest = settled(task_graph.tree_order(levels.where("level IS NOT NULL").select("node").join(up, "node", "left")).select("node", "place", "size"), "forest")
    span = lambda end: forest.select(F.col("node").alias(end), F.col("place").alias(f"{end}_place"), F.col("size").alias(f"{end}_size"))
    return settled(open_.join(span("src"), "src", "left").join(span("dst"), "dst", "left").withColumn("inside", F.coalesce((F.col("dst_place") >= F.col("src_place")) & (F.col("dst_place") < F.col("src_place") + F.col("src_size")), F.lit(False))), "placed")


def reachable(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, reaches): whether edges lead from src to dst, for each of the distinct pairs (src, dst); a node reaches itself.

    Pairs that are edges are known at once. Most others are decided by labels: a path leads from lower to higher levels of `peeled`, never from behind a cycle to before it,
    and a tree of one edge into each node holds what lies within the interval of src; the tree is built
    where over one pair for 16 nodes is left. Only the others are walked, all
    at once, each no further than the levels of what it still looks for.
    """
    asked = settled(pairs.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "asked")
    edges = settled(edges.select("src", "dst").distinct(), "edges")
    direct = settled(asked.where("src <> dst").join(edges, ["src", "dst"], "left_semi"), "direct")
    levels = settled(peeled(edges), "levels")
    at = lambda end: levels.select(F.col("node").alias(end), F.col("level").alias(f"{end}_level"), F.lit(True).alias(f"{end}_known"))
    known = asked.where("src <> dst").join(direct, ["src", "dst"], "left_anti").join(at("src"), "src").join(at("dst"), "dst")
    # a known level of dst means that no cycle lies before it
    open_ = settled(known.where("dst_level IS NULL OR src_level < dst_level").select("src", "dst", "src_level", "dst_level"), "open")
    found = asked.where("src = dst").select("src", "dst").unionByName(direct)
    if open_.count() * 16 > levels.count():
        placed = _in_tree(open_, edges, levels)
        found, open_ = found.unionByName(placed.where("inside").select("src", "dst")), placed.where("NOT inside")
    wanted = settled(open_.select("src", "dst", "dst_level"), "wanted")
    steps = settled(edges.select(F.col("src").alias("node"), "dst").join(levels.select(F.col("node").alias("dst"), "level"), "dst").select("node", F.col("dst").alias("next"), "level"), "steps")
    frontier, seen = wanted.select("src", F.col("src").alias("node")).distinct(), None
    while not wanted.isEmpty():
        # null: something behind a cycle is wanted, so any node may lead there
        limit = wanted.groupBy("src").agg(F.when(F.count_if(F.col("dst_level").isNull()) == 0, F.max("dst_level")).alias("limit"))
        far = frontier.join(limit, "src").join(steps, "node").where("limit IS NULL OR level <= limit").select("src", F.col("next").alias("node")).distinct()
        far = settled(far if seen is None else far.join(seen, ["src", "node"], "left_anti"), "far")
        if far.isEmpty():
            break
        seen = far if seen is None else settled(seen.unionByName(far), "seen")
        hits = settled(wanted.join(far.withColumnRenamed("node", "dst"), ["src", "dst"], "left_semi").select("src", "dst"), "hits")
        found, frontier = found.unionByName(hits), far
        wanted = settled(wanted.join(hits, ["src", "dst"], "left_anti"), "wanted")
    return asked.join(found.withColumn("reaches", F.lit(True)), ["src", "dst"], "left").select("src", "dst", F.coalesce("reaches", F.lit(False)).alias("reaches"))


def would_cycle(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(src, dst, closes): whether an edge from src to dst would close a cycle, for candidates (src, dst)."""
    back = reachable(edges, candidates.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "reaches")
    return candidates.join(back, ["src", "dst"], "left").select("src", "dst", F.coalesce("reaches", F.lit(False)).alias("closes"))


def longest_depths(edges: DataFrame) -> DataFrame:
    """(node, depth): hops of the longest chain from a root (a node without incoming edges); for graphs without cycles.

    Nodes that no root reaches have no row. A graph whose longest chain would exceed its number of
    nodes has a cycle, which is an error.
    """
    steps = settled(edges.select("src", "dst").distinct(), "steps")
    ends = steps.select(F.col("dst").alias("node")).distinct()
    total = steps.select("src").unionByName(steps.select(F.col("dst").alias("src"))).distinct().count()
    now = steps.select(F.col("src").alias("node")).distinct().join(ends, "node", "left_anti")
    found, level = None, 0
    while True:
        here = settled(now.withColumn("depth", F.lit(level)), "depths")
        if here.isEmpty():
            break
        if level >= total:
            raise ValueError("the graph has a cycle")
        found = here if found is None else found.unionByName(here)
        now = here.join(steps, here["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct()
        level += 1
    empty = steps.select(F.col("src").alias("node"), F.lit(0).alias("depth")).limit(0)
    return (empty if found is None else found).groupBy("node").agg(F.max("depth").alias("depth"))


def label_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over undirected edges, however far.

    Labels go to all neighbours and then on to the label's own label, so that long chains shorten
    by doubling, until no label changes. The edges of a hot node meet its label in a join that Spark splits where it is skewed.
    No join broadcasts: tables of labels are small as files, but whole ones would pass through the driver in each round.
    """
    both = settled(undirected(edges), "both")
    labels = settled(both.groupBy(F.col("src").alias("node")).agg(F.min(F.least("src", "dst")).alias("component")), "labels")
    while True:
        mine = labels.select(F.col("node").alias("dst"), F.col("component").alias("near"))
        offered = both.join(mine.hint("merge"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("near").alias("near"))
        # the old label hears of the better one too, so whole groups move at once
        heard = labels.join(offered.hint("merge"), "node").select("node", "component", F.least("component", "near").alias("best"))
        told = heard.groupBy(F.col("component").alias("node")).agg(F.min("best").alias("told"))
        moved = heard.join(told.hint("merge"), "node", "left").select("node", "component", F.least("best", F.coalesce("told", "best")).alias("best"))
        up = moved.select(F.col("node").alias("best"), F.col("best").alias("next"))
        new = settled(moved.join(up.hint("merge"), "best", "left").select("node", F.least("best", F.coalesce("next", "best")).alias("component"), (F.least("best", F.coalesce("next", "best")) != F.col("component")).alias("changed")), "labels")
        labels = new.select("node", "component")
        if new.where("changed").isEmpty():
            return labels


def component_count(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(components, isolated): connected components among the nodes, and how many of them are single nodes without edges."""
    labels = label_components(edges)
    alone = nodes.select("node").distinct().join(labels.select("node").hint("merge"), "node", "left_anti").agg(F.count("*").alias("isolated"))
    return labels.agg(F.count_distinct("component").alias("n")).join(F.broadcast(alone)).select((F.col("n") + F.col("isolated")).alias("components"), "isolated")


def expanded_context(seeds: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(node, depth): the seeds and what is within `depth` hops either way, each at its first depth."""
    return reach(seeds, undirected(edges), depth).groupBy("node").agg(F.min("depth").alias("depth"))


def systems(anchors: DataFrame, edges: DataFrame, depth: int = 5, least: int = 3) -> DataFrame:
    """(anchor, node, depth): regions around anchors (node, place), of at least `least` nodes.

    All regions grow one hop a level at once; a node belongs to the region that reaches it first,
    and of several to that of the anchor with the least place.
    """
    steps = settled(undirected(edges), "steps")
    owned = settled(anchors.groupBy("node").agg(F.min("place").alias("place")).select("node", "place", F.lit(0).alias("depth")), "owned")
    for level in range(1, depth + 1):
        edge = owned.where(F.col("depth") == level - 1)
        claims = edge.join(steps, edge["node"] == steps["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("place").alias("place"))
        new = claims.join(owned.select("node"), "node", "left_anti").withColumn("depth", F.lit(level))
        owned = settled(owned.unionByName(new), "owned")
    large = owned.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("place")
    names = anchors.groupBy("place").agg(F.min("node").alias("anchor"))
    return owned.join(large, "place").join(names, "place").select("anchor", "node", "depth")


def pipelines(callables: DataFrame, edges: DataFrame, depth: int = 10, least: int = 3) -> DataFrame:
    """(entry, stage, node, is_exit): what is called from each callable (node) that nothing calls, in first-seen order.

    Stages are ordered by depth and name; the last three are exits. Entries with fewer than `least` stages have no rows.
    """
    calls = edges.where("type = 'calls'").select("src", "dst")
    entries = callables.select("node").distinct().join(calls.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    seen = reach(entries, calls, depth)
    staged = seen.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("stages")).where(F.size("stages") >= least)
    return staged.select(F.col("seed").alias("entry"), F.size("stages").alias("n"), F.posexplode("stages").alias("stage", "s")).select("entry", "stage", "s.node", (F.col("stage") >= F.col("n") - 3).alias("is_exit"))


def derived_edges(owners: DataFrame, owner: str, member: str, type_: str, place: str | None = None) -> DataFrame:
    """(src, dst, type, place): an edge from each member to its owner, as systems, pipelines and patterns give them."""
    return owners.select(F.col(member).alias("src"), F.col(owner).alias("dst"), F.lit(type_).alias("type"), (F.col(place) if place else F.lit(None).cast("int")).alias("place"))


def cohesion(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(group, n, cohesion, coupling) of groups of nodes (group, node).

    Cohesion: edges within the group over n (n - 1). Coupling: edges across its border over all edges.
    """
    ends = edges.select("src", "dst")
    total = F.broadcast(edges.agg(F.count("*").alias("total")))
    a, b = members.select("group", F.col("node").alias("src")), members.select("group", F.col("node").alias("dst"))
    inside = ends.join(a, "src").join(b, ["dst", "group"]).groupBy("group").agg(F.count("*").alias("inside"))
    touching = ends.join(a, "src").groupBy("group").agg(F.count("*").alias("n")).unionByName(ends.join(b, "dst").groupBy("group").agg(F.count("*").alias("n"))).groupBy("group").agg(F.sum("n").alias("ends"))
    sizes = members.groupBy("group").agg(F.count_distinct("node").alias("n"))
    joined = sizes.join(inside, "group", "left").join(touching, "group", "left").join(total)
    within = F.coalesce("inside", F.lit(0))
    return joined.select("group", "n", F.when(F.col("n") > 1, within / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("cohesion"), F.when(F.col("total") > 0, (F.coalesce("ends", F.lit(0)) - 2 * within) / F.col("total")).otherwise(0.0).alias("coupling"))


#: Hops of a leap; roots up to which all ways are followed at once, and how many of more roots go on first.
LEAP, DIRECT, FIRST = 6, 10_000, 1_000


def _leaps(ball: DataFrame, seeds: DataFrame, leap: int) -> DataFrame:
    """As `closure` to the end, by the pairs (seed, node, depth) of all nodes that lie within `leap` hops: a round is so many levels."""
    to = ball.select(F.col("seed").alias("via"), F.col("node").alias("to"), F.col("depth").alias("hops"))
    frontier, seen, level = seeds.select(F.col("node").alias("seed"), "node"), None, 0
    while True:
        # what lies farther than a level is within a leap of some node that lies just there
        step = frontier.join(to, frontier["node"] == to["via"]).groupBy("seed", F.col("to").alias("node")).agg((F.min("hops") + level).alias("depth"))
        new = settled(step if seen is None else step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti"), "leap")
        if new.isEmpty():
            return new if seen is None else seen
        seen, level = new if seen is None else seen.unionByName(new), level + leap
        frontier = new.where(F.col("depth") == level).select("seed", "node")


def _longest_way(edges: DataFrame, roots: DataFrame, within: int | None = None, leap: int = LEAP, direct: int = DIRECT, first: int = FIRST) -> DataFrame:
    """One row (depth): the longest of the shortest ways from roots, followed to their end, or for `within` hops.

    Over `direct` roots go one leap. They meet in far fewer nodes there, whose ways are followed to their end: a root's ways
    are no longer than a leap and the longest of those from its nodes. Roots of the highest bounds go on first, then
    every other whose bound is above what was found, so none is left out that could have a longer way.
    """
    spark = edges.sparkSession
    longest = lambda found: found.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))
    if within is not None:
        return longest(closure(edges, roots, within=within))
    roots = settled(roots, "roots")
    ball = settled(closure(edges, edges.select(F.col("src").alias("node")).distinct(), within=leap), "ball")
    if roots.count() <= direct:
        return longest(_leaps(ball, roots, leap))
    begun = ball.join(roots.select(F.col("node").alias("seed")), "seed", "left_semi")
    met = settled(begun.where(F.col("depth") == leap).select("seed", "node"), "met")
    beyond = _leaps(ball, met.select("node").distinct(), leap).groupBy(F.col("seed").alias("node")).agg(F.max("depth").alias("more"))
    bounds = settled(met.join(beyond, "node", "left").groupBy("seed").agg(F.max(F.coalesce("more", F.lit(0)) + leap).alias("bound")), "bounds")
    found, above, high = longest(begun).first()["depth"], 0, 0
    for r in bounds.groupBy("bound").agg(F.count("*").alias("n")).orderBy(F.desc("bound")).collect():
        above, high = above + r["n"], r["bound"]
        if above >= first:
            break
    for some in (F.col("bound") >= high, F.col("bound") < high):
        asked = bounds.where(some & (F.col("bound") > found)).select(F.col("seed").alias("node"))
        if not asked.isEmpty():
            found = max(found, longest(_leaps(ball, asked, leap)).first()["depth"])
    return spark.createDataFrame([(found,)], "depth int")


def flow_complexity(edges: DataFrame, depth: int = 5, within: int | None = None) -> DataFrame:
    """One row (cycles, depth, branching): cycles of at most `depth` hops, the longest of the shortest ways from roots, mean edges out.

    Ways are followed to their end, or for `within` hops.
    """
    out = edges.groupBy("src").agg(F.count_distinct("dst").alias("n")).agg(F.coalesce(F.avg("n"), F.lit(0.0)).alias("branching"))
    roots = edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    deep = _longest_way(edges, roots, within)
    found = cycles(edges, depth).agg(F.count("*").alias("cycles"))
    return found.join(F.broadcast(deep)).join(F.broadcast(out)).select("cycles", "depth", "branching")


def first_of(column: Column, *order: Column) -> Column:
    """The column's value of the first row in an order, as an aggregate."""
    return F.min_by(column, F.struct(*order))
