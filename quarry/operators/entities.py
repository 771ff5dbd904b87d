"""Operators over entity frames (components, tasks, notes, rules): filters, pages, views, upserts and deletes."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import entities as en
from quarry.functions import vector as vec
from quarry.operators import graph, ordered
from quarry.sources.written import settled

ANY = object()


def _holds(text: str, *columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out |= F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return out


def search_tasks(tasks: DataFrame, status=None, priority=None, type_=None, assignee=None, parent=ANY, text: str | None = None, tags: Sequence[str] | None = None, entity: str | None = None) -> DataFrame:
    """Tasks that match all that is asked; parent None asks for tasks without one; any of the tags is enough."""
    out = tasks
    for column, value in (("status", status), ("priority", priority), ("type", type_), ("assignee", assignee)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if parent is not ANY:
        out = out.where(F.col("parent_id").isNull() if parent is None else F.col("parent_id") == parent)
    if text is not None:
        out = out.where(_holds(text, "title", "description"))
    if tags is not None:
        out = out.where(en.any_tag(F.col("tags"), tags))
    return out if entity is None else out.where(en.has_link(F.col("links"), id_=entity))


def search_notes(notes: DataFrame, type_=None, parent=ANY, text: str | None = None, link: tuple[str | None, str | None] | None = None, tags: Sequence[str] | None = None) -> DataFrame:
    """Notes that match all that is asked; both parts of a link have to match in the same one."""
    out = notes if type_ is None else notes.where(F.col("type") == type_)
    if parent is not ANY:
        out = out.where(F.col("parent_id").isNull() if parent is None else F.col("parent_id") == parent)
    if text is not None:
        out = out.where(_holds(text, "title", "content"))
    if link is not None:
        out = out.where(en.has_link(F.col("links"), *link))
    return out if tags is None else out.where(en.any_tag(F.col("tags"), tags))


def search_rules(rules: DataFrame, type_=None, active: bool | None = None, ids: Sequence[str] | None = None, entity: tuple[str, str] | None = None) -> DataFrame:
    """Rules by type, whether they are active (None: all), ids, and an entity they are linked to."""
    out = rules if type_ is None else rules.where(F.col("type") == type_)
    if active is not None:
        out = out.where(F.coalesce(F.col("active"), F.lit(False)) == active)
    if ids is not None:
        out = out.where(F.col("id").isin(*ids))
    return out if entity is None else out.where(en.has_link(F.col("links"), *entity))


def for_degradation(rules: DataFrame, before: Column, least: float) -> DataFrame:
    """Active rules that were never used, last used before a time, or less effective than `least`; the longest unused first."""
    idle = F.col("last_used").isNull() | (F.col("last_used") < before) | (F.col("effectiveness") < least)
    return rules.where(F.col("active") & F.coalesce(idle, F.lit(False))).orderBy(F.col("last_used").asc_nulls_first(), "effectiveness", "id")


def page(rows: DataFrame, order: Sequence[Column | str], offset: int = 0, limit: int = 20) -> DataFrame:
    """A page with `total` and `has_more`: the total is one aggregate beside it, the page a top-k of offset + limit rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def limit_between(limit: int | None, fallback: int = 20, least: int = 1, most: int = 1000) -> int:
    """A page size: the fallback for none, else within bounds."""
    return max(least, min(most, fallback if limit is None else int(limit)))


#: Columns of each view, beside id.
VIEWS = {"ids": (), "titles": ("title",), "summary": ("title", "type", "status", "priority", "parent_id", "updated_at"), "names": ("name",), "files": ("name", "path"), "files+lines": ("name", "path", "start_line", "end_line")}


def view(rows: DataFrame, name: str = "full", fields: Sequence[str] | None = None, always: Sequence[str] = ("id",)) -> DataFrame:
    """The columns of a view, or the asked fields that there are; `always` columns come first."""
    wanted = rows.columns if fields is None and name == "full" else fields if fields is not None else VIEWS[name]
    return rows.select(*dict.fromkeys([c for c in always if c in rows.columns] + [c for c in wanted if c in rows.columns]))


def suggested_next(tasks: DataFrame, context: str | None = None, assignee: str | None = None, limit: int = 5) -> DataFrame:
    """Open tasks by priority weight, then age; with a context, those whose texts hold it."""
    out = tasks.where(~F.coalesce(F.col("status").isin("done", "cancelled", "blocked"), F.lit(False)))
    if context:
        out = out.where(_holds(context, "title", "description"))
    if assignee:
        out = out.where(F.col("assignee") == assignee)
    return out.orderBy(en.priority_weight(F.col("priority")).desc(), "created_at", "id").limit(limit)


def sibling_order(rows: DataFrame, order: Sequence[Column | str], parent: str = "parent_id") -> DataFrame:
    """Rows with `place` among the children of their parent, from 1."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(parent).orderBy(*order)))


def tree_page(rows: DataFrame, order: Sequence[Column | str], offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of roots."""
    return rows.where("parent_id IS NULL").orderBy(*order).offset(offset).limit(limit)


def subtree(rows: DataFrame, root: str) -> DataFrame:
    """A root and all below it, with the least depth; the root's is 0, also where a cycle leads back to it."""
    links = rows.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))
    seed = rows.sparkSession.createDataFrame([(root,)], "node string")
    below = graph.closure(links, seed).select(F.col("node").alias("id"), "depth")
    depths = below.unionByName(rows.sparkSession.createDataFrame([(root, 0)], "id string, depth int"))
    return rows.join(depths.groupBy("id").agg(F.min("depth").alias("depth")), "id")


def in_scope(rows: DataFrame, notes: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Rows (entity_type, id) whose notes are below one of the roots; rows of other types stay."""
    links = notes.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))
    seeds = notes.sparkSession.createDataFrame([(r,) for r in roots], "node string")
    inside = graph.closure(links, seeds).select(F.col("node").alias("id")).unionByName(seeds.select(F.col("node").alias("id"))).distinct()
    other = rows.where(~F.col("entity_type").eqNullSafe("note"))
    return other.unionByName(rows.where("entity_type = 'note'").join(inside, "id", "left_semi").select(*rows.columns))


def upserted(old: DataFrame, batch: DataFrame, keys: Sequence[str], order: str, first_in_batch: bool = True, maps: Sequence[str] = (), keep_if_empty: Sequence[str] = ()) -> DataFrame:
    """Old rows with a batch written over them, by keys.

    Of equal keys in the batch the first (or last) in `order` counts; a null order counts last (first),
    equal ones are told apart by their values. Null keys are keys like others. Columns of `maps` are
    merged, new values win; columns of `keep_if_empty` keep the old value where the new one is null or
    empty; columns that the batch lacks stay.
    """
    rank = F.struct(F.col(order).isNull() if first_in_batch else F.col(order).isNotNull(), order, F.to_json(F.struct("*")))
    best = (F.min_by if first_in_batch else F.max_by)(F.struct("*"), rank)
    new = batch.groupBy(*keys).agg(best.alias("row")).select("row.*", F.lit(True).alias("_came"))
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = old.withColumn("_was", F.lit(True)).alias("o").join(new.alias("n"), same, "full_outer")
    came = F.col("n._came").isNotNull()

    def value(c: str) -> Column:
        if c in keys:
            return F.when(F.col("o._was"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
        if c not in new.columns:
            return F.col(f"o.{c}")
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in maps:
            return en.merged_maps(o, n).alias(c)
        if c in keep_if_empty:
            return F.when(came & (F.coalesce(n, F.lit("")) != ""), n).otherwise(o).alias(c)
        return F.when(came, n).otherwise(o).alias(c)

    return both.select(*[value(c) for c in old.columns])


def deleted(components: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components and edges without those of gone (id) and without edges from or to them; nulls match nothing."""
    ids = gone.select("id").where("id IS NOT NULL").distinct()
    kept = edges
    for end in ("src", "dst", "resolved_src", "resolved_dst"):
        if end in edges.columns:
            kept = kept.join(ids.withColumnRenamed("id", end), end, "left_anti").select(*edges.columns)
    return components.join(ids, "id", "left_anti"), kept


def patched(rows: DataFrame, patches: DataFrame, key: str | Sequence[str] = "id", order: str | None = None) -> DataFrame:
    """Rows with patches (key, and for a column c its new value and `set_c`): a null under set_c clears, without it the old stays.

    Patches of one key are applied one after the other, in `order` (nulls first; without one, by their
    values), so that the last which sets a column counts. A null key patches nothing.
    """
    keys = [key] if isinstance(key, str) else list(key)
    changed = [c for c in patches.columns if f"set_{c}" in patches.columns]
    rank = F.struct(*([F.col(order)] if order else []), F.to_json(F.struct("*")))
    last = lambda c: F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(f"set_{c}"), rank)).alias(f"_{c}")
    one = patches.groupBy(*keys).agg(*(last(c) for c in changed)) if changed else patches.select(*keys).distinct()
    joined = rows.join(one, keys, "left")
    return joined.select(*[F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}")["v"]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in rows.columns])


def cleared(frame: DataFrame) -> DataFrame:
    """No rows of the same schema, to be written over an index."""
    return frame.sparkSession.createDataFrame([], frame.schema)


def merged_notes(notes: DataFrame, group: str, order: Sequence[str], separator: str = "\n\n---\n\n") -> DataFrame:
    """One note a group: contents joined in order, the union of tags (sorted), the last update."""
    texts = F.array_sort(F.collect_list(F.struct(*order, "content")))
    tags = notes.select(group, F.explode("tags").alias("tag")).groupBy(group).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    merged = notes.groupBy(group).agg(F.array_join(F.transform(texts, lambda x: x["content"]), separator).alias("content"), F.max("updated_at").alias("updated_at"))
    return merged.join(tags, group, "left")


def linked_notes(tasks: DataFrame, notes: DataFrame) -> DataFrame:
    """(task_id, note_id): links stored on either side, each pair once."""
    of_tasks = tasks.select(F.col("id").alias("task_id"), F.explode("links").alias("x")).where("x.type = 'note'").select("task_id", F.col("x.id").alias("note_id"))
    of_notes = notes.select(F.col("id").alias("note_id"), F.explode("links").alias("x")).where("x.type = 'task'").select(F.col("x.id").alias("task_id"), "note_id")
    pairs = of_tasks.unionByName(of_notes).distinct()
    return pairs.join(tasks.select(F.col("id").alias("task_id")), "task_id", "left_semi").join(notes.select(F.col("id").alias("note_id")), "note_id", "left_semi")


def recent(rows: DataFrame, group: str, order: Sequence[str], most: int = 20) -> DataFrame:
    """The last `most` rows of each group, the newest first, with `place` from 1."""
    w = Window.partitionBy(group).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def enclosing_headings(lines: DataFrame, doc: str, line: str, level: str, title: str, levels: int = 6) -> DataFrame:
    """Rows with `parent_title`: of the last heading before them of a lesser level (for plain lines, of any level)."""
    w = Window.partitionBy(doc).orderBy(line).rowsBetween(Window.unboundedPreceding, -1)
    out = lines
    for k in range(1, levels + 1):
        # the last heading of level k, forgotten where a higher one begins
        last = F.last(F.when(F.col(level) <= k, F.struct(F.col(line).alias("line"), F.col(level).alias("level"), F.col(title).alias("title"))), ignorenulls=True).over(w)
        out = out.withColumn(f"_h{k}", last)
    parent = F.lit(None).cast("string")
    for k in range(1, levels + 1):
        found = F.col(f"_h{k}")
        parent = F.when((F.coalesce(F.col(level), F.lit(levels + 1)) > k) & found.isNotNull(), found["title"]).otherwise(parent)
    return out.withColumn("parent_title", parent).drop(*[f"_h{k}" for k in range(1, levels + 1)])


def within_budget(items: DataFrame, group: str, order: Sequence[str], size: str, budget: int) -> DataFrame:
    """Items taken greedily in order while their sizes fit into the budget of their group, as `ordered.within_budget` says."""
    return ordered.within_budget(items, [group], order, size, budget)


def retained(items: DataFrame, score: str, least: float, share: float, key: str = "id") -> DataFrame:
    """Items of at least `least`, but no fewer than the best `share` of all (rounded up); null and NaN scores come last.

    Only where the threshold keeps too few, the best are found by histograms of the score.
    """
    known = F.when(~F.isnan(F.col(score).cast("double")), F.col(score))
    counts = items.agg(F.count("*").alias("n"), F.count_if(known >= least).alias("kept")).first()
    most = math.ceil(counts["n"] * share)
    return items.where(known >= least) if counts["kept"] >= most else ordered.best_rows(items, score, most, [key])


def similar(vectors: DataFrame, query: Column, limit: int = 10, least: float | None = None, strictly: bool = False, types: Sequence[str] | None = None, metadata: Mapping[str, str] | None = None, key: str = "id") -> DataFrame:
    """The nearest rows (id, type, v, metadata map) by cosine, with `score`: of the types, equal in the metadata, at (or strictly over) `least`."""
    rows = vectors if types is None else vectors.where(F.col("type").isin(*types))
    for k, v in (metadata or {}).items():
        rows = rows.where(F.col("metadata")[k] == v)
    finite = F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    scored = rows.where(finite).withColumn("score", vec.cosine(F.col("v"), query))
    if least is not None:
        scored = scored.where(F.col("score") > least if strictly else F.col("score") >= least)
    return scored.orderBy(F.desc("score"), key).limit(limit)


def similar_to(vectors: DataFrame, key_value, limit: int = 10, key: str = "id") -> DataFrame:
    """The nearest rows of the same type as a row, without itself; none where the row is missing."""
    own = vectors.where(F.col(key) == key_value).limit(1).select(F.col("v").alias("q"), F.col("type").alias("q_type"))
    rows = vectors.join(F.broadcast(own)).where((F.col("type") == F.col("q_type")) & (F.col(key) != key_value))
    return rows.withColumn("score", vec.cosine(F.col("v"), F.col("q"))).orderBy(F.desc("score"), key).limit(limit).drop("q", "q_type")


def detected_topics(queries: DataFrame, topics: DataFrame, least: float = 0.7, most: int = 5, order: str = "id", block: int = 256) -> DataFrame:
    """(id, topic, score, is_new): topics (topic, v) near each query (id, v), the best `most`, in the order of the queries.

    A query near none opens a topic of its own vector, `topic-` and its id, which the queries after it may take as
    well as those there were. Of the queries that are still without a topic the first `block` choose leaders among
    themselves: each that no earlier leader is near. All later queries meet these, and the next block is of those left.
    So each query meets each topic once, and what is broadcast is never more than a block.
    """
    rank = F.struct(*dict.fromkeys((order, "id")))
    rows = settled(queries.select("id", "v", rank.alias("_at")), "queries")
    near = lambda asked, known, when: asked.join(F.broadcast(known)).where(when).select("id", "topic", vec.cosine(F.col("v"), F.col("topic_v")).alias("score")).where(F.col("score") >= least)
    known = ordered.numbered(ordered.placed(topics.select(F.col("topic").cast("string").alias("topic"), F.col("v").alias("topic_v")), ["topic"], "topics"), [], "n")
    known = settled(known.select("topic", "topic_v", F.floor((F.col("n") - 1) / block).alias("block")), "topics")
    found = rows.select("id", F.lit("").alias("topic"), F.lit(0.0).alias("score")).limit(0)
    for k in range((known.agg(F.max("block")).first()[0] or 0) + 1):
        found = found.unionByName(settled(near(rows, known.where(F.col("block") == k), F.lit(True)), "near"))
    left, opened = settled(rows.join(found.select("id").distinct(), "id", "left_anti"), "left"), rows.select("id").limit(0)
    while True:
        first = settled(left.orderBy("_at").limit(block), "block")
        mine = first.select(F.col("id").alias("topic"), F.col("v").alias("topic_v"), F.col("_at").alias("topic_at"))
        pairs = {(r["topic"], r["id"]) for r in near(first, mine, F.col("_at") > F.col("topic_at")).collect()}  # within a block
        leaders: list = []
        for r in first.select("id").orderBy("_at").collect():
            if not any((a, r["id"]) in pairs for a in leaders):
                leaders.append(r["id"])
        if not leaders:
            break
        chosen = settled(mine.where(F.col("topic").isin(leaders)), "leaders")
        met = settled(near(rows, chosen, F.col("_at") > F.col("topic_at")), "near")
        found = found.unionByName(met.withColumn("topic", F.concat(F.lit("topic-"), F.col("topic").cast("string"))))
        opened = opened.unionByName(chosen.select(F.col("topic").alias("id")))
        left = settled(left.join(first.select("id").unionByName(met.select("id")).distinct(), "id", "left_anti"), "left")
    w = Window.partitionBy("id").orderBy(F.desc("score"), "topic")
    best = found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("id", "topic", "score", F.lit(False).alias("is_new"))
    return best.unionByName(opened.select("id", F.concat(F.lit("topic-"), F.col("id").cast("string")).alias("topic"), F.lit(1.0).alias("score"), F.lit(True).alias("is_new")))


def crosses_boundary(current: Column, query: Column, distance: float = 0.3) -> Column:
    """Whether a query leaves the current topic."""
    return 1 - vec.cosine(current, query) > distance


@dataclass(frozen=True)
class Budget:
    """Legacy search: a quarter of the limit for each kind, then cut."""

    limit: int = 20

    def each(self) -> int:
        return self.limit // 4


def split_search(frames: Mapping[str, tuple[DataFrame, str, str]], budget: Budget = Budget()) -> DataFrame:
    """(kind, id): the first rows of each kind (frame, id column, ordering SQL), together at most the limit."""
    out = None
    for kind, (frame, key, order) in frames.items():
        part = frame.orderBy(F.expr(order).desc(), key).limit(budget.each()).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out.limit(budget.limit)


def safe_json(text: Column) -> Column:
    """A JSON text as a variant; a text that isn't JSON as a string variant; empty as null."""
    given = F.nullif(text, F.lit(""))
    return F.when(given.isNotNull(), F.coalesce(F.try_parse_json(given), F.to_variant_object(F.struct(given.alias("raw")))))
