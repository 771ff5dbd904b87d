"""Source divergence audit: how far the sources of a language stray from each other and from the whole, term by term.

A count-min sketch of the terms' document frequencies is filled by every task, merged block by block
and shared; it never underestimates, so a term that it puts under the bound can't reach it and is left
out before anything of it is shuffled. All others are counted exactly, over texts that are dealt by
language and source, so that a task meets few groups and passes each of their terms on once, not once
for every group of the table. Pairs of sources then meet on the terms that both have; what only one or
none has follows from its own counts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import scratch, text_or_empty, written

LEAST, SCALE, TOP = 3, 1_000_000_000, 200
#: Rows and cells a row of the sketch: one byte a cell, so 8 MB in each worker whatever the input; the wider it is, the more it leaves out.
DEPTH, WIDTH = 4, 1 << 21
_BLOCK = 1 << 16
#: Bytes of texts that are counted together (a task takes up to seventy times as many, when all terms differ), and bytes of a longer text that are split at once.
_HELD, _SLAB = 1 << 22, 1 << 23

_TERM_OR_BLANK = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(body: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, slab by slab: runs of ASCII letters (lower-cased) and of all that isn't ASCII."""
    body, at = body.translate(_TERM_OR_BLANK), 0
    while at < len(body):
        end = body.find(b" ", at + _SLAB)
        end = len(body) if end < 0 else end
        yield body[at:end].split()
        at = end


def _cells(lang: str, found: list[bytes], depth: int, width: int) -> np.ndarray:
    """depth x terms: the cells of each term of a language."""
    seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "replace"))
    h = np.array([xxhash.xxh3_64_intdigest(t, seed) for t in found], np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((low + np.arange(depth, dtype=np.uint64)[:, None] * high) % np.uint64(width)).astype(np.int64)


class Sketch:
    """Document frequencies up to a cap, in depth x width cells; never too small."""

    def __init__(self, depth: int = DEPTH, width: int = WIDTH, cap: int = LEAST) -> None:
        if width % _BLOCK:
            raise ValueError(f"width has to be a multiple of {_BLOCK}")
        self.cap = min(cap, 255)
        self.cells = np.zeros((depth, width), np.uint8)

    def add(self, lang: str, counts: dict[bytes, int]) -> None:
        at = _cells(lang, list(counts), *self.cells.shape)
        n = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), self.cap)
        for row, cell in zip(self.cells, at, strict=True):
            order = np.argsort(cell)
            cell = cell[order]
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            cell = cell[first]
            row[cell] = np.minimum(row[cell] + np.add.reduceat(n[order], first), self.cap)

    def possible(self, lang: str, found: list[bytes]) -> np.ndarray:
        """Whether each term may reach the cap."""
        at = _cells(lang, found, *self.cells.shape)
        return np.all([row[cell] >= self.cap for row, cell in zip(self.cells, at, strict=True)], axis=0)


class Tally(NamedTuple):
    """For each group of texts and each term it has: places of both, texts that hold it and its occurrences."""

    groups: list[tuple]
    terms: pa.Array
    group: np.ndarray
    term: np.ndarray
    docs: np.ndarray
    n: np.ndarray | None

    def of_group(self, first: int, end: int) -> slice:
        """The rows of the groups from first to end, which stand together."""
        return slice(*np.searchsorted(self.group, (first, end)))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys (none is negative) in order, and how often each stands; sorts keys in place."""
    keys.sort()
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return keys[first], np.diff(first, append=len(keys))


def _tally(held: list[tuple[tuple, bytes]], occurrences: bool) -> Tally:
    """The Tally of some whole texts with their groups; groups are sorted."""
    groups = sorted({group for group, _ in held})
    place = {group: k for k, group in enumerate(groups)}
    of = np.array([place[group] for group, _ in held])
    split = pc.ascii_split_whitespace(pa.array([body.translate(_TERM_OR_BLANK) for _, body in held], pa.binary()).view(pa.string()))
    text, found = pc.list_parent_indices(split).to_numpy(), split.flatten().dictionary_encode()
    del split
    code, kinds = found.indices.to_numpy(), max(1, len(found.dictionary))
    empty = pc.index(found.dictionary, "").as_py()  # before a blank at the begin, after one at the end
    if empty >= 0:
        real = code != empty
        code, text = code[real], text[real]
    once, _ = _counted(text * kinds + code)
    key, docs = _counted(of[once // kinds] * kinds + once % kinds)
    n = _counted(of[text] * kinds + code)[1] if occurrences else None
    return Tally(groups, found.dictionary, key // kinds, key % kinds, docs, n)


def _tally_long(group: tuple, body: bytes) -> Tally:
    """The Tally of a text that is too long to be split at once."""
    n = Counter()
    for some in terms(body):
        n.update(some)
    size = len(n)
    return Tally([group], pa.array(list(n), pa.binary()).view(pa.string()), np.zeros(size, np.int64), np.arange(size), np.ones(size, np.int64), np.fromiter(n.values(), np.int64, size))


def tallies(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], occurrences: bool = True) -> Iterator[Tally]:
    """Tallies of `body` by the values of columns, each of some whole texts; n only with occurrences."""
    held, size = [], 0
    for batch in batches:
        for *group, body in zip(*(batch.column(c).to_pylist() for c in (*columns, "body")), strict=True):
            if len(body) > _HELD:
                yield _tally_long(tuple(group), body)
                continue
            if held and size + len(body) > _HELD:
                yield _tally(held, occurrences)
                held, size = [], 0
            held.append((tuple(group), body))
            size += len(body)
    if held:
        yield _tally(held, occurrences)


def _bytes(found: pa.Array) -> list[bytes]:
    return found.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def _sketched(depth: int, width: int, cap: int):
    """Each task's sketch, in blocks of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(depth, width, cap)
        for t in tallies(batches, ("lang",), occurrences=False):
            for k, (lang,) in enumerate(t.groups):
                rows = t.of_group(k, k + 1)
                if rows.start < rows.stop:
                    sketch.add(lang, dict(zip(_bytes(t.terms.take(pa.array(t.term[rows]))), t.docs[rows].tolist(), strict=True)))
        for k, block in enumerate(sketch.cells.reshape(-1, _BLOCK)):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["block", "cells"])

    return run


def _merged(cap: int):
    """The sum of the blocks of one number, up to the cap; a task holds the blocks dealt to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                new = np.frombuffer(cells, np.uint8)
                total[k] = np.minimum(total[k].astype(np.uint16) + new, cap).astype(np.uint8) if k in total else new
        for k, cells in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["block", "cells"])

    return run


def frequency_sketch(rows: DataFrame, least: int = LEAST, depth: int = DEPTH, width: int = WIDTH) -> Sketch:
    """The merged sketch of (lang, body): for each term and language in how many rows it may be, up to `least`."""
    sketch = Sketch(depth, width, least)
    blocks = rows.select("lang", "body").mapInArrow(_sketched(depth, width, sketch.cap), "block int, cells binary")
    merged = blocks.repartition(max(1, min(64, depth * width // _BLOCK)), "block").mapInArrow(_merged(sketch.cap), "block int, cells binary").toArrow()
    flat = sketch.cells.reshape(-1, _BLOCK)
    for k, cells in zip(merged.column("block").to_pylist(), merged.column("cells"), strict=True):
        flat[k] = np.frombuffer(cells.as_buffer(), np.uint8)
    return sketch


def _survivors(shared):
    """lang, source, term, n, docs of each task: counts of the terms that the sketch leaves possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tallies(batches, ("lang", "source")):
            kept, first = np.zeros(len(t.term), bool), 0
            while first < len(t.groups):
                lang = t.groups[first][0]
                end = bisect_right(t.groups, lang, first, key=lambda group: group[0])
                rows = t.of_group(first, end)
                if rows.start < rows.stop:
                    mine, at = np.unique(t.term[rows], return_inverse=True)
                    kept[rows] = shared.value.possible(lang, _bytes(t.terms.take(pa.array(mine))))[at]
                first = end
            if kept.any():
                group = pa.array(t.group[kept])
                named = [pa.array([g[k] for g in t.groups], pa.string()).take(group) for k in (0, 1)]
                columns = [*named, t.terms.take(pa.array(t.term[kept])), pa.array(t.n[kept]), pa.array(t.docs[kept])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    return run


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(plain("lang").alias("lang"), plain("source").alias("source"), text_or_empty().cast("binary").alias("body"), *more)


def _dealt(docs: DataFrame) -> DataFrame:
    """The rows in ranges of lang and source; a large group lies in several ranges, by doc_id (where there is one) and text."""
    place = F.xxhash64(*(c for c in ("doc_id", "text") if c in docs.columns))
    return _rows(docs, place.alias("place")).repartitionByRange("lang", "source", "place").drop("place")


def kept_counts(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, width: int = WIDTH, table=None) -> DataFrame:
    """lang, source, term, n, total: how often a source has each kept term that it has, and its language.

    Kept are the terms in at least `least` documents (rows) of their language. depth and width set only how
    much is left out before the shuffle. table writes the exact counts, which are read twice.
    """
    rows = _rows(docs)
    shared = docs.sparkSession.sparkContext.broadcast(frequency_sketch(rows, least, depth, width))
    found = _dealt(docs).mapInArrow(_survivors(shared), "lang string, source string, term string, n long, docs long")
    counts = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = table(counts, "source-terms") if table else counts
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    return counts.drop("docs").join(kept.drop("docs"), ["lang", "term"])


def _probability(n: Column | str, size: Column | str) -> Column:
    """1 + floor(10^9 (n + 1) / size), exact: the product is a decimal."""
    n, size = (F.col(x) if isinstance(x, str) else x for x in (n, size))
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)"), size.cast("decimal(19,0)")) + 1


def _distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / q)"""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: each other source of the language as item, by the summed distance of all kept terms, 0
    without kept terms. Part `term`: the `top` terms that the source has more often than its language.
    Null text, lang and source are empty strings; rows that repeat count as often as they stand. The
    result is a written table.
    """
    pair_key = ["lang", "source", "item"]
    with scratch(docs.sparkSession) as table:
        counts = table(kept_counts(docs, least, depth, width, table), "kept-terms")
        of_lang = counts.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
        of_source = counts.groupBy("lang", "source").agg(F.sum("n").alias("source_n"), F.count("*").alias("has"))
        groups = _rows(docs).select("lang", "source").distinct().join(of_lang, "lang", "left").join(of_source, ["lang", "source"], "left").na.fill(0)
        sized = groups.select("lang", "source", "terms", "has", "lang_n", (F.col("source_n") + F.col("terms")).alias("size"))
        sized = table(sized.withColumn("zero", F.when(F.col("terms") > 0, _probability(F.lit(0), "size"))), "groups")
        own = counts.join(sized, ["lang", "source"])
        own = table(own.select("lang", "source", "term", "zero", _probability("n", "size").alias("p"), _probability("total", F.col("lang_n") + F.col("terms")).alias("q")), "probabilities")

        other = sized.select("lang", F.col("source").alias("item"), F.col("has").alias("item_has"), F.col("zero").alias("item_zero"))
        pairs = sized.join(other, "lang").where(F.col("source") != F.col("item"))
        levels = own.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
        alone = pairs.join(levels, ["lang", "source"]).groupBy(*pair_key).agg(F.sum(F.col("m") * _distance("p", "item_zero")).alias("left"), F.sum(F.col("m") * _distance("item_zero", "p")).alias("back"))
        mine, theirs = own.drop("q"), own.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("item_p"), F.col("zero").alias("item_zero"))
        both = mine.join(theirs, ["lang", "term"]).where(F.col("source") != F.col("item"))
        gain = _distance("p", "item_p") - _distance("p", "item_zero") - _distance("zero", "item_p") + _distance("zero", "item_zero")
        shared = both.groupBy(*pair_key).agg(F.sum(gain).alias("both"))
        swapped = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("right"))
        joined = pairs.join(alone.drop("back"), pair_key, "left").join(swapped, pair_key, "left").join(shared, pair_key, "left")
        none = (F.col("terms") - F.col("has") - F.col("item_has")) * _distance("zero", "item_zero")
        value = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("left", "right", "both")), F.coalesce(none, F.lit(0)))
        pair = joined.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))

        more = own.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance("p", "q").alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
        best = more.select("*", rank).where(F.col("rank") <= top)
        return written(pair.select("*", rank).unionByName(best), "divergence")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.total, coalesce(x.n, 0) AS n
      FROM g JOIN k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + CAST(1000000000 AS HUGEINT) * (c.n + 1) // (s.n + v.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (c.total + 1) // (v.n + v.v) AS q
      FROM c JOIN s ON s.lang = c.lang AND s.source = c.source JOIN v ON v.lang = c.lang),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
