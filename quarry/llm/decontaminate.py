"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item become candidates by joining on shared seeds: hashes of
`min_match` tokens in a row. For candidates, running Karp-Rabin string tiling marks the longest
common matches that don't overlap, again and again, down to `min_match` tokens. The share of an
item's tokens that tiles cover doesn't depend on the order of the passages in the document.

The benchmark is the query set: it goes to the executors in blocks of at most `block_tokens`
tokens, each against all documents, so what is broadcast is bounded at any size of the benchmark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MIN_MATCH, COVERAGE, BLOCK_TOKENS = 4, 0.6, 500_000
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_BASE, _PRIME = 1_000_003, (1 << 61) - 1
_MIX = np.random.default_rng(99).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _windows(ids: list[int], marked: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(start, hash) of each unmarked window, by running Karp-Rabin."""
    lead, h, free = pow(_BASE, size - 1, _PRIME), 0, 0
    for end, x in enumerate(ids):
        if marked[end]:
            h = free = 0
            continue
        if free == size:
            h = (h - (ids[end - size] + 1) * lead) % _PRIME
            free -= 1
        h = (h * _BASE + x + 1) % _PRIME
        free += 1
        if free == size:
            yield end - size + 1, h


def tile(pattern: list[int], text: list[int], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (start in pattern, start in text, length), the longest first; none overlap on either side."""
    tiles: list[tuple[int, int, int]] = []
    used_p, used_t = [False] * len(pattern), [False] * len(text)
    size = max(min_match, min(len(pattern), len(text)))
    while True:
        places = defaultdict(list)
        for start, h in _windows(text, used_t, size):
            places[h].append(start)
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        longest = 0
        for p, h in _windows(pattern, used_p, size):
            for t in places.get(h, ()):
                if pattern[p : p + size] != text[t : t + size]:
                    continue
                k = size
                while p + k < len(pattern) and t + k < len(text) and not used_p[p + k] and not used_t[t + k] and pattern[p + k] == text[t + k]:
                    k += 1
                found[k].append((p, t))
                longest = max(longest, k)
        if longest > 2 * size:
            size = longest
            continue
        for k in sorted(found, reverse=True):
            for p, t in found[k]:
                if not any(used_p[p : p + k]) and not any(used_t[t : t + k]):
                    used_p[p : p + k], used_t[t : t + k] = [True] * k, [True] * k
                    tiles.append((p, t, k))
        if size <= min_match:
            # a match that lost its end to a longer tile may still hold min_match free tokens
            if found and _left_over(pattern, text, used_p, used_t, min_match):
                continue
            return tiles
        size = max(min_match, size // 2)


def _left_over(pattern: list[int], text: list[int], used_p: list[bool], used_t: list[bool], size: int) -> bool:
    there = {h for _, h in _windows(text, used_t, size)}
    return any(h in there for _, h in _windows(pattern, used_p, size))


class Block:
    """A block of benchmark items: token numbers, and the sorted seeds with their items."""

    def __init__(self, items: list[tuple[int, str]], min_match: int) -> None:
        self.min_match = min_match
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        #: Items of too few tokens for a seed, by their tokens: they match equal documents alone.
        self.short: dict[tuple[str, ...], list[int]] = defaultdict(list)
        self.item_seeds: list[np.ndarray] = []
        seeds, owners = [], []
        for item_id, text in items:
            words = tokens(text)
            if len(words) < min_match:
                if words:
                    self.short[tuple(words)].append(item_id)
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            h = self.seeds(np.array(ids, np.int64))
            self.item_seeds.append(h)
            seeds.append(h)
            owners.append(np.full(len(h), len(self.items)))
            self.items.append((item_id, ids))
        all_seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(all_seeds, kind="stable")
        self.seed, self.owner = all_seeds[order], (np.concatenate(owners) if owners else np.zeros(0, np.int64))[order]

    def seeds(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - self.min_match + 1
        h = np.zeros(max(0, n), np.uint64)
        for k in range(self.min_match if n > 0 else 0):
            h = (h ^ ids[k : k + n].astype(np.uint64)) * _MIX[k % len(_MIX)]
            h ^= h >> np.uint64(29)
        return h

    def matches(self, text: str, coverage: float) -> Iterator[tuple[int, int, int, int, int, float]]:
        """(item, tokens of the item, tokens covered, tiles, longest tile, coverage) of contaminating items."""
        words = tokens(text)
        if len(words) < self.min_match:
            for item_id in self.short.get(tuple(words), ()):
                yield item_id, len(words), len(words), 1, len(words), 1.0
            return
        if not len(self.seed):
            return
        ids = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int64, len(words))
        h = self.seeds(ids)
        at = np.minimum(np.searchsorted(self.seed, h), len(self.seed) - 1)
        starts = np.flatnonzero(self.seed[at] == h)
        if not len(starts):
            return
        places: dict[int, list[int]] = defaultdict(list)
        for s in starts.tolist():
            k = int(at[s])
            while k < len(self.seed) and self.seed[k] == h[s]:
                if not places[self.owner[k]] or places[self.owner[k]][-1] != s:
                    places[self.owner[k]].append(s)
                k += 1
        for owner, found in places.items():
            item_id, pattern = self.items[owner]
            # tiles cover no more of the item than the seeds that it shares with the text
            shared = np.isin(self.item_seeds[owner], h[found])
            covers = np.convolve(shared, np.ones(self.min_match, int)) > 0
            if np.count_nonzero(covers) < coverage * len(pattern):
                continue
            # only what seeds cover can be in a tile; a gap of one token keeps runs apart
            near: list[int] = []
            last = -1
            for s in found:
                if s > last and near:
                    near.append(-2)
                near += ids[max(s, last) : s + self.min_match].tolist()
                last = s + self.min_match
            tiles = tile(pattern, near, self.min_match)
            covered = sum(k for *_, k in tiles)
            if covered >= coverage * len(pattern):
                yield item_id, len(pattern), covered, len(tiles), max((k for *_, k in tiles), default=0), covered / len(pattern)


def _blocks(benchmark: DataFrame, min_match: int, block_tokens: int) -> Iterator[Block]:
    held: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        held.append((row["item_id"], row["text"]))
        size += 1 + len(row["text"]) // 3
        if size >= block_tokens:
            yield Block(held, min_match)
            held, size = [], 0
    if held:
        yield Block(held, min_match)


HIT = "doc_id long, item_id long, item_tokens int, matched_tokens int, tiles int, longest_tile int, coverage double"


def _hits(shared, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in batches:
            rows = [(doc_id, *hit) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for hit in block.matches(text, coverage)]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[c.split()[0] for c in HIT.split(", ")])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each document and benchmark item of which tiles cover at least `coverage`.

    Null and empty texts and texts without tokens have no rows. Items and documents of fewer than
    `min_match` tokens match if all their tokens are equal. Repeated rows give repeated hits.
    """
    spark, out = docs.sparkSession, None
    for block in _blocks(benchmark, min_match, block_tokens):
        hits = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_hits(spark.sparkContext.broadcast(block), coverage), HIT)
        out = hits if out is None else out.unionByName(hits)
    return spark.createDataFrame([], HIT) if out is None else out


def _clean(shared, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in batches:
            keep = [not text or next(block.matches(text, coverage), None) is None for text in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of docs that no benchmark item contaminates; null and empty texts stay."""
    spark, out = docs.sparkSession, docs
    for block in _blocks(benchmark, min_match, block_tokens):
        out = out.mapInArrow(_clean(spark.sparkContext.broadcast(block), coverage), docs.schema)
    return out
