"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are dealt to buckets by pairs of bit blocks: with `blocks` blocks and at most
`blocks - 2` differing bits, two fingerprints agree on two whole blocks at least, so each link is
found in some bucket. A bucket is indexed by sorting its fingerprints by Gray rank and grouping
neighbours; a node holds the bits that all its members share. Two nodes are compared by the
differences of their shared bits: a pair of groups beyond the distance goes as a whole.

A bucket gives out no pairs but a spanning forest: links to the least member of each local
component. Components over all buckets are then found by star operations on written tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.components import connected_components

WORDS, DISTANCE, BLOCKS, SEED = 4, 4, 6, 42
#: Members of a node of the index.
FAN = 8
#: Fingerprints in a bucket from which it is dealt anew by pairs of blocks of its other bits.
HOT_BUCKET = 20_000
#: Rows that one index holds, and pairs of nodes that are compared at once.
INDEX_ROWS, PAIRS = 40_000, 1 << 15
#: Shingles whose bits are counted at once.
_COUNTED = 1 << 14


def fingerprint(body: bytes, words: int = WORDS, rounds: int = 1) -> list[int]:
    """Unsigned fingerprints of a text: one by XXH64, and more by mixing its values further."""
    tokens = body.lower().split()
    if not tokens:
        return [0] * rounds
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = np.array([digest(b" ".join(tokens), SEED)], np.uint64)
    else:
        joined = b" ".join(tokens)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
        ends = np.cumsum(sizes) - 1
        begins = (ends + 1 - sizes)[: len(tokens) - words + 1].tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends[words - 1 :].tolist(), strict=True)], np.uint64)
    out = []
    for k in range(rounds):
        h = hashes
        if k:
            h = (h ^ np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        out.append(majority(h))
    return out


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _COUNTED):
        part = h[at : at + _COUNTED]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, list[int]] = {}
            rows = []
            for body in batch.column(1).to_pylist():
                if body not in known:
                    known[body] = fingerprint(body, words, rounds)
                rows.append(known[body])
            signed = np.array(rows, np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(signed) + 1, rounds, dtype=np.int32)), pa.array(signed))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "prints"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS, rounds: int = 1) -> DataFrame:
    """doc_id and prints (array of `rounds` signed 64-bit fingerprints) of each row; null texts count as empty."""
    bodies = docs.select(F.col("doc_id").cast("long"), common.text_or_empty().cast("binary").alias("body"))
    return bodies.mapInArrow(_fingerprints(words, rounds), "doc_id long, prints array<long>")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in the Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Fingerprints sorted by (bucket, Gray rank), with levels of nodes above them.

    A fingerprint is one word of 64 bits or a row of them.

    Level 0 are the fingerprints. A node stands for up to FAN neighbours of one bucket: `masks` are
    the bits on which they agree, `bits` their values there. The top level has a node a bucket.
    """

    def __init__(self, bucket: np.ndarray, prints: np.ndarray) -> None:
        prints = prints.reshape(len(bucket), -1)
        self.width = 64 * prints.shape[1]
        self.order = np.lexsort((*(gray_rank(prints[:, k]) for k in range(prints.shape[1] - 1, -1, -1)), bucket))
        owner = np.unique(bucket[self.order], return_inverse=True)[1]
        self.bits, self.masks = [prints[self.order]], [np.full(prints.shape, ~np.uint64(0))]
        self.first: list[np.ndarray] = []
        while len(owner) > owner[-1] + 1:
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            inside = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
            first = np.flatnonzero(inside % FAN == 0)
            bits, masks = self.bits[-1], self.masks[-1]
            every, some = np.bitwise_and.reduceat(bits, first, 0), np.bitwise_or.reduceat(bits, first, 0)
            mask = np.bitwise_and.reduceat(masks, first, 0) & ~(every ^ some)
            self.first.append(np.append(first, len(owner)))
            self.bits.append(every & mask)
            self.masks.append(mask)
            owner = owner[first]

    def members(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.first[level - 1]
        return first[nodes], first[nodes + 1]

    def components(self, distance: int) -> np.ndarray:
        """A label for each row in the given order: the least sorted place that links within `distance` reach."""
        n = len(self.order)
        label = np.arange(n)
        low = [np.arange(n)]
        for first in self.first:
            low.append(low[-1][first[:-1]])
        spans = [np.append(x, n) for x in low]
        top = len(self.first)
        roots = np.arange(len(self.bits[top]))
        stack = [(top, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > PAIRS:
                stack += [(level, a[i : i + PAIRS], b[i : i + PAIRS]) for i in range(0, len(a), PAIRS)][::-1]
                continue
            shared = self.masks[level][a] & self.masks[level][b]
            least = np.bitwise_count((self.bits[level][a] ^ self.bits[level][b]) & shared).sum(1, dtype=np.int64)
            close = least <= distance
            a, b, shared, least = a[close], b[close], shared[close], least[close]
            if level == 0:
                label = _united(label, a, b)
                continue
            # groups of which each member is close to each: one chain of links is enough
            sure = least + self.width - np.bitwise_count(shared).sum(1, dtype=np.int64) <= distance
            if sure.any():
                ends = spans[level]
                for x, y in zip(a[sure].tolist(), b[sure].tolist(), strict=True):
                    rows = np.append(np.arange(ends[x], ends[x + 1]), np.arange(ends[y], ends[y + 1]))
                    label = _united(label, rows, np.full(len(rows), ends[x]))
                a, b = a[~sure], b[~sure]
            # groups that are wholly in one component need no comparison
            least_label = np.minimum.reduceat(label, spans[level][:-1])
            most_label = np.maximum.reduceat(label, spans[level][:-1])
            done = (least_label[a] == most_label[a]) & (least_label[b] == most_label[b]) & (least_label[a] == least_label[b])
            a, b = a[~done], b[~done]
            if not len(a):
                continue
            a0, a1 = self.members(level, a)
            b0, b1 = self.members(level, b)
            i, j = np.divmod(np.arange(FAN * FAN), FAN)
            left, right = a0[:, None] + i, b0[:, None] + j
            ok = (left < a1[:, None]) & (right < b1[:, None]) & ((left < right) | ((left == right) & (level > 1)))
            left, right = left[ok], right[ok]
            near = np.argsort(right - left, kind="stable")
            stack.append((level - 1, left[near], right[near]))
        out = np.empty(n, np.int64)
        out[self.order] = self.order[label]
        return out


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking rows a and b; a label is the least row of its component."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        hook = np.arange(len(label))
        np.minimum.at(hook, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = hook[hook]
            if np.array_equal(jumped, hook):
                break
            hook = jumped
        label = hook[label]
    return label


def _forest(distance: int):
    """Blocks of whole buckets to links (u, v): a node and the least member of its component in the bucket."""

    def links(bucket: np.ndarray, prints: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        label = GrayIndex(bucket, prints.view(np.uint64)).components(distance) if len(nodes) else np.zeros(0, np.int64)
        linked = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[label[linked]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = batch.column("print")
            if pa.types.is_list(prints.type):
                prints = prints.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            else:
                prints = prints.to_numpy(zero_copy_only=False)
            held.append((batch.column("bucket").to_numpy(zero_copy_only=False), prints, batch.column("node").to_numpy(zero_copy_only=False)))
            size += batch.num_rows
            # a bucket is put together once, when the next one begins
            if size >= INDEX_ROWS and held[0][0][0] != held[-1][0][-1]:
                whole = tuple(map(np.concatenate, zip(*held, strict=True)))
                cut = int(np.flatnonzero(whole[0] == whole[0][-1])[0])
                yield links(*(x[:cut] for x in whole))
                held = [tuple(x[cut:] for x in whole)]
                size = len(held[0][0])
        if held:
            yield links(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _block_masks(bits: int, blocks: int) -> list[int]:
    """`bits` as masks of `blocks` blocks of nearly equal size."""
    places = [k for k in range(64) if bits >> k & 1]
    cuts = [len(places) * k // blocks for k in range(blocks + 1)]
    return [sum(1 << p for p in places[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _dealt(rows: DataFrame, masks: list[int], bucket: Column) -> DataFrame:
    """Each row once for each pair of blocks, with the bucket of their bits."""
    tables = F.array(*[F.struct(F.lit(k).alias("k"), F.col("print").bitwiseAND(F.lit(_signed(a | b)).cast("long")).alias("b")) for k, (a, b) in enumerate(combinations(masks, 2))])
    return rows.withColumn("t", F.explode(tables)).withColumn("bucket", F.xxhash64(bucket, "t.k", "t.b")).withColumn("table", F.col("t.k")).drop("t")


def links(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Links (u, v) that connect all nodes (node, prints) with a print of one round within `distance` bits.

    A bucket with over `hot_bucket` prints is dealt anew by its other bits, for the same reason:
    at most `distance` of them differ, over `blocks` blocks.
    """
    if blocks < distance + 2:
        raise ValueError("two blocks have to stay without a difference: blocks >= distance + 2")
    masks = _block_masks((1 << 64) - 1, blocks)
    pairs = list(combinations(masks, 2))
    rows = nodes.select("node", F.posexplode("prints").alias("round", "print"))
    dealt = _dealt(rows, masks, F.col("round"))
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > hot_bucket)
    hot = common.written(sizes.select("bucket"), "hot_buckets")
    found = dealt
    if not hot.isEmpty():
        found = dealt.join(hot, "bucket", "left_anti")
        again = dealt.join(hot, "bucket", "left_semi")
        for k, (a, b) in enumerate(pairs):
            rest = _block_masks((1 << 64) - 1 & ~(a | b), blocks)
            found = found.unionByName(_dealt(again.where(F.col("table") == k).drop("table"), rest, F.col("bucket")))
    return found.select("bucket", "print", "node").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_forest(distance), "u long, v long")


def _groups(named: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, print and component_id of each row of (doc_id, prints, node); `linked` gives the links of all nodes."""
    nodes = common.written(named.groupBy("node").agg(F.min("prints").alias("prints"), F.min("doc_id").alias("first_doc")), "nodes")
    roots = connected_components(linked(nodes))
    grouped = nodes.join(roots, "node", "left").select("node", "first_doc", F.coalesce("root", "node").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    group = common.written(grouped.join(least, "root").select("node", "component_id"), "groups")
    return named.join(group, "node").select("doc_id", F.col("prints")[0].alias("print"), "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, blocks: int = BLOCKS, rounds: int = 1, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """doc_id, print (signed) and component_id (the smallest doc_id reachable by links) of each row.

    Equal fingerprints are one node, so copies are never expanded into pairs. Rows that repeat a
    doc_id stay rows; a null doc_id is a member that names no group unless it is alone (null then).
    With several rounds, documents link when the prints of any round are close.
    """
    prints = common.written(fingerprints(docs, words, rounds), "prints")
    node = F.col("prints")[0] if rounds == 1 else F.xxhash64("prints")
    named = prints.withColumn("node", node)
    return _groups(named, lambda nodes: links(nodes, distance, blocks, hot_bucket))


def hex_print(print_: Column | str = "print") -> Column:
    return F.lower(F.lpad(F.hex(F.col(print_) if isinstance(print_, str) else print_), 16, "0"))
