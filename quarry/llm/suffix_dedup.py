"""Substring deduplication with a column-wise multi-document Burrows-Wheeler transform.

A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same
document or another; strings are judged on the input, and overlaps count.

1. Windowed minima pick an anchor for each string of `length` bytes: the leftmost k-gram of least
   hash in it. Equal strings have equal anchors at equal places, so it is enough to compare
   strings of one anchor. The strings of one anchor occurrence form a segment, and each string of
   a document is in exactly one segment.
2. Anchors are counted, and those that occur once are left behind. Equal segments of the others
   are counted; a segment that occurs twice is repeated whole. Only distinct segments that share an
   anchor, and with another one half of the other bytes on one side of it, have to be compared.
3. Those segments, grouped by anchor in blocks of bounded size, go through the column-wise
   construction: each round inserts one symbol of every string into the block's transform and
   updates the common prefixes of neighbouring suffixes. (Symbols are 40 bytes; a segment counts as
   40 strings, from each of its first 40 bytes on, so that suffixes begin at every byte.) A suffix
   whose common prefix with a neighbour reaches `length` is a repeated string. Blocks are streams
   of rows between stages (Spark's shuffle and the tables in the shared folder are the sequential
   external files).
4. An anchor with very many distinct segments is dealt anew: its strings get narrower, longer
   keys (189 common bytes, then all 200), on which nearly all of them fall apart or become equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import common

LENGTH = 200
#: Bytes of an anchor; a power of two.
GRAM = 32
#: Positions that are hashed at once.
SLAB = 1 << 18
#: Bytes of segments that one transform holds.
BLOCK_BYTES = 60_000
#: Distinct segments of an anchor from which its strings are dealt anew, and over how many neighbouring strings.
HOT_SEGMENTS, HOT_WIDTHS = 4096, (12, 1)

_TABLE = np.random.default_rng(20_240_901).integers(1, 1 << 63, 256, dtype=np.uint64)
_MULTIPLIERS = np.random.default_rng(7_411).integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes from each position on."""
    h, step = _TABLE[data], 1
    while step < gram:
        h = h[:-step] * _MULTIPLIERS[step.bit_length() - 1] + h[step:]
        step *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The position of the leftmost least value in each window of `width` values (by the upper 40 bits)."""
    low = np.uint64((1 << 24) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    if step < width:
        rest = width - step
        v = np.minimum(v[:-rest], v[rest:])
    return (v & low).astype(np.int64)


def segments_of(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Segments of documents that lie one after another in `data` and end at `ends`.

    Returns first string, number of strings, place of the anchor and the anchor's hash, per segment.
    """
    window, out = length - GRAM + 1, []
    for at in range(0, max(0, len(data) - length + 1), SLAB):
        part = data[at : at + SLAB + length - 1]
        h = gram_hashes(part)
        place = leftmost_minima(h, window)
        start = np.arange(at, at + len(place))
        owner = np.searchsorted(ends, start, side="right")
        ok = np.flatnonzero(start + length <= ends[owner])
        if not len(ok):
            continue
        new = np.ones(len(ok), bool)
        new[1:] = (place[ok[1:]] != place[ok[:-1]]) | (ok[1:] != ok[:-1] + 1) | (owner[ok[1:]] != owner[ok[:-1]])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(ok)))
        anchor = place[ok[first]]
        out.append((start[ok[first]], count, anchor + at, h[anchor].view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    return b"".join(texts), ends - lengths, ends


OCCURRENCE = "doc_id long, doc_hash long, first int, strings int, shift int, anchor long, segment long"


def _occurrences(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            whole, begins, ends = _joined(batch.column(2).to_pylist())
            first, count, place, anchor = segments_of(np.frombuffer(whole, np.uint8), ends, length)
            if not len(first):
                continue
            owner = np.searchsorted(ends, first, side="right")
            digest = xxhash.xxh3_64_intdigest
            segment = np.fromiter((digest(whole[a:b]) for a, b in zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)), np.uint64, len(first)).view(np.int64)
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [ids.take(at), hashes.take(at), *(pa.array(x.astype(np.int32)) for x in (first - begins[owner], count, place - first)), pa.array(anchor), pa.array(segment)],
                names=["doc_id", "doc_hash", "first", "strings", "shift", "anchor", "segment"],
            )

    return run


def _symbols(segments: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts each segment, from each of its first `width` bytes on, into symbols of `width` bytes.

    Returns the rank (from 1) of the symbol at each byte of the joined segments, and per string its
    segment, first byte and number of symbols. The suffixes of all these strings begin at every
    byte, and two of them share 200 bytes just when they share 200/width symbols. Symbols are
    ranked by a 64-bit hash: any order of them will do.
    """
    data = np.frombuffer(b"".join(segments), np.uint8)
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    begins = np.cumsum(lengths) - lengths
    part = next(k for k in (8, 4, 2, 1) if width % k == 0)
    short = np.append(gram_hashes(data, part), np.zeros(part - 1, np.uint64)) if len(data) >= part else np.zeros(len(data), np.uint64)
    value = np.zeros(len(data), np.uint64)
    for k in range(0, min(width, len(data)), part):
        value[: len(data) - k] = (value[: len(data) - k] ^ short[k:]) * _MULTIPLIERS[0]
    value ^= value >> np.uint64(29)
    distinct, rank = np.unique(value, return_inverse=True)
    rank = (rank + 1).astype(np.uint16 if len(distinct) < 65_535 else np.uint32)
    segment = np.repeat(np.arange(len(segments)), width)
    phase = np.tile(np.arange(width), len(segments))
    return rank, segment, begins[segment] + phase, np.maximum(lengths[segment] - phase, 0) // width


def bwt_lcp(rank: np.ndarray, first: np.ndarray, count: np.ndarray, width: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The transform of a collection and its common prefixes up to `cap`, built one column at a time.

    String i has the symbols rank[first[i] + width * k], k < count[i]; 0 stands where a string
    begins. Empty suffixes come first, in the order of the strings. Round j inserts the suffixes of
    length j: that of string i, below the row of its suffix of length j-1, goes to the place that
    its next symbol has among all rows with that symbol.
    """
    m = len(first)

    def column(j: int, which: np.ndarray) -> np.ndarray:
        """The symbol before the suffix of length j."""
        left = count[which] > j
        return np.where(left, rank[np.where(left, first[which] + width * (count[which] - 1 - j), 0)], 0).astype(rank.dtype)

    active = np.arange(m)
    bwt, lcp, rows = column(0, active), np.zeros(m, np.uint8), np.arange(m)
    for j in range(1, int(count.max(initial=0)) + 1):
        keep = count[active] >= j
        active, rows = active[keep], rows[keep]
        n = len(bwt)
        order = np.argsort(bwt, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        by_symbol = np.argsort(place[rows])
        active, rows = active[by_symbol], rows[by_symbol]
        at, symbol = place[rows], bwt[rows]
        before, after = order[np.maximum(at - 1, 0)], order[np.minimum(at + 1, n - 1)]
        has_before = (at > 0) & (bwt[before] == symbol)
        has_after = (at < n - 1) & (bwt[after] == symbol)
        padded = np.append(lcp, np.uint8(0))
        up, down = np.zeros(len(rows), np.uint8), np.zeros(len(rows), np.uint8)
        up[has_before] = _least(padded, before[has_before] + 1, rows[has_before] + 1, cap)
        down[has_after] = _least(padded, rows[has_after] + 1, after[has_after] + 1, cap)
        rows = m + at - (n - int(np.count_nonzero(bwt)))
        old = np.ones(n + len(rows), bool)
        old[rows] = False
        grown, prefixes = np.empty(len(old), rank.dtype), np.empty(len(old), np.uint8)
        grown[old], prefixes[old] = bwt, lcp
        grown[rows], prefixes[rows] = column(j, active), up
        prefixes[rows[has_after] + 1] = down[has_after]
        bwt, lcp = grown, prefixes
    return bwt, lcp


def _least(values: np.ndarray, begin: np.ndarray, end: np.ndarray, cap: int) -> np.ndarray:
    """1 + the least value of each range, up to cap."""
    if not len(begin):
        return np.zeros(0, np.uint8)
    order = np.argsort(begin, kind="stable")
    pairs = np.stack([begin[order], end[order]], 1).ravel()
    out = np.empty(len(begin), np.uint8)
    out[order] = np.minimum.reduceat(values, pairs)[::2]
    return np.minimum(out.astype(np.int64) + 1, cap).astype(np.uint8)


def repeated_suffixes(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, which strings of `length` bytes in it occur again in the collection."""
    width = next(w for w in (40, 25, 20, 16, 10, 8, 5, 4, 3, 2, 1) if length % w == 0)
    cap = length // width
    rank, segment, first, count = _symbols(segments, width)
    bwt, lcp = bwt_lcp(rank, first, count, width, cap)
    best = np.maximum(lcp, np.append(lcp[1:], np.uint8(0))) >= cap
    order = np.argsort(bwt, kind="stable")
    place = np.empty(len(bwt), np.int64)
    place[order] = np.arange(len(bwt))
    m, zeros = len(first), len(bwt) - int(np.count_nonzero(bwt))
    found = np.zeros(len(rank), bool)
    active, rows = np.arange(m), np.arange(m)
    for j in range(1, int(count.max(initial=0)) + 1):
        keep = count[active] >= j
        active, rows = active[keep], rows[keep]
        rows = m + place[rows] - zeros
        if j >= cap:
            found[first[active] + width * (count[active] - j)] = best[rows]
    ends = np.cumsum([len(x) for x in segments])
    return [found[end - len(x) : max(end - len(x), end - length + 1)] for x, end in zip(segments, ends.tolist(), strict=True)]


def _ranges(repeated: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The bytes that repeated strings cover, as ranges."""
    at = np.flatnonzero(repeated)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + length).tolist(), strict=True))


SEGMENT = "anchor long, segment long, copies long, doc_id long, doc_hash long, first int, strings int, shift int"


def _fetch(length: int):
    """Bytes of the segments a document was asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("anchor", "segment", "copies", "doc_id", "doc_hash", "first", "strings", "shift", "body")}
            texts = batch.column("body").to_pylist()
            for text, doc_id, doc_hash, asked in zip(texts, batch.column("doc_id").to_pylist(), batch.column("doc_hash").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                for x in asked:
                    for k in ("anchor", "segment", "copies", "first", "strings", "shift"):
                        rows[k].append(x[k])
                    rows["doc_id"].append(doc_id)
                    rows["doc_hash"].append(doc_hash)
                    rows["body"].append(text[x["first"] : x["first"] + x["strings"] + length - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[k], t) for k, t in (("anchor", pa.int64()), ("segment", pa.int64()), ("copies", pa.int64()), ("doc_id", pa.int64()), ("doc_hash", pa.int64()), ("first", pa.int32()), ("strings", pa.int32()), ("shift", pa.int32()), ("body", pa.binary()))],
                names=list(rows),
            )

    return run


def _can_match(rows: list[tuple], length: int) -> list[tuple]:
    """Those of an anchor's rows that agree with another on the bytes left or right of the anchor.

    Strings that are equal hold the anchor and length - GRAM more bytes, so at least half of these
    on one side of it.
    """
    half = (length - GRAM) // 2
    seen: dict[tuple, int] = {}
    keys = []
    for r in rows:
        body, shift = r[-1], r[-2]
        left, right = body[max(shift - half, 0) : shift], body[shift + GRAM : shift + GRAM + half]
        keys.append([(side, x) for side, x in ((0, left), (1, right)) if len(x) == half])
        for k in keys[-1]:
            seen[k] = seen.get(k, 0) + 1
    return [r for r, ks in zip(rows, keys, strict=True) if any(seen[k] > 1 for k in ks)]


def _compare(length: int, block_bytes: int, anchored: bool):
    """Runs blocks of whole anchors through the transform; returns ranges of segments that occur once."""

    def answer(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) > 1:
            for r, found in zip(rows, repeated_suffixes([r[-1] for r in rows], length), strict=True):
                if r[2] == 1 and found.any():
                    yield (r[3], r[4], [{"a": r[5] + a, "b": r[5] + b} for a, b in _ranges(found, length)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
                names=["doc_id", "doc_hash", "spans"],
            )

        block: list[tuple] = []
        own: list[tuple] = []
        held = 0

        def close() -> None:
            nonlocal held
            rows = _can_match(own, length) if anchored else own
            if len(rows) > 1 and any(r[2] == 1 for r in rows):
                block.extend(rows)
                held += sum(len(r[-1]) for r in rows)
            own.clear()

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("anchor", "segment", "copies", "doc_id", "doc_hash", "first", "shift", "body")), strict=True):
                if own and row[0] != own[-1][0]:
                    close()
                    if held >= block_bytes:
                        yield pack(list(answer(block)))
                        block, held = [], 0
                if not own or row[1] != own[-1][1]:  # equal rows of a document fetch a segment again
                    own.append(row)
        close()
        yield pack(list(answer(block)))

    return run


def _narrow(length: int, width: int):
    """Deals the strings of hot anchors out by narrower groups of `width` neighbours and their common bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out: list[tuple] = []
            for anchor, _, copies, doc_id, doc_hash, first, strings, shift, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                begin = 0
                while begin < strings:
                    group = (begin - shift) // width
                    end = min(strings, (group + 1) * width + shift)
                    common_from, common_to = group * width + width - 1 + shift, group * width + length + shift
                    key = digest(body[common_from:common_to], seed=(anchor ^ group) & 0xFFFFFFFFFFFFFFFF)
                    part = body[begin : end + length - 1]
                    out.append((key - (1 << 63), digest(part) - (1 << 63), copies, doc_id, doc_hash, first + begin, end - begin, shift - begin, part))
                    begin = end
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 9, batch.schema.types, strict=True)], names=batch.schema.names)

    return run


def _covered(length: int):
    """The bytes that the strings of a segment cover, as one range."""
    return F.array(F.struct(F.col("first").alias("a"), (F.col("first") + F.col("strings") + length - 1).alias("b"))).alias("spans")


def find_repeats(docs: DataFrame, length: int = LENGTH, hot_segments: int = HOT_SEGMENTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Spans (a, b) of bytes that repeated strings cover, collected per (doc_id, doc_hash), as a written table.

    docs: doc_id and text; null texts count as empty and have no spans. Rows that repeat a doc_id
    and its text are further occurrences of the text: all of it repeats. Spans of a document may
    overlap; `remove_spans` unites them. 64 <= length <= 250.
    """
    if not 2 * GRAM <= length <= 250:
        raise ValueError("length must be from 64 to 250")
    bodies = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(common.text_or_empty()).alias("doc_hash"), common.text_or_empty().cast("binary").alias("body"))
    with common.scratch(docs.sparkSession) as written:
        occurrences = written(bodies.where(F.length("body") >= length).mapInArrow(common.released(_occurrences(length)), OCCURRENCE), "occurrences")
        # anchors that occur once are counted alone and leave their places behind
        anchors = occurrences.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("segment") != F.max("segment")).alias("several")).where("n > 1")
        anchors = written(anchors, "anchors")
        met = written(common.join_by_share(occurrences, anchors, ["anchor"], "n", occurrences.count()).drop("n"), "met")
        written.delete(occurrences, anchors)
        place = F.struct("doc_id", "doc_hash", "first", "strings", "shift")
        segments = written(met.groupBy("anchor", "segment").agg(F.count("*").alias("copies"), F.min(place).alias("at"), F.first("several").alias("several")), "segments")
        asked = segments.where("several").select("anchor", "segment", "copies", "at.*").groupBy("doc_id", "doc_hash").agg(F.collect_list(F.struct("anchor", "segment", "copies", "first", "strings", "shift")).alias("asked"))
        fetched = written(
            bodies.alias("d")
            .join(asked.alias("q"), F.col("d.doc_id").eqNullSafe(F.col("q.doc_id")) & (F.col("d.doc_hash") == F.col("q.doc_hash")))
            .select("d.doc_id", "d.doc_hash", "d.body", "q.asked")
            .mapInArrow(_fetch(length), SEGMENT + ", body binary"),
            "fetched",
        )
        repeated = segments.where("copies > 1").select("anchor", "segment", "copies")
        whole = common.join_by_share(met, repeated, ["anchor", "segment"], "copies", met.count()).select("doc_id", "doc_hash", _covered(length))
        found = [whole]
        columns = [c.split()[0] for c in SEGMENT.split(", ")] + ["body"]
        spans = "doc_id long, doc_hash long, spans array<struct<a:int,b:int>>"
        rest, anchored = fetched, True
        for width in (*HOT_WIDTHS, 0):
            sizes = rest.groupBy("anchor").agg(F.count("*").alias("distinct_segments"))
            hot = sizes.where(F.col("distinct_segments") > hot_segments).select("anchor") if width else None
            any_hot = width and not hot.isEmpty()
            cool = rest.join(sizes.where(F.col("distinct_segments") <= hot_segments).select("anchor"), "anchor") if any_hot else rest
            found.append(cool.select(*columns).repartition("anchor").sortWithinPartitions("anchor", "segment").mapInArrow(_compare(length, block_bytes, anchored), spans))
            if not any_hot:
                break
            narrow = written(rest.join(hot, "anchor", "left_semi").select(*columns).mapInArrow(_narrow(length, width), SEGMENT + ", body binary"), "narrow")
            counted = narrow.groupBy("anchor", "segment").agg(F.sum("copies").alias("copies"), F.min_by(F.struct(*columns[3:]), F.struct("doc_id", "first")).alias("at")).select("anchor", "segment", "copies", "at.*")
            counted = written(counted, "counted")
            found.append(narrow.where("copies = 1").select("anchor", "segment", "doc_id", "doc_hash", "first", "strings").join(counted.where("copies > 1").select("anchor", "segment"), ["anchor", "segment"]).select("doc_id", "doc_hash", _covered(length)))
            several = counted.groupBy("anchor").agg(F.count("*").alias("distinct_segments")).where("distinct_segments > 1").select("anchor")
            rest, anchored = counted.join(several, "anchor", "left_semi"), False
        all_spans = found[0]
        for x in found[1:]:
            all_spans = all_spans.unionByName(x)
        # a set: rows that repeat a document have the same spans
        return common.written(all_spans.groupBy("doc_id", "doc_hash").agg(F.flatten(F.collect_set("spans")).alias("spans")), "spans")


def _unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(as_text: bool):
    spans_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans_out, kept = [], [], [], []
            for text, spans in zip(batch.column("row").field("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                body = (text or "").encode()
                united = _unite([(x["a"], x["b"]) for x in spans or ()])
                parts, at = [], 0
                for a, b in united:
                    parts.append(body[at:a])
                    at = b
                parts.append(body[at:])
                left = b"".join(parts)
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                sizes.append(len(body))
                removed.append(sum(b - a for a, b in united))
                spans_out.append([{"a": a, "b": b} for a, b in united])
            names = [k for k in batch.schema.names if k != "spans"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in names), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_out, spans_type), pa.array(kept, pa.string() if as_text else pa.binary())],
                names=[*names, "n_bytes", "n_removed", "removed_spans", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, as_text: bool = False, **limits: int) -> DataFrame:
    """Every row of docs with its repeated bytes cut out.

    Adds n_bytes, n_removed, removed_spans (array of a, b in bytes of the input) and kept (binary:
    the remaining bytes; with as_text a string, without characters that a cut left in part).
    Replaces columns of docs with these names. A null text has n_bytes 0 and keeps nothing.
    Empty tables give empty results; texts shorter than `length` are kept. Rows that repeat a doc_id
    and its text, and texts with a null doc_id, are occurrences as any other.
    """
    added = ("n_bytes", "n_removed", "removed_spans", "kept")
    base = docs.drop(*added)
    others = [c for c in base.columns]
    packed = base.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64(common.text_or_empty()).alias("doc_hash"))
    spans = find_repeats(docs, length, **limits)
    joined = packed.alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.doc_hash") == F.col("s.doc_hash")), "left").select("d.row", "s.spans")
    schema = T.StructType([*joined.select("row").schema, *T.StructType.fromDDL("n_bytes long, n_removed long, removed_spans array<struct<a:int,b:int>>, kept " + ("string" if as_text else "binary"))])
    return joined.mapInArrow(common.released(_cut(as_text)), schema).select("row.*", *added)


def digests(docs: DataFrame, length: int = LENGTH, **limits: int) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and the kept bytes' SHA-256."""
    return remove_repeats(docs.select("doc_id", "text"), length, **limits).select("doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, str | None], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The contract over a few small documents, for tests."""
    seen: dict[bytes, int] = {}
    bodies = {k: (t or "").encode() for k, t in texts.items()}
    for body in bodies.values():
        for i in range(len(body) - length + 1):
            seen[body[i : i + length]] = seen.get(body[i : i + length], 0) + 1
    out = {}
    for k, body in bodies.items():
        spans = _unite([(i, i + length) for i in range(len(body) - length + 1) if seen[body[i : i + length]] > 1])
        kept = b"".join(body[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(body)], strict=True))
        out[k] = (len(body), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
    return out
