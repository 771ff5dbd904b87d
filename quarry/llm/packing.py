"""Best-fit packing by the sum-of-squares rule.

Only lengths matter for packing, and sequences stay separate, so pieces are dealt to groups of
bounded size, each packed on its own: a piece goes where the squared counts of open bins per
residual gap, summed over gaps, become smallest. Pieces come longest first. The poorly filled
sequences of all groups are then opened again and packed together in fewer groups.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import common
from quarry.llm.tokenize import encoder

CAPACITY, END = 2048, 0
#: Pieces of a group at most (about), and groups that are made as soon as there are pieces for them.
GROUP_PIECES, LEAST_PIECES, USUAL_GROUPS = 60_000, 1_000, 32
#: A sequence filled less than this is opened again in the next round; so many rounds.
WELL_FILLED, ROUNDS = 0.995, 2


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each length (1..capacity), in the given order of arrival.

    count[g] is the number of open bins with gap g. Putting s into a bin of gap g changes the sum
    of squares by 2 * (count[g-s] - count[g] + 1), or by 1 - 2 * count[g] where it fills the bin;
    a new bin changes it by 2 * count[capacity-s] + 1. Ties go to the smallest gap.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, bins = np.empty(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        best_gap = -1
        if s < capacity:
            gaps = count[s:capacity]
            change = 2 * (count[: capacity - s] - gaps) + 2
            change[0] = 1 - 2 * gaps[0]
            change[gaps == 0] = np.iinfo(np.int64).max
            at = int(change.argmin())
            if gaps[at] and change[at] < 2 * count[capacity - s] + 1:
                best_gap = s + at
        if best_gap < 0:
            b, best_gap, bins = bins, capacity, bins + 1
        else:
            b = open_bins[best_gap].pop()
            count[best_gap] -= 1
        out[k] = b
        left = best_gap - s
        if left:
            open_bins[left].append(b)
            count[left] += 1
    return out


def _in_order(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bins of lengths that arrive longest first, or in a mixed order where that takes fewer bins."""
    best = None
    longest_first = np.argsort(-lengths, kind="stable")
    mixed = np.random.default_rng(len(lengths)).permutation(len(lengths))
    for order in (longest_first, mixed):
        bins = np.empty(len(lengths), np.int64)
        bins[order] = sum_of_squares(lengths[order], capacity)
        if best is None or bins.max(initial=-1) < best.max(initial=-1):
            best = bins
    return best


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = encoder(path).encoded
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            cut: list[list[tuple]] = []
            for text in encoded(coded.dictionary):
                ids = np.append(text.astype("<u4"), np.uint32(end))
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                cut.append([(k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
            rows = [(doc_id, *x) for doc_id, text in zip(batch.column(0).to_pylist(), coded.indices.to_pylist(), strict=True) for x in cut[text]]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[c.split()[0] for c in PIECE.split(", ")])

    return run


def pieces(docs: DataFrame, tokenizer: str, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most `capacity` tokens; only longer documents are cut, and their first piece is the shorter one.

    A document's tokens are its text's ids and the end id; a null text has the end id alone.
    """
    return docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text")).mapInArrow(common.released(_pieces(tokenizer, end, capacity)), PIECE)


def _packed(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "salt"], kind="stable", ignore_index=True)
        bins = _in_order(rows["length"].to_numpy(), capacity)
        order = np.argsort(bins, kind="stable")
        rows, bins = rows.iloc[order].reset_index(drop=True), bins[order]
        total = np.cumsum(rows["length"].to_numpy())
        begin = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
        base = np.repeat((total - rows["length"].to_numpy())[begin], np.diff(np.append(begin, len(bins))))
        rows["offset"] = total - rows["length"].to_numpy() - base
        rows["sequence_id"] = rows["round"] * (1 << 56) + rows["part"] * (1 << 28) + bins
        filled = np.bincount(bins, rows["length"].to_numpy())
        rows["filled"] = filled[bins].astype(np.int64)
        return rows

    return run


def _groups(count: int) -> int:
    return max(min(USUAL_GROUPS, count // LEAST_PIECES), common.row_blocks(count, GROUP_PIECES), 1)


def pack(items: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """sequence_id and offset of each item (doc_id, piece, length and others), 1 <= length <= capacity.

    Items of full length are sequences of their own. Repeated rows are packed as further items.
    """
    spark, key = items.sparkSession, F.xxhash64("doc_id", "piece", "salt")
    keys = items.columns
    salted = items.withColumn("salt", F.floor(F.rand(11) * (1 << 30)).cast("long"))
    table = common.written(salted, "pieces")
    done = table.where(F.col("length") == capacity).select(*keys, (F.lit(1 << 60) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = table.where(F.col("length") < capacity)
    schema = rest.schema
    out = [done]
    for k in range(rounds):
        count = rest.count()
        if not count:
            break
        groups = _groups(count) if k == 0 else max(common.row_blocks(count, GROUP_PIECES), _groups(count) // 8)
        dealt = rest.withColumn("part", F.pmod(key, F.lit(groups))).withColumn("round", F.lit(k).cast("long"))
        packed_schema = T.StructType([*dealt.schema, *T.StructType.fromDDL("offset long, sequence_id long, filled long")])
        packed = common.written(dealt.groupBy("part").applyInPandas(_packed(capacity), packed_schema), "packed")
        last = k == rounds - 1
        out.append((packed if last else packed.where(F.col("filled") >= WELL_FILLED * capacity)).select(*keys, "sequence_id", "offset"))
        rest = packed.where(F.col("filled") < WELL_FILLED * capacity).select(*schema.names)
    packed = out[0]
    for x in out[1:]:
        packed = packed.unionByName(x)
    return packed


def pack_documents(docs: DataFrame, tokenizer: str, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, tokenizer, end, capacity), capacity)


def sequences_needed(lengths: list[int], capacity: int = CAPACITY) -> int:
    """A lower bound of the sequences for some lengths, for tests and reports."""
    return max(-(-sum(lengths) // capacity), sum(v for k, v in Counter(lengths).items() if 2 * k > capacity))
