"""Toxicity: a factorization machine over hashed terms, with a logistic output.

Terms are the words of a text and the first bytes of longer words, so that the forms of one stem meet;
each is hashed to a row. A bounded sample of labelled documents says which rows go with the label at
all; for these, linear weights and factors are learned by AdaGrad in numpy. The factors give each pair of
terms a weight of its own, the product of their vectors: what two terms mean together, as an insult
beside the mention of a group, no sum of single weights can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import scratch, text_or_empty
from quarry.llm.lang_id import held_out

BUCKETS, FACTORS = 1 << 20, 8
#: Bytes of a word's beginnings that are terms of their own.
STEMS = (4, 5, 6, 7, 8)
#: The bounds of the training sample (rows of each label) and of the model (terms), and the least G-test statistic of a term.
ROWS_PER_LABEL, TERMS, LEAST_G = 10_000, 4096, 10.0
#: Parts of a label from which the sample is drawn, each its share (rounded up).
SLICES = 50
EPOCHS, RATE, DECAY = 12, 0.2, 1e-4
#: Bytes of a text that are hashed at once.
_SLAB = 1 << 20

_TERM_OR_BLANK = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def _slabs(body: bytes) -> Iterator[bytes]:
    body, at = body.translate(_TERM_OR_BLANK), 0
    while at < len(body):
        end = body.find(b" ", at + _SLAB)
        end = len(body) if end < 0 else end
        yield body[at:end]
        at = end


def hashed_terms(body: bytes) -> Iterator[np.ndarray]:
    """Rows of the terms of a text in UTF-8, slab by slab: whole words, and their stems where they are longer."""
    for slab in _slabs(body):
        data = np.frombuffer(slab, np.uint8)
        inside = np.concatenate([[False], data != 32, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        if not len(start):
            continue
        power, inverse = _powers(len(data) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * power[: len(data)], dtype=np.uint64)])
        for size in (0, *STEMS):
            at = start if not size else start[end - start > size]
            to = end if not size else at + size
            h = (total[to] - total[at]) * inverse[at] + np.uint64(size * 0x632BE59BD9B4E019 & (1 << 64) - 1)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield ((h ^ (h >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def counted(body: bytes, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a text's terms (of those kept) and how often each occurs."""
    parts = [rows if kept is None else rows[kept[rows] >= 0] for rows in hashed_terms(body)]
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _value(counts: np.ndarray) -> np.ndarray:
    return np.log2(1 + counts).astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """place: of each row of BUCKETS its number among the kept terms, or -1; a bias, linear weights and factors of these."""

    place: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logit(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at]
        both = x @ v
        return float(self.bias + x @ self.linear[at] + 0.5 * (both @ both - (x * x) @ (v * v).sum(1)))

    def score(self, body: bytes) -> float:
        rows, counts = counted(body, self.place)
        return float(_sigmoid(self.logit(self.place[rows], _value(counts))))


def fit(kept: list[int], taught: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 13, factors: int = FACTORS) -> Model:
    """A model over the kept rows, of (label, rows, counts) of documents in a fixed order."""
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    rng = np.random.default_rng(seed)
    toxic = np.mean([y for y, _, _ in taught])
    model = Model(place, float(np.log(max(toxic, 1e-3) / max(1 - toxic, 1e-3))), np.zeros(len(kept), np.float32), rng.normal(0, 0.05, (len(kept), factors)).astype(np.float32))
    xs = [(y, place[rows[k]], _value(counts[k])) for y, rows, counts in taught for k in [place[rows] >= 0]]
    past_bias, past, past_v = 1.0, np.ones(len(kept), np.float32), np.ones((len(kept), factors), np.float32)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(xs)):
            y, at, x = xs[k]
            error = float(_sigmoid(model.logit(at, x))) - y
            past_bias += error * error
            model.bias -= RATE * error / past_bias**0.5
            if not len(at):
                continue
            g = error * x + DECAY * model.linear[at]
            past[at] += g * g
            v = model.factors[at]
            gv = error * (x[:, None] * (x @ v) - v * (x * x)[:, None]) + DECAY * v
            past_v[at] += gv * gv
            model.linear[at] -= RATE * g / np.sqrt(past[at])
            model.factors[at] = v - RATE * gv / np.sqrt(past_v[at])
    return model


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for y, place, body in zip(*(batch.column(c).to_pylist() for c in ("y", "place", "body")), strict=True):
            rows, counts = counted(body)
            yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([place], pa.int64()), pa.array([rows.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts.astype(np.int32)], pa.list_(pa.int32()))], names=["y", "place", "rows", "counts"])


def _reduced(shared):
    """Only the kept rows of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, counts = [], []
            for r, n in zip(batch.column("rows"), batch.column("counts"), strict=True):
                r, n = r.values.to_numpy(), n.values.to_numpy()
                kept = shared.value[r]
                rows.append(r[kept])
                counts.append(n[kept])
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("place"), pa.array(rows, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["y", "place", "rows", "counts"])

    return run


def sample(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL, seed: int = 13) -> DataFrame:
    """y, place, body of the documents to learn from: at most `rows_per_label` of each label
    (rounded up to a multiple of SLICES), chosen by hashes of the id.

    A document that several labels mark is toxic where one of them says so. Of rows that share an id, one is
    taken; a label without a document or without an id teaches nothing.
    """
    doc_id = F.col("doc_id").cast("long")
    place = F.xxhash64(F.lit(seed), "doc_id")
    marks = labels.where(doc_id.isNotNull() & F.col("toxic").isNotNull()).groupBy(doc_id.alias("doc_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("y"))
    # each of the slices of a label gives its share, so that no task ranks a whole label
    dealt = marks.where(~held_out()).select("*", place.alias("place"), F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).alias("slice"))
    rank = F.row_number().over(Window.partitionBy("y", "slice").orderBy("place", "doc_id"))
    picked = dealt.select("*", rank.alias("n")).where(F.col("n") <= -(-rows_per_label // SLICES)).drop("n", "slice")
    rows = docs.select(doc_id.alias("doc_id"), text_or_empty().cast("binary").alias("body")).join(F.broadcast(picked), "doc_id")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("body"), "body"))
    return rows.select("*", first.alias("n")).where(F.col("n") == 1).select("y", "place", "body")


def associated(features: DataFrame, sizes: dict[int, int], terms: int = TERMS, least_g: float = LEAST_G) -> list[int]:
    """The rows whose presence goes with the label by the G-test, the strongest first, `terms` of them at most."""
    total = sum(sizes.values())
    n = features.select("y", F.explode("rows").alias("row")).groupBy("row").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    seen = F.col("n0") + F.col("n1")
    g = F.lit(0.0)
    for y in (0, 1):
        for cell, of in ((F.col(f"n{y}"), seen), (sizes.get(y, 0) - F.col(f"n{y}"), total - seen)):
            g = g + F.when(cell > 0, cell * F.log(cell * total / (of * sizes.get(y, 0)))).otherwise(0.0)
    found = n.select("row", (g * 2).alias("g")).where(F.col("g") >= least_g).orderBy(F.desc("g"), "row").limit(terms)
    return [r["row"] for r in found.collect()]


def train(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL, terms: int = TERMS, least_g: float = LEAST_G) -> Model | None:
    """A model of the documents that labels mark; None where they mark none.

    The driver gets `terms` row numbers and, of the sample, only these: all counts of terms stay in Spark.
    """
    with scratch(docs.sparkSession) as table:
        features = table(sample(docs, labels, rows_per_label).mapInArrow(_counted, "y int, place long, rows array<int>, counts array<int>"), "toxicity-terms")
        sizes = {r["y"]: r["n"] for r in features.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if not sizes:
            return None
        kept = associated(features, sizes, terms, least_g)
        mask = np.zeros(BUCKETS, bool)
        mask[kept] = True
        shared = docs.sparkSession.sparkContext.broadcast(mask)
        found = features.mapInArrow(_reduced(shared), features.schema).toArrow().sort_by([("place", "ascending"), ("y", "ascending")])
    columns = (found.column("y").to_pylist(), found.column("rows"), found.column("counts"))
    return fit(kept, [(y, rows.values.to_numpy(), counts.values.to_numpy()) for y, rows, counts in zip(*columns, strict=True)])


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            scores = [0.0 if model is None else model.score(body) for body in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted of each row by its whole text; null and empty texts get the model's bias, all get 0 without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("body"))
    return rows.mapInArrow(_scored(shared), "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document, learned from labelled ones that aren't held out."""
    found = toxicity(docs, train(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
