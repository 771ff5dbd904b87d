"""Language identification: averaged hashed subword embeddings with a linear softmax.

Byte n-grams of a text are hashed to rows of an embedding; their mean goes through a linear layer
and a softmax. SGD in numpy trains both layers on a bounded sample of labelled rows. For scoring,
the two layers are multiplied into one table of class scores per n-gram, so that a whole text
costs a gather and a sum. A held-back part of the sample sets a temperature, so that scores are
probabilities, and two bounds below which a prediction is rejected: one of the probability, and one
of the share of n-grams that training saw, as a softmax over few languages is sure of any text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import common

UNDETERMINED = "und"
SIZES, BUCKETS, DIMENSIONS = (3, 4), 1 << 16, 16
#: The bound of the training sample: so many rows of each language.
ROWS_PER_LANGUAGE = 500
#: The bound of the sample as a whole: where there are more languages than it has room for, each has fewer rows.
SAMPLE_ROWS = 128_000
#: Languages up to which the model holds a score of each for every bucket; over that, it holds the embedding.
TABLE_LANGUAGES = 16
EPOCHS, RATE = 6, 8.0
#: Share of right predictions of the held-back sample that each rejection may cost, and the slack under that quantile.
REJECTED_SHARE, SLACK = 0.001, 0.9
#: Bytes that are scored at once.
_SLAB = 1 << 20
#: Rows that are predicted at once, and characters in which a letter is looked for before the whole text is.
_ROWS, _BEGIN = 1_000, 64

_LETTER = regex.compile(r"\p{L}")
_TO_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FACTORS = np.random.default_rng(515).integers(1, 1 << 31, 8, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def features(body: bytes) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of a text, in slabs; letters are lower-cased, other ASCII parts words."""
    data = np.frombuffer(b" " + body.translate(_TO_LETTERS) + b" ", np.uint8)
    for at in range(0, len(data), _SLAB):
        part = data[at : at + _SLAB + max(SIZES) - 1].astype(np.uint32)
        for n in SIZES:
            count = min(_SLAB, len(data) - at, len(part) - n + 1)
            if count <= 0 or at + n > len(data):
                continue
            h = np.full(count, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ part[k : k + count]) * _FACTORS[k]
                h ^= h >> np.uint32(15)
            yield (h & np.uint32(BUCKETS - 1)).astype(np.int64)


@dataclass
class Model:
    """languages; scores: BUCKETS x languages (with linear: x DIMENSIONS), and whether training saw the bucket; the bounds of rejection."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0
    least_seen: float = 0.0
    #: DIMENSIONS x languages, where scores are the embedding.
    linear: np.ndarray | None = None

    def logits(self, means: np.ndarray) -> np.ndarray:
        """Scores of the languages by the mean of a text's buckets."""
        return (means if self.linear is None else means @ self.linear) + self.bias

    def predict(self, body: bytes) -> tuple[str, float, bool]:
        """The best language, its probability, and whether it is rejected."""
        total, n = np.zeros(self.scores.shape[1]), 0
        for f in features(body):
            total += self.scores[f].sum(0, dtype=np.float64)
            n += len(f)
        total /= max(n, 1)
        p = _softmax(self.logits(total[:-1]) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.least or total[-1] < self.least_seen)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _has_letter() -> Column:
    """Whether text has a letter: nearly all texts show it at their begin, and only that is decoded."""
    return F.substring("text", 1, _BEGIN).rlike(r"\p{L}") | F.col("text").rlike(r"\p{L}")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts = [], []
        for body in batch.column(1).to_pylist():
            total = np.zeros(BUCKETS, np.int64)
            for f in features(body):
                total += np.bincount(f, minlength=BUCKETS)
            ids.append(np.flatnonzero(total))
            counts.append(total[ids[-1]].astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))], names=["lang", "place", "ids", "counts"])


def train(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, seed: int = 7, languages: int | None = None) -> Model | None:
    """A model of labelled rows (doc_id, text, lang); rows without a language or letters teach nothing.

    The sample is fixed by a hash of doc_id and text: the `rows_per_language` rows of the smallest
    hashes in each language, fewer where there are so many languages that SAMPLE_ROWS would not do; with `languages`, of
    the most frequent ones alone. Over TABLE_LANGUAGES a language adds 64 bytes to the model, which each worker holds. Rows without an id, or of one id, are dealt by their texts; rows that repeat both
    share a hash and are cut by rank, and every language has a row at least. None where nothing can
    be learned.
    """
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text"), F.lit(1 << 30))
    rows = labelled.where(F.col("lang").isNotNull() & _has_letter()).select("lang", "text", place.alias("dealt"))
    per = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("dealt").alias("first")).orderBy(F.desc("n"), "lang")
    per = (per if languages is None else per.limit(languages)).collect()
    if not per:
        return None
    rows_per_language = max(1, min(rows_per_language, SAMPLE_ROWS // len(per)))
    names = sorted(r["lang"] for r in per)
    number = {name: k for k, name in enumerate(names)}
    # twice the rows that are wanted lie under the bound, so that next to none is missing, and the rest is cut
    bounds = labelled.sparkSession.createDataFrame([(r["lang"], max(r["first"], int(min(1.0, 2 * rows_per_language / r["n"]) * (1 << 30)))) for r in per], "lang string, bound long")
    order = Window.partitionBy("lang").orderBy("dealt", "text")
    dealt = rows.join(F.broadcast(bounds), "lang").where(F.col("dealt") <= F.col("bound")).select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= rows_per_language)
    sample = dealt.select("lang", F.col("text").cast("binary").alias("body"), (F.col("dealt") * (1 << 20) + F.col("rank")).alias("place")).mapInArrow(_counted, "lang string, place long, ids array<int>, counts array<float>").toArrow()
    sample = sample.sort_by([("place", "ascending"), ("lang", "ascending")])
    xs = [(number[y], ids.values.to_numpy(), counts.values.to_numpy()) for y, ids, counts in zip(sample.column("lang").to_pylist(), sample.column("ids"), sample.column("counts"), strict=True)]
    held, taught = xs[::5] if len(xs) >= 50 else xs, [x for k, x in enumerate(xs) if k % 5 or len(xs) < 50]
    rng = np.random.default_rng(seed)
    embedding = (rng.random((BUCKETS, DIMENSIONS), np.float32) - 0.5) / DIMENSIONS
    linear, bias = np.zeros((DIMENSIONS, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, step = EPOCHS * len(taught), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(taught)):
            y, ids, counts = taught[k]
            rate = RATE * (1 - step / steps)
            weight = counts / counts.sum()
            hidden = weight @ embedding[ids]
            error = _softmax(hidden @ linear + bias)
            error[y] -= 1
            back = linear @ error
            linear -= np.float32(rate * 0.1) * np.outer(hidden, error)
            bias -= np.float32(rate * 0.001) * error
            embedding[ids] -= np.float32(rate) * weight[:, None] * back
            step += 1
    seen = np.zeros((BUCKETS, 1), np.float32)
    for _, ids, _ in taught:
        seen[ids] = 1
    table = len(names) <= TABLE_LANGUAGES
    model = Model(names, np.hstack([embedding @ linear if table else embedding, seen]), bias, linear=None if table else linear)
    return _calibrated(model, held)


def _calibrated(model: Model, held: list[tuple]) -> Model:
    """Sets the temperature of least log loss and the bounds under which predictions are rejected."""
    means = np.array([(c / c.sum()) @ model.scores[ids] for _, ids, c in held], np.float64)
    logits, seen = model.logits(means[:, :-1]), means[:, -1]
    y = np.array([x[0] for x in held])

    def loss(t: float) -> float:
        return -np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()

    model.temperature = min((math.exp(x) for x in np.linspace(-4, 3, 57)), key=loss)
    p = _softmax(logits / model.temperature)
    right = p.argmax(1) == y
    if right.any():
        model.least, model.least_seen = (float(np.sort(x[right])[int(REJECTED_SHARE * right.sum())] * SLACK) for x in (p.max(1), seen))
    return model


def _predicted(shared, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[str, float, bool]]]]:
    """The rows of batches, up to _ROWS at once, and what the model says of their texts, which are column `at`."""
    common.leave()
    model: Model | None = shared.value
    for batch in batches:
        for begin in range(0, batch.num_rows, _ROWS):
            rows = batch.slice(begin, _ROWS)
            out: list[tuple[str, float, bool]] = []
            for text in rows.column(at).to_pylist():
                if model is None or text is None or not _LETTER.search(text):
                    out.append((UNDETERMINED, 0.0, True))
                    continue
                out.append(model.predict(text.encode("utf-8", "replace")))
            yield rows, out


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, out in _predicted(shared, 1, batches):
            lang, score, rejected = (pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_())))
            yield pa.RecordBatch.from_arrays([rows.column(0), lang, score, rejected], names=["doc_id", "lang_pred", "score", "rejected"])

    return common.released(run)


def _keep(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, out in _predicted(shared, at, batches):
            yield rows.filter(pa.array([not rejected for _, _, rejected in out], pa.bool_()))

    return common.released(run)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a document is held out of training: crc32 of its id as text leaves 0 by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row, by its whole text.

    lang_pred is `und` (score 0, rejected) where the text is null or has no letter, or nothing was
    learned; otherwise a learned language, rejected where its calibrated score or its share of seen
    n-grams is under the model's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that `identify` doesn't reject, with all their columns.

    Null texts and texts without a letter go; rows that repeat an id or a text are decided one by one.
    Each row goes to the worker once, with its text, and only those that stay come back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(shared, [c.lower() for c in docs.columns].index("text")), docs.schema)


def learned(docs: DataFrame) -> Model | None:
    """The model of the rows that aren't held out."""
    return train(docs.where(~held_out()).select("doc_id", "text", "lang"))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each document, learned from those not held out."""
    return identify(docs, learned(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
