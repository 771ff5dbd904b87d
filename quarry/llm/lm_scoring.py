"""LM scoring with a hashed maximum-entropy model and a class-factored softmax.

log P(word | history) = log P(class | history) + the sum of log P(digit | class, digits before it,
history) + log P(word | leaf). A word's class is the number of base-16 digits that its share of the
training tokens needs, so a class of t has at most 16**t words. Its digits, at most DEPTH of them,
come from the hash of its ending and then of the word; they lead to a leaf, which is mostly one
word in the classes up to DEPTH. Words that share a leaf are told apart by their counts. Each
factor is a softmax of 16 outcomes whose logits are the log counts of the outcomes and one row of a
hashed weight table for each of three features: the word before (bigram), the one before that
(skip), and the endings of both (trigram).

1. Tasks reduce their documents to blocks in the shared folder: a dictionary of word hashes, and
   token numbers. Only dictionaries are shuffled, never tokens.
2. Each word's training count is summed over the dictionaries and put beside each block.
3. Training tasks run sparse mini-batch updates over their blocks, one drawn factor a token. Each
   row of the table is then averaged by its own updates. `rounds` rounds share the tokens out and
   begin with the average of the round before.
4. All blocks are scored in sparse numpy batches with the averaged table.

The table has about 2,048 rows for each cube root of a training token, so it grows with the corpus
(64 MB at 120 million tokens, 256 MB at 7 billion); a worker holds it whole. A training task has so
many tokens that what tasks send grows with the tokens alone. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import common

SMOOTHING = 0.1
#: Digits of a word at most, and outcomes of a factor.
DEPTH, WAYS = 3, 16
#: Classes; class 0 are words that training doesn't know.
CLASSES = WAYS
#: Tokens of an update and its rate; rounds of training.
BATCH, RATE, ROUNDS = 8192, 0.2, 2
_PLACE = BATCH.bit_length()
#: Tokens of a training task for each row of the weight table, about.
TASK_TOKENS = 12
#: Bytes of text in a block, and rows of the weight table that are averaged together.
BLOCK_BYTES, SLICE = 12 << 20, 4096
#: Tokens whose features are held at once.
WINDOW = 1 << 17
#: The end of a text; no word holds white space.
END = b"\n"
_ONES = np.ones(WAYS, np.float32)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
#: Nodes of a class before those of its next depth: the sum of 16**k.
_BEFORE = [(WAYS**d - 1) // (WAYS - 1) for d in range(DEPTH + 1)]
#: Nodes and leaves of a class.
_NODES, _LEAVES = _BEFORE[DEPTH], WAYS**DEPTH


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 0 by 10."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


_SIZES = struct.Struct("<QQQ")


def word_hashes(words: list[bytes], endings: np.ndarray) -> np.ndarray:
    """64 bits that know a word: 8 of its ending's hash, then 56 of its own."""
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    ending = endings.astype(np.uint64) * _MIX[0] >> np.uint64(56)
    return ending << np.uint64(56) | own >> np.uint64(8)


_END_ENDING = np.full(1, int.from_bytes(END, "big"), np.uint64)
_END_WORD = word_hashes([END], _END_ENDING)


def _write_block(files, path: str, docs: np.ndarray, words: np.ndarray, endings: np.ndarray, tokens: np.ndarray) -> None:
    raw = _SIZES.pack(len(docs), len(words), len(tokens)) + docs.tobytes() + words.tobytes() + endings.tobytes() + tokens.tobytes()
    common.write_file(files, path, zstandard.ZstdCompressor(level=1).compress(raw))


#: id, whether it is null, whether the document is held out, tokens.
_DOC = np.dtype([("id", "<i8"), ("null", "?"), ("held", "?"), ("size", "<i8")])


class Block:
    """Documents, words and their endings, token numbers, and the words' training counts."""

    def __init__(self, files, path: str) -> None:
        raw = zstandard.ZstdDecompressor().decompress(common.read_file(files, path))
        docs, words, tokens = _SIZES.unpack_from(raw)
        at = _SIZES.size
        self.docs = np.frombuffer(raw, _DOC, docs, at)
        self.words = np.frombuffer(raw, np.uint64, words, at + docs * _DOC.itemsize)
        self.endings = np.frombuffer(raw, np.uint32, words, at + docs * _DOC.itemsize + words * 8)
        self.tokens = np.frombuffer(raw, np.uint32, tokens, at + docs * _DOC.itemsize + words * 12)
        self.ends = np.cumsum(self.docs["size"])
        self.counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(common.read_file(files, path + ".counts")), np.int64)
        self._factors: tuple[np.ndarray, np.ndarray] | None = None

    def factors(self, total: int) -> tuple[np.ndarray, np.ndarray]:
        """Class and code of each word of the dictionary."""
        if self._factors is None:
            self._factors = classes_of(self.counts, total), codes_of(self.words)
        return self._factors


ENTRY = "block long, word long, n long"


def _blocks(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        files, at = common.file_system(folder)
        files.create_dir(at, recursive=True)

        def block(docs: list[tuple]) -> pa.RecordBatch:
            known: dict[bytes, int] = {END: 0}
            parts = []
            for *_, body in docs:
                words = body.lower().split()
                words.append(END)
                parts.append(np.fromiter([known.setdefault(w, len(known)) for w in words], np.uint32, len(words)))
            counts = np.zeros(len(known), np.int64)
            tokens = np.concatenate(parts)
            taught = [p for (_, held, _), p in zip(docs, parts, strict=True) if not held]
            if taught:
                counts += np.bincount(np.concatenate(taught), minlength=len(known))
            endings = np.fromiter((int.from_bytes(w[-3:], "big") for w in known), np.uint32, len(known))
            hashes = word_hashes(list(known), endings)
            order = np.argsort(hashes.view(np.int64))  # a dictionary's words come in order of their hashes
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            hashes, endings = hashes[order], endings[order]
            heads = np.array([(d or 0, d is None, held, len(p)) for (d, held, _), p in zip(docs, parts, strict=True)], _DOC)
            own = part << 24 | number
            _write_block(files, f"{at}/{own}", heads, hashes, endings, place[tokens])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(order), own)), pa.array(hashes.view(np.int64)), pa.array(counts[order])], names=["block", "word", "n"])

        docs, size = [], 0
        for batch in batches:
            for doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs.append(doc)
                size += len(doc[2])
                if size >= BLOCK_BYTES:
                    yield block(docs)
                    docs, size, number = [], 0, number + 1
        if docs:
            yield block(docs)

    return run


def classes_of(counts: np.ndarray, total: int) -> np.ndarray:
    """Class of each training count: the least t >= 1 with count * 16**t >= total; 0 for none."""
    with np.errstate(divide="ignore"):
        t = np.ceil(np.log2(max(total, 1) / np.maximum(counts, 1)) / 4 - 1e-9)
    return np.where(counts > 0, np.clip(t, 1, CLASSES - 1), 0).astype(np.int64)


def codes_of(words: np.ndarray) -> np.ndarray:
    """The digits of each word as one number of DEPTH digits."""
    return (words >> np.uint64(64 - 4 * DEPTH)).astype(np.int64)


def _leaf(kind: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The leaf of each word, as a number over all classes."""
    short = 4 * (DEPTH - np.minimum(kind, DEPTH))
    return kind * _LEAVES + (code >> short << short)


LEAF = "leaf int, n long, words long"


def _counted(folder: str, total: int):
    """Puts the words' counts beside their block; returns the leaves' counts of words that have this as their first block.

    A count is negative in a block that isn't the word's first.
    """

    def run(entries: pa.Table) -> pa.Table:
        files, at = common.file_system(folder)
        own = entries.column("block")[0].as_py()
        word, signed = entries.column("word").to_numpy(), entries.column("total").to_numpy()
        order = np.argsort(word)
        common.write_file(files, f"{at}/{own}.counts", zstandard.ZstdCompressor(level=1).compress(np.abs(signed[order]).tobytes()))
        first = signed > 0
        counts = signed[first]
        leaves, which = np.unique(_leaf(classes_of(counts, total), codes_of(word[first].view(np.uint64))), return_inverse=True)
        return pa.table([pa.array(leaves.astype(np.int32)), pa.array(np.bincount(which, counts, len(leaves)).astype(np.int64)), pa.array(np.bincount(which, minlength=len(leaves)).astype(np.int64))], names=["leaf", "n", "words"])

    return run


class Prior:
    """Log shares of the outcomes of each node, and the leaves' counts."""

    def __init__(self, leaf: np.ndarray, n: np.ndarray) -> None:
        self.leaves = np.zeros((CLASSES, _LEAVES))
        self.leaves.reshape(-1)[leaf] = n
        kinds = self.leaves.sum(1)
        kinds[0] = SMOOTHING
        parts = [kinds[None]]
        for kind in range(CLASSES):
            for depth in range(DEPTH):
                parts.append(self.leaves[kind].reshape(WAYS**depth, WAYS, -1).sum(2))
        n = np.concatenate(parts)
        n = (n + 1e-9) / (n + 1e-9).sum(1, keepdims=True)
        self.log = np.log(n).astype(np.float32)


def _factors(kind: np.ndarray, code: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The node and the outcome of factor `level` of each token; factor 0 is the class."""
    depth = np.maximum(level - 1, 0)
    node = 1 + kind * _NODES + np.take(_BEFORE, depth) + (code >> 4 * (DEPTH - depth))
    outcome = code >> 4 * (DEPTH - 1 - depth) & WAYS - 1
    whole = level == 0
    return np.where(whole, 0, node), np.where(whole, kind, outcome)


class Tokens:
    """Tokens begin..end of a block, with what their factors and features need."""

    def __init__(self, block: Block, total: int, begin: int = 0, end: int | None = None) -> None:
        ids = block.tokens[max(begin - 2, 0) : end]
        lead = begin - max(begin - 2, 0)
        kinds, codes = block.factors(total)
        self.kind, self.code = kinds.take(ids[lead:]), codes.take(ids[lead:])
        begins = block.ends - block.docs["size"]
        begins = begins[np.searchsorted(begins, begin) : np.searchsorted(begins, begin + len(ids) - lead)] - begin
        found = []
        for x, outside in ((block.words, _END_WORD), (block.endings.astype(np.uint64), _END_ENDING)):
            # an end token stands before each text, twice
            x = np.concatenate((np.full(2 - lead, outside, np.uint64), x.take(ids))) * _MIX[0]
            before = x[:-2].copy()
            before[begins] = outside * _MIX[0]
            found += [x[1:-1], before]
        word, skipped, ending, second = found
        self.features = [_mixed(f) for f in (word, skipped + _MIX[3], ending * _MIX[3] ^ second)]

    def rows(self, at: np.ndarray, node: np.ndarray, bits: int) -> list[np.ndarray]:
        """The rows of the weight table for each feature of these tokens at these nodes."""
        salt, shift = node.astype(np.uint64) * _MIX[1], np.uint64(64 - bits)
        return [(((f.take(at) ^ salt) * _MIX[2]) >> shift).view(np.int64) for f in self.features]


def _mixed(x: np.ndarray) -> np.ndarray:
    return x ^ x >> np.uint64(32)


def _logits(weights: np.ndarray, prior: np.ndarray, node: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """The logits of each factor's outcomes; they begin at log probabilities, so their exponentials are finite."""
    x = prior.take(node, 0)
    for r in rows:
        x += weights.take(r, 0)
    return x


def log_probabilities(weights: np.ndarray, prior: np.ndarray, node: np.ndarray, rows: list[np.ndarray], outcome: np.ndarray) -> np.ndarray:
    """The log probability of each factor's outcome."""
    x = _logits(weights, prior, node, rows)
    return x[np.arange(len(outcome)), outcome] - np.log(np.exp(x) @ _ONES)


def update(weights: np.ndarray, scale: np.ndarray, times: np.ndarray, prior: np.ndarray, node: np.ndarray, rows: list[np.ndarray], outcome: np.ndarray) -> None:
    """One mini-batch of sparse gradient updates; scale holds each row's squared gradients, times its tokens so far."""
    error = np.exp(_logits(weights, prior, node, rows))
    error /= (error @ _ONES)[:, None]
    place = np.arange(len(outcome))
    error[place, outcome] -= 1
    for r in rows:
        ordered = np.sort(r << _PLACE | place)
        order, which = ordered & (1 << _PLACE) - 1, ordered >> _PLACE
        first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        gradient = np.add.reduceat(error.take(order, 0), first)
        which = which.take(first)
        scale[which] += (gradient * gradient) @ _ONES / WAYS
        times[which] += np.diff(np.append(first, len(r)))
        gradient *= (np.float32(-RATE) / np.sqrt(scale.take(which) + np.float32(1.0)))[:, None]
        weights[which] = weights.take(which, 0) + gradient


SLICES = "slice int, times binary, rows binary"


def _train(folder: str, total: int, bits: int, shared_prior, shared_weights, round_: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = common.file_system(folder)
        prior = shared_prior.value.log
        weights = np.zeros((1 << bits, WAYS), np.float32) if shared_weights is None else shared_weights.value.astype(np.float32)
        scale, times = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.int32)
        for batch in batches:
            for own in batch.column("block").to_pylist():
                block = Block(files, f"{at}/{own}")
                tokens = Tokens(block, total)
                held = np.repeat(block.docs["held"], block.docs["size"])
                draw = np.random.default_rng([own, round_])
                for begin in range(0, len(held), WINDOW):
                    tokens = Tokens(block, total, begin, begin + WINDOW)
                    taught = np.flatnonzero(~held[begin : begin + WINDOW])[round_::rounds]
                    for at_ in range(0, len(taught), BATCH):
                        some = taught[at_ : at_ + BATCH]
                        kind = tokens.kind.take(some)
                        level = (draw.random(len(some), np.float32) * (1 + np.minimum(kind, DEPTH))).astype(np.int64)
                        node, outcome = _factors(kind, tokens.code.take(some), level)
                        update(weights, scale, times, prior, node, tokens.rows(some, node, bits), outcome)
        for k, at in enumerate(range(0, 1 << bits, SLICE)):
            part = times[at : at + SLICE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([weights[at : at + SLICE].astype(np.float16).tobytes()], pa.binary())], names=["slice", "times", "rows"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of each row by its updates, for slices that come one after another."""

    def out(k: int, times: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        mean = (total / np.maximum(times, 1)[:, None]).astype(np.float16)
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([times.tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary())], names=["slice", "times", "rows"])

    at, times, total = None, None, None
    for batch in batches:
        for k, t, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            t = np.frombuffer(t, np.int32).astype(np.int64)
            part = np.frombuffer(rows, np.float16).reshape(-1, WAYS).astype(np.float64) * t[:, None]
            if k == at:
                times, total = times + t, total + part
            else:
                if at is not None:
                    yield out(at, times, total)
                at, times, total = k, t, part
    if at is not None:
        yield out(at, times, total)


class Model:
    """The counted corpus in its folder, the prior and the weight table."""

    def __init__(self, folder: str, blocks: DataFrame, total: int, distinct: int, prior: Prior, weights: np.ndarray) -> None:
        self.folder, self.blocks, self.total, self.distinct, self.prior, self.weights = folder, blocks, total, distinct, prior, weights


def table_bits(total: int) -> int:
    """Log2 of the rows of the weight table for so many training tokens."""
    return 11 + round(np.log2(max(total, 1)) / 3)


def dealt(blocks: DataFrame, tasks: int) -> DataFrame:
    """The blocks of a manifest in so many partitions, as even as can be.

    Each training task sends the rows of the table it has touched, so there are never more of them than asked for,
    however many partitions the session's shuffles have.
    """
    return blocks.select("block").repartition(tasks).sortWithinPartitions("block")


def train(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """Counts and trains over the documents that aren't held out."""
    spark = docs.sparkSession
    folder = common.fresh_path(spark, "lm-blocks")
    bodies = docs.select(F.col("doc_id").cast("long"), held_out().alias("held"), common.text_or_empty().cast("binary").alias("body"))
    with common.scratch(spark) as written:
        entries = written(bodies.mapInArrow(_blocks(folder), ENTRY), "lm-entries")
        # a row for BLOCK_BYTES of text: one file, whose rows repartition() without a key deals evenly
        blocks = common.written(entries.select("block").distinct().coalesce(1).sortWithinPartitions("block"), "lm-manifest")
        total = entries.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        # a word has one entry a block at most
        same_word = Window.partitionBy("word")
        sign = F.when(F.min("block").over(same_word) == F.col("block"), 1).otherwise(-1)
        sums = entries.select("block", "word", (F.sum("n").over(same_word) * sign).alias("total"))
        leaves = sums.groupBy("block").applyInArrow(_counted(folder, total), LEAF)
        # what is written leaves no shuffle files behind
        leaves = written(leaves.groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "lm-leaves").toArrow()
    prior = Prior(leaves.column("leaf").to_numpy(), leaves.column("n").to_numpy())
    distinct, bits, weights = int(leaves.column("words").to_numpy().sum()), table_bits(total), np.zeros((1 << table_bits(total), WAYS), np.float16)
    tasks = common.row_blocks(total, TASK_TOKENS << bits)
    shared_prior = spark.sparkContext.broadcast(prior)
    for k in range(rounds if total else 0):
        shared = spark.sparkContext.broadcast(weights) if k else None
        slices = dealt(blocks, tasks).mapInArrow(_train(folder, total, bits, shared_prior, shared, k, rounds), SLICES).repartition(F.col("slice")).sortWithinPartitions("slice")
        with common.scratch(spark) as written:
            found = written(slices.mapInArrow(_average, SLICES), "lm-weights").select("slice", "rows").toArrow()
        weights = weights.copy()
        for at, rows in zip(found.column("slice").to_pylist(), found.column("rows").to_pylist(), strict=True):
            weights[at * SLICE : (at + 1) * SLICE] = np.frombuffer(rows, np.float16).reshape(-1, WAYS)
        if shared is not None:
            shared.destroy()
    shared_prior.destroy()
    return Model(folder, blocks, total, distinct, prior, weights)


SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score_block(block: Block, prior: Prior, weights: np.ndarray, total: int, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known tokens, base score and score (log10) of each document."""
    bits = len(weights).bit_length() - 1
    base = np.log10((block.counts + SMOOTHING) / (total + SMOOTHING * (distinct + 1)))
    leaf = prior.leaves.reshape(-1).take(_leaf(*block.factors(total)))
    inside = np.log(np.maximum(block.counts, 1) / np.where(block.counts > 0, leaf, 1))
    found = inside.take(block.tokens)
    for begin in range(0, len(found), WINDOW):
        tokens = Tokens(block, total, begin, begin + WINDOW)
        at, kind, code = np.arange(len(tokens.kind)), tokens.kind, tokens.code
        for level in range(DEPTH + 1):
            if level:
                more = np.flatnonzero(kind >= level)
                at, kind, code = at.take(more), kind.take(more), code.take(more)
            node, outcome = _factors(kind, code, np.full(len(at), level))
            found[begin + at] += log_probabilities(weights, prior.log, node, tokens.rows(at, node, bits), outcome)
    begins = block.ends - block.docs["size"]
    known = np.add.reduceat((block.counts > 0)[block.tokens].astype(np.int64), begins)
    return known, np.add.reduceat(base[block.tokens], begins), np.add.reduceat(found, begins) / np.log(10)


def _score(folder: str, shared, total: int, distinct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = common.file_system(folder)
        prior, half = shared.value
        weights = half.astype(np.float32)
        for batch in batches:
            for own in batch.column("block").to_pylist():
                block = Block(files, f"{at}/{own}")
                known, base, score = score_block(block, prior, weights, total, distinct)
                docs = block.docs
                yield pa.RecordBatch.from_arrays([pa.array(docs["id"].copy(), mask=docs["null"].copy()), pa.array(docs["held"].copy()), pa.array(docs["size"].copy()), pa.array(known), pa.array(base), pa.array(score)], names=[c.split()[0] for c in SCORE.split(", ")])

    return run


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    A null text is its end token alone; rows are scored one by one, so repeated rows, and rows with
    a null doc_id (which are never held out), have a row each. Without training documents, all
    words are unknown and have probability 1.
    """
    model = train(docs, rounds)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.prior, model.weights))
    tasks = common.row_blocks(model.blocks.count(), 1)
    rows = model.blocks.select("block").repartition(tasks).mapInArrow(_score(model.folder, shared, model.total, model.distinct), SCORE)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
