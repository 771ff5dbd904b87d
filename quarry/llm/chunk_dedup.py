"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 32 bytes sets chunk ends, so they depend on nearby bytes alone:
text that is inserted before a passage leaves the passage's later chunks as they were. Chunks are
counted by digest, with partial sums before the shuffle; the first place of a digest keeps its
chunk and the other places are duplicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import common

#: Chunk sizes in bytes: least and most; ends are 1 in 2**MASK_BITS places besides.
LEAST, MOST, MASK_BITS = 16, 128, 5
#: Bytes from which a run of neighbouring repeated chunks counts as a repeat; 0: all of them.
LEAST_RUN = 0
_GEAR = np.random.default_rng(1_234_567).integers(0, 1 << 32, 256, dtype=np.uint32)
_SLAB = 1 << 20


def ends_of(data: np.ndarray) -> np.ndarray:
    """Places after which the gear hash asks for a chunk end."""
    out = []
    for at in range(0, len(data), _SLAB):
        begin = max(0, at - 31)
        h = _GEAR[data[begin : at + _SLAB]]
        for step in (1, 2, 4, 8, 16):
            older = np.zeros_like(h)
            older[step:] = h[:-step]
            h = h + (older << np.uint32(step))
        cut = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + begin + 1
        out.append(cut[cut > at])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def chunks(body: bytes, least: int = LEAST, most: int = MOST) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text: at least `least` bytes (but for the last), at most `most`."""
    out, start = [], 0
    for end in [*ends_of(np.frombuffer(body, np.uint8)).tolist(), len(body)]:
        while end - start > most:
            out.append((start, start + most))
            start += most
        if end - start >= least or end == len(body) > start:
            out.append((start, end))
            start = end
    return out


CHUNK = "doc_id long, doc_hash long, start int, size int, digest binary"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            owner, start, size, digest = [], [], [], []
            for k, body in enumerate(part.column(2).to_pylist()):
                for a, b in chunks(body):
                    owner.append(k)
                    start.append(a)
                    size.append(b - a)
                    digest.append(hashlib.blake2b(body[a:b], digest_size=16).digest())
            at = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(digest, pa.binary())], names=["doc_id", "doc_hash", "start", "size", "digest"])


def chunk_table(docs: DataFrame) -> DataFrame:
    """All chunks of all texts; null and empty texts have none."""
    body = common.text_or_empty().cast("binary")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(common.text_or_empty()).alias("doc_hash"), body.alias("body")).mapInArrow(_chunked, CHUNK)


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Every chunk that occurs at another place too, whatever its size: doc_id, doc_hash, start, size, first (its first place), is_first.

    A row that repeats a doc_id and its text is the same place; a null doc_id comes before all others.
    """
    table = common.written(chunk_table(docs), "chunks")
    place = F.struct("doc_id", "doc_hash", "start")
    known = table.groupBy("digest").agg(F.count("*").alias("copies"), F.min(place).alias("first")).where("copies > 1")
    joined = common.join_by_share(table, common.written(known, "known"), ["digest"], "copies", table.count())
    return joined.select("doc_id", "doc_hash", "start", "size", "first", place.eqNullSafe(F.col("first")).alias("is_first")).dropDuplicates(["doc_id", "doc_hash", "start"])


def _runs(repeated: DataFrame) -> DataFrame:
    """Repeated chunks with `run`, which neighbours share."""
    in_order = Window.partitionBy("doc_id", "doc_hash").orderBy("start")
    opens = F.coalesce(F.col("start") != F.lag(F.col("start") + F.col("size")).over(in_order), F.lit(True))
    return repeated.withColumn("opens", opens).withColumn("run", F.sum(F.col("opens").cast("int")).over(in_order))


def repeated_runs(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """Runs of neighbouring chunks that occur elsewhere too, of at least `least_run` bytes together (0: all of them).

    Per run: doc_id, start and length in bytes of the text, n_chunks, n_first (chunks of which this
    is the first place, which keep them), first_doc_id (the least document that holds one of them
    first) and duplicates, the spans (start, size) of the chunks that have their first place
    elsewhere. Documents without such a run have no row.
    """
    later = F.array_sort(F.collect_list(F.when(~F.col("is_first"), F.struct("start", "size"))))
    return (
        _runs(repeated_chunks(docs))
        .groupBy("doc_id", "doc_hash", "run")
        .agg(F.min("start").alias("start"), F.sum("size").alias("length"), F.count("*").alias("n_chunks"), F.sum(F.col("is_first").cast("long")).alias("n_first"), F.min("first.doc_id").alias("first_doc_id"), later.alias("duplicates"))
        .where(F.col("length") >= least_run)
        .select("doc_id", "doc_hash", "start", "length", "n_chunks", "n_first", "first_doc_id", "duplicates")
    )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed = [], []
        for text, spans in zip(batch.column("row").field("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if text is None:
                kept.append(None)
                removed.append(0)
                continue
            body, parts, at = text.encode(), [], 0
            for s in sorted(spans or (), key=lambda x: x["start"]):
                parts.append(body[at : s["start"]])
                at = s["start"] + s["size"]
            parts.append(body[at:])
            left = b"".join(parts)
            kept.append(left.decode("utf-8", "ignore"))
            removed.append(len(body) - len(left))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string()), pa.array(removed, pa.int64())], names=["row", "kept_text", "removed_bytes"])


def deduplicated(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """Every row of docs with kept_text, its text without the chunks of repeated runs that stand first elsewhere, and removed_bytes.

    Replaces columns of these names; a null text stays null; rows that repeat a doc_id and its text lose the same.
    """
    docs = docs.drop("kept_text", "removed_bytes")
    gone = repeated_runs(docs, least_run).groupBy("doc_id", "doc_hash").agg(F.flatten(F.collect_list("duplicates")).alias("spans"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(common.text_or_empty()).alias("own_hash"))
    joined = rows.join(gone, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("doc_hash")), "left").select("row", "spans")
    schema = joined.select("row").schema.add("kept_text", "string").add("removed_bytes", "long")
    return joined.mapInArrow(_without, schema).select("row.*", "kept_text", "removed_bytes")
