"""Token-id files of independent zstandard frames with a trailing seek table.

A file holds the ids of documents one after another, as unsigned little-endian integers, in frames
of about FRAME_BYTES that decompress on their own. Behind them come two skippable frames, which
any zstandard reader passes over:
- the document index (compressed): item size, and per document its id, whether the id is null, and
  its number of tokens;
- the seek table: per frame its compressed and decompressed size and a checksum (the lower 32 bits
  of XXH64 of the decompressed bytes); then the number of frames, a descriptor byte and a magic
  number, so that a reader finds the table from the end of the file.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.tokenize import encoder

END, FRAME_BYTES = 2, 1 << 18
# Fixed values of the zstandard formats.
SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEKABLE_FOOTER, HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_FOOTER = struct.Struct("<IBI")
_LEVEL = 3


class Writer:
    """Writes documents to one file."""

    def __init__(self, out, item_size: int) -> None:
        self._out, self._item_size = out, item_size
        self._compress = zstandard.ZstdCompressor(level=_LEVEL).compress
        self._held, self._size = [], 0
        self._frames: list[tuple[int, int, int]] = []
        self._ids: list[int | None] = []
        self._counts: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._ids.append(doc_id)
        self._counts.append(len(ids) // self._item_size)
        self._held.append(ids)
        self._size += len(ids)
        if self._size >= FRAME_BYTES:
            self._frame()

    def _frame(self) -> None:
        raw = b"".join(self._held)
        packed = self._compress(raw)
        self._out.write(packed)
        self._frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self._held, self._size = [], 0

    def close(self) -> tuple[int, int]:
        """Ends the file; returns its documents and tokens."""
        if self._held:
            self._frame()
        null = np.array([x is None for x in self._ids], np.uint8)
        ids = np.array([x or 0 for x in self._ids], "<i8")
        index = self._compress(struct.pack("<BQ", self._item_size, len(ids)) + ids.tobytes() + null.tobytes() + np.array(self._counts, "<u8").tobytes())
        self._out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        entries = b"".join(struct.pack("<III", *x) for x in self._frames)
        self._out.write(struct.pack("<II", SKIPPABLE_TABLE, len(entries) + _FOOTER.size) + entries + _FOOTER.pack(len(self._frames), HAS_CHECKSUMS, SEEKABLE_FOOTER))
        return len(self._ids), sum(self._counts)


class Reader:
    """Reads a file's tables from its end, then only the frames that are asked for."""

    def __init__(self, source) -> None:
        self._source = source
        size = source.size() if hasattr(source, "size") else source.seek(0, io.SEEK_END)
        count, descriptor, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != SEEKABLE_FOOTER or not descriptor & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        entries = self._at(size - _FOOTER.size - 12 * count, 12 * count)
        self.frames = np.frombuffer(entries, "<u4").reshape(-1, 3).astype(np.int64)
        self._begins = np.append(0, np.cumsum(self.frames[:, 0]))
        self._raw = np.append(0, np.cumsum(self.frames[:, 1]))
        at = int(self._begins[-1])
        magic, length = struct.unpack("<II", self._at(at, 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no document index behind the frames")
        index = zstandard.ZstdDecompressor().decompress(self._at(at + 8, length))
        self.item_size, n = struct.unpack_from("<BQ", index)
        self.doc_ids = np.frombuffer(index, "<i8", n, 9)
        self.null_ids = np.frombuffer(index, np.uint8, n, 9 + 8 * n).astype(bool)
        self.counts = np.frombuffer(index, "<u8", n, 9 + 9 * n).astype(np.int64)
        self.starts = np.append(0, np.cumsum(self.counts))

    def _at(self, begin: int, size: int) -> bytes:
        self._source.seek(int(begin))
        return self._source.read(int(size))

    def frame(self, k: int) -> bytes:
        raw = zstandard.ZstdDecompressor().decompress(self._at(self._begins[k], self.frames[k, 0]), max_output_size=int(self.frames[k, 1]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"checksum of frame {k} doesn't match")
        return raw

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, from the frames that hold it."""
        begin, end = int(self.starts[k]) * self.item_size, int(self.starts[k + 1]) * self.item_size
        first, last = np.searchsorted(self._raw, [begin, end - 1], side="right") - 1 if end > begin else (0, -1)
        raw = b"".join(self.frame(i) for i in range(int(first), int(last) + 1))
        offset = begin - int(self._raw[first]) if end > begin else 0
        return np.frombuffer(raw[offset : offset + end - begin], f"<u{self.item_size}")

    def documents(self) -> Iterator[np.ndarray]:
        """All documents in order; frames are decompressed one at a time."""
        held, k = b"", 0
        for frame in range(len(self.frames)):
            held, at = held + self.frame(frame), 0
            while k < len(self.counts) and len(held) - at >= self.counts[k] * self.item_size:
                end = at + int(self.counts[k]) * self.item_size
                yield np.frombuffer(held[at:end], f"<u{self.item_size}")
                at, k = end, k + 1
            held = held[at:]


MANIFEST = "part int, path string, docs long, tokens long"


def _write(folder: str, tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, part = encoder(tokenizer).encoded, TaskContext.get().partitionId()
        files, at = common.file_system(folder)
        path, own = f"{at}/part-{part:06d}.zst", f"{at}/.writing-{part:06d}-{uuid.uuid4().hex}"
        out = writer = None
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
                if writer is None:
                    files.create_dir(at, recursive=True)
                    out = files.open_output_stream(own)
                    writer = Writer(out, ids.dtype.itemsize)
                writer.add(doc_id, ids.tobytes() + ids.dtype.type(end).tobytes())
        rows = []
        if writer is not None:
            docs, tokens = writer.close()
            out.close()
            files.move(own, path)
            rows = [(part, path, docs, tokens)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "path", "docs", "tokens"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end: int = END) -> DataFrame:
    """Writes the ids of all texts, in ascending doc_id order over the files, and returns the manifest.

    Null doc_ids come first; rows of one doc_id come by a hash of their texts, so that many of them
    are dealt to several files. Null texts have the end id alone. A task that runs again replaces
    its file. The manifest has a row per file: part (ascending),
    path, docs, tokens.
    """
    rows = docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text")).withColumn("place", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("place").asc()]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return common.written(sorted_rows.mapInArrow(_write(folder, tokenizer, end), MANIFEST), "manifest")


ROW = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = common.file_system(folder)
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with files.open_input_file(path) as source:
                    reader = Reader(source)
                    crc = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for ids in reader.documents()), np.int64, len(reader.counts))
                    yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids, mask=reader.null_ids), pa.array(before + reader.starts[:-1]), pa.array(reader.counts), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files of a manifest."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("part", "path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))
    spread = placed.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), "part")
    return spread.mapInArrow(_read(folder), ROW)


def _fetch(folder: str, wanted: set[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = common.file_system(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with files.open_input_file(path) as source:
                    reader = Reader(source)
                    found = [k for k, x in enumerate(reader.doc_ids.tolist()) if x in wanted and not reader.null_ids[k]]
                    yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids[found]), pa.array([reader.document(k).tolist() for k in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return run


def read_documents(manifest: DataFrame, folder: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the requested documents; only their frames are decompressed."""
    return manifest.select("path").mapInArrow(_fetch(folder, set(doc_ids)), "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes all documents to a new folder in the shared one and reads their digests back."""
    spark: SparkSession = docs.sparkSession
    folder = common.fresh_path(spark, "tokens")
    return read_digests(write_tokens(docs, tokenizer, folder), folder)
