"""What the operators of this subpackage share: the shared folder, written tables and document columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Releases a finished write's shuffle files, which nothing reads again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_folder: list[str] = []
_held: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """What this worker keeps from task to task under a name, at first make().

    Spark reuses workers for later steps, so that of one name is held at a time: what another step
    has left goes.
    """
    if name not in _held:
        leave()
        _held[name] = make()
    return _held[name]


def leave() -> None:
    """Drops what earlier steps have left in this worker."""
    _held.clear()


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function of mapInArrow, at whose end Arrow gives back the memory that it no longer uses: the worker stays."""

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return ended


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset (a single local machine, as in tests) a temporary folder stands in.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append(f"file://{tempfile.mkdtemp(prefix='quarry-')}")
        at = _own_folder[0]
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder that executors share (a URI, or a local path)."""
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def write_file(files: pafs.FileSystem, path: str, data: bytes) -> None:
    """Writes a file under another name first, so that a task that runs again never leaves half of it."""
    own = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        out.write(data)
    files.move(own, path)


def read_file(files: pafs.FileSystem, path: str) -> bytes:
    with files.open_input_stream(path) as source:
        return source.read()


def write_table(df: DataFrame, name: str) -> str:
    """Writes a table to the shared folder and returns its path; a reader's lineage starts there."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a written table: its plan runs once, and a lost executor loses none of it."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


def delete_table(spark: SparkSession, path: str) -> None:
    """Deletes a table of write_table() that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Written tables that are deleted again: `written(df, name)` as above, `delete(table)`, and all that is left at the end."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._paths = spark, {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = write_table(df, name)
        table = self._spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = (path, table)
        return table

    def delete(self, *tables: DataFrame) -> None:
        for table in tables:
            delete_table(self._spark, self._paths.pop(id(table))[0])

    def close(self) -> None:
        for path, _ in self._paths.values():
            delete_table(self._spark, path)
        self._paths = {}


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A Scratch whose tables live as long as the block: what leaves it has to be written elsewhere."""
    held = Scratch(spark)
    try:
        yield held
    finally:
        held.close()


def join_by_share(rows: DataFrame, known: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """rows joined to known, which has a row for each key and in `n` how often the key is in rows (of `total`).

    Keys with over a thousandth of the rows, of which there are fewer than 1,000, are broadcast, so
    that none of them puts its rows into one task; all others are joined by shuffles.
    """
    hot, cold = known.where(F.col(n) * 1000 > total), known.where(F.col(n) * 1000 <= total)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


def text_or_empty(text: Column | str = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a frame's size, from file sizes; reads no rows."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def row_blocks(count: int, per_block: int, least: int = 1) -> int:
    """Into how many blocks `count` rows go so that none holds much more than `per_block`."""
    return max(least, -(-count // per_block))
