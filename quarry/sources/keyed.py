"""Keyed tables that are written to: hash buckets of Parquet files, named by a versioned manifest.

A write rewrites the buckets that its keys fall into and no others, and shows at once when its manifest
is there; a writer that comes second gets a Conflict. Readers keep the version they began with: files
that only older versions name go one write later.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators import entities
from quarry.sources.manifest import Manifest
from quarry.sources.written import settled


class KeyedTable:
    """A table of a schema with one row a key (several columns), in a folder all executors share.

    `buckets` fixes how much a small write rewrites: choose it so that a bucket is about a file.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, keys: Sequence[str], buckets: int = 64) -> None:
        self._spark, self._folder, self._keys, self._buckets = spark, folder.rstrip("/"), list(keys), buckets
        self._empty = spark.createDataFrame([], schema)
        self._manifest = Manifest(spark, folder)

    def _at(self, paths: Sequence[str]) -> DataFrame:
        return self._spark.read.schema(self._empty.schema).parquet(*paths) if paths else self._empty

    def paths(self) -> dict[str, str]:
        """The folder of each bucket that has rows."""
        return (self._manifest.latest()[1] or {}).get("buckets", {})

    def read(self) -> DataFrame:
        return self._at(sorted(self.paths().values()))

    def _write(self, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        number = F.pmod(F.xxhash64(*self._keys), F.lit(self._buckets))
        version, value = self._manifest.latest()
        now, stale = (value or {}).get("buckets", {}), (value or {}).get("stale", [])
        new = settled(batch, "batch")
        touched = {str(r["b"]) for r in new.select(number.alias("b")).distinct().collect()}  # no more than there are buckets
        if not touched:
            return
        rows = change(self._at(sorted(now[b] for b in touched if b in now)), new).select(*self._empty.columns)
        at = f"{self._folder}/part-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", number).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(at)
        kept = {str(r["b"]) for r in self._spark.read.parquet(at).select(F.col("_bucket").alias("b")).distinct().collect()} if self._has_files(at) else set()
        after = {b: p for b, p in now.items() if b not in touched} | {b: f"{at}/_bucket={b}" for b in kept}
        self._manifest.commit(version, {"buckets": after, "stale": [now[b] for b in touched if b in now]})
        for path in stale:
            self._manifest.delete(path)

    def _has_files(self, at: str) -> bool:
        fs = self._manifest._fs
        return any(s.isDirectory() for s in fs.listStatus(self._manifest._path(at)))

    def upsert(self, batch: DataFrame, order: str, **options) -> None:
        """Writes a batch over the rows of its keys, as `entities.upserted` says."""
        self._write(batch, lambda old, new: entities.upserted(old, new, self._keys, order, **options))

    def patch(self, patches: DataFrame, order: str | None = None) -> None:
        """Changes rows that are there, as `entities.patched` says."""
        self._write(patches, lambda old, new: entities.patched(old, new, self._keys, order))

    def delete(self, gone: DataFrame) -> None:
        """Removes the rows of some keys."""
        self._write(gone.select(*self._keys).distinct(), lambda old, new: old.join(new, self._keys, "left_anti"))
