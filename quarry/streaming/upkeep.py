"""Upkeep of an index as streams: changed files, expiry of tags, decay of rules, states of topic sessions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState

from quarry.functions import entities as en
from quarry.sources import files, walk
from quarry.sources.manifest import Manifest


class Watch:
    """Changes below a folder, listing by listing: add, change and unlink against the last listing that was committed.

    The listing is a written table that a versioned manifest in `folder` names. A file younger than
    `stable` seconds is left as it was in the last listing, so that it comes once its writer is done. What
    `poll` gives comes again until `commit`; the first listing is a list of additions, or nothing with
    `initial=False`.
    """

    _SCHEMA = "relative string, size long, modified timestamp"

    def __init__(self, spark: SparkSession, root: str, folder: str, patterns: Sequence[str] = (), stable: float = 0.2, initial: bool = True, **options) -> None:
        self._spark, self._root, self._folder, self._patterns, self._stable, self._initial, self._options = spark, root, folder.rstrip("/"), patterns, stable, initial, options
        self._manifest = Manifest(spark, folder)
        self._next: str | None = None
        self.counts = dict.fromkeys(("add", "change", "unlink"), 0)

    def poll(self, now: datetime | None = None) -> DataFrame:
        """(relative, change) since the last commit."""
        self._version, value = self._manifest.latest()
        self._last = value and value["listing"]
        before = self._spark.read.schema(self._SCHEMA).parquet(self._last) if self._last else self._spark.createDataFrame([], self._SCHEMA)
        edge = F.lit((now or datetime.now(UTC)) - timedelta(seconds=self._stable))
        found = walk.scan(self._spark, self._root, self._patterns, **self._options).select("relative", "size", "modified")
        old, young = F.col("modified") <= edge, F.col("modified") > edge
        kept = found.where(old).unionByName(before.join(found.where(young).select("relative"), "relative", "left_semi"))
        if self._next:
            self._manifest.delete(self._next)
        self._next = f"{self._folder}/listing-{uuid.uuid4().hex}"
        kept.write.parquet(self._next)
        now_ = self._spark.read.schema(self._SCHEMA).parquet(self._next)
        return files.changes(now_ if self._last is None and not self._initial else before, now_)

    def commit(self) -> None:
        """The listing that was polled becomes the one to compare with."""
        self._manifest.commit(self._version, {"listing": self._next})
        if self._last:
            self._manifest.delete(self._last)
        self._next = None

    def stream(self, apply: Callable[[DataFrame, int], None], seconds: int = 1) -> DataStreamWriter:
        """A writer that lists at each trigger, hands changes to `apply` and commits; a batch that fails comes again.

        Start it with a processing-time trigger of the same pace: the ticks only set the pace.
        """

        def run(_: DataFrame, batch: int) -> None:
            found = self.poll()
            counts = {r["change"]: r["count"] for r in found.groupBy("change").count().collect()}
            if counts:
                apply(found, batch)
            self.commit()
            for change, n in counts.items():
                self.counts[change] += n

        ticks = self._spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(run).trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", f"{self._folder}/ticks")


def expired(entities: DataFrame, hashes: DataFrame, now: Column, most_days: int = 14) -> DataFrame:
    """Entities (id, tags, links, updated_at) with `kept` and `expired` (a number): automatic tags go when a linked file's hash changed, contextual ones after `most_days`.

    hashes: path, old_hash, new_hash.
    """
    differ = hashes.where(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).select(F.col("path").alias("file"))
    links = entities.select("id", F.explode("links").alias("x")).where("x.type = 'file'").select("id", F.col("x.id").alias("file"))
    changed = links.join(differ, "file", "left_semi").select("id").distinct().withColumn("changed", F.lit(True))
    rows = entities.join(changed, "id", "left")
    old = F.coalesce(F.col("updated_at") <= en.cutoff(now, most_days), F.lit(False))
    kept = en.expired_tags(F.col("tags"), F.coalesce("changed", F.lit(False)), old)
    return rows.withColumn("kept", kept).withColumn("expired", F.size("tags") - F.size("kept")).drop("changed")


def decayed(rules: DataFrame, now: Column, rate: float = 0.02, after_days: int = 30) -> DataFrame:
    """Rules (id, uses, last_used) with `decayed_uses`: uses * (1 - rate) ** days for those unused for longer, rounded down."""
    days = F.coalesce(en.days_since(F.col("last_used"), now), F.lit(0.0))
    return rules.withColumn("decayed_uses", F.when(days > after_days, F.greatest(F.lit(0), F.floor(F.col("uses") * F.pow(F.lit(1 - rate), days)))).otherwise(F.col("uses")).cast("long"))


def with_retries(job: Callable[[], None], tries: int = 3) -> int:
    """Runs a scheduled job until it succeeds, at most `tries` times; the number of tries it took."""
    for k in range(1, tries + 1):
        try:
            job()
            return k
        except Exception:
            if k == tries:
                raise
    return tries


STATE = "topic string, since timestamp, searches long, locked boolean"


def topic_sessions(searches: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """A stream of the state of each session (session, topic, since, searches, locked) after each batch of (session, ts, action, topic).

    search counts for the current topic and moves to its own unless locked; lock and unlock hold and
    free it. A session that is idle in event time is forgotten. Output mode: update.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        topic, since, n, locked = state.get if state.exists else (None, None, 0, False)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for ts, action, wanted in zip(rows["ts"], rows["action"], rows["topic"], strict=True):
            if action == "lock":
                locked = True
            elif action == "unlock":
                locked = False
            else:
                if wanted != topic and not (locked and topic is not None):
                    topic, since, n = wanted, ts, 0
                n += 1
        state.update((topic, since, n, locked))
        state.setTimeoutTimestamp(int(max(rows["ts"].max().timestamp() * 1000, state.getCurrentWatermarkMs()) + pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame({"session": [key[0]], "topic": [topic], "since": [since], "searches": [n], "locked": [locked]})

    return searches.withWatermark("ts", idle).groupBy("session").applyInPandasWithState(run, f"session long, {STATE}", STATE, "update", "EventTimeTimeout")
