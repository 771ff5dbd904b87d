"""Versioned manifests: small JSON files in a shared folder, each version written once, by whoever comes first."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Manifest:
    """The versions of a small value in a folder that Spark can write (any Hadoop file system).

    A version is written under another name and renamed, which fails where it exists: of two writers that
    read the same version one gets a Conflict and has to begin anew. Older versions are removed.
    """

    def __init__(self, spark: SparkSession, folder: str, kept: int = 3) -> None:
        self._jvm, self._conf, self._kept = spark._jvm, spark._jsc.hadoopConfiguration(), kept
        self._folder = self._path(folder.rstrip("/"))
        self._fs = self._folder.getFileSystem(self._conf)

    def _path(self, at: str, child: str | None = None):
        path = self._jvm.org.apache.hadoop.fs.Path
        return path(at) if child is None else path(at, child)

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._folder)]
        return sorted(int(m[1]) for m in map(re.compile(r"manifest-(\d+)\.json").fullmatch, names) if m)

    def latest(self) -> tuple[int, dict | None]:
        """The last version and its value; -1 and None where there is none."""
        versions = self._versions()
        if not versions:
            return -1, None
        stream = self._fs.open(self._path(self._folder.toString(), f"manifest-{versions[-1]}.json"))
        try:
            return versions[-1], json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, after: int, value: dict) -> int:
        """Writes the version that follows `after`."""
        at = self._folder.toString()
        own, final = self._path(at, f"own-{uuid.uuid4().hex}"), self._path(at, f"manifest-{after + 1}.json")
        out = self._fs.create(own, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._folder.toUri(), self._conf).rename(own, final, none)
        except Exception as e:
            self._fs.delete(own, False)
            if self._fs.exists(final):
                raise Conflict(f"version {after + 1} is there already") from e
            raise
        for old in self._versions()[: -self._kept]:
            self._fs.delete(self._path(at, f"manifest-{old}.json"), False)
        return after + 1

    def delete(self, path: str) -> None:
        """Deletes a table that no version names any more."""
        self._fs.delete(self._path(path), True)
