"""Folder walks: every file below a folder, names that begin with . or _ included, by ignore files of each folder.

Spark's own file index passes over such names. Here a walk goes by rounds: the folders still to be read are
dealt to tasks, each reads its folders and those below up to a number, and hands on what is left.
Depth and width of the tree set no bound, and no listing passes through the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import files as fl
from quarry.sources.files import ignore_regex
from quarry.sources.written import settled

Opener = Callable[[str], tuple[pafs.FileSystem, str]]
IGNORE_FILES = (".gitignore", ".indexignore")
#: A deeper folder is taken for a loop of links.
DEEPEST = 256
_RULES = pa.list_(pa.struct([("base", pa.string()), ("line", pa.string())]))
_FOUND = pa.schema([("kind", pa.string()), ("relative", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("rules", _RULES)])
_SCHEMA = "kind string, relative string, size long, modified timestamp, rules array<struct<base:string,line:string>>"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder given by a URI or a local path."""
    local = re.match(r"(?:file:/+)?(?=/)|file:/+", uri)
    return (pafs.LocalFileSystem(), "/" + uri[local.end() :].lstrip("/")) if local else pafs.FileSystem.from_uri(uri)


def rules_of(text: str, base: str) -> list[dict]:
    """The lines of an ignore file that stands in the folder `base` (relative; the root is empty)."""
    return [{"base": base, "line": line.strip()} for line in text.split("\n") if ignore_regex(line.strip()) is not None]


class Rules:
    """Whether paths are ignored by rules, each of which holds below its base only; the last that matches decides."""

    def __init__(self) -> None:
        self._compiled: dict[str, tuple[re.Pattern, bool]] = {}

    def ignored(self, relative: str, rules: Sequence[dict]) -> bool:
        """relative ends with / for a folder."""
        for rule in reversed(rules):
            base = rule["base"]
            if base and not relative.startswith(base + "/"):
                continue
            line = rule["line"]
            if line not in self._compiled:
                pattern, back = ignore_regex(line)
                self._compiled[line] = (re.compile(pattern), back)
            pattern, back = self._compiled[line]
            if pattern.search(relative[len(base) + 1 if base else 0 :]):
                return not back
        return False


def _step(root: str, ignore_files: Sequence[str], most: int, open_fs: Opener):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = open_fs(root)
        top, known = top.rstrip("/"), Rules()
        for batch in batches:
            stack = [(r["relative"], r["rules"]) for r in batch.to_pylist()]
            n = 0
            while stack and n < most:
                here, rules = stack.pop()
                n += 1
                rows: list[tuple] = []
                if here.count("/") > DEEPEST:
                    raise ValueError(f"{root}/{here} is deeper than {DEEPEST} folders: a loop of links?")
                try:
                    entries = files.get_file_info(pafs.FileSelector(f"{top}/{here}" if here else top or "/"))
                except OSError:
                    yield _batch([("unreadable", here + "/", None, None, None)])
                    continue
                names = {e.base_name: e for e in entries}
                for name in ignore_files:
                    if name in names and names[name].type == pafs.FileType.File:
                        with files.open_input_stream(names[name].path) as source:
                            rules = [*rules, *rules_of(source.read().decode("utf-8", "replace"), here)]
                for e in sorted(entries, key=lambda e: e.base_name):
                    relative = f"{here}/{e.base_name}" if here else e.base_name
                    if e.type == pafs.FileType.Directory:
                        if known.ignored(relative + "/", rules):
                            rows.append(("ignored", relative + "/", None, None, None))
                        else:
                            stack.append((relative, rules))
                    elif e.type == pafs.FileType.File:
                        at = datetime.fromtimestamp(e.mtime_ns // 1000 / 1e6, UTC) if e.mtime_ns else None
                        rows.append(("ignored" if known.ignored(relative, rules) else "file", relative, e.size, at, None))
                yield _batch(rows)
            yield _batch([("folder", here, None, None, rules) for here, rules in stack])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_FOUND)], schema=_FOUND)


def walked(spark: SparkSession, root: str, patterns: Sequence[str] = (), ignore_files: Sequence[str] = IGNORE_FILES, per_task: int = 2000, open_fs: Opener = opened) -> DataFrame:
    """(path, relative, size, modified, ignored) of what is below a folder.

    `patterns` hold below the root; the lines of ignore files below their own folder, and weigh more the
    nearer they are. What is below an ignored folder isn't read: the folder stands for it, its name ends with
    / and it has no size, as has one that can't be read. Links to files and folders are followed.
    """
    tasks = 4 * spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([("", [(r["base"], r["line"]) for r in rules_of("\n".join(patterns), "")])], "relative string, rules array<struct<base:string,line:string>>")
    found, budget = None, 16
    while True:
        rows = settled(frontier.repartition(tasks, "relative").mapInArrow(_step(root, tuple(ignore_files), budget, open_fs), _SCHEMA), "walk")
        part = rows.where("kind <> 'folder'").drop("rules")
        found = part if found is None else found.unionByName(part)
        frontier = rows.where("kind = 'folder'").select("relative", "rules")
        if frontier.isEmpty():
            break
        budget = min(per_task, budget * 8)
    base = root.rstrip("/") + "/"
    return found.selectExpr(f"concat({_quoted(base)}, relative) AS path", "relative", "size", "modified", "kind = 'ignored' AS ignored", "kind = 'unreadable' AS unreadable")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listed(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, relative, size, modified) of all files below a folder, whatever ignore files say; glob is of names."""
    rows = walked(spark, root, ignore_files=()).where("size IS NOT NULL").select("path", "relative", "size", "modified")
    return rows if glob is None else rows.where(F.col("relative").rlike(fl.ignore_regex(glob)[0]))


def classified(spark: SparkSession, root: str, patterns: Sequence[str] = (), **options) -> DataFrame:
    """What a walk finds, with `verdict`; folders count as ignored where they are."""
    return fl.classified(walked(spark, root, patterns).where("NOT unreadable").drop("unreadable"), **options)


def scan(spark: SparkSession, root: str, patterns: Sequence[str] = (), **options) -> DataFrame:
    """The accepted files below a folder."""
    return classified(spark, root, patterns, **options).where("verdict = 'accepted'").drop("verdict", "ignored")


def scan_all(spark: SparkSession, root: str, patterns: Sequence[str] = (), supported: Sequence[str] = fl.EXTENSIONS) -> DataFrame:
    """All files of supported extensions, however large and whatever ignore rules say of them; ignored folders aren't read."""
    return walked(spark, root, patterns).where("size IS NOT NULL").where(fl.extension(F.col("relative")).isin(*supported)).drop("ignored", "unreadable")
