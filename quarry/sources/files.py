"""File sources: listings with ignore rules, changes between listings."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.manifest import Manifest

#: The time and path of the last file that was taken; None before the first.
Mark = tuple | None

# Sizes and extensions.
MOST_BYTES = 1 << 20
EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".py", ".php", ".java", ".cs", ".md", ".mdx", ".rst", ".txt", ".html", ".css", ".json")
FALLBACKS = (".sh", ".yml", ".yaml", ".toml", ".sql", ".xml")
# End of fixed values.


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """The regular expression of a line of an ignore file and whether it brings paths back; None for comments and blanks."""
    line = pattern.rstrip()
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line
    only_folders = line.endswith("/")
    line = line.rstrip("/")
    rooted = "/" in line
    line = line.lstrip("/")
    out, k = "", 0
    while k < len(line):
        if line.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif line.startswith("**", k):
            out, k = out + (".+" if line[:k].endswith("/") else ".*"), k + 2
        elif line[k] == "*":
            alone = (k == 0 or line[k - 1] == "/") and line[k + 1 : k + 2] in ("", "/")
            out, k = out + ("[^/]+" if alone else "[^/]*"), k + 1
        elif line[k] == "?":
            out, k = out + "[^/]", k + 1
        elif line[k] == "[" and "]" in line[k:]:
            end = line.index("]", k)
            out, k = out + line[k : end + 1].replace("[!", "[^"), end + 1
        elif line[k] == "\\" and k + 1 < len(line):
            out, k = out + re.escape(line[k + 1]), k + 2
        else:
            out, k = out + re.escape(line[k]), k + 1
    return ("^" if rooted else "^(?:.*/)?") + out + ("/.*$" if only_folders else "(?:/.*)?$"), back


def is_ignored(path: Column, patterns: Iterable[str]) -> Column:
    """Whether a relative path is ignored: the last pattern that matches decides, ! brings back."""
    out = F.lit(False)
    for p in patterns:
        found = ignore_regex(p)
        if found is not None:
            out = F.when(path.rlike(found[0]), F.lit(not found[1])).otherwise(out)
    return out


def is_ignored_below(path: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """As is_ignored, of (folder, pattern): a pattern holds below its folder only (the root is empty); the last that matches decides."""
    out = F.lit(False)
    for base, p in rules:
        found = ignore_regex(p)
        if found is not None:
            below = F.lit(True) if not base else path.startswith(base + "/")
            within = path if not base else F.substring(path, len(base) + 2, 1 << 30)
            out = F.when(below & within.rlike(found[0]), F.lit(not found[1])).otherwise(out)
    return out


def read_patterns(spark: SparkSession, files: Sequence[str]) -> list[str]:
    """The lines of ignore files, in order; those of files that come later weigh more. These files are small."""
    return [r["value"] for f in files for r in spark.read.text(f).select("value").collect()]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def classified(files: DataFrame, patterns: Iterable[str] = (), most_bytes: int = MOST_BYTES, tests: bool = False, include: Sequence[str] | None = None, exclude: Sequence[str] = (), supported: Sequence[str] = (*EXTENSIONS, *FALLBACKS)) -> DataFrame:
    """Files with `verdict`: ignored, oversize, unsupported or accepted; a column `ignored` of a walk counts beside the patterns."""
    path, ext = F.col("relative"), extension(F.col("relative"))
    test = path.rlike(r"\.(test|spec)\.[^/]*$") | path.rlike(r"(^|/)__tests?__/[^/]*$")
    wrong = ext.isin(*exclude) if exclude else F.lit(False)
    if include is not None:
        wrong |= ~ext.isin(*include)
    verdict = (
        F.when(is_ignored(path, patterns) | (F.col("ignored") if "ignored" in files.columns else F.lit(False)), "ignored")
        .when(F.col("size") > most_bytes, "oversize")
        .when((F.lit(not tests) & test) | wrong, "ignored")
        .when(ext.isin(*supported), "accepted")
        .otherwise("unsupported")
    )
    return files.withColumn("verdict", verdict)


def scan_summary(files: DataFrame) -> DataFrame:
    """One row: scanned, ignored, oversize and accepted files of classified()."""
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return files.agg(F.count("*").alias("scanned"), count("ignored"), count("oversize"), count("accepted"))


def changes(before: DataFrame, now: DataFrame, settled_before: Column | None = None) -> DataFrame:
    """(relative, change) between two listings: add, change (size or time) or unlink.

    A file that was written after `settled_before` may still be growing: it is passed over until a later listing.
    """
    old, new = before.select("relative", F.col("size").alias("s0"), F.col("modified").alias("m0"), F.lit(True).alias("was")), now.select("relative", F.col("size").alias("s1"), F.col("modified").alias("m1"), F.lit(True).alias("is"))
    differ = ~(F.col("s0").eqNullSafe(F.col("s1")) & F.col("m0").eqNullSafe(F.col("m1")))
    kind = F.when(F.col("was").isNull(), "add").when(F.col("is").isNull(), "unlink").when(differ, "change")
    both = old.join(new, "relative", "full_outer").select("relative", kind.alias("change"), "m1").where("change IS NOT NULL")
    if settled_before is not None:
        both = both.where(F.col("m1").isNull() | (F.col("m1") <= settled_before))
    return both.select("relative", "change")


def to_reconcile(files: DataFrame, mark: Mark = None, most: int = 100, settled_before: Column | None = None) -> DataFrame:
    """The `most` files that come after a mark in the order of (modified, relative); `mark_of` a batch is the next mark.

    Files of one time are told apart by their paths, so a batch may end among them. A file without a time
    counts as of the time 0. With `settled_before`, later files wait: a mark then never reaches a time
    that other files may still get.
    """
    time = F.coalesce("modified", F.lit(0).cast("timestamp") if dict(files.dtypes)["modified"].startswith("timestamp") else F.lit(0))
    rows = files if settled_before is None else files.where(time <= settled_before)
    if mark is not None:
        t, p = F.lit(mark[0]), F.lit(mark[1])
        rows = rows.where((time > t) | ((time == t) & (F.col("relative") > p)))
    return rows.orderBy(time, "relative").limit(most)


def mark_of(taken: DataFrame, mark: Mark = None) -> Mark:
    """The mark after a batch: (modified, relative) of its last file, or the old one where the batch is empty."""
    time = F.coalesce("modified", F.lit(0).cast("timestamp") if dict(taken.dtypes)["modified"].startswith("timestamp") else F.lit(0))
    last = taken.agg(F.max(F.struct(time.alias("t"), F.col("relative").alias("p"))).alias("last")).first()["last"]
    return mark if last is None else (last["t"], last["p"])


class Reconciler:
    """Batches of changed files, by a mark that is kept as a small versioned table.

    `batch()` gives the next files; `done(batch)` moves the mark behind them, and fails where another
    run has moved it meanwhile. What isn't done comes again.
    """

    def __init__(self, spark: SparkSession, folder: str, most: int = 100) -> None:
        self._manifest, self._most = Manifest(spark, folder), most
        self._version, value = self._manifest.latest()
        self.mark: Mark = None if value is None else (datetime.fromisoformat(value["modified"]), value["relative"])

    def batch(self, files: DataFrame, settled_before: Column | None = None) -> DataFrame:
        return to_reconcile(files, self.mark, self._most, settled_before)

    def done(self, taken: DataFrame) -> None:
        mark = mark_of(taken, self.mark)
        if mark != self.mark:
            self._version = self._manifest.commit(self._version, {"modified": mark[0].isoformat(), "relative": mark[1]})
            self.mark = mark
