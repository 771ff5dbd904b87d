"""Orders that no single task has to hold: positions by range partitioning, greedy budgets, the best rows, values carried on.

A group may hold any share of the rows. Its rows lie in neighbouring chunks of a written table, and what a
chunk needs of those before it comes from one small row a chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.written import settled

_CHUNK = 33
#: Groups of so many rows at most are folded by one expression.
FOLDED = 2000
_BUCKETS = 4096
_MOST = 1.7976931348623157e308


def placed(df: DataFrame, order: Sequence[Column | str], name: str = "ordered", chunks: int | None = None) -> DataFrame:
    """The rows with `pos`, unique and ascending in an order, and `chunk`, the part of the table they lie in; a written table.

    Rows that are equal in the order come one after the other, in no fixed order. Spark sets the number of
    chunks by their bytes unless it is given.
    """
    keys = [*order, F.col("_tie")]
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    rows = (rows.repartitionByRange(chunks, *keys) if chunks else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys).drop("_tie").withColumn("pos", F.monotonically_increasing_id())
    return settled(rows, name).withColumn("chunk", F.shiftright("pos", _CHUNK))


def nulls_last(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows in an order, as orderBy(...).limit(n) gives them, however large n is."""
    rows = placed(df, order, "first")
    left, cut = n, 0
    for r in sorted(rows.groupBy("chunk").agg(F.count("*").alias("n")).collect(), key=lambda r: r["chunk"]):
        cut = (r["chunk"] << _CHUNK) + min(left, r["n"])
        left -= min(left, r["n"])
        if not left:
            break
    return rows.where(F.col("pos") < cut).select(*df.columns)


def best_rows(df: DataFrame, score: str, n: int, key: Sequence[str]) -> DataFrame:
    """The n rows of the highest score; of equal ones the first by key; null and NaN come last.

    The n-th score is found by histograms, each of one bucket of the one before, so no row is moved;
    only rows of exactly that score are put in order.
    """
    value = F.col(score).cast("double")
    rows = df.withColumn("_v", F.when(value.isNotNull() & ~F.isnan(value), F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), value))))
    low, high, known = rows.agg(F.min("_v"), F.max("_v"), F.count("_v")).first()
    if n >= known:
        rest = first_rows(rows.where("_v IS NULL"), nulls_last(key), n - known) if n > known else rows.limit(0)
        return rows.where("_v IS NOT NULL").unionByName(rest).select(*df.columns)
    if n <= 0:
        return df.limit(0)
    want = n
    while low < high:
        inside = rows.where(F.col("_v").between(low, high))
        width = high / 2 - low / 2
        bucket = F.least(F.lit(_BUCKETS - 1), F.floor((F.lit(high / 2) - F.col("_v") / 2) / width * _BUCKETS))
        for b in sorted(inside.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).collect(), key=lambda r: -r["high"]):
            if b["n"] >= want:
                low, high = b["low"], b["high"]
                break
            want -= b["n"]
    ties = first_rows(rows.where(F.col("_v") == low), nulls_last(key), want)
    return rows.where(F.col("_v") > low).unionByName(ties).select(*df.columns)


def within_budget(items: DataFrame, group: Sequence[str], order: Sequence[str], size: str, budget: int, folded: int = FOLDED, chunks: int | None = None) -> DataFrame:
    """Rows taken greedily in order (nulls last) while their sizes fit into the budget of their group; later smaller ones may still fit.

    Null sizes are 0; a null group is a group; of rows that are equal in the order the smaller come first, and those
    that are equal in size too are taken one by one. Groups over `folded` rows go by rounds, all of them at once: while r is left,
    rows up to r/2 are taken until they reach r/2, or until a larger row fits behind them; either halves r,
    so there are no more rounds than the budget has bits. A round reads sums of chunks, and the rows of those chunks only
    that lie before its end.
    """
    rows = items.withColumn("_g", F.struct(*group) if group else F.struct(F.lit(0).alias("all"))).withColumn("_n", F.greatest(F.lit(0), F.coalesce(F.col(size), F.lit(0))).cast("long"))
    rows = placed(rows, ["_g", *nulls_last(order), "_n"], "budget", chunks)
    if budget < 0:
        return items.limit(0)
    free = rows.where("_n = 0").select("pos")
    sized = rows.where((F.col("_n") > 0) & (F.col("_n") <= budget)).select("_g", "pos", "chunk", "_n")
    large = settled(sized.groupBy("_g").agg(F.count("*").alias("rows")).where(F.col("rows") > folded).select("_g"), "large-groups")

    def add(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["n"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["n"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x["pos"]))).otherwise(acc["kept"]).alias("kept"))

    folds = sized.join(large, "_g", "left_anti").groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("_n").alias("n")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("kept"))
    kept = free.unionByName(folds.select(F.explode(F.aggregate("all", start, add, lambda acc: acc["kept"])).alias("pos")))
    if not large.isEmpty():
        kept = kept.unionByName(_by_rounds(sized.join(large, "_g", "left_semi"), large, budget))
    return rows.join(kept, "pos", "left_semi").select(*items.columns)


def _by_rounds(rows: DataFrame, groups: DataFrame, budget: int) -> DataFrame:
    """pos of the rows (_g, pos, chunk, _n) that fit."""
    state = groups.select("_g", F.lit(budget).cast("long").alias("r"), F.lit(-1).cast("long").alias("low"))
    rounds: DataFrame | None = None
    small = F.col("_n") * 2 <= F.col("r")
    while True:
        left = rows.join(state, "_g").where((F.col("pos") > F.col("low")) & (F.col("_n") <= F.col("r")))
        sums = left.groupBy("_g", "chunk").agg(F.sum(F.when(small, F.col("_n")).otherwise(0)).alias("s"), F.max("r").alias("limit"))
        before = F.coalesce(F.sum("s").over(Window.partitionBy("_g").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        open_ = sums.select("_g", "chunk", "limit", before.alias("before")).where(F.col("before") * 2 <= F.col("limit")).drop("limit")
        w = Window.partitionBy("_g", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        run = left.join(open_, ["_g", "chunk"]).withColumn("used", F.col("before") + F.coalesce(F.sum(F.when(small, F.col("_n")).otherwise(0)).over(w), F.lit(0)) + F.col("_n"))
        ends = run.where(F.when(small, F.col("used") * 2 > F.col("r")).otherwise(F.col("used") <= F.col("r")))
        end = ends.groupBy("_g").agg(F.min(F.struct("pos", "used")).alias("end"))
        done = settled(state.join(end, "_g", "left").select("_g", "r", "low", F.col("end.pos").alias("high"), F.col("end.used").alias("used")), "budget-round")
        rounds = done if rounds is None else rounds.unionByName(done)
        state = done.where("high IS NOT NULL AND used < r").select("_g", (F.col("r") - F.col("used")).alias("r"), F.col("high").alias("low"))
        if state.isEmpty():
            break
    taken = rounds.groupBy("_g").agg(F.collect_list(F.struct("low", "high", "r")).alias("rounds"))
    fits = lambda x: (F.col("pos") > x["low"]) & (x["high"].isNull() | (F.col("pos") <= x["high"])) & (F.col("_n") <= x["r"]) & ((F.col("_n") * 2 <= x["r"]) | F.coalesce(F.col("pos") == x["high"], F.lit(False)))
    return rows.join(taken, "_g").where(F.exists("rounds", fits)).select("pos")


def carried(rows: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of placed() with each of the columns filled by its last value that isn't null, up to and with the row itself, in its group.

    A chunk holds its rows of a group together; the last values of the chunks before it come from one row a chunk.
    """
    g = F.struct(*group)
    within = Window.partitionBy("_g", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("_g").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_g", g)
    ends = rows.groupBy("_g", "chunk").agg(*(F.max_by(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"))), F.when(F.col(c).isNotNull(), F.col("pos"))).alias(f"_{c}") for c in columns))
    ends = ends.select("_g", "chunk", *(F.last(f"_{c}", ignorenulls=True).over(across).alias(f"_{c}") for c in columns))
    filled = rows.select("*", *(F.last(c, ignorenulls=True).over(within).alias(f"_own_{c}") for c in columns)).join(ends, ["_g", "chunk"])
    out = filled.select(*[F.coalesce(f"_own_{c}", F.col(f"_{c}")["v"]).alias(c) if c in columns else F.col(c) for c in rows.columns if c != "_g"])
    return out


def numbered(rows: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    """Rows of placed() with their place in their group, from 1, in a column `name`."""
    g = F.struct(*group)
    within = Window.partitionBy("_g", "chunk").orderBy("pos")
    across = Window.partitionBy("_g").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_g", g)
    before = rows.groupBy("_g", "chunk").agg(F.count("*").alias("_n")).select("_g", "chunk", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    return rows.withColumn(name, F.row_number().over(within)).join(before, ["_g", "chunk"]).withColumn(name, F.col(name) + F.col("_before")).drop("_g", "_before")


def following(rows: DataFrame, group: Sequence[str], column: str, name: str) -> DataFrame:
    """Rows of placed() with the value of a column in the next row of their group, in a column `name`; null for the last row."""
    within = Window.partitionBy("_g", "chunk").orderBy("pos")
    after = Window.partitionBy("_g").orderBy("chunk")
    rows = rows.withColumn("_g", F.struct(*group))
    first = rows.groupBy("_g", "chunk").agg(F.min_by(F.struct(F.col(column).alias("v")), "pos").alias("_first")).select("_g", "chunk", F.lead("_first").over(after).alias("_next"))
    out = rows.withColumn("_own", F.lead(F.struct(F.col(column).alias("v"))).over(within)).join(first, ["_g", "chunk"])
    return out.withColumn(name, F.coalesce("_own", "_next")["v"]).drop("_g", "_own", "_next")
