"""Filter interaction audit: what five quality filters remove, alone, together and in every order.

Words are exploded and counted by (doc_id, word), then by document for totals and distinct words; the
other flags are joined to them, and 32 conditional counts a source (one for each set of failed
filters) hold all that the orders, their steps and the Shapley sums need.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_or_empty

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_BLANKS = r"[\x20\x09-\x0D]+"
#: Documents with a known id stand for themselves; without one they share this key, beside their text's hash.
_NO_ID = 0


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(_NO_ID)).alias("word_id"), text.alias("text"), F.xxhash64(text).alias("text_key"), F.unhex(F.sha2(text, 256)).alias("digest"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))


def word_totals(docs: DataFrame) -> DataFrame:
    """word_id, text_key, n_words, n_distinct of each document that has words.

    Texts are dealt once by (doc_id, hash of the text), rows that repeat both only once; the counts by
    word and by document need no other shuffle, as both keys begin with that one.
    """
    words = _keyed(docs).select("word_id", "text_key", "text").dropDuplicates(["word_id", "text_key"]).select("word_id", "text_key", F.explode(F.split("text", _BLANKS)).alias("word")).where(F.col("word") != "")
    by_word = words.groupBy("word_id", "text_key", "word").agg(F.count("*").alias("n"))
    return by_word.groupBy("word_id", "text_key").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, n, good, toxic, mask: how many rows of a part fail the same filters, by document.

    mask has bit 0 for A (under 200 words) to bit 4 for E (the text of a smaller doc_id). A null id is
    neither smaller nor larger than another, so E is false there, as it is for rows that repeat both id
    and text. Labels that repeat an id count as good (toxic) where any of them says so.
    """
    keyed = _keyed(docs)
    letters = F.regexp_count("text", F.lit("[A-Z]")) * 100 > F.char_length("text") * 2
    rows = keyed.select("doc_id", "word_id", "text_key", "digest", "part", letters.alias("c"), F.col("text").rlike("[#$%&*|]").alias("d"))
    rows = rows.groupBy("doc_id", "word_id", "text_key", "digest", "part", "c", "d").agg(F.count("*").alias("n"))
    first = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where(F.col("doc_id").isNotNull()).withColumn("first", F.lit(True))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    joined = rows.join(word_totals(docs), ["word_id", "text_key"], "left").join(first, ["digest", "doc_id"], "left").join(marked, "doc_id", "left")
    words, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    fails = {"A": words < 200, "B": distinct * 100 < words * 50, "C": F.col("c"), "D": F.col("d"), "E": F.col("doc_id").isNotNull() & F.col("first").isNull()}
    mask = sum((F.when(fails[x], _bit(x)).otherwise(0) for x in FILTERS), F.lit(0))
    return joined.select("part", "n", *(F.coalesce(F.col(x), F.lit(0)).alias(x) for x in ("good", "toxic")), mask.alias("mask"))


def _sum_where(counts: str, test) -> Column:
    """The sum of those of 32 counts whose set of failed filters passes a test."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda total, m: total + F.when(test(m), F.get(F.col(counts), m)).otherwise(0))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part (source; null: the empty string), order of the five filters and step, zeros
    included; no rows where docs is empty. shapley is the filter's removed summed over all orders: of n
    failed filters, each comes first in 120 / n of them.
    """
    rows = failures(docs, labels)
    masks = range(1 << len(FILTERS))
    n = {"all": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    counts = rows.groupBy("part").agg(*(F.sum(F.when(F.col("mask") == m, x).otherwise(0)).alias(f"{name}{m}") for name, x in n.items() for m in masks))
    counts = counts.select("part", *(F.array(*(F.col(f"{name}{m}") for m in masks)).alias(name) for name in n))
    steps = counts.select("*", F.explode(F.split(F.lit(",".join(ORDERS)), ",")).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda at: F.call_function("shiftleft", F.lit(1), F.ascii(F.substr("filter_order", at, F.lit(1))) - ord(FILTERS[0]))
    before = F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda k: k < F.col("step")), F.lit(0), lambda total, k: total + bit(k))
    steps = steps.select("*", bit(F.col("step")).alias("own"), before.alias("before"))
    fails, earlier = (lambda m: m.bitwiseAND(F.col("own")) != 0), (lambda m: m.bitwiseAND(F.col("before")) != 0)
    removed = lambda m: fails(m) & ~earlier(m)
    shapley = F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.lit(0).cast("long"), lambda total, m: total + F.when(fails(m), F.get(F.col("all"), m) * F.floor(F.lit(len(ORDERS)) / F.bit_count(m))).otherwise(0))
    return steps.select("part", "filter_order", "step", _sum_where("all", lambda m: ~fails(m) & ~earlier(m)).alias("kept"), _sum_where("all", removed).alias("removed"), _sum_where("all", lambda m: fails(m) & earlier(m)).alias("redundant"), F.get(F.col("all"), F.col("own")).alias("unique_fails"), _sum_where("good", removed).alias("good_lost"), _sum_where("toxic", removed).alias("toxic_lost"), shapley.alias("shapley"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS word FROM d),
c AS (SELECT r, count(*) AS words, count(DISTINCT word) AS kinds FROM w GROUP BY r),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.r, part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
        map {'A': coalesce(words, 0) < 200, 'B': 100 * coalesce(kinds, 0) < 50 * coalesce(words, 0),
             'C': 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t), 'D': regexp_matches(t, '[#$%&*|]'),
             'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)} AS fails
      FROM d LEFT JOIN c USING (r) LEFT JOIN l ON d.doc_id = l.doc_id),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM a, a b, a c, a d, a e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
every AS (SELECT f.*, filter_order, step, fails[substr(filter_order, step, 1)] AS own FROM f, s),
late AS (SELECT *, min(CASE WHEN own THEN step END) OVER (PARTITION BY r, filter_order) AS gone FROM every),
n AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, count(*) FILTER (gone IS NULL OR gone > step) AS kept, count(*) FILTER (gone = step) AS removed,
        count(*) FILTER (own AND gone < step) AS redundant, count(*) FILTER (own AND list_sum(CAST(map_values(fails) AS INTEGER[])) = 1) AS unique_fails,
        count(*) FILTER (gone = step AND good) AS good_lost, count(*) FILTER (gone = step AND toxic) AS toxic_lost
      FROM late GROUP BY ALL)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM n
"""
