"""Source divergence, filter interaction and toxicity: SQL twins, plain versions, odd inputs and held-out accuracy."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations, permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import divergence, filter_audit, queries, toxicity
from tests import oracle

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, n string, term string, item string, rank string, y string"


@pytest.fixture(scope="module")
def odd():
    r = random.Random(4)
    words = ["Alpha", "béta", "GAMMA", "x1y", "日本", "the", "of", "$5", "a|b", "Zeta"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    many = " ".join(f"word{k}" for k in range(250))
    copied = prose(12)
    rows = [(1, None, "en", "s1"), (2, "", "en", "s2"), (3, " \n\t ", None, None), (4, prose(300), "en", "s1"), (5, many, "en", "s2"), (6, copied, "en", "s1"), (7, copied, "en", "s3"), (7, copied, "en", "s3"), (None, copied, "en", "s2"), (None, copied, "fr", None), (8, copied, None, "s1"), (8, "other text", "fr", "s1"), (9, "A" * 30, "", ""), (10, "\x00 　 日本\x85the of", "fr", "s4"), (11, prose(40), "fr", "s1"), (12, prose(40), "fr", "s4"), (13, prose(40), "fr", "s4"), (14, "1 2 3", "xx", "s9"), (15, "4 5", "xx", "s8")]
    return [(*x, 0, *["clash"] * 6) for x in rows]


LABELS = [(4, 1, 0), (4, 0, 1), (6, 1, 1), (7, 1, 0), (8, 0, 1), (9, None, None), (None, 1, 1), (99, 1, 1)]


def frames(spark, odd):
    return spark.createDataFrame(odd, DOCS), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def duck(odd):
    con = duckdb.connect()
    names = [c.split()[0] for c in DOCS.split(", ")]
    docs = pa.table({c: pa.array([r[k] for r in odd], pa.int64() if c in ("doc_id", "n_chars") else pa.string()) for k, c in enumerate(names)})
    labels = pa.table({c: pa.array([r[k] for r in LABELS], pa.int64()) for k, c in enumerate(("doc_id", "quality", "toxic"))})
    con.register("documents", docs)
    con.register("labels", labels)
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert oracle.difference(queries.queries()[name](spark, SF), oracle.connection(SF), queries.oracle_sql()[name]) == ""


def test_divergence_of_odd_rows(spark, odd):
    docs, _ = frames(spark, odd)
    assert oracle.difference(divergence.divergence(docs), duck(odd), divergence.SQL) == ""
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_a_crowded_sketch_changes_nothing(spark, odd):
    docs, _ = frames(spark, odd)
    assert oracle.difference(divergence.divergence(docs, depth=1, width=1 << 16), duck(odd), divergence.SQL) == ""


def test_sketch_never_underestimates_and_leaves_out_most_rare_terms():
    r = random.Random(2)
    counts = Counter(int(r.paretovariate(0.8)) for _ in range(60_000))
    counts = {b"t%d" % k: n for k, n in counts.items()}
    sketch = divergence.Sketch(4, 1 << 16, 3)
    for part in range(3):
        sketch.add("en", {t: n for k, (t, n) in enumerate(counts.items()) if k % 3 == part})
    possible = sketch.possible("en", list(counts))
    assert all(ok for ok, n in zip(possible, counts.values(), strict=True) if n >= 3)
    rare = [ok for ok, n in zip(possible, counts.values(), strict=True) if n < 3]
    assert sum(rare) < len(rare) * 0.2
    assert not sketch.possible("fr", [b"never seen %d" % k for k in range(50)]).all()


def test_terms_do_not_depend_on_slabs(monkeypatch):
    body = ("Alpha béta x1y 日本 " * 40).encode()
    plain = re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", body.lower())
    monkeypatch.setattr(divergence, "_SLAB", 7)
    assert [t for part in divergence.terms(body) for t in part] == plain


def test_tallies_of_odd_texts_and_slabs(odd, monkeypatch):
    rows = [(lang or "", source or "", (text or "").encode()) for _, text, lang, source, *_ in odd] + [("en", "s1", b" the  of "), ("en", "s1", b"")]
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], names=["lang", "source", "body"]) for part in (rows[:9], rows[9:])])
    n, docs = Counter(), Counter()
    for lang, source, body in rows:
        found = re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", body.lower())
        n.update((lang, source, t.decode()) for t in found)
        docs.update((lang, source, t.decode()) for t in set(found))
    for held, slab in ((1 << 24, 1 << 23), (200, 1 << 23), (1 << 24, 50), (1, 1)):
        monkeypatch.setattr(divergence, "_HELD", held)
        monkeypatch.setattr(divergence, "_SLAB", slab)
        got_n, got_docs = Counter(), Counter()
        for t in divergence.tallies(batches(), ("lang", "source")):
            for g, k, d, m in zip(t.group, t.terms.take(pa.array(t.term)).to_pylist(), t.docs, t.n, strict=True):
                got_n[*t.groups[g], k] += int(m)
                got_docs[*t.groups[g], k] += int(d)
        assert got_n == n and got_docs == docs
        by_lang = Counter()
        for t in divergence.tallies(batches(), ("lang",), occurrences=False):
            assert (np.diff(t.group) >= 0).all()
            for g, k, d in zip(t.group, t.terms.take(pa.array(t.term)).to_pylist(), t.docs, strict=True):
                by_lang[*t.groups[g], k] += int(d)
        assert by_lang == sum((Counter({(lang, t): d}) for (lang, _, t), d in docs.items()), Counter())


def test_a_task_counts_texts_of_few_groups_and_shares_large_ones(spark):
    rows = spark.range(4000, numPartitions=4).selectExpr("id AS doc_id", "'en' AS lang", "if(id % 2 = 0, 'large', concat('s', id % 79)) AS source", "'same text' AS text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = divergence._dealt(rows).rdd.mapPartitions(lambda part: [Counter(r.source for r in part)]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks, Counter()) == Counter(r.source for r in rows.select("source").collect())
    assert sum(len(t) for t in tasks) <= 80 + 8
    assert max(sum(t.values()) for t in tasks) < 1000 and max(t["large"] for t in tasks) < 1000


def test_exact_probabilities_of_large_counts(spark):
    rows = spark.createDataFrame([(10**13, 3 * 10**13 + 7), (0, 10**12)], "n long, size long")
    assert [r[0] for r in rows.select(divergence._probability("n", "size")).collect()] == [1 + 10**9 * (10**13 + 1) // (3 * 10**13 + 7), 1]


def plain_audit(odd):
    firsts, good, toxic = {}, {d for d, q, _ in LABELS if q == 1}, {d for d, _, t in LABELS if t == 1}
    for doc_id, text, *_ in odd:
        if doc_id is not None:
            firsts[text or ""] = min(doc_id, firsts.get(text or "", doc_id))
    rows = []
    for doc_id, text, _, source, *_ in odd:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and firsts[text] < doc_id}
        rows.append((source or "", {k for k, v in fails.items() if v}, doc_id in good and doc_id is not None, doc_id in toxic and doc_id is not None))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                left = [r for r in mine if not r[1] & set(order[:step])]
                removed = [r for r in left if f in r[1]]
                shapley[part, f] += len(removed)
                out[part, "".join(order), step + 1] = (len(left) - len(removed), len(removed), sum(f in r[1] for r in mine) - len(removed), sum(r[1] == {f} for r in mine), sum(r[2] for r in removed), sum(r[3] for r in removed))
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_of_odd_rows(spark, odd):
    docs, labels = frames(spark, odd)
    got = filter_audit.audit(docs, labels)
    assert {tuple(r) for r in got.collect()} == plain_audit(odd)
    assert oracle.difference(got, duck(odd), filter_audit.SQL) == ""
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).count() == got.count()


def test_words_are_shuffled_with_their_text_only(spark, odd):
    docs, _ = frames(spark, odd)
    plan = filter_audit.word_totals(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_hashed_terms_are_words_and_stems(monkeypatch):
    rows = lambda text: np.concatenate([*toxicity.hashed_terms(text.encode()), np.zeros(0, np.int64)])
    assert len(rows("abc")) == 1 and len(rows("abcdefghij")) == 1 + len(toxicity.STEMS) and len(rows("12 ;")) == 0
    assert set(rows("Abcdefghij")) == set(rows("x abcdEFGHIJ!"))- set(rows("x"))
    assert len(set(rows("abcdefghij")) & set(rows("abcdefgzz"))) == 4  # the stems of 4 to 7 bytes
    text = "lorem ipsum dolor sit amet consectetur " * 20
    whole = sorted(rows(text))
    monkeypatch.setattr(toxicity, "_SLAB", 11)
    assert sorted(rows(text)) == whole


def test_machine_against_all_pairs_and_its_gradient():
    rng = np.random.default_rng(1)
    model = toxicity.Model(np.arange(toxicity.BUCKETS, dtype=np.int32), 0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    at, x = np.array([1, 4, 7, 11]), np.array([1.0, 2.0, 0.5, 1.5])
    pairs = sum(model.factors[at[i]] @ model.factors[at[j]] * x[i] * x[j] for i, j in combinations(range(4), 2))
    assert np.isclose(model.logit(at, x), 0.3 + model.linear[at] @ x + pairs)
    v = model.factors[at]
    slope = x[:, None] * (x @ v) - v * (x * x)[:, None]
    step = 1e-6
    for i, f in ((0, 0), (2, 3)):
        moved = toxicity.Model(model.place, model.bias, model.linear, model.factors.copy())
        moved.factors[at[i], f] += step
        assert np.isclose((moved.logit(at, x) - model.logit(at, x)) / step, slope[i, f], atol=1e-4)


def test_pairs_that_single_weights_cannot_tell():
    """Insult or group alone is fine, both together are not, beside other words; and two words that cancel each other."""
    r = random.Random(3)
    def text(*extra):
        return " ".join(r.sample([*(f"w{k}x" for k in range(30))], 8) + list(extra)).encode()
    rows = []
    for _ in range(400):
        for extra, y in (((), 1), (("insult", "group"), 1), (("insult",), 0), (("group",), 0)):
            rows.append((y, *toxicity.counted(text(*extra))))
    kept = sorted({int(k) for _, found, _ in rows for k in found})
    model, plain = toxicity.fit(kept, rows[:1200]), toxicity.fit(kept, rows[:1200], factors=0)
    right = lambda m: np.mean([(m.logit(m.place[k], toxicity._value(n)) > 0) == y for y, k, n in rows[1200:]])
    assert right(model) > 0.95 and right(plain) < 0.8


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF[:-1]}/{t}.parquet".replace("sf0.00", "sf0.01")) for t in ("documents", "labels"))
    rows = toxicity.predictions(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert not [r for r in rows if r.predicted and not r.toxic] and sum(r.predicted for r in rows) >= 0.6 * sum(r.toxic for r in rows)


def test_toxicity_of_odd_rows(spark, odd):
    docs, labels = frames(spark, odd)
    for marks in (labels, labels.limit(0), labels.where("toxic = 1")):
        rows = toxicity.predictions(docs, marks).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(x[0]) for x in odd) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.predictions(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.predictions(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.predictions(docs.withColumn("doc_id", docs.doc_id.cast("int")), labels).count() == len(odd)


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(200)] + [(k, f"text {k}") for k in range(2, 1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 1000, k % 1000 % 2) for k in range(2000)], "doc_id long, toxic int")
    rows = toxicity.sample(docs, labels, 2 * toxicity.SLICES).collect()
    counts = Counter(r.y for r in rows)
    assert 80 <= min(counts.values()) and max(counts.values()) <= 100 and len({r.place for r in rows}) == len(rows)
    assert len(toxicity.sample(docs, labels).collect()) == sum(zlib.crc32(str(k).encode()) % 5 > 0 for k in range(1, 1000))
