"""Topics that a run opens, query modifiers, patterns and ends of edges on literal frames."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import boolean_search, mining
from quarry.operators import entities as ops


def _cosine(a, b):
    dot, n = sum(x * y for x, y in zip(a, b, strict=True)), (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    return dot / n if n else 0.0


@pytest.mark.parametrize("block", [4, 100])
def test_topics_opened_in_the_run_take_later_queries(spark, block):
    r = random.Random(2)
    queries = [(k, [r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 0.3)]) for k in range(25)] + [(30, [0.0, 0.0, 0.0]), (31, [0.0, 0.0, 0.0])]
    known = [("old", [1.0, 0.0, 0.0]), ("older", [0.9, 0.1, 0.0])]
    want, topics = set(), list(known)
    for k, v in queries:
        near = sorted(((-_cosine(v, t), name) for name, t in topics if _cosine(v, t) >= 0.7))[:2]
        want |= {(k, name) for _, name in near}
        if not near:
            topics.append((f"topic-{k}", v))
            want.add((k, f"topic-{k}"))
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name}, v array<double>")
    got = ops.detected_topics(frame(queries, "id int").repartition(4), frame(known, "topic string"), 0.7, 2, block=block).collect()
    assert {(x.id, x.topic) for x in got} == want and sum(x.is_new for x in got) == len(topics) - 2
    assert ops.detected_topics(frame(queries, "id int").limit(0), frame(known, "topic string")).count() == 0
    assert ops.detected_topics(frame(queries[:3], "id int"), frame(known, "topic string").limit(0)).where("is_new").count() >= 1


def test_modifiers(spark):
    rows = spark.createDataFrame([("Parser", "class", "TypeScript", "src/parse/a.ts"), ("parser", "method", "python", "lib/b.py"), ("my parser", None, None, None)], "name string, type string, language string, path string")
    found = lambda q, **kw: [x.name for x in rows.where(boolean_search.compile_query(q, ["name"], **kw)).collect()]
    assert found("exact:Parser") == ["Parser"] and found("exact:'my parser'") == ["my parser"] and found("like:PARS_R") == ["Parser", "parser", "my parser"]
    assert found("lang:typescript") == ["Parser"] and found("type:METHOD parser") == ["parser"] and found('file:"SRC/"') == ["Parser"] and found("NOT lang:python") == ["Parser", "my parser"]
    assert found("semantic:x", semantic=lambda v: F.col("name").startswith("my")) == ["my parser"] and found("semantic:my") == ["my parser"]
    assert found("other:parser") == []
    assert boolean_search.terms('a AND "b c" OR NOT lang:TS (a d)') == ["a", "b c", "TS", "d"]
    for bad in ("", "a AND", '"open', "(a", "NOT NOT a", "AND a"):
        with pytest.raises(boolean_search.QueryError):
            boolean_search.compile_query(bad, ["name"])


def test_mining_on_literal_frames(spark):
    edges = spark.createDataFrame([(1, "RESOLVE:a", None, None), (2, "RESOLVE:a", None, "{}"), (3, "RESOLVE:a", None, '{"isExternal": false}'), (4, "RESOLVE:a", None, '{"isExternal": true}'), (5, "RESOLVE:a", "x", None), (6, "a", None, None), (7, None, None, None)], "id int, dst string, resolved_dst string, metadata string")
    assert [r.id for r in mining.unresolved(edges).orderBy("id").collect()] == [1, 3]
    scripts = spark.createDataFrame([("d", 1, 1, None, None), ("d", 2, 2, True, None), ("d", 3, 3, None, True), ("d", 4, 4, False, False), ("e", 5, 1, None, None)], "doc string, id int, place int, is_async boolean, is_defer boolean")
    assert [tuple(r) for r in mining.blocking_scripts(scripts).collect()] == [(4, 1)]
    assert [mining.entity_of_id(x) for x in ("task_12", " note_a ", "rule_", "component_1", "task_1 more", "plain")] == ["task", "note", None, None, None, None]
    rules = spark.createDataFrame([(1, 5, 0.5, "2024-01-01"), (2, 1, None, None)], "id int, usage_count int, effectiveness double, last_used string").withColumn("last_used", F.to_timestamp("last_used"))
    none = spark.createDataFrame([], "id int, rule_id int, action string, feedback double, applied_at timestamp")
    got = {r.id: r for r in mining.rule_analytics(rules, none, spark.createDataFrame([(1, 2, "conflicts"), (1, 1, "conflicts"), (1, 2, "other")], "parent int, child int, type string"), F.expr("timestamp'2024-01-11 12:00:00'")).collect()}
    assert (got[1].conflicts, got[1].applications, got[1].acceptance, got[1].days_since) == (2, 0, None, 10) and (got[2].conflicts, got[2].days_since) == (1, None)


def test_mail_patterns_take_time_in_proportion(spark):
    df = spark.createDataFrame([("x" * 300_000 + " a.b@c.de_f@g.hi",)], "t string")
    assert df.select(tx.normalised(F.col("t"))).first()[0] == "x" * 300_000
    assert df.select(tx.cleaned(F.col("t"), emails=True, urls=False)).first()[0].endswith("x @g.hi")
