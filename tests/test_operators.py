"""Operators on small literal frames."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions import vector as vec
from quarry.operators import boolean_search, edges, graph


def test_cosine_edge_cases(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 1.0]), (2, [0.0, 0.0], [1.0, 1.0]), (3, [1.0], [1.0, 1.0]), (4, [2.0, 2.0], [1.0, 1.0])], "id int, a array<double>, b array<double>")
    got = {r.id: r.c for r in rows.select("id", vec.cosine(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got[1] == 0 and got[2] == 0 and got[3] == 0 and got[4] == pytest.approx(1)


def test_boolean_query_precedence_and_errors(spark):
    rows = spark.createDataFrame([("storage",), ("storage_update",), ("timestamp",), ("update",), (None,)], "name string")
    assert [r.name for r in rows.where(boolean_search.compile_query("storage AND (update OR timestamp)", ["name"])).collect()] == ["storage_update"]
    assert rows.where(boolean_search.compile_query("storage NOT update", ["name"])).count() == 1
    for bad in ("a AND", "(a", "OR", "a )", '"a'):
        with pytest.raises(boolean_search.QueryError):
            boolean_search.compile_query(bad, ["name"])


def test_evidence_of_two_sources(spark):
    rows = spark.createDataFrame([("a", "b", 4, 0.8, 0), ("a", "b", 3, 0.9, 0), ("c", "d", 2, 0.5, 10), ("c", "d", 2, 0.3, 30), ("x", "y", 4, 0.9, 200)], "src string, dst string, precedence int, confidence double, age_days int")
    got = {r.src: r for r in edges.aggregate_evidence(rows, ["src", "dst"]).collect()}
    assert (got["a"].confidence, got["a"].consensus, got["a"].lowest, got["a"].highest, got["a"].pieces) == (0.92, 0.9975, 0.8, 0.9, 2)
    assert got["c"].confidence == 0.432 and got["x"].confidence == 0  # (.5 + .02 + .02) * .8; 200 days take all


def test_cycles_and_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("z", "z")], "src string, dst string")
    assert sorted(">".join(r.cycle) for r in graph.cycles(e, 4).collect()) == ["a>b>c>a", "z>z"]
    labels = {r.node: r.component for r in graph.label_components(e).collect()}
    assert labels == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "z": "z"}


def test_reach_counts_least_hops(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "src string, dst string")
    got = {r.node: r.depth for r in graph.reach(spark.createDataFrame([("a",)], "node string"), e, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_text_functions(spark):
    row = spark.createDataFrame([("<p>a &amp; b<br>c</p><script>x</script>", "getUserById2", "")], "html string, name string, empty string")
    got = row.select(tx.html_text(F.col("html")).alias("h"), tx.identifier_words(F.col("name")).alias("w"), tx.char_ngrams(F.col("empty")).alias("g"), tx.name_match(F.col("name"), "getuser").alias("m"), tx.jaccard(tx.char_ngrams(F.col("empty")), tx.char_ngrams(F.col("empty"))).alias("j")).first()
    assert got.h == "a & b\nc" and got.w == ["get", "user", "by", "id", "2"] and got.g == [] and got.m == 0.75 and got.j == 1
