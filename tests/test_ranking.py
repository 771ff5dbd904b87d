"""Scores, classes and tags: odd and small inputs."""

from pyspark.sql import functions as F

from quarry.functions import ranking as rk


def _one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_similarity_of_texts(spark):
    s = [rk.text_similarity(F.lit(a), F.lit(b)) for a, b in ((" A b", "a B "), ("get user", "user"), ("a b c", "b c d"), ("x", "y"))]
    assert [tuple(r) for r in _one(spark, *s)] == [(True, 1.0, 1.0), (False, 0.8, 0.5), (False, 0.0, 0.5), (False, 0.0, 0.0)]


def test_classes(spark):
    specs = ["", None, "{x}", "./a", "/a", "App\\Models", "a/b\\c", "react", "a\nb", "x|class:y"]
    assert _one(spark, *[rk.specifier_class(F.lit(x).cast("string")) for x in specs]) == ("junk", "junk", "junk", "path", "path", "namespace", "path", "bare", "junk", "junk")
    assert _one(spark, rk.architectural_layer(F.lit("src/UserService.ts"), F.lit(None).cast("string")), rk.architectural_layer(F.lit("a"), F.lit("b"))) == ("service", None)
    tags = ["lang:en", "context:x", "regenerated", "mine", None]
    assert _one(spark, *[rk.tag_class(F.lit(x).cast("string")) for x in tags]) == ("auto", "contextual", "auto", "stable", None)


def test_tags_and_templates(spark):
    got = _one(spark, rk.auto_tags(F.lit("#Bug in the API #x #x")), rk.pattern_tags(F.lit("createBuilder")), rk.rendered(F.lit("{{a}}{{b}}"), {"a": F.lit("1"), "b": F.lit("")}))
    assert got == (["bug", "x", "api"], ["Factory", "Builder"], "1{{b}}")


def test_summaries_and_highlights(spark):
    got = _one(spark, rk.summarised(F.lit("short."), 20), rk.summarised(F.lit("One. Two. " + "x" * 40), 20), rk.summarised(F.lit("y" * 40), 10), rk.highlights(F.lit("A cat! No. Cats?cat. cat"), ["CAT"]), rk.estimated_tokens(F.lit(None).cast("string"), "json"))
    assert got == ("short.", "One. Two....", "yyyyyyy...", ["A cat", "Cats", "cat"], 0)


def test_vectors_and_scores(spark):
    v, again, c = _one(spark, rk.hash_vector(F.lit("a")), rk.hash_vector(F.lit("a")), rk.rule_confidence(F.lit(1.0), F.lit(11)))
    assert v == again and abs(sum(x * x for x in v) - 1) < 1e-9 and abs(c - 0.525) < 1e-12
