"""Column functions over array<double> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 for different lengths or a zero vector."""
    n = norm(a) * norm(b)
    value = F.least(F.greatest(dot(a, b) / n, F.lit(-1.0)), F.lit(1.0))
    return F.when((F.size(a) != F.size(b)) | (n == 0), F.lit(0.0)).otherwise(value)


def _same_length(a: Column, b: Column, value: Column, strict: bool) -> Column:
    wrong = F.raise_error(F.lit("vectors of different lengths")).cast("double") if strict else F.lit(float("inf"))
    return F.when(F.size(a) == F.size(b), value).when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(wrong)


def euclidean(a: Column, b: Column, strict: bool = False) -> Column:
    """Infinite for different lengths, with strict an error."""
    return _same_length(a, b, F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)), strict)


def manhattan(a: Column, b: Column, strict: bool = False) -> Column:
    """Infinite for different lengths, with strict an error."""
    return _same_length(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x), strict)


def cosine_strict(a: Column, b: Column) -> Column:
    """Cosine; null, empty and unlike vectors are errors, a zero vector gives 0."""
    wrong = a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(a) != F.size(b))
    return F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(F.lit("vectors have to be given, filled and of one length")).cast("double")).otherwise(cosine(a, b))


def l2_normalised(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    return F.when(norm(a) == 0, a).otherwise(F.transform(a, lambda x: x / norm(a)))


def squashed(z: Column) -> Column:
    """A z-score squashed to (0, 1)."""
    return 0.5 + 0.5 * F.tanh(z / 2)
