"""Vector expressions: normalising, int8 codes and cosines, all by higher-order functions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, cut off at 0; null where a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.greatest(dot(a, b) / n, F.lit(0.0)))


def scale(a: Column) -> Column:
    """Scale of the int8 codes of a normalised vector: its largest component over 127; 1 for the zero vector."""
    n = norm(a)
    peak = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    return F.when(peak > 0, peak / n / 127.0).otherwise(1.0)


def codes(a: Column) -> Column:
    """int8 codes of the normalised vector, rounded half to even and clipped."""
    n, s = norm(a), scale(a)
    code = lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x.cast("double") / n / s)))
    return F.when(n > 0, F.transform(a, lambda x: code(x).cast("tinyint"))).otherwise(F.transform(a, lambda x: F.lit(0).cast("tinyint")))


def restored(code: Column, s: Column) -> Column:
    return F.transform(code, lambda x: x.cast("double") * s)
