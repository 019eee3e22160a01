"""Vector functions on array<float> columns, in double precision, as native Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if either is null or the widths differ."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a norm is zero or the widths differ. NaN stays NaN: see at_least."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def at_least(score: Column, threshold: float) -> Column:
    """score >= threshold, false for null and for NaN (which Spark orders above every number)."""
    return score.isNotNull() & ~F.isnan(score) & (score >= threshold)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def state(v: Column, width: int) -> Column:
    """'null', 'empty', 'width', 'nan' (also null components), 'zero' or 'ok'."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return (
        F.when(v.isNull(), "null").when(F.size(v) == 0, "empty").when(F.size(v) != width, "width").when(bad, "nan").when(~F.exists(v, lambda x: x != 0), "zero").otherwise("ok")
    )


def signature(v: Column) -> Column:
    """The components in thousandths, rounded half to even in single precision, every `size div 1000`-th of wide vectors.

    Vectors with equal signatures count as the same vector.
    """
    step = F.greatest(F.lit(1), F.floor(F.size(v) / 1000).cast("int"))
    sampled = F.filter(v, lambda x, i: i % step == 0)
    return F.transform(sampled, lambda x: F.rint(x.cast("float") * F.lit(1000).cast("float")) + 0.0)


def parsed(text: Column) -> Column:
    """'[a,b,c]' to array<float>; null if the text has another form or any part is not a number."""
    parts = F.split(F.regexp_extract(text, r"^\s*\[([^\[\]]*)\]\s*$", 1), ",")
    numbers = F.transform(parts, lambda x: F.trim(x).try_cast("float"))
    return F.when(text.rlike(r"^\s*\[[^\[\]]+\]\s*$") & ~F.exists(numbers, lambda x: x.isNull()), numbers)
