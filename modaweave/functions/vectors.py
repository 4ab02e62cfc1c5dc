"""Row-level vector expressions on ARRAY columns (all stay in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` (a lambda would re-evaluate it)."""
    return F.transform(F.array(value), body)[0]


def as_doubles(v: str | Column) -> Column:
    return _c(v).cast("array<double>")


def vsum(v: str | Column) -> Column:
    return F.aggregate(as_doubles(v), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm1(v: str | Column) -> Column:
    return F.aggregate(as_doubles(v), F.lit(0.0), lambda acc, x: acc + F.abs(x))


def norm2(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def norm_max(v: str | Column) -> Column:
    return F.array_max(F.transform(as_doubles(v), F.abs))


def divide_unless_zero(v: str | Column, by: Column) -> Column:
    """Scale a vector; a zero divisor leaves the row as it is."""
    return F.when(by == 0.0, as_doubles(v)).otherwise(F.transform(as_doubles(v), lambda x: x / by))


def cosine(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(dot(a, b), norm2(a) * norm2(b))


def squared_gap(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(
        F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x
    )


def is_clean(v: str | Column) -> Column:
    """No null, NaN or infinite entry."""
    return ~F.exists(as_doubles(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def nan_to(v: str | Column, value: float = 0.0) -> Column:
    return F.transform(as_doubles(v), lambda x: F.when(x.isNull() | F.isnan(x), F.lit(value)).otherwise(x))


def zero_if_unclean(v: str | Column) -> Column:
    """Whole row becomes zeros when any entry is not finite."""
    return F.when(is_clean(v), as_doubles(v)).otherwise(F.transform(as_doubles(v), lambda _: F.lit(0.0)))


def weighted(v: str | Column, weights: Column) -> Column:
    return F.zip_with(as_doubles(v), as_doubles(weights), lambda x, w: x * w)


def bits_above(v: str | Column, threshold: float = 0.0) -> Column:
    return F.transform(as_doubles(v), lambda x: (x > threshold).cast("tinyint"))


def bits_from_text(text: str | Column) -> Column:
    """Parse a string of 0/1 characters into a bit array."""
    return F.transform(F.split(_c(text), ""), lambda ch: ch.cast("tinyint"))


def bit_total(bits: str | Column) -> Column:
    return F.aggregate(_c(bits), F.lit(0), lambda acc, x: acc + x.cast("int"))


def tanimoto(a: str | Column, b: str | Column) -> Column:
    """Shared bits over united bits; the union is clamped at 1e-8."""
    both = F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda acc, x: acc + x
    )
    union = bit_total(a) + bit_total(b) - both
    return both.cast("double") / F.greatest(union.cast("double"), F.lit(1e-8))


def spread(v: str | Column, prefix: str, width: int) -> list[Column]:
    """Named scalar columns ``prefix0 .. prefix{width-1}`` for flat sinks."""
    return [_c(v)[i].alias(f"{prefix}{i}") for i in range(width)]
