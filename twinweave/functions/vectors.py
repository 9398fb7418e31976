"""Vector expressions: cosine similarity, pixel scaling, colour tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squared_norm(v: Column | str) -> Column:
    """Sum of squares: float products, added one after another in double."""
    return F.aggregate(F.transform(_col(v), lambda x: (x * x).cast("double")), F.lit(0.0), lambda s, x: s + x)


def magnitude(v: Column | str) -> Column:
    return F.sqrt(squared_norm(v))


def dot(a: Column | str, b: Column | str) -> Column:
    """Products in the elements' own type, added one after another in double."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity, not clamped; 0 where a magnitude is 0; an error for a null vector or unequal lengths."""
    a, b = _col(a), _col(b)
    product = magnitude(a) * magnitude(b)
    value = F.when(product == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(product, F.lit(0.0)))
    return (
        F.when(a.isNull() | b.isNull(), F.raise_error(F.lit("a vector is null")).cast("double"))
        .when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double"))
        .otherwise(value)
    )


def has_features(v: Column | str) -> Column:
    """Whether a vector is there and not empty."""
    return F.coalesce(F.size(_col(v)) > 0, F.lit(False))


def scale_channel(value: Column | str, mean: float, std: float) -> Column:
    """(c / 255 - mean) * (1 / std) in float."""
    inverse = F.lit(1.0).cast("float") / F.lit(std).cast("float")
    scaled = (_col(value).cast("float") / F.lit(255.0).cast("float")).cast("float")
    return ((scaled - F.lit(mean).cast("float")).cast("float") * inverse.cast("float")).cast("float")


def colours_match(a: tuple, b: tuple, tolerance: Column | int) -> Column:
    """Whether each of red, green and blue differs by at most the tolerance."""
    tolerance = F.lit(tolerance) if isinstance(tolerance, int) else tolerance
    tests = [F.abs(_col(x).cast("int") - _col(y).cast("int")) <= tolerance for x, y in zip(a, b, strict=True)]
    return tests[0] & tests[1] & tests[2]


def pack_argb(a: Column | str, r: Column | str, g: Column | str, b: Column | str) -> Column:
    parts = [_col(x).cast("long") for x in (a, r, g, b)]
    return F.shiftleft(parts[0], 24).bitwiseOR(F.shiftleft(parts[1], 16)).bitwiseOR(F.shiftleft(parts[2], 8)).bitwiseOR(parts[3])


def unpack_argb(value: Column | str) -> list[Column]:
    """Alpha, red, green and blue of a packed colour."""
    return [F.shiftright(_col(value).cast("long"), s).bitwiseAND(F.lit(255)).cast("int") for s in (24, 16, 8, 0)]
