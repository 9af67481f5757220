"""Vectors as arrays: products, cosine, and 8-bit quantisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def quantize(v: Column) -> Column:
    """(scale, q): q * scale is near v, with q in -127..127; a zero vector has scale 1."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(F.lit(1.0))
    q = F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / scale))).cast("tinyint"))
    return F.struct(scale.alias("scale"), q.alias("q"))


def quantized_dot(query: Column, packed: Column) -> Column:
    return dot(query, packed["q"]) * packed["scale"]
