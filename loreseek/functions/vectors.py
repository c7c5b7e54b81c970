"""8-bit quantised vectors and their cosine, in single precision where the index format has it.

Spark widens mixed arithmetic to double, so each single-precision step is cast back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantize(vector: Column) -> Column:
    """struct<q_min, q_scale, q_data>: 256 levels between a vector's least and greatest component."""
    low, high = F.array_min(vector), F.array_max(vector)
    spread = F.when(high == low, F.lit(1.0).cast("float")).otherwise(high - low)
    scale = (spread / F.lit(255.0)).cast("float")
    level = lambda v, low, scale: F.greatest(F.lit(-128), F.least(F.lit(127), F.rint(((v - low) / scale).cast("float")).cast("int") - 128)).cast("tinyint")
    # The bounds are fields of a one-element array, so that they are found once and not once per component.
    bounds = F.array(F.struct(low.alias("q_min"), scale.alias("q_scale"), vector.alias("v")))
    return F.transform(bounds, lambda b: F.struct(b["q_min"].alias("q_min"), b["q_scale"].alias("q_scale"), F.transform(b["v"], lambda v: level(v, b["q_min"], b["q_scale"])).alias("q_data")))[0]


def dequantize(low: Column, scale: Column, data: Column) -> Column:
    return F.transform(data, lambda q: ((q.cast("int") + 128).cast("float") * scale).cast("float") + low)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def cosine(query: Column, vector: Column) -> Column:
    """Cosine of two single-precision vectors, summed in double precision; 0 where either has no length."""
    dot = _sum(F.zip_with(query, vector, lambda x, y: (x * y).cast("float").cast("double")))
    own = _sum(F.transform(vector, lambda y: (y * y).cast("float").cast("double")))
    asked = _sum(F.transform(query, lambda x: x.cast("double") * x.cast("double")))
    length = F.sqrt(asked) * F.sqrt(own)
    return F.when(length > 0, dot / length).otherwise(F.lit(0.0))


def cosine_quantized(query: Column, low: Column, scale: Column, data: Column) -> Column:
    """Cosine against a quantised vector, which is expanded once."""
    return F.transform(F.array(dequantize(low, scale, data)), lambda v: cosine(query, v))[0]


def literal(vector: Sequence[float]) -> Column:
    return F.lit([float(x) for x in vector]).cast("array<float>")
