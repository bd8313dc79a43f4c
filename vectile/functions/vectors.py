"""Vector expressions and deterministic pseudo-random numbers, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision, summed from left to right."""
    terms = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.reduce(terms, F.lit(0.0), lambda total, term: total + term)


def as_float_vector(v: Column) -> Column:
    return v.cast("array<float>")


def hash_uniform(key: Column, stream: int | Column, seed: int = 584) -> Column:
    """Uniform number in (0, 1) that depends on (seed, stream, key) alone.

    Unlike ``rand`` it does not depend on partitioning, so a task that is run again
    after an executor loss draws the same numbers.
    """
    stream = F.lit(stream) if isinstance(stream, int) else stream
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), stream, key), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))
