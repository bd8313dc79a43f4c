"""Synthetic attribute columns: inverse distribution functions over a uniform column, and their histogram."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectile.functions.vectors import hash_uniform


def uniform_attribute(u: Column, lower: float, upper: float) -> Column:
    """Integers in [lower, upper), truncated towards zero."""
    return (F.lit(float(lower)) + F.lit(float(upper - lower)) * u).cast("int")


def geometric_attribute(u: Column, p: float) -> Column:
    """Number of trials up to the first success; the support starts at 1."""
    return F.greatest(F.lit(1), F.ceil(F.log(1 - u) / F.log(F.lit(1.0 - p))).cast("int"))


def normal_attribute(u: Column, v: Column, mean: float, std: float) -> Column:
    """Normal by Box-Muller from two uniforms, truncated towards zero."""
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)
    return (F.lit(float(mean)) + F.lit(float(std)) * z).cast("int")


def with_uniform_attributes(
    df: DataFrame, attrs: Sequence[str], maximum: int, key: str = "id", seed: int = 584, uniform: Callable[[Column, int], Column] | None = None
) -> DataFrame:
    """One independent uniform attribute in [0, maximum) per name; ``uniform`` maps (key, stream) to numbers in (0, 1)."""
    draw = uniform or (lambda k, stream: hash_uniform(k, stream, seed))
    columns = {a: uniform_attribute(draw(F.col(key), i), 0, maximum) for i, a in enumerate(attrs)}
    return df.withColumns(columns)


def histogram(df: DataFrame, attr: str, lower: int, upper: int, width: int) -> DataFrame:
    """Counts per bin over the edges lower, lower + width, ..., below upper.

    The last edge belongs to the last bin; values outside the edges are not counted.
    """
    edges = list(range(lower, upper, width))
    last = len(edges) - 2
    x = F.col(attr)
    bin_no = F.least(F.floor((x - lower) / width), F.lit(last))
    return (
        df.filter(x.between(edges[0], edges[-1]))
        .groupBy(bin_no.cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
        .select("bin", (F.lit(lower) + F.col("bin") * width).alias("lo"), "n")
    )
