"""Exact quantiles by group with linear interpolation: one plan, whatever the number and the size of the groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectile.session import materialise


def slices_of(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(k, v, n, slice): the distinct values of every group with their counts, in slices of about equal numbers of values.

    Slices are ranges of (group, value) between splitters that Spark samples, so neither a large group nor values far from the others
    make a large slice; a frequent value is one row. ``k`` is the group as a struct, in which nulls are values like others.
    """
    group = F.struct(*[F.col(c) for c in keys]) if keys else F.struct(F.lit(0).alias("all"))
    freq = df.filter(F.col(value).isNotNull()).groupBy(group.alias("k"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    return freq.repartitionByRange("k", "v").withColumn("slice", F.spark_partition_id())


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """``keys`` and ``q``, an array with the quantile of every probability; groups without a value have no row.

    A quantile lies between two neighbouring ranks. Counts per group and slice tell which slices hold a wanted
    rank; only in those are values counted up to it.
    """
    placed = materialise(slices_of(df, keys, value))  # sampled splitters differ from run to run
    along = Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    sizes = placed.groupBy("k", "slice").agg(F.sum("n").alias("own"))
    spans = sizes.select("k", "slice", "own", (F.sum("own").over(along) - F.col("own")).alias("before"), F.sum("own").over(Window.partitionBy("k")).alias("total"))
    at = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), x.alias("at"), side(x).cast("bigint").alias("rank")) for i, x in enumerate(at) for side in (F.floor, F.ceil)])
    inside = lambda r: (r["rank"] >= F.col("before")) & (r["rank"] < F.col("before") + F.col("own"))
    hit = spans.select("k", "slice", "before", F.filter(ranks, inside).alias("wanted")).where(F.size("wanted") > 0)

    upto = Window.partitionBy("k", "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    counted = placed.join(hit, ["k", "slice"]).withColumn("end", F.col("before") + F.sum("n").over(upto))
    holds = lambda r: (r["rank"] >= F.col("end") - F.col("n")) & (r["rank"] < F.col("end"))
    found = counted.select("k", "v", F.explode(F.filter("wanted", holds)).alias("w")).select("k", "v", "w.*")
    sides = found.groupBy("k", "i", "at").agg(F.min_by("v", "rank").alias("below"), F.max_by("v", "rank").alias("above"))
    x = F.col("below") + (F.col("above") - F.col("below")) * (F.col("at") - F.floor("at"))
    ordered = F.array_sort(F.collect_list(F.struct("i", x.alias("x"))))
    return sides.groupBy("k").agg(ordered.alias("o")).select(*[F.col("k")[c].alias(c) for c in keys], F.col("o.x").alias("q"))
