"""Scores and latency statistics of search runs.

A run table has one row per executed query with the columns named in ``Run`` and any configuration
columns; every function takes the grouping columns as a parameter and combines before it shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectile.operators.quantiles import quantiles


def recall(tp: Column, fn: Column) -> Column:
    """tp / (tp + fn), and 0 where there is nothing to find."""
    return F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))


def confusion(truth: DataFrame, results: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(qid, tp, fp, fn) on sets of ids: one shuffle by (qid, id), then counts per query.

    ``queries`` adds the queries that have neither truth nor results.
    """
    side = lambda df, t, r: df.select("qid", "id", F.lit(t).alias("in_truth"), F.lit(r).alias("in_result"))
    pairs = (
        side(truth, 1, 0)
        .unionByName(side(results, 0, 1))
        .groupBy("qid", "id")
        .agg(F.max("in_truth").alias("t"), F.max("in_result").alias("r"))
    )
    if queries is not None:
        pairs = pairs.unionByName(queries.select("qid", F.lit(None).cast("bigint").alias("id"), F.lit(0).alias("t"), F.lit(0).alias("r")))
    count = lambda t, r, name: F.sum(((F.col("t") == t) & (F.col("r") == r)).cast("bigint")).alias(name)
    return pairs.groupBy("qid").agg(count(1, 1, "tp"), count(0, 1, "fp"), count(1, 0, "fn"))


def confusion_of_lists(df: DataFrame, truth: str, results: str) -> DataFrame:
    """The same counts where both lists are on one row: no shuffle."""
    t, r = F.col(truth), F.col(results)
    return df.withColumns(
        {
            "tp": F.size(F.array_intersect(t, r)).cast("bigint"),
            "fp": F.size(F.array_except(r, t)).cast("bigint"),
            "fn": F.size(F.array_except(t, r)).cast("bigint"),
        }
    )


def time_stats(runs: DataFrame, keys: Sequence[str], time: str = "search_time") -> DataFrame:
    """Mean, median, extremes and population standard deviation of a time column."""
    moments = runs.groupBy(*keys).agg(
        F.avg(time).alias("mean"), F.max(time).alias("max"), F.min(time).alias("min"), F.stddev_pop(time).alias("std")
    )
    median = quantiles(runs, keys, time, [0.5]).select(*keys, F.get("q", F.lit(0)).alias("median"))
    return _attach(moments, median, keys)


def _attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    if keys:  # null is a group like any other
        other = right.select(*[F.col(k).alias(f"same_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"same_{i}")) for i, k in enumerate(keys)])
        return left.join(other, same).drop(*[f"same_{i}" for i in range(len(keys))])
    return left.withColumns({c: right.select(c).scalar() for c in right.columns})  # a single row


def time_percentiles(runs: DataFrame, keys: Sequence[str], percents: Sequence[float], time: str = "search_time") -> DataFrame:
    """One row per group and percentile, linearly interpolated."""
    labels = F.array(*[F.lit(float(p)) for p in percents])
    table = quantiles(runs, keys, time, [p / 100 for p in percents])
    zipped = F.explode(F.arrays_zip(labels.alias("percent"), F.col("q").alias("value"))).alias("e")
    return table.select(*keys, zipped).select(*keys, F.col("e.percent").alias("percent"), F.col("e.value").alias("value"))


def mean_over_trials(runs: DataFrame, keys: Sequence[str], trial: str = "trial", percent: float = 99.0) -> DataFrame:
    """Mean over trials of each trial's mean time, mean recall and time percentile (trials weigh the same)."""
    per_trial = [*keys, trial]
    means = runs.groupBy(*per_trial).agg(
        F.avg("search_time").alias("t"), F.avg(recall(F.col("tp"), F.col("fn"))).alias("r")
    )
    tails = quantiles(runs, per_trial, "search_time", [percent / 100]).select(*per_trial, F.get("q", F.lit(0)).alias("p"))
    return (
        _attach(means, tails, per_trial)
        .groupBy(*keys)
        .agg(F.avg("t").alias("mean_time"), F.avg("r").alias("mean_recall"), F.avg("p").alias("tail_time"))
    )


def recall_stats(runs: DataFrame, keys: Sequence[str], filtered_only: bool = True) -> DataFrame:
    """Pooled mean and population standard deviation of recall, by default of filtered queries.

    ``no_truth`` counts the queries whose truth is empty and whose recall is 0 by definition.
    """
    rows = runs.filter("filter_used") if filtered_only else runs
    score = recall(F.col("tp"), F.col("fn"))
    empty = F.sum((F.col("tp") + F.col("fn") == 0).cast("bigint"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_recall"), F.stddev_pop(score).alias("std_recall"), empty.alias("no_truth")
    )


def qualifying_points(runs: DataFrame, qid: str = "qid") -> DataFrame:
    """Query and recall of the filtered queries."""
    return runs.filter("filter_used").select(qid, recall(F.col("tp"), F.col("fn")).alias("recall"))


def heatmap(
    runs: DataFrame, rows: str, columns: str, column_values: Sequence, percent: float, keys: Sequence[str] = (), trial: str = "trial"
) -> DataFrame:
    """Matrix of the mean over trials of a time percentile: one row per ``rows`` value, one column per listed value."""
    cell = [*keys, rows, columns]
    tails = quantiles(runs, [*cell, trial], "search_time", [percent / 100])
    return tails.groupBy(*keys, rows).pivot(columns, list(column_values)).agg(F.avg(F.get("q", F.lit(0))))


def time_by_filter(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and mean times with and without a filter, side by side in one pass."""
    used, t = F.col("filter_used"), F.col("search_time")
    return runs.groupBy(*keys).agg(
        F.sum(used.cast("bigint")).alias("n_filtered"),
        F.sum((~used).cast("bigint")).alias("n_unfiltered"),
        F.avg(F.when(used, t)).alias("mean_filtered"),
        F.avg(F.when(~used, t)).alias("mean_unfiltered"),
    )


def time_histogram(runs: DataFrame, bins: int, log: bool = True, keys: Sequence[str] = (), time: str = "search_time") -> DataFrame:
    """Counts in ``bins`` equal bins (of log10 with ``log``) between the extremes of all rows; the last is closed.

    Times that have no logarithm are counted in bin -1, up to 0, if there are any. The extremes are one row and reach the second scan
    as a scalar.
    """
    t = F.col(time)
    values = runs.filter(t.isNotNull())
    inside = t > 0 if log else F.lit(True)
    x = F.when(inside, F.log10(F.when(inside, t)) if log else t)
    ends = values.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = (0.0, 0.0) if ends["lo"] is None else (ends["lo"], ends["hi"])
    step = (hi - lo) / bins or 1.0
    number = F.least(F.floor((x - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo or 1.0)), F.lit(bins - 1)).cast("int")
    edge = lambda i: F.pow(F.lit(10.0), F.lit(lo) + i * F.lit(step)) if log else F.lit(lo) + i * F.lit(step)
    binned = F.col("bin") >= 0
    return (
        values.groupBy(*keys, F.when(inside, number).otherwise(F.lit(-1)).alias("bin"))
        .agg(F.count("*").alias("n"))
        .select(*keys, "bin", "n", F.when(binned, edge(F.col("bin"))).alias("lo"), F.when(binned, edge(F.col("bin") + 1)).otherwise(F.lit(0.0)).alias("hi"))
    )


def histogram_density(runs: DataFrame, bins: int, log: bool = True, key: str = "filter_used") -> DataFrame:
    """Stacked density: counts by ``key`` over (all binned rows times bin width), so all stacks together have area 1."""
    counted = time_histogram(runs, bins, log, [key]).filter("bin >= 0")
    total = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
    return counted.select(key, "bin", "n", (F.col("n") / (F.lit(float(total)) * (F.col("hi") - F.col("lo")))).alias("density"))


def box_summary(runs: DataFrame, keys: Sequence[str], time: str = "search_time") -> DataFrame:
    """Quartiles, whiskers (the furthest values within 1.5 interquartile ranges) and the number of outliers."""
    q = quantiles(runs, keys, time, [0.25, 0.5, 0.75])
    box = q.select(*keys, *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fences = box.select("*", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    t = F.col(time)
    inside = t.between(F.col("low"), F.col("high"))
    # equal times are counted first, so a large group sends few rows into the join
    freq = runs.groupBy(*keys, time).agg(F.count("*").alias("n"))
    return (
        _attach(freq, fences, keys)
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, t)).alias("whisker_low"),
            F.max(F.when(inside, t)).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).cast("bigint").alias("outliers"),
        )
    )


def distinct_sorted(df: DataFrame, column: str, condition: Column | None = None) -> DataFrame:
    return (df if condition is None else df.filter(condition)).select(column).distinct().orderBy(column)
