"""Parameter grids and configuration lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand_grid(lists: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every combination of the array columns ``names`` of each row, numbered in product order.

    The last list varies fastest. A scalar column counts as a list of one. Arrays are unnested one
    after the other on the row they stand on, and the number follows from their positions.
    """
    arrays = [F.col(n) if lists.schema[n].dataType.typeName() == "array" else F.array(n) for n in names]
    out = lists.select(*[a.alias(n) for n, a in zip(names, arrays)], *[F.size(a).alias(f"{n}#size") for n, a in zip(names, arrays)])
    number = F.lit(0).cast("bigint")
    for n in names:
        rest = [c for c in out.columns if c != n]
        out = out.select(*rest, F.posexplode(n).alias(f"{n}#pos", n))
    for n in names:
        number = number * F.col(f"{n}#size") + F.col(f"{n}#pos")
    return out.select(number.alias("config_id"), *names)


def collect_lists(df: DataFrame, names: Sequence[str], limit: int = 10_000) -> DataFrame:
    """One row with the sorted distinct values of each column: the lists of a grid. Grids are small by nature."""
    counts = df.agg(*[F.count_distinct(n).alias(n) for n in names]).first()
    for n in names:
        if counts[n] > limit:
            raise ValueError(f"{n} has {counts[n]} values; a grid list holds at most {limit}")
    return df.agg(*[F.array_sort(F.collect_set(n)).alias(n) for n in names])


def lookup(rows: DataFrame, configs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` with their ``config_id``, by equality on all ``columns``."""
    return rows.join(configs.select("config_id", *columns), list(columns))


def missing(rows: DataFrame, configs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Configurations used in ``rows`` that the grid does not have."""
    return rows.select(*columns).distinct().join(configs, list(columns), "left_anti")
