"""Ground truth lists and their filtered forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectile.functions.predicates import dnf_holds


def explode_truth(truth: DataFrame) -> DataFrame:
    """(qid, pos, id) from stored neighbour lists."""
    return truth.select("qid", F.posexplode("neighbours").alias("pos", "id")).withColumn("id", F.col("id").cast("bigint"))


def filtered_truth(truth: DataFrame, base: DataFrame, queries: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Stored neighbours that pass the query's filter, in stored order; lists get shorter and are not refilled.

    Attributes are looked up by an equi-join on id that leaves the vectors unread; an id that many
    lists contain spreads over the tasks by AQE's skew handling.
    """
    looked_up = base.select("id", F.array(*[F.col(a).cast("int") for a in attrs]).alias("values"))
    return (
        explode_truth(truth)
        .join(looked_up, "id")
        .join(queries.select("qid", "dnf"), "qid")
        .filter(F.col("dnf").isNull() | dnf_holds(F.col("dnf"), F.col("values")))
        .select("qid", "pos", "id")
    )


def as_lists(truth: DataFrame) -> DataFrame:
    """Back to one list per query, of at most the stored list's length."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "id")))
    return truth.groupBy("qid").agg(ordered.alias("m")).select("qid", F.col("m.id").alias("neighbours"))
