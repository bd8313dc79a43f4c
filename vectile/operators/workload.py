"""Query workloads: synthetic sampling, counting atomic predicates, characterisation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectile.functions.predicates import DNF_TYPE
from vectile.functions.vectors import hash_uniform
from vectile.operators.catalog import literal_array

# Thresholds and shape of the synthetic workload distribution.
THRESHOLDS = (100, 200, 300, 400, 500, 600, 700, 800, 900)
KINDS = ("none", "single", "and", "or")
KIND_WEIGHTS = (0.0, 1 / 3, 1 / 3, 1 / 3)
RATE_MEAN, RATE_STD = 0.25, 0.1

#: Numbers in (0, 1) for a key and a stream number.
Uniform = Callable[[Column, int], Column]


@dataclass(frozen=True)
class WorkloadParams:
    """Discrete distributions, one probability per choice. A few dozen numbers, so they live in the plan."""

    attrs: tuple[str, ...]
    attr_weights: tuple[float, ...]
    threshold_weights: tuple[tuple[float, ...], ...]  # per attribute
    length_weights: tuple[float, ...]  # over 0 .. len(attrs) - 1 predicates
    kind_weights: tuple[float, ...] = KIND_WEIGHTS


def exponential_weights(ranks: DataFrame, rate: Column, shuffle: Column | None = None) -> DataFrame:
    """``exp(-rate * i)`` over each ``name``'s choices 0..n-1, normalised; ``shuffle`` permutes the weights.

    ``ranks`` has (name, choice), a handful of rows per distribution.
    """
    per = Window.partitionBy("name")
    place = F.col("choice") if shuffle is None else F.row_number().over(per.orderBy(shuffle, "choice")) - 1
    raw = F.exp(-rate * place)
    return ranks.withColumn("raw", raw).select("name", "choice", (F.col("raw") / F.sum("raw").over(per)).alias("weight"))


def synthetic_params(spark: SparkSession, attrs: Sequence[str], seed: int = 584) -> WorkloadParams:
    """Draw the distributions of one workload: exponential weights at a random rate, in random order."""
    names = ["attr", "length", *[f"threshold_{a}" for a in attrs]]
    sizes = {n: len(THRESHOLDS) if n.startswith("threshold_") else len(attrs) for n in names}
    ranks = spark.createDataFrame([(n, i) for n in names for i in range(sizes[n])], "name string, choice int")
    # Box-Muller on two hashed uniforms gives the normal rate
    u, v = hash_uniform(F.col("name"), 1, seed), hash_uniform(F.col("name"), 2, seed)
    rate = F.lit(RATE_MEAN) + F.lit(RATE_STD) * F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)
    rate = F.least(F.greatest(rate, F.lit(0.0)), F.lit(1.0))
    order = hash_uniform(F.concat_ws(":", "name", F.col("choice").cast("string")), 3, seed)
    rows = exponential_weights(ranks, rate, order).orderBy("name", "choice").collect()
    drawn = {n: tuple(r.weight for r in rows if r.name == n) for n in names}
    return WorkloadParams(tuple(attrs), drawn["attr"], tuple(drawn[f"threshold_{a}"] for a in attrs), drawn["length"])


def choose(u: Column, weights: Sequence[float]) -> Column:
    """Index drawn by inverse distribution function: the number of cumulative weights at or below ``u``."""
    total, steps = sum(weights), []
    for i in range(len(weights) - 1):
        steps.append((u >= F.lit(sum(weights[: i + 1]) / total)).cast("int"))
    return sum(steps, F.lit(0))


def sample_workload(keys: DataFrame, params: WorkloadParams, key: str = "qid", uniform: Uniform = hash_uniform) -> DataFrame:
    """One sampled filter per key: (qid, kind, dnf). A map over the keys, without any shuffle.

    "single" has one predicate, "and" / "or" have a drawn number of them on distinct attributes
    (none at all included); "none" is an absent filter.
    """
    k, n = F.col(key), len(params.attrs)
    live = [i for i, w in enumerate(params.attr_weights) if w > 0]
    draws = {"u_kind": uniform(k, 0), "u_length": uniform(k, 1)}
    draws |= {f"u_race{i}": uniform(k, 10 + i) for i in live} | {f"u_value{i}": uniform(k, 20 + i) for i in range(n)}
    numbers = keys.select(k, *[u.alias(name) for name, u in draws.items()])  # drawn once, used often
    kind = F.get(literal_array(KINDS, "array<string>"), choose(F.col("u_kind"), params.kind_weights))
    # weighted draw without replacement: the smallest arrival times of competing exponentials
    arrival = lambda i: (-F.log(f"u_race{i}") / F.lit(params.attr_weights[i])).alias("time")
    race = F.sort_array(F.array(*[F.struct(arrival(i), F.lit(i).alias("attr")) for i in live]))
    value = lambda i: F.get(literal_array(THRESHOLDS, "array<int>"), choose(F.col(f"u_value{i}"), params.threshold_weights[i]))
    drawn = numbers.select(
        k,
        kind.alias("kind"),
        choose(F.col("u_length"), params.length_weights).alias("length"),
        race.alias("race"),
        F.array(*[value(i) for i in range(n)]).alias("thresholds"),
    )
    taken = F.when(F.col("kind") == "single", F.lit(1)).otherwise(F.least(F.col("length"), F.lit(n)))
    literals = F.transform(
        F.slice(F.col("race"), F.lit(1), taken),
        lambda r: F.struct(r["attr"].alias("attr"), F.lit(False).alias("neg"), F.get(F.col("thresholds"), r["attr"]).alias("value")),
    )
    dnf = (
        F.when(F.col("kind") == "none", F.lit(None).cast(DNF_TYPE))
        .when(F.col("kind") == "or", F.transform(literals, lambda l: F.array(l)))
        .otherwise(F.array(literals))
    )
    return drawn.select(key, "kind", dnf.cast(DNF_TYPE).alias("dnf"))


def explode_atomics(workload: DataFrame, attrs: Sequence[str], qid: str = "qid") -> DataFrame:
    """(qid, pos, attr, value): the leaves of every filter in order, repeated ones included, negation dropped."""
    leaves = F.posexplode(F.flatten("dnf")).alias("pos", "leaf")
    name = F.get(literal_array(attrs, "array<string>"), F.col("leaf.attr"))
    return workload.select(qid, leaves).select(qid, "pos", name.alias("attr"), F.col("leaf.value").alias("value"))


def characterize(atoms: DataFrame, qid: str = "qid") -> DataFrame:
    """Frequency per atomic predicate, most frequent first and ties by first appearance.

    Counts combine before the shuffle, so a predicate that dominates the workload is no hot key.
    """
    first = F.min(F.struct(qid, "pos"))
    counted = atoms.groupBy("attr", "value").agg(F.count("*").alias("freq"), first.alias("first"))
    return counted.select("attr", "value", "freq", F.col(f"first.{qid}").alias("first_qid"), F.col("first.pos").alias("first_pos")).orderBy(
        F.desc("freq"), "first_qid", "first_pos"
    )


def atom_list(characterized: DataFrame, min_frequency: int = 1, limit: int = 1_000_000) -> list[tuple[str, int, int]]:
    """The ordered list for ``build_tree``: distinct thresholds, not queries, so it stays small.

    Predicates below ``min_frequency`` can never split a node and stay out of it.
    """
    frequent = characterized.filter(F.col("freq") >= min_frequency)
    rows = frequent.select("attr", "value", "freq").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} distinct predicates occur {min_frequency} times; raise the minimum frequency")
    return [(r.attr, r.value, r.freq) for r in rows]
