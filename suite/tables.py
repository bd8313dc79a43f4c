"""Inputs that both sides derive from the given tables: Spark frames and the same tables as SQL.

Attributes are integer remainders and lie in [0, 1000); workloads derive from integer keys, so the
two engines agree exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectile.functions.predicates import DNF_TYPE, all_of, any_of, at_least, negate

ATTRS = ("w", "x", "y", "z")
PRIMES = (7919, 104729, 1299709, 15485863)

# The example filter, (y in [200, 250)) or x < 400.
EXAMPLE = any_of(all_of(at_least("y", 200), negate(at_least("y", 250))), negate(at_least("x", 400)))
EXAMPLE_SQL = "((y >= 200 AND NOT (y >= 250)) OR NOT (x >= 400))"

# The example catalog of six boxes over x and y.
SIX_BOXES = {
    "part_0": {"x": (500, None), "y": (300, None)},
    "part_1": {"x": (500, None), "y": (None, 299)},
    "part_2": {"x": (100, 499), "y": (300, None)},
    "part_3": {"x": (100, 499), "y": (None, 299)},
    "part_4": {"x": (None, 99), "y": (300, None)},
    "part_5": {"x": (None, 99), "y": (None, 299)},
}


#: Columns the queries use; a given schema saves reading footers on the driver.
SCHEMAS = {
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string",
    "orders": "o_orderkey bigint",
    "events": "event_id bigint, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings with four attributes."""
    key = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        key.alias("id"),
        F.col("embedding").alias("vector"),
        *[((key * p) % 1000).cast("int").alias(a) for a, p in zip(ATTRS, PRIMES)],
    )


BASE = "base AS (SELECT vec_id AS id, embedding AS vector, " + ", ".join(
    f"CAST((vec_id * {p}) % 1000 AS INTEGER) AS {a}" for a, p in zip(ATTRS, PRIMES)
) + " FROM embeddings)"


def items(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """All line items as attribute rows."""
    mixed = [F.col("l_quantity").cast("bigint") * 20, F.col("l_partkey") * 7919, F.col("l_suppkey") * 104729, F.col("l_orderkey") * 15485863]
    return table(spark, sf_dir, "lineitem").select(*keep, *[(m % 1000).cast("int").alias(a) for m, a in zip(mixed, ATTRS)])


ITEMS = """items AS (SELECT *, CAST((CAST(l_quantity AS BIGINT) * 20) % 1000 AS INTEGER) AS w,
  CAST((l_partkey * 7919) % 1000 AS INTEGER) AS x, CAST((l_suppkey * 104729) % 1000 AS INTEGER) AS y,
  CAST((l_orderkey * 15485863) % 1000 AS INTEGER) AS z FROM lineitem)"""


def filters_of(keys: DataFrame, key: Column) -> DataFrame:
    """(qid, kind, dnf): a filter of 0 to 3 possibly negated thresholds, determined by an integer key."""
    kinds = F.array(*[F.lit(k) for k in ("none", "single", "and", "or")])
    n = F.when(F.col("kind") == "none", 0).when(F.col("kind") == "single", 1).otherwise(F.floor(F.col("qid") / 16) % 4).cast("int")

    def literal(j: Column) -> Column:
        attr = (F.floor(F.col("qid") / 4) + j) % 4
        return F.struct(
            attr.cast("int").alias("attr"),
            ((F.floor(F.col("qid") / 64) + j) % 2 == 1).alias("neg"),
            (100 * (1 + (F.col("qid") * (7 + 2 * attr) + attr) % 9)).cast("int").alias("value"),
        )

    chosen = F.transform(F.slice(F.sequence(F.lit(0), F.lit(3)), F.lit(1), n), literal)
    dnf = (
        F.when(F.col("kind") == "none", F.lit(None).cast(DNF_TYPE))
        .when(F.col("kind") == "or", F.transform(chosen, lambda l: F.array(l)))
        .otherwise(F.array(chosen))
    )
    keyed = keys.select(key.alias("qid")).select("qid", F.get(kinds, (F.col("qid") % 4).cast("int")).alias("kind"))
    return keyed.select("qid", "kind", dnf.alias("dnf"))


def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One filter per order."""
    return filters_of(table(spark, sf_dir, "orders"), F.col("o_orderkey"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a query with its own filter."""
    rows = table(spark, sf_dir, "embeddings")
    filters = filters_of(rows, F.col("vec_id"))
    return rows.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")).join(filters, "qid")


def filters_sql(source: str, key: str) -> str:
    """CTEs ``keyed`` (qid, kind, n) and ``lits`` (qid, pos, attr, neg, value) for the same filters."""
    return f"""keyed AS (SELECT qid, kind, CASE kind WHEN 'none' THEN 0 WHEN 'single' THEN 1 ELSE (qid // 16) % 4 END AS n
  FROM (SELECT {key} AS qid, CASE {key} % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'single' WHEN 2 THEN 'and' ELSE 'or' END AS kind FROM {source})),
lits AS (SELECT qid, kind, j AS pos, (qid // 4 + j) % 4 AS a, ((qid // 64) + j) % 2 = 1 AS neg,
  CAST(100 * (1 + (qid * (7 + 2 * ((qid // 4 + j) % 4)) + ((qid // 4 + j) % 4)) % 9) AS INTEGER) AS value
  FROM keyed, (SELECT unnest(range(0, 3)) AS j) WHERE j < n),
wide AS (SELECT k.qid, k.kind, k.n, {", ".join(f"max(a) FILTER (WHERE pos = {j}) AS a{j}, bool_or(neg) FILTER (WHERE pos = {j}) AS neg{j}, max(value) FILTER (WHERE pos = {j}) AS v{j}" for j in range(3))}
  FROM keyed k LEFT JOIN lits l ON k.qid = l.qid GROUP BY k.qid, k.kind, k.n)"""


def combine_sql(term) -> str:
    """A filter's value from its literals' values, ``term(j)`` for the j-th."""
    conj = " AND ".join(f"(n <= {j} OR {term(j)})" for j in range(3))
    disj = " OR ".join(f"(n > {j} AND {term(j)})" for j in range(3))
    return f"CASE kind WHEN 'none' THEN true WHEN 'or' THEN ({disj}) ELSE ({conj}) END"


def holds_sql() -> str:
    """Whether a row with columns w, x, y, z passes the filter in a ``wide`` row."""
    return combine_sql(lambda j: f"((CASE a{j} WHEN 0 THEN w WHEN 1 THEN x WHEN 2 THEN y ELSE z END >= v{j}) <> neg{j})")


def truth_sql() -> str:
    """Three-valued truth of the filter in a ``wide`` row over lo_* and hi_* columns."""

    def term(j: int) -> str:
        lo = f"CASE a{j} WHEN 0 THEN lo_w WHEN 1 THEN lo_x WHEN 2 THEN lo_y ELSE lo_z END"
        hi = f"CASE a{j} WHEN 0 THEN hi_w WHEN 1 THEN hi_x WHEN 2 THEN hi_y ELSE hi_z END"
        return f"((CASE WHEN {hi} < v{j} THEN false WHEN {lo} >= v{j} THEN true END) <> neg{j})"

    return combine_sql(term)


def boxes_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog made from the data: attribute ranges of the lines of every order."""
    bounds = [f(a).alias(f"{n}_{a}") for a in ATTRS for n, f in (("lo", F.min), ("hi", F.max))]
    return items(spark, sf_dir, "l_orderkey").groupBy(F.col("l_orderkey").alias("part")).agg(*bounds)


BOXES = "boxes AS (SELECT l_orderkey AS part, " + ", ".join(f"min({a}) AS lo_{a}, max({a}) AS hi_{a}" for a in ATTRS) + " FROM items GROUP BY l_orderkey)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one executed search of an experiment grid."""
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        e.alias("qid"),
        (e % 3).cast("int").alias("trial"),
        pick(("HNSW", "IVF_FLAT"), u % 2).alias("index"),
        pick(("mod", "range"), F.floor(u / 2) % 2).alias("partitioner"),
        pick((5, 10, 100), F.floor(u / 4) % 3).alias("n_partitions"),
        pick((0.01, 0.1, 0.5, 0.9), F.floor(e / 3) % 4).alias("selectivity"),
        pick((0.1, 0.5, 0.9), F.floor(e / 12) % 3).alias("filter_percentage"),
        F.col("value").alias("search_time"),
        F.col("event_type").isin("click", "view", "error").alias("filter_used"),
        (k % 7).alias("tp"),
        ((k * 3) % 11).alias("fp"),
        ((k * 5) % 7).alias("fn"),
    )


RUNS = """runs AS (SELECT event_id AS qid, CAST(event_id % 3 AS INTEGER) AS trial,
  CASE user_id % 2 WHEN 0 THEN 'HNSW' ELSE 'IVF_FLAT' END AS "index",
  CASE (user_id // 2) % 2 WHEN 0 THEN 'mod' ELSE 'range' END AS partitioner,
  CASE (user_id // 4) % 3 WHEN 0 THEN 5 WHEN 1 THEN 10 ELSE 100 END AS n_partitions,
  CAST(CASE (event_id // 3) % 4 WHEN 0 THEN 0.01 WHEN 1 THEN 0.1 WHEN 2 THEN 0.5 ELSE 0.9 END AS DOUBLE) AS selectivity,
  CAST(CASE (event_id // 12) % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 0.5 ELSE 0.9 END AS DOUBLE) AS filter_percentage,
  "value" AS search_time, event_type IN ('click', 'view', 'error') AS filter_used,
  k % 7 AS tp, (k * 3) % 11 AS fp, (k * 5) % 7 AS fn
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))"""


def portable_uniform(key: Column, stream: int) -> Column:
    """A uniform number that SQL can compute too; stands in for the hash in checked queries."""
    return ((key * 7919 + key * key % 1000033 * (stream + 1) + stream * 104729) % 1000003 + F.lit(0.5)) / F.lit(1000003.0)


def uniform_sql(key: str, stream: int | str) -> str:
    return f"((({key} * 7919 + {key} * {key} % 1000033 * ({stream} + 1) + {stream} * 104729) % 1000003 + 0.5::DOUBLE) / 1000003.0::DOUBLE)"


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})
