"""Vector collections: Parquet tables with one folder per partition and their catalog beside the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectile.functions.predicates import UNBOUNDED_LO, Predicate
from vectile.operators.catalog import Catalog, bucket_of
from vectile.operators.search import nearest

CATALOG_DIR = "_catalog"  # an underscore hides it from scans of the collection
SEED_DIR = "_seed"  # a sample of the rows, searched first to bound a large search
ROWS_PER_FILE = 1_000_000


def collection_rows(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """The collection schema: id, float vector, int attributes."""
    return df.select(
        F.col("id").cast("bigint").alias("id"),
        F.col("vector").cast("array<float>").alias("vector"),
        *[F.col(a).cast("int").alias(a) for a in attrs],
    )


def write_collection(
    df: DataFrame,
    path: str,
    attrs: Sequence[str],
    catalog: Catalog | None = None,
    route: Column | None = None,
    mode: str = "overwrite",
    rows_per_file: int = ROWS_PER_FILE,
) -> None:
    """Create ("overwrite") or extend ("append") a collection.

    Without a catalog rows are written where they are. With one they are routed and rebalanced:
    AQE merges small partitions into shared tasks and splits a large one over several, so a
    partition that holds a third of the rows is no single task. Appending to a collection that has a catalog routes
    with the stored one; another one, or none, is an error, as older folders keep their boxes.
    """
    rows = collection_rows(df, attrs)
    if mode == "append" and (stored := stored_catalog(df.sparkSession, path)) is not None:
        if catalog is None or catalog.boxes != stored.boxes or list(catalog.attrs) != list(stored.attrs):
            raise ValueError(f"{path} has another catalog; append with the stored one")
    if catalog is None:
        rows.write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(path)
        return
    routed = rows.withColumn("part", catalog.route() if route is None else route)
    if mode == "overwrite":
        routed.limit(0).write.mode(mode).partitionBy("part").parquet(path)  # empties the folder
    # the catalog comes first: a crash never leaves rows that a later append would take for rows without one
    catalog.to_df(df.sparkSession).coalesce(1).write.mode("overwrite").parquet(f"{path}/{CATALOG_DIR}")
    routed.hint("rebalance", "part").write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("part").parquet(path)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """The rows; ``part`` is a folder column, so conditions on it skip whole partitions."""
    return spark.read.parquet(path)


def stored_catalog(spark: SparkSession, path: str) -> Catalog | None:
    """The catalog beside a collection, if there is one."""
    try:
        return read_catalog(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_catalog(spark: SparkSession, path: str) -> Catalog:
    return Catalog.from_df(spark.read.parquet(f"{path}/{CATALOG_DIR}"))


def write_seed(spark: SparkSession, path: str, one_in: int = 1_000) -> None:
    """Store a sample of the collection beside it, chosen by a hash of the id. Appending keeps it valid."""
    rows = read_collection(spark, path)
    rows.filter(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0).write.mode("overwrite").parquet(f"{path}/{SEED_DIR}")


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{SEED_DIR}")


def curve_key(attrs: Sequence[str], cuts: Mapping[str, Sequence[int]]) -> Column:
    """Place on a space-filling curve (Z order): the bits of the attributes' bucket numbers, dealt out in turn.

    ``cuts`` are ascending bucket bounds per attribute. Rows next to each other on the curve are near in every attribute.
    """
    bits = max(len(cuts[a]).bit_length() for a in attrs)
    if bits * len(attrs) > 62:
        raise ValueError("the curve has at most 62 bits")
    buckets = [bucket_of(F.coalesce(F.col(a), F.lit(UNBOUNDED_LO)), list(cuts[a])).cast("bigint") for a in attrs]
    key = F.lit(0).cast("bigint")
    for bit in range(bits):
        for i, bucket in enumerate(buckets):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(bucket, bit).bitwiseAND(F.lit(1)), bit * len(attrs) + i))
    return key


def compact(spark: SparkSession, source: str, target: str, attrs: Sequence[str], n: int | None = None, rows_per_file: int = ROWS_PER_FILE, buckets: int = 64) -> None:
    """Rewrite the layout so that the minimum and maximum of a Parquet row group skip data inside a partition, on every attribute.

    Rows are ranged by partition and place on a space-filling curve over ``attrs`` and sorted inside each task. Bucket bounds are
    approximate quantiles, so skewed attributes are cut where their rows are; they steer the order only, not what is stored.
    """
    rows = read_collection(spark, source)
    shares = [i / buckets for i in range(1, buckets)]
    found = rows.agg(*[F.percentile_approx(a, shares, 10_000).alias(a) for a in attrs]).first()  # one row
    cuts = {a: sorted(set(found[a] or [])) for a in attrs}
    whole = [F.col(c) for c in ("part",) if c in rows.columns]
    keys = [*whole, F.col("#curve"), F.col("id")]
    placed = rows.withColumn("#curve", curve_key(attrs, cuts))
    ranged = placed.repartitionByRange(n, *keys) if n else placed.repartitionByRange(*keys)
    out = ranged.sortWithinPartitions(*keys).drop("#curve").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    if not whole:
        out.parquet(target)
        return
    out.partitionBy("part").parquet(target)
    read_catalog(spark, source).to_df(spark).coalesce(1).write.mode("overwrite").parquet(f"{target}/{CATALOG_DIR}")


def search_collection(spark: SparkSession, path: str, query: Sequence[float] | Column, k: int, predicate: Predicate | None = None) -> DataFrame:
    """k nearest rows to one vector: the catalog picks folders, the filter reaches the scan, the rest is a bounded sort."""
    parts = None if predicate is None else read_catalog(spark, path).prune_names(spark, predicate)
    return nearest(read_collection(spark, path), query, k, predicate, parts)
