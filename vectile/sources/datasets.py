"""Vector benchmark datasets: base vectors, query vectors and stored neighbours as lazy tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectile.sources.vecs import read_vecs

# File names of the public datasets, and the sizes (in millions) that have neighbour files.
FILES = {
    "small": ("siftsmall_base.fvecs", "siftsmall_query.fvecs", "siftsmall_groundtruth.ivecs"),
    "1m": ("sift_base.fvecs", "sift_query.fvecs", "sift_groundtruth.ivecs"),
    "1b": ("bigann_base.bvecs", "bigann_query.bvecs", "gnd/idx_{n}M.ivecs"),
}
MILLIONS = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000)


@dataclass(frozen=True)
class Dataset:
    base: DataFrame  # id, vector
    queries: DataFrame  # qid, vector
    truth: DataFrame  # qid, neighbours


def load_dataset(spark: SparkSession, directory: str, kind: str, n: int | None = None) -> Dataset:
    """Dataset ``kind`` ("small", "1m", "1b"). For "1b", ``n`` million base rows and their neighbour lists."""
    if kind not in FILES:
        raise ValueError(f"unknown dataset {kind}")
    if kind == "1b" and n not in MILLIONS:
        raise ValueError(f"neighbours are published for {MILLIONS} million rows")
    base, query, truth = (f"{directory.rstrip('/')}/{name.format(n=n)}" for name in FILES[kind])
    limit = n * 1_000_000 if kind == "1b" else None
    return Dataset(
        read_vecs(spark, base, limit=limit),
        read_vecs(spark, query).withColumnRenamed("id", "qid"),
        read_vecs(spark, truth).select(F.col("id").alias("qid"), F.col("vector").alias("neighbours")),
    )


def describe(vectors: DataFrame) -> DataFrame:
    """Row count and dimensions of a vector table; the vectors themselves are only measured."""
    d = F.size("vector").cast("bigint")
    return vectors.agg(F.count("*").alias("n_vectors"), F.min(d).alias("min_dim"), F.max(d).alias("max_dim"))
