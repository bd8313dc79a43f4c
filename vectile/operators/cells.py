"""Approximate search: coarse cells over the vectors, of which a query reads only a few.

The cells take the place of partitions in ``search``: base rows carry ``part``, queries get routes
to their nearest cells, and distances inside the cells read are exact. Cells come from k-means
(inverted file) or from random hyperplanes (locality-sensitive codes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectile.functions.vectors import hash_uniform
from vectile.operators.search import SearchLimits, matrix, search
from vectile.session import ship_by_value

# Cell count and cells read per query to start from.
N_CELLS, N_PROBE = 128, 16
# Share of the exact neighbours to find, and about how many queries it is measured on.
RECALL, MEASURED = 0.9, 1_000


def train_cells(base: DataFrame, n_cells: int | None = N_CELLS, seed: int = 584, fraction: float = 1.0, max_iter: int = 10) -> np.ndarray:
    """Cell centres by k-means on all rows, or on an explicit ``fraction`` of them chosen by a hash of the id.

    Without ``n_cells`` there are about as many cells as the square root of the number of rows.
    """
    base = base.filter(F.col("vector").isNotNull())
    if n_cells is None:
        n_cells = max(1, round(base.count() ** 0.5))
    if fraction < 1.0:
        base = base.filter(hash_uniform(F.col("id"), 0, seed) < fraction)
    features = base.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter, initSteps=2).fit(features)
    return np.asarray(model.clusterCenters(), dtype=np.float32)


def with_nearest_cells(df: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """Adds ``cells``, the ``n`` nearest centres of each vector, nearest first."""

    def nearest(vectors: np.ndarray) -> np.ndarray:
        gap = (centres.astype(np.float64) ** 2).sum(1) - 2.0 * (vectors @ centres.T)
        return np.argsort(gap, axis=1, kind="stable")[:, :n]

    return _map_vectors(df, nearest)


def hyperplanes(dim: int, bits: int, seed: int = 584) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((bits, dim)).astype(np.float32)


def with_codes(df: DataFrame, planes: np.ndarray, probes: int = 1) -> DataFrame:
    """Adds ``cells``: the code of each vector, then the ``probes - 1`` next ones by the summed gaps to the hyperplanes crossed."""
    crossed = np.arange(1 << len(planes)) if probes > 1 else np.zeros(1, np.int64)
    bits = (crossed[:, None] >> np.arange(len(planes)) & 1).astype(np.float64)

    def codes(vectors: np.ndarray) -> np.ndarray:
        side = vectors @ planes.T
        own = (side >= 0) @ (1 << np.arange(len(planes)))
        flips = np.argsort(np.abs(side).astype(np.float64) @ bits.T, axis=1, kind="stable")[:, :probes]
        return own[:, None] ^ crossed[flips]

    return _map_vectors(df, codes)


def _map_vectors(df: DataFrame, step) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField("cells", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = step(matrix(batch.column("vector"))) if batch.num_rows else np.empty((0, 0), np.int64)
            offsets = np.arange(0, found.size + 1, max(found.shape[1], 1), dtype=np.int32)[: batch.num_rows + 1]
            cells = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cells"])

    return df.mapInArrow(run, schema)


def search_cells(base: DataFrame, probed: DataFrame, k: int, attrs=(), limits: SearchLimits = SearchLimits()) -> DataFrame:
    """Search with ``base`` assigned to its first cell and ``probed`` queries reading all of theirs."""
    stored = base.withColumn("part", F.get("cells", F.lit(0))).drop("cells")
    return search(stored, probed.withColumnRenamed("cells", "parts"), k, attrs, limits)


def cells_to_read(base: DataFrame, ranked: DataFrame, k: int, attrs=(), recall: float = RECALL, most: int = MEASURED, seed: int = 584) -> int:
    """How many of its ``cells``, which ``ranked`` queries have all of, a query has to read to find ``recall`` on average.

    About ``most`` queries, chosen by a hash, are searched exactly with their filters. A neighbour is found as soon as its
    cell is read, so the places of the neighbours' cells give the recall of every number of cells; two standard errors are added.
    """
    total = ranked.count()
    asked = ranked.filter(hash_uniform(F.col("qid"), 1, seed) < most / total) if total > most else ranked
    exact = search(base.drop("cells"), asked.drop("cells"), k, attrs).select("qid", "id")
    own = base.select("id", F.get("cells", F.lit(0)).alias("cell"))
    places = exact.join(own, "id").join(asked.select("qid", "cells"), "qid")
    weighed = places.select("qid", F.array_position("cells", F.col("cell")).alias("place"), (1.0 / F.count("*").over(Window.partitionBy("qid"))).alias("weight"))
    counted = weighed.groupBy("place").agg(F.sum("weight").alias("weight")).orderBy("place").collect()  # one row per cell at most
    n = sum(r["weight"] for r in counted)
    wanted, found = recall + 2 * (recall * (1 - recall) / n) ** 0.5 if n else 0.0, 0.0
    for r in counted:
        found += r["weight"]
        if found >= min(wanted, 1.0) * n - 1e-9:
            return int(r["place"])
    return int(counted[-1]["place"]) if counted else 1


def _read_enough(base: DataFrame, ranked: DataFrame, k: int, attrs, least: int, recall: float) -> DataFrame:
    n = max(least, cells_to_read(base, ranked, k, attrs, recall))
    return search_cells(base, ranked.withColumn("cells", F.slice("cells", 1, n)), k, attrs)


def knn_ivf(base: DataFrame, queries: DataFrame, k: int, attrs=(), n_cells: int | None = N_CELLS, n_probe: int = N_PROBE, seed: int = 584, recall: float | None = RECALL) -> DataFrame:
    """Queries read ``n_probe`` cells, and as many more as the measured ``recall`` asks for, if one is given."""
    centres = train_cells(base, n_cells, seed)
    stored = with_nearest_cells(base, centres, 1)
    if recall is None or n_probe >= len(centres):
        return search_cells(stored, with_nearest_cells(queries, centres, n_probe), k, attrs)
    return _read_enough(stored, with_nearest_cells(queries, centres, len(centres)), k, attrs, n_probe, recall)


def knn_lsh(base: DataFrame, queries: DataFrame, k: int, dim: int, attrs=(), bits: int = 5, probes: int = 4, seed: int = 584, recall: float | None = RECALL) -> DataFrame:
    """Queries read ``probes`` codes, and as many more as the measured ``recall`` asks for, if one is given."""
    planes = hyperplanes(dim, bits, seed)
    stored = with_codes(base, planes)
    if recall is None:
        return search_cells(stored, with_codes(queries, planes, probes), k, attrs)
    return _read_enough(stored, with_codes(queries, planes, 1 << bits), k, attrs, probes, recall)


ship_by_value(__name__)
