"""Stored approximate indexes: built once beside each other's data, searched many times with pruning of folders.

``build_cells`` stores an inverted file of two levels: one folder per catalog partition and cell, with the centres, the catalog, a
directory of what the folders hold and the recall measured at the build. A query ranks the cells that hold rows in the partitions its
filter may match, and reads only the (partition, cell) pairs of the nearest ones.

``build_hashes`` stores several independent hash tables of random hyperplanes: one folder per table and code. A query reads
one code, or the few nearest, of every table; rows that meet it in several tables are measured once.

Both are fitted on a documented, bounded part of the rows at most, and index every row. Distances of what is read are exact.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectile.functions.predicates import DNF_TYPE
from vectile.functions.vectors import hash_uniform
from vectile.operators.catalog import Catalog
from vectile.operators.cells import hyperplanes, train_cells
from vectile.operators.search import SearchLimits, matrix, search
from vectile.session import ship_by_value

CENTRES, DIRECTORY, CATALOG, RECALL = "_centres", "_directory", "_catalog", "_recall"  # underscores hide them from scans
#: Rows that the centres are fitted on, and queries that the recall is measured with, at most about.
FITTED, MEASURED = 200_000, 1_000
TARGET = 0.9


def label_centres(base: DataFrame, label: str) -> DataFrame:
    """(cell, vector): the mean vector of every value of a label column, numbered in the order of the values."""
    entries = base.filter(F.col(label).isNotNull()).select(label, F.posexplode("vector").alias("pos", "v"))
    means = entries.groupBy(label, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    vectors = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("e")).orderBy(label)
    rows = [r.v for r in vectors.select(F.col("e.v").alias("v")).collect()]  # one row per cell
    return base.sparkSession.createDataFrame(list(enumerate(rows)), "cell int, vector array<double>")


def _distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(1) - 2.0 * (vectors.astype(np.float64) @ centres.T)


def _with_int(df: DataFrame, name: str, step, kind: T.DataType = T.IntegerType()) -> DataFrame:
    """A column that ``step`` computes from the matrix of vectors."""
    arrow = {"int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<array<int>>": pa.list_(pa.list_(pa.int32()))}[kind.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = step(matrix(batch.column("vector"))).tolist() if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


# -- inverted file --------------------------------------------------------------------------------


@dataclass
class CellIndex:
    spark: SparkSession
    path: str
    attrs: list[str]
    centres: np.ndarray
    catalog: Catalog | None
    held: np.ndarray  # which cells hold rows in which partition; one partition without a catalog
    probes: int  # cells that reach the target recall, as measured at the build

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def directory(self) -> DataFrame:
        """(part, cell, n_rows) of every folder; ``part`` is the place in the catalog."""
        return self.spark.read.parquet(f"{self.path}/{DIRECTORY}")

    def routed(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """Adds ``parts``, the folders a query reads as codes: place of the partition times cells plus cell."""
        probes, centres, held = probes or self.probes, self.centres, self.held
        n_parts, n_cells = held.shape
        if self.catalog is not None:
            queries = self.catalog.with_part_sets(queries if "dnf" in queries.columns else queries.withColumn("dnf", F.lit(None).cast(DNF_TYPE)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = []
                if batch.num_rows:
                    order = np.argsort(_distances(matrix(batch.column("vector")), centres), axis=1, kind="stable")
                    sets = batch.column("part_set").to_pylist() if "part_set" in batch.schema.names else [None] * batch.num_rows
                    for near, s in zip(order, sets):
                        own = np.ones(n_parts, bool) if s is None else np.unpackbits(np.frombuffer(s, np.uint8), count=n_parts).astype(bool)
                        chosen = near[held[own].any(axis=0)[near]][:probes]  # ranked inside the surviving partitions only
                        part, cell = np.nonzero(held[:, chosen] & own[:, None])
                        codes.append((part * n_cells + chosen[cell]).tolist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.list_(pa.int64()))], [*batch.schema.names, "parts"])

        queries = queries.filter(F.col("vector").isNotNull())
        schema = T.StructType([*queries.schema.fields, T.StructField("parts", T.ArrayType(T.LongType()))])
        found = queries.mapInArrow(run, schema)
        return found.drop("part_set")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, limits: SearchLimits = SearchLimits()) -> DataFrame:
        """Top-k of the rows in the folders read; the codes that no query reads become a partition filter on both folder columns."""
        rows = self.rows().withColumn("part", F.col("part").cast("bigint") * len(self.centres) + F.col("cell"))
        return search(rows, self.routed(queries, probes), k, self.attrs, limits)


def build_cells(
    base: DataFrame,
    path: str,
    attrs: Sequence[str] = (),
    centres: DataFrame | int = 128,
    catalog: Catalog | None = None,
    route: Column | None = None,
    k: int = 10,
    target: float = TARGET,
    seed: int = 584,
) -> CellIndex:
    """Store ``base`` (id, vector, attrs) by partition and nearest centre; ties go to the smaller cell.

    ``centres`` are given as (cell, vector), cells numbered from 0, or their number: then they come from k-means on about ``FITTED`` rows chosen by
    a hash of the id. Every row is indexed, those without a vector excepted, which no search can find. The number of cells to read for
    ``target`` is measured with about ``MEASURED`` rows as queries, searched exactly, and stored.
    """
    spark = base.sparkSession
    base = base.filter(F.col("vector").isNotNull())
    if isinstance(centres, int):
        n = base.count()
        found = train_cells(base, centres, seed, min(1.0, FITTED / n) if n else 1.0)
        centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(found)], "cell int, vector array<double>")
    rows = centres.orderBy("cell").collect()  # planning data, as large as the caller asks for
    table = np.array([r.vector for r in rows], np.float64)
    part = F.lit(0) if catalog is None else catalog.route_index() if route is None else F.array_position(F.array(*[F.lit(n) for n in catalog.names]), route).cast("int") - 1
    slim = base.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<float>").alias("vector"), *[F.col(a).cast("int").alias(a) for a in attrs], part.alias("part"))
    placed = _with_int(slim, "cell", lambda v: _distances(v, table).argmin(axis=1))
    # what describes the data is written first, so a reader never takes rows without it
    centres.coalesce(1).write.mode("overwrite").parquet(f"{path}/{CENTRES}")
    if catalog is not None:
        catalog.to_df(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/{CATALOG}")
    placed.hint("rebalance", "part", "cell").write.mode("append").partitionBy("part", "cell").parquet(path)
    stored = spark.read.parquet(path)
    stored.groupBy("part", "cell").agg(F.count("*").alias("n_rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/{DIRECTORY}")
    measured = _recall_by_probes(stored, table, k, seed)
    measured.coalesce(1).write.mode("overwrite").parquet(f"{path}/{RECALL}")
    return open_cells(spark, path, attrs, target)


def _recall_by_probes(stored: DataFrame, centres: np.ndarray, k: int, seed: int) -> DataFrame:
    """(probes, recall, queries): the share of exact neighbours whose cell is among the nearest ``probes`` of the query.

    The neighbours come from one exact search at the build; later searches run none.
    """
    spark = stored.sparkSession
    total = stored.count()
    asked = stored.filter(hash_uniform(F.col("id"), 1, seed) < MEASURED / max(total, 1)).select(F.col("id").alias("qid"), "vector")
    exact = search(stored.drop("part"), asked, k + 1).filter("id != qid").select("qid", "id")  # without the query itself
    order = _with_int(asked, "ranked", lambda v: np.argsort(_distances(v, centres), axis=1, kind="stable"), T.ArrayType(T.IntegerType()))
    met = exact.join(stored.select("id", "cell"), "id").join(order.select("qid", "ranked"), "qid")
    counted = met.select("qid", F.array_position("ranked", F.col("cell")).alias("place")).groupBy("place").agg(F.count("*").alias("n")).collect()  # a row per cell at most
    found = {r.place: r.n for r in counted}
    share = np.cumsum([found.get(i + 1, 0) for i in range(len(centres))]) / max(1, sum(found.values()))
    return spark.createDataFrame([(i + 1, float(x), sum(found.values())) for i, x in enumerate(share)], "probes int, recall double, neighbours long")


def open_cells(spark: SparkSession, path: str, attrs: Sequence[str] = (), target: float = TARGET) -> CellIndex:
    rows = spark.read.parquet(f"{path}/{CENTRES}").orderBy("cell").collect()
    centres = np.array([r.vector for r in rows], np.float64)
    folders = spark.read.parquet(f"{path}/{DIRECTORY}").collect()  # a row per folder
    exists = spark.read.parquet(f"{path}/{CATALOG}") if _is_there(spark, f"{path}/{CATALOG}") else None
    catalog = None if exists is None else Catalog.from_df(exists)
    held = np.zeros((1 if catalog is None else len(catalog.names), len(centres)), bool)
    for r in folders:
        held[r.part, r.cell] = True
    enough = spark.read.parquet(f"{path}/{RECALL}").filter(F.col("recall") >= target).agg(F.min("probes")).first()[0]
    return CellIndex(spark, path, list(attrs), centres, catalog, held, enough or len(centres))


def _is_there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


# -- hash tables ----------------------------------------------------------------------------------


@dataclass
class HashIndex:
    spark: SparkSession
    path: str
    attrs: list[str]
    planes: np.ndarray  # tables, bits, dimensions

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def search(self, queries: DataFrame, k: int, probes: int = 1, limits: SearchLimits = SearchLimits()) -> DataFrame:
        """Top-k of the rows that share a code with the query in some table, each measured once."""
        planes = self.planes
        n_tables, bits = planes.shape[:2]
        asked = _with_int(queries.filter(F.col("vector").isNotNull()), "probes", lambda v: _near_codes(v, planes, probes), T.ArrayType(T.ArrayType(T.IntegerType())))
        codes = F.flatten(F.transform("probes", lambda own, t: F.transform(own, lambda c: _part_code(t, c))))
        asked = asked.withColumn("parts", codes)
        read = self.rows().withColumn("part", _part_code(F.col("tbl"), F.col("code")))
        return search(read, asked, k, self.attrs, limits)


def _part_code(table: Column, code: Column) -> Column:
    return F.shiftleft(table.cast("bigint"), 32) + code


def _codes(vectors: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    side = np.einsum("nd,tbd->ntb", vectors.astype(np.float64), planes.astype(np.float64))
    return ((side >= 0) * (1 << np.arange(planes.shape[1]))).sum(axis=2), side


def _near_codes(vectors: np.ndarray, planes: np.ndarray, probes: int) -> np.ndarray:
    """Per vector and table its code and the next ones by the summed gaps to the hyperplanes crossed."""
    own, side = _codes(vectors, planes)
    crossed = np.arange(1 << planes.shape[1]) if probes > 1 else np.zeros(1, np.int64)
    bits = (crossed[:, None] >> np.arange(planes.shape[1]) & 1).astype(np.float64)
    flips = np.argsort(np.abs(side) @ bits.T, axis=2, kind="stable")[:, :, :probes]
    return own[:, :, None] ^ crossed[flips]


def build_hashes(base: DataFrame, path: str, dim: int, attrs: Sequence[str] = (), tables: int = 16, bits: int = 8, seed: int = 584) -> HashIndex:
    """Store ``base`` once per hash table, by table and code, with the codes of all tables beside each row.

    Storage grows with ``tables``: that is the price of reading few rows. Rows without a vector are left out.
    """
    planes = hyperplanes(dim, tables * bits, seed).reshape(tables, bits, dim)
    spark = base.sparkSession
    slim = base.filter(F.col("vector").isNotNull()).select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<float>").alias("vector"), *[F.col(a).cast("int").alias(a) for a in attrs])
    coded = _with_int(slim, "codes", lambda v: _codes(v, planes)[0], T.ArrayType(T.IntegerType()))
    spark.createDataFrame([(json.dumps(planes.tolist()), bits)], "planes string, bits int").coalesce(1).write.mode("overwrite").parquet(f"{path}/{CENTRES}")
    copies = coded.select("*", F.posexplode("codes").alias("tbl", "code"))
    copies.hint("rebalance", "tbl", "code").write.mode("append").partitionBy("tbl", "code").parquet(path)
    return open_hashes(spark, path, attrs)


def open_hashes(spark: SparkSession, path: str, attrs: Sequence[str] = ()) -> HashIndex:
    stored = spark.read.parquet(f"{path}/{CENTRES}").first()
    return HashIndex(spark, path, list(attrs), np.array(json.loads(stored.planes), np.float32))


ship_by_value(__name__)
