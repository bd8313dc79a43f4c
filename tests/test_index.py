"""Stored indexes against exact search."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from suite import searches
from suite.tables import ATTRS, SIX_BOXES, base, filters_of, vector_queries
from vectile.functions.predicates import any_of, at_least, dnf_literal, negate
from vectile.operators.catalog import Catalog
from vectile.operators.index import build_cells, build_hashes, label_centres, open_cells, open_hashes
from vectile.operators.search import SearchLimits, search
from vectile.plans.pipelines import score


def recall_of(exact, found, queries):
    return score(exact, found, queries).filter("tp + fn > 0").agg(F.avg("recall")).first()[0]


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """Rows around 200 centres, as embeddings are; a third of them around one, and some without a vector."""
    path = str(tmp_path_factory.mktemp("rows"))
    rng = np.random.default_rng(3)
    middles = rng.standard_normal((200, 32)) * 3
    own = np.where(rng.random(20_000) < 0.33, 0, rng.integers(0, 200, 20_000))
    vectors = (middles[own] + rng.standard_normal((20_000, 32)) * 0.7).astype(np.float32)
    frame = pd.DataFrame({"id": np.arange(20_000), "vector": list(vectors), "label": own, **{a: rng.integers(0, 1000, 20_000) for a in ATTRS}})
    frame.loc[frame.id % 1000 == 999, "vector"] = None
    spark.createDataFrame(frame, "id long, vector array<float>, label int, w int, x int, y int, z int").repartition(8).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def queries_of(rows, every=100):
    own = rows.filter(F.col("vector").isNotNull() & (F.col("id") % every == 0))
    return own.select(F.col("id").alias("qid"), "vector").join(filters_of(own, F.col("id")), "qid")


def test_cells_are_read_by_folder_and_reach_the_target(spark, clustered, tmp_path):
    catalog = Catalog.from_ranges(ATTRS, SIX_BOXES)
    path = str(tmp_path / "cells")
    built = build_cells(clustered, path, ATTRS, 64, catalog)
    index = open_cells(spark, path, ATTRS)
    assert index.probes == built.probes < 32 and index.directory().agg(F.sum("n_rows")).first()[0] == 20_000 - 20
    queries = queries_of(clustered)
    exact = search(clustered, queries, 10, ATTRS).cache()
    found = index.search(queries, 10)
    assert recall_of(exact, found, queries) >= 0.9
    one = index.search(queries.filter("qid = 700"), 10, probes=2)
    filters = plan_of(one).split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "part#" in filters and "cell#" in filters
    everything = index.search(queries, 10, probes=64)
    assert everything.exceptAll(exact).count() == 0 and everything.count() == exact.count()
    waves = index.search(queries, 10, limits=SearchLimits(broadcast_bytes=60_000, merge_width=2)).select("qid", "id")
    assert waves.exceptAll(found.select("qid", "id")).count() == 0 and waves.count() == found.count()
    exact.unpersist()


def test_cells_are_ranked_inside_the_partitions_that_survive(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 4), 0.0], 10 if i % 4 == 3 else 90) for i in range(40)], "id long, vector array<float>, a int")
    centres = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], "cell int, vector array<double>")
    catalog = Catalog.from_ranges(["a"], {"low": {"a": (None, 49)}, "high": {"a": (50, None)}})
    index = build_cells(rows, str(tmp_path / "c"), ["a"], centres, catalog)
    asked = spark.createDataFrame([(1, [0.0, 0.0])], "qid long, vector array<float>").withColumn("dnf", dnf_literal(negate(at_least("a", 50)), ["a"]))
    assert [r.parts for r in index.routed(asked, 1).collect()] == [[3]]  # only cell 3 holds rows of the low partition
    assert index.search(asked, 10, 1).count() == 10


def test_label_centres(spark):
    rows = spark.createDataFrame([(1, [0.0, 2.0], 7), (2, [2.0, 4.0], 7), (3, [9.0, 9.0], 3), (4, [5.0, 5.0], None)], "id long, vector array<float>, label int")
    assert [(r.cell, r.vector) for r in label_centres(rows, "label").orderBy("cell").collect()] == [(0, [9.0, 9.0]), (1, [1.0, 3.0])]


def test_hash_tables_measure_a_pair_once(spark, clustered, tmp_path):
    path = str(tmp_path / "hashes")
    build_hashes(clustered, path, 32, ATTRS, tables=8, bits=5)
    index = open_hashes(spark, path, ATTRS)
    queries = queries_of(clustered)
    exact = search(clustered, queries, 10, ATTRS).cache()
    found = index.search(queries, 10).cache()
    assert found.select("qid", "id").distinct().count() == found.count()
    assert recall_of(exact, found, queries) >= 0.9
    every = index.search(queries.filter("qid < 3000"), 10, probes=32)
    want = exact.filter("qid < 3000")
    assert every.exceptAll(want).count() == 0 and every.count() == want.count()
    planes = index.planes.astype(np.float64)
    vectors = {r.id: np.array(r.vector, np.float64) for r in clustered.filter("vector is not null").collect()}
    code = lambda v: (np.einsum("d,tbd->tb", v, planes) >= 0)
    for r in queries.filter("dnf is null").limit(5).collect():
        met = [i for i, v in vectors.items() if (code(v) == code(np.array(r.vector))).all(axis=1).any()]
        want = sorted(((float(((vectors[i] - vectors[r.qid]) ** 2).sum()), i) for i in met))[:10]
        assert [i for _, i in want] == [x.id for x in found.filter(F.col("qid") == r.qid).orderBy("rank").collect()]
    found.unpersist(), exact.unpersist()


def test_empty_queries_and_rows(spark, clustered, tmp_path):
    index = build_cells(clustered, str(tmp_path / "e"), ATTRS, 8)
    assert index.search(queries_of(clustered).limit(0), 5).count() == 0
    assert index.search(queries_of(clustered).limit(3).withColumn("dnf", dnf_literal(any_of(), ATTRS)), 5).count() == 0


def test_a_stored_index_beats_exact_search(spark, tmp_path):
    """100,000 clustered rows and 10,000 queries: the index is built before and searched after."""
    rng = np.random.default_rng(8)
    middles = rng.standard_normal((400, 64)) * 3
    own = rng.integers(0, 400, 100_000)
    frame = pd.DataFrame({"id": np.arange(100_000), "vector": list((middles[own] + rng.standard_normal((100_000, 64))).astype(np.float32))})
    path = str(tmp_path / "rows")
    spark.createDataFrame(frame, "id long, vector array<float>").repartition(8).write.parquet(path)
    rows = spark.read.parquet(path)
    queries = rows.filter("id % 10 = 7").select(F.col("id").alias("qid"), "vector")
    index = build_cells(rows, str(tmp_path / "index"), (), 64)

    def spent(run):
        laps = []
        for _ in range(2):
            start = time.perf_counter()
            n = run().count()
            laps.append(time.perf_counter() - start)
        return min(laps), n

    exact, n = spent(lambda: search(rows, queries, 10))
    stored, m = spent(lambda: index.search(queries, 10))
    print(f"exact {exact:.2f} s, stored {stored:.2f} s with {index.probes} of 64 cells")
    assert n == m == 100_000 and stored < exact
    assert recall_of(search(rows, queries, 10), index.search(queries, 10), queries) >= 0.9


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_registered_settings_find_nine_of_ten(spark, folder):
    """The given vectors have no clusters, so much has to be read; the registered parameters still reach the recall."""
    sf = f"/root/testdata/{folder}"
    queries = vector_queries(spark, sf)
    exact = search(base(spark, sf), queries, 10, ATTRS).cache()
    for query in (searches.knn_lsh, searches.knn_ivf_stored):
        assert recall_of(exact, query(spark, sf), queries) >= 0.9, query
    exact.unpersist()
