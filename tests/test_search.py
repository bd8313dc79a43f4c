import tracemalloc
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from conftest import plan_of
from suite.tables import ATTRS, EXAMPLE, SIX_BOXES, base, filters_of
from vectile.functions.predicates import DNF_TYPE, any_of, at_least, dnf_literal
from vectile.operators import cells
from vectile.operators.catalog import Catalog
from vectile.operators.search import QueryBlock, SearchLimits, _broadcast_search, nearest, search
from vectile.operators.truth import as_lists, explode_truth, filtered_truth
from vectile.plans.pipelines import pruned_search, score

TINY = SearchLimits(broadcast_bytes=30_000, merge_width=2, seed_one_in=4)  # several waves, seeded, merged in two levels
BASE_TYPE = "id bigint, vector array<float>, a int, b int"


def brute(vectors, ids, queries, k, keep):
    """Lists of (id, distance) per query, nearest first, ties to the smaller id."""
    out = []
    for q, mask in zip(queries, keep):
        d = ((vectors.astype(np.float64) - q.astype(np.float64)) ** 2).sum(1)
        order = [i for i in np.lexsort((ids, d)) if mask[i]][:k]
        out.append([(int(ids[i]), float(d[i])) for i in order])
    return out


def lists(found, n):
    out = [[] for _ in range(n)]
    for r in found.orderBy("qid", "rank").collect():
        assert r["rank"] == len(out[r.qid]) + 1
        out[r.qid].append((r.id, r.dist))
    return out


def same(got, want):
    assert [[i for i, _ in g] for g in got] == [[i for i, _ in w] for w in want]
    assert all(abs(x - y) <= 1e-9 * max(1, y) for g, w in zip(got, want) for (_, x), (_, y) in zip(g, w))


@pytest.fixture(scope="module")
def copies(spark):
    """A third of the rows are copies of one vector, and a third share one partition."""
    rng = np.random.default_rng(0)
    vectors = rng.integers(0, 255, (900, 8)).astype(np.float32)
    vectors[::3] = vectors[0]
    ids = rng.permutation(5000)[:900].astype(np.int64)
    a, b = rng.integers(0, 100, 900), rng.integers(0, 100, 900)
    a[1::3] = 5
    df = spark.createDataFrame([(int(i), v.tolist(), int(x), int(y)) for i, v, x, y in zip(ids, vectors, a, b)], BASE_TYPE).repartition(5)
    queries = np.vstack([vectors[:60], rng.integers(0, 255, (60, 8)).astype(np.float32)])
    return df, vectors, ids, a, b, queries


def query_frame(spark, queries, dnf=None):
    rows = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "qid bigint, vector array<float>")
    return rows if dnf is None else rows.withColumn("dnf", dnf)


@pytest.mark.parametrize("limits", [SearchLimits(), TINY])
@pytest.mark.parametrize("k", [1, 7, 2000])
def test_exact_with_copies(spark, copies, k, limits):
    df, vectors, ids, a, b, queries = copies
    if k > 100 and limits is TINY:
        limits = replace(TINY, broadcast_bytes=3_000_000)  # as large state would make very many waves
    got = lists(search(df, query_frame(spark, queries), k, limits=limits), len(queries))
    same(got, brute(vectors, ids, queries, k, np.ones((len(queries), 900), bool)))


@pytest.mark.parametrize("limits", [SearchLimits(), TINY])
def test_filters_carried_by_queries(spark, copies, limits):
    df, vectors, ids, a, b, queries = copies
    sharp, wide = any_of(at_least("a", 97)), any_of(at_least("a", 50), ~at_least("b", 40))
    dnf = (
        F.when(F.col("qid") % 4 == 0, dnf_literal(sharp, "ab"))
        .when(F.col("qid") % 4 == 1, dnf_literal(wide, "ab"))
        .when(F.col("qid") % 4 == 2, dnf_literal(any_of(), "ab"))
        .otherwise(F.lit(None).cast(DNF_TYPE))
    )
    masks = [a >= 97, (a >= 50) | (b < 40), np.zeros(900, bool), np.ones(900, bool)]
    asked = query_frame(spark, queries, dnf)
    want = brute(vectors, ids, queries, 5, [masks[i % 4] for i in range(len(queries))])
    same(lists(search(df, asked, 5, "ab", limits=limits), len(queries)), want)
    catalog = Catalog.from_ranges("ab", {"hot": {"a": (5, 5)}, "mid": {"a": (6, 80), "b": (None, 60)}, "high": {"a": (81, None)}})
    routed = df.withColumn("part", catalog.route())
    same(lists(pruned_search(routed, asked, 5, catalog, limits), len(queries)), want)


@pytest.mark.parametrize("limits", [SearchLimits(), TINY])
def test_seed_bounds_change_nothing_but_the_volume(spark, copies, limits):
    df, vectors, ids, a, b, queries = copies
    dnf = F.when(F.col("qid") % 2 == 0, dnf_literal(at_least("a", 60), "ab")).otherwise(F.lit(None).cast(DNF_TYPE))
    asked = query_frame(spark, queries, dnf)
    masks = [a >= 60 if i % 2 == 0 else np.ones(900, bool) for i in range(len(queries))]
    for k in (3, 40):
        seed = df.filter("id % 5 = 0")
        got = search(df, asked, k, "ab", limits, seed)
        same(lists(got, len(queries)), brute(vectors, ids, queries, k, masks))
    table = asked.toArrow()
    block = QueryBlock(table.append_column("bound", pa.array([-1.0] * table.num_rows)), k=3)
    rows = df.select("id", "vector", F.array("a", "b").alias("values")).toArrow()
    for batch in rows.to_batches():
        block.add(batch)
    assert sum(r.num_rows for r in block.results()) == 0


@pytest.mark.parametrize("limits", [SearchLimits(), TINY])
def test_empty_inputs(spark, copies, limits):
    df, *_, queries = copies
    asked = query_frame(spark, queries)
    assert search(df, asked.limit(0), 3, limits=limits).count() == 0
    assert search(df.limit(0), asked, 3, limits=limits).count() == 0
    catalog = Catalog.from_ranges("ab", {"low": {"a": (None, 49)}, "high": {"a": (50, None)}})
    routed = df.withColumn("part", catalog.route())
    nothing = asked.withColumn("dnf", dnf_literal(any_of(), "ab"))
    assert pruned_search(routed, nothing, 3, catalog, limits).count() == 0


def test_large_and_tiny_scales(spark):
    """Rounding of the float32 product must not lose a neighbour."""
    rng = np.random.default_rng(2)
    for scale, shift in ((1e-4, 0), (1e4, 1e5)):
        vectors = (rng.standard_normal((700, 16)) * scale + shift).astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist(), 0, 0) for i, v in enumerate(vectors)], BASE_TYPE)
        got = lists(search(df, query_frame(spark, vectors[:30]), 9), 30)
        same(got, brute(vectors, np.arange(700), vectors[:30], 9, np.ones((30, 700), bool)))


def test_ten_thousand_neighbours_in_waves(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((12_000, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, 0) for i, v in enumerate(vectors)], BASE_TYPE).repartition(6)
    limits = SearchLimits(broadcast_bytes=4_000_000, merge_width=2)  # three or more waves of at most twelve queries
    got = lists(search(df, query_frame(spark, vectors[:24]), 10_000, limits=limits), 24)
    same(got, brute(vectors, np.arange(12_000), vectors[:24], 10_000, np.ones((24, 12_000), bool)))


def test_a_seeded_wave_passes_on_few_candidates(spark):
    """One task for each of 24 partitions would pass on k rows a query; the bound of the sample leaves about k over its share."""
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((9_600, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, 0) for i, v in enumerate(vectors)], BASE_TYPE).repartition(24)
    asked = query_frame(spark, vectors[:10]).withColumn("dnf", F.lit(None).cast(DNF_TYPE)).toArrow()
    values = F.array().cast("array<int>").alias("values")
    plain = _broadcast_search(df.select("id", "vector", values), asked, 50, None)
    near = search(df.filter("id % 4 = 0"), query_frame(spark, vectors[:10]), 50).filter("rank = 50").orderBy("qid").collect()
    bound = _broadcast_search(df.select("id", "vector", values), asked.append_column("bound", pa.array([r.dist for r in near])), 50, None)
    assert plain.count() == 24 * 10 * 50 and bound.count() < 10 * 50 * 8
    assert "Exchange" not in plan_of(plain).split("MapInArrow")[0]


@pytest.mark.parametrize("filtered", [False, True])
def test_a_tile_takes_no_more_memory_for_more_queries(filtered):
    rng = np.random.default_rng(3)
    rows = rng.random((4096, 8), dtype=np.float32)
    lists = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float32()))
    values = pa.array(rng.integers(0, 1000, (4096, 1)).tolist(), pa.list_(pa.int32()))
    batch = pa.record_batch([pa.array(np.arange(4096)), lists(rows), values], names=["id", "vector", "values"])
    literal = pa.list_(pa.list_(pa.struct([("attr", pa.int32()), ("neg", pa.bool_()), ("value", pa.int32())])))

    def peak(n):
        asked = [[[{"attr": 0, "neg": bool(i % 2), "value": i % 999}]] if filtered else None for i in range(n)]
        table = pa.table({"qid": np.arange(n), "vector": lists(rng.random((n, 8), dtype=np.float32)), "dnf": pa.array(asked, literal)})
        block = QueryBlock(table, k=4)
        tracemalloc.start()
        block.add(batch)
        used = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return used

    assert peak(24_000) < peak(6_000) + 18_000 * 500  # candidates only; a byte for each row of the tile would be 4096


def peak_of(block, batch):
    tracemalloc.start()
    block.add(batch)
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return used


def test_a_task_that_reads_many_partitions_keeps_no_list_of_readers_for_each():
    names, n = [f"p{i}" for i in range(512)], 4_000
    lists = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float32()))
    rng = np.random.default_rng(4)
    rows = len(names)
    batch = pa.record_batch([pa.array(np.arange(rows)), lists(rng.random((rows, 2), dtype=np.float32)), pa.array([[]] * rows, pa.list_(pa.int32())), pa.array(names)], names=["id", "vector", "values", "part"])
    table = pa.table({"qid": np.arange(n), "vector": lists(rng.random((n, 2), dtype=np.float32)), "dnf": pa.array([None] * n, pa.list_(pa.list_(pa.struct([("attr", pa.int32()), ("neg", pa.bool_()), ("value", pa.int32())])))), "part_set": pa.array([b"\xff" * 64] * n)})
    block = QueryBlock(table, names, k=1)
    assert peak_of(block, batch) < 8 * n * len(names) // 2  # lists for all partitions take 8 bytes a query and partition
    (found,) = block.results()
    assert found.num_rows == n


def test_copies_that_meet_in_many_hash_tables_are_compared_a_few_at_a_time():
    n, rows, tables = 256, 4096, 40
    lists = lambda m, kind: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(kind))
    same_vector = lambda m: lists(np.ones((m, 2), np.float32), pa.float32())
    batch = pa.record_batch([pa.array(np.arange(rows)), same_vector(rows), pa.array([[]] * rows, pa.list_(pa.int32())), lists(np.zeros((rows, tables), np.int32), pa.int32()), pa.array([tables - 1 << 32] * rows)], names=["id", "vector", "values", "codes", "part"])
    probes = pa.array([[[1]] * (tables - 1) + [[0]]] * n, pa.list_(pa.list_(pa.int32())))  # rows and queries share the last code only
    table = pa.table({"qid": np.arange(n), "vector": same_vector(n), "dnf": pa.array([None] * n, pa.list_(pa.list_(pa.struct([("attr", pa.int32()), ("neg", pa.bool_()), ("value", pa.int32())])))), "probes": probes, "parts": pa.array([[tables - 1 << 32]] * n, pa.list_(pa.int64()))})
    block = QueryBlock(table, k=3)
    assert peak_of(block, batch) < 8 * n * rows * tables // 2  # a number for each pair and table
    (found,) = block.results()
    assert found.column("id").to_pylist() == [0, 1, 2] * n


def test_single_query(spark, sf):
    rows = base(spark, sf)
    catalog = Catalog.from_ranges(ATTRS, SIX_BOXES)
    routed = rows.withColumn("part", catalog.route())
    target = rows.orderBy("id").first()["vector"]
    parts = catalog.prune_names(spark, EXAMPLE)
    got = nearest(routed, target, 10, EXAMPLE, parts)
    plan = plan_of(got)
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    pruned = [(r.id, round(r.dist, 9)) for r in got.collect()]
    assert pruned == [(r.id, round(r.dist, 9)) for r in nearest(rows, target, 10, EXAMPLE).collect()]
    assert nearest(routed, target, 10, EXAMPLE, []).count() == 0


def test_search_plan_has_no_cross_join_and_one_shuffle(spark, sf):
    rows = base(spark, sf)
    found = search(rows, rows.select(F.col("id").alias("qid"), "vector"), 5)
    plan = plan_of(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert plan.count("Exchange") == 1 and plan.count("WindowGroupLimit") == 2
    assert "embedding" in plan and "label" not in plan  # unused columns are not read


def test_shared_filter_and_folders_reach_the_scan(spark, sf, tmp_path):
    from vectile.sources.collection import read_collection, write_collection

    catalog = Catalog.from_ranges(ATTRS, SIX_BOXES)
    rows, path = base(spark, sf), str(tmp_path / "c")
    write_collection(rows, path, ATTRS, catalog)
    asked = rows.select(F.col("id").alias("qid"), "vector").withColumn("dnf", dnf_literal(EXAMPLE, ATTRS))
    found = pruned_search(read_collection(spark, path), asked, 5, catalog)
    plan = plan_of(found)
    assert "GreaterThanOrEqual(y,200)" in plan and "PartitionFilters: [part#" in plan
    assert "part_0" not in plan.split("PartitionFilters:")[1].split("]")[0]
    plain = search(rows, asked, 5, ATTRS)
    assert found.select("qid", "id").exceptAll(plain.select("qid", "id")).count() == 0 and found.count() == plain.count()


def test_inverted_file(spark, sf):
    rows = base(spark, sf)
    queries = rows.select(F.col("id").alias("qid"), "vector").join(filters_of(rows, F.col("id")), "qid")
    exact = search(rows, queries, 10, ATTRS).cache()
    every = cells.knn_ivf(rows, queries, 10, ATTRS, n_cells=8, n_probe=8)
    assert every.select("qid", "id").exceptAll(exact.select("qid", "id")).count() == 0 and every.count() == exact.count()
    for found, floor in (
        (cells.knn_ivf(rows, queries, 10, ATTRS, n_cells=16, n_probe=8), 0.6),
        (cells.knn_lsh(rows, queries, 10, 64, ATTRS, bits=4, probes=4), 0.4),
    ):
        scored = score(exact, found, queries).filter("tp + fn > 0")
        assert scored.agg(F.avg("recall")).first()[0] > floor
    exact.unpersist()


def test_cells_reach_the_recall_of_an_index(spark):
    rows = base(spark, "/root/testdata/sf0.1")
    queries = rows.filter("id % 5 = 0").select(F.col("id").alias("qid"), "vector").join(filters_of(rows, F.col("id")), "qid")
    exact = search(rows, queries, 10, ATTRS).cache()
    for found in (cells.knn_ivf(rows, queries, 10, ATTRS, n_cells=16, n_probe=6), cells.knn_ivf(rows, queries, 10, ATTRS), cells.knn_lsh(rows, queries, 10, 64, ATTRS)):
        assert score(exact, found, queries).filter("tp + fn > 0").agg(F.avg("recall")).first()[0] >= 0.9
    exact.unpersist()


def test_cell_search_with_small_blocks(spark, sf):
    rows = base(spark, sf)
    centres = cells.train_cells(rows, 6)
    stored = cells.with_nearest_cells(rows, centres, 1)
    asked = cells.with_nearest_cells(rows.select(F.col("id").alias("qid"), "vector"), centres, 3)
    one = cells.search_cells(stored, asked, 5).select("qid", "id", "rank")
    two = cells.search_cells(stored, asked, 5, limits=TINY).select("qid", "id", "rank")
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
    assert len(cells.train_cells(rows, None, max_iter=2)) == round(rows.count() ** 0.5)


def test_odd_vectors_and_unknown_attributes(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0], 5), (2, None, 6), (3, [2.0, 0.0], 7)], "id bigint, vector array<float>, a int")
    asked = spark.createDataFrame([(1, [0.0, 0.0])], "qid bigint, vector array<float>")
    assert [r.id for r in search(rows, asked, 5, ["a"]).orderBy("rank").collect()] == [1, 3]
    assert [r.id for r in nearest(rows, [0.0, 0.0], 5).collect()] == [1, 3]
    uneven = spark.createDataFrame([(1, [0.0], 5), (2, [1.0, 2.0, 3.0], 6)], rows.schema).coalesce(1)
    for attribute, base_rows in ((0, uneven), (-1, rows), (1, rows)):
        dnf = F.array(F.array(F.struct(F.lit(attribute).alias("attr"), F.lit(False).alias("neg"), F.lit(6).alias("value")))).cast(DNF_TYPE)
        with pytest.raises((PythonException, IndexError)):
            search(base_rows, asked.withColumn("dnf", dnf), 5, ["a"]).collect()


def test_folder_names_that_look_like_numbers(spark, copies, tmp_path):
    df, vectors, ids, a, b, queries = copies
    path = str(tmp_path / "numbered")
    df.withColumn("part", (F.col("a") % 3).cast("string")).write.partitionBy("part").parquet(path)
    asked = query_frame(spark, queries).withColumn("parts", F.array(F.lit("0"), F.lit("2")))
    for limits in (SearchLimits(), TINY):
        got = lists(search(spark.read.parquet(path), asked, 5, limits=limits), len(queries))
        same(got, brute(vectors, ids, queries, 5, [a % 3 != 1] * len(queries)))


def test_truth_lists(spark):
    truth = spark.createDataFrame([(0, [3, 1, 2]), (1, [2, 3]), (2, [1])], "qid bigint, neighbours array<int>")
    rows = spark.createDataFrame([(i, [0.0], 10 * i, 0) for i in range(1, 4)], BASE_TYPE)
    queries = spark.createDataFrame([(0,), (1,), (2,)], "qid bigint").withColumn("dnf", F.when(F.col("qid") != 1, dnf_literal(at_least("a", 20), "ab")))
    got = filtered_truth(truth, rows, queries, "ab")
    assert {r.qid: r.neighbours for r in as_lists(got).collect()} == {0: [3, 2], 1: [2, 3]}
    assert explode_truth(truth).count() == 6
