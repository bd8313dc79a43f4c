import json
import struct

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from suite.tables import ATTRS, EXAMPLE, SIX_BOXES, base
from vectile.operators.catalog import Catalog
from vectile.session import materialise, shared_dir
from vectile.sources.collection import (
    compact, read_catalog, read_collection, search_collection, write_collection,
)
from vectile.sources.datasets import describe, load_dataset
from vectile.sources.experiments import numbered_lines, read_config, read_run_arrays, read_workload, write_config
from vectile.sources.vecs import read_vecs, write_vecs
from vectile.streaming.ingest import append_batch, routed_ingest

CATALOG = Catalog.from_ranges(ATTRS, SIX_BOXES)


def record(values, code):
    return struct.pack("<i", len(values)) + struct.pack(f"<{len(values)}{code}", *values)


def rows(df):
    return [(r.id, list(r.vector)) for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("kind,code,values", [("ivecs", "i", [-5, 7, 2**31 - 1]), ("fvecs", "f", [0.5, -2.25, 8.0]), ("bvecs", "B", [0, 127, 255])])
def test_vector_files(spark, tmp_path, kind, code, values):
    n = 50
    path = tmp_path / f"v.{kind}"
    data = [[v for v in values[:2]] + [type(values[2])(i)] for i in range(n)]
    path.write_bytes(b"".join(record(v, code) for v in data))
    df = read_vecs(spark, path, bytesPerPartition=64)
    assert df.rdd.getNumPartitions() > 5
    assert rows(df) == list(enumerate(data))
    assert rows(read_vecs(spark, path, limit=7)) == list(enumerate(data))[:7]
    assert rows(read_vecs(spark, path, limit=500)) == list(enumerate(data))
    assert df.schema["vector"].dataType.elementType.typeName() == ("integer" if kind == "ivecs" else "float")
    out = tmp_path / "out"
    for mode in ("overwrite", "overwrite"):
        write_vecs(df.repartitionByRange(3, "id").sortWithinPartitions("id"), out, kind, mode)
    assert rows(read_vecs(spark, out, kind)) == list(enumerate(data))
    write_vecs(df, out, kind, "append")
    assert read_vecs(spark, out, kind).count() == 2 * n
    assert read_vecs(spark, out, kind, limit=n + 3).count() == n + 3


def test_vector_file_errors(spark, tmp_path):
    (tmp_path / "e.fvecs").write_bytes(b"")
    assert read_vecs(spark, tmp_path / "e.fvecs").count() == 0
    (tmp_path / "m.ivecs").write_bytes(record([1, 2, 3], "i") + record([1], "i") + record([5], "i"))
    with pytest.raises(Exception, match="dimension"):
        read_vecs(spark, tmp_path / "m.ivecs").collect()
    (tmp_path / "t.ivecs").write_bytes(record([1, 2, 3], "i") + b"xx")
    with pytest.raises(Exception, match="not a sequence"):
        read_vecs(spark, tmp_path / "t.ivecs").collect()
    with pytest.raises(Exception, match="unsupported"):
        read_vecs(spark, tmp_path / "t.npy").collect()


def test_datasets(spark, tmp_path):
    vec = lambda v, code: b"".join(record(x, code) for x in v)
    (tmp_path / "siftsmall_base.fvecs").write_bytes(vec([[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]], "f"))
    (tmp_path / "siftsmall_query.fvecs").write_bytes(vec([[0.0, 1.0]], "f"))
    (tmp_path / "siftsmall_groundtruth.ivecs").write_bytes(vec([[0, 1]], "i"))
    data = load_dataset(spark, str(tmp_path), "small")
    assert describe(data.base).first() == (3, 2, 2)
    assert data.queries.columns == ["qid", "vector"] and data.truth.first().neighbours == [0, 1]
    (tmp_path / "gnd").mkdir()
    (tmp_path / "gnd" / "idx_1M.ivecs").write_bytes(vec([[0, 1]], "i"))
    for name in ("bigann_base.bvecs", "bigann_query.bvecs"):
        (tmp_path / name).write_bytes(vec([[200, 1], [3, 4]], "B"))
    big = load_dataset(spark, str(tmp_path), "1b", 1)
    assert rows(big.base)[0] == (0, [200.0, 1.0])
    for args in (("1b", 3), ("1b", None), ("other", None)):
        with pytest.raises(ValueError):
            load_dataset(spark, str(tmp_path), *args)


def test_collection_layout(spark, sf, tmp_path):
    path, target = str(tmp_path / "c"), str(tmp_path / "d")
    source = base(spark, sf)
    write_collection(source, path, ATTRS, CATALOG)
    stored = read_collection(spark, path)
    assert stored.schema["part"].dataType.typeName() == "string"
    assert stored.select("id", *ATTRS).exceptAll(source.select("id", *ATTRS)).count() == 0 and stored.count() == source.count()
    assert stored.filter(F.col("part") != CATALOG.route()).count() == 0
    assert read_catalog(spark, path).boxes == CATALOG.boxes
    target_vector = source.first()["vector"]
    found = search_collection(spark, path, target_vector, 5, EXAMPLE)
    plan = plan_of(found)
    assert "PartitionFilters: [part#" in plan and "part_0" not in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "GreaterThanOrEqual(y,200)" in plan  # the filter reaches the scan
    assert [r.id for r in found.collect()] == [r.id for r in search_collection(spark, path, target_vector, 5, EXAMPLE).collect()]
    compact(spark, path, target, ("x", "y"), n=3)
    assert read_collection(spark, target).exceptAll(stored.select(*read_collection(spark, target).columns)).count() == 0
    assert read_catalog(spark, target).boxes == CATALOG.boxes
    write_collection(source, path, ATTRS, CATALOG, mode="append")
    assert read_collection(spark, path).count() == 2 * source.count()
    write_collection(source, path, ATTRS)  # replaces, unpartitioned
    assert read_collection(spark, path).count() == source.count()
    compact(spark, path, target, ("x",))
    assert read_collection(spark, target).count() == source.count()


def test_hot_partition_is_split(spark, tmp_path):
    """A third of the rows in one partition must not become one task."""
    df = spark.range(60_000).select("id", F.array(F.lit(0.0), F.rand(1)).alias("vector"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 100).alias("x"))
    catalog = Catalog.from_ranges(["x"], {"hot": {"x": (5, 5)}, "low": {"x": (None, 4)}, "high": {"x": (6, None)}})
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        write_collection(df, str(tmp_path / "c"), ["x"], catalog)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "c" / "part=hot").glob("*.parquet"))) > 1
    assert read_collection(spark, str(tmp_path / "c")).count() == 60_000


def test_workload_lines(spark, tmp_path):
    good = {"query": [0.5, 1.0], "conditions": {"and": [{"a": {"range": {"gt": 3, "lt": 9}}, "b": {"match": {"value": "q"}}}]}, "closest_ids": [4], "closest_scores": [0.5]}
    open_side = {**good, "conditions": {"and": [{"a": {"range": {"gt": 3}}}]}}
    no_ids = {k: v for k, v in good.items() if k != "closest_ids"}
    lines = [json.dumps(good), "{broken", json.dumps(open_side), json.dumps(no_ids), json.dumps(good)]
    (tmp_path / "w.jsonl").write_text("\n".join(lines))
    got = read_workload(spark, str(tmp_path / "w.jsonl"), ["a"]).collect()
    assert len(got) == 2
    r = got[0]
    assert (r.attr, r.lower, r.upper, r.closest_ids) == ("a", 4, 9, [4])
    assert [[tuple(l) for l in c] for c in r.dnf] == [[(0, False, 4), (0, True, 9)]]
    assert [(r.line, r.qid) for r in read_workload(spark, str(tmp_path / "w.jsonl"), ["a"], n=4).collect()] == [(0, 0)]
    assert sorted((r.line, r.qid) for r in got) == [(0, 0), (4, 4 << 16)]


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    lines = [f"{i} " + "x" * (i % 97) for i in range(4000)]
    (tmp_path / "a.txt").write_text("\n".join(lines[:2500]) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(lines[2500:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.value for r in sorted(got, key=lambda r: r.line)] == lines and sorted(r.line for r in got) == list(range(4000))


def test_run_files_and_configs(spark, tmp_path):
    folder = tmp_path / "r" / "trial=0" / "schema_id=1" / "workflow_id=2"
    folder.mkdir(parents=True)
    (folder / "r.json").write_text(json.dumps({"search_times": [5, 6], "filter_used": [], "tp": [1, 0], "fp": [0, 0], "fn": [0, 2]}, indent=4))
    got = read_run_arrays(spark, str(tmp_path / "r")).orderBy("pos").collect()
    assert [(r.trial, r.schema_id, r.search_time, r.filter_used, r.tp, r.fn) for r in got] == [(0, 1, 5, None, 1, 0), (0, 1, 6, None, 0, 2)]
    grid = spark.createDataFrame([(1, "b"), (0, "a")], "config_id bigint, index string")
    write_config(grid, str(tmp_path / "c"), ["index"], "schemas")
    assert {(r.config_id, r["index"]) for r in read_config(spark, str(tmp_path / "c"), "schemas", "index string").collect()} == {(0, "a"), (1, "b")}
    pretty = {"expanded_schemas": [{"index": "p"}, {"index": "q"}], "trials": 3}
    (tmp_path / "p.json").write_text(json.dumps(pretty, indent=4))
    assert [r["index"] for r in read_config(spark, str(tmp_path / "p.json"), "schemas", "index string").orderBy("config_id").collect()] == ["p", "q"]


def test_stream_ingest(spark, sf, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows_ = base(spark, sf)
    rows_.filter("id % 2 = 0").write.parquet(source)

    def drain():
        stream = spark.readStream.schema(rows_.schema).parquet(source)
        routed_ingest(stream, path, str(tmp_path / "ck"), ATTRS, CATALOG).trigger(availableNow=True).start().awaitTermination()

    drain()
    rows_.filter("id % 2 = 1").write.mode("append").parquet(source)
    drain()
    stored = read_collection(spark, path)
    assert stored.count() == rows_.count() and stored.filter(F.col("part") != CATALOG.route()).count() == 0
    assert read_catalog(spark, path).boxes == CATALOG.boxes
    write_collection(rows_.limit(10), path, ATTRS, CATALOG, mode="append")  # batch rows land beside streamed ones
    assert read_collection(spark, path).count() == rows_.count() + 10
    for other in (None, Catalog.from_ranges(ATTRS, {"all": {ATTRS[0]: (0, 1)}})):
        with pytest.raises(ValueError):
            write_collection(rows_.limit(10), path, ATTRS, other, mode="append")


def test_batches_keep_stored_rows_and_replace_their_own(spark, sf, tmp_path):
    rows_, path, bare = base(spark, sf), str(tmp_path / "out"), str(tmp_path / "bare")
    write_collection(rows_, bare, ATTRS)
    with pytest.raises(ValueError):
        append_batch(rows_, bare, "s-0", ATTRS, CATALOG)
    assert read_collection(spark, bare).count() == rows_.count()
    half = lambda n: rows_.filter(F.col("id") % 2 == n)
    for n, key in ((0, "s-1"), (1, "s-10"), (0, "s-1")):  # the last is a replay
        append_batch(half(n), path, key, ATTRS, CATALOG)
    stored = read_collection(spark, path)
    assert sorted(r.id for r in stored.select("id").collect()) == sorted(r.id for r in rows_.select("id").collect())
    assert stored.filter(F.col("part") != CATALOG.route()).count() == 0 and read_catalog(spark, path).boxes == CATALOG.boxes
    with pytest.raises(ValueError):
        append_batch(rows_, path, "s-2", ATTRS, Catalog.from_ranges(ATTRS, {"all": {ATTRS[0]: (0, 1)}}))


def test_shared_folder(spark):
    assert shared_dir(spark) != shared_dir(spark)
    assert materialise(spark.range(5)).count() == 5


def test_compaction_prunes_on_every_attribute(spark, tmp_path):
    """Files of 100 rows: their minimum and maximum let a filter on any one attribute skip most of them."""
    rows_ = spark.range(20_000).select("id", F.array(F.lit(0.0)).alias("vector"), *[(F.xxhash64(F.lit(i), "id") % 500 + 500).cast("int").alias(a) for i, a in enumerate(ATTRS)])
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    write_collection(rows_, source, ATTRS)
    compact(spark, source, target, ATTRS, n=4, rows_per_file=100)
    stored = read_collection(spark, target)
    assert stored.exceptAll(read_collection(spark, source)).count() == 0 and stored.count() == 20_000
    for attr in (ATTRS[0], ATTRS[-1]):
        touched = total = 0
        for f in (tmp_path / "t").glob("*.parquet"):
            meta = pq.ParquetFile(f).metadata
            at = meta.schema.names.index(attr)
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(at).statistics
                total += 1
                touched += stats.min <= 30 and stats.max >= 10
        assert total >= 200 and touched < 0.6 * total, (attr, touched, total)
