import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from vectile.operators import attributes as attr_ops
from vectile.operators import evaluation as ev
from vectile.operators import grid as gr
from vectile.operators import workload as wl
from vectile.operators.catalog import atom_selectivity, selectivity
from vectile.functions.predicates import at_least
from vectile.functions.vectors import hash_uniform
from vectile.operators.quantiles import quantiles, slices_of
from vectile.plans.pipelines import fixed_selectivity_queries, score

ATTRS = ("w", "x", "y", "z")


def test_sampled_workload_follows_its_distributions(spark):
    n = 40_000
    params = wl.synthetic_params(spark, ATTRS, seed=3)
    assert params == wl.synthetic_params(spark, ATTRS, seed=3) != wl.synthetic_params(spark, ATTRS, seed=4)
    for weights in (params.attr_weights, params.length_weights, *params.threshold_weights):
        assert abs(sum(weights) - 1) < 1e-9 and all(w > 0 for w in weights)
    drawn = wl.sample_workload(spark.range(n).withColumnRenamed("id", "qid"), params)
    rows = drawn.select("kind", F.size("dnf").alias("clauses"), F.flatten("dnf").alias("lits")).collect()
    kinds = {k: sum(r.kind == k for r in rows) / n for k in wl.KINDS}
    assert kinds["none"] == 0 and all(abs(kinds[k] - 1 / 3) < 0.02 for k in ("single", "and", "or"))
    lengths = np.bincount([len(r.lits) for r in rows if r.kind == "and"], minlength=4) / sum(r.kind == "and" for r in rows)
    assert np.abs(lengths[:4] - params.length_weights).max() < 0.02 and len(lengths) == 4
    first = np.bincount([r.lits[0].attr for r in rows if r.kind == "single"], minlength=4)
    assert np.abs(first / first.sum() - params.attr_weights).max() < 0.02
    for r in rows:
        attrs = [l.attr for l in r.lits]
        assert len(set(attrs)) == len(attrs) and all(l.value in wl.THRESHOLDS and not l.neg for l in r.lits)
        assert r.clauses == (len(r.lits) if r.kind == "or" else 1)
    # the same keys in another partitioning draw the same filters
    again = wl.sample_workload(spark.range(0, n, 1, 7).withColumnRenamed("id", "qid").repartition(5), params)
    assert again.exceptAll(drawn).count() == 0


def test_exponential_weights(spark):
    ranks = spark.createDataFrame([("a", i) for i in range(4)], "name string, choice int")
    got = [r.weight for r in wl.exponential_weights(ranks, F.lit(0.25)).orderBy("choice").collect()]
    want = np.exp(-0.25 * np.arange(4))
    assert np.allclose(got, want / want.sum())


def test_attribute_distributions(spark):
    u, v = hash_uniform(F.col("id"), 1), hash_uniform(F.col("id"), 2)
    df = spark.range(50_000).select(
        attr_ops.uniform_attribute(u, 0, 1000).alias("u"), attr_ops.geometric_attribute(u, 0.2).alias("g"), attr_ops.normal_attribute(u, v, 500, 150).alias("n")
    ).toPandas()
    assert 0 <= df.u.min() and df.u.max() < 1000 and abs(df.u.mean() - 499.5) < 5
    assert df.g.min() == 1 and abs(df.g.mean() - 5) < 0.1
    assert abs(df.n.mean() - 500) < 3 and abs(df.n.std() - 150) < 3
    many = attr_ops.with_uniform_attributes(spark.range(20_000), ["p", "q"], 1000).toPandas()
    assert abs(np.corrcoef(many.p, many.q)[0, 1]) < 0.03


def test_attribute_histogram(spark):
    df = spark.createDataFrame([(v,) for v in (-1, 0, 9, 10, 979, 980, 989, 990, 991)], "v int")
    got = {r.bin: (r.lo, r.n) for r in attr_ops.histogram(df, "v", 0, 1000, 10).collect()}
    assert got == {0: (0, 2), 1: (10, 1), 97: (970, 1), 98: (980, 3)}


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.lognormal(0, 3, 700)] + [("b", 4.0)] * 300 + [("b", float(x)) for x in range(5)] + [("c", 1.5)]
    rows += [(None, float(x)) for x in range(40)]  # null is a group like any other
    df = spark.createDataFrame([*rows, ("a", None), ("empty", None)], "g string, v double")
    probs = [0, 0.001, 0.25, 0.5, 0.77, 0.99, 0.999, 1]
    got = {r.g: r.q for r in quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g in ("a", "b", "c", None):
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g], probs), rtol=1e-12)
    everything = quantiles(df, [], "v", probs).first().q
    assert np.allclose(everything, np.quantile([v for _, v in rows], probs), rtol=1e-12)
    both = quantiles(df.withColumn("h", F.lit(None).cast("int")), ["h", "g"], "v", [0.5]).collect()
    assert {(r.h, r.g) for r in both} == {(None, g) for g in got}
    assert quantiles(df.limit(0), ["g"], "v", probs).count() == 0


def test_slices_hold_as_many_values_whatever_their_size(spark):
    """One far outlier and one value that half the rows share: slices are cut by the number of distinct values."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(40_000).select(F.when(F.col("id") == 7, 1e300).when(F.col("id") % 2 == 0, 0.5).otherwise(F.col("id") / 1e6).alias("v"))
        sizes = [r["count"] for r in slices_of(df, [], "v").groupBy("slice").count().collect()]
        assert len(sizes) == 4 and max(sizes) < 2 * 20_001 / 4
        q = quantiles(df, [], "v", [0.5, 0.75, 1]).first().q
        assert np.allclose(q, np.quantile([1e300 if i == 7 else 0.5 if i % 2 == 0 else i / 1e6 for i in range(40_000)], [0.5, 0.75, 1]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_golden_statistics(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10)], "search_time double")
    assert abs(ev.time_percentiles(df, [], [99]).first().value - 9.76) < 1e-12
    r = ev.time_stats(df, []).first()
    assert (r["mean"], r["median"], r["max"], r["min"]) == (4.0, 3.0, 10.0, 1.0) and abs(r["std"] - 3.1622776601683795) < 1e-12


def test_confusion_and_recall(spark):
    truth = spark.createDataFrame([(0, 1), (0, 2), (0, 2), (1, 5), (3, 1)], "qid bigint, id bigint")
    found = spark.createDataFrame([(0, 2), (0, 2), (0, 9), (1, 5), (2, 7)], "qid bigint, id bigint")
    queries = spark.range(5).withColumnRenamed("id", "qid")
    got = {r.qid: (r.tp, r.fp, r.fn, r.recall) for r in score(truth, found, queries).collect()}
    assert got == {0: (1, 1, 1, 0.5), 1: (1, 0, 0, 1.0), 2: (0, 1, 0, 0.0), 3: (0, 0, 1, 0.0), 4: (0, 0, 0, 0.0)}
    lists = spark.createDataFrame([([1, 2, 2], [2, 9, 9])], "t array<int>, r array<int>")
    assert ev.confusion_of_lists(lists, "t", "r").select("tp", "fp", "fn").first() == (1, 1, 1)


def test_histograms(spark):
    rng = np.random.default_rng(4)
    times = rng.lognormal(1, 1, 500)
    df = spark.createDataFrame([(float(t), bool(t > 3)) for t in times], "search_time double, filter_used boolean")
    counts, edges = np.histogram(times, np.logspace(np.log10(times.min()), np.log10(times.max()), 50))
    got = {r.bin: r.n for r in ev.time_histogram(df, 49).collect()}
    assert sum(got.values()) == 500 and sum(abs(got.get(i, 0) - c) for i, c in enumerate(counts)) <= 2
    linear, _ = np.histogram(times, 30)
    assert {r.bin: r.n for r in ev.time_histogram(df, 30, log=False).collect()} == {i: c for i, c in enumerate(linear) if c}
    rows = ev.histogram_density(df, 30, log=False).collect()
    assert abs(sum(r.density for r in rows) * (times.max() - times.min()) / 30 - 1) < 1e-9
    assert ev.time_histogram(df.limit(0), 30).count() == 0
    odd = spark.createDataFrame([(0.0,), (-3.0,), (1.0,), (None,), (100.0,)], "search_time double")
    assert [(r.bin, r.n) for r in ev.time_histogram(odd, 2).orderBy("bin").collect()] == [(-1, 2), (0, 1), (1, 1)]
    assert ev.time_histogram(odd.filter("search_time <= 0"), 2).select("bin", "n", "lo", "hi").collect() == [(-1, 2, None, 0.0)]
    same = spark.createDataFrame([(2.0,), (2.0,)], "search_time double")
    assert [(r.bin, r.n) for r in ev.time_histogram(same, 30).collect()] == [(0, 2)]


def test_trials_weigh_the_same(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 1, 1), ("a", 0, 3.0, 1, 1), ("a", 1, 10.0, 0, 0)], "g string, trial int, search_time double, tp int, fn int")
    r = ev.mean_over_trials(df, ["g"], percent=50).first()
    assert (r.mean_time, r.mean_recall, r.tail_time) == (6.0, 0.25, 6.0)


def test_grid(spark):
    row = spark.createDataFrame([([0.01, 0.1], [16, 32], "adam")], "rate array<double>, size array<int>, optimizer string")
    got = gr.expand_grid(row, ["rate", "size", "optimizer"]).orderBy("config_id").collect()
    assert [tuple(r) for r in got] == [(0, 0.01, 16, "adam"), (1, 0.01, 32, "adam"), (2, 0.1, 16, "adam"), (3, 0.1, 32, "adam")]
    runs = spark.createDataFrame([(0.1, 16), (0.5, 16)], "rate double, size int")
    configs = gr.expand_grid(row, ["rate", "size"])
    assert gr.lookup(runs, configs, ["rate", "size"]).select("config_id").collect() == [(2,)]
    assert gr.missing(runs, configs, ["rate", "size"]).collect() == [(0.5, 16)]


def test_selectivity_of_many_atoms(spark):
    df = spark.range(1000).select(F.col("id").cast("int").alias("a"), (F.col("id") % 10).cast("int").alias("b"), F.when(F.col("id") < 500, F.col("id").cast("int")).alias("c"))
    atoms = [("a", v) for v in range(-5, 1005)] + [("b", 5), ("b", 10), ("c", 250)]
    got, short = atom_selectivity(df, atoms), atom_selectivity(df, atoms[:1000] + atoms[-3:])
    assert plan_of(got).count("\n") == plan_of(short).count("\n")  # the plan does not grow with the predicates
    want = {("a", v): min(1000, max(0, 1000 - v)) / 1000 for v in range(-5, 1005)} | {("b", 5): 0.5, ("b", 10): 0.0, ("c", 250): 0.25}
    assert {(r.attr, r.value): r.selectivity for r in got.collect()} == want
    assert atom_selectivity(df.limit(0), [("a", 1)]).collect() == [("a", 1, None)]


def test_selectivity_and_fraction(spark):
    df = spark.range(100).select(F.col("id").cast("int").alias("x"))
    assert {r.predicate: r.selectivity for r in selectivity(df, {"p": at_least("x", 75)}).collect()} == {"p": 0.25}
    queries = spark.range(5000).withColumnRenamed("id", "qid")
    out = fixed_selectivity_queries(queries, ["x"], "x", 1000, 0.1, 0.3)
    assert abs(out.filter("filter_used").count() / 5000 - 0.3) < 0.03
    assert out.filter("filter_used = (dnf is null)").count() == 0
