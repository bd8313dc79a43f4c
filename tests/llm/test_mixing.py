"""Targets, flows and selections of the mix, against exhaustive search where that is possible."""

import itertools
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectile.llm.mixing import membership, mix_documents, mixed_sizes, route, targets

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("size", T.StringType()), T.StructField("pattern", T.StringType())])


def test_targets():
    assert targets({"a": 100, "b": 100, None: 100}) == {"a": 50.0, "b": 100.0, None: 150.0}
    got = targets({"B": 10, "a": 1000, "é": 990, None: 0})
    assert got[None] == 0 and got["é"] + got["a"] + got["B"] == pytest.approx(2000) and got["B"] == 30.0
    assert targets({}) == {} and targets({"x": 0}) == {"x": 0.0}


def exhaustive(supply, quota, most):
    keys = [(p, s) for p in supply for s in p]
    best = None
    for flows in itertools.product(*[range(most * supply[p] + 1) for p, _ in keys]):
        by_pattern, by_source = Counter(), Counter()
        for (p, s), f in zip(keys, flows):
            by_pattern[p] += f
            by_source[s] += f
        if any(f > most * supply[p] for p, f in by_pattern.items()) or any(f > quota.get(s, 0) for s, f in by_source.items()):
            continue
        cost = sum(max(0, f - supply[p] * u) for p, f in by_pattern.items() for u in range(1, most))
        best = min(best or (0, 1 << 60), (-sum(flows), cost))
    return best


@pytest.mark.parametrize(
    "supply, quota",
    [
        ({("a",): 2, ("b",): 1, ("a", "b"): 2}, {"a": 4, "b": 5}),
        ({("a",): 1, ("a", "b"): 1, ("b", "c"): 1}, {"a": 3, "b": 2, "c": 4}),
        ({("a", "b"): 2, ("b",): 2}, {"a": 1, "b": 9}),
        ({(None,): 2, ("a",): 0}, {None: 3, "a": 2}),
    ],
)
def test_flow_is_largest_and_cheapest(supply, quota):
    routed = route(supply, quota)
    by_pattern, by_source = Counter(), Counter()
    for (p, s), f in routed.items():
        by_pattern[p] += f
        by_source[s] += f
    assert all(f <= 3 * supply[p] for p, f in by_pattern.items()) and all(f <= quota[s] for s, f in by_source.items())
    assert (-sum(routed.values()), sum(max(0, f - supply[p] * u) for p, f in by_pattern.items() for u in (1, 2))) == exhaustive(supply, quota, 3)


def check(rows, docs):
    words = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in docs}
    sizes = defaultdict(int)
    for r in docs:
        sizes[r[2]] += words[r[0]]
    goal, source = targets(dict(sizes)), {r[0]: r[2] for r in docs}
    taken = defaultdict(int)
    for r in rows:
        assert r.size == words[r.doc_id] and r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(goal[source[r.doc_id]])
        assert r.taken <= 3 * r.size and (r.taken % r.size == 0 if r.size else r.taken == 0)
        taken[source[r.doc_id]] += r.taken
    assert len(rows) == len(docs)
    return {s: (taken[s], goal[s]) for s in sizes}


def test_sources_come_near_their_targets(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    result = mixed_sizes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = result.collect()
    for taken, goal in check(rows, docs).values():
        assert abs(taken - goal) <= 0.005 * goal
    assert sorted(map(tuple, mixed_sizes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)).collect())) == sorted(map(tuple, rows))


def test_odd_rows(spark):
    docs = [(1, None, "a"), (2, "", None), (3, "one two\x0bthree", None), (4, "é\xa0x y", "B"), (5, "w " * 50_000, "b"), (6, " ", "z")] + [(10 + i, "w " * (i % 7), "b") for i in range(60)]
    df = spark.createDataFrame([(*d, "clash", "clash") for d in docs], DOCS)
    check(mixed_sizes(df).collect(), docs)
    mixed = mix_documents(df, membership("source"))
    assert mixed.columns == df.columns
    taken = {r.doc_id: r.taken // r.size for r in mixed_sizes(df).collect() if r.size}
    counted = Counter(r.doc_id for r in mixed.collect())
    assert {d: n for d, n in taken.items() if n} == {d: n for d, n in counted.items() if d in taken}
    again = spark.createDataFrame([(1, "a b c", "s", "", "")] * 5 + [(None, "d e", "s", "", "")], DOCS)
    assert len(mixed_sizes(again).collect()) == 6
    assert mixed_sizes(df.limit(0)).collect() == [] and mix_documents(df.limit(0), membership("source")).collect() == []


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, None, "", "") for i in range(200)]
    df = spark.createDataFrame(rows, DOCS)
    members = F.when(F.col("doc_id") < 50, F.array(F.lit("a"), F.lit("b"))).when(F.col("doc_id") < 120, F.array(F.lit("b"))).otherwise(F.array(F.lit("c"), F.lit("a")))
    counted = Counter(r.doc_id for r in mix_documents(df, members).collect())
    assert abs(sum(counted.values()) * 10 - 2000) <= 20 and max(counted.values()) <= 3


def test_equal_rows_meet_the_target(spark):
    rows = [(1, "a b c d e f g h i j", "s", "", "")] * 1000 + [(2 + i, "k l m", "t", "", "") for i in range(1000)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    got = mixed_sizes(df).collect()
    for size, (taken, goal) in {r.size: (sum(x.taken for x in got if x.size == r.size), r.target) for r in got}.items():
        assert abs(taken - goal) <= 0.005 * goal, (size, taken, goal)
    mixed = mix_documents(df, membership("source"))
    counted = Counter(r.doc_id for r in mixed.collect())
    assert counted[1] * 10 == sum(r.taken for r in got if r.size == 10)


def test_twins_with_other_columns_agree_over_partitions(spark):
    rows = [(1, "a b c d", "s", str(i % 50), "") for i in range(400)] + [(2, "e " * 30, "t", "", "")] * 20
    taken = lambda n: Counter(map(tuple, mix_documents(spark.createDataFrame(rows, DOCS).repartition(n), membership("source")).collect()))
    assert taken(2) == taken(6)


def test_many_overlapping_patterns_are_solved_in_seconds():
    import random
    import time

    draw = random.Random(5)
    names = [f"s{i:03d}" for i in range(100)]
    supply = {tuple(sorted(draw.sample(names, draw.randint(1, 5)))): draw.randint(1, 10**9) for _ in range(10_000)}
    quota = {s: draw.randint(10**9, 10**11) for s in names}
    start = time.time()
    routed = route(supply, quota)
    assert time.time() - start < 20
    by_pattern, by_source = Counter(), Counter()
    for (p, s), f in routed.items():
        by_pattern[p] += f
        by_source[s] += f
    assert all(by_pattern[p] <= 3 * n for p, n in supply.items()) and all(by_source[s] <= q for s, q in quota.items())
