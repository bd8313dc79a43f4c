import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from suite.tables import EXAMPLE, SIX_BOXES
from vectile.functions.predicates import all_of, at_least, negate
from vectile.operators import tree as tree_ops
from vectile.operators.catalog import UNMATCHED, Catalog, bucket_of, mod_partition, validate
from vectile.operators.tree import TreeParams, build_tree
from vectile.operators.workload import atom_list, characterize, explode_atomics

XY = ("x", "y")
SIX = Catalog.from_ranges(XY, SIX_BOXES)


def test_six_boxes(spark):
    row = spark.createDataFrame([(100, 200)], "x int, y int")
    assert row.select(SIX.route()).first()[0] == "part_3"
    assert SIX.prune_names(spark, at_least("x", 100)) == ["part_0", "part_1", "part_2", "part_3", UNMATCHED]
    assert SIX.prune_names(spark, None) == SIX.names
    assert "part_0" not in SIX.prune_names(spark, EXAMPLE)


def test_overlaps():
    assert SIX.overlapping() == []
    cat = Catalog.from_ranges(XY, {"a": {"x": (0, 10)}, "b": {"x": (10, 20), "y": (None, 5)}, "c": {"x": (10, 10), "y": (6, None)}})
    assert cat.overlapping() == [("a", "b"), ("a", "c")]


def test_equal_width():
    names = Catalog.equal_width(("w", "x"), 1000, 10).names
    assert names[:3] == ["0_99", "100_199", "200_299"] and names[9] == "900_999" and names[-1] == UNMATCHED
    gaps = Catalog.equal_width(("w",), 10, 3)
    assert gaps.names[:3] == ["0_2", "3_5", "7_9"]  # 6 lies in no slice


def test_routing_of_overlaps_and_gaps(spark, monkeypatch):
    rng = random.Random(3)
    pick = lambda: tuple(sorted(rng.sample(range(0, 40), 2)))
    for trial in range(5):
        ranges = {f"p{i}": {a: pick() for a in ("a", "b", "c") if rng.random() < 0.7} for i in range(8)}
        cat = Catalog.from_ranges(("a", "b", "c"), ranges)
        rows = [tuple(rng.randrange(-2, 43) for _ in "abc") for _ in range(200)]
        df = spark.createDataFrame(rows, "a int, b int, c int")

        def first(row):
            for name, r in ranges.items():
                if all(r[a][0] <= v <= r[a][1] for a, v in zip("abc", row) if a in r):
                    return name
            return UNMATCHED

        want = [first(r) for r in rows]
        assert [r[0] for r in df.select(cat.route()).collect()] == want
        with monkeypatch.context() as m:
            m.setattr("vectile.operators.catalog.MAX_LOOKUP_CELLS", 1)
            assert [r[0] for r in df.select(cat.route()).collect()] == want


def test_catalog_table_roundtrip(spark, tmp_path):
    SIX.to_df(spark).write.parquet(str(tmp_path / "c"))
    back = Catalog.from_df(spark.read.parquet(str(tmp_path / "c")))
    assert back.boxes == SIX.boxes and back.attrs == SIX.attrs and back.unmatched
    assert {r.part: r.path for r in SIX.to_df(spark).collect()}["part_2"] == "(x >= 100) and (y >= 300) and (not(x >= 500))"


def test_buckets_and_mod(spark):
    df = spark.createDataFrame([(v,) for v in range(12)], "v int")
    assert [r[0] for r in df.select(bucket_of(F.col("v"), [2, 5, 9])).collect()] == [sum(v >= c for c in (2, 5, 9)) for v in range(12)]
    assert [r[0] for r in df.select(bucket_of(F.col("v"), [])).collect()] == [0] * 12
    for cuts in ([0], [2, 5, 9], [1, 2, 3, 4, 5, 6, 7, 8], list(range(3, 11))):
        want = [sum(v >= c for c in cuts) for v in range(12)]
        assert [r[0] for r in df.select(bucket_of(F.col("v"), cuts, max_case=0)).collect()] == want
    assert df.select(mod_partition(F.col("v"), 3)).distinct().count() == 3


def test_routes_equal_pruning_and_lose_nothing(spark):
    preds = [EXAMPLE, at_least("x", 100), all_of(), negate(at_least("x", 100)), all_of(at_least("x", 500), negate(at_least("x", 100)))]
    from vectile.functions.predicates import dnf_literal

    queries = None
    for i, p in enumerate(preds):
        q = spark.range(1).select(F.lit(i).cast("bigint").alias("qid"), dnf_literal(p, XY).alias("dnf"))
        queries = q if queries is None else queries.union(q)
    queries = queries.union(spark.range(1).select(F.lit(99).cast("bigint").alias("qid"), F.lit(None).cast(q.schema["dnf"].dataType).alias("dnf")))
    got = {}
    for r in SIX.routes(queries).collect():
        got.setdefault(r.qid, set()).add(r.part)
    for i, p in enumerate(preds):
        assert got[i] == set(SIX.prune_names(spark, p))
    assert got[99] == set(SIX.names)


# -- tree ----------------------------------------------------------------------------------------


def assert_grown(tree, data, atoms, params):
    """What holds for a finished tree: which candidates were passed over, which one was taken, and why growth ended."""
    order = [(a, v) for a, v, f in sorted(atoms, key=lambda c: -c[2]) if f >= params.min_predicate_frequency]
    taken = {path: order.index((tree.attrs[s.attr], s.value)) for path, s in tree.splits.items()}
    leaves = tree.leaf_paths()
    assert leaves == sorted(leaves) and len(leaves) == len(tree.splits) + 1 <= max(params.max_num_partitions, 1)
    assert all(path[:i] in taken for path in taken for i in range(len(path)))  # every split hangs on a split

    def held(path):
        sides = [(*order[taken[path[:i]]], side == "0") for i, side in enumerate(path)]
        return [r for r in data if all((r[a] >= v) == above for a, v, above in sides)]

    def divides(rows, at):
        attr, value = order[at]
        above = sum(r[attr] >= value for r in rows)
        share = above / len(rows)
        return params.selectivity_threshold <= share <= 1 - params.selectivity_threshold and params.min_partition_size <= min(above, len(rows) - above)

    def first_open(path):
        return taken[path[:-1]] + 1 if path else 0

    for path, at in taken.items():
        rows = held(path)
        assert divides(rows, at) and not any(divides(rows, i) for i in range(first_open(path), at))
    # The budget goes to nodes in path order, so only leaves behind the last split can have ended for lack of it.
    spent = len(leaves) == params.max_num_partitions
    for path in leaves:
        if not spent or (taken and path < max(taken)):
            rows = held(path)
            assert not any(divides(rows, i) for i in range(first_open(path), len(order)))


def test_golden_tree(spark):
    rows = spark.range(100_000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).cast("int").alias("x"), F.pmod(F.xxhash64(F.col("id") + 7), F.lit(1000)).cast("int").alias("y"))
    tree = build_tree(rows, XY, [("x", 500, 10), ("x", 100, 9), ("y", 300, 8)], TreeParams(max_num_partitions=5))
    cat = tree.catalog()
    assert [b.name for b in cat.boxes] == ["part_0", "part_1"]
    assert str(tree) == "x >= 500\n  part_0\nnot(x >= 500)\n  part_1"
    one = spark.createDataFrame([(100, 200)], "x int, y int")
    assert one.select(tree.route()).first()[0] == "part_1" == one.select(cat.route()).first()[0]


def test_characterized_example(spark):
    from vectile.functions.predicates import to_dnf
    from vectile.functions.predicates import DNF_TYPE

    preds = [all_of(at_least("x", 100), negate(at_least("x", 500))), all_of(at_least("x", 500)), all_of(at_least("x", 500), negate(at_least("y", 300)))]
    rows = [(i, [[{"attr": a, "neg": n, "value": v} for a, n, v in c] for c in to_dnf(p, XY)]) for i, p in enumerate(preds)]
    workload = spark.createDataFrame(rows, f"qid bigint, dnf {DNF_TYPE}")
    assert atom_list(characterize(explode_atomics(workload, XY))) == [("x", 500, 3), ("x", 100, 1), ("y", 300, 1)]


@pytest.mark.parametrize("seed", range(6))
def test_tree_properties(spark, seed):
    rng = random.Random(seed)
    attrs = ("a", "b", "c")
    skewed = lambda: 7 if rng.random() < 0.3 else rng.randrange(0, 20)  # a third of the rows share one value
    data = [{a: skewed() for a in attrs} for _ in range(300)]
    atoms = list({(rng.choice(attrs), rng.randrange(1, 20)): rng.randrange(1, 6) for _ in range(25)}.items())
    atoms = [(a, v, f) for (a, v), f in atoms]
    params = TreeParams(rng.choice([1, 2]), rng.choice([0.05, 0.11, 0.2]), rng.choice([1, 5, 20]), rng.choice([1, 2, 3, 7, 50]))
    df = spark.createDataFrame([tuple(r[a] for a in attrs) for r in data], "a int, b int, c int")
    tree = build_tree(df, attrs, atoms, params, local_cells=rng.choice([0, 3, 40, 200_000]))  # by levels, in one pass, or both
    assert_grown(tree, data, atoms, params)
    assert build_tree(df, attrs, atoms, params).splits == tree.splits
    checked = validate(df, tree.catalog()).collect()
    assert sum(r.n_rows for r in checked) == 300 and all(r.n_rows == r.n_inside for r in checked)
    routed = df.select(((tree.case_route() == tree.catalog().route()) & (tree.case_route() == tree.descent())).alias("same"))
    assert routed.filter("not same").count() == 0


def test_budget_is_fresh_for_every_build(spark):
    df = spark.range(1000).select(F.col("id").cast("int").alias("x"))
    atoms = [("x", v, 10) for v in range(100, 1000, 100)]
    params = TreeParams(1, 0.01, 10, 4)
    first, second = (build_tree(df, ["x"], atoms, params) for _ in range(2))
    assert first.splits == second.splits and [b.name for b in second.catalog().boxes] == ["part_0", "part_1", "part_2", "part_3"]
    assert build_tree(df, ["x"], atoms, TreeParams(1, 0.01, 10, 1)).leaf_paths() == [""]
    assert build_tree(df, ["x"], [], params).catalog().names == ["part_0"]
    assert tree_ops.TreeParams() == TreeParams(10, 0.11, 1000, 4096)
    zero = build_tree(df.withColumn("x", F.col("x") - 500), ["x"], [("x", 0, 5)], TreeParams(1, 0.1, 10, 4)).catalog()
    assert (zero.boxes[0].lo, zero.boxes[1].hi) == ((0,), (-1,))  # a bound of 0 is a bound


def test_large_catalog_routes_by_lookup(spark):
    n = 32
    ranges = {f"g{i}_{j}": {"x": (i * 10, i * 10 + 9), "y": (j * 10, j * 10 + 9)} for i in range(n) for j in range(n)}
    cat = Catalog.from_ranges(XY, ranges)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in np.random.default_rng(1).integers(0, 330, (500, 2))], "x int, y int")
    for r in df.select("x", "y", cat.route().alias("p")).collect():
        assert r.p == (f"g{r.x // 10}_{r.y // 10}" if r.x < 320 and r.y < 320 else UNMATCHED)


def test_routing_past_the_lookup_table(spark):
    """32 cuts on each of four attributes: 33^4 cells are too many for a table, and no box is tested one by one."""
    rng = np.random.default_rng(6)
    attrs = ("a", "b", "c", "d")
    boxes = {f"g{i}": {x: tuple(sorted(int(v) for v in rng.integers(0, 400, 2))) for x in attrs} for i in range(300)}
    cat = Catalog.from_ranges(attrs, boxes)
    assert all(len(c) >= 32 for c in cat.cuts()) and cat.n_cells() > 2**20
    rows = rng.integers(-10, 410, (400, 4))
    df = spark.createDataFrame([tuple(int(v) for v in r) for r in rows], "a int, b int, c int, d int")
    inside = lambda r, box: all(box[x][0] <= v <= box[x][1] for x, v in zip(attrs, r))
    for r in df.select(*attrs, cat.route().alias("p")).collect():
        assert r.p == next((name for name, box in boxes.items() if inside(r[:4], box)), UNMATCHED)


def test_two_hundred_thresholds_on_four_attributes(spark):
    """Far more cells than rows; the tree is the one that plain counting gives, and the descent routes to it."""
    rng = np.random.default_rng(9)
    attrs = ("a", "b", "c", "d")
    rows = rng.integers(0, 1000, (4000, 4))
    df = spark.createDataFrame([tuple(int(v) for v in r) for r in rows], "a int, b int, c int, d int")
    atoms = [(x, v, int(rng.integers(10, 10_000))) for x in attrs for v in range(5, 1000, 5)]
    params = TreeParams(10, 0.11, 20, 200)
    tree = build_tree(df, attrs, atoms, params, local_cells=900)
    ordered = sorted(atoms, key=lambda t: -t[2])
    place = {x: i for i, x in enumerate(attrs)}

    def grow(path, own, first, out):
        for i in range(first, len(ordered)):
            x, v, _ = ordered[i]
            up = own[:, place[x]] >= v
            if 0.11 <= up.mean() <= 0.89 and min(up.sum(), (~up).sum()) >= 20:
                out[path] = (x, v)
                grow(path + "0", own[up], i + 1, out)
                grow(path + "1", own[~up], i + 1, out)
                return

    import sys

    sys.setrecursionlimit(10_000)
    want = {}
    grow("", rows, 0, want)
    kept = dict(sorted(want.items())[:199])
    assert {p: (attrs[s.attr], s.value) for p, s in tree.splits.items()} == kept
    sizes = {r.part: r["count"] for r in df.groupBy(tree.descent().alias("part")).count().collect()}
    assert sizes == {r.part: r.n_rows for r in validate(df, tree.catalog()).collect() if r.n_rows}
