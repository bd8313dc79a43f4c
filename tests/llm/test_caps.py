"""Links and components of vectors against brute force, and the recall of the filters."""

import math

import numpy as np
from pyspark.sql import types as T

from vectile.llm import caps
from vectile.llm.caps import code_for, decode, near_vectors, product_code, rotation

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("cls", T.StringType())])


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, threshold=0.93):
    n = len(rows)
    near = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            (_, a, la, _), (_, b, lb, _) = rows[i], rows[j]
            if i != j and la is not None and la == lb and usable(a) and usable(b) and len(a) == len(b):
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                near[i][j] = x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold
    low = [r[0] for r in rows]
    for _ in range(n):
        new = [min([x for x in [low[i], *[low[j] for j in range(n) if near[i][j]]] if x is not None], default=None) for i in range(n)]
        if new == low:
            break
        low = new
    return sorted((str(r[0]), sum(near[i]), low[i], r[0] is not None and r[0] == low[i]) for i, r in enumerate(rows))


def vectors(n=60, dims=64, seed=1):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = draw.standard_normal(dims)
        for _ in range(draw.integers(1, 5)):
            noise = draw.standard_normal(dims) * np.linalg.norm(v) / math.sqrt(dims)
            rows.append((v + draw.choice([0, 0.1, 0.2, 0.3, 0.45]) * noise) * draw.choice([1.0, 1.0, 1e-3, 50.0]))
    rows = [(len(rows) - i, [float(np.float32(x)) for x in v], int(draw.integers(0, 3)), "c") for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * dims, [math.nan] + [1.0] * (dims - 1), [math.inf] * dims, [None] * dims, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0]]
    rows += [(5000 + i, v, 1, None) for i, v in enumerate(odd)]
    rows += [(6000, rows[0][1], None, None), (6001, rows[0][1], None, None), (None, rows[3][1], rows[3][2], "n"), rows[3], rows[3]]
    return rows


def result(df):
    return sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in df.collect())


def test_equals_brute_force(spark):
    rows = vectors()
    assert result(near_vectors(spark.createDataFrame(rows, VECTORS))) == brute(rows)


def test_blocks_of_a_large_group(spark):
    draw = np.random.default_rng(4)
    base = draw.standard_normal(64)
    rows = [(i, [float(np.float32(x)) for x in base + 0.2 * draw.standard_normal(64)], 7, "") for i in range(150)]
    rows += [(1000 + i, rows[0][1], 7, "") for i in range(40)]
    assert result(near_vectors(spark.createDataFrame(rows, VECTORS), block=16)) == brute(rows)


def test_decoding_equals_enumeration():
    draw = np.random.default_rng(2)
    x = draw.standard_normal((50, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = product_code(12, 3, 8, 5)
    sums = [x[:, at] @ rows.T for at, rows in code]
    full = (sums[0][:, :, None, None] + sums[1][:, None, :, None] + sums[2][:, None, None, :]).reshape(50, -1)
    row, name = decode(x, code, 0.5, 0)
    assert sorted(zip(row, name)) == sorted(zip(*np.nonzero(full >= 0.5)))
    row, _ = decode(x, code, 0.99, 5)
    assert (np.bincount(row, minlength=50) >= 5).all()


def test_recall_at_the_threshold():
    draw = np.random.default_rng(3)
    x = draw.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = draw.standard_normal((3000, 64))
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * side
    code = product_code(64, 2, 1024, 42)
    of = lambda v: [set(g[1]) for g in _lists(*decode(v, code, 4.0 / 8, 32), len(v))]
    common = [bool(a & b) for a, b in zip(of(x), of(y))]
    assert np.mean(common) >= 0.99


def _lists(row, name, n):
    return [(i, name[row == i]) for i in range(n)]


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], VECTORS)).collect() == []


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def test_levels_keep_recall_and_bound_what_meets():
    draw = np.random.default_rng(6)
    x = unit(draw.standard_normal((400, 64)))
    side = draw.standard_normal((400, 64))
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    shares = []
    for level in (0, 1, 2, 4):
        code, cap = code_for(64, level, 2, 1024, 4.0, 42)
        filters = math.prod(len(rows) for _, rows in code)
        assert filters >= 4**level * 1024**2
        of = lambda v: [set(g) for g in _names(*decode(v, code, cap, 32), len(v))]
        one, two = of(x), of(y)
        assert np.mean([bool(a & b) for a, b in zip(one, two)]) >= 0.9, level
        # The largest label of a level has four times the vectors of the one below: each filter takes as many of them.
        shares.append(np.mean([len(a) for a in one]) / filters * 4**level)
    assert max(shares) <= 3 * shares[0]


def _names(row, name, n):
    return [name[row == i].tolist() for i in range(n)]


def test_large_labels_take_more_filters(spark, monkeypatch):
    monkeypatch.setattr(caps, "CROWD", 40)
    rows = vectors()
    assert result(near_vectors(spark.createDataFrame(rows, VECTORS))) == brute(rows)


def test_long_labels_and_double_components(spark):
    turn = math.acos(0.93)
    flat = [[1.0] + [0.0] * 7, [math.cos(turn - 1e-9), math.sin(turn - 1e-9)] + [0.0] * 6, [math.cos(turn + 1e-9), -math.sin(turn + 1e-9)] + [0.0] * 6]
    rows = [(i, v, 2**40 + 1) for i, v in enumerate(flat)] + [(9, flat[0], 2**40 + 1 + 2**32)]
    shape = "vec_id long, embedding array<double>, label long"
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, shape)).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2), 9: (0, 9)}


def test_recall_with_few_dimensions_and_sparse_vectors():
    draw = np.random.default_rng(8)
    for dims in (3, 8, 16, 24, 64):
        for filled in {2, dims}:
            x = np.zeros((300, dims))
            x[:, :filled] = draw.standard_normal((300, filled))
            x = unit(x)
            side = np.zeros((300, dims))
            side[:, :filled] = draw.standard_normal((300, filled))
            side -= (side * x).sum(axis=1, keepdims=True) * x
            y = 0.93 * x + math.sqrt(1 - 0.93**2) * unit(side)
            code, cap = code_for(dims, 0, 2, 1024, 4.0, 42)
            of = lambda v: [set(g) for g in _names(*decode(v @ rotation(dims, 42), code, cap, 32), len(v))]
            assert np.mean([bool(a & b) for a, b in zip(of(x), of(y))]) >= 0.9, (dims, filled)
