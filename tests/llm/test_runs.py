"""Periodic runs against a search over all lags."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from vectile.llm.runs import find_runs, with_runs
from vectile.llm.suite import op11_periodic_runs


def plain_runs(words, shortest=6, repeats=4):
    """All maximal stretches at every lag, without those whose stretch has a smaller period."""
    found = []
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(shortest, repeats * q):
                own = words[i : i + length]
                if not any(all(own[t] == own[t + p] for t in range(length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(n=120, seed=5):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        alphabet = [f"w{i}" for i in range(draw.choice([1, 2, 3, 8, 200]))]
        words = []
        for _ in range(draw.randint(0, 6)):
            unit = [draw.choice(alphabet) for _ in range(draw.randint(1, 17))]
            words += unit * draw.randint(1, 7) + unit[: draw.randint(0, len(unit))]
        out.append(draw.choice([" ", "\n", "  \t"]).join(words))
    nested = (["a"] * 6 + ["b"]) * 5 + ["c"]
    return out + ["", " \n", "a", "a a a a a", "a a a a a a", " ".join(nested * 4), " ".join(["x"] * 3000), " ".join(f"u{i % 700}" for i in range(3000))]


@pytest.mark.parametrize("seed", range(6))
def test_finds_every_run(seed):
    docs = [t.split() for t in texts(60, seed)]
    codes, owner, known = [-1], [-1], {}
    for i, words in enumerate(docs):
        codes += [known.setdefault(w, len(known)) for w in words] + [-2 - i]
        owner += [i] * len(words) + [-1]
    runs = find_runs(np.array(codes), np.array(owner))
    starts = {i: owner.index(i) for i in set(owner) if i >= 0}
    for i, words in enumerate(docs):
        own = [(s - starts[i], n, q) for s, n, q in runs.tolist() if owner[s] == i]
        assert own == plain_runs(words), words


def test_a_run_needs_what_the_seeds_rely_on():
    with pytest.raises(ValueError):
        find_runs(np.array([0]), np.array([-1]), 6, 3)


def test_rows_nulls_repeats_and_other_columns(spark):
    schema = T.StructType([T.StructField(n, k) for n, k in [("doc_id", T.LongType()), ("text", T.StringType()), ("runs", T.MapType(T.StringType(), T.IntegerType())), ("row", T.StringType())]])
    rows = [(1, None, None, "x"), (None, "a a a a a a a b", {"k": 1}, None), (1, "", None, None), (2, "p q " * 9, None, None), (2, "p q " * 9, None, None), (3, "é " * 40_000, None, None)]
    found = with_runs(spark.createDataFrame(rows, schema)).select("row.doc_id", "n_words", "runs", "collapsed", "row.row").collect()
    result = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed, str(r.row)) for r in found)
    assert result == [
        ("1", 0, [], "", "None"),
        ("1", 0, [], "", "x"),
        ("2", 18, [(0, 18, 2)], "p q", "None"),
        ("2", 18, [(0, 18, 2)], "p q", "None"),
        ("3", 40_000, [(0, 40_000, 1)], "é", "None"),
        ("None", 8, [(0, 7, 1)], "a b", "None"),
    ]
    assert with_runs(spark.createDataFrame([], schema)).count() == 0


def plain_query(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    best = (None,) * 4
    if runs:
        top = runs[0]
        for r in runs:  # by start and period, so only a truly greater exponent wins
            if r[1] * top[2] > top[1] * r[2]:
                top = r
        best = (*top, 1000 * top[1] // top[2])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(plain_kept(words, runs)))


def test_the_query_against_a_search_over_all_lags(spark, tmp_path):
    rows = list(enumerate([None, *texts(150, 11), *[" ".join(f"v{i}" for i in range(n)) for n in range(1, 300, 7)]]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect())
    assert found == [plain_query(*r) for r in rows]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10


def test_ties_of_the_strongest_run(spark, tmp_path):
    """Equal exponents at one start and further on: the smallest start wins."""
    rows = [(1, "x y x y x y x y z " + "a b " * 4 + "c " + "d e f " * 4)]
    assert zlib.crc32(b"1") % 10
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = op11_periodic_runs(spark, str(tmp_path)).select("n_runs", "start", "length", "period", "exponent_milli").collect()
    assert [tuple(r) for r in found] == [(3, 0, 8, 2, 4000)]
