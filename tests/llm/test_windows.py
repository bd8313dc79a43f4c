"""Removal of repeated windows against a dictionary of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from vectile.llm.suite import op13_repeated_windows
from vectile.llm.windows import drop_repeated_windows, pack_sorted, unpack_sorted

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("payload", T.MapType(T.StringType(), T.StringType()))])


def plain(rows, width):
    """(doc_id, n_words, n_removed, kept) in the order of ids; rows that share an id must be equal here."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - width + 1):
            own = tuple(words[i : i + width])
            if own in seen:
                gone.update(range(i, i + width))
            seen.add(own)
        out.append((doc_id, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def corpus(width, n=80, seed=1):
    draw = random.Random(seed)
    passages = [[f"p{draw.randrange(60)}" for _ in range(draw.randint(width - 2, 4 * width))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(draw.randint(0, 5)):
            words += draw.choice(passages) if draw.random() < 0.5 else [f"w{draw.randrange(5000)}" for _ in range(draw.randint(0, 3 * width))]
        rows.append((draw.randrange(10**12) if i % 7 else -i, draw.choice([" ", "\n", "\t "]).join(words)))
    rows += [(10**13 + i, rows[i % 3][1]) for i in range(40)]  # a group of copies
    rows += [(5, None), (6, ""), (7, " \n"), (8, "few words"), (9, "again " * 100), (3, "é ü " * 30), (3, "é ü " * 30), (None, rows[0][1])]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,words,slab,entries", [(20, 1 << 20, 25, 1 << 22), (20, 200, 10, 50), (3, 64, 12, 8), (1, 100, 16, 1 << 22)])
def test_against_all_windows(spark, width, words, slab, entries):
    rows = corpus(width, seed=width + words)
    docs = spark.createDataFrame([(i, t, {"k": "v"}) for i, t in rows], DOCS).repartition(7)
    found = drop_repeated_windows(docs, width, block_words=words, slab_bits=slab, group_entries=entries).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(rows, width)


def test_rows_that_share_an_id_keep_one_copy(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(4, text + " tail", None), (4, "head " + text, None), (4, text, None)]
    found = drop_repeated_windows(spark.createDataFrame(rows, DOCS), 20, block_words=1).collect()
    assert len(found) == 3 and sum(r.n_removed for r in found) == 100


def test_an_empty_table(spark):
    assert drop_repeated_windows(spark.createDataFrame([], DOCS), 20).count() == 0


def test_a_very_long_text(spark):
    words = [f"w{i % 30_011}" for i in range(60_000)]
    found = drop_repeated_windows(spark.createDataFrame([(1, " ".join(words), None)], DOCS), 20).first()
    assert tuple(found) == (1, 60_000, 60_000 - 30_011 - 0, " ".join(words[:30_011]))


def test_packed_numbers():
    for top in (1, 200, 70_000, 2**33, 2**63):
        values = np.unique(np.random.default_rng(top % 97).integers(0, top, 500, dtype=np.uint64))
        assert (unpack_sorted(pack_sorted(values)) == values).all()
    assert len(unpack_sorted(pack_sorted(np.empty(0, np.uint64)))) == 0


def test_the_query(spark, tmp_path):
    rows = corpus(20, seed=77)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((tuple(r) for r in op13_repeated_windows(spark, str(tmp_path)).collect()), key=str)
    assert found == sorted(((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in plain(rows, 20)), key=str)


def test_one_large_step_does_not_widen_all():
    values = np.cumsum(np.random.default_rng(5).integers(1, 1 << 15, 100_000)).astype(np.uint64)
    narrow = len(pack_sorted(values))
    values[50_000:] += np.uint64(1 << 40)
    packed = pack_sorted(values)
    assert (unpack_sorted(packed) == values).all()
    assert len(packed) < 1.1 * narrow  # six bytes each before
