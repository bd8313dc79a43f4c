"""Codes, n-gram counts and held-out accuracy of language identification."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from vectile.llm import langid
from vectile.llm.langid import codewords, fit_languages, gram_counts, identify_languages, predict_languages

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType())])


@pytest.mark.parametrize("classes", [2, 3, 4, 7, 8, 40])
def test_codewords_are_apart(classes):
    code = codewords(classes)
    gaps = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
    assert set(np.unique(code)) == {-1, 1} and min(gaps) >= (1 if classes == 2 else 2 ** (classes - 2) if classes <= 7 else 5)
    assert (np.abs(code.sum(axis=0)) < classes).all()


def test_blocks_do_not_change_counts(monkeypatch):
    text = "Größe – déjà vu, 日本 x1y! " * 300
    whole = gram_counts(text)
    monkeypatch.setattr(langid, "BLOCK_CHARS", 1000)
    parts = gram_counts(text)
    assert parts.sum() >= whole.sum() and np.abs(parts - whole).sum() <= 9 * (len(text) // 1000)


def plain_grams(text):
    """The 1-, 2- and 3-grams of a text one by one, as the buckets they fall into."""
    chars, counts = [c if c.isalpha() else " " for c in text.lower()], np.zeros(langid.BUCKETS, np.int64)
    factors = [[1], [0x27D4EB2F, 0x165667B1], [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D]]
    for n, own in enumerate(factors, 1):
        for i in range(len(chars) - n + 1):
            gram = chars[i : i + n]
            if gram[0] == " " and gram[-1] == " ":
                continue
            mixed = (sum(ord(c) * f for c, f in zip(gram, own)) + n - 1) * 0x9E3779B97F4A7C15 % 2**64
            counts[mixed >> 49] += 1
    return counts


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000, 1 << 20])
def test_counts_equal_plain_counts_at_every_block_size(monkeypatch, size):
    monkeypatch.setattr(langid, "BLOCK_CHARS", size)
    for text in ("Größe – déjà vu, 日本 x1y! " * 20, "a", "ab", " ab  c", "", "ΟΔΟΣ ΟΔΟΣ"):
        assert (gram_counts(text) == plain_grams(text)).all()


def test_decoding_equals_a_plain_search_of_the_codewords():
    draw = np.random.default_rng(7)
    for classes in (2, 3, 5, 9):
        code = codewords(classes)
        model = langid.LanguageModel([f"l{i}" for i in range(classes)], code, draw.standard_normal((langid.BUCKETS, code.shape[1])))
        for text in ("the cat sat", "été", "x", "日本 go 12"):
            counts = plain_grams(text)
            losses = []
            for word in code:
                margins = [sum(int(counts[b]) * model.weights[b, k] for b in np.flatnonzero(counts)) / counts.sum() for k in range(code.shape[1])]
                losses.append(sum(math.log1p(math.exp(-4 * bit * m)) for bit, m in zip(word, margins)))
            order = sorted(range(classes), key=lambda i: losses[i])
            name, score, close = model.decode(text, 1.0)
            assert name == f"l{order[0]}" and score == pytest.approx(1 / sum(math.exp(losses[order[0]] - x) for x in losses))
            assert close == (losses[order[1]] - losses[order[0]] < 1.0)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang]
    assert len(held) > 100 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(1, None, "a", "x"), (2, "", "a", None), (3, "123 !? \n", "b", None), (None, "the cat", "b", None), (7, "le chat et la souris", None, None), (7, "le chat et la souris", None, None), (8, "été " * 200_000, "fr", None)]
    rows += [(100 + i, "the cat and the dog " * 3, "en", None) for i in range(10)] + [(200 + i, "le chat et la souris " * 3, "fr", None) for i in range(10)]
    found = predict_languages(spark.createDataFrame(rows, DOCS)).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    assert all(by[i].lang_pred == "und" and by[i].score == 0.0 for i in (1, 2, 3))
    assert by[7].lang_pred == "fr" and by[None].held_out


def test_without_languages_and_rows(spark):
    df = spark.createDataFrame([(1, "text", None, None)], DOCS)
    assert [(r.lang_pred, r.score) for r in predict_languages(df).collect()] == [("und", 0.0)]
    assert predict_languages(df.limit(0)).collect() == []
    one = fit_languages(spark.createDataFrame([(1, "text", "xx", None)], DOCS))
    assert [r.lang_pred for r in identify_languages(df, one).collect()] == ["xx"]
