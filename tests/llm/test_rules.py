"""Statistics of the quality rules against plain Python, and the verdict of the ratio."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectile.llm.rules import BUCKETS, apply_rules, fit_ratio

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("words", T.StringType()), T.StructField("kept", T.StringType())])


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def rows():
    draw = random.Random(7)
    texts = [None, "", " \n\t\x0b", "one", "a b", "a a a", "a a a a", "a b c a b c", "a b c x a b c d b c d", "x\ny\nx\n\n \n \nx ", "é\xa0b 𝒳𝒴 #*|<>$%&", "w " * 49, "w" * 100_000, "a b c d " * 30_000]
    for _ in range(120):
        texts.append("".join(draw.choice("abc d") + draw.choice(["", " ", "\n", "# "]) for _ in range(draw.randint(0, 400))))
    return [(i if i != 5 else None, t, "clash", "clash") for i, t in enumerate(texts)] + [(7, "a b c a b c", "", "")] * 2


def test_statistics_equal_plain_python(spark):
    data = rows()
    found = apply_rules(spark.createDataFrame(data, DOCS), spark.createDataFrame([(20,), (None,), (21,)], "doc_id long")).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    assert got == sorted((str(d), *plain(t)) for d, t, _, _ in data)
    assert not any(r.kept for r in found if r.base_failed)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(rows(), DOCS)
    plan = apply_rules(df, df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_ratio_is_the_mean_log_ratio(spark):
    docs = [(i, t, "", "") for i, t in enumerate(["good words here", "bad bad words", "good good words", "other"])]
    df = spark.createDataFrame(docs, DOCS)
    trusted = spark.createDataFrame([(0,), (2,)], "doc_id long")
    model = fit_ratio(df, trusted)
    gram = lambda *ws: spark.range(1).select(F.pmod(F.xxhash64(*[F.lit(w) for w in ws]), F.lit(BUCKETS)).alias("b")).first().b
    buckets = {i: [gram(w) for w in t.split()] + [gram(a, b) for a, b in zip(t.split(), t.split()[1:])] for i, t, _, _ in docs}
    raw, good = Counter(b for bs in buckets.values() for b in bs), Counter(b for i in (0, 2) for b in buckets[i])
    score = lambda i: np.mean([math.log((good[b] + 1) / (sum(good.values()) + BUCKETS)) - math.log((raw[b] + 1) / (sum(raw.values()) + BUCKETS)) for b in buckets[i]])
    got = {r.doc_id: r.ratio for r in apply_rules(df, trusted).collect()}
    assert all(abs(got[i] - score(i)) < 1e-6 for i in got)
    spread = [score(0), score(2)]
    assert abs(model.threshold - (np.mean(spread) - 4 * np.std(spread))) < 1e-6


def test_counts_come_from_every_trusted_document(spark):
    docs = [(i, f"w{i % 7} all" if i % 4 else f"v{i % 5}", "", "") for i in range(16_000)]
    df = spark.createDataFrame(docs, DOCS)
    model = fit_ratio(df, spark.createDataFrame([(i,) for i in range(12_000)], "doc_id long"))
    words = sorted({w for _, t, _, _ in docs for w in t.split()} | {t for _, t, _, _ in docs})
    gram = lambda t: F.pmod(F.xxhash64(*[F.lit(w) for w in t.split()]), F.lit(BUCKETS))
    bucket = spark.range(1).select(*[gram(w).alias(w) for w in words]).first().asDict()
    count = lambda own: Counter(bucket[g] for _, t, _, _ in own for g in (t.split() if " " not in t else [*t.split(), t]))
    raw, good = count(docs), count(docs[:12_000])
    whole, trusted = (sum(c.values()) + BUCKETS for c in (raw, good))
    expected = [round(math.log((good[b] + 1) / trusted) - math.log((raw[b] + 1) / whole), 6) for b in range(BUCKETS)]
    assert [round(x, 6) for x in model.ratios] == expected


def test_clean_documents_stay_and_junk_goes(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = apply_rules(docs, labels.where("quality = 1")).join(labels, "doc_id").where("NOT base_failed").collect()
    kept = lambda q: np.mean([r.kept for r in found if r.quality == q])
    print("kept of good", kept(1), "of bad", kept(0))
    assert kept(1) >= 0.985 and kept(0) <= 0.5


def test_empty_tables(spark):
    df = spark.createDataFrame(rows(), DOCS)
    assert apply_rules(df.limit(0), df).collect() == []
    alone = apply_rules(df, df.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in alone)
