"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from vectile.llm.merkle import merkle_manifest
from vectile.llm.suite import op12_merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, tree string, pos map<string,int>"
sha = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    spelled = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in spelled))


def reduced(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def walk(levels, i, now):
    siblings = ""
    for level in levels[:-1]:
        low = i - i % 8
        before, after = "".join(level[low:i]), "".join(level[i + 1 : low + 8])
        siblings, now, i = siblings + before + after, sha(before, now, after), i // 8
    return siblings, now


def plain(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r, plain_leaf(*r)))
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[lang] = reduced([leaf for _, leaf in by_lang[lang]])
    top = reduced([trees[lang][-1][0] for lang in langs])
    out = []
    for at, lang in enumerate(langs):
        for i, (r, leaf) in enumerate(by_lang[lang]):
            other = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                other = plain_leaf(r[0], None if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            s1, now = walk(trees[lang], i, other)
            s2, now = walk(top, at, now)
            out.append((r[0], leaf, trees[lang][-1][0], top[-1][0], sha(s1 + s2), now, now == top[-1][0]))
    return sorted(out, key=str)


def corpus(n, langs, seed=2):
    draw = random.Random(seed)
    rows = [(draw.randrange(10**10), draw.choice(["Plain TEXT", "lower", "ÄÖÜ Straße İ", "", None, "x" * 5000 + "Y"]), draw.choice(langs), draw.choice(["s", None, "1:s"]), draw.choice([None, 4])) for _ in range(n)]
    rows += [rows[0], rows[0], (rows[-1][0], "other text", *rows[-1][2:]), (None, "no id", langs[0], None, None), (-5, "ab", langs[-1], None, 7)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,langs,depth", [(1, ["de"], 1), (3, ["a", None], 4), (300, ["en", None, "", "é", "-", "z"], 1), (700, ["en", "en", "en", "de"], 2), (260, [f"l{i}" for i in range(90)], 1)])
def test_against_plain_trees(spark, n, langs, depth):
    rows = corpus(n, langs)
    docs = spark.createDataFrame([(*r, "clash", {"p": 1}) for r in rows], SCHEMA).repartition(5)
    found = merkle_manifest(docs, tampered=F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0, depth=depth).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(rows)


def test_one_leaf_is_the_root(spark):
    docs = spark.createDataFrame([(1, "Text", "en", None, None, None, None)], SCHEMA)
    row = merkle_manifest(docs).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == sha("")


def test_an_empty_table(spark):
    assert merkle_manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_query(spark, tmp_path):
    rows = corpus(120, ["en", "de", None], 9)
    spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = op12_merkle(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(rows)
    assert any(not r.verified for r in found)
