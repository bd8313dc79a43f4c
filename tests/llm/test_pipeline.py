"""The pipeline on a small table, stage by stage against the operators' own brute force."""

import hashlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from .test_pii import plain
from .test_simhash import plain_print

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = cp.quality(spark, docs, SF)
    assert kept.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = kept.collect()
    ids = {r.doc_id for r in rows}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in ids for d in good) >= 0.95 * len(good)

    unique = cp.near_copies(spark, kept, SF).collect()
    prints = {r.doc_id: plain_print(r.text) for r in rows}
    parent = {d: d for d in prints}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    assert sorted(r.doc_id for r in unique) == sorted({top(d) for d in prints})

    unique_df = spark.createDataFrame(unique, docs.schema)
    clean = cp.personal_data(spark, unique_df, SF)
    assert clean.columns == columns
    text = {r.doc_id: r.text for r in clean.collect()}
    assert len(text) == len(unique) and not any(plain(t) for t in text.values())
    assert all(text[r.doc_id] == r.text for r in unique if not plain(r.text) and "<" not in text[r.doc_id])

    mixed = cp.mix(spark, clean, SF)
    assert mixed.columns == columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= set(text) and max(times.values()) <= 3

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    final = cp.run(spark, SF).collect()
    assert Counter(r.doc_id for r in final) == times
    for r in final:
        assert r.ids == library.encode(text[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert cp.run(spark, folder).collect() == []
