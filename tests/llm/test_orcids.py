"""Token files against the tokenizers library, row by row and as a whole."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.orc as po
from tokenizers import Tokenizer

from vectile.llm.orcids import WordEncoder, read_token_files, token_index, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " \n\t", "Hello  World don't", "a<|endoftext|>b <|startoftext|>", "x\x1cy\x1fz\x85a\xa0b", "ΣΑΣ İI ſ", "é é \n ́", "日本語 テスト", "abc...123!! 4's 'S",
    "word " * 5000, "x" * 3000, "\x00 \x7f", "👩‍👩‍👧 ​ ﻿", "same text", "same text",
]


def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def noise(n, seed):
    draw = random.Random(seed)
    letters = "abcdeABC .,'\n\t’éèß日1234\x85\xa0\x1ć" + "".join(map(chr, range(0x370, 0x3D0)))
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 80))) for _ in range(n)]


def test_words_encode_as_whole_texts():
    texts = [t or "" for t in ODD] + noise(3000, 5)
    encoder = WordEncoder(open(PATH, encoding="utf-8").read())
    got = [ids for i in range(0, len(texts), 500) for ids in encoder.encode(pa.array(texts[i : i + 500], pa.string()), 1).to_pylist()]
    assert got == [[*e.ids, 1] for e in library().encode_batch(texts, add_special_tokens=False)]


def test_forgetting_words_changes_nothing(monkeypatch):
    texts = noise(300, 8)
    whole = WordEncoder(open(PATH, encoding="utf-8").read()).encode(pa.array(texts), 1).to_pylist()
    monkeypatch.setattr("vectile.llm.orcids.KNOWN_WORDS", 40)
    small = WordEncoder(open(PATH, encoding="utf-8").read())
    assert [ids for i in range(0, 300, 5) for ids in small.encode(pa.array(texts[i : i + 5]), 1).to_pylist()] == whole


def test_files_read_back(spark, tmp_path):
    texts = ODD + noise(200, 6)
    rows = [(None if i == 3 else 7 if i in (14, 15) else 1000 - 3 * i, t, "clash") for i, t in enumerate(texts)]
    folder = str(tmp_path / "ids")
    write_token_files(spark.createDataFrame(rows, "doc_id long, text string, ids string"), folder, PATH, files=3)
    encoded = {}
    for doc, text, _ in rows:
        ids = [*library().encode(text or "", add_special_tokens=False).ids, 1]
        encoded.setdefault(doc, []).append(ids)
    stored = sorted(read_token_files(spark, folder).collect(), key=lambda r: r.place)
    order = [-1 if r.doc_id is None else r.doc_id for r in stored]
    assert order == sorted(order) and len(stored) == len(rows)
    for r in stored:
        assert r.ids in encoded[r.doc_id]
    at = 0
    index = {(r.doc_id, r.start): r for r in token_index(spark, folder).collect()}
    for r in stored:
        found = index[r.doc_id, at]
        assert found.n_tokens == len(r.ids) and found.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += len(r.ids)
    assert len(index) == len(rows)


def test_metadata_prunes(spark, tmp_path):
    folder = str(tmp_path / "ids")
    write_token_files(spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string"), folder, PATH, files=4)
    one = read_token_files(spark, folder).where("doc_id = 77")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in one._jdf.queryExecution().executedPlan().toString()
    assert [r.doc_id for r in one.collect()] == [77]
    files = sorted((tmp_path / "ids").glob("*.orc"))
    spans = [po.read_table(str(f)).column("doc_id").to_pylist() for f in files]
    spans = [s for s in spans if s]
    assert len(spans) > 1 and all(a[-1] < b[0] for a, b in zip(spans, spans[1:]))


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path / "ids")
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), folder, PATH)
    assert token_index(spark, folder).collect() == []
