"""Encoding and decoding against the tokenizers library."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vectile.llm.bpe import Encoder, Vocabulary, WordMemory, decode_ids, encode_texts, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "   \n\n  x", "don't we'll I'M 's", "a<|endoftext|>b<|endoftext|><|endoftext|>", "<|endoftext|", "\x00\x1f\x7f\x85\xa0  x", "é é ́", "日本語テスト 한국어 العربية हिन्दी",
    "👩‍👩‍👧‍👦🏳️‍🌈", "a" * 5000, "=" * 3000 + " " * 500 + "-" * 700, "ab" * 3000, "\n" * 200, "1234567890" * 50, "Ⅷ ² ½ ٣", "﻿bom �", "​‍ x", "ſtraße İI", "_" * 129 + "x",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def definition():
    return open(PATH, encoding="utf-8").read()


def noise(n, seed):
    draw = random.Random(seed)
    alphabets = ["abcdefgh", "etaoinshr ", "aA1 .,'\n", "éèüßñ ", "日本語 字", "".join(map(chr, range(0x20, 0x250)))]
    for _ in range(n):
        letters = draw.choice(alphabets)
        yield "".join(draw.choice(letters) for _ in range(draw.randint(0, 60)))


def test_every_token_encodes_to_itself(definition):
    vocabulary = Vocabulary(definition)
    own = sorted((t, i) for t, i in vocabulary.ids.items())
    assert [int.from_bytes(ids, "little") for ids in vocabulary.encode_sorted([t for t, _ in own])] == [i for _, i in own]


def test_encoding_equals_the_library(library, definition):
    texts = [*ODD, *noise(3000, 1)]
    got = Encoder(definition).encode(texts).to_pylist()
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_forgetting_words_changes_nothing(definition, monkeypatch):
    import vectile.llm.bpe as bpe

    texts = list(noise(400, 2))
    whole = Encoder(definition).encode(texts).to_pylist()
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 50)
    monkeypatch.setattr(bpe, "KNOWN_PAIRS", 50)
    small = Encoder(definition)
    assert [ids for i in range(0, len(texts), 7) for ids in small.encode(texts[i : i + 7]).to_pylist()] == whole


def test_round_trip(spark, library):
    texts = [None, *ODD, "same", "same"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in round_trip(df, PATH).collect()}
    apart = encode_texts(df, PATH).select("row.doc_id", "ids", decode_ids(spark, PATH, F.col("ids")).alias("decoded"))
    assert {r.doc_id: r for r in apart.collect()} == rows
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i].ids == ids and rows[i].decoded == library.decode(ids, skip_special_tokens=False) == (t or "")


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_known_words_are_looked_up_once():
    class Counted(str):
        hashed = 0

        def __hash__(self):
            Counted.hashed += 1
            return str.__hash__(self)

    memory = WordMemory(1000)
    words = [Counted(f"w{i}") for i in range(100)]
    encode = lambda new: [w.encode() for w in new]
    assert memory.ids_of(words, encode) == encode(words)
    Counted.hashed = 0
    assert memory.ids_of(words, lambda new: [w.encode() for w in new]) == encode(words)
    assert Counted.hashed <= 200  # found, and noted as seen again
