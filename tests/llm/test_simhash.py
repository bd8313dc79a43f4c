"""SimHash groups against brute force over all pairs."""

import random
import re

import pytest
import xxhash
from pyspark.sql import types as T

from vectile.llm.simhash import close_pairs, covering_masks, drop_near_copies, fingerprint, simhash_groups

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("print", T.StringType())])


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, radius=2):
    prints = [plain_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted((str(doc), f"{prints[i]:016x}", least.get(top(i))) for i, (doc, _) in enumerate(rows))


def corpus(n=150, seed=3):
    draw = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "déjà", "vu", "x", "straße", "№", "delta,", "end."]
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "ONE"), (None, "two words"), (None, "Two Words"), (3, "two words"), (3, "two words")]
    for i in range(n):
        text = [draw.choice(words) + str(draw.randint(0, 30)) for _ in range(draw.randint(1, 120))]
        rows.append((1000 - i, " ".join(text)))
        for j in range(draw.randint(0, 3)):
            text[draw.randrange(len(text))] = "changed"
            rows.append((2000 + 10 * i + j, "\n".join(text)))
    draw.shuffle(rows)
    return rows


def test_fingerprint_matches_plain_code():
    for _, text in corpus(20):
        assert int.from_bytes(fingerprint(text or "", 3)) == plain_print(text)
    long_text = " ".join(str(i) for i in range(200_000))
    assert int.from_bytes(fingerprint(long_text, 3)) == plain_print(long_text)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_of_positions(radius):
    masks = covering_masks(radius)
    draw = random.Random(radius)
    for _ in range(3000):
        differs = sum(1 << b for b in draw.sample(range(64), radius))
        assert any(not (m & differs) for m in masks)


def test_groups_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], DOCS)
    found = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash_groups(df).collect())
    assert found == plain_groups(rows)


@pytest.mark.parametrize("direct", [1, 32])
@pytest.mark.parametrize("radius", [1, 2, 3])
def test_large_buckets_lose_no_link(spark, direct, radius):
    draw = random.Random(9)
    base = [draw.getrandbits(64) for _ in range(4)]
    prints = {b ^ sum(1 << i for i in draw.sample(range(64), draw.randint(0, 5))) for b in base for _ in range(80)} | {1 << 63, (1 << 63) | 1}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = {(r.a, r.b) for r in close_pairs(spark.createDataFrame([(p,) for p in signed], "print long"), radius, direct).collect()}
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= radius for a, b in links)
    parent = {p: p for p in signed}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[top(a)] = top(b)
    wanted = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius]
    assert wanted and all(top(a) == top(b) for a, b in wanted)


def test_drop_keeps_one_row_of_each_group(spark):
    rows = corpus(60)
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], DOCS)
    kept = drop_near_copies(df).collect()
    groups = {(least, p if least is None else None) for _, p, least in plain_groups(rows)}
    assert len(kept) == len(groups)
    assert kept[0].asDict().keys() == {"doc_id", "text", "print"}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(least for least, _ in groups if least is not None)


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert simhash_groups(df).collect() == [] and drop_near_copies(df).collect() == []


def test_rows_with_maps_keep_one_of_each_group(spark):
    schema = "doc_id long, text string, tags map<string,int>, more array<struct<m:map<string,string>>>"
    rows = [(3, "a b c d", {"x": 1}, None), (2, "A B C D", None, [({"k": "v"},)]), (2, "A B C D", None, [({"k": "v"},)]), (9, "other words entirely here", {}, [])]
    kept = drop_near_copies(spark.createDataFrame(rows, schema)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.tags) for r in kept] == [(2, None), (9, {})]
