"""Near-duplicate texts by SimHash fingerprints and covering locality-sensitive hashing.

Bit positions are dealt to the non-zero vectors of GF(2)^(radius + 1). Table ``v`` keeps the bits whose vector has
an odd product with ``v`` and masks the others. The positions in which two fingerprints within the radius differ give
at most ``radius`` equations, which some non-zero ``v`` solves: in that table both have the same key. So every
pair within the radius collides in at least one of the 2^(radius + 1) - 1 tables, without an exception.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectile.llm.common import packed, with_text_results
from vectile.llm.components import components
from vectile.session import materialise

HASH_SEED = 42  # fixed by the contract
BLOCK = 1 << 16


def fingerprint(text: str, width: int) -> bytes:
    """The 64-bit SimHash of a whole text, most significant byte first.

    A-Z become lower case, ASCII white space separates words, and every shingle of ``width`` words counts once per
    occurrence. Fewer words make one shingle, no word gives zero.
    """
    words = text.encode().lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_digest(joined, HASH_SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        part = b"".join([digest(joined[s:e], HASH_SEED) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])])
        ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(starts)).tobytes()


def with_fingerprints(docs: DataFrame, width: int, text: str = "text") -> DataFrame:
    """``row`` (the whole input row) and ``print``, the fingerprint as a long. A null text counts as empty."""

    def prints(texts: pa.Array) -> list[pa.Array]:
        found = b"".join([fingerprint(t.as_py(), width) for t in texts])
        return [pa.array(np.frombuffer(found, ">i8").astype(np.int64))]

    return with_text_results(docs, prints, [("print", "long")], text)


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The signed 64-bit masks of the tables; see the module's description for why they cover the radius."""
    tables = (1 << (radius + 1)) - 1
    vector = [1 + i % tables for i in range(bits)]
    masks = [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, tables + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def close_pairs(prints: DataFrame, radius: int, direct: int = 32) -> DataFrame:
    """Links (a, b) that connect every two distinct fingerprints of ``prints`` (print) within ``radius`` bits.

    Buckets of at most ``direct`` fingerprints compare their pairs. A larger bucket is never expanded to
    pairs: each fingerprint goes to the points at most half the radius (rounded up) away in its masked-out bits, where
    every two within the radius meet. A point has a bounded number of visitors, for radius 2 one more than there
    are masked-out bits. For an even radius all visitors are within the radius and link to the smallest;
    for an odd one their pairs are verified.
    """
    masks = covering_masks(radius)
    table = lambda t, mask: F.struct(F.lit(t).alias("tbl"), F.col("print").bitwiseAND(F.lit(mask)).alias("key"))
    tables = prints.select("print", F.inline(F.array(*[table(t, m) for t, m in enumerate(masks)])))
    sizes = tables.groupBy("tbl", "key").agg(F.count("*").alias("members")).where("members > 1")
    met = materialise(tables.join(sizes, ["tbl", "key"]))

    small = met.where(F.col("members") <= direct)
    left, right = small.select("tbl", "key", F.col("print").alias("a")), small.select("tbl", "key", F.col("print").alias("b"))
    distance = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    pairs = left.join(right, ["tbl", "key"]).where((F.col("a") < F.col("b")) & (distance("a", "b") <= radius)).select("a", "b")

    steps = [[0, *[1 << i for i in range(64) if not (m >> i) & 1]] for m in masks]
    steps = [[s - (1 << 64) if s >> 63 else s for s in own] for own in steps]
    point = F.col("print")
    hubs = met.where(F.col("members") > direct).select("tbl", "key", "print", point.alias("point"))
    flips = F.expr("CASE tbl " + " ".join(f"WHEN {t} THEN array({', '.join(_long(s) for s in own)})" for t, own in enumerate(steps)) + " END")
    for step in range((radius + 1) // 2):
        hubs = hubs.select("tbl", "key", "print", "point", F.explode(flips).alias("flip")).select("tbl", "key", "print", F.col("point").bitwiseXOR(F.col("flip")).alias("point"))
        if step:
            hubs = hubs.distinct()
    place = ["tbl", "key", "point"]
    if radius % 2 == 0:
        seen = hubs.groupBy(*place).agg(F.collect_list("print").alias("seen")).where(F.size("seen") > 1)
        near = seen.select(F.array_min("seen").alias("a"), F.explode("seen").alias("b")).where("a < b")
    else:
        near = hubs.select(*place, F.col("print").alias("a")).join(hubs.select(*place, F.col("print").alias("b")), place).where((F.col("a") < F.col("b")) & (distance("a", "b") <= radius)).select("a", "b")
    return pairs.union(near).distinct()


def _long(value: int) -> str:
    return f"{value}L" if value > -(1 << 63) else "shiftleft(1L, 63)"


def fingerprint_groups(prints: DataFrame, radius: int, doc_id: str = "doc_id") -> DataFrame:
    """(print, component_id) of every distinct fingerprint of ``prints`` (doc_id, print).

    ``component_id`` is the smallest id among the documents reachable over links of at most ``radius`` bits, null
    only if all their ids are null. Copies are one fingerprint here, so a group of any size is one row.
    """
    own = materialise(prints.groupBy("print").agg(F.min(doc_id).alias("first_id")))
    roots = components(close_pairs(own.select("print"), radius))
    placed = own.join(roots, F.col("print") == F.col("node"), "left").select("print", "first_id", F.coalesce("root", "print").alias("root"))
    least = placed.where("root != print").groupBy("root").agg(F.min("first_id").alias("member_id")).withColumnRenamed("root", "top")
    groups = materialise(placed.join(least, F.col("root") == F.col("top"), "left").select("print", "root", F.least("first_id", "member_id").alias("low")))
    tops = groups.where("root = print").select(F.col("print").alias("top"), F.col("low").alias("component_id"))
    linked = groups.where("root != print").join(tops, F.col("root") == F.col("top")).select("print", "component_id")
    return linked.union(tops)


def simhash_groups(docs: DataFrame, width: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id).

    Repeated rows and ids keep their rows; null ids never name a component that holds another id; null and wordless
    texts have fingerprint zero and link like any other; an empty table gives no rows. Other columns are not read.
    """
    prints = materialise(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width).select("row.doc_id", "print"))
    groups = fingerprint_groups(prints, radius)
    return prints.join(groups, "print").select("doc_id", hex_print(F.col("print")).alias("fingerprint"), "component_id")


def hex_print(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def drop_near_copies(docs: DataFrame, width: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near copies with all its columns: the one with the smallest id.

    If several rows share that id, the first by a hash of text and row stays; of equal rows one stays.
    A group without any id keeps one row.
    """
    # Fingerprints and ids decide; the texts are shuffled once, to meet the list of rows that stay.
    # Maps cannot be hashed, so rows that hold some are hashed as their JSON text.
    mapped = "map<" in docs.schema.simpleString()
    body = F.xxhash64(F.to_json("row") if mapped else F.col("row"))
    slim = materialise(with_fingerprints(docs, width, text).select(F.col(f"row.{doc_id}").alias("doc_id"), "print", F.xxhash64(F.coalesce(F.col(f"row.{text}"), F.lit(""))).alias("order"), body.alias("body")))
    alone = F.when(F.col("component_id").isNull(), F.col("print"))
    placed = slim.join(fingerprint_groups(slim, radius), "print")
    best = placed.groupBy("component_id", alone.alias("alone")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "order", "body")).alias("best"))
    keep = best.select(F.coalesce("best.doc_id", F.lit(0)).alias("keep_id"), F.col("best.body").alias("keep_body"))
    rows = docs.select(packed(docs).alias("row")).select("row", F.coalesce(f"row.{doc_id}", F.lit(0)).alias("keep_id"), body.alias("keep_body"))
    return rows.join(keep, ["keep_id", "keep_body"], "left_semi").dropDuplicates(["keep_id", "keep_body"]).select("row.*")
