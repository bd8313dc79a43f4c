"""A Merkle tree over a table of documents, with a proof for each of them.

Every document is a leaf. The leaves of a language, in order of their ids, are combined in runs of eight, level by level; what remains
of each language is combined likewise. Leaves are numbered by one range partitioning, and ``ARITY ** DEPTH`` consecutive ones
are a superblock, whose root needs nothing from outside. Only those roots go through the levels above, as joins and aggregates. Then
the outer nodes that a superblock's proofs need go back to it: leaves and outer nodes are cogrouped, and one pass reduces the leaves
again, completes the proofs and folds them. No group holds more than one superblock, whatever the sizes of the languages.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectile.session import materialise, ship_by_value

ARITY, DEPTH = 8, 4  # the arity is fixed by the contract
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")  # fixed by the contract, like their order
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(*values: Column) -> Column:
    """Hash of the fields, each with its length in bytes before it, or ``-`` for null."""
    spelled = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in spelled]), 256)


def lower_ascii(text: Column) -> Column:
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``pos``, their number within ``group`` from 0 by ``order``, and ``n``, the size of the group.

    Rows are ranged by group and order and sorted inside their tasks; what is summed up is one count per group and task.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = materialise(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    spans = placed.groupBy(group, "part").agg(F.count("*").alias("own"), F.min("at").alias("first"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("own").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(group, "part", (before - F.col("first")).alias("shift"), F.sum("own").over(whole).alias("n"))
    return placed.join(spans, [group, "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def levels_of(nodes: list[bytes], levels: int | None) -> list[list[bytes]]:
    """The nodes of each level, from the given ones up; ``levels`` times, or until one node remains."""
    out = [nodes]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        below = out[-1]
        out.append([hashlib.sha256(b"".join(below[i : i + ARITY])).hexdigest().encode() for i in range(0, len(below), ARITY)])
    return out


def _local_levels(n: int, depth: int) -> int | None:
    return depth if n > ARITY**depth else None


def combine(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Reduce trees of ``nodes`` (tree, pos, n, digest): the runs of each level from below, and (tree, digest) of what remains.

    Each level is an aggregate over an eighth of the rows of the one below; its rows are (tree, pos, n, run, digest).
    """
    levels = []
    while (nodes.agg(F.max("n")).first()[0] or 1) > 1:
        run = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
        runs = nodes.groupBy("tree", "n", F.expr(f"pos div {ARITY}").alias("pos")).agg(run.alias("run"))
        digest = F.when(F.col("n") > 1, F.sha2(F.array_join("run", ""), 256)).otherwise(F.get("run", F.lit(0)))
        levels.append(materialise(runs.withColumn("digest", digest)))
        nodes = levels[-1].select("tree", "pos", F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), "digest")
    return levels, nodes.select("tree", "digest")


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, pos, path, ...) of the lowest nodes; ``tops`` (tree, path, ...) has the path above each tree.

    A path lists the levels from below: the place of the node in its run, and the run.
    """
    paths = tops.withColumn("pos", F.lit(0).cast("bigint"))
    for level in reversed(levels):
        met = level.select("tree", "pos", "n", "run").join(paths, ["tree", "pos"])
        rest = [c for c in paths.columns if c not in ("tree", "pos", "path")]
        opened = met.select("tree", (F.col("pos") * ARITY).alias("low"), "n", "path", "run", *rest, F.posexplode("run").alias("place", "digest"))
        step = F.array(F.struct("place", "run"))
        paths = opened.select("tree", (F.col("low") + F.col("place")).alias("pos"), F.when(F.col("n") > 1, F.concat(step, "path")).otherwise(F.col("path")).alias("path"), *rest)
    return paths


PATH = "array<struct<place:int,run:array<string>>>"
PROVED = "doc_id string, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"


def prove(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Roots, proofs and folded proofs of ``leaves`` (tree, doc_id, leaf, other).

    ``tree`` names the tree of a leaf and is not null; trees follow their names bytewise. ``other`` is the digest that the proof is
    folded with instead of ``leaf``, null for ``leaf`` itself.
    """
    size = ARITY**depth
    rows = materialise(leaves.withColumn("row", F.monotonically_increasing_id()))  # equal leaves keep one order
    placed = numbered(rows, "tree", [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("row").asc()])
    placed = materialise(placed.withColumn("block", F.expr(f"pos div {size}")))

    def top(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        last = levels_of([x.encode() for x in group["leaf"]], _local_levels(int(group["n"].iloc[0]), depth))[-1]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-int(group["n"].iloc[0]) // size)], "digest": [last[0].decode()]})

    blocks = placed.select("tree", "block", "pos", "n", "leaf").groupBy("tree", "block").applyInPandas(top, "tree string, pos long, n long, digest string")
    inner, subroots = combine(materialise(blocks))
    subroots = materialise(subroots)
    trees = numbered(subroots.select(F.lit("").alias("all"), F.col("tree").alias("name"), "digest"), "all", [F.col("name").asc()])
    trees = materialise(trees.select(F.col("all").alias("tree"), "name", "pos", "n", "digest"))
    outer, root = combine(trees.select("tree", "pos", "n", "digest"))
    tops = descend(outer, root.select("tree", F.col("digest").alias("root"), F.array().cast(PATH).alias("path")))
    tops = trees.join(tops, ["tree", "pos"]).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    needed = descend(inner, tops).select("tree", F.col("pos").alias("block"), "subroot", "root", "path")

    def fold(mine: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        mine, above = mine.sort_values("pos"), above.iloc[0]
        steps = [(int(s["place"]), [x.encode() for x in s["run"]]) for s in above["path"]]
        outside = b"".join(b"".join(run[:place] + run[place + 1 :]) for place, run in steps)
        levels = levels_of([x.encode() for x in mine["leaf"]], _local_levels(int(mine["n"].iloc[0]), depth))
        ends = [(b"".join(run[:place]), b"".join(run[place + 1 :])) for place, run in steps]
        proofs, folds = [], []
        for i, (leaf, other) in enumerate(zip(mine["leaf"], mine["other"])):
            now, siblings = (other or leaf).encode(), []
            for level in levels[:-1]:
                low = i - i % ARITY
                before, after = b"".join(level[low:i]), b"".join(level[i + 1 : low + ARITY])
                siblings += [before, after]
                now = hashlib.sha256(before + now + after).hexdigest().encode()
                i //= ARITY
            for before, after in ends:
                now = hashlib.sha256(before + now + after).hexdigest().encode()
            proofs.append(hashlib.sha256(b"".join(siblings) + outside).hexdigest())
            folds.append(now.decode())
        out = mine[["doc_id", "leaf"]].assign(subroot=above["subroot"], root=above["root"], proof=proofs, folded_root=folds)
        return out.assign(verified=out["folded_root"] == out["root"])

    # pandas would turn whole numbers beside nulls into floats, so ids travel as text
    mine = placed.select("tree", "block", "pos", "n", F.col("doc_id").cast("string").alias("doc_id"), "leaf", "other")
    found = mine.groupBy("tree", "block").cogroup(needed.groupBy("tree", "block")).applyInPandas(fold, PROVED)
    return found.withColumn("doc_id", F.col("doc_id").cast(placed.schema["doc_id"].dataType))


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """One row per document: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).

    Where ``tampered`` (of ``doc_id``) is true, the proof is folded from the document with A-Z of its text in lower case. A null
    language is a tree of its own, before the others; null ids come before the others of their language; rows that share an id
    follow the digest of the whole row, and equal rows are leaves beside each other, so the rows returned do not depend
    on the partitioning. Nulls in any field are told from empty values. Texts of any length are hashed whole. An empty table gives no
    rows. Other columns, whatever their names, are not read.
    """
    fields = [F.col(f"`{c}`") for c in FIELDS]
    changed = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    other = F.when(changed, leaf_digest(*fields[:-1], lower_ascii(fields[-1].cast("string"))))
    tree = F.coalesce(F.concat(F.lit("+"), F.col("`lang`").cast("string")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), F.col("`doc_id`").alias("doc_id"), leaf_digest(*fields).alias("leaf"), other.alias("other"))
    return prove(leaves, depth).withColumnRenamed("proof", "proof_sha256")


ship_by_value(__name__)
