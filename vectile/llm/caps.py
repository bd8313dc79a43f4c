"""Embedding near-duplicates by spherical-cap filters with structured random product codes.

The space is cut into ``parts`` blocks of dimensions; each block has its own random code of unit vectors, and every
combination of one word per part is a filter, whose direction is the concatenation of its words. A vector passes
the filters whose cap it lies in: those with which its inner product is at least ``cap``. The list of them is
decoded block by block, dropping every partial sum that the best words of the remaining blocks cannot lift over the
cap, so the filters (``words ** parts`` of them) are never enumerated.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectile.llm.components import components
from vectile.session import materialise, ship_by_value

CROWD = 1 << 16
STEP_SUMS = 1 << 21
MOST_WORDS = 4096
BROADCAST_ROWS = 1_000_000


def product_code(dims: int, parts: int, words: int, seed: int) -> list[tuple[slice, np.ndarray]]:
    """Each part's slice of the dimensions with its code, scaled so that a filter is a unit vector.

    A part of few dimensions has room for few directions, so its code holds at most four words per doubling.
    """
    cuts = np.linspace(0, dims, min(parts, dims) + 1).astype(int)
    code = []
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        rows = np.random.Generator(np.random.PCG64([seed, dims, i])).standard_normal((min(words, 4 ** min(b - a, 16)), b - a))
        code.append((slice(a, b), rows / np.linalg.norm(rows, axis=1, keepdims=True) / np.sqrt(len(cuts) - 1)))
    return code


def rotation(dims: int, seed: int) -> np.ndarray:
    """A random rotation, without which vectors that lie mostly in one part would be far from all filters."""
    return np.linalg.qr(np.random.Generator(np.random.PCG64([seed, dims])).standard_normal((dims, dims)))[0]


def cap_share(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Inner products from 0 to 1, and the share of the sphere's directions that reach each with a given unit vector."""
    t = np.linspace(0, 1, 100_001)
    density = (1 - t * t) ** ((dims - 3) / 2) if dims > 3 else np.ones_like(t)
    tail = density[::-1].cumsum()[::-1]
    return t, tail / (2 * tail[0])


def code_for(dims: int, level: int, parts: int, words: int, deviations: float, seed: int, threshold: float = 0.93) -> tuple[list[tuple[slice, np.ndarray]], float]:
    """The code and the cap of labels of a level: each has four times the filters of the one below and takes a fourth of their share.

    A vector so passes about as many filters at every level, while the vectors of one filter stay as many.
    More words than ``MOST_WORDS`` a part are spread over more parts. With few dimensions the cap has to stay clearly below the
    inner product that the middle of two vectors at the threshold has with both.
    """
    filters, cap = words**parts * 4**level, min(deviations / np.sqrt(dims), 0.87 * np.sqrt((1 + threshold) / 2))
    while level and filters ** (1 / parts) > max(MOST_WORDS, words) + 0.5:
        parts += 1
    if level:
        words = int(np.ceil(filters ** (1 / parts) - 1e-6))
        t, share = cap_share(dims)
        at = np.searchsorted(t, cap)
        if at < len(t):
            cap = float(t[len(t) - np.searchsorted(share[::-1], share[at] / 4**level, "right")])
    return product_code(dims, parts, words, seed), cap


def decode(vectors: np.ndarray, code: list[tuple[slice, np.ndarray]], cap: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters whose inner product with a unit vector is at least ``cap``.

    A row that reaches fewer than ``least`` filters lowers its own cap in small steps until it has them.
    """
    sums = [vectors[:, at] @ rows.T for at, rows in code]
    rest = np.cumsum([np.zeros(len(vectors)), *[s.max(axis=1) for s in sums[:0:-1]]], axis=0)[::-1]
    top = rest[0] + sums[0].max(axis=1)
    caps, todo, found = np.full(len(vectors), cap), np.arange(len(vectors)), []
    while len(todo):
        row, name, total = todo, np.zeros(len(todo), np.int64), np.zeros(len(todo))
        for s, left in zip(sums, rest):
            wanted, more = caps[row] - left[row], []
            step = max(1, STEP_SUMS // s.shape[1])
            for at in range(0, max(len(row), 1), step):
                cut = slice(at, at + step)
                reach = total[cut, None] + s[row[cut]]
                i, j = np.nonzero(reach >= wanted[cut, None])
                more.append((row[cut][i], name[cut][i] * s.shape[1] + j, reach[i, j]))
            row, name, total = (np.concatenate(c) for c in zip(*more))
        enough = np.bincount(row, minlength=len(vectors)) >= least
        done = enough[todo] | (caps[todo] <= -top[todo])
        take = np.isin(row, todo[done])
        found.append((row[take], name[take]))
        todo = todo[~done]
        caps[todo] = np.where(caps[todo] > top[todo], top[todo], caps[todo] - 0.03 * np.abs(top[todo]) - 1e-9)
    return np.concatenate([r for r, _ in found]), np.concatenate([n for _, n in found])


def with_filters(vectors: DataFrame, parts: int, words: int, deviations: float, least: int, seed: int, threshold: float) -> DataFrame:
    """(label, dims, cls, filters): the sorted filters of every vector of ``vectors`` (label, dims, level, cls, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            df = batch.to_pandas()
            for (dims, level), own in df.groupby(["dims", "level"]):
                if (dims, level) not in codes:
                    codes[dims, level] = (*code_for(dims, level, parts, words, deviations, seed, threshold), rotation(dims, seed))
                code, cap, turn = codes[dims, level]
                for at in range(0, len(own), 256):
                    some = own.iloc[at : at + 256]
                    x = np.stack(some.embedding.to_numpy()).astype(np.float64)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x = x / np.linalg.norm(x, axis=1, keepdims=True) @ turn
                    row, name = decode(x, code, cap, least)
                    order = np.lexsort((name, row))
                    ends = np.searchsorted(row[order], np.arange(len(some) + 1))
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(name[order]))
                    yield pa.RecordBatch.from_arrays([pa.array(some.label, pa.int64()), pa.array(some.dims, pa.int32()), pa.array(some.cls, pa.int64()), lists], names=["label", "dims", "cls", "filters"])

    return vectors.select("label", "dims", "level", "cls", "embedding").mapInArrow(run, "label long, dims int, cls long, filters array<long>")


def linked_block(cls: np.ndarray, copies: np.ndarray, block: np.ndarray, vectors: np.ndarray, below: list[np.ndarray], within: bool, threshold: float):
    """Verified links counted for each vector of a pair of blocks, and the smallest vector of each linked piece.

    ``below`` has for each vector the filters it passes before this one: a pair counts in the first filter that both
    pass, and in no other. ``within`` compares one block with itself, else only vectors of different blocks meet.
    """
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    if not within:
        near &= block[:, None] != block[None, :]
    if not near.any():
        return None
    names, at = np.unique(np.concatenate(below), return_inverse=True)
    passes = np.zeros((len(cls), len(names)), np.float32)
    passes[np.repeat(np.arange(len(cls)), [len(b) for b in below]), at] = 1
    links = (near & (passes @ passes.T == 0)) @ copies
    root = cls.copy()
    while True:
        low = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (low == root).all():
            break
        root = low
    take = (links > 0) | (root != cls)
    return cls[take], links[take], root[take]


KEYS = ["label", "dims", "filter", "one", "two"]


def compared_blocks(pairs: DataFrame, threshold: float) -> DataFrame:
    """(cls, links, root) of every pair of blocks; ``pairs`` has the vectors of both under ``KEYS``.

    Pairs of blocks are cut from the sorted rows of a partition, so many small ones share one batch; what is held is a
    batch and the rows of one pair.
    """

    def groups(rows: pa.Table):
        rows = rows.combine_chunks()
        plain = {c: rows[c].to_numpy() for c in [*KEYS, "block", "cls", "copies"]}
        lists = {c: rows[c].chunk(0) for c in ("embedding", "filters")}
        values = {c: v.values.to_numpy(zero_copy_only=False) for c, v in lists.items()}
        ends = {c: v.offsets.to_numpy() for c, v in lists.items()}
        change = np.any([plain[k][1:] != plain[k][:-1] for k in KEYS], axis=0)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(rows)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = [values["filters"][s:e] for s, e in zip(ends["filters"][a:b].tolist(), ends["filters"][a + 1 : b + 1].tolist())]
            below = [f[: np.searchsorted(f, plain["filter"][a])] for f in own]
            vectors = values["embedding"][ends["embedding"][a] : ends["embedding"][b]].reshape(b - a, -1).astype(np.float64)
            found = linked_block(plain["cls"][a:b], plain["copies"][a:b], plain["block"][a:b], vectors, below, bool(plain["one"][a] == plain["two"][a]), threshold)
            if found is not None:
                yield found

    def last_start(rows: pa.Table) -> int:
        columns = [rows[k].to_numpy() for k in KEYS]
        return int(np.flatnonzero(~np.all([c == c[-1] for c in columns], axis=0))[-1:].sum() + 1) if any((c != c[-1]).any() for c in columns) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, out = None, []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                table = pa.Table.from_batches([batch])
                rest = table if rest is None else pa.concat_tables([rest, table])
            if rest is None:
                return
            start = last_start(rest) if batch is not None else len(rest)
            out = list(groups(rest.slice(0, start))) if start else []
            rest = rest.slice(start)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["cls", "links", "root"])

    columns = [*KEYS, "block", "cls", "copies", "filters", "embedding"]
    return pairs.select(*columns).repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(run, "cls long, links long, root long")


def with_levels(classes: DataFrame) -> DataFrame:
    """``classes`` with ``level``: by how many powers of four a label has more vectors of a length than ``CROWD``.

    Only labels above that are joined, at most one for ``CROWD`` vectors; they are broadcast if counted to be few.
    """
    level = F.ceil(F.log2(F.col("n") / CROWD) / 2).cast("int")
    large = materialise(classes.groupBy("label", "dims").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("label", "dims", level.alias("level")))
    joined = classes.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, ["label", "dims"], "left")
    return joined.withColumn("level", F.coalesce("level", F.lit(0)))


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    parts: int = 2,
    words: int = 1024,
    deviations: float = 4.0,
    least: int = 32,
    block: int = 256,
    seed: int = 42,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept).

    Vectors link when labels (whole numbers up to 64 bits) are equal and not null, lengths are equal and the cosine in
    double precision is at least ``threshold``; components that come as doubles stay doubles. Null, empty and zero vectors and those with null, NaN or infinite components link with
    nothing: no links, their own id as component. Equal vectors of a label are compared once and counted as often as
    they occur. Repeated ids keep their rows; a null id names a component only where no other does, and a
    vector with a null id is not kept. An empty table gives no rows.

    A cap of ``deviations`` standard deviations of a random inner product takes about 2e-5 of the filters, and every
    vector takes at least ``least``. A label of more than ``CROWD`` different vectors gets more filters and smaller caps, by
    its counted vectors, so that the vectors of a filter do not grow with the label. A link is missed only if no
    common filter takes both ends; tests measure the recall at the threshold for several levels.
    Only filters with several different vectors are joined back with the vectors; a filter's vectors are compared
    in pairs of blocks, so no task holds more than two blocks however many vectors meet.
    """
    kind = "double" if vectors.select(F.col(embedding)).schema[0].dataType == T.ArrayType(T.DoubleType()) else "float"
    typed = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("long").alias("label"), F.transform(F.col(embedding).cast(f"array<{kind}>"), lambda x: x + F.lit(0).cast(kind)).alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0)
    rows = materialise(typed.select("vec_id", "label", F.when(usable, F.col("embedding")).alias("embedding"), F.when(usable, F.xxhash64("embedding")).alias("digest")))
    # The digest shortens the key; the vector itself stays part of it. Classes are numbered, and the numbers are written.
    shape = ["label", "digest", "embedding"]
    classes = materialise(
        rows.where("embedding IS NOT NULL").groupBy(*shape).agg(F.count("*").alias("copies"), F.min("vec_id").alias("low")).withColumn("cls", F.monotonically_increasing_id()).withColumn("dims", F.size("embedding"))
    )
    filters = materialise(with_filters(with_levels(classes), parts, words, deviations, least, seed, threshold))
    member = filters.select("label", "dims", "cls", F.explode("filters").alias("filter"))
    crowded = member.groupBy("label", "dims", "filter").agg(F.count("*").alias("members")).where("members > 1").withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    met = member.join(crowded, ["label", "dims", "filter"]).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(seed)), "blocks").cast("int"))
    full = met.join(filters.select("cls", "filters"), "cls").join(classes.select("cls", "copies", "embedding"), "cls")
    # Each block meets each block, itself included: pairs (one <= two), and a pair holds both blocks.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = full.withColumn("other", other).withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    compared = materialise(compared_blocks(pairs, threshold))
    counted = compared.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(compared.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    placed = classes.select("cls", "low", *shape, "copies").join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls")).drop("node")
    tops = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    known = placed.join(tops, "root").join(counted, "cls", "left").select(*shape, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    apart = rows.where("embedding IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    joined = rows.where("embedding IS NOT NULL").join(known, shape).select("vec_id", "n_links", "component_id").union(apart)
    return joined.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ship_by_value(__name__)
