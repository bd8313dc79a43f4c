"""Filtered top-k search in squared L2 distance, for one query vector and for tables of queries.

``nearest`` answers one query with built-in expressions only. ``search`` answers a table of queries of any size in waves:
each query carries its vector, optionally a filter in disjunctive form and the partitions to read. Spark
partitions the base rows; a NumPy step inside the tasks turns blocks of them into at most k
candidates per query, and a shuffle by query ranks what is left. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vectile.functions.predicates import DNF_TYPE, Predicate, as_column, dnf_column
from vectile.functions.vectors import squared_l2
from vectile.session import materialise, shared_dir, ship_by_value

RESULT_TYPE = "qid bigint, id bigint, dist double"


def nearest(
    base: DataFrame,
    query: Sequence[float] | Column,
    k: int,
    predicate: Predicate | None = None,
    parts: Sequence[str] | None = None,
) -> DataFrame:
    """The k nearest rows to one vector: pruned, filtered, measured, then a bounded sort (no full sort, no shuffle)."""
    if parts is not None:
        base = base.filter(F.col("part").isin(list(parts))) if parts else base.filter(F.lit(False))
    if predicate is not None:
        base = base.filter(as_column(predicate))
    base = base.filter(F.col("vector").isNotNull())
    target = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    return base.select("id", squared_l2(F.col("vector"), target).alias("dist")).orderBy("dist", "id").limit(k)


@dataclass(frozen=True)
class SearchLimits:
    """Sizes that bound what tasks hold and pass on; none of them changes a result."""

    broadcast_bytes: int = 64 << 20  # query vectors, filters, routes, top-k state and candidates of one wave, held by each task
    merge_width: int = 64  # tasks beyond this many pass their candidates through a middle level of the merge
    seed_one_in: int = 16  # with as many tasks, a sample of one row in so many bounds the queries first


def search(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    attrs: Sequence[str] = (),
    limits: SearchLimits = SearchLimits(),
    seed: DataFrame | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """(qid, id, dist, rank) with the k nearest base rows of every query that pass its filter.

    ``base`` has id, vector and the ``attrs``. ``queries`` has qid, vector and optionally dnf, the filter. A query may read
    only some values of the base column ``part``: listed in an array ``parts``, or as a bitmap ``part_set`` over ``names``, null for
    all. They have to include every partition that can hold a match.

    Queries go in waves that fit the limits, by a hash of qid; each is broadcast and the base is scanned in place, never shuffled.
    What is shuffled is at most k candidates per query and task, fewer with a ``seed``: a small sample of the base
    rows, searched first, whose k-th distance bounds the result. Where the cluster runs more tasks than ``merge_width``, one is taken from
    the base if none is given, and candidates are merged in two levels, so no query gathers all tasks' rows in one place.

    With ``codes`` beside base rows and ``probes`` beside queries (arrays with an entry per hash table, see ``index``), ``part`` is the table
    shifted left over the code, and a pair that meets in several tables is measured in the first only.

    Rows and queries without a vector are left out; vectors of different lengths and filters on attributes outside
    ``attrs`` are errors.
    """
    spark = base.sparkSession
    base, queries = base.filter(F.col("vector").isNotNull()), queries.filter(F.col("vector").isNotNull())
    routing = [c for c in ("parts", "part_set", "probes") if c in queries.columns]
    if "part_set" in routing and names is None:
        raise ValueError("a part_set needs the names it counts")
    if "dnf" not in queries.columns:
        queries = queries.withColumn("dnf", F.lit(None).cast(DNF_TYPE))
    queries = queries.select("qid", "vector", "dnf", *routing)
    part = F.col("part")
    if "part_set" in routing or dict(queries.dtypes).get("parts") == "array<string>":
        part = part.cast("string")  # folder names may read back as numbers
    columns = [
        "id",
        "vector",
        F.array(*[F.col(a).cast("int") for a in attrs]).cast("array<int>").alias("values"),
        *([part.alias("part")] if {"parts", "part_set"} & set(routing) else []),
        *(["codes"] if "probes" in routing else []),
    ]
    wide = spark.sparkContext.defaultParallelism > limits.merge_width
    if seed is None and wide:
        seed = base.filter(F.pmod(F.xxhash64("id"), F.lit(limits.seed_one_in)) == 0)
    fan = max(2, round(spark.sparkContext.defaultParallelism**0.5)) if wide else 1

    def candidates(rows: DataFrame, table: pa.Table, width: int) -> DataFrame:
        return rank(_broadcast_search(_prefiltered(rows, table, attrs, names).select(*columns), table, k, names), k, width)

    def answer(table: pa.Table) -> DataFrame:
        if seed is not None and table.num_rows:
            near = candidates(seed, table, 1).filter(F.col("rank") == k).select("qid", "dist").toArrow()  # a row per query
            bound = dict(zip(near.column("qid").to_pylist(), near.column("dist").to_pylist()))
            table = table.append_column("bound", pa.array([bound.get(q) for q in table.column("qid").to_pylist()], pa.float64()))
        return candidates(base, table, fan)

    # the vector is held as float, twice while queries are sorted, as double, and as a float matrix with one more column; beside
    # the k best there are half as many candidates, three times while they are merged
    per_query = 256 + 64 * k + 24 * F.size("vector") + 64 * F.coalesce(F.size(F.flatten("dnf")), F.lit(0))
    if "parts" in routing:
        per_query = per_query + 48 * F.size("parts")
    if "probes" in routing:  # a flag for each code of each table
        per_query = per_query + 8 * F.size(F.flatten("probes")) + F.size("probes") * (1 + F.array_max(F.flatten("probes")))
    if "part_set" in routing:
        per_query = per_query + F.coalesce(F.octet_length("part_set"), F.lit(0))
    held = queries.agg(F.sum(per_query.cast("bigint"))).first()[0] or 0
    if held <= limits.broadcast_bytes:
        return answer(queries.toArrow())  # its size is known to fit
    waves = -(-5 * held // (4 * limits.broadcast_bytes))  # a quarter more than needed, as hashed waves differ in size
    asked, folder = materialise(queries), shared_dir(spark)
    for wave in range(waves):
        table = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(waves)) == wave).toArrow()
        if table.num_rows:
            answer(table).write.mode("append").parquet(folder)
    schema = T.StructType([T.StructField("qid", T.LongType()), T.StructField("id", T.LongType()), T.StructField("dist", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    return spark.read.schema(schema).parquet(folder)


def rank(candidates: DataFrame, k: int, fan: int = 1) -> DataFrame:
    """Final ranking: the window keeps k rows per query on each side of the one shuffle.

    With ``fan``, tasks are grouped so many ways and ranked by group first: a merge tree of two levels.
    """
    if fan > 1:
        groups = Window.partitionBy("qid", "slot").orderBy("dist", "id")
        slotted = candidates.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(fan)))
        candidates = slotted.withColumn("rank", F.row_number().over(groups)).filter(F.col("rank") <= k).drop("slot", "rank")
    order = Window.partitionBy("qid").orderBy("dist", "id")
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _prefiltered(base: DataFrame, table: pa.Table, attrs: Sequence[str], names: Sequence[str] | None, most: int = 8) -> DataFrame:
    """Rows and partitions that some query can use, as conditions that reach the scan."""
    read = None
    if "parts" in table.column_names:
        read = pc.unique(table.column("parts").combine_chunks().flatten()).to_pylist()
    elif "part_set" in table.column_names and not table.column("part_set").null_count:
        together = reduce(np.bitwise_or, [np.frombuffer(x.as_py(), np.uint8) for x in table.column("part_set")], np.zeros(1, np.uint8))
        read = [names[i] for i in np.flatnonzero(np.unpackbits(together))]
    if read is not None:  # a constant list prunes folders before anything is read
        base = base.filter(F.col("part").isin(read)) if read else base.filter(F.lit(False))
    forms = filter_forms(table)[0]
    if len(forms) <= most and None not in forms:
        base = base.filter(reduce(or_, [dnf_column(form, attrs) for form in forms], F.lit(False)))
    return base


def _broadcast_search(base: DataFrame, table: pa.Table, k: int, names: Sequence[str] | None) -> DataFrame:
    held = base.sparkSession.sparkContext.broadcast((table, names))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = QueryBlock(*held.value, k=k)
        for batch in batches:
            block.add(batch)
        yield from block.results()

    return base.mapInArrow(kernel, RESULT_TYPE)


# -- the step inside a task ----------------------------------------------------------------------

RESULT_SCHEMA = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("dist", pa.float64())])


def matrix(column) -> np.ndarray:
    """Equal-length list column as a float32 matrix, without a Python loop."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, 0), np.float32)
    sizes = pc.list_value_length(column)
    if column.null_count or pc.min_max(sizes).as_py()["min"] != pc.min_max(sizes).as_py()["max"]:
        raise ValueError("vectors have to be present and of one length")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float32, copy=False)


def filter_forms(table: pa.Table, step: int = 1024) -> tuple[list, np.ndarray]:
    """The distinct filters of the queries in hashable form, ``None`` being no filter, and the number of each query's own."""
    literals = lambda clause: tuple((l["attr"], l["neg"], l["value"]) for l in clause)
    forms: dict = {}
    numbers = np.empty(table.num_rows, np.int64)
    for s in range(0, table.num_rows, step):  # Python objects of a few queries at a time
        for i, form in enumerate(table.column("dnf").slice(s, step).to_pylist(), s):
            numbers[i] = forms.setdefault(None if form is None else tuple(map(literals, form)), len(forms))
    return list(forms), numbers


class QueryBlock:
    """Running top-k of a block of queries over the base rows of one task.

    A float32 matrix product rules rows out, with a margin that covers its rounding error; rows that
    remain are measured in double precision, so results do not depend on how Spark cut the data. What is
    held beside the queries and their k best has a fixed size: a tile of rows meets ``ASKED`` queries and their filters at a time.
    """

    ASKED, PRODUCT = 2048, 256  # queries whose filters are tested together, and those of one matrix product

    def __init__(self, table: pa.Table, names: Sequence[str] | None = None, *, k: int):
        self.k, self.n = k, table.num_rows
        # queries with the same filter are neighbours and masked together
        self.filters, numbers = filter_forms(table)
        if len(self.filters) > 1:
            order = np.argsort(numbers, kind="stable")
            table, numbers = table.take(pa.array(order)), numbers[order]
        self.filter_of = numbers
        self.qid = table.column("qid").to_numpy()
        self.vec = matrix(table.column("vector")).astype(np.float64)
        self.norm = np.einsum("ij,ij->i", self.vec, self.vec)
        self.twice = np.column_stack([2 * self.vec, np.ones(self.n)]).astype(np.float32)
        self.dist = np.full((self.n, k), np.inf)
        self.ids = np.full((self.n, k), np.iinfo(np.int64).max)
        self.bound = np.full(self.n, np.inf)  # no row beyond it can be among the k best
        if "bound" in table.column_names:
            self.bound = pc.fill_null(table.column("bound"), np.inf).to_numpy().copy()
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.routed = bool({"parts", "part_set"} & set(table.column_names))
        self.readers: dict = {}
        self.place: dict = {}
        if "part_set" in table.column_names:
            self.place = {name: i for i, name in enumerate(names)}
            width = (len(names) + 7) // 8
            sets = [b"\xff" * width if x is None else x for x in table.column("part_set").to_pylist()]
            self.sets = np.frombuffer(b"".join(sets), np.uint8).reshape(-1, width)
        elif self.routed:
            self.readers = self._readers(table)
        self.probed = None
        if "probes" in table.column_names:  # which codes of which table a query reads
            per_query = table.column("probes").combine_chunks()
            per_table = per_query.flatten()
            codes = per_table.flatten().to_numpy(zero_copy_only=False)
            tables = len(per_table) // self.n if self.n else 0
            self.probed = np.zeros((self.n, tables, 1 + codes.max(initial=0)), bool)
            owner = np.repeat(np.arange(len(per_table)), pc.list_value_length(per_table).to_numpy(zero_copy_only=False))
            self.probed.reshape(len(per_table), -1)[owner, codes] = True

    @staticmethod
    def _readers(table: pa.Table) -> dict:
        parts = table.column("parts").combine_chunks()
        owner = np.repeat(np.arange(table.num_rows), np.diff(parts.offsets.to_numpy()))
        codes = parts.flatten().dictionary_encode()
        index, order = codes.indices.to_numpy(), np.argsort(codes.indices.to_numpy(), kind="stable")
        edges = np.searchsorted(index[order], np.arange(len(codes.dictionary) + 1))
        return {name: owner[order[edges[i] : edges[i + 1]]] for i, name in enumerate(codes.dictionary.to_pylist())}

    def _who_reads(self, part) -> np.ndarray:
        at = self.place.get(part) if self.place else None
        if at is not None:  # read off the bitmaps anew: kept lists would take a number per query and partition
            return np.flatnonzero(self.sets[:, at >> 3] & (0x80 >> (at & 7)))
        return self.readers.get(part, np.empty(0, np.int64))

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows or not self.n:
            return
        ids, vectors = batch.column("id").to_numpy(), matrix(batch.column("vector"))
        values = batch.column("values").flatten().to_numpy().reshape(batch.num_rows, -1)
        hashed = None if self.probed is None else matrix(batch.column("codes")).astype(np.int64)
        groups = [(None, np.arange(self.n), np.arange(len(ids)))]
        if self.routed:
            codes = batch.column("part").dictionary_encode()
            place = codes.indices.to_numpy()
            groups = ((name, self._who_reads(name), np.flatnonzero(place == i)) for i, name in enumerate(codes.dictionary.to_pylist()))
        for part, asked, rows in groups:
            for start in range(0, len(rows) if len(asked) else 0, 4096):
                tile = rows[start : start + 4096]
                earlier = None if hashed is None else hashed[tile, : part >> 32]
                exact = vectors[tile].astype(np.float64)
                norms = np.einsum("ij,ij->i", exact, exact)
                # one product gives 2 q.r - |r|^2, so a row is close enough where that reaches |q|^2 - bound
                rows32 = np.column_stack([vectors[tile], -norms]).astype(np.float32)
                for s in range(0, len(asked), self.ASKED):
                    self._tile(asked[s : s + self.ASKED], ids[tile], exact, norms, rows32, values[tile], earlier)

    def _tile(self, asked, ids, exact, norms, rows32, values, earlier=None) -> None:
        used, group = np.unique(self.filter_of[asked], return_inverse=True)
        masks = self._masks(used, values)
        n_group, n_rows = np.bincount(group), masks.sum(axis=1)
        overhead = 20_000  # pairs a matrix product handles in the time one more call costs
        if np.sum(n_group * n_rows + overhead) < len(asked) * len(ids):
            work = [(asked[group == g], np.flatnonzero(masks[g]), None, None) for g in range(len(used)) if n_rows[g]]
        else:
            work = [(asked, np.arange(len(ids)), None if n_rows.min() == len(ids) else group, n_rows[group])]
        for queries, rows, mask_of, matches in work:
            block = rows32[rows].T
            longest = norms[rows].max()
            for s in range(0, len(queries), self.PRODUCT):
                q = queries[s : s + self.PRODUCT]
                near = self.twice[q] @ block
                passing = None if mask_of is None else masks[mask_of[s : s + self.PRODUCT]]
                bound = self.bound[q]
                scale = self.norm[q] + longest + np.where(np.isfinite(bound), bound, 0.0)
                slack = scale * (exact.shape[1] + 8) * 2.0**-22  # several times the rounding error
                limit = np.maximum(self.norm[q] - bound - slack, -np.finfo(np.float32).max)
                # without a bound yet, the k-th best of a tile with plenty of matches is one
                plenty = (len(rows) if matches is None else matches[s : s + self.PRODUCT]) > 2 * self.k
                first = np.flatnonzero(np.isinf(bound) & plenty)
                if len(first):
                    seen = near[first] if passing is None else np.where(passing[first], near[first], -np.inf)
                    kth = np.partition(seen, len(rows) - self.k, axis=1)[:, len(rows) - self.k]
                    limit[first] = np.maximum(limit[first], kth - 2 * slack[first])
                hit = near >= limit.astype(np.float32)[:, None]
                if passing is not None:
                    hit &= passing
                hit_q, hit_r = np.divmod(np.flatnonzero(hit), len(rows))
                hit_q, hit_r = q[hit_q], rows[hit_r]
                self._measure(hit_q, hit_r, ids, exact, earlier)
                if sum(len(f[0]) for f in self.found) >= max(50_000, self.n * self.k // 2):
                    self._merge()

    def _masks(self, used, values) -> np.ndarray:
        """Which rows pass each of the filters; every distinct literal is tested once per tile."""
        named = {l[0] for f in used for clause in self.filters[f] or () for l in clause}
        if named and not 0 <= min(named) <= max(named) < values.shape[1]:
            raise ValueError(f"a filter names an attribute outside the {values.shape[1]} of the search")
        tested = {l: (values[:, l[0]] >= l[2]) != l[1] for f in used for clause in self.filters[f] or () for l in clause}
        masks = np.empty((len(used), len(values)), bool)
        for i, f in enumerate(used):
            dnf = self.filters[f]
            hold = [np.logical_and.reduce([tested[l] for l in c]) if len(c) > 1 else tested[c[0]] if c else True for c in dnf or ()]
            masks[i] = True if dnf is None else np.logical_or.reduce(hold) if len(hold) > 1 else hold[0] if hold else False
        return masks

    def _measure(self, q, r, ids, exact, earlier=None) -> None:
        for s in range(0, len(q), 4_096):
            part_q, part_r = q[s : s + 4_096], r[s : s + 4_096]
            if earlier is not None and earlier.shape[1]:  # pairs that an earlier table has
                new = ~self.probed[part_q[:, None], np.arange(earlier.shape[1]), np.minimum(earlier[part_r], self.probed.shape[2] - 1)].any(axis=1)
                part_q, part_r = part_q[new], part_r[new]
            diff = exact.take(part_r, axis=0)
            diff -= self.vec.take(part_q, axis=0)
            dist = np.einsum("ij,ij->i", diff, diff)
            close = dist <= self.bound[part_q]
            self.found.append((part_q[close], dist[close], ids[part_r[close]]))

    def _merge(self) -> None:
        """Fold the collected candidates into the running top-k."""
        q, dist, ids = (np.concatenate(x) for x in zip(*self.found))
        self.found = []
        order = np.argsort(q, kind="stable")
        q, dist, ids = q[order], dist[order], ids[order]
        owners, first, count = np.unique(q, return_index=True, return_counts=True)
        for s in range(0, len(owners), 512):
            own, n = owners[s : s + 512], count[s : s + 512]
            span = slice(first[s], first[s] + n.sum())
            row = np.repeat(np.arange(len(own)), n)
            col = self.k + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pool_d = np.full((len(own), self.k + n.max()), np.inf)
            pool_i = np.full(pool_d.shape, np.iinfo(np.int64).max)
            pool_d[:, : self.k], pool_i[:, : self.k] = self.dist[own], self.ids[own]
            pool_d[row, col], pool_i[row, col] = dist[span], ids[span]
            kth = np.partition(pool_d, self.k - 1, axis=1)[:, self.k - 1]
            keep = pool_d <= kth[:, None]
            tied = np.flatnonzero(keep.sum(axis=1) > self.k)
            if len(tied):  # several rows share the k-th distance: the smaller ids stay
                best = np.lexsort((pool_i[tied], pool_d[tied]), axis=1)[:, : self.k]
                keep[tied] = False
                keep[tied[:, None], best] = True
            self.dist[own] = pool_d[keep].reshape(len(own), self.k)
            self.ids[own] = pool_i[keep].reshape(len(own), self.k)
            self.bound[own] = np.minimum(self.bound[own], kth)

    def results(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            self._merge()
        step = max(1, 250_000 // self.k)
        for s in range(0, self.n, step):
            q, col = np.nonzero(np.isfinite(self.dist[s : s + step]))
            columns = [self.qid[s + q], self.ids[s + q, col], self.dist[s + q, col]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=RESULT_SCHEMA)


ship_by_value(__name__)
