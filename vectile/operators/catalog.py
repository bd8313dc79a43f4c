"""Partition catalogs: named boxes of attribute ranges, the column that routes rows into them, and pruning."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vectile.functions.predicates import (
    UNBOUNDED_HI,
    UNBOUNDED_LO,
    Predicate,
    all_of,
    as_column,
    at_least,
    catalog_truth,
    filter_text,
    negate,
    survives,
)
from vectile.session import ship_by_value

UNMATCHED = "__unmatched__"
#: A catalog is planning data held on the driver and inside plans; this bounds its size.
MAX_PARTITIONS = 16_384
#: Largest lookup table, in cells, that a routing column carries.
MAX_LOOKUP_CELLS = 1 << 20
#: Bits of a word in the sets of boxes: a bigint without its sign.
WORD_BITS = 62
#: Queries times partitions tested at once.
PRUNE_CELLS = 1 << 21

Bounds = tuple[int | None, int | None]


@dataclass(frozen=True)
class Box:
    name: str
    lo: tuple[int, ...]
    hi: tuple[int, ...]


class Catalog:
    """Ordered boxes over ``attrs``. Rows outside every box belong to ``__unmatched__``, which is never pruned."""

    def __init__(self, attrs: Sequence[str], boxes: Sequence[Box], unmatched: bool = True):
        if len(boxes) > MAX_PARTITIONS:
            raise ValueError(f"{len(boxes)} partitions; a catalog holds at most {MAX_PARTITIONS}")
        self.attrs = tuple(attrs)
        self.boxes = list(boxes)
        self.unmatched = unmatched

    @classmethod
    def from_ranges(cls, attrs: Sequence[str], partitions: Mapping[str, Mapping[str, Bounds]]) -> Catalog:
        """Explicit ranges, inclusive; ``None`` or a missing attribute means unconstrained."""
        boxes = []
        for name, ranges in partitions.items():
            bounds = [ranges.get(a, (None, None)) for a in attrs]
            boxes.append(
                Box(
                    name,
                    tuple(UNBOUNDED_LO if lo is None else int(lo) for lo, _ in bounds),
                    tuple(UNBOUNDED_HI if hi is None else int(hi) for _, hi in bounds),
                )
            )
        return cls(attrs, boxes)

    @classmethod
    def equal_width(cls, attrs: Sequence[str], maximum: int, n: int) -> Catalog:
        """``n`` slices of [0, maximum) on the first attribute, named ``lo_hi``.

        Slices start at the rounded multiples of maximum / n and are all maximum // n wide,
        so some values fall between two slices when n does not divide maximum.
        """
        width = maximum // n
        starts = [i * maximum / n for i in range(n)]
        ranges = [(round(s), round(s + width - 1)) for s in starts]
        return cls.from_ranges(attrs, {f"{lo}_{hi}": {attrs[0]: (lo, hi)} for lo, hi in ranges})

    @property
    def names(self) -> list[str]:
        return [b.name for b in self.boxes] + ([UNMATCHED] if self.unmatched else [])

    def _all_boxes(self) -> list[Box]:
        rest = Box(UNMATCHED, (UNBOUNDED_LO,) * len(self.attrs), (UNBOUNDED_HI,) * len(self.attrs))
        return self.boxes + ([rest] if self.unmatched else [])

    def box_predicate(self, box: Box) -> Predicate:
        lower = [at_least(a, lo) for a, lo in zip(self.attrs, box.lo) if lo != UNBOUNDED_LO]
        upper = [negate(at_least(a, hi + 1)) for a, hi in zip(self.attrs, box.hi) if hi != UNBOUNDED_HI]
        return all_of(*lower, *upper)

    # -- the catalog as a table ------------------------------------------------------------

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row per partition: position, name, bounds per attribute and the SQL text of its box."""
        fields = [T.StructField("pos", T.IntegerType()), T.StructField("part", T.StringType())]
        for a in self.attrs:
            fields += [T.StructField(f"lo_{a}", T.IntegerType()), T.StructField(f"hi_{a}", T.IntegerType())]
        fields.append(T.StructField("path", T.StringType()))
        rows = [
            (i, b.name, *[v for pair in zip(b.lo, b.hi) for v in pair], filter_text(self.box_predicate(b)))
            for i, b in enumerate(self._all_boxes())
        ]
        return spark.createDataFrame(rows, T.StructType(fields))

    @classmethod
    def from_df(cls, table: DataFrame) -> Catalog:
        attrs = [c[3:] for c in table.columns if c.startswith("lo_")]
        rows = table.orderBy("pos").limit(MAX_PARTITIONS + 2).collect()
        boxes = [Box(r.part, tuple(r[f"lo_{a}"] for a in attrs), tuple(r[f"hi_{a}"] for a in attrs)) for r in rows]
        named = [b for b in boxes if b.name != UNMATCHED]
        return cls(attrs, named, unmatched=len(named) < len(boxes))

    def overlapping(self) -> list[tuple[str, str]]:
        """Pairs of boxes that share points, so that their order decides. Planning data only."""
        lo, hi = (np.array([getattr(b, side) for b in self.boxes], dtype=np.int64) for side in ("lo", "hi"))
        pairs = []
        for i in range(len(self.boxes) - 1):
            shared = ((lo[i + 1 :] <= hi[i]) & (hi[i + 1 :] >= lo[i])).all(axis=1)
            pairs += [(self.boxes[i].name, self.boxes[i + 1 + int(j)].name) for j in np.flatnonzero(shared)]
        return pairs

    # -- routing ---------------------------------------------------------------------------

    def cuts(self) -> list[list[int]]:
        """Per attribute, the thresholds at which some box starts or ends."""
        out = []
        for d in range(len(self.attrs)):
            starts = {b.lo[d] for b in self.boxes} | {b.hi[d] + 1 for b in self.boxes}
            out.append(sorted(v for v in starts if UNBOUNDED_LO < v <= UNBOUNDED_HI))
        return out

    def route(self) -> Column:
        """Name of the first box that holds the row, as one generated expression: no join, no shuffle, no UDF."""
        index = self.route_index()
        names = literal_array(self.names, "array<string>")
        return F.coalesce(F.get(names, index), F.lit(UNMATCHED))

    def n_cells(self) -> int:
        """Cells of the grid that the bounds of all boxes cut."""
        return int(np.prod([len(c) + 1 for c in self.cuts()], dtype=object))

    def route_index(self) -> Column:
        """Position of the row's partition in the catalog."""
        cuts = self.cuts()
        shape = [len(c) + 1 for c in cuts]
        if self.n_cells() > MAX_LOOKUP_CELLS:
            return self._set_index(cuts)
        table = np.full(shape, len(self.boxes), dtype=np.int32)
        for i in range(len(self.boxes) - 1, -1, -1):  # the first matching box is written last
            box = self.boxes[i]
            cell = tuple(
                slice(int(np.searchsorted(c, lo, side="right")), int(np.searchsorted(c, hi, side="right")) + 1)
                for c, lo, hi in zip(cuts, box.lo, box.hi)
            )
            table[cell] = i
        flat = F.lit(0)
        for attr, c, size in zip(self.attrs, cuts, shape):
            flat = flat * F.lit(size) + bucket_of(F.col(attr), c)
        return F.get(literal_array(table.ravel().tolist(), "array<int>"), flat)

    def _set_index(self, cuts: Sequence[Sequence[int]]) -> Column:
        """Too many cells for a table: per attribute and bucket the set of boxes that reach it, as words of bits.

        A row's sets are ANDed word by word; the lowest bit left is the first box that holds it. That takes one step for every 62
        boxes and a table of buckets times boxes bits.
        """
        n_words = -(-len(self.boxes) // WORD_BITS)
        together = None
        for d, (attr, own) in enumerate(zip(self.attrs, cuts)):
            held = np.zeros((len(own) + 1, n_words * WORD_BITS), bool)
            for i, box in enumerate(self.boxes):
                held[np.searchsorted(own, box.lo[d], side="right") : np.searchsorted(own, box.hi[d], side="right") + 1, i] = True
            weights = 1 << np.arange(WORD_BITS, dtype=np.int64)
            words = (held.reshape(len(own) + 1, n_words, WORD_BITS) * weights).sum(axis=2)
            sets = F.get(literal_array(words.tolist(), "array<array<bigint>>"), bucket_of(F.col(attr), own))
            together = sets if together is None else F.zip_with(together, sets, lambda x, y: x.bitwiseAND(y))
        lowest = lambda w, i: F.when(w != 0, i * WORD_BITS + F.bit_count(w.bitwiseAND(-w) - 1))
        first = F.array_min(F.transform(together, lowest))  # nulls are passed over
        return F.coalesce(first, F.lit(len(self.boxes))).cast("int")

    # -- pruning ---------------------------------------------------------------------------

    def prune(self, spark: SparkSession, predicate: Predicate | None) -> DataFrame:
        """Catalog rows whose box holds or may hold matching rows."""
        table = self.to_df(spark)
        return table if predicate is None else table.filter(survives(catalog_truth(predicate, self.attrs)))

    def prune_names(self, spark: SparkSession, predicate: Predicate | None) -> list[str]:
        return [r.part for r in self.prune(spark, predicate).select("part").collect()]

    def with_part_sets(self, queries: DataFrame, dnf: str = "dnf") -> DataFrame:
        """Adds ``part_set``, the partitions a query has to read: a bitmap over the catalog's names, null for all of them.

        A map over the queries, without shuffle or join; a set takes one bit per partition, whatever the names. "Holds or may hold"
        passes through AND and OR, so one comparison per literal and partition decides: the upper
        bound for a plain threshold, the lower bound for a negated one.
        """
        boxes = self._all_boxes()
        lo, hi = (np.array([getattr(b, side) for b in boxes], dtype=np.int64).T for side in ("lo", "hi"))

        def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [s for whole in _slices(batch.column(dnf), max(1, PRUNE_CELLS // len(boxes))) for s in _part_sets(whole, lo, hi)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sets, pa.binary())], [*batch.schema.names, "part_set"])

        schema = T.StructType([*queries.schema.fields, T.StructField("part_set", T.BinaryType())])
        return queries.mapInArrow(prune, schema)

    def routes(self, queries: DataFrame, qid: str = "qid", dnf: str = "dnf") -> DataFrame:
        """(qid, part) for every partition a query has to read."""
        names = pa.array(self.names)

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, max(1, PRUNE_CELLS // len(names))):
                    batch = whole.slice(start, max(1, PRUNE_CELLS // len(names)))
                    full = b"\xff" * ((len(names) + 7) // 8)
                    sets = np.frombuffer(b"".join(full if s is None else s for s in batch.column("part_set").to_pylist()), np.uint8)
                    query, part = np.nonzero(np.unpackbits(sets.reshape(batch.num_rows, -1), axis=1, count=len(names)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(query)), names.take(pa.array(part))], [qid, "part"])

        schema = T.StructType([queries.schema[qid], T.StructField("part", T.StringType())])
        return self.with_part_sets(queries.select(qid, dnf), dnf).select(qid, "part_set").mapInArrow(opened, schema)


def _slices(column: pa.Array, step: int) -> Iterator[pa.Array]:
    return (column.slice(start, step) for start in range(0, len(column), step))


def _part_sets(forms: pa.ListArray, lo: np.ndarray, hi: np.ndarray) -> list[bytes | None]:
    """The bitmap of each filter; null for a filter that rules out nothing, which none at all does too."""
    literals = forms.flatten().flatten()
    attr, neg, value = (literals.field(n).to_numpy(zero_copy_only=False) for n in ("attr", "neg", "value"))
    if len(attr) and not 0 <= attr.min() <= attr.max() < len(lo):
        raise ValueError(f"a filter names an attribute outside the {len(lo)} of the catalog")
    may = np.where(neg[:, None], lo[attr] < value[:, None], hi[attr] >= value[:, None])
    clause = _per_list(~may, forms.flatten()) == 0
    kept = _per_list(clause, forms) > 0
    kept[forms.is_null().to_numpy(zero_copy_only=False)] = True
    return [None if whole else bits.tobytes() for whole, bits in zip(kept.all(axis=1), np.packbits(kept, axis=1))]


def _per_list(mask: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """How many of a list's elements are set, per list and column; empty lists count 0."""
    running = np.concatenate([np.zeros((1, mask.shape[1]), np.int32), np.cumsum(mask, axis=0, dtype=np.int32)])
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return running[ends[1:]] - running[ends[:-1]]


def literal_array(values: Sequence, ddl: str) -> Column:
    """A constant array, parsed once during planning."""
    return F.from_json(F.lit(json.dumps(list(values))), ddl)


def bucket_of(value: Column, cuts: Sequence[int], max_case: int = 256) -> Column:
    """Number of cuts at or below the value: a balanced CASE, or a binary search over a constant array for many cuts."""

    def build(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        mid = (first + last) // 2
        return F.when(value >= F.lit(cuts[mid]), build(mid + 1, last)).otherwise(build(first, mid))

    n = len(cuts)
    if n <= max_case:
        return build(0, n)
    table = literal_array(cuts, "array<bigint>")
    steps = literal_array([1 << i for i in reversed(range(n.bit_length()))], "array<int>")
    fits = lambda at: (at <= n) & (F.get(table, at - 1) <= value)
    return F.reduce(steps, F.lit(0), lambda at, step: F.when(fits(at + step), at + step).otherwise(at))


def mod_partition(key: Column, n: int) -> Column:
    """Partition by remainder: a control that no filter can prune."""
    return F.concat(F.lit("mod_"), F.pmod(key, F.lit(n)).cast("string"))


def validate(df: DataFrame, catalog: Catalog, attrs: Sequence[str] | None = None) -> DataFrame:
    """Per partition: rows routed to it and rows of it that lie inside its own box."""
    spark = df.sparkSession
    bounds = catalog.to_df(spark)
    inside = F.lit(True)
    for a in attrs or catalog.attrs:
        inside = inside & F.col(a).between(F.col(f"lo_{a}"), F.col(f"hi_{a}"))
    counted = (
        df.select(catalog.route().alias("part"), *catalog.attrs)
        .join(F.broadcast(bounds.drop("pos", "path")), "part")  # at most MAX_PARTITIONS rows
        .groupBy("part")
        .agg(F.count("*").alias("n_rows"), F.sum(inside.cast("bigint")).alias("n_inside"))
    )
    return (
        bounds.select("part")
        .join(counted, "part", "left")
        .select("part", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_rows", "n_inside")])
    )


def partition_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("part").agg(F.count("*").alias("n_rows"))


def selectivity(df: DataFrame, predicates: Mapping[str, Predicate]) -> DataFrame:
    """Share of rows passing each predicate: one scan and one partial aggregate for all of them."""
    passing = F.create_map(
        *[c for name, p in predicates.items() for c in (F.lit(name), F.avg(F.coalesce(as_column(p), F.lit(False)).cast("int")))]
    )
    return df.agg(passing.alias("m")).select(F.explode("m").alias("predicate", "selectivity"))


def atom_selectivity(df: DataFrame, atoms: Sequence[tuple[str, int]]) -> DataFrame:
    """(attr, value, selectivity) of any number of thresholds ``attr >= value``: the share of all rows that pass, null without rows.

    Every attribute is bucketed by its sorted thresholds, which stand in the plan as one constant each; one aggregate counts the
    buckets, one row per threshold at most, and suffix sums turn counts into rows that pass. A null attribute passes nothing.
    """
    spark = df.sparkSession
    cuts: dict[str, list[int]] = {}
    for attr, value in sorted(set(atoms)):
        cuts.setdefault(attr, []).append(value)
    place = lambda attr: F.when(F.col(attr).isNull(), F.lit(0)).otherwise(bucket_of(F.col(attr), cuts[attr], max_case=0))
    entries = F.array(*[F.struct(F.lit(a).alias("attr"), place(a).alias("bucket")) for a in cuts])
    counted = df.select(F.explode(entries).alias("e")).groupBy("e.attr", "e.bucket").agg(F.count("*").alias("n"))
    named = [(a, i + 1, v) for a, own in cuts.items() for i, v in enumerate(own)]  # a row passes the thresholds up to its bucket
    thresholds = spark.createDataFrame(pd.DataFrame(named, columns=["attr", "bucket", "value"]), "attr string, bucket int, value int")
    total = counted.groupBy("attr").agg(F.sum("n").alias("total"))
    upwards = Window.partitionBy("attr").orderBy(F.col("bucket").desc())
    joined = thresholds.join(counted, ["attr", "bucket"], "left").withColumn("passing", F.sum(F.coalesce("n", F.lit(0))).over(upwards))
    return joined.join(total, "attr", "left").select("attr", "value", (F.col("passing") / F.col("total")).alias("selectivity"))


ship_by_value(__name__)
