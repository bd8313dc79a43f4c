"""Workload-driven partition tree, grown level by level from one distributed aggregation.

A split decision depends only on how many rows lie in each cell of the grid that the candidate
thresholds cut, so the rows are aggregated to cells once. Cells descend to their open node. Nodes of many cells are split level by level:
cells are counted by node, attribute and bucket, and a node's counts, at most one per threshold, decide. All smaller nodes
are groups of one last pass that grows what hangs on each. Only the chosen splits reach the driver.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectile.functions.predicates import UNBOUNDED_HI, UNBOUNDED_LO, at_least
from vectile.operators.catalog import MAX_LOOKUP_CELLS, Box, Catalog, bucket_of, literal_array
from vectile.session import materialise, ship_by_value

#: Cells of a node that one task may grow to the end.
LOCAL_CELLS = 200_000


@dataclass(frozen=True)
class TreeParams:
    # The defaults that published results of the method use.
    min_predicate_frequency: int = 10
    selectivity_threshold: float = 0.11
    min_partition_size: int = 1_000
    max_num_partitions: int = 4_096


@dataclass(frozen=True)
class Candidate:
    attr: int  # position among the attributes
    value: int
    bucket: int  # rows with value >= threshold are those in this bucket or a later one


@dataclass
class Tree:
    """Splits by path. A path is a string of '0' (true side) and '1' (false side) from the root."""

    attrs: tuple[str, ...]
    splits: dict[str, Candidate] = field(default_factory=dict)

    def leaf_paths(self) -> list[str]:
        """Leaves from left to right, true side first: plain string order."""
        if not self.splits:
            return [""]
        ends = {p + side for p in self.splits for side in "01"}
        return sorted(ends - self.splits.keys())

    def catalog(self) -> Catalog:
        """One box per leaf, by intersecting the bounds along its path."""
        boxes = []
        for number, path in enumerate(self.leaf_paths()):
            lo = [UNBOUNDED_LO] * len(self.attrs)
            hi = [UNBOUNDED_HI] * len(self.attrs)
            for depth, side in enumerate(path):
                split = self.splits[path[:depth]]
                if side == "0":
                    lo[split.attr] = max(lo[split.attr], split.value)
                else:
                    hi[split.attr] = min(hi[split.attr], split.value - 1)
            boxes.append(Box(f"part_{number}", tuple(lo), tuple(hi)))
        return Catalog(self.attrs, boxes, unmatched=False)

    def case_route(self) -> Column:
        """Nested CASE for small trees; larger ones use the lookup of ``Catalog.route``."""
        names = {path: f"part_{i}" for i, path in enumerate(self.leaf_paths())}

        def build(path: str) -> Column:
            split = self.splits.get(path)
            if split is None:
                return F.lit(names[path])
            passes = F.col(self.attrs[split.attr]) >= F.lit(split.value)
            return F.when(passes, build(path + "0")).otherwise(build(path + "1"))

        return build("")

    def nodes(self) -> tuple[list[tuple[int, int, int, int]], dict[str, int]]:
        """Flat nodes (attribute, threshold, true child, other child), the root first, and the number of every path.

        Leaves follow the splits, from left to right; children are numbers of either.
        """
        number = {path: i for i, path in enumerate([*sorted(self.splits, key=lambda p: (len(p), p)), *self.leaf_paths()])}
        flat = [(s.attr, s.value, number[p + "0"], number[p + "1"]) for p, s in sorted(self.splits.items(), key=lambda x: number[x[0]])]
        return flat, number

    def descent(self) -> Column:
        """The leaf's name by following the nodes: as many steps as the tree is deep, however many leaves it has."""
        flat, _ = self.nodes()
        values = F.array(*[F.col(a).cast("int") for a in self.attrs])
        depth = max(map(len, self.leaf_paths()))
        leaf = follow(flat, values, depth) - len(flat)
        return F.get(literal_array([f"part_{i}" for i in range(len(flat) + 1)], "array<string>"), leaf)

    def route(self, max_case_leaves: int = 128) -> Column:
        """A nested CASE for few leaves, a lookup where the grid of thresholds is small enough, else the descent."""
        if len(self.splits) < max_case_leaves:
            return self.case_route()
        catalog = self.catalog()
        return catalog.route() if catalog.n_cells() <= MAX_LOOKUP_CELLS else self.descent()

    def __str__(self) -> str:
        names = {path: f"part_{i}" for i, path in enumerate(self.leaf_paths())}
        lines = []

        def show(path: str) -> None:
            pad = "  " * len(path)
            split = self.splits.get(path)
            if split is None:
                lines.append(pad + names[path])
                return
            test = str(at_least(self.attrs[split.attr], split.value))
            for side, label in (("0", test), ("1", f"not({test})")):
                lines.append(pad + label)
                show(path + side)

        show("")
        return "\n".join(lines)


def candidates_of(atoms: Sequence[tuple[str, int, int]], attrs: Sequence[str], params: TreeParams) -> list[Candidate]:
    """Frequent thresholds, most frequent first; ties keep the given order."""
    frequent = [a for a in sorted(atoms, key=lambda a: -a[2]) if a[2] >= params.min_predicate_frequency]
    cuts = {a: sorted({v for name, v, _ in frequent if name == a}) for a in attrs}
    position = {a: i for i, a in enumerate(attrs)}
    return [Candidate(position[name], v, bisect_left(cuts[name], v) + 1) for name, v, _ in frequent]


def cuts_of(candidates: Sequence[Candidate], n_attrs: int) -> list[list[int]]:
    return [sorted({c.value for c in candidates if c.attr == d}) for d in range(n_attrs)]


def cell_table(df: DataFrame, attrs: Sequence[str], cuts: Sequence[Sequence[int]]) -> DataFrame:
    """Rows per grid cell: ``b0, b1, ..., n``. Partial aggregation leaves at most one row per cell and task."""
    buckets = [bucket_of(F.col(a), c).alias(f"b{d}") for d, (a, c) in enumerate(zip(attrs, cuts))]
    return df.select(*buckets).groupBy(*[f"b{d}" for d in range(len(attrs))]).agg(F.count("*").alias("n"))


def follow(nodes: Sequence[tuple[int, int, int, int]], values: Column, depth: int) -> Column:
    """Number that a row reaches from node 0 in at most ``depth`` steps; numbers past the nodes are ends.

    A null value takes the other side, as in SQL's CASE.
    """
    attr, threshold, yes, no = (literal_array([n[i] for n in nodes], "array<int>") for i in range(4))

    def step(at: Column, _: Column) -> Column:
        passes = F.get(values, F.get(attr, at)) >= F.get(threshold, at)
        return F.when(at >= len(nodes), at).when(passes, F.get(yes, at)).otherwise(F.get(no, at))

    return F.reduce(literal_array(range(depth), "array<int>"), F.lit(0), step) if depth else F.lit(0)


def build_tree(
    df: DataFrame, attrs: Sequence[str], atoms: Sequence[tuple[str, int, int]], params: TreeParams = TreeParams(), local_cells: int = LOCAL_CELLS
) -> Tree:
    """Grow the tree for rows ``df`` from ``atoms``, the (attribute, threshold, frequency) list of a workload.

    Nodes of more than ``local_cells`` cells are split one level after the other; every smaller one is a group of one
    last pass, which grows all that hangs on it.
    """
    candidates = candidates_of(atoms, attrs, params)
    tree = Tree(tuple(attrs))
    if not candidates or params.max_num_partitions < 2:
        return tree
    cells = materialise(cell_table(df, attrs, cuts_of(candidates, len(attrs))))
    budget = params.max_num_partitions - 1
    taken: dict[str, int] = {}  # the candidate of each split
    opened, small = {"": (0, cells.count())}, {}  # of a node, the first candidate it may use and its number of cells
    while opened:
        small |= {p: first for p, (first, n) in opened.items() if n <= local_cells}
        opened = {p: first for p, (first, n) in opened.items() if n > local_cells}
        picked = _split(cells, taken, opened, candidates, params) if opened else {}
        # the budget goes to the first splits in path order, so later ones can never be kept
        taken = dict(sorted({**taken, **{p: i for p, (i, *_) in picked.items()}}.items())[:budget])
        sides = [(p + side, i + 1, n) for p, (i, *own) in picked.items() if p in taken for side, n in zip("01", own)]
        opened = {p: (first, n) for p, first, n in sides if first < len(candidates)}
    small = {p: first for p, first in small.items() if not p or p[:-1] in taken}
    if small:
        taken = dict(sorted({**taken, **_finish(cells, taken, small, candidates, params, budget)}.items())[:budget])
    tree.splits = {path: candidates[i] for path, i in taken.items()}
    return tree


def _at_nodes(cells: DataFrame, taken: dict[str, int], nodes: dict[str, int], candidates: Sequence[Candidate]) -> tuple[DataFrame, dict[int, str]]:
    """The cells of some open ``nodes`` with the number of their node, and the path of each number."""
    d = len(cells.columns) - 1
    grown = Tree(tuple(f"b{i}" for i in range(d)), {p: Candidate(candidates[i].attr, candidates[i].bucket, 0) for p, i in taken.items()})
    flat, number = grown.nodes()
    buckets = F.array(*[F.col(f"b{i}") for i in range(d)])
    paths = {number[path]: path for path in nodes}
    level = cells.withColumn("node", follow(flat, buckets, max(map(len, grown.leaf_paths()))))
    return level.filter(F.col("node").isin(sorted(paths))).select("node", buckets.alias("buckets"), "n"), paths


def _split(cells: DataFrame, taken: dict[str, int], nodes: dict[str, int], candidates: Sequence[Candidate], params: TreeParams) -> dict[str, tuple[int, int, int]]:
    """Of each node, the first candidate that passes and the cells on its sides: one aggregation, one small group per node."""
    level, paths = _at_nodes(cells, taken, nodes, candidates)
    marked = level.select("node", "n", F.posexplode("buckets").alias("attr", "bucket"))
    counts = marked.groupBy("node", "attr", "bucket").agg(F.sum("n").alias("n"), F.count("*").alias("cells"))
    attr, bucket = (np.array([getattr(c, f) for c in candidates]) for f in ("attr", "bucket"))
    shape = (len(cells.columns) - 1, max(bucket) + 2)

    def choose(group: pa.Table) -> pa.Table:
        node = group.column("node")[0].as_py()
        start = nodes[paths[node]]
        above = {}
        for name in ("n", "cells"):
            held = np.zeros(shape, np.int64)
            np.add.at(held, (group.column("attr").to_numpy(), group.column("bucket").to_numpy()), group.column(name).to_numpy())
            above[name] = np.cumsum(held[:, ::-1], axis=1)[:, ::-1]  # in this bucket or a later one
        fits = _acceptable(above["n"][attr[start:], bucket[start:]], above["n"][0, 0], params)
        at = [start + int(np.argmax(fits))] if fits.any() else []
        yes = [int(above["cells"][attr[i], bucket[i]]) for i in at]
        no = [int(above["cells"][0, 0]) - y for y in yes]
        return pa.table({"node": pa.array([node] * len(at), pa.int32()), "cand": pa.array(at, pa.int32()), "yes": pa.array(yes, pa.int64()), "no": pa.array(no, pa.int64())})

    found = counts.groupBy("node").applyInArrow(choose, "node int, cand int, yes long, no long").collect()  # a row per open node
    return {paths[r.node]: (r.cand, r.yes, r.no) for r in found}


def _finish(cells: DataFrame, taken: dict[str, int], nodes: dict[str, int], candidates: Sequence[Candidate], params: TreeParams, budget: int) -> dict[str, int]:
    """The splits below each of the nodes, the first ``budget`` of them in path order. A group holds the cells of one node."""
    level, paths = _at_nodes(cells, taken, nodes, candidates)
    attr, bucket = (np.array([getattr(c, f) for c in candidates]) for f in ("attr", "bucket"))

    def grow(group: pa.Table) -> pa.Table:
        path = paths[group.column("node")[0].as_py()]
        grid = group.column("buckets").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        weight = group.column("n").to_numpy()
        splits: dict[str, int] = {}
        pending = [(path, np.arange(len(weight)), nodes[path])]
        while pending and len(splits) < budget:
            here, rows, first = pending.pop()
            if first >= len(attr) or not len(rows):
                continue
            # rows at or above each bucket, per attribute, give the true side of every candidate at once
            above = np.zeros((grid.shape[1], max(bucket) + 2))
            for d in range(grid.shape[1]):
                own = np.bincount(grid[rows, d], weight[rows], max(bucket) + 2)
                above[d] = np.cumsum(own[::-1])[::-1]
            fits = _acceptable(above[attr[first:], bucket[first:]], above[0, 0], params)
            if fits.any():
                chosen = first + int(np.argmax(fits))
                splits[here] = chosen
                side = grid[rows, attr[chosen]] >= bucket[chosen]
                pending.append((here + "1", rows[~side], chosen + 1))
                pending.append((here + "0", rows[side], chosen + 1))
        return pa.table({"path": pa.array(list(splits), pa.string()), "cand": pa.array(list(splits.values()), pa.int32())})

    found = level.groupBy("node").applyInArrow(grow, "path string, cand int").orderBy("path").limit(budget)
    return {r.path: r.cand for r in found.collect()}


def _acceptable(yes, total, params):
    share, t, size = yes / total, params.selectivity_threshold, params.min_partition_size
    return ~(share < t) & ~(share > 1 - t) & (yes >= size) & (total - yes >= size)


ship_by_value(__name__)
