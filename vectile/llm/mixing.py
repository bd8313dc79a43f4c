"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents that belong to the same set of sources are one pattern. A pattern can supply its words once for nothing and
again at a rising price, up to a number of times; each source takes words up to its quota. The cheapest
largest flow between the two, over one node per pattern and source, says how many words of each pattern the mix
takes; documents are then selected by a seeded hash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectile.llm.common import WORD, packed, whole_text
from vectile.session import materialise

FLIPS = 3
BROADCAST_ROWS = 20_000
Pattern = tuple[str | None, ...]


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (1, 2, 3), most: int = 3) -> dict[str | None, float]:
    """Words each source should get: all words shared by weight, none above ``most`` times its size.

    Weights repeat over the sources in the order of code points, null last. What a source cannot take is shared anew by
    weight among the others until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    got, left, open_ = {}, float(sum(sizes.values())), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        full = [s for s in open_ if share[s] > most * sizes[s]]
        if not full:
            return got | share
        got |= {s: float(most * sizes[s]) for s in full}
        left -= sum(got[s] for s in full)
        open_ = [s for s in open_ if s not in got]
    return got


class Flow:
    """Largest flows by blocking flows over shortest paths; nodes are numbers, 0 the start and 1 the end."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.left: list[int] = []  # an arc and its reverse are neighbours
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, capacity: int) -> int:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.left += [capacity, 0]
        return len(self.to) - 2

    def _depths(self) -> list[int]:
        depth = [-1] * len(self.out)
        depth[0], row = 0, [0]
        while row and depth[1] < 0:
            after = []
            for a in row:
                for i in self.out[a]:
                    b = self.to[i]
                    if self.left[i] and depth[b] < 0:
                        depth[b] = depth[a] + 1
                        after.append(b)
            row = after
        return depth

    def run(self) -> None:
        """Push all that the capacities let through."""
        to, left, out = self.to, self.left, self.out
        while (depth := self._depths())[1] >= 0:
            tried, path, node = [0] * len(out), [], 0
            while True:
                if node == 1:
                    step = min(left[i] for i in path)
                    for i in path:
                        left[i] -= step
                        left[i ^ 1] += step
                    # Go back to the first arc that is full now.
                    full = next(k for k, i in enumerate(path) if not left[i])
                    node = to[path[full] ^ 1]
                    del path[full:]
                    continue
                while tried[node] < len(out[node]):
                    i = out[node][tried[node]]
                    if left[i] and depth[to[i]] == depth[node] + 1:
                        break
                    tried[node] += 1
                if tried[node] < len(out[node]):
                    path.append(i)
                    node = to[i]
                elif path:
                    node = to[path.pop() ^ 1]
                    tried[node] += 1
                else:
                    break


def route(supply: dict[Pattern, int], quota: dict[str | None, int], most: int = 3) -> dict[tuple[Pattern, str | None], int]:
    """Words that each pattern gives to each of its sources.

    The quotas are met as far as possible, and among the ways to do so the one with the least repetition is taken: the
    n-th use of a pattern's words costs n - 1 each. Prices stand on the arcs that leave the start, and what these can
    carry together is a polymatroid; so the largest flow at one price, enlarged at the next, is a cheapest one. A
    source whose patterns belong to no other needs no flow where it has one pattern alone.
    """
    patterns = sorted((p for p in supply if p), key=repr)
    of_source: dict[str | None, int] = defaultdict(int)
    for pattern in patterns:
        for source in pattern:
            of_source[source] += 1
    alone = [p for p in patterns if len(p) == 1 and of_source[p[0]] == 1]
    routed = {(p, p[0]): min(most * supply[p], quota.get(p[0], 0)) for p in alone}
    shared = [p for p in patterns if (p, p[0]) not in routed]
    sources = sorted({s for p in shared for s in p}, key=repr)
    place = {s: 2 + len(shared) + i for i, s in enumerate(sources)}
    flow, arcs = Flow(2 + len(shared) + len(sources)), {}
    enter = [flow.arc(0, 2 + i, 0) for i in range(len(shared))]
    for i, pattern in enumerate(shared):
        for source in pattern:
            arcs[pattern, source] = flow.arc(2 + i, place[source], most * supply[pattern])
    for source in sources:
        flow.arc(place[source], 1, quota.get(source, 0))
    for _ in range(most):
        for i, pattern in zip(enter, shared):
            flow.left[i] += supply[pattern]
        flow.run()
    return routed | {key: flow.left[i ^ 1] for key, i in arcs.items()}


def small(table: DataFrame, rows: int) -> DataFrame:
    """A table of one row per pattern, to be broadcast if its counted rows are few; else joins shuffle and AQE splits them."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def word_count(text: str = "text") -> Column:
    return F.size(F.regexp_extract_all(whole_text(text), F.lit(WORD), F.lit(0))).cast("long")


def membership(source: str) -> Column:
    """The pattern of documents that belong to one source each."""
    return F.array(F.col(source).cast("string"))


def measured(docs: DataFrame, members: Column, doc_id: str, text: str, seed: int, keep: Column | None = None) -> DataFrame:
    """(pattern, size, draw) of each document beside ``keep``; ``draw`` is a seeded hash of id and text below 2^63."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), whole_text(text)), 1)
    return docs.select(F.array_sort(F.array_distinct(members)).alias("pattern"), word_count(text).alias("size"), draw.alias("draw"), *([keep.alias("row")] if keep is not None else []))


PLAN = T.StructType([T.StructField("pattern", T.ArrayType(T.StringType())), T.StructField("uses", T.LongType()), T.StructField("rest", T.LongType())])


def select_documents(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(pattern, uses, edge, of_edge, flips): every document is used ``uses`` times, and once more if its draw is below ``edge``.

    The documents of a pattern stand in the order of their draws, and ``rest`` words are wanted from the front. Where
    that point lies is narrowed down by two histograms of 4,096 slices over partial sums, so only a 2^24-th of a
    pattern is ever ordered, whatever its share of all rows; equal rows are counted before. Of the ``edge`` draw, where
    the point lies, ``of_edge`` rows are used once more. Then one row of each of ``FLIPS`` draws, each the one whose
    inclusion or exclusion brings the pattern nearest to what is wanted, changes sides.
    """
    partial = plan.where("rest > 0").select(F.col("pattern").alias("wanted"), "rest")
    rows = sized.join(partial, F.col("pattern") == F.col("wanted")).select("pattern", "rest", "size", "draw")
    # Per level: the slice of the pattern in which the running total passes what is wanted.
    level = rows.select("pattern", F.col("rest").alias("missing"), "size", "draw", F.lit(0).cast("long").alias("slice"))
    for shift in (51, 39):
        sums = level.groupBy("pattern", "missing", F.shiftright("draw", shift).alias("slice")).agg(F.sum("size").alias("words"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("pattern").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        stands = sums.withColumn("before", before).where((F.col("before") <= F.col("missing")) & (F.col("missing") < F.col("before") + F.col("words")))
        at = materialise(stands.select("pattern", (F.col("missing") - F.col("before")).alias("missing"), "slice"))
        here = at.select(F.col("pattern").alias("there"), "missing", "slice")
        level = rows.select("pattern", "size", "draw").join(here, (F.col("pattern") == F.col("there")) & (F.shiftright("draw", shift) == F.col("slice"))).select("pattern", "missing", "size", "draw", "slice")
    equal = level.groupBy("pattern", "missing", "draw").agg(F.sum("size").alias("words"), F.max("size").alias("size"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("pattern").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = equal.withColumn("missing", F.col("missing") - before).where("missing >= 0 AND missing < words")
    of_edge = F.expr("missing div size")
    front = inside.select("pattern", F.col("draw").alias("edge"), of_edge.alias("of_edge"), (F.col("missing") - of_edge * F.col("size")).alias("missing"))
    front = materialise(front.withColumn("flips", F.array().cast("array<long>")))
    for _ in range(FLIPS):
        there = front.withColumnRenamed("pattern", "there")
        others = sized.where("size > 0").join(there, F.col("pattern") == F.col("there")).where("NOT array_contains(flips, draw)")
        change = F.when(F.col("draw") < F.col("edge"), -F.col("size")).otherwise(F.col("size"))
        gap = F.abs(F.col("missing") - change)
        best = others.where(gap < F.abs("missing")).groupBy("pattern").agg(F.min(F.struct(gap.alias("gap"), "draw", change.alias("change"))).alias("best"))
        flips = F.when(F.col("best").isNull(), F.col("flips")).otherwise(F.array_append("flips", F.col("best.draw")))
        front = materialise(front.join(best, "pattern", "left").select("pattern", "edge", "of_edge", (F.col("missing") - F.coalesce("best.change", F.lit(0))).alias("missing"), flips.alias("flips")))
    # A pattern whose wanted words are all of it has no slice that passes them; the plan counts it as one more use.
    return plan.select("pattern", "uses").join(front.drop("missing"), "pattern", "left")


def planned_mix(sized: DataFrame, weights: Sequence[float], most: int) -> tuple[dict[str | None, int], dict[str | None, float], DataFrame]:
    """Sizes and targets of the sources, and the selection of every pattern. The driver gets one row per pattern, and solves the flow."""
    spark = sized.sparkSession
    supply = {tuple(r.pattern): int(r.words or 0) for r in sized.groupBy("pattern").agg(F.sum("size").alias("words")).collect()}
    sizes: dict[str | None, int] = defaultdict(int)
    for pattern, words in supply.items():
        for source in pattern:
            sizes[source] += words
    # All words are shared, so words of several sources count once.
    goal = targets(dict(sizes), weights, most)
    scale = sum(supply.values()) / max(sum(sizes.values()), 1)
    goal = {s: t * scale for s, t in goal.items()} if scale < 1 else goal
    flows: dict[Pattern, int] = defaultdict(int)
    for (pattern, _), words in route(supply, {s: round(t) for s, t in goal.items()}, most).items():
        flows[pattern] += words
    rows = [(list(p), flows[p] // words if words else 0, flows[p] % words if words else 0) for p, words in supply.items()]
    chosen = select_documents(sized, small(spark.createDataFrame(rows, PLAN), len(rows)))
    return dict(sizes), goal, small(chosen, len(rows))


def with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copy``: 1, 2, ... among the rows of a (pattern, draw), in the order of a hash of ``row``.

    Rows are written with the task they come from, and numbers are sums of counts before plus a place within (hash,
    task), so no task holds all rows of one draw. Rows of equal hashes are alike, and any order of them will do.
    """
    mark = F.xxhash64(F.to_json(F.struct("row")))
    kept = materialise(rows.withColumn("mark", mark).withColumn("task", F.spark_partition_id()))
    key = ["pattern", "draw"]
    before = lambda n, by, order: F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = kept.groupBy(*key, "mark", "task").agg(F.count("*").alias("n")).withColumn("bucket", F.shiftrightunsigned("mark", 52))
    buckets = marks.groupBy(*key, "bucket").agg(F.sum("n").alias("n")).withColumn("ahead", before("n", key, ["bucket"])).drop("n")
    starts = marks.withColumn("within", before("n", [*key, "bucket"], ["mark", "task"])).join(buckets, [*key, "bucket"])
    starts = starts.select(*key, "mark", "task", (F.col("ahead") + F.col("within")).alias("first"))
    place = F.row_number().over(Window.partitionBy(*key, "mark", "task").orderBy(F.lit(0)))
    return kept.withColumn("place", place).join(starts, [*key, "mark", "task"]).withColumn("copy", F.col("first") + F.col("place")).drop("mark", "task", "place", "first")


def with_times(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rows`` (pattern, draw, row and more) with ``times``: how often the mix uses each."""
    placed = rows.join(chosen, "pattern")
    draw, edge, flipped = F.col("draw"), F.col("edge"), F.coalesce(F.array_contains("flips", F.col("draw")), F.lit(False))
    split = F.coalesce(draw == edge, F.lit(False)) | flipped
    whole = placed.where(~split).withColumn("times", F.col("uses") + F.coalesce(draw < edge, F.lit(False)).cast("int"))
    again = F.when(draw == edge, F.col("copy") <= F.col("of_edge") + flipped.cast("int")).when(draw < edge, F.col("copy") > 1).otherwise(F.col("copy") <= 1)
    some = with_copies(placed.where(split)).withColumn("times", F.col("uses") + again.cast("int"))
    return whole.unionByName(some.drop("copy"))


def mix_documents(docs: DataFrame, members: Column, weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is used, with all its columns; unused rows are gone.

    ``members`` is an array of the sources a document belongs to; null is a source like any other, and a document
    without any is never taken. Documents of equal id and text share a draw and are counted, so some of them can be
    taken. Size is the number of words; empty and null texts are taken as their draws have it, like others.
    """
    sized = materialise(measured(docs, members, doc_id, text, seed))
    _, _, chosen = planned_mix(sized, weights, most)
    taken = with_times(measured(docs, members, doc_id, text, seed, packed(docs)).drop("size"), chosen).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def mixed_sizes(docs: DataFrame, source: str = "source", weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document of single sources: (doc_id, size, source_size, target, taken); no rows from an empty table."""
    spark = docs.sparkSession
    sized = materialise(measured(docs, membership(source), doc_id, text, seed, F.col(doc_id)))
    sizes, goal, chosen = planned_mix(sized, weights, most)
    facts = spark.createDataFrame([([s], sizes[s], float(goal[s])) for s in sizes], "pattern array<string>, source_size long, target double")
    placed = with_times(sized, small(chosen.join(facts, "pattern"), len(sizes)))
    return placed.select(F.col("row").alias("doc_id"), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))
