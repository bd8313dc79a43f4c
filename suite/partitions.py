"""Catalogs, the workload-driven tree, routing, pruning and partitioned storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.filters import ATTR_NAME, CHARACTERIZE
from suite.tables import (
    ATTRS, BASE, BOXES, EXAMPLE, ITEMS, SIX_BOXES, base, boxes_by_order, filters_sql, items, truth_sql, workload,
)
from vectile.functions.predicates import catalog_truth, survives
from vectile.operators.catalog import Catalog, mod_partition, partition_sizes, validate
from vectile.operators.tree import TreeParams, candidates_of, cell_table, cuts_of
from vectile.operators.workload import atom_list, characterize, explode_atomics
from vectile.plans.pipelines import plan_layout
from vectile.session import shared_dir
from vectile.sources.collection import compact, read_catalog, read_collection, write_collection

PARAMS = TreeParams(min_predicate_frequency=100, min_partition_size=100, max_num_partitions=16)

#: Overlapping boxes and a gap: the first match counts.
OVERLAPPING = {
    "low": {"x": (None, 399), "z": (0, 499)},
    "wide": {"x": (200, 799)},
    "corner": {"w": (500, None), "x": (700, None), "y": (None, 299)},
    "high": {"x": (900, None), "y": (300, 899)},
}


def _catalog(boxes) -> Catalog:
    return Catalog.from_ranges(ATTRS, boxes)


def _sizes(df, route):
    return partition_sizes(df.select(route.alias("part")))


def range_partition(spark, sf):
    return _sizes(items(spark, sf), Catalog.equal_width(("x", "w", "y", "z"), 1000, 7).route())


def mod_partitions(spark, sf):
    return _sizes(items(spark, sf, "l_orderkey"), mod_partition(F.col("l_orderkey"), 5))


def explicit_partition(spark, sf):
    return validate(items(spark, sf), _catalog(SIX_BOXES))


def route_ranges(spark, sf):
    return items(spark, sf, "l_orderkey", "l_linenumber", "l_partkey").withColumn("part", _catalog(OVERLAPPING).route())


def _tree(spark, sf):
    return plan_layout(items(spark, sf), workload(spark, sf), ATTRS, PARAMS)


def tree_cells(spark, sf):
    atoms = atom_list(characterize(explode_atomics(workload(spark, sf), ATTRS)))
    cuts = cuts_of(candidates_of(atoms, ATTRS, PARAMS), len(ATTRS))
    return cell_table(items(spark, sf), ATTRS, cuts)


def tree_partitions(spark, sf):
    """Leaves of the tree that the orders' filters ask for, with their conditions and sizes."""
    tree = _tree(spark, sf)
    sizes = _sizes(items(spark, sf), tree.route())
    return tree.catalog().to_df(spark).select("part", "path").join(sizes, "part")


def tree_ranges(spark, sf):
    return _tree(spark, sf).catalog().to_df(spark).drop("path", "pos")


def route_tree(spark, sf):
    tree = _tree(spark, sf)
    rows = items(spark, sf, "l_orderkey", "l_linenumber", "l_partkey")
    return rows.withColumn("part", tree.route()).withColumn("looked_up", tree.catalog().route())


def partition_coverage(spark, sf):
    return validate(items(spark, sf), _tree(spark, sf).catalog())


def prune_partitions(spark, sf):
    """Orders whose attribute box the example filter cannot rule out."""
    return boxes_by_order(spark, sf).filter(survives(catalog_truth(EXAMPLE, ATTRS))).select("part")


def route_queries(spark, sf):
    """Partitions that each order's filter has to read."""
    return _tree(spark, sf).catalog().routes(workload(spark, sf))


def _cut_sql(a: int) -> str:
    return f"(SELECT count(*) FROM cand c WHERE c.a = {a} AND c.value <= {ATTRS[a]})"


# The greedy tree in SQL: every level tests the later candidates of each open node on the cell counts
# and keeps the first that passes; the budget then keeps the first splits in path order.
def tree_sql(source: str) -> str:
    return f"""{ITEMS}, {filters_sql("orders", "o_orderkey")}, {CHARACTERIZE},
cand AS (SELECT row_number() OVER (ORDER BY freq DESC, first) - 1 AS i, CASE attr WHEN 'w' THEN 0 WHEN 'x' THEN 1 WHEN 'y' THEN 2 ELSE 3 END AS a, attr, value
  FROM atoms WHERE freq >= {PARAMS.min_predicate_frequency}),
points AS (SELECT {", ".join(f"coalesce((SELECT max(c.value) FROM cand c WHERE c.a = {d} AND c.value <= {n}), -1) AS {n}" for d, n in enumerate(ATTRS))}, count(*) AS n FROM {source} GROUP BY ALL),
grown AS (
  WITH RECURSIVE nodes AS (
    SELECT '' AS path, 0 AS first, {", ".join(f"-2147483648 AS lo_{a}, 2147483647 AS hi_{a}" for a in ATTRS)}, CAST(NULL AS BIGINT) AS split, CAST(NULL AS INTEGER) AS a, CAST(NULL AS INTEGER) AS v, 0 AS kind
    UNION ALL
    SELECT path, first, {", ".join(f"lo_{a}, hi_{a}" for a in ATTRS)}, split, a, v, kind FROM (
      WITH tested AS (
        SELECT t.path, t.first, {", ".join(f"t.lo_{a}, t.hi_{a}" for a in ATTRS)}, c.i, c.a, c.value,
          sum(p.n) AS total, sum(CASE WHEN CASE c.a WHEN 0 THEN p.w WHEN 1 THEN p.x WHEN 2 THEN p.y ELSE p.z END >= c.value THEN p.n ELSE 0 END) AS yes
        FROM (SELECT * FROM nodes WHERE kind = 0) t JOIN cand c ON c.i >= t.first
        JOIN points p ON {" AND ".join(f"p.{a} BETWEEN t.lo_{a} AND t.hi_{a}" for a in ATTRS)}
        GROUP BY ALL),
      chosen AS (
        SELECT *, row_number() OVER (PARTITION BY path ORDER BY i) AS r FROM tested
        WHERE NOT (yes / total < {PARAMS.selectivity_threshold}) AND NOT (yes / total > 1 - {PARAMS.selectivity_threshold})
          AND yes >= {PARAMS.min_partition_size} AND total - yes >= {PARAMS.min_partition_size})
      SELECT path, first, {", ".join(f"lo_{a}, hi_{a}" for a in ATTRS)}, CAST(i AS BIGINT) AS split, CAST(a AS INTEGER) AS a, CAST(value AS INTEGER) AS v, 1 AS kind FROM chosen WHERE r = 1
      UNION ALL
      SELECT path || s.side, CAST(i + 1 AS INTEGER), {", ".join(f"CASE WHEN a = {d} AND s.side = '0' THEN greatest(lo_{n}, value) ELSE lo_{n} END, CASE WHEN a = {d} AND s.side = '1' THEN least(hi_{n}, value - 1) ELSE hi_{n} END" for d, n in enumerate(ATTRS))},
        NULL, NULL, NULL, 0 FROM chosen, (VALUES ('0'), ('1')) AS s(side) WHERE r = 1)
  ) SELECT * FROM nodes),
kept AS (SELECT path FROM (SELECT path, row_number() OVER (ORDER BY path) AS r FROM grown WHERE kind = 1) WHERE r < {PARAMS.max_num_partitions}),
leaves AS (SELECT 'part_' || (row_number() OVER (ORDER BY g.path) - 1) AS part, {", ".join(f"CAST(g.lo_{a} AS INTEGER) AS lo_{a}, CAST(g.hi_{a} AS INTEGER) AS hi_{a}" for a in ATTRS)}
  FROM grown g WHERE kind = 0 AND g.path NOT IN (SELECT path FROM kept) AND (g.path = '' OR left(g.path, length(g.path) - 1) IN (SELECT path FROM kept)))"""

TREE = tree_sql("items")
INSIDE = " AND ".join(f"{a} BETWEEN lo_{a} AND hi_{a}" for a in ATTRS)
LOWER = ", ".join(f"CASE WHEN lo_{a} > -2147483648 THEN '({a} >= ' || lo_{a} || ')' END" for a in ATTRS)
UPPER = ", ".join(f"CASE WHEN hi_{a} < 2147483647 THEN '(not({a} >= ' || (hi_{a} + 1) || '))' END" for a in ATTRS)
SIX_SQL = """CASE WHEN x >= 500 AND y >= 300 THEN 'part_0' WHEN x >= 500 THEN 'part_1' WHEN x >= 100 AND y >= 300 THEN 'part_2'
  WHEN x >= 100 THEN 'part_3' WHEN y >= 300 THEN 'part_4' ELSE 'part_5' END"""


# -- storage -------------------------------------------------------------------------------------


def write_read_roundtrip(spark, sf):
    path = shared_dir(spark)
    write_collection(base(spark, sf), path, ATTRS)
    rows = read_collection(spark, path)
    return rows.select("id", *ATTRS, F.posexplode("vector").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


def append_collection(spark, sf):
    """A second copy with shifted ids, appended to the first."""
    path, catalog = shared_dir(spark), _catalog(SIX_BOXES)
    write_collection(base(spark, sf), path, ATTRS, catalog)
    write_collection(base(spark, sf).withColumn("id", F.col("id") + 1_000_000_000), path, ATTRS, catalog, mode="append")
    return read_collection(spark, path).select("id", "part")


def ingest_partitioned(spark, sf):
    path = shared_dir(spark)
    tree = plan_layout(base(spark, sf), workload(spark, sf), ATTRS, PARAMS)
    write_collection(base(spark, sf), path, ATTRS, tree.catalog(), tree.route())
    written = read_collection(spark, path)
    agree = (F.col("part") == read_catalog(spark, path).route()).cast("int")
    return written.groupBy("part").agg(F.count("*").alias("n_rows"), F.min(agree).alias("agree"))


def compact_layout(spark, sf):
    source, target = shared_dir(spark), shared_dir(spark)
    write_collection(base(spark, sf), source, ATTRS, _catalog(SIX_BOXES))
    compact(spark, source, target, ("x", "y"))
    rows = read_collection(spark, target)
    return rows.groupBy("part").agg(F.count("*").alias("n_rows"), *[f(a).alias(f"{n}_{a}") for a in ("x", "y") for n, f in (("min", F.min), ("max", F.max))])


def partition_catalog(spark, sf):
    """Catalog of a stored collection with the rows its files hold."""
    path = shared_dir(spark)
    write_collection(base(spark, sf), path, ATTRS, _catalog(SIX_BOXES))
    catalog = read_catalog(spark, path).to_df(spark).select("pos", "part", "lo_x", "hi_x", "lo_y", "hi_y")
    return catalog.join(partition_sizes(read_collection(spark, path)), "part", "left").fillna(0, ["n_rows"])


QUERIES = {
    "range_partition": (
        range_partition,
        f"""WITH {ITEMS}, slices AS (SELECT CAST(round(i * 1000.0 / 7) AS INTEGER) AS lo, CAST(round(i * 1000.0 / 7 + 141) AS INTEGER) AS hi FROM range(0, 7) t(i))
SELECT coalesce(lo || '_' || hi, '__unmatched__') AS part, count(*) AS n_rows FROM items LEFT JOIN slices ON x BETWEEN lo AND hi GROUP BY 1""",
    ),
    "mod_partition": (mod_partitions, "SELECT 'mod_' || (l_orderkey % 5) AS part, count(*) AS n_rows FROM lineitem GROUP BY 1"),
    "explicit_partition": (
        explicit_partition,
        f"WITH {ITEMS} SELECT {SIX_SQL} AS part, count(*) AS n_rows, count(*) AS n_inside FROM items GROUP BY 1 UNION ALL SELECT '__unmatched__', 0, 0",
    ),
    "route_ranges": (
        route_ranges,
        f"""WITH {ITEMS} SELECT l_orderkey, l_linenumber, l_partkey, w, x, y, z, CASE WHEN x <= 399 AND z BETWEEN 0 AND 499 THEN 'low' WHEN x BETWEEN 200 AND 799 THEN 'wide'
WHEN w >= 500 AND x >= 700 AND y <= 299 THEN 'corner' WHEN x >= 900 AND y BETWEEN 300 AND 899 THEN 'high' ELSE '__unmatched__' END AS part FROM items""",
    ),
    "tree_cells": (
        tree_cells,
        f"""WITH {ITEMS}, {filters_sql("orders", "o_orderkey")}, {CHARACTERIZE}, cand AS (SELECT CASE attr WHEN 'w' THEN 0 WHEN 'x' THEN 1 WHEN 'y' THEN 2 ELSE 3 END AS a, value FROM atoms WHERE freq >= {PARAMS.min_predicate_frequency}),
b AS (SELECT {", ".join(f"CAST({_cut_sql(i)} AS INTEGER) AS b{i}" for i in range(4))} FROM items)
SELECT b0, b1, b2, b3, count(*) AS n FROM b GROUP BY ALL""",
    ),
    "tree_partitions": (
        tree_partitions,
        f"""WITH {TREE} SELECT part, concat_ws(' and ', {LOWER}, {UPPER}) AS path, count(*) AS n_rows
FROM leaves JOIN items ON {INSIDE} GROUP BY ALL""",
    ),
    "tree_ranges": (tree_ranges, f"WITH {TREE} SELECT * FROM leaves"),
    "route_tree": (route_tree, f"WITH {TREE} SELECT l_orderkey, l_linenumber, l_partkey, w, x, y, z, part, part AS looked_up FROM items JOIN leaves ON {INSIDE}"),
    "partition_coverage": (partition_coverage, f"WITH {TREE} SELECT part, count(*) AS n_rows, count(*) AS n_inside FROM items JOIN leaves ON {INSIDE} GROUP BY part"),
    "prune_partitions": (
        prune_partitions,
        f"""WITH {ITEMS}, {BOXES} SELECT part FROM boxes WHERE coalesce((CASE WHEN hi_y < 200 THEN false WHEN lo_y >= 200 THEN true END AND NOT CASE WHEN hi_y < 250 THEN false WHEN lo_y >= 250 THEN true END)
OR NOT CASE WHEN hi_x < 400 THEN false WHEN lo_x >= 400 THEN true END, true)""",
    ),
    "route_queries": (route_queries, f"WITH {TREE} SELECT qid, part FROM wide CROSS JOIN leaves WHERE coalesce({truth_sql()}, true)"),
    "write_read_roundtrip": (
        write_read_roundtrip,
        f"WITH {BASE} SELECT id, w, x, y, z, CAST(unnest(range(0, len(vector))) AS INTEGER) AS pos, CAST(unnest(vector) AS DOUBLE) AS v FROM base",
    ),
    "append_collection": (
        append_collection,
        f"WITH {BASE} SELECT id + s AS id, {SIX_SQL} AS part FROM base, (VALUES (0), (1000000000)) AS t(s)",
    ),
    "ingest_partitioned": (
        ingest_partitioned,
        f"WITH {BASE}, {tree_sql("base")} SELECT part, count(*) AS n_rows, 1 AS agree FROM base JOIN leaves ON {INSIDE} GROUP BY part",
    ),
    "compact_layout": (
        compact_layout,
        f"WITH {BASE} SELECT {SIX_SQL} AS part, count(*) AS n_rows, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM base GROUP BY 1",
    ),
    "partition_catalog": (
        partition_catalog,
        f"""WITH {BASE}, c(pos, part, lo_x, hi_x, lo_y, hi_y) AS (VALUES (0, 'part_0', 500, 2147483647, 300, 2147483647), (1, 'part_1', 500, 2147483647, -2147483648, 299), (2, 'part_2', 100, 499, 300, 2147483647),
(3, 'part_3', 100, 499, -2147483648, 299), (4, 'part_4', -2147483648, 99, 300, 2147483647), (5, 'part_5', -2147483648, 99, -2147483648, 299), (6, '__unmatched__', -2147483648, 2147483647, -2147483648, 2147483647)),
s AS (SELECT {SIX_SQL} AS part, count(*) AS n_rows FROM base GROUP BY 1)
SELECT pos, c.part, CAST(lo_x AS INTEGER) AS lo_x, CAST(hi_x AS INTEGER) AS hi_x, CAST(lo_y AS INTEGER) AS lo_y, CAST(hi_y AS INTEGER) AS hi_y, coalesce(n_rows, 0) AS n_rows FROM c LEFT JOIN s ON c.part = s.part""",
    ),
}
