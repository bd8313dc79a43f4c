"""Exact and approximate top-k search, ground truth and scores. Every embedding is a query against all of them."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from suite.partitions import PARAMS, tree_sql
from suite.tables import ATTRS, BASE, EXAMPLE, EXAMPLE_SQL, SIX_BOXES, base, filters_sql, holds_sql, table, truth_sql, vector_queries, workload
from vectile.functions.predicates import dnf_literal
from vectile.operators import cells
from vectile.operators.catalog import Catalog
from vectile.operators.evaluation import confusion_of_lists, recall
from vectile.operators.index import build_cells, build_hashes, label_centres
from vectile.operators.search import search
from vectile.operators.truth import as_lists, explode_truth, filtered_truth
from vectile.plans.pipelines import plan_layout, pruned_search, score
from vectile.session import materialise, shared_dir
from vectile.sources.collection import (
    read_catalog, read_collection, read_seed, search_collection, write_collection, write_seed,
)

K, STORED = 10, 40


def _plain_queries(spark, sf):
    return base(spark, sf).select(F.col("id").alias("qid"), "vector")


def _example_queries(spark, sf):
    return _plain_queries(spark, sf).withColumn("dnf", dnf_literal(EXAMPLE, ATTRS))


def _catalog():
    return Catalog.from_ranges(ATTRS, SIX_BOXES)


def _out(found):
    return found.select("qid", "id", "rank", F.round("dist", 6).alias("dist"))


def knn_exact(spark, sf):
    return _out(search(base(spark, sf), _plain_queries(spark, sf), K))


def knn_filtered(spark, sf):
    return _out(search(base(spark, sf), _example_queries(spark, sf), K, ATTRS))


def knn_pruned(spark, sf):
    """The flagship: rows routed to six partitions, each query reading those its filter may match."""
    catalog = _catalog()
    routed = base(spark, sf).withColumn("part", catalog.route())
    return _out(pruned_search(routed, _example_queries(spark, sf), K, catalog))


def knn_batch(spark, sf):
    """Every query with its own filter, over a stored collection of which only routed folders are read."""
    path = shared_dir(spark)
    write_collection(base(spark, sf), path, ATTRS, _catalog())
    return _out(pruned_search(read_collection(spark, path), vector_queries(spark, sf), K, read_catalog(spark, path)))


def knn_seeded(spark, sf):
    """The same search, with bounds from a stored sample of the collection."""
    path = shared_dir(spark)
    write_collection(base(spark, sf), path, ATTRS, _catalog())
    write_seed(spark, path, one_in=4)
    stored, seed = read_collection(spark, path), read_seed(spark, path)
    return _out(pruned_search(stored, vector_queries(spark, sf), K, read_catalog(spark, path), seed=seed))


def topk_limit(spark, sf):
    """The 100 rows nearest to the mean vector of the table, filtered and pruned."""
    path = shared_dir(spark)
    write_collection(base(spark, sf), path, ATTRS, _catalog())
    entries = base(spark, sf).select(F.posexplode("vector").alias("pos", "v"))
    mean = [r.m for r in entries.groupBy("pos").agg(F.avg("v").alias("m")).orderBy("pos").collect()]  # one row per dimension
    return search_collection(spark, path, mean, 100, EXAMPLE).select("id", F.round("dist", 6).alias("dist"))


CELLS_READ, PRUNED_CELLS_READ = 8, 5


def _labelled(spark, sf):
    rows = table(spark, sf, "embeddings")
    return base(spark, sf).join(rows.select(F.col("vec_id").alias("id"), "label"), "id")


def _cell_index(spark, sf, catalog=None):
    """The stored inverted file with the mean vector of each label as a centre, which SQL can compute too."""
    rows = _labelled(spark, sf)
    return build_cells(rows, shared_dir(spark), ATTRS, label_centres(rows, "label"), catalog, k=K)


def ivf_build(spark, sf):
    """What the folders of the stored index hold, by partition and cell."""
    return _cell_index(spark, sf, _catalog()).directory()


def knn_ivf(spark, sf):
    """Cells without a stored index: the base is assigned and searched in one go."""
    rows = _labelled(spark, sf)
    centres = np.array([r.vector for r in label_centres(rows, "label").orderBy("cell").collect()])  # a row per label
    stored, asked = (cells.with_nearest_cells(df, centres, n) for df, n in ((base(spark, sf), 1), (vector_queries(spark, sf), CELLS_READ)))
    return _out(cells.search_cells(stored, asked, K, ATTRS))


def knn_ivf_stored(spark, sf):
    """Every query reads the nearest cells of the stored index; filters apply to what is read."""
    return _out(_cell_index(spark, sf).search(vector_queries(spark, sf), K, CELLS_READ))


def knn_ivf_pruned(spark, sf):
    """Cells are ranked inside the partitions that the query's filter may match, and only those pairs are read."""
    return _out(_cell_index(spark, sf, _catalog()).search(vector_queries(spark, sf), K, PRUNED_CELLS_READ))


def knn_ivf_all_cells(spark, sf):
    """Reading every cell makes the inverted file exact."""
    return _out(cells.knn_ivf(base(spark, sf), vector_queries(spark, sf), K, ATTRS, n_cells=8, n_probe=8))


LSH_TABLES, LSH_BITS, LSH_SEED = 20, 4, 584


def knn_lsh(spark, sf):
    """Twenty stored hash tables; every query reads one code of each."""
    rows = base(spark, sf)
    dim = rows.select(F.size("vector").alias("d")).first()["d"]
    index = build_hashes(rows, shared_dir(spark), dim, ATTRS, LSH_TABLES, LSH_BITS, LSH_SEED)
    return _out(index.search(vector_queries(spark, sf), K))


def ivf_recall(spark, sf):
    """Recall of the stored inverted file against the exact filtered search, per query."""
    queries = vector_queries(spark, sf)
    exact = search(base(spark, sf), queries, K, ATTRS)
    scored = score(exact, _cell_index(spark, sf).search(queries, K, CELLS_READ), queries)
    return scored.select("qid", "tp", "fp", "fn", F.round("recall", 9).alias("recall"))


def _stored_truth(spark, sf):
    """Unfiltered neighbour lists, as datasets ship them."""
    found = search(base(spark, sf), _plain_queries(spark, sf), STORED)
    return as_lists(found.select("qid", F.col("rank").alias("pos"), "id"))


def truth_explode(spark, sf):
    return explode_truth(_stored_truth(spark, sf))


def truth_filtered(spark, sf):
    return filtered_truth(_stored_truth(spark, sf), base(spark, sf), vector_queries(spark, sf), ATTRS)


def truth_exact_filtered(spark, sf):
    return search(base(spark, sf), vector_queries(spark, sf), STORED, ATTRS).select("qid", "id", "rank")


def _scored(spark, sf):
    """The reference form of scoring: filtered stored truth against the k results of the filtered search."""
    queries = vector_queries(spark, sf)
    truth = filtered_truth(materialise(_stored_truth(spark, sf)), base(spark, sf), queries, ATTRS)
    return score(truth, search(base(spark, sf), queries, K, ATTRS), queries)


def confusion(spark, sf):
    return _scored(spark, sf).select("qid", "tp", "fp", "fn")


def recall_per_query(spark, sf):
    return _scored(spark, sf).select("qid", F.round("recall", 9).alias("recall"))


def tree_search_scored(spark, sf):
    """The whole way: a tree grown for the orders' filters, rows written by it, every query pruned, searched and scored."""
    rows, queries, path = base(spark, sf), vector_queries(spark, sf), shared_dir(spark)
    tree = plan_layout(rows, workload(spark, sf), ATTRS, PARAMS)
    write_collection(rows, path, ATTRS, tree.catalog(), tree.route())
    catalog = read_catalog(spark, path)
    found = pruned_search(read_collection(spark, path), queries, K, catalog)
    truth = filtered_truth(materialise(_stored_truth(spark, sf)), rows, queries, ATTRS)
    read = catalog.routes(queries.select("qid", "dnf")).groupBy("qid").agg(F.count("*").alias("n_read"))
    scored = score(truth, found, queries).join(read, "qid", "left").fillna(0, ["n_read"])
    return scored.select("qid", "tp", "fp", "fn", F.round("recall", 9).alias("recall"), "n_read")


def confusion_lists(spark, sf):
    """The list form: stored neighbours against the exact filtered result, both on one row."""
    found = truth_exact_filtered(spark, sf).select("qid", F.col("rank").alias("pos"), "id")
    lists = _stored_truth(spark, sf).join(as_lists(found).withColumnRenamed("neighbours", "found"), "qid", "left")
    lists = lists.withColumn("found", F.coalesce("found", F.array().cast("array<bigint>")))
    counted = confusion_of_lists(lists, "neighbours", "found")
    return counted.select("qid", "tp", "fp", "fn", F.round(recall(F.col("tp"), F.col("fn")), 9).alias("recall"))


DIFF = "(CAST(b.vector[i] AS DOUBLE) - CAST(q.vector[i] AS DOUBLE))"
DIST = f"list_sum(list_transform(range(1, len(b.vector) + 1), lambda i: {DIFF} * {DIFF}))"


def ranked_sql(name: str, condition: str, k: int, joins: str = "") -> str:
    """CTE with the k nearest base rows of every query that meet the condition."""
    return f"""{name} AS (SELECT qid, id, CAST(r AS INTEGER) AS rank, dist FROM (
  SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS r FROM (
    SELECT q.id AS qid, b.id AS id, {DIST} AS dist FROM base q CROSS JOIN base b {joins} WHERE {condition})) WHERE r <= {k})"""


OWN = filters_sql("embeddings", "vec_id")
OWN_JOIN = "JOIN wide ON wide.qid = q.id"


def _b(sql: str) -> str:
    """Attributes of the base side."""
    for a in ATTRS:
        sql = sql.replace(f"THEN {a} ", f"THEN b.{a} ").replace(f"ELSE {a} ", f"ELSE b.{a} ").replace(f"({a} ", f"(b.{a} ").replace(f" {a} >=", f" b.{a} >=")
    return sql


HOLDS, EXAMPLE_B = _b(holds_sql()), _b(EXAMPLE_SQL)
FULL = "SELECT qid, id, rank, round(dist, 6) AS dist FROM found"
SCORED = f"""WITH {BASE}, {OWN}, {ranked_sql("stored", "true", STORED)}, {ranked_sql("found", HOLDS, K, OWN_JOIN)},
truth AS (SELECT s.qid, s.id FROM stored s JOIN base b ON b.id = s.id JOIN wide ON wide.qid = s.qid WHERE {HOLDS}),
counts AS (SELECT k.qid, (SELECT count(*) FROM truth t JOIN found f ON f.qid = t.qid AND f.id = t.id WHERE t.qid = k.qid) AS tp,
  (SELECT count(*) FROM truth t WHERE t.qid = k.qid) AS nt, (SELECT count(*) FROM found f WHERE f.qid = k.qid) AS nf FROM keyed k)"""


def _lsh_sql() -> str:
    planes = cells.hyperplanes(64, LSH_TABLES * LSH_BITS, LSH_SEED)
    literal = ", ".join(f"({j}, [{', '.join(repr(float(x)) for x in p)}]::DOUBLE[])" for j, p in enumerate(planes))
    return f"""WITH {BASE}, {OWN}, planes(j, plane) AS (VALUES {literal}),
sides AS (SELECT id, j // {LSH_BITS} AS tbl, j % {LSH_BITS} AS bit, list_dot_product(CAST(vector AS DOUBLE[]), plane) >= 0 AS up FROM base, planes),
codes AS (SELECT id, tbl, sum(CASE WHEN up THEN 1 << bit ELSE 0 END) AS code FROM sides GROUP BY id, tbl),
met AS (SELECT DISTINCT p.id AS a, c.id AS b FROM codes p JOIN codes c ON p.tbl = c.tbl AND p.code = c.code),
{ranked_sql("found", HOLDS, K, OWN_JOIN + " JOIN met ON met.a = q.id AND met.b = b.id")}
{FULL}"""


# Every row's cells, nearest first: by the distance to the mean vector of each label.
CELLS_SQL = f"""means AS (SELECT label, pos, avg(v) AS v FROM (SELECT label, unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE label IS NOT NULL)
  GROUP BY label, pos),
centres AS (SELECT row_number() OVER (ORDER BY label) - 1 AS cell, list(v ORDER BY pos) AS c FROM means GROUP BY label),
near AS (SELECT id, cell, row_number() OVER (PARTITION BY id ORDER BY list_dot_product(c, c) - 2 * list_dot_product(CAST(vector AS DOUBLE[]), c), cell) AS r FROM base, centres),
own AS (SELECT id, cell FROM near WHERE r = 1)"""
IN_CELLS = "own ON own.id = b.id JOIN near ON near.id = q.id AND near.cell = own.cell"
PLACES = ", ".join(f"({i}, '{name}', " + ", ".join(str(v) for a in ATTRS for v in (-(2**31) if box.get(a, (None, None))[0] is None else box[a][0], 2**31 - 1 if box.get(a, (None, None))[1] is None else box[a][1])) + ")" for i, (name, box) in enumerate(SIX_BOXES.items()))
BOXES_SQL = f"""boxes(pos, part, {", ".join(f"lo_{a}, hi_{a}" for a in ATTRS)}) AS (VALUES {PLACES}, (6, '__unmatched__', {", ".join("-2147483648, 2147483647" for _ in ATTRS)})),
placed AS (SELECT id, pos AS part FROM base JOIN boxes ON {" AND ".join(f"{a} BETWEEN lo_{a} AND hi_{a}" for a in ATTRS)} WHERE pos < 6)"""
# What a query may read, and the cells that hold rows there, ranked anew.
PRUNED_SQL = f"""{BOXES_SQL},
may AS (SELECT qid, pos AS part FROM wide CROSS JOIN boxes WHERE coalesce({truth_sql()}, true)),
filled AS (SELECT DISTINCT part, cell FROM placed JOIN own USING (id)),
open_cells AS (SELECT DISTINCT qid, cell FROM may JOIN filled USING (part)),
chosen AS (SELECT qid, cell FROM (SELECT o.qid, o.cell, row_number() OVER (PARTITION BY o.qid ORDER BY n.r) AS r FROM open_cells o JOIN near n ON n.id = o.qid AND n.cell = o.cell) WHERE r <= {PRUNED_CELLS_READ})"""


QUERIES = {
    "knn_exact": (knn_exact, f"WITH {BASE}, {ranked_sql('found', 'true', K)} {FULL}"),
    "knn_filtered": (knn_filtered, f"WITH {BASE}, {ranked_sql('found', EXAMPLE_B, K)} {FULL}"),
    "knn_pruned": (knn_pruned, f"WITH {BASE}, {ranked_sql('found', EXAMPLE_B, K)} {FULL}"),
    "knn_batch": (knn_batch, f"WITH {BASE}, {OWN}, {ranked_sql('found', HOLDS, K, OWN_JOIN)} {FULL}"),
    "knn_seeded": (knn_seeded, f"WITH {BASE}, {OWN}, {ranked_sql('found', HOLDS, K, OWN_JOIN)} {FULL}"),
    "topk_limit": (
        topk_limit,
        f"""WITH {BASE}, mean AS (SELECT list(m ORDER BY pos) AS vector FROM (SELECT pos, avg(CAST(v AS DOUBLE)) AS m FROM
  (SELECT unnest(range(0, len(vector))) AS pos, unnest(vector) AS v FROM base) GROUP BY pos))
SELECT id, round({DIST}, 6) AS dist FROM base b CROSS JOIN mean q WHERE {EXAMPLE_B} ORDER BY {DIST}, id LIMIT 100""",
    ),
    "ivf_build": (
        ivf_build,
        f"WITH {BASE}, {CELLS_SQL}, {BOXES_SQL} SELECT CAST(part AS INTEGER) AS part, CAST(cell AS INTEGER) AS cell, count(*) AS n_rows FROM own JOIN placed USING (id) GROUP BY ALL",
    ),
    "knn_ivf": (knn_ivf, f"WITH {BASE}, {OWN}, {CELLS_SQL}, {ranked_sql('found', f'near.r <= {CELLS_READ} AND {HOLDS}', K, f'{OWN_JOIN} JOIN {IN_CELLS}')} {FULL}"),
    "knn_ivf_stored": (knn_ivf_stored, f"WITH {BASE}, {OWN}, {CELLS_SQL}, {ranked_sql('found', f'near.r <= {CELLS_READ} AND {HOLDS}', K, f'{OWN_JOIN} JOIN {IN_CELLS}')} {FULL}"),
    "knn_ivf_pruned": (
        knn_ivf_pruned,
        f"""WITH {BASE}, {OWN}, {CELLS_SQL}, {PRUNED_SQL},
{ranked_sql("found", HOLDS, K, f"{OWN_JOIN} JOIN own ON own.id = b.id JOIN placed ON placed.id = b.id JOIN may ON may.qid = q.id AND may.part = placed.part JOIN chosen ON chosen.qid = q.id AND chosen.cell = own.cell")}
{FULL}""",
    ),
    "knn_ivf_all_cells": (knn_ivf_all_cells, f"WITH {BASE}, {OWN}, {ranked_sql('found', HOLDS, K, OWN_JOIN)} {FULL}"),
    "knn_lsh": (knn_lsh, _lsh_sql()),
    "ivf_recall": (
        ivf_recall,
        f"""WITH {BASE}, {OWN}, {CELLS_SQL}, {ranked_sql("exact", HOLDS, K, OWN_JOIN)},
{ranked_sql("found", f"near.r <= {CELLS_READ} AND {HOLDS}", K, f"{OWN_JOIN} JOIN {IN_CELLS}")},
counts AS (SELECT k.qid, count(e.id) AS nt, count(f.id) FILTER (e.id IS NOT NULL) AS tp, (SELECT count(*) FROM found f WHERE f.qid = k.qid) AS nf
  FROM keyed k LEFT JOIN exact e ON e.qid = k.qid LEFT JOIN found f ON f.qid = e.qid AND f.id = e.id GROUP BY k.qid)
SELECT qid, tp, nf - tp AS fp, nt - tp AS fn, CASE WHEN nt > 0 THEN round(tp / nt, 9) ELSE 0.0 END AS recall FROM counts""",
    ),
    "truth_explode": (truth_explode, f"WITH {BASE}, {ranked_sql('stored', 'true', STORED)} SELECT qid, CAST(rank - 1 AS INTEGER) AS pos, id FROM stored"),
    "truth_filtered": (
        truth_filtered,
        f"""WITH {BASE}, {OWN}, {ranked_sql("stored", "true", STORED)}
SELECT s.qid, CAST(s.rank - 1 AS INTEGER) AS pos, s.id FROM stored s JOIN base b ON b.id = s.id JOIN wide ON wide.qid = s.qid WHERE {HOLDS}""",
    ),
    "truth_exact_filtered": (truth_exact_filtered, f"WITH {BASE}, {OWN}, {ranked_sql('found', HOLDS, STORED, OWN_JOIN)} SELECT qid, id, rank FROM found"),
    "confusion": (confusion, f"{SCORED} SELECT qid, tp, nf - tp AS fp, nt - tp AS fn FROM counts"),
    "recall": (recall_per_query, f"{SCORED} SELECT qid, CASE WHEN nt > 0 THEN round(tp / nt, 9) ELSE 0.0 END AS recall FROM counts"),
    "tree_search_scored": (
        tree_search_scored,
        f"""{re.sub(r"\b(keyed|lits|wide)\b", r"own_\1", SCORED)}, {tree_sql("base")}
SELECT qid, tp, nf - tp AS fp, nt - tp AS fn, CASE WHEN nt > 0 THEN round(tp / nt, 9) ELSE 0.0 END AS recall,
  (SELECT count(*) FROM own_wide w CROSS JOIN leaves WHERE w.qid = counts.qid AND coalesce({truth_sql()}, true)) AS n_read FROM counts""",
    ),
    "confusion_lists": (
        confusion_lists,
        f"""WITH {BASE}, {OWN}, {ranked_sql("stored", "true", STORED)}, {ranked_sql("found", HOLDS, STORED, OWN_JOIN)},
both_sides AS (SELECT k.qid, count(f.id) AS nf, count(s.id) AS tp FROM (SELECT DISTINCT qid FROM stored) k LEFT JOIN found f ON f.qid = k.qid
  LEFT JOIN stored s ON s.qid = f.qid AND s.id = f.id GROUP BY k.qid)
SELECT qid, tp, nf - tp AS fp, {STORED} - tp AS fn, round(tp / {STORED}, 9) AS recall FROM both_sides""",
    ),
}
