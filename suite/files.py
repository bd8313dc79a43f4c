"""Vector files, datasets and workload files, all written by Spark from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.searches import DIST, K, STORED, _stored_truth, ranked_sql
from suite.tables import ATTRS, BASE, base
from vectile.functions.predicates import dnf_text
from vectile.operators.search import search
from vectile.operators.truth import explode_truth
from vectile.plans.pipelines import score
from vectile.session import materialise, shared_dir
from vectile.sources.datasets import FILES, describe, load_dataset
from vectile.sources.experiments import read_workload
from vectile.sources.vecs import read_vecs, write_vecs


def _ordered(df):
    """Rows in id order over the tasks, so that a row's position in the files is its id."""
    return df.repartitionByRange("id").sortWithinPartitions("id")


def _entries(df):
    return df.select("id", F.posexplode("vector").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


def _scan(kind, element, limit=None):
    def run(spark, sf):
        path = shared_dir(spark)
        vectors = base(spark, sf).select("id", F.transform("vector", element).alias("vector"))
        write_vecs(_ordered(vectors), path, kind)
        return _entries(read_vecs(spark, path, kind, limit, bytesPerPartition=1 << 16))

    return run


AS_INT = lambda v: F.floor(v.cast("double") * 1000).cast("int")
AS_BYTE = lambda v: F.floor((v.cast("double") + 1) * 100).cast("int")


def _scan_sql(element: str, where: str = "true") -> str:
    return f"""WITH e AS (SELECT vec_id AS id, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS pos, unnest(embedding) AS v FROM embeddings WHERE {where})
SELECT id, pos, CAST({element} AS DOUBLE) AS value FROM e"""


LIMIT = 250


def _dataset(spark, sf):
    directory = shared_dir(spark)
    base_file, query_file, truth_file = FILES["small"]
    rows = _ordered(base(spark, sf).select("id", "vector"))
    write_vecs(rows, f"{directory}/{base_file}", "fvecs")
    write_vecs(rows, f"{directory}/{query_file}", "fvecs")
    truth = _stored_truth(spark, sf).select(F.col("qid").alias("id"), F.col("neighbours").alias("vector"))
    write_vecs(_ordered(truth), f"{directory}/{truth_file}", "ivecs")
    return load_dataset(spark, directory, "small")


def load_vectors(spark, sf):
    """Search over a dataset read from vector files: base and query vectors, and hits among the stored neighbours."""
    data = _dataset(spark, sf)
    found = search(data.base, data.queries, K)
    stored = explode_truth(data.truth)
    return found.join(stored, ["qid", "id"]).select("qid", "id", "rank", "pos", F.round("dist", 6).alias("dist"))


def dataset_stats(spark, sf):
    return describe(base(spark, sf))


def _workload_file(spark, sf):
    """Two range conditions per embedding as JSON lines, in id order, among lines and conditions that have to be skipped."""
    path = shared_dir(spark)
    rng = lambda a, width: F.create_map(F.lit("range"), F.struct(F.col(a).alias("gt"), (F.col(a) + width).alias("lt")))
    other = F.create_map(F.lit("match"), F.struct(F.col("y").alias("gt"), F.col("y").alias("lt")))
    entry = F.struct(
        F.col("vector").alias("query"),
        F.struct(F.array(F.create_map(F.lit("w"), rng("w", 100), F.lit("y"), other, F.lit("x"), rng("x", 200))).alias("and")).alias("conditions"),
        F.array("id", F.col("id") + 1).alias("closest_ids"),
        F.array(F.lit(0.5), F.lit(0.25)).alias("closest_scores"),
    )
    good = F.to_json(entry)
    lines = _ordered(base(spark, sf)).select(F.explode(F.array(good, F.substring(good, 1, 40), F.to_json(F.struct("id")))).alias("value"))
    lines.write.text(path)
    return path


def workload_jsonl(spark, sf):
    entries = read_workload(spark, _workload_file(spark, sf), ATTRS)
    return entries.select(
        "line", "qid", "attr", "lower", "upper", dnf_text(F.col("dnf"), ATTRS).alias("text"), F.size("query").alias("dim"),
        F.get("closest_ids", F.lit(0)).alias("first_id"), F.get("closest_scores", F.lit(1)).cast("double").alias("second_score"),
    )


def workload_jsonl_search(spark, sf):
    """The first 600 lines of the file as runnable queries, scored against the neighbours they list."""
    entries = materialise(read_workload(spark, _workload_file(spark, sf), ATTRS, n=600))
    queries = entries.select("qid", F.col("query").alias("vector"), "dnf")
    truth = explode_truth(entries.select("qid", F.col("closest_ids").alias("neighbours")))
    scored = score(truth, search(base(spark, sf), queries, K, ATTRS), queries)
    return scored.select("qid", "tp", "fp", "fn", F.round("recall", 9).alias("recall"))


QUERIES = {
    "scan_ivecs": (_scan("ivecs", AS_INT), _scan_sql("floor(CAST(v AS DOUBLE) * 1000)")),
    "scan_fvecs": (_scan("fvecs", lambda v: v), _scan_sql("v")),
    "scan_bvecs": (_scan("bvecs", AS_BYTE), _scan_sql("floor((CAST(v AS DOUBLE) + 1) * 100)")),
    "scan_bvecs_limit": (_scan("bvecs", AS_BYTE, LIMIT), _scan_sql("floor((CAST(v AS DOUBLE) + 1) * 100)", f"vec_id < {LIMIT}")),
    "load_vectors": (
        load_vectors,
        f"""WITH {BASE}, {ranked_sql("stored", "true", STORED)} SELECT qid, id, rank, CAST(rank - 1 AS INTEGER) AS pos, round(dist, 6) AS dist FROM stored WHERE rank <= {K}""",
    ),
    "dataset_stats": (dataset_stats, "SELECT count(*) AS n_vectors, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM embeddings"),
    "workload_jsonl": (
        workload_jsonl,
        f"""WITH {BASE}, places AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM base)
SELECT 3 * place AS line, 3 * place * 65536 + pos AS qid, a AS attr, CAST(g + 1 AS INTEGER) AS lower, CAST(g + width AS INTEGER) AS upper, '(' || a || ' >= ' || (g + 1) || ') and (not(' || a || ' >= ' || (g + width) || '))' AS text,
CAST(len(vector) AS INTEGER) AS dim, id AS first_id, CAST(0.25 AS DOUBLE) AS second_score
FROM (SELECT 'w' AS a, 0 AS pos, w AS g, 100 AS width, id, vector FROM base UNION ALL SELECT 'x', 2, x, 200, id, vector FROM base) JOIN places USING (id)""",
    ),
    "workload_jsonl_search": (
        workload_jsonl_search,
        f"""WITH {BASE}, places AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM base),
asked AS (SELECT 3 * place * 65536 + pos AS qid, id, a, g + 1 AS lower, g + width AS upper FROM
  (SELECT 'w' AS a, 0 AS pos, w AS g, 100 AS width, id FROM base UNION ALL SELECT 'x', 2, x, 200, id FROM base) JOIN places USING (id) WHERE 3 * place < 600),
found AS (SELECT qid, id FROM (SELECT s.qid, b.id, row_number() OVER (PARTITION BY s.qid ORDER BY {DIST}, b.id) AS r
  FROM asked s JOIN base q ON q.id = s.id JOIN base b ON CASE s.a WHEN 'w' THEN b.w ELSE b.x END >= s.lower AND CASE s.a WHEN 'w' THEN b.w ELSE b.x END < s.upper) WHERE r <= {K}),
listed AS (SELECT qid, id FROM asked UNION ALL SELECT qid, id + 1 FROM asked),
counts AS (SELECT s.qid, (SELECT count(*) FROM listed l JOIN found f ON f.qid = l.qid AND f.id = l.id WHERE l.qid = s.qid) AS tp,
  (SELECT count(*) FROM found f WHERE f.qid = s.qid) AS nf FROM asked s)
SELECT qid, tp, nf - tp AS fp, 2 - tp AS fn, round(tp / 2, 9) AS recall FROM counts""",
    ),
}
