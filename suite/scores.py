"""Statistics over run tables, grids and configuration lookup. Every event is one executed search."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.tables import RUNS, rounded, runs, table
from vectile.operators import evaluation as ev
from vectile.operators import grid as gr
from vectile.session import shared_dir
from vectile.sources.experiments import read_configs, read_run_arrays, read_runs, write_configs, write_runs

SCHEMA = ["index", "partitioner", "n_partitions"]
WORKFLOW = ["filter_percentage", "selectivity"]
SCHEMA_SQL = '"index", partitioner, n_partitions'
RECALL = "(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END)"
Q = lambda p: f"quantile_cont(search_time, {p})"


def time_stats(spark, sf):
    return rounded(ev.time_stats(runs(spark, sf), [*SCHEMA, "trial"]), mean=6, median=6, max=6, min=6, std=6)


def time_stats_overall(spark, sf):
    return rounded(ev.time_stats(runs(spark, sf), []), mean=6, median=6, max=6, min=6, std=6)


PERCENTS = (99.9, 99.0, 50.0, 1.0, 0.1)


def time_percentiles(spark, sf):
    return rounded(ev.time_percentiles(runs(spark, sf), SCHEMA, PERCENTS), value=6)


def mean_over_trials(spark, sf):
    return rounded(ev.mean_over_trials(runs(spark, sf), SCHEMA), mean_time=6, mean_recall=9, tail_time=6)


def recall_by_selectivity(spark, sf):
    return rounded(ev.recall_stats(runs(spark, sf), ["n_partitions", "selectivity"]), mean_recall=9, std_recall=9)


def recall_by_config(spark, sf):
    return rounded(ev.recall_stats(runs(spark, sf), [*SCHEMA, *WORKFLOW]), mean_recall=9, std_recall=9)


def qualifying_points(spark, sf):
    return rounded(ev.qualifying_points(runs(spark, sf)), recall=9)


SELECTIVITIES = (0.01, 0.1, 0.5, 0.9)


def heatmap_pivot(spark, sf):
    cells = ev.heatmap(runs(spark, sf), "filter_percentage", "selectivity", SELECTIVITIES, 99.9, SCHEMA)
    return cells.select(*SCHEMA, "filter_percentage", *[F.round(F.col(f"`{s}`"), 6).alias(f"s_{str(s)[2:]}") for s in SELECTIVITIES])


def time_by_filter(spark, sf):
    return rounded(ev.time_by_filter(runs(spark, sf), SCHEMA), mean_filtered=6, mean_unfiltered=6)


def time_histogram(spark, sf):
    return rounded(ev.time_histogram(runs(spark, sf), 49), lo=6, hi=6)


def time_histogram_linear(spark, sf):
    return rounded(ev.time_histogram(runs(spark, sf), 30, log=False, keys=["index"]), lo=6, hi=6)


def time_histogram_density(spark, sf):
    return rounded(ev.histogram_density(runs(spark, sf), 49), density=9)


def box_summary(spark, sf):
    return rounded(ev.box_summary(runs(spark, sf), ["filter_used"]), q1=6, median=6, q3=6, whisker_low=6, whisker_high=6)


def distinct_sorted(spark, sf):
    return ev.distinct_sorted(runs(spark, sf), "n_partitions", F.col("index") == "IVF_FLAT")


GRID = ["l_returnflag", "l_linestatus", "l_linenumber"]


def param_grid(spark, sf):
    """Grid over the values that three columns take, with one scalar parameter."""
    lists = gr.collect_lists(table(spark, sf, "lineitem"), GRID).withColumn("k", F.lit(1000))
    return gr.expand_grid(lists, [*GRID, "k"])


def _configs(spark, sf):
    """The configurations of the runs, written and read back as rows."""
    path = shared_dir(spark)
    grid = gr.expand_grid(gr.collect_lists(runs(spark, sf), SCHEMA), SCHEMA)
    write_configs(grid, path, SCHEMA)
    return read_configs(spark, path, "index string, partitioner string, n_partitions int")


def config_lookup(spark, sf):
    return gr.lookup(runs(spark, sf), _configs(spark, sf), SCHEMA).groupBy("config_id", *SCHEMA).agg(F.count("*").alias("n"))


def config_missing(spark, sf):
    """Configurations that the runs use and a grid without HNSW lacks."""
    configs = _configs(spark, sf).filter("index <> 'HNSW'")
    return gr.missing(runs(spark, sf), configs, SCHEMA)


def _run_ids(df):
    return df.withColumns(
        {
            "schema_id": (F.col("n_partitions") % 7).cast("int"),
            "workflow_id": F.floor(F.col("filter_percentage") * 10).cast("int"),
        }
    )


def result_roundtrip(spark, sf):
    """Rows per query, written as JSON folders per run and read back."""
    path = shared_dir(spark)
    columns = ["qid", "search_time", "filter_used", "tp", "fp", "fn", "trial", "schema_id", "workflow_id"]
    write_runs(_run_ids(runs(spark, sf)).select(*columns), path)
    return read_runs(spark, path, "qid bigint, search_time double, filter_used boolean, tp int, fp int, fn int")


def results_explode(spark, sf):
    """Result files with parallel arrays, 500 queries per file, unnested to one row per query."""
    path = shared_dir(spark)
    ordered = lambda c, t: F.transform(F.array_sort(F.collect_list(F.struct("qid", c))), lambda r: r[c].cast(t))
    rows = _run_ids(runs(spark, sf)).withColumn("ns", (F.col("search_time") * 100).cast("bigint"))
    names = {"search_times": ("ns", "bigint"), "filter_used": ("filter_used", "boolean"), "tp": ("tp", "int"), "fp": ("fp", "int"), "fn": ("fn", "int")}
    files = rows.groupBy("trial", "schema_id", "workflow_id", F.floor(F.col("qid") / 500).alias("chunk")).agg(
        *[ordered(c, t).alias(n) for n, (c, t) in names.items()]
    )
    files.write.partitionBy("trial", "schema_id", "workflow_id").json(path)
    return read_run_arrays(spark, path, multi_line=False).drop("pos")


DENSITY = f"""ends AS (SELECT min(log10(search_time)) AS a, max(log10(search_time)) AS z FROM runs),
binned AS (SELECT r.*, CAST(least(floor((log10(search_time) - a) * 49 / (z - a)), 48) AS INTEGER) AS bin, a, z FROM runs r, ends)"""

QUERIES = {
    "time_stats": (
        time_stats,
        f"""WITH {RUNS} SELECT {SCHEMA_SQL}, trial, round(avg(search_time), 6) AS mean, round(median(search_time), 6) AS median, max(search_time) AS max,
min(search_time) AS min, round(stddev_pop(search_time), 6) AS std FROM runs GROUP BY ALL""",
    ),
    "time_stats_overall": (
        time_stats_overall,
        f"""WITH {RUNS} SELECT round(avg(search_time), 6) AS mean, round(median(search_time), 6) AS median, max(search_time) AS max,
min(search_time) AS min, round(stddev_pop(search_time), 6) AS std FROM runs""",
    ),
    "time_percentiles": (
        time_percentiles,
        f"WITH {RUNS} " + " UNION ALL ".join(f"SELECT {SCHEMA_SQL}, CAST({p} AS DOUBLE) AS percent, round({Q(p / 100)}, 6) AS value FROM runs GROUP BY ALL" for p in PERCENTS),
    ),
    "mean_over_trials": (
        mean_over_trials,
        f"""WITH {RUNS}, t AS (SELECT {SCHEMA_SQL}, trial, avg(search_time) AS t, avg({RECALL}) AS r, {Q(0.99)} AS p FROM runs GROUP BY ALL)
SELECT {SCHEMA_SQL}, round(avg(t), 6) AS mean_time, round(avg(r), 9) AS mean_recall, round(avg(p), 6) AS tail_time FROM t GROUP BY ALL""",
    ),
    "recall_by_selectivity": (
        recall_by_selectivity,
        f"""WITH {RUNS} SELECT n_partitions, selectivity, count(*) AS n, round(avg({RECALL}), 9) AS mean_recall, round(stddev_pop({RECALL}), 9) AS std_recall,
count(*) FILTER (WHERE tp + fn = 0) AS no_truth FROM runs WHERE filter_used GROUP BY ALL""",
    ),
    "recall_by_config": (
        recall_by_config,
        f"""WITH {RUNS} SELECT {SCHEMA_SQL}, filter_percentage, selectivity, count(*) AS n, round(avg({RECALL}), 9) AS mean_recall, round(stddev_pop({RECALL}), 9) AS std_recall,
count(*) FILTER (WHERE tp + fn = 0) AS no_truth FROM runs WHERE filter_used GROUP BY ALL""",
    ),
    "qualifying_points": (qualifying_points, f"WITH {RUNS} SELECT qid, round(CAST({RECALL} AS DOUBLE), 9) AS recall FROM runs WHERE filter_used"),
    "heatmap_pivot": (
        heatmap_pivot,
        f"""WITH {RUNS}, t AS (SELECT {SCHEMA_SQL}, filter_percentage, selectivity, trial, {Q(0.999)} AS p FROM runs GROUP BY ALL)
SELECT {SCHEMA_SQL}, filter_percentage, {", ".join(f"round(avg(p) FILTER (WHERE selectivity = {s}), 6) AS s_{str(s)[2:]}" for s in SELECTIVITIES)} FROM t GROUP BY ALL""",
    ),
    "time_by_filter": (
        time_by_filter,
        f"""WITH {RUNS} SELECT {SCHEMA_SQL}, count(*) FILTER (WHERE filter_used) AS n_filtered, count(*) FILTER (WHERE NOT filter_used) AS n_unfiltered,
round(avg(search_time) FILTER (WHERE filter_used), 6) AS mean_filtered, round(avg(search_time) FILTER (WHERE NOT filter_used), 6) AS mean_unfiltered FROM runs GROUP BY ALL""",
    ),
    "time_histogram": (
        time_histogram,
        f"WITH {RUNS}, {DENSITY} SELECT bin, count(*) AS n, round(pow(10, a + bin * (z - a) / 49), 6) AS lo, round(pow(10, a + (bin + 1) * (z - a) / 49), 6) AS hi FROM binned GROUP BY bin, a, z "
        "UNION ALL SELECT -1, count(*), NULL, 0.0 FROM runs WHERE search_time <= 0 HAVING count(*) > 0",
    ),
    "time_histogram_linear": (
        time_histogram_linear,
        f"""WITH {RUNS}, ends AS (SELECT min(search_time) AS a, max(search_time) AS z FROM runs)
SELECT "index", CAST(least(floor((search_time - a) * 30 / (z - a)), 29) AS INTEGER) AS bin, count(*) AS n, round(a + least(floor((search_time - a) * 30 / (z - a)), 29) * (z - a) / 30, 6) AS lo,
round(a + (least(floor((search_time - a) * 30 / (z - a)), 29) + 1) * (z - a) / 30, 6) AS hi FROM runs, ends GROUP BY ALL""",
    ),
    "time_histogram_density": (
        time_histogram_density,
        f"""WITH {RUNS}, {DENSITY} SELECT filter_used, bin, count(*) AS n,
round(count(*) / ((SELECT count(*) FROM runs) * (pow(10, a + (bin + 1) * (z - a) / 49) - pow(10, a + bin * (z - a) / 49))), 9) AS density FROM binned GROUP BY filter_used, bin, a, z""",
    ),
    "box_summary": (
        box_summary,
        f"""WITH {RUNS}, q AS (SELECT filter_used, {Q(0.25)} AS q1, {Q(0.5)} AS median, {Q(0.75)} AS q3 FROM runs GROUP BY filter_used)
SELECT filter_used, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
min(search_time) FILTER (WHERE search_time BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
max(search_time) FILTER (WHERE search_time BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
count(*) FILTER (WHERE NOT (search_time BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS outliers
FROM runs JOIN q USING (filter_used) GROUP BY filter_used, q1, median, q3""",
    ),
    "distinct_sorted": (distinct_sorted, f"WITH {RUNS} SELECT DISTINCT n_partitions FROM runs WHERE \"index\" = 'IVF_FLAT' ORDER BY 1"),
    "param_grid": (
        param_grid,
        """SELECT row_number() OVER (ORDER BY l_returnflag, l_linestatus, l_linenumber) - 1 AS config_id, l_returnflag, l_linestatus, l_linenumber, 1000 AS k
FROM (SELECT DISTINCT l_returnflag FROM lineitem), (SELECT DISTINCT l_linestatus FROM lineitem), (SELECT DISTINCT l_linenumber FROM lineitem)""",
    ),
    "config_lookup": (
        config_lookup,
        f"""WITH {RUNS}, c AS (SELECT row_number() OVER (ORDER BY i, p, n) - 1 AS config_id, i, p, n FROM
(SELECT DISTINCT "index" AS i FROM runs), (SELECT DISTINCT partitioner AS p FROM runs), (SELECT DISTINCT n_partitions AS n FROM runs))
SELECT config_id, {SCHEMA_SQL}, count(*) AS n FROM runs JOIN c ON "index" = i AND partitioner = p AND n_partitions = c.n GROUP BY ALL""",
    ),
    "config_missing": (config_missing, f"WITH {RUNS} SELECT DISTINCT {SCHEMA_SQL} FROM runs WHERE \"index\" = 'HNSW'"),
    "result_roundtrip": (
        result_roundtrip,
        f"WITH {RUNS} SELECT qid, search_time, filter_used, tp, fp, fn, trial, n_partitions % 7 AS schema_id, CAST(floor(filter_percentage * 10) AS INTEGER) AS workflow_id FROM runs",
    ),
    "results_explode": (
        results_explode,
        f"WITH {RUNS} SELECT CAST(trunc(search_time * 100) AS BIGINT) AS search_time, filter_used, tp, fp, fn, trial, n_partitions % 7 AS schema_id, CAST(floor(filter_percentage * 10) AS INTEGER) AS workflow_id FROM runs",
    ),
}
