"""Workload files, result files and experiment configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectile.functions.predicates import DNF_TYPE
from vectile.operators.catalog import literal_array
from vectile.session import materialise

RANGE = "struct<gt:int,lt:int>"
ENTRY = (
    f"struct<query:array<float>,conditions:struct<`and`:array<map<string,map<string,{RANGE}>>>>,"
    "closest_ids:array<bigint>,closest_scores:array<float>>"
)
RUN_ARRAYS = "search_times array<bigint>, filter_used array<boolean>, tp array<int>, fp array<int>, fn array<int>"
MOST_CONDITIONS = 1 << 16  # of a line, in the numbers of its queries
RUN_KEYS = ("trial", "schema_id", "workflow_id")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a file, or of a folder's files in the order of their paths, numbered from 0.

    Spark reads a file in splits. Lines are counted per split, and a split's lines start behind those of the splits before it, so
    numbers do not depend on how the splits are dealt to tasks.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = materialise(read.withColumn("at", F.monotonically_increasing_id()))
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("own"), F.min("at").alias("first"))
    whole = Window.partitionBy("file")
    within = F.coalesce(F.sum("own").over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = splits.groupBy("file").agg(F.sum("own").alias("in_file"))  # a row per file
    before = F.coalesce(F.sum("in_file").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "block", (within - F.col("first")).alias("shift")).join(files.select("file", before.alias("before")), "file")
    return lines.join(starts, ["file", "block"]).select((F.col("at") + F.col("shift") + F.col("before")).alias("line"), "value")


def read_workload(spark: SparkSession, path: str, attrs: Sequence[str], n: int | None = None) -> DataFrame:
    """Range conditions of a JSON-lines workload, one row per condition of a line's first conjunct.

    ``{"gt": g, "lt": l}`` means ``x >= g + 1 and not x >= l``. Lines that do not parse and conditions
    of another kind, without both bounds or on an attribute outside ``attrs`` are skipped; ``n`` keeps the first lines
    by position, skipped ones included. ``line`` is the position and ``qid`` a number for every condition, in file order.
    """
    lines = numbered_lines(spark, path)
    if n is not None:
        lines = lines.filter(F.col("line") < n)
    entry = lines.select("line", F.from_json("value", ENTRY).alias("e")).select("line", "e.*")
    conditions = entry.select(
        "line", "query", "closest_ids", "closest_scores", F.posexplode(F.get(F.col("conditions.and"), F.lit(0))).alias("pos", "attr", "ops")
    )
    first = F.get(F.map_keys("ops"), F.lit(0))
    ranged = conditions.filter(first == "range").withColumn("r", F.col("ops")["range"])
    kept = ranged.filter(
        F.col("attr").isin(list(attrs)) & F.col("r.gt").isNotNull() & F.col("r.lt").isNotNull() & F.col("query").isNotNull()
        & F.col("closest_ids").isNotNull() & F.col("closest_scores").isNotNull()
    )
    place = F.array_position(literal_array(attrs, "array<string>"), F.col("attr")) - 1
    literal = lambda neg, value: F.struct(place.cast("int").alias("attr"), F.lit(neg).alias("neg"), value.alias("value"))
    dnf = F.array(F.array(literal(False, F.col("r.gt") + 1), literal(True, F.col("r.lt")))).cast(DNF_TYPE)
    qid = F.col("line") * MOST_CONDITIONS + F.col("pos")
    return kept.select("line", qid.alias("qid"), "query", "attr", (F.col("r.gt") + 1).alias("lower"), F.col("r.lt").alias("upper"), dnf.alias("dnf"), "closest_ids", "closest_scores")


def write_runs(runs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Run results as JSON, one row per query, in one folder per (trial, schema, workflow)."""
    runs.write.mode(mode).partitionBy(*RUN_KEYS).json(path)


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows written by ``write_runs``."""
    return spark.read.schema(f"{schema}, trial int, schema_id int, workflow_id int").json(path)


def read_run_arrays(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Result files that keep parallel arrays per run, as one row per query.

    By default a file is one document, indented or not; otherwise every line is one. Runs without filter flags have an empty array for them; those rows get NULL.
    """
    arrays = spark.read.schema(f"{RUN_ARRAYS}, trial int, schema_id int, workflow_id int").option("multiLine", multi_line).json(path)
    zipped = F.arrays_zip("search_times", "filter_used", "tp", "fp", "fn")
    rows = arrays.select(*RUN_KEYS, F.posexplode(zipped).alias("pos", "r"))
    return rows.select(
        *RUN_KEYS, "pos", F.col("r.search_times").alias("search_time"), F.col("r.filter_used").alias("filter_used"), "r.tp", "r.fp", "r.fn"
    )


def write_config(grid: DataFrame, path: str, columns: Sequence[str], name: str) -> None:
    """A grid's numbered combinations as the list ``expanded_<name>`` of one configuration document."""
    rows = F.array_sort(F.collect_list(F.struct("config_id", *columns)))
    listed = F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in columns]))
    grid.agg(listed.alias(f"expanded_{name}")).coalesce(1).write.mode("overwrite").json(path)


def write_configs(grid: DataFrame, path: str, columns: Sequence[str]) -> None:
    """A grid as JSON lines, one configuration each, written where the rows are; for grids of any size."""
    grid.select("config_id", *columns).write.mode("overwrite").json(path)


def read_configs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows written by ``write_configs``."""
    return spark.read.schema(f"config_id bigint, {schema}").json(path)


def read_config(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """(config_id, columns...) of the list ``expanded_<name>``; the id is the position."""
    document = spark.read.schema(f"expanded_{name} array<struct<{schema}>>").option("multiLine", True).json(path)
    return document.select(F.posexplode(f"expanded_{name}").alias("config_id", "c")).select(F.col("config_id").cast("bigint").alias("config_id"), "c.*")
