"""Session settings and the shared folder used for materialised intermediate tables."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "vectile", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Only a local-mode session without that setting gets a folder of its own.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/vectile-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder, so a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_by_value(module: str) -> None:
    """Send a module's task code with the task, so executors need no installed copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
