"""Chunked ingest as a stream: each micro-batch of new rows is appended to the partitions it routes to."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from vectile.operators.catalog import Catalog
from vectile.sources.collection import CATALOG_DIR, stored_catalog, write_collection

BATCHES_DIR = "_batches"  # one folder per micro-batch, left empty once its files are in their partitions


def append_batch(batch: DataFrame, path: str, key: str, attrs: Sequence[str], catalog: Catalog) -> None:
    """Append ``batch`` to the collection under file names that start with ``key``; files an earlier run left under it go.

    The catalog is written first. Rows without one, or another one, are an error.
    """
    spark = batch.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda *names: jvm.org.apache.hadoop.fs.Path("/".join([path, *names]))
    fs = at().getFileSystem(conf)
    names = lambda *folder: [s.getPath().getName() for s in fs.listStatus(at(*folder))] if fs.exists(at(*folder)) else []
    parts = lambda *folder: [n for n in names(*folder) if n.startswith("part=")]
    stored = stored_catalog(spark, path)
    if stored is None:
        if any(not n.startswith(("_", ".")) for n in names()):
            raise ValueError(f"{path} has rows but no catalog; write it anew with one first")
        catalog.to_df(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/{CATALOG_DIR}")
    elif catalog.boxes != stored.boxes or list(catalog.attrs) != list(stored.attrs):
        raise ValueError(f"{path} has another catalog; append with the stored one")
    if fs.exists(at(BATCHES_DIR, key)):  # a replay
        for part in parts():
            for name in names(part):
                if name.startswith(f"{key}-"):
                    fs.delete(at(part, name), False)
    write_collection(batch, f"{path}/{BATCHES_DIR}/{key}", attrs, catalog)
    for part in parts(BATCHES_DIR, key):
        fs.mkdirs(at(part))
        for name in names(BATCHES_DIR, key, part):
            if not name.startswith(("_", ".")) and not fs.rename(at(BATCHES_DIR, key, part, name), at(part, f"{key}-{name}")):
                raise OSError(f"{name} of batch {key} could not be moved to {path}/{part}")


def routed_ingest(stream: DataFrame, path: str, checkpoint: str, attrs: Sequence[str], catalog: Catalog) -> DataStreamWriter:
    """Writer for a streaming frame of (id, vector, attributes); call ``start`` on it.

    Micro-batches go through ``write_collection``, so streamed and batch rows share one folder layout and read
    together. Files are named by checkpoint and batch, so a batch that is run again after a failure replaces its own.
    """
    name = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def append(batch: DataFrame, number: int) -> None:
        append_batch(batch, path, f"{name}-{number}", attrs, catalog)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
