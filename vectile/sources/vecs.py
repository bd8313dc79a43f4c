"""``spark.read.format("vecs")``: ivecs, fvecs and bvecs files as rows of (id, vector).

A record is a little-endian int32 dimension followed by that many int32 (ivecs), float32 (fvecs) or
uint8 (bvecs) values. Records have equal length, so a file splits at record boundaries, tasks read
byte ranges, and a row's id is its position: offset over record length, counted on over the files of
a folder in name order.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from vectile.session import ship_by_value

# Element type on disk and in the table, by file suffix.
ELEMENTS = {"ivecs": ("<i4", "int"), "fvecs": ("<f4", "float"), "bvecs": ("u1", "float")}
BYTES_PER_PARTITION = 128 << 20
ROWS_PER_BATCH = 8_192


@dataclass
class ByteRange(InputPartition):
    path: str
    first_id: int
    first_row: int
    n_rows: int
    dim: int


@dataclass
class Written(WriterCommitMessage):
    hidden: str | None
    order: int


def file_format(options: dict) -> str:
    kind = options.get("vecsformat") or options["path"].rstrip("/").rsplit(".", 1)[-1]
    if kind not in ELEMENTS:
        raise ValueError(f"unsupported vector file format: {kind}")
    return kind


class VecsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecs"

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def schema(self) -> str:
        return f"id bigint, vector array<{ELEMENTS[file_format(self._options())][1]}>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return VecsReader(self._options())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return VecsWriter(self._options(), overwrite)


class VecsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.kind = options, file_format(options)
        self.dtype = np.dtype(ELEMENTS[self.kind][0])

    def partitions(self) -> list[ByteRange]:
        store, root = fs.FileSystem.from_uri(self.options["path"])
        info = store.get_file_info(root)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, allow_not_found=False))
        files = sorted((f for f in files if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.path)
        limit = int(self.options["limit"]) if "limit" in self.options else None
        per_part = int(self.options.get("bytesperpartition", BYTES_PER_PARTITION))
        out, next_id = [], 0
        for f in files:
            if not f.size:
                continue
            with store.open_input_file(f.path) as handle:
                dim = int(np.frombuffer(handle.read(4), "<i4")[0])
            width = 4 + dim * self.dtype.itemsize
            if dim <= 0 or f.size % width:
                raise ValueError(f"{f.path}: not a sequence of {dim}-dimensional {self.kind} records")
            rows = f.size // width if limit is None else min(f.size // width, limit - next_id)
            step = max(1, per_part // width)
            for start in range(0, rows, step):
                out.append(ByteRange(f.path, next_id + start, start, min(step, rows - start), dim))
            next_id += rows
        return out

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if part is None:  # no files or only empty ones
            return
        store, _ = fs.FileSystem.from_uri(self.options["path"])
        record = np.dtype([("dim", "<i4"), ("v", self.dtype, (part.dim,))])
        element = pa.int32() if self.kind == "ivecs" else pa.float32()
        with store.open_input_file(part.path) as handle:
            handle.seek(part.first_row * record.itemsize)
            for start in range(0, part.n_rows, ROWS_PER_BATCH):
                n = min(ROWS_PER_BATCH, part.n_rows - start)
                rows = np.frombuffer(handle.read(n * record.itemsize), record)
                if (rows["dim"] != part.dim).any():
                    raise ValueError(f"{part.path}: records of different dimensions")
                flat = pa.array(rows["v"].ravel().astype(np.int32 if self.kind == "ivecs" else np.float32))
                offsets = pa.array(np.arange(0, n * part.dim + 1, part.dim, dtype=np.int32))
                vectors = pa.ListArray.from_arrays(offsets, flat.cast(element))
                ids = pa.array(np.arange(part.first_id + start, part.first_id + start + n, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([ids, vectors], ["id", "vector"])


class VecsWriter(DataSourceArrowWriter):
    """One file per task, hidden until the job commits; the folder's file order is the partition order."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.kind, self.overwrite = options, file_format(options), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(self.options["path"])
        store.create_dir(root)
        order = TaskContext.get().partitionId()
        hidden = f"{root.rstrip('/')}/.attempt-{uuid.uuid4().hex}"
        dtype, dim, written = np.dtype(ELEMENTS[self.kind][0]), None, False
        with store.open_output_stream(hidden) as out:
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors = batch.column(batch.schema.get_field_index("vector"))
                values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                if dim not in (None, values.shape[1]):
                    raise ValueError("vectors of different dimensions")
                dim, written = values.shape[1], True
                rows = np.empty(len(values), [("dim", "<i4"), ("v", dtype, (dim,))])
                rows["dim"], rows["v"] = dim, values
                out.write(rows.tobytes())
        if not written:
            store.delete_file(hidden)
        return Written(hidden if written else None, order)

    def commit(self, messages: list[Written]) -> None:
        store, root = fs.FileSystem.from_uri(self.options["path"])
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if f.is_file and f.base_name[0] not in "._":
                    store.delete_file(f.path)
        batch = uuid.uuid4().hex[:8]
        for m in messages:
            if m is not None and m.hidden:
                store.move(m.hidden, f"{root.rstrip('/')}/part-{m.order:06d}-{batch}.{self.kind}")

    def abort(self, messages: list[Written]) -> None:
        store, _ = fs.FileSystem.from_uri(self.options["path"])
        for m in messages:
            if m is not None and m.hidden:
                store.delete_file(m.hidden)


def read_vecs(spark: SparkSession, path: str | os.PathLike, kind: str | None = None, limit: int | None = None, **options) -> DataFrame:
    """Vector file or folder as (id, vector). ``limit`` reads the first rows only and never opens the rest."""
    spark.dataSource.register(VecsSource)
    reader = spark.read.format("vecs").options(**options)
    if kind:
        reader = reader.option("vecsFormat", kind)
    if limit is not None:
        reader = reader.option("limit", str(limit))
    return reader.load(str(path))


def write_vecs(df: DataFrame, path: str | os.PathLike, kind: str, mode: str = "overwrite") -> None:
    """The ``vector`` column as vector files, in the frame's partition order."""
    df.sparkSession.dataSource.register(VecsSource)
    element = {"ivecs": "int", "fvecs": "float", "bvecs": "float"}[kind]
    rows = df.selectExpr("id", f"cast(vector as array<{element}>) as vector")
    rows.write.format("vecs").option("vecsFormat", kind).mode(mode).save(str(path))


ship_by_value(__name__)
