"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ASCII white space separates words; fixed by the contracts of the operators.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 2 << 20
SPACES = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(text: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def is_held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that no model learns from; a null id belongs to it."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def packed(df: DataFrame) -> Column:
    """The whole row as one struct, so that added columns cannot clash with the columns of the input."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive slices of about ``SLICE_BYTES``, each with one text at least; an empty array is one slice."""
    at, ends = 0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    while at < len(texts) or not len(texts):
        begun = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begun + SLICE_BYTES, "right")))
        yield texts.slice(at, to - at)
        if not len(texts):
            return
        at = to


def with_text_results(docs: DataFrame, results: Callable[[pa.Array], list[pa.Array]], fields: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """``docs`` as column ``row`` beside the columns that ``results`` computes from each batch of whole texts.

    Only the text travels to Python. ``results`` takes an Arrow string array without nulls (null texts come as
    empty ones) and returns one array for each of ``fields``. It gets slices of about ``SLICE_BYTES`` of text,
    or one longer text, so what a worker holds beside an Arrow batch does not depend on the number of its rows.
    """
    schema = T.StructType([T.StructField(name, T._parse_datatype_string(kind)) for name, kind in fields])

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(batch):
                yield pa.StructArray.from_arrays(results(part), names=[name for name, _ in fields])

    return docs.select(packed(docs).alias("row"), run(whole_text(text)).alias("found")).select("row", "found.*")


def stratified_bound(rows: DataFrame, key: str, by: str, most: int, seed: int = 42) -> DataFrame:
    """At most about ``most`` rows of each value of ``by``, chosen by a hash of ``key`` and not by partition.

    Counts are taken over all rows first, so the share of each stratum is known and a re-run chooses the same
    rows.
    """
    counts = rows.groupBy(F.col(by).alias("stratum")).agg((F.lit(float(most)) / F.count("*")).alias("share"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11).cast("double") / F.lit(float(2**53))
    return rows.join(counts, F.col(by) == F.col("stratum")).where(draw < F.col("share")).drop("stratum", "share")
