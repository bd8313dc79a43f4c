"""Token ids as ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

A dataset is a folder of ORC files with columns (doc_id, place, ids). ``place`` is the number of the file shifted left by 33
plus the row in it, which run-length encoding stores in next to nothing. Files hold disjoint ranges of ids in ascending order, so
stripes can be read in parallel, and statistics in the footer, the row index of each stripe and the Bloom filters
rule out files, stripes and row groups for a reader that asks for some documents.
"""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from vectile.llm.bpe import WordMemory, gather, share_definition
from vectile.llm.common import with_text_results
from vectile.session import materialise

END_ID = 1  # fixed by the contract: closes each document
KNOWN_WORDS = 600_000
JOINED = 256
SCHEMA = "doc_id long, place long, ids array<int>"


class WordEncoder:
    """Encodes texts with a tokenizer of which white space separates all words, each distinct word once.

    ASCII white space is dropped by such a tokenizer before it merges, and nothing it does reaches across; words are
    cut there and nowhere else, so what remains inside them is the library's own work.
    """

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        plain = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        for probe in ("a\tb", "a  b", " a \n b\x0b\x0c\r"):
            if plain(probe) != [i for word in probe.split() for i in plain(word)]:
                raise ValueError("the tokenizer does not drop white space between words")
        self.memory = WordMemory(KNOWN_WORDS)

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word. Some hundred words make one text for the library, whose offsets tell them apart."""
        out: list[bytes] = []
        spelled = [w.decode() for w in words]
        joined = [spelled[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for own, coded in zip(joined, self.tokenizer.encode_batch([" ".join(own) for own in joined], add_special_tokens=False)):
            starts = np.cumsum([0, *[len(w) + 1 for w in own]])
            ids = np.array(coded.ids, "<i4").tobytes()
            cuts = (4 * np.searchsorted([a for a, _ in coded.offsets], starts)).tolist()
            out += [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        return out

    def encode(self, texts: pa.Array, end: int) -> pa.ListArray:
        """The ids of each text with the end id, which counts as a word of its own."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        found = self.memory.ids_of(words, self._ids)
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.insert(coded.indices.to_numpy(zero_copy_only=False), np.cumsum(counts), len(words))
        return gather([*found, end.to_bytes(4, "little")], order, counts + 1)


_encoders: dict[str, WordEncoder] = {}


def _encoder(definition: str) -> WordEncoder:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        _encoders.clear()
        _encoders[key] = WordEncoder(definition)
    return _encoders[key]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, files: int | None = None, stripe_bytes: int = 64 << 20, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts (null: empty), close each with ``end_id`` and write them in ascending order of ids.

    Null ids come first, rows of one id in the order of a hash of their text. Texts are dealt by ranges of (id, hash),
    so that rows that share an id are split between tasks, and sorted and encoded where they are written.
    ``files`` defaults to the session's number of shuffle partitions.
    """
    spark = docs.sparkSession
    definition = share_definition(spark, tokenizer)
    order = ["doc_id", "tie"]
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = slim.withColumn("tie", F.xxhash64("text"))
    ranged = keyed.repartitionByRange(files or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def ids(texts: pa.Array) -> list[pa.Array]:
        return [_encoder(definition.value).encode(texts, end_id)]

    rows = with_text_results(ranged, ids, [("ids", "array<int>")]).select("row.doc_id", F.monotonically_increasing_id().alias("place"), "ids")
    options = {
        "compression": "zstd",
        "orc.create.index": "true",
        "orc.row.index.stride": "10000",
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
        "orc.stripe.size": str(stripe_bytes),
        "orc.encoding.strategy": "COMPRESSION",
    }
    rows.write.mode("overwrite").options(**options).orc(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, place, ids) of a folder; a condition on doc_id is pushed down to files, stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(folder)


@F.arrow_udf(T.LongType())
def ids_crc32(lists: pa.Array) -> pa.Array:
    """The unsigned CRC-32 of each list's ids as little-endian 32-bit integers."""
    ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False).view(np.uint8)
    ends = 4 * np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
    return pa.array([zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.int64())


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per stored document: (doc_id, start, n_tokens, ids_crc32), read back from the files.

    ``start`` is the number of ids of all documents before it. Files are summed first and their running total is taken
    over one row per file; documents are ordered within their file only.
    """
    rows = read_token_files(spark, folder)
    rows = rows.select("doc_id", "place", F.shiftright("place", 33).alias("file"), F.size("ids").cast("long").alias("n_tokens"), ids_crc32(F.col("ids")).alias("ids_crc32"))
    lengths = materialise(rows)
    earlier = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    files = lengths.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"))
    before = files.select("file", F.coalesce(F.sum("file_tokens").over(earlier(Window.orderBy("file"))), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n_tokens").over(earlier(Window.partitionBy("file").orderBy("place"))), F.lit(0))
    placed = lengths.withColumn("within", within).join(before, "file")
    return placed.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
