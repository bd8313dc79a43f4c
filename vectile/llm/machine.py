"""Quality of texts by a factorisation machine over hashed words, structure statistics and metadata.

Every feature has a weight and a short vector; the inner products of the vectors model what pairs of features add.
With the identity sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i x_i v_i|^2 - sum_i x_i^2 |v_i|^2) / 2 a text is scored in time
linear in the number of its words.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectile.llm.common import is_held_out, stratified_bound, whole_text, with_text_results

WORD_BUCKETS = 1 << 14
BINS = 8
CLASSES = {  # byte classes counted for the structure statistics
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": (9, 11, 12, 13, 32),
    "line": (10,),
    "stop": b".,;:!?'\"()-",
    "symbol": b"#*$%&|<>@^_=+~`/\\[]{}",
}
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _i, _bytes in enumerate(CLASSES.values()):
    _CLASS[list(_bytes)] = _i
STATISTICS = ["words", "length", "distinct", "repeated_lines", "line_words", "tail_stops", *CLASSES, "other"]


def words_and_statistics(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, values) of the hashed words of a whole text, and its structure statistics.

    Words are cut at ASCII white space and lower-cased there; values are damped counts with unit norm.
    """
    raw = text.encode()
    words = raw.lower().split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    share = np.zeros(len(CLASSES) + 1)
    for at in range(0, len(raw), 1 << 20):
        share += np.bincount(_CLASS[np.frombuffer(raw[at : at + (1 << 20)], np.uint8)], minlength=len(share))
    n, ink = max(len(words), 1), max(len(raw), 1)
    shape = [np.log1p(len(words)), sum(map(len, words)) / n, len(set(words)) / n, 1 - len(set(lines)) / max(len(lines), 1), np.log1p(n / max(len(lines), 1)), sum(w[-1:] in b".,;:!?" for w in words) / n]
    if not words:
        return np.zeros(0, np.int64), np.zeros(0), np.array([*shape, *(share / ink)])
    crc = zlib.crc32
    buckets, counts = np.unique(np.fromiter([crc(w) for w in words], np.uint32, len(words)) & np.uint32(WORD_BUCKETS - 1), return_counts=True)
    values = np.log1p(counts)
    return buckets.astype(np.int64), values / np.linalg.norm(values), np.array([*shape, *(share / ink)])


@dataclass
class Machine:
    """Trained parameters; ``cuts`` are the inner borders of the bins of each statistic."""

    cuts: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def features(self, buckets: np.ndarray, values: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins = (numbers[:, None] > self.cuts).sum(axis=1)
        own = WORD_BUCKETS + np.arange(len(numbers)) * BINS + bins
        return np.concatenate([buckets, own]), np.concatenate([values, np.full(len(numbers), 1 / np.sqrt(len(numbers)))])

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        scaled = self.factor[index] * value[:, None]
        pairs = (np.square(scaled.sum(axis=0)) - np.square(scaled).sum(axis=0)).sum() / 2
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weight[index] @ value + pairs, -30, 30))))


@dataclass
class Rows:
    """Hashed words of many texts in flat arrays, row i from ``ends[i - 1]`` to ``ends[i]``, and their statistics."""

    buckets: np.ndarray
    values: np.ndarray
    ends: np.ndarray
    numbers: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Rows:
        buckets, values, numbers = zip(*rows)
        return cls(np.concatenate(buckets), np.concatenate(values), np.cumsum([len(b) for b in buckets]), np.array(numbers))

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = slice(self.ends[i - 1] if i else 0, self.ends[i])
        return self.buckets[own].astype(np.int64), self.values[own].astype(float), self.numbers[i]


def train(rows: Rows, labels: np.ndarray, rank: int = 8, epochs: int = 8, batch: int = 128, rate: float = 0.1, decay: float = 1e-4, seed: int = 42) -> Machine:
    """A machine fitted to labelled rows by mini-batches with adaptive steps; classes weigh alike.

    The order is a function of the seed. One class alone gives its share as score for every text.
    """
    numbers = rows.numbers
    width = numbers.shape[1]
    cuts = np.quantile(numbers, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    size = WORD_BUCKETS + width * BINS
    draw = np.random.Generator(np.random.PCG64(seed))
    machine = Machine(cuts, 0.0, np.zeros(size), draw.normal(0, 0.05, (size, rank)))
    weight_of = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    if labels.min() == labels.max():
        return Machine(cuts, 4.0 if labels[0] else -4.0, machine.weight, np.zeros((size, rank)))
    sums = [np.full(size, 1e-2), np.full((size, rank), 1e-2), 1e-2]
    for _ in range(epochs):
        order = draw.permutation(len(labels))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            coded = [machine.features(*rows.row(i)) for i in own]
            index, value = (np.concatenate(part) for part in zip(*coded))
            lengths = np.array([len(i) for i, _ in coded])
            ends = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            scaled = machine.factor[index] * value[:, None]
            total = np.add.reduceat(scaled, ends)
            linear = np.add.reduceat(machine.weight[index] * value, ends)
            margin = machine.bias + linear + (np.square(total).sum(axis=1) - np.add.reduceat(np.square(scaled).sum(axis=1), ends)) / 2
            slope = weight_of[own] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[own]) / len(own)
            each = np.repeat(slope, lengths) * value
            touched, place = np.unique(index, return_inverse=True)
            grad_weight = np.bincount(place, each) + decay * machine.weight[touched]
            step = each[:, None] * (np.repeat(total, lengths, axis=0) - scaled)
            grad_factor = np.stack([np.bincount(place, step[:, f]) for f in range(rank)], axis=1) + decay * machine.factor[touched]
            sums[0][touched] += np.square(grad_weight)
            sums[1][touched] += np.square(grad_factor)
            sums[2] += slope.sum() ** 2
            machine.weight[touched] -= rate * grad_weight / np.sqrt(sums[0][touched])
            machine.factor[touched] -= rate * grad_factor / np.sqrt(sums[1][touched])
            machine.bias -= rate * slope.sum() / np.sqrt(sums[2])
    return machine


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 5000, text: str = "text", doc_id: str = "doc_id", quality: str = "quality", seed: int = 42) -> Machine:
    """Learn from documents outside the held-out fold: at most about ``most`` labelled rows of either class.

    That bound is what makes the list of chosen ids, which goes to the documents, and the features of their texts, which
    come to the driver in flat arrays of narrow types, of fixed size. Ids whose labels contradict each other or are null teach nothing. Without
    any labelled document every text scores 0.5.
    """
    marks = labels.where(~is_held_out(F.col(doc_id)) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("label_id"))
    agreed = marks.agg(F.min(quality).alias("low"), F.max(quality).alias("label")).where("low = label AND label IN (0, 1)").select("label_id", F.col("label").cast("int").alias("label"))
    chosen = stratified_bound(agreed, "label_id", "label", most, seed)
    texts = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    # At most two strata of ``most`` ids: a proven bound.
    sample = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "label", "text")

    def features(own: pa.Array) -> list[pa.Array]:
        found = [words_and_statistics(t.as_py()) for t in own]
        lists = lambda k, kind: pa.array([f[k].astype(kind) for f in found], pa.list_(pa.from_numpy_dtype(kind)))
        return [lists(0, np.int16), lists(1, np.float32), lists(2, np.float64)]

    fields = [("buckets", "array<smallint>"), ("vals", "array<float>"), ("numbers", "array<double>")]
    rows = with_text_results(sample, features, fields).select("row.doc_id", "row.label", "buckets", "vals", "numbers").toArrow()
    if not rows.num_rows:
        width = len(STATISTICS)
        return Machine(np.zeros((width, BINS - 1)), 0.0, np.zeros(WORD_BUCKETS + width * BINS), np.zeros((WORD_BUCKETS + width * BINS, 1)))
    table = rows.sort_by([("doc_id", "ascending"), ("label", "ascending")]).combine_chunks()
    del rows
    flat = lambda name: np.concatenate([c.flatten().to_numpy() for c in table[name].chunks])
    lengths = pc.list_value_length(table["buckets"]).to_numpy()
    own = Rows(flat("buckets"), flat("vals"), np.cumsum(lengths), flat("numbers").reshape(len(lengths), -1))
    labelled = table["label"].to_numpy().astype(float)
    del table
    pa.default_memory_pool().release_unused()
    return train(own, labelled, seed=seed)


def with_quality(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """``docs`` as column ``row`` with ``score``, the chance that a whole text has label 1; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def score(texts: pa.Array) -> list[pa.Array]:
        own = shared.value
        return [pa.array([own.score(*own.features(*words_and_statistics(t.as_py()))) for t in texts], pa.float64())]

    return with_text_results(docs, score, [("score", "double")], text)


def accepted(score: Column, threshold: float = 0.3) -> Column:
    return F.when(score >= threshold, 1).otherwise(0)


def predict_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted); an empty table gives no rows."""
    machine = fit_quality(docs, labels, text=text, doc_id=doc_id)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = with_quality(slim, machine).select("row.doc_id", "score")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", accepted(F.col("score"), threshold).alias("predicted"))
