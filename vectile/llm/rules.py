"""Quality rules: word and line statistics, and a log-likelihood ratio of hashed n-grams. Built-in functions only.

Two multinomials over hashed one- and two-word grams are counted: one over trusted documents, one over the whole corpus.
The mean log ratio of a text's grams under the two tells how much it looks like the trusted ones; a fixed threshold
decides about every document, without drawing lots.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectile.llm.common import WORD, packed, whole_text

BUCKETS = 10_000
SYMBOLS = "#*$%&|<>"  # fixed by the contract
WINDOW = 3


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` refers to it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of three words that occurs at least twice; each word counts once.

    Windows are compared by their 64-bit hash. Sorted by (hash, place), equal ones are neighbours, so no window is
    looked up in a list of others; most texts have no equal hashes and stop at comparing two sizes. ``words`` has to
    be bound by ``let``, as it is used within functions of its elements.
    """

    def hashes(ws: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ws) - WINDOW)
        return F.transform(places, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)]))

    def covered(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, k, d: F.coalesce(F.get(s, k + d)["h"] == F.get(s, k)["h"], F.lit(False))
        doubled = let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: F.when(k > 0, same(s, k, -1)).otherwise(F.lit(False)) | same(s, k, 1)), lambda x: x["i"])))
        steps = let(doubled, lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    repeats = lambda hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), covered(hs)).otherwise(F.lit(0))
    return F.when(F.size(words) > WINDOW, let(hashes(words), repeats)).otherwise(F.lit(0)).cast("long")


def grams(words: Column) -> Column:
    """The buckets of the words and of the pairs of neighbours; ``words`` has to be bound by ``let``."""
    own = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    pair = lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(BUCKETS)).cast("int")
    return F.concat(own, F.slice(F.transform(words, pair), F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))


@dataclass(frozen=True)
class RatioModel:
    """Log ratio of each bucket, and the mean ratio from which a text is kept."""

    ratios: tuple[float, ...]
    threshold: float

    def score(self, words: Column) -> Column:
        """The mean log ratio of the grams of a text, null for a text without words."""
        # One literal array: the text is split and cast once, when the plan is optimised.
        table = F.split(F.lit(",".join(map(repr, self.ratios))), ",").cast("array<double>")
        summed = lambda gs: F.aggregate(gs, F.lit(0.0), lambda total, g: total + F.get(table, g)) / F.size(gs)
        return F.when(F.size(words) > 0, let(grams(words), summed))


def fit_ratio(docs: DataFrame, trusted: DataFrame, deviations: float = 4.0, text: str = "text", doc_id: str = "doc_id", smooth: float = 1.0) -> RatioModel:
    """Count the grams of all documents, and of the trusted ones (``trusted`` has their ids).

    Both multinomials come from every document they are about: partial sums leave a task as one row per bucket. Trusted
    documents are found by a join that shuffles by id, as their ids may be too many to broadcast. Texts are shuffled
    once; for the threshold, ``deviations`` standard deviations below the mean score of the trusted, every document is scored in place
    and only the scores meet the ids. Without any trusted document all ratios are 0 and everything is kept.
    """
    ids = trusted.select(F.col(doc_id).alias("trusted_id")).where("trusted_id IS NOT NULL").distinct()
    slim = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    is_trusted = F.col("doc_id") == F.col("trusted_id")
    good = slim.join(ids.hint("merge"), is_trusted, "left_semi")
    words = words_of(F.col("text"))
    count = lambda df: {r.bucket: r.n for r in df.select(F.explode(let(words, grams)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    target = count(good)
    if not target:
        return RatioModel((0.0,) * BUCKETS, float("-inf"))
    raw = count(slim)
    whole, trusted_whole = sum(raw.values()) + smooth * BUCKETS, sum(target.values()) + smooth * BUCKETS
    ratios = tuple(round(math.log((target.get(b, 0) + smooth) / trusted_whole) - math.log((raw.get(b, 0) + smooth) / whole), 9) for b in range(BUCKETS))
    model = RatioModel(ratios, float("-inf"))
    scored = slim.select("doc_id", let(words, model.score).alias("score")).join(ids, is_trusted)  # ids are distinct; a semi join would move below the scores
    spread = scored.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd")).first()
    return RatioModel(ratios, round(spread["mean"] - deviations * spread["sd"], 9))


def with_rules(docs: DataFrame, model: RatioModel, text: str = "text") -> DataFrame:
    """``docs`` as column ``row`` with the statistics, the score and the verdict of each whole text.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier one),
    n_repeat_words, base_failed, ratio (null without words) and kept. A null text counts as empty, which fails.
    """
    own = F.col("own_text")
    lines = F.filter(F.split(own, "\n"), lambda line: line.rlike(WORD))
    chars = lambda drop: F.length(own) - F.length(F.translate(own, drop, ""))
    staged = docs.select(packed(docs).alias("row"), whole_text(text).alias("own_text"))
    # The words are cut once; what is found in them is one struct.
    found = lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).alias("n_repeat_words"), model.score(ws).alias("ratio"))
    staged = staged.withColumn("found", let(words_of(own), found))
    counted = staged.select(
        "row",
        F.length(F.translate(own, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        chars(SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        F.col("found.*"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = F.coalesce(F.col("ratio") >= model.threshold, F.lit(False))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict)


def apply_rules(docs: DataFrame, trusted: DataFrame, deviations: float = 4.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id with the columns of ``with_rules``. Repeated rows stay; an empty table gives none."""
    model = fit_ratio(docs, trusted, deviations, text=text, doc_id=doc_id)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = with_rules(slim, model)
    return found.select("row.doc_id", *[c for c in found.columns if c != "row"])
