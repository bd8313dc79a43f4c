"""Language identification by error-correcting output codes over hashed character n-grams.

Every language has a codeword of bits. For each bit a binary classifier tells languages with a one from those with a
zero: the log ratio of their hashed n-gram distributions, averaged over the n-grams of a text. A text goes to the
codeword whose bits lose least on the classifiers' margins; a text for which two codewords lose about the same is
flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectile.llm.common import is_held_out, whole_text, with_text_results

BUCKETS = 1 << 15
BLOCK_CHARS = 1 << 20
LONG = 5000
UNIT = 1000
UNDETERMINED = "und"  # fixed by the contract
_LETTER = regex.compile(r"\p{L}")
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        table = np.zeros(0x110000, bool)
        plain = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        table[[ord(c) for c in _LETTER.findall("".join(plain))]] = True
        _letters.append(table)
    return _letters[0]


def gram_counts(text: str) -> np.ndarray:
    """Counts per bucket of the 1-, 2- and 3-grams of a whole text; what is no letter counts as one blank."""
    counts, text = np.zeros(BUCKETS, np.int64), text.lower()
    for at in range(0, len(text), BLOCK_CHARS):
        # A block counts the n-grams that end in it; two characters before it complete those at its border.
        seen = min(at, 2)
        part = text[at - seen : at + BLOCK_CHARS]
        code = np.frombuffer(part.encode("utf-32-le"), "<u4")
        letter = _is_letter()[code]
        code = np.where(letter, code, 32).astype(np.uint64)
        blank = ~letter
        three = code[:-2] * np.uint64(0x9E3779B1) + code[1:-1] * np.uint64(0x85EBCA77) + code[2:] * np.uint64(0xC2B2AE3D) if len(code) > 2 else code[:0]
        two = code[:-1] * np.uint64(0x27D4EB2F) + code[1:] * np.uint64(0x165667B1)
        first = [seen, max(seen - 1, 0), 0]
        useful = [~blank, ~(blank[:-1] & blank[1:]), ~(blank[:-2] & blank[2:])]
        grams = [own[a:][keep[a:]] for own, keep, a in zip((code, two, three), useful, first)]
        for salt, own in enumerate(grams):
            mixed = (own + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
            counts += np.bincount((mixed >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
    return counts


def codewords(classes: int, seed: int = 42) -> np.ndarray:
    """One row of +1 and -1 per class: all distinct splits for up to seven classes, else the best of random codes."""
    if classes < 2:
        return np.zeros((classes, 0))
    if classes <= 7:
        splits = np.arange(2 ** (classes - 1) - 1)
        rows = [np.ones(len(splits))] + [np.where(splits >> i & 1, 1.0, -1.0) for i in range(classes - 1)]
        return np.array(rows)
    draw, bits, best, best_gap = np.random.Generator(np.random.PCG64(seed)), int(np.ceil(10 * np.log2(classes))), None, -1
    for _ in range(50):
        code = draw.choice([-1.0, 1.0], (classes, bits))
        code = code[:, np.abs(code.sum(axis=0)) < classes]
        gap = ((code.shape[1] - code @ code.T) / 2 + code.shape[1] * np.eye(classes)).min()
        if gap > best_gap:
            best, best_gap = code, gap
    return best


@dataclass
class LanguageModel:
    """``weights`` (buckets x bits) gives margins of about one where a bit is sure."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray

    def decode(self, text: str, gap: float) -> tuple[str, float, bool]:
        if not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0, True
        counts = gram_counts(text)
        margins = counts @ self.weights / counts.sum()
        # Loss-weighted decoding: each codeword pays for every bit by how far the margin is on the wrong side.
        losses = np.logaddexp(0, -4 * self.code * margins).sum(axis=1)
        chance = np.exp(losses.min() - losses)
        chance /= chance.sum()
        order = np.argsort(losses, kind="stable")
        close = len(order) > 1 and losses[order[1]] - losses[order[0]] < gap
        return self.languages[order[0]], float(chance[order[0]]), bool(close)


def fit_languages(docs: DataFrame, most: int = 4000, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", smooth: float = 0.02, seed: int = 42) -> LanguageModel:
    """Learn from the texts of documents outside the held-out fold with a language.

    Counts come from at most about ``most`` documents of each language, chosen by a hash of their id: the documented
    bound of the sample. Tasks add up their n-grams per language before anything is shuffled, and the driver gets one
    count per language and bucket.
    """
    known = docs.where(~is_held_out(F.col(doc_id)) & F.col(lang).isNotNull())
    totals = {r.lang: r.n for r in known.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return LanguageModel([], codewords(0), np.zeros((BUCKETS, 0)))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id)), 11).cast("double") / F.lit(float(2**53))
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, most / totals[name]))])
    sample = known.where(draw < share[F.col(lang)]).select(F.col(lang).alias("lang"), whole_text(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, own in zip(batch["lang"].to_pylist(), batch["text"]):
                counts = gram_counts(own.as_py())
                # A text weighs at most as much as LONG n-grams; in whole units, so that sums do not depend on their order.
                counts = np.rint(counts * (UNIT * min(1.0, LONG / max(counts.sum(), 1)))).astype(np.int64)
                sums[name] = sums[name] + counts if name in sums else counts
        for name, counts in sums.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(counts[some])], names=["lang", "bucket", "n"])

    counted = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counted["lang"].to_pylist()))  # those of which a letter was seen
    if not languages:
        return LanguageModel([], codewords(0), np.zeros((BUCKETS, 0)))
    table = np.full((len(languages), BUCKETS), smooth)
    row = {name: i for i, name in enumerate(languages)}
    table[[row[x] for x in counted["lang"].to_pylist()], counted["bucket"].to_numpy()] += counted["n"].to_numpy() / UNIT
    share_of = table / table.sum(axis=1, keepdims=True)
    code = codewords(len(languages), seed)
    # Languages weigh alike within a side, whatever the size of their samples.
    ones, zeros = (code.T > 0) @ share_of, (code.T < 0) @ share_of
    weights = np.log(ones / (code.T > 0).sum(axis=1, keepdims=True)) - np.log(zeros / (code.T < 0).sum(axis=1, keepdims=True))
    expected = np.abs(share_of @ weights.T).mean(axis=0)
    return LanguageModel(languages, code, (weights / np.maximum(expected, 1e-9)[:, None]).T.copy())


def identify_languages(docs: DataFrame, model: LanguageModel, gap: float = 1.0, text: str = "text") -> DataFrame:
    """``docs`` as column ``row`` with (lang_pred, score, ambiguous) from whole texts alone.

    A null text or one without a letter is ``und`` with score 0, as is every text if no language was learned. Texts
    of any length are counted whole, repeated rows get equal answers, other columns are only carried in ``row``,
    and an empty table gives no rows.
    The score is the share of the chosen codeword among all, and ``ambiguous`` tells that the runner-up's loss is within
    ``gap`` of the best. Ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> list[pa.Array]:
        found = [shared.value.decode(t.as_py(), gap) for t in texts]
        names, scores, close = zip(*found) if found else ((), (), ())
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(close, pa.bool_())]

    return with_text_results(docs, predict, [("lang_pred", "string"), ("score", "double"), ("ambiguous", "boolean")], text)


def predict_languages(docs: DataFrame, most: int = 4000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: (doc_id, held_out, lang_pred, score, ambiguous), with the model learned from ``docs`` itself."""
    model = fit_languages(docs, most, lang, text, doc_id)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return identify_languages(slim, model).select("row.doc_id", is_held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
