"""Periodic runs of words by seed-and-extend along diagonals.

A run is a stretch of consecutive words with smallest period q, at least max(shortest, repeats * q) words long, that no neighbouring
word extends. Its words agree with those q places on over at least three periods, or five words where q is 1. So for
k = 5, 15, 45, ... the runs with k / 3 < q <= k (q <= 5 for the first k) hold a k-gram that starts again q places on, and as k >= q,
it cannot start any sooner: that would give the run a smaller period. Each k-gram is therefore paired only with its next
occurrence in the document, and only if that is at a lag of its class. A class has at most as many seeds as there are words, and
a table of the furthest place covered on each lag keeps a stretch from being extended twice.

k-grams are numbered exactly by joining the numbers of shorter ones, from which only those that recur in their document are kept.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectile.llm.common import WORD, with_text_results
from vectile.session import ship_by_value

SEED = 5  # guaranteed overlap of the smallest class
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _numbered(left: np.ndarray, right: np.ndarray | None, gap: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the grams made of ``left`` and, ``gap`` places on, ``right``; -1 where one does not recur in its document.

    Also the pairs (place, next place) of equal grams of one document.
    """
    if right is None:
        places = np.flatnonzero(left >= 0)
        keys = left[places]
    else:
        places = np.flatnonzero((left[: len(left) - gap] >= 0) & (right[gap:] >= 0)) if len(left) > gap else np.empty(0, np.int64)
        keys = left[places] * (right.max(initial=0) + 1) + right[places + gap]
    order = np.argsort(keys, kind="stable")
    places, keys = places[order], keys[order]
    equal = keys[1:] == keys[:-1]
    again = equal & (owner[places[1:]] == owner[places[:-1]])
    kept = np.zeros(len(places), bool)
    kept[1:] |= again
    kept[:-1] |= again
    numbers = np.full(len(left), -1, np.int64)
    numbers[places[kept]] = np.concatenate([[0], np.cumsum(~equal)])[: len(places)][kept]
    return numbers, places[:-1][again], places[1:][again]


def _agreeing(codes: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many places from ``at`` on, in the direction of ``step``, agree with those ``lag`` further."""
    n, chunk = 0, 32
    while True:
        a = at + n * step
        to = min(len(codes) - lag, a + chunk) if step > 0 else max(-1, a - chunk)
        if a == to:
            return n
        here = codes[a:to] if step > 0 else codes[to + 1 : a + 1][::-1]
        there = codes[a + lag : to + lag] if step > 0 else codes[to + 1 + lag : a + 1 + lag][::-1]
        differs = here != there
        first = int(differs.argmax())
        if differs[first]:
            return n + first
        n, chunk = n + len(here), 2 * chunk


def find_runs(codes: np.ndarray, owner: np.ndarray, shortest: int = 6, repeats: int = 4) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period.

    ``codes`` holds the words of several documents as numbers, with a code of its own before, between and after them;
    ``owner`` is the document of each place, -1 for those separators. ``shortest`` is 6 or more and ``repeats`` 4 or more,
    on which the seeds rely.
    """
    if shortest < SEED + 1 or repeats < 4:
        raise ValueError("seeds need runs of six words and four periods at least")
    found: list[tuple[int, int, int]] = []
    words, *_ = _numbered(np.where(owner >= 0, codes, -1), None, 0, owner)
    twos, *_ = _numbered(words, words, 1, owner)
    fours, *_ = _numbered(twos, twos, 2, owner)
    grams, here, there = _numbered(fours, words, 4, owner)
    k, low = SEED, 0
    while len(here):
        lags = there - here
        fits = (lags > low) & (lags <= k)
        order = np.lexsort((here[fits], lags[fits]))
        starts, lags = here[fits][order], lags[fits][order]
        heads = np.ones(len(starts), bool)
        heads[1:] = (lags[1:] != lags[:-1]) | (starts[1:] != starts[:-1] + 1)  # neighbours on a diagonal are one stretch
        covered: dict[int, int] = {}  # by lag, the first place that is not covered yet
        for start, lag in zip(starts[heads].tolist(), lags[heads].tolist()):
            if start < covered.get(lag, -1):
                continue
            to = start + k + _agreeing(codes, start + k, lag, 1)
            begun = start - _agreeing(codes, start - 1, lag, -1)
            covered[lag] = to
            if to - begun + lag >= max(shortest, repeats * lag):
                found.append((begun, to - begun + lag, lag))
        tens, *_ = _numbered(grams, grams, k, owner)
        grams, here, there = _numbered(tens, grams, 2 * k, owner)
        k, low = 3 * k, k
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _of_texts(texts: pa.Array, shortest: int, repeats: int) -> list[pa.Array]:
    lists = [t.as_py().encode().split() for t in texts]
    sizes = np.array([len(words) for words in lists], np.int64)
    known = {w: i for i, w in enumerate(set().union(*lists))}
    firsts = np.concatenate([[0], np.cumsum(sizes + 1)])[: len(lists)] + 1
    owner = np.full(int(sizes.sum()) + len(lists) + 1, -1, np.int64)
    codes = len(known) + np.arange(len(owner), dtype=np.int64)  # a number of its own for each place, words are filled in
    for i, (first, words) in enumerate(zip(firsts.tolist(), lists)):
        owner[first : first + len(words)] = i
        codes[first : first + len(words)] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    runs = find_runs(codes, owner, shortest, repeats)

    steps = np.zeros(len(codes) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(steps)[:-1] == 0
    texts_kept = []
    for first, words in zip(firsts.tolist(), lists):
        stays = kept[first : first + len(words)]
        texts_kept.append(b" ".join(words if stays.all() else compress(words, stays.tolist())).decode())

    at = owner[runs[:, 0]]
    offsets = np.searchsorted(at, np.arange(len(lists) + 1)).astype(np.int32)
    fields = {"start": runs[:, 0] - firsts[at], "length": runs[:, 1], "period": runs[:, 2]}
    rows = pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], names=list(fields))
    return [pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), rows), pa.array(texts_kept, pa.string())]


def with_runs(docs: DataFrame, text: str = "text", shortest: int = 6, repeats: int = 4) -> DataFrame:
    """``docs`` as column ``row`` beside ``n_words``, ``runs`` (start, length, period) and ``collapsed``.

    ``collapsed`` is the text without the words that some run repeats: those within a run after its first period; the rest is
    joined by single spaces. A null, empty or wordless text has no words, no runs and an empty ``collapsed``; a text of any length is
    handled whole, with memory in proportion to it; repeated rows stay, each with its result; an empty table gives no rows;
    other columns, whatever their names, are only carried in ``row``.
    """
    fields = [("n_words", "bigint"), ("runs", RUN), ("collapsed", "string")]
    return with_text_results(docs, lambda texts: _of_texts(texts, shortest, repeats), fields, text)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties go to the smallest start, then period."""

    def better(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        place = F.struct(b["start"], b["period"]) < F.struct(a["start"], a["period"])
        return F.when(a.isNull() | (right > left) | ((right == left) & place), b).otherwise(a)

    return F.reduce(runs, F.lit(None).cast(RUN.removeprefix("array<").removesuffix(">")), better)


def repeat_tail(text: Column, first: Column, period: Column) -> Column:
    """The words of a text, where those from number ``first`` on repeat the ``period`` words found there; joined by spaces."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    rest = F.size(words) - first
    times = F.ceil(rest / period).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, first + 1, period), times)), F.lit(1), rest)
    return F.array_join(F.concat(F.slice(words, F.lit(1), first), tail), " ")


ship_by_value(__name__)
