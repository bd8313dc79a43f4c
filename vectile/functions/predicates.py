"""Boolean range filters, as expressions built on the driver and as data carried by query rows.

A predicate is built from ``at_least(attr, value)`` with ``all_of``, ``any_of`` and ``negate``.
Everything else is one fold over that tree with a different meaning for its leaves.
Three-valued truth is SQL's own: TRUE, FALSE, and NULL for "may hold".
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentinels for an unbounded side: the limits of a 32-bit attribute.
UNBOUNDED_LO = -(2**31)
UNBOUNDED_HI = 2**31 - 1

#: A query's filter as data: OR of clauses, each an AND of (attribute position, negated, threshold).
DNF_TYPE = "array<array<struct<attr:int,neg:boolean,value:int>>>"

#: A filter as data without expansion: postfix steps. A leaf tests ``attr >= value``; AND and OR take ``value`` operands, NOT one.
PROGRAM_TYPE = "array<struct<op:int,attr:int,value:int>>"
LEAF, AND, OR, NOT = range(4)


@dataclass(frozen=True)
class Predicate:
    kind: str  # "leaf", "all", "any" or "not"
    attr: str = ""
    value: int = 0
    parts: tuple[Predicate, ...] = ()

    def __and__(self, other: Predicate) -> Predicate:
        return all_of(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return any_of(self, other)

    def __invert__(self) -> Predicate:
        return negate(self)

    def __str__(self) -> str:
        return filter_text(self)


def at_least(attr: str, value: int) -> Predicate:
    return Predicate("leaf", attr=str(attr), value=int(value))


def all_of(*parts: Predicate) -> Predicate:
    return Predicate("all", parts=parts)


def any_of(*parts: Predicate) -> Predicate:
    return Predicate("any", parts=parts)


def negate(part: Predicate) -> Predicate:
    return Predicate("not", parts=(part,))


def between(attr: str, lo: int | None, hi: int | None) -> Predicate:
    """Inclusive range, with ``None`` for an open side."""
    low = [at_least(attr, lo)] if lo is not None else []
    high = [negate(at_least(attr, hi + 1))] if hi is not None else []
    return all_of(*low, *high)


def _fold(p: Predicate, leaf: Callable, conj: Callable, disj: Callable, neg: Callable):
    if p.kind == "leaf":
        return leaf(p.attr, p.value)
    inner = [_fold(q, leaf, conj, disj, neg) for q in p.parts]
    return {"all": conj, "any": disj}[p.kind](inner) if p.kind != "not" else neg(inner[0])


def _boolean(p: Predicate, leaf: Callable[[str, int], Column]) -> Column:
    """An empty conjunction is true and an empty disjunction false."""
    return _fold(
        p,
        leaf,
        lambda cs: reduce(and_, cs) if cs else F.lit(True),
        lambda cs: reduce(or_, cs) if cs else F.lit(False),
        lambda c: ~c,
    )


def as_column(p: Predicate) -> Column:
    """The filter itself; comparisons with literals reach the Parquet scan."""
    return _boolean(p, lambda attr, value: F.col(attr) >= F.lit(value))


def range_truth(lo: Column, hi: Column, value: Column) -> Column:
    """Truth of ``x >= value`` for every x in [lo, hi]; NULL where some x pass and some do not."""
    return F.when(hi < value, F.lit(False)).when(lo >= value, F.lit(True))


def catalog_truth(p: Predicate, attrs: Sequence[str]) -> Column:
    """Three-valued truth over a catalog row with ``lo_<attr>`` and ``hi_<attr>`` columns."""

    def leaf(attr: str, value: int) -> Column:
        if attr not in attrs:
            return F.lit(None).cast("boolean")
        return range_truth(F.col(f"lo_{attr}"), F.col(f"hi_{attr}"), F.lit(value))

    return _boolean(p, leaf)


def survives(truth: Column) -> Column:
    """Keep what holds or may hold."""
    return F.coalesce(truth, F.lit(True))


def filter_text(p: Predicate) -> str:
    """SQL text, usable in ``df.filter``."""
    wrap = lambda word, empty: lambda ts: f" {word} ".join(f"({t})" for t in ts) if ts else empty
    return _fold(
        p,
        lambda attr, value: f"{attr} >= {value}",
        wrap("and", "true"),
        wrap("or", "false"),
        lambda t: f"not({t})",
    )


def atomics(p: Predicate) -> list[tuple[str, int]]:
    """Leaves in depth-first order, repeated ones included, without their negations."""
    gather = lambda lists: [leaf for found in lists for leaf in found]
    return _fold(p, lambda attr, value: [(attr, value)], gather, gather, lambda found: found)


def to_dnf(p: Predicate, attrs: Sequence[str], max_clauses: int = 4096) -> list[list[tuple[int, bool, int]]]:
    """Disjunctive form for ``DNF_TYPE``. Nothing is simplified, so three-valued truth is unchanged."""
    order = {attr: i for i, attr in enumerate(attrs)}

    def both(pair_lists, joined_first: bool):
        pos = [pair[0] for pair in pair_lists]
        neg = [pair[1] for pair in pair_lists]
        union = lambda forms: [clause for form in forms for clause in form]

        def cross(forms):
            size = reduce(lambda n, form: n * len(form), forms, 1)
            if size > max_clauses:
                raise ValueError(f"the filter expands to {size} clauses; use it as a column instead")
            return [sum(combo, []) for combo in product(*forms)]

        return (cross(pos), union(neg)) if joined_first else (union(pos), cross(neg))

    positive, _ = _fold(
        p,
        lambda attr, value: ([[(order[attr], False, value)]], [[(order[attr], True, value)]]),
        lambda pairs: both(pairs, True),
        lambda pairs: both(pairs, False),
        lambda pair: (pair[1], pair[0]),
    )
    return positive


def dnf_literal(p: Predicate, attrs: Sequence[str]) -> Column:
    """The same filter on every query row."""
    form = [[{"attr": a, "neg": n, "value": v} for a, n, v in clause] for clause in to_dnf(p, attrs)]
    return F.from_json(F.lit(json.dumps(form)), DNF_TYPE)


def to_program(p: Predicate, attrs: Sequence[str]) -> list[tuple[int, int, int]]:
    """Postfix code for ``PROGRAM_TYPE``: one step per leaf and connective, so its length is that of the filter itself."""
    order = {attr: i for i, attr in enumerate(attrs)}
    joined = lambda op: lambda codes: [step for code in codes for step in code] + [(op, 0, len(codes))]
    return _fold(p, lambda attr, value: [(LEAF, order[attr], value)], joined(AND), joined(OR), lambda code: [*code, (NOT, 0, 1)])


def program_literal(p: Predicate, attrs: Sequence[str]) -> Column:
    """The same program on every row."""
    code = [{"op": op, "attr": a, "value": v} for op, a, v in to_program(p, attrs)]
    return F.from_json(F.lit(json.dumps(code)), PROGRAM_TYPE)


def program_holds(program: Column, values: Column) -> Column:
    """A filter carried by the row as a program, run by a fold over its steps with a stack of truth values.

    An empty AND is true and an empty OR false; a null value makes its leaf unknown, as in SQL; a null program keeps
    the row.
    """
    top = lambda stack, n: F.slice(stack, F.lit(1), n)

    def step(stack: Column, s: Column) -> Column:
        n = s["value"]
        rest = F.slice(stack, n + 1, F.greatest(F.size(stack) - n, F.lit(0)))
        push = lambda truth, below: F.concat(F.array(truth), below)
        return (
            F.when(s["op"] == LEAF, push(F.get(values, s["attr"]) >= s["value"], stack))
            .when(s["op"] == AND, push(F.forall(top(stack, n), lambda t: t), rest))
            .when(s["op"] == OR, push(F.exists(top(stack, n), lambda t: t), rest))
            .otherwise(push(~F.get(stack, F.lit(0)), rest))
        )

    return F.coalesce(program.isNull(), F.lit(False)) | F.reduce(program, F.array().cast("array<boolean>"), step, lambda stack: F.get(stack, F.lit(0)))


def dnf_column(form: Sequence[Sequence[tuple[int, bool, int]]], attrs: Sequence[str]) -> Column:
    """A filter in disjunctive form as a plain column, which reaches the Parquet scan."""
    literal = lambda a, n, v: negate(at_least(attrs[a], v)) if n else at_least(attrs[a], v)
    return as_column(any_of(*[all_of(*[literal(*l) for l in clause]) for clause in form]))


def _quantify(dnf: Column, literal: Callable[[Column], Column]) -> Column:
    return F.exists(dnf, lambda clause: F.forall(clause, literal))


def dnf_holds(dnf: Column, values: Column) -> Column:
    """Filter carried by the row, on an array of attribute values."""
    return _quantify(dnf, lambda l: (F.get(values, l["attr"]) >= l["value"]) != l["neg"])


def dnf_truth(dnf: Column, lo: Column, hi: Column) -> Column:
    """Three-valued truth of a carried filter over arrays of lower and upper bounds."""

    def literal(l: Column) -> Column:
        t = range_truth(F.get(lo, l["attr"]), F.get(hi, l["attr"]), l["value"])
        return F.when(l["neg"], ~t).otherwise(t)

    return _quantify(dnf, literal)


def dnf_text(dnf: Column, attrs: Sequence[str]) -> Column:
    """SQL text of a carried filter."""
    names = F.array(*[F.lit(a) for a in attrs])

    def literal(l: Column) -> Column:
        plain = F.concat_ws(" ", F.get(names, l["attr"]), F.lit(">="), l["value"].cast("string"))
        return F.when(l["neg"], F.concat(F.lit("not("), plain, F.lit(")"))).otherwise(plain)

    def joined(items: Column, render: Callable[[Column], Column], word: str, empty: str) -> Column:
        wrapped = F.transform(items, lambda item: F.concat(F.lit("("), render(item), F.lit(")")))
        return (
            F.when(F.size(items) == 0, F.lit(empty))
            .when(F.size(items) == 1, render(F.get(items, F.lit(0))))
            .otherwise(F.array_join(wrapped, f" {word} "))
        )

    return joined(dnf, lambda clause: joined(clause, literal, "and", "true"), "or", "false")
