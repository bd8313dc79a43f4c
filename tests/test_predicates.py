import random

import pytest
from pyspark.sql import functions as F

from vectile.functions.predicates import (
    PROGRAM_TYPE, UNBOUNDED_HI, UNBOUNDED_LO, all_of, any_of, as_column, at_least, atomics, between, catalog_truth, dnf_holds, dnf_literal,
    dnf_text, dnf_truth, filter_text, negate, program_holds, program_literal, to_dnf,
    to_program,
)

SAMPLE = all_of(at_least("x", 100), negate(at_least("x", 1001)))
ATTRS = ("x", "y", "z")


def holds(p, row):
    inner = [holds(q, row) for q in p.parts]
    return {"leaf": lambda: row[p.attr] >= p.value, "all": lambda: all(inner), "any": lambda: any(inner), "not": lambda: not inner[0]}[p.kind]()


def truth(p, box):
    """Kleene value in {0: false, 1: maybe, 2: true}."""
    inner = [truth(q, box) for q in p.parts]
    if p.kind == "leaf":
        lo, hi = box[p.attr]
        return 0 if hi < p.value else 2 if lo >= p.value else 1
    return {"all": lambda: min(inner, default=2), "any": lambda: max(inner, default=0), "not": lambda: 2 - inner[0]}[p.kind]()


def random_predicate(rng, depth=3):
    kind = rng.choice(["leaf", "all", "any", "not"]) if depth else "leaf"
    if kind == "leaf":
        return at_least(rng.choice(ATTRS), rng.randrange(0, 10))
    if kind == "not":
        return negate(random_predicate(rng, depth - 1))
    make = all_of if kind == "all" else any_of
    return make(*[random_predicate(rng, depth - 1) for _ in range(rng.randrange(0, 4))])


def test_text_and_atomics():
    assert filter_text(SAMPLE) == "(x >= 100) and (not(x >= 1001))" == str(SAMPLE)
    assert atomics(SAMPLE) == [("x", 100), ("x", 1001)]
    assert filter_text(any_of(at_least("x", 1), at_least("y", 2))) == "(x >= 1) or (y >= 2)"
    assert (filter_text(all_of()), filter_text(any_of())) == ("true", "false")
    assert at_least(1, 2).attr == "1" and at_least("x", 5) == at_least("x", 5) and hash(at_least("x", 5)) == hash(at_least("x", 5))
    assert (at_least("x", 1) & at_least("y", 2)) == all_of(at_least("x", 1), at_least("y", 2))
    assert (at_least("x", 1) | ~at_least("y", 2)) == any_of(at_least("x", 1), negate(at_least("y", 2)))


def test_row_evaluation(spark):
    df = spark.createDataFrame([(500,), (50,), (1001,)], "x int")
    assert [r.x for r in df.filter(as_column(SAMPLE)).collect()] == [500]
    assert [r.x for r in df.filter(filter_text(SAMPLE)).collect()] == [500]
    assert df.filter(as_column(all_of())).count() == 3 and df.filter(as_column(any_of())).count() == 0
    assert df.filter(filter_text(any_of())).count() == 0
    assert [r.x for r in df.filter(as_column(between("x", 50, 500))).collect()] == [500, 50]
    assert df.filter(as_column(between("x", None, None))).count() == 3


def test_range_truth(spark):
    boxes = spark.createDataFrame([(500, 1000), (50, 200), (0, 10)], "lo_x int, hi_x int")
    assert [r.t for r in boxes.select(catalog_truth(SAMPLE, ["x"]).alias("t")).collect()] == [True, None, False]
    assert boxes.select(catalog_truth(at_least("q", 1), ["x"]).alias("t")).first().t is None


def test_kleene_tables(spark):
    rows = spark.sql("SELECT a, b FROM VALUES (true), (false), (null) x(a), VALUES (true), (false), (null) y(b)")
    got = {(r.a, r.b): (r.c, r.d, r.e) for r in rows.select("a", "b", (F.col("a") & F.col("b")).alias("c"), (F.col("a") | F.col("b")).alias("d"), (~F.col("a")).alias("e")).collect()}
    T, N, M = True, False, None
    assert got[T, M] == (M, T, N) and got[N, M] == (N, M, T) and got[M, M] == (M, M, M)


def test_random_predicates_agree_in_every_form(spark):
    rng = random.Random(5)
    preds = [random_predicate(rng) for _ in range(60)]
    rows = [(i, *[rng.randrange(0, 11) for _ in ATTRS]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, x int, y int, z int")
    values = F.array(*ATTRS)
    columns = [as_column(p).alias(f"p{i}") for i, p in enumerate(preds)] + [dnf_holds(dnf_literal(p, ATTRS), values).alias(f"d{i}") for i, p in enumerate(preds)]
    for r in df.select("*", *columns).collect():
        row = r.asDict()
        for i, p in enumerate(preds):
            assert row[f"p{i}"] == row[f"d{i}"] == holds(p, row), (filter_text(p), row)
    boxes = []
    for i in range(40):
        b = []
        for _ in ATTRS:
            lo, hi = sorted((rng.randrange(0, 11), rng.randrange(0, 11)))
            b += [rng.choice([lo, UNBOUNDED_LO]), rng.choice([hi, UNBOUNDED_HI])]
        boxes.append((i, *b))
    cat = spark.createDataFrame(boxes, "id int, lo_x int, hi_x int, lo_y int, hi_y int, lo_z int, hi_z int")
    lo, hi = F.array("lo_x", "lo_y", "lo_z"), F.array("hi_x", "hi_y", "hi_z")
    columns = [catalog_truth(p, ATTRS).alias(f"p{i}") for i, p in enumerate(preds)] + [dnf_truth(dnf_literal(p, ATTRS), lo, hi).alias(f"d{i}") for i, p in enumerate(preds)]
    for r in cat.select("*", *columns).collect():
        row = r.asDict()
        box = {a: (row[f"lo_{a}"], row[f"hi_{a}"]) for a in ATTRS}
        for i, p in enumerate(preds):
            want = (False, None, True)[truth(p, box)]
            assert row[f"p{i}"] == want and row[f"d{i}"] == want, (filter_text(p), box)


def test_dnf_text_and_limits(spark):
    p = any_of(all_of(at_least("x", 1), negate(at_least("y", 2))), at_least("z", 3))
    one = spark.range(1)
    text = lambda q: one.select(dnf_text(dnf_literal(q, ATTRS), ATTRS).alias("t")).first().t
    assert text(p) == "((x >= 1) and (not(y >= 2))) or (z >= 3)"
    assert (text(all_of()), text(any_of()), text(at_least("x", 7))) == ("true", "false", "x >= 7")
    wide = all_of(*[any_of(*[at_least("x", i * 10 + j) for j in range(4)]) for i in range(8)])
    with pytest.raises(ValueError):
        to_dnf(wide, ATTRS)


def test_programs_equal_columns_without_expansion(spark):
    rows = spark.createDataFrame([(x, y) for x in (None, 0, 5, 9, 40) for y in (None, 1, 5, 200)], "x int, y int")
    knotty = all_of(*[any_of(at_least("x", i), negate(at_least("y", 9 * i))) for i in range(13)])
    assert len(to_program(knotty, "xy")) == 13 * 4 + 1
    filters = [all_of(), any_of(), at_least("x", 5), negate(any_of(at_least("x", 5), at_least("y", 5))), knotty, negate(knotty), any_of(all_of(), at_least("y", 3))]
    values = F.array("x", "y")
    for p in filters:
        got = rows.select(program_holds(program_literal(p, "xy"), values).alias("got"), as_column(p).alias("want")).collect()
        assert all(r.got == r.want for r in got), p
    assert rows.filter(program_holds(F.lit(None).cast(PROGRAM_TYPE), values)).count() == 20
