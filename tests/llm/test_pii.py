"""Base spans against the plain patterns, the trees against hand counts, and redaction."""

import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectile.llm.pii import FEATURES, KINDS, SpanModel, Tree, boost, find_personal_data, fit_spans, redact, threshold

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("base", T.StringType()), T.StructField("row", T.StringType())])
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return [(i, m.start(), m.end()) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if passes(k, m.group())]


def texts():
    draw = random.Random(11)
    out = [None, "", "a@b.c_d@e.f @x.y a@@b.c a@b", "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111-1 5 4111111111111111",
           "+1 (279) 555-0024 +12 3 +1--2 ++44 20 7946 0958x +123456789012345678", "é𝒳 mail@é.de 日本 1.1.1.1𝒳 ", "12--34 5 6-7 " * 50, "1" * 20_000, "a" * 200_000 + "@", "1." * 50_000, "a@b.co " * 3000, "+" * 5000 + "1" * 5000]
    for _ in range(1500):
        alphabet = draw.choice(["0123456789. -", "0123456789 -()+.", "ab@.-_+ 1", "a1@. é+-(\n"])
        out.append("".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))))
    for _ in range(300):
        digits = "".join(str(draw.randint(0, 9)) for _ in range(draw.randint(14, 20)))
        out.append(draw.choice(["x", "", " "]) + re.sub("(.{4})", lambda m: m[1] + draw.choice(["", " ", "-", ""]), digits) + draw.choice(["y", "", " 5", "-"]))
    return out


def test_base_spans_equal_the_plain_patterns(spark):
    data = [(i, t, "c", "c") for i, t in enumerate(texts())] + [(None, "x@y.z", None, None)] * 2
    rows = find_personal_data(spark.createDataFrame(data, DOCS).repartition(8), SpanModel()).collect()
    got = {r.doc_id: [tuple(s) for s in r.base] for r in rows}
    assert len(rows) == len(data)
    for i, t, _, _ in data:
        assert got[i] == plain(t), t
    assert all(r.base == r.spans for r in rows)


def test_boosting_separates_counts():
    x = lambda **k: tuple(k.get(f, 0) for f in FEATURES)
    table = {x(kind=3, digits=10): (90, 2), x(kind=3, digits=7): (1, 80), x(kind=2, digits=16, context=2): (40, 0), x(kind=2, digits=16): (5, 60)}
    trees = boost(table)
    score = lambda k: sum(t.score(k) for t in trees)
    assert all((score(k) > 0) == (yes > no) for k, (yes, no) in table.items())


def sample(spark):
    draw = random.Random(5)
    rows = []
    for i in range(400):
        n = f"({draw.randint(200, 999)}) 555-{draw.randint(0, 9999):04}"
        rows.append((i, f"please call me on phone +1 {n} soon" if i % 4 else f"please call me on phone 1 {n} soon", "", ""))
        rows.append((1000 + i, f"the order has number {draw.randint(10**12, 10**13)} today and 12.5 more", "", ""))
    return spark.createDataFrame(rows, DOCS)


def test_thresholds_add_spans_that_look_like_base_ones(spark):
    df = sample(spark)
    model = fit_spans(df, precision=0.7)
    found = {r.doc_id: r for r in find_personal_data(df, model).collect()}
    assert all(found[i].base == [] and [KINDS[s.kind] for s in found[i].spans] == ["phone"] for i in range(0, 400, 4))
    assert all(set(r.base) <= set(r.spans) for r in found.values())
    assert all(found[1000 + i].spans == [] for i in range(400))


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.co, 1.2.3.4!", "b", "r"), (2, None, None, None), (3, "+1 279 555 0024", "", ""), (3, "nothing", "", "")], DOCS)
    assert [tuple(r) for r in redact(df, SpanModel()).orderBy("doc_id", "text").collect()] == [(1, "é <email>, <ip>!", "b", "r"), (2, None, None, None), (3, "<phone>", "", ""), (3, "nothing", "", "")]


def test_no_python_and_empty_table(spark):
    df = sample(spark)
    plan = redact(df, fit_spans(df))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    assert find_personal_data(df.limit(0)).collect() == [] and redact(df.limit(0)).collect() == []


def luhn_number(draw, prefix, length):
    body = prefix + "".join(str(draw.randint(0, 9)) for _ in range(length - len(prefix) - 1))
    return next(body + c for c in "0123456789" if sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(body + c))) % 10 == 0)


def unmatched_by_base(n):
    """(kind or None, text): what the base patterns miss, by kind, among texts that only look like it."""
    draw = random.Random(3)
    part = lambda: f"{draw.randint(0, 65535):x}"
    number = lambda: f"({draw.randint(200, 999)}) 555-{draw.randint(0, 9999):04}"
    for i in range(n):
        yield 0, f"please write to user{i} (at) mail{i % 9} (dot) example (dot) com for more"
        yield None, f"they look at noon{i} dot the end and then"
        yield 1, f"the route of {':'.join(part() for _ in range(8))} is up"
        yield None, f"it ran from 12:{i % 60:02}:45:{draw.randint(0, 99):02} and on"
        yield 2, f"paid by {luhn_number(draw, '37', 15)} again"
        yield None, f"the order has number {draw.randint(7 * 10**14, 8 * 10**14)} today"
        yield 3, f"ring 1 {number()} after nine"
        yield None, f"ring +1 {number()} after nine"


def test_every_generator_adds_spans_with_the_production_parameters(spark):
    cases = list(unmatched_by_base(200))
    df = spark.createDataFrame([(i, t, "", "") for i, (_, t) in enumerate(cases)], DOCS).repartition(4)
    added = {r.doc_id: {s.kind for s in set(r.spans) - set(r.base)} for r in find_personal_data(df).collect()}
    for kind in range(len(KINDS)):
        hit = [kind in added[i] for i, (k, _) in enumerate(cases) if k == kind]
        assert sum(hit) >= 0.9 * len(hit), KINDS[kind]
    wrong = sum(bool(added[i]) for i, (k, _) in enumerate(cases) if k is None)
    assert wrong <= 0.05 * sum(map(len, added.values()))


def test_the_best_of_overlapping_candidates_stays(spark):
    by_kind = Tree(0.0, FEATURES.index("kind"), 2, Tree(2.0), Tree(1.0))  # a card is better than a phone
    texts = ["x 378282246310005 y", "x 279 555 0024 y", "a@b.co 378282246310005 +1 279 555 0024", "4111111111111112"]
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in find_personal_data(df, SpanModel([by_kind], (0.0,) * 4)).collect()}
    assert found[0] == [(2, 2, 17)] and found[1] == [(3, 2, 14)]
    assert found[2] == [(0, 0, 6), (2, 7, 22), (3, 23, 38)]
    other = Tree(0.0, FEATURES.index("kind"), 2, Tree(1.0), Tree(2.0))
    assert [tuple(s) for s in find_personal_data(df.where("doc_id = 0"), SpanModel([other], (0.0,) * 4)).first().spans] == [(3, 2, 17)]


def test_rare_kinds_count_in_a_large_table(spark):
    """60 of 60,000 documents hold a kind: a sample of about 20,000 left a threshold without support."""
    rare = spark.createDataFrame([(i, "the route of " + ":".join(f"{(i * 7919 + k * 104729) % 65536:x}" for k in range(8)) + " is up", "", "") for i in range(60)], DOCS)
    rest = spark.range(60, 60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("nothing here "), "id").alias("text"), F.lit("").alias("base"), F.lit("").alias("row"))
    model = fit_spans(rare.unionByName(rest), support=20)
    assert model.thresholds[KINDS.index("ip")] < float("inf")


def harmless(n):
    """Numbers that are no personal data, beside words or in layouts that telephone numbers have too."""
    draw = random.Random(17)
    for i in range(n):
        yield f"mobile sales reached {draw.randint(10**7, 10**8 - 1)} units"
        yield f"they call the recall of lot {draw.randint(10**11, 10**12 - 1)}"
        yield f"version 1 ({draw.randint(200, 999)}) 555-{draw.randint(0, 9999):04} of the part list"
        yield f"it ran from 12:{i % 60:02}:45:{draw.randint(0, 99):02} and on"
        yield f"they look at noon{i} dot the end and then"


def test_harmless_numbers_stay(spark):
    draw = random.Random(23)
    number = lambda: f"({draw.randint(200, 999)}) 555-{draw.randint(0, 9999):04}"
    for bare in (0, 40):  # percent of the real numbers without a plus
        real = [f"ring my phone {'' if draw.randint(0, 99) < bare else '+'}1 {number()} after nine" for _ in range(300)]
        plain_texts = list(harmless(300))
        df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(real + plain_texts)], DOCS).repartition(4)
        found = {r.doc_id: r for r in find_personal_data(df).collect()}
        assert not any(found[i].spans for i in range(300, 300 + len(plain_texts)))
        assert sum(bool(found[i].spans) for i in range(300)) >= 0.95 * 300, bare


def test_threshold_against_counts():
    level = lambda yes, n, new: (yes, n, 0, new)
    # Every second true number shows its plus, at both margins: both are right. The third margin has none.
    assert threshold({2.0: level(50, 100, 50), 1.0: level(40, 80, 40), 0.0: level(0, 500, 500)}, 0.95, 20, 0.3) == 1.0
    # Where nearly all true numbers show it, a margin where half do is half right.
    assert threshold({2.0: level(1000, 1000, 0), 1.0: level(100, 200, 100)}, 0.95, 20, 0.3) == 2.0
    # Evidence that few candidates have says nothing; neither do too few candidates, nor none.
    assert threshold({2.0: level(10, 1000, 990)}, 0.95, 20, 0.3) == float("inf")
    assert threshold({2.0: level(19, 19, 0)}, 0.95, 20, 0.3) == threshold({}, 0.95, 20, 0.3) == threshold({}, 0.95, 20) == float("inf")
    # Whole evidence counts itself, and those that would be added count alone as well.
    assert threshold({2.0: (96, 100, 96, 100), 1.0: (900, 900, 0, 0), 0.0: (10, 20, 5, 10)}, 0.95, 20) == 1.0
    assert threshold({2.0: (990, 1000, 1, 5)}, 0.95, 20) == float("inf")
