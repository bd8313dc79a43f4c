"""Predicates, three-valued logic, workloads and attribute columns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from suite.tables import (
    ATTRS, BASE, BOXES, EXAMPLE, EXAMPLE_SQL, ITEMS, base, boxes_by_order, combine_sql, filters_of, filters_sql, holds_sql,
    items, portable_uniform, rounded, table, uniform_sql, workload,
)
from vectile.functions.predicates import (
    all_of, any_of, as_column, at_least, between, catalog_truth, dnf_holds, dnf_text, filter_text, negate, program_holds,
    program_literal,
)
from vectile.operators import attributes as attr_ops
from vectile.operators import workload as wl
from vectile.operators.attributes import with_uniform_attributes
from vectile.operators.catalog import atom_selectivity, selectivity
from vectile.plans.pipelines import fixed_selectivity_queries

LINE = ("l_orderkey", "l_linenumber", "l_partkey")
LINE_SQL = ", ".join(LINE)
KLEENE = lambda c: F.coalesce(c.cast("string"), F.lit("maybe"))
KLEENE_SQL = lambda e: f"coalesce(CAST({e} AS VARCHAR), 'maybe')"
T_SQL = lambda a, v: f"(CASE WHEN hi_{a} < {v} THEN false WHEN lo_{a} >= {v} THEN true END)"


def _filtered(predicate):
    return lambda spark, sf: items(spark, sf, *LINE).filter(as_column(predicate))


def _filtered_sql(condition):
    return f"WITH {ITEMS} SELECT {LINE_SQL}, w, x, y, z FROM items WHERE {condition}"


def filter_data_predicates(spark, sf):
    """Line items that pass the filter of their own order."""
    lines = items(spark, sf, *LINE)
    joined = lines.join(workload(spark, sf), lines["l_orderkey"] == F.col("qid"))
    held = F.col("dnf").isNull() | dnf_holds(F.col("dnf"), F.array(*ATTRS))
    return joined.filter(held).select(*LINE, *ATTRS, "kind")


def predicate_text(spark, sf):
    return workload(spark, sf).select("qid", "kind", F.coalesce(dnf_text(F.col("dnf"), ATTRS), F.lit("")).alias("text"))


def _text_sql():
    name = lambda j: f"CASE a{j} WHEN 0 THEN 'w' WHEN 1 THEN 'x' WHEN 2 THEN 'y' ELSE 'z' END || ' >= ' || v{j}"
    t = lambda j: f"(CASE WHEN neg{j} THEN 'not(' || {name(j)} || ')' ELSE {name(j)} END)"
    joined = lambda word: f"'(' || {t(0)} || ') {word} (' || {t(1)} || ')' || CASE WHEN n > 2 THEN ' {word} (' || {t(2)} || ')' ELSE '' END"
    return f"""WITH {filters_sql("orders", "o_orderkey")}
SELECT qid, kind, CASE WHEN kind = 'none' THEN '' WHEN n = 0 AND kind = 'or' THEN 'false' WHEN n = 0 THEN 'true' WHEN n = 1 THEN {t(0)}
  WHEN kind = 'or' THEN {joined("or")} ELSE {joined("and")} END AS text FROM wide"""


def explode_atomics(spark, sf):
    return wl.explode_atomics(workload(spark, sf), ATTRS)


ATTR_NAME = "CASE a WHEN 0 THEN 'w' WHEN 1 THEN 'x' WHEN 2 THEN 'y' ELSE 'z' END"


def tvl_truth_table(spark, sf):
    """Both operands are truths of an order's attribute ranges, so all nine cases occur in the data."""
    a = catalog_truth(at_least("w", 300), ATTRS)
    b = catalog_truth(at_least("x", 500), ATTRS)
    pairs = boxes_by_order(spark, sf).select(a.alias("p"), b.alias("q"))
    out = pairs.select(*[KLEENE(c).alias(n) for c, n in (
        (F.col("p"), "a"), (F.col("q"), "b"), (F.col("p") & F.col("q"), "a_and_b"), (F.col("p") | F.col("q"), "a_or_b"), (~F.col("p"), "not_a"))])
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


def range_satisfy_atomic(spark, sf):
    truths = {f"{a}_{v}": catalog_truth(at_least(a, v), ATTRS) for a, v in (("w", 300), ("x", 500), ("z", 400))}
    return boxes_by_order(spark, sf).select("part", *[KLEENE(t).alias(n) for n, t in truths.items()])


#: Not satisfiable, yet each part may hold: conjunctions are not reasoned about across literals.
CONTRADICTION = all_of(at_least("x", 500), negate(at_least("x", 100)))


def range_satisfy_bool(spark, sf):
    truths = {"example": EXAMPLE, "contradiction": CONTRADICTION, "nothing": any_of(), "everything": all_of(), "unknown": at_least("other", 1)}
    return boxes_by_order(spark, sf).select("part", *[KLEENE(catalog_truth(p, ATTRS)).alias(n) for n, p in truths.items()])


SELECTIVITIES = (0.01, 0.1, 0.5, 0.9)


def filter_selectivity(spark, sf):
    tests = {str(s): negate(at_least("x", int(1000 * s) + 1)) for s in SELECTIVITIES}
    return rounded(selectivity(items(spark, sf), tests), selectivity=9)


def predicate_selectivity(spark, sf):
    """Share of line items that pass each atomic predicate of the workload."""
    atoms = wl.atom_list(wl.characterize(wl.explode_atomics(workload(spark, sf), ATTRS)))
    shares = atom_selectivity(items(spark, sf), [(a, v) for a, v, _ in atoms])
    return rounded(shares.select(F.concat_ws(" >= ", "attr", "value").alias("predicate"), "selectivity"), selectivity=9)


#: Thirteen alternatives joined by AND: 2^13 clauses in disjunctive form, 39 steps as a program.
KNOTTY = all_of(*[any_of(at_least(ATTRS[i % 4], 40 * i), negate(at_least(ATTRS[(i + 1) % 4], 700 - 30 * i))) for i in range(13)], negate(all_of(at_least("w", 900), any_of())))
KNOTTY_SQL = " AND ".join(f"({ATTRS[i % 4]} >= {40 * i} OR NOT {ATTRS[(i + 1) % 4]} >= {700 - 30 * i})" for i in range(13))


def filter_programs(spark, sf):
    """A filter carried as a postfix program, beside the same filter as a column."""
    values = F.array(*[F.col(a) for a in ATTRS])
    rows = items(spark, sf, *LINE).withColumn("program", program_literal(KNOTTY, ATTRS))
    return rows.filter(program_holds(F.col("program"), values)).select(*LINE, *ATTRS, as_column(KNOTTY).alias("as_column"))


def filter_fraction(spark, sf):
    queries = table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"))
    out = fixed_selectivity_queries(queries, ATTRS, "x", 1000, 0.1, 0.5, uniform=portable_uniform)
    return out.select("qid", "filter_used", F.coalesce(dnf_text(F.col("dnf"), ATTRS), F.lit("")).alias("text"))


def characterize_workload(spark, sf):
    return wl.characterize(explode_atomics(spark, sf))


CHARACTERIZE = f"""atoms AS (SELECT {ATTR_NAME} AS attr, value, count(*) AS freq,
  min(qid * 10 + pos) AS first FROM lits GROUP BY 1, 2)"""

RANK_COLUMNS = ("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")


def workload_params(spark, sf):
    """Exponential weights over the distinct values of several columns."""
    lines = table(spark, sf, "lineitem").select(*[F.col(c).cast("string").alias(c) for c in RANK_COLUMNS])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in RANK_COLUMNS])).alias("p")
    values = lines.select(pairs).select("p.*").distinct()
    ranks = values.select("name", (F.row_number().over(Window.partitionBy("name").orderBy("v")) - 1).alias("choice"))
    return rounded(wl.exponential_weights(ranks, F.lit(0.25)), weight=9)


SAMPLE_PARAMS = wl.WorkloadParams(
    ATTRS, (0.4, 0.3, 0.2, 0.1), ((0.2, 0.15, 0.15, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05),) * 4, (0.1, 0.4, 0.3, 0.2)
)


def sample_workload(spark, sf):
    """One sampled filter per order, as text."""
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"))
    drawn = wl.sample_workload(keys, SAMPLE_PARAMS, uniform=portable_uniform)
    return drawn.select("qid", "kind", F.coalesce(dnf_text(F.col("dnf"), ATTRS), F.lit("")).alias("text"))


def _choose_sql(u, weights):
    total = sum(weights)
    return "(" + " + ".join(f"CAST({u} >= {sum(weights[: i + 1]) / total!r}::DOUBLE AS INTEGER)" for i in range(len(weights) - 1)) + ")"


def _sample_sql():
    p, k = SAMPLE_PARAMS, "o_orderkey"
    race = " UNION ALL ".join(
        f"SELECT {k} AS qid, {i} AS a, -ln({uniform_sql(k, 10 + i)}) / {w!r}::DOUBLE AS t, "
        f"100 * (1 + {_choose_sql(uniform_sql(k, 20 + i), p.threshold_weights[i])}) AS v FROM orders"
        for i, w in enumerate(p.attr_weights)
    )
    return f"""WITH race AS ({race}),
placed AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY t, a) - 1 AS pos, {ATTR_NAME} || ' >= ' || v AS txt FROM race),
drawn AS (SELECT {k} AS qid, CASE {_choose_sql(uniform_sql(k, 0), p.kind_weights)} WHEN 0 THEN 'none' WHEN 1 THEN 'single' WHEN 2 THEN 'and' ELSE 'or' END AS kind,
  {_choose_sql(uniform_sql(k, 1), p.length_weights)} AS len FROM orders),
taken AS (SELECT d.qid, d.kind, CASE d.kind WHEN 'single' THEN 1 ELSE len END AS n, pos, txt FROM drawn d JOIN placed p ON d.qid = p.qid)
SELECT qid, kind, CASE WHEN max(n) = 0 THEN CASE kind WHEN 'or' THEN 'false' ELSE 'true' END
  WHEN max(n) = 1 THEN max(txt) FILTER (WHERE pos = 0)
  WHEN kind = 'or' THEN string_agg('(' || txt || ')', ' or ' ORDER BY pos) FILTER (WHERE pos < n)
  ELSE string_agg('(' || txt || ')', ' and ' ORDER BY pos) FILTER (WHERE pos < n) END AS text
FROM taken GROUP BY qid, kind"""


def _attribute(expr):
    def run(spark, sf):
        k = F.col("o_orderkey")
        u, v = portable_uniform(k, 1), portable_uniform(k, 2)
        return table(spark, sf, "orders").select(k.alias("id"), expr(u, v).alias("value"))

    return run


U, V = uniform_sql("o_orderkey", 1), uniform_sql("o_orderkey", 2)


def attr_histogram(spark, sf):
    return attr_ops.histogram(items(spark, sf), "x", 0, 1000, 10)


QUERIES = {
    "filter_atomic": (_filtered(at_least("w", 500)), _filtered_sql("w >= 500")),
    "filter_and": (_filtered(all_of(at_least("w", 200), at_least("x", 300), all_of())), _filtered_sql("w >= 200 AND x >= 300")),
    "filter_or": (_filtered(any_of(at_least("w", 900), at_least("y", 950), any_of())), _filtered_sql("w >= 900 OR y >= 950")),
    "filter_not": (_filtered(negate(EXAMPLE)), _filtered_sql(f"NOT {EXAMPLE_SQL}")),
    "filter_example": (_filtered(EXAMPLE), _filtered_sql(EXAMPLE_SQL)),
    "filter_by_text": (lambda spark, sf: items(spark, sf, *LINE).filter(filter_text(EXAMPLE)), _filtered_sql(EXAMPLE_SQL)),
    "range_contains": (_filtered(between("x", 100, 499)), _filtered_sql("x BETWEEN 100 AND 499")),
    "filter_data_predicates": (
        filter_data_predicates,
        f"WITH {ITEMS}, {filters_sql('orders', 'o_orderkey')} SELECT {LINE_SQL}, w, x, y, z, kind FROM items JOIN wide ON l_orderkey = qid WHERE {holds_sql()}",
    ),
    "predicate_text": (predicate_text, _text_sql()),
    "explode_atomics": (explode_atomics, f"WITH {filters_sql('orders', 'o_orderkey')} SELECT qid, CAST(pos AS INTEGER) AS pos, {ATTR_NAME} AS attr, value FROM lits"),
    "tvl_truth_table": (
        tvl_truth_table,
        f"""WITH {ITEMS}, {BOXES}, t AS (SELECT {T_SQL('w', 300)} AS p, {T_SQL('x', 500)} AS q FROM boxes)
SELECT {KLEENE_SQL('p')} AS a, {KLEENE_SQL('q')} AS b, {KLEENE_SQL('(p AND q)')} AS a_and_b, {KLEENE_SQL('(p OR q)')} AS a_or_b, {KLEENE_SQL('(NOT p)')} AS not_a, count(*) AS n
FROM t GROUP BY ALL""",
    ),
    "range_satisfy_atomic": (
        range_satisfy_atomic,
        f"WITH {ITEMS}, {BOXES} SELECT part, {KLEENE_SQL(T_SQL('w', 300))} AS w_300, {KLEENE_SQL(T_SQL('x', 500))} AS x_500, {KLEENE_SQL(T_SQL('z', 400))} AS z_400 FROM boxes",
    ),
    "range_satisfy_bool": (
        range_satisfy_bool,
        f"""WITH {ITEMS}, {BOXES} SELECT part, {KLEENE_SQL(f"(({T_SQL('y', 200)} AND NOT {T_SQL('y', 250)}) OR NOT {T_SQL('x', 400)})")} AS example,
{KLEENE_SQL(f"({T_SQL('x', 500)} AND NOT {T_SQL('x', 100)})")} AS contradiction, 'false' AS nothing, 'true' AS everything, 'maybe' AS unknown FROM boxes""",
    ),
    "filter_selectivity": (
        filter_selectivity,
        f"WITH {ITEMS} " + " UNION ALL ".join(f"SELECT '{s}' AS predicate, round(avg(CASE WHEN NOT (x >= {int(1000 * s) + 1}) THEN 1 ELSE 0 END), 9) AS selectivity FROM items" for s in SELECTIVITIES),
    ),
    "predicate_selectivity": (
        predicate_selectivity,
        f"""WITH {ITEMS}, {filters_sql('orders', 'o_orderkey')}, atoms AS (SELECT DISTINCT a, value FROM lits)
SELECT {ATTR_NAME} || ' >= ' || value AS predicate, round(avg(CASE WHEN CASE a WHEN 0 THEN w WHEN 1 THEN x WHEN 2 THEN y ELSE z END >= value THEN 1 ELSE 0 END), 9) AS selectivity
FROM atoms CROSS JOIN items GROUP BY a, value""",
    ),
    "filter_programs": (filter_programs, f"WITH {ITEMS} SELECT {LINE_SQL}, w, x, y, z, true AS as_column FROM items WHERE {KNOTTY_SQL}"),
    "filter_fraction": (
        filter_fraction,
        f"SELECT vec_id AS qid, {uniform_sql('vec_id', 0)} <= 0.5 AS filter_used, CASE WHEN {uniform_sql('vec_id', 0)} <= 0.5 THEN 'not(x >= 101)' ELSE '' END AS text FROM embeddings",
    ),
    "characterize_workload": (
        characterize_workload,
        f"WITH {filters_sql('orders', 'o_orderkey')}, {CHARACTERIZE} SELECT attr, value, freq, first // 10 AS first_qid, CAST(first % 10 AS INTEGER) AS first_pos FROM atoms",
    ),
    "workload_params": (
        workload_params,
        "WITH v AS (" + " UNION ".join(f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS v FROM lineitem" for c in RANK_COLUMNS) + """),
r AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY v) - 1 AS choice FROM v)
SELECT name, CAST(choice AS INTEGER) AS choice, round(exp(-0.25 * choice) / sum(exp(-0.25 * choice)) OVER (PARTITION BY name), 9) AS weight FROM r""",
    ),
    "sample_workload": (sample_workload, _sample_sql()),
    "attr_uniform": (_attribute(lambda u, v: attr_ops.uniform_attribute(u, 0, 1000)), f"SELECT o_orderkey AS id, CAST(trunc(1000 * {U}) AS INTEGER) AS value FROM orders"),
    "attr_geometric": (
        _attribute(lambda u, v: attr_ops.geometric_attribute(u, 0.005)),
        f"SELECT o_orderkey AS id, greatest(1, CAST(ceil(ln(1 - {U}) / ln(1.0::DOUBLE - 0.005::DOUBLE)) AS INTEGER)) AS value FROM orders",
    ),
    "attr_normal": (
        _attribute(lambda u, v: attr_ops.normal_attribute(u, v, 500, 150)),
        f"SELECT o_orderkey AS id, CAST(trunc(500 + 150 * (sqrt(-2 * ln({U})) * cos(2 * pi() * {V}))) AS INTEGER) AS value FROM orders",
    ),
    "attr_hash": (
        lambda spark, sf: with_uniform_attributes(base(spark, sf).select("id"), ATTRS, 1000, uniform=portable_uniform),
        f"SELECT vec_id AS id, {', '.join(f'CAST(trunc(1000.0 * {uniform_sql('vec_id', i)}) AS INTEGER) AS {a}' for i, a in enumerate(ATTRS))} FROM embeddings",
    ),
    "attr_histogram": (
        attr_histogram,
        f"WITH {ITEMS} SELECT least(98, x // 10)::INTEGER AS bin, (least(98, x // 10) * 10)::INTEGER AS lo, count(*) AS n FROM items WHERE x BETWEEN 0 AND 990 GROUP BY ALL",
    ),
}
