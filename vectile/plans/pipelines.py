"""End-to-end plans: lay out a collection for a workload, search it with a table of queries, score the run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectile.functions.predicates import at_least, dnf_literal, negate
from vectile.functions.vectors import hash_uniform
from vectile.operators.catalog import Catalog
from vectile.operators.evaluation import confusion, recall
from vectile.operators.search import SearchLimits, search
from vectile.operators.tree import Tree, TreeParams, build_tree
from vectile.operators.workload import Uniform, atom_list, characterize, explode_atomics


def plan_layout(base: DataFrame, workload: DataFrame, attrs: Sequence[str], params: TreeParams = TreeParams()) -> Tree:
    """The partition tree for the rows of ``base`` and the filters of ``workload``."""
    atoms = atom_list(characterize(explode_atomics(workload, attrs)), params.min_predicate_frequency)
    return build_tree(base, attrs, atoms, params)


def pruned_search(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    catalog: Catalog,
    limits: SearchLimits = SearchLimits(),
    seed: DataFrame | None = None,
) -> DataFrame:
    """Top-k per query where each query reads only the partitions its filter may match.

    ``base`` carries ``part``; the result equals the unpruned search.
    """
    return search(base, catalog.with_part_sets(queries), k, catalog.attrs, limits, seed, catalog.names)


def fixed_selectivity_queries(
    queries: DataFrame, attrs: Sequence[str], attr: str, maximum: int, share: float, filtered: float, uniform: Uniform = hash_uniform
) -> DataFrame:
    """Queries of which a fraction ``filtered`` gets ``not(attr >= int(maximum * share) + 1)``."""
    limit = dnf_literal(negate(at_least(attr, int(maximum * share) + 1)), attrs)
    used = uniform(F.col("qid"), 0) <= F.lit(filtered)
    return queries.withColumn("filter_used", used).withColumn("dnf", F.when(F.col("filter_used"), limit))


def score(truth: DataFrame, results: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, tp, fp, fn, recall) for every query, those without truth or results included."""
    return confusion(truth, results, queries).withColumn("recall", recall(F.col("tp"), F.col("fn")))
