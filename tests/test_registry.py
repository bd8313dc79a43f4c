import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from check import compare  # noqa: E402


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["qid", "id", "rank", "dist"] and frame.limit(1).count() == 1


def test_every_query_has_a_twin():
    without = entry.queries().keys() - entry.oracle_sql().keys()
    optional = {name for name in without if re.match(r"op\d+_|pipeline$", name)}  # tested with their own package
    assert not without - optional


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, sf, name):
    result = compare(spark, sf, name)
    assert result.startswith(("ok", "rows")), result
