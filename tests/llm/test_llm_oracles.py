"""Training-data queries that have SQL give the rows of their SQL."""

from __future__ import annotations

import pytest
from oracle import compare

from seqpack.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])
