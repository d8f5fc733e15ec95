"""Queries without SQL run at the size that the others are compared at."""

from __future__ import annotations

import pytest

from seqpack.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)) or [pytest.param("", marks=pytest.mark.skip("every query has SQL"))])
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


@pytest.mark.parametrize("name", ["scheduler_replay", "lease_replay", "speculation_replay", "suffix_array_long", "replay_dedupe"])
def test_folds_give_the_rows_of_their_sql_on_longer_logs(spark, name):
    from oracle import compare

    compare(spark, QUERIES[name], ORACLES[name], DATA)
