"""What queries hold and make at larger sizes: rows of joins, parts of shuffles, tiles."""

from __future__ import annotations

import random

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from seqpack.functions import cuts
from seqpack.operators import control, kv, store
from seqpack.registry import ORACLES, QUERIES


def steps(df):
    """The nodes of the plan that df ran by, stages of an adaptive one included."""
    df.collect()

    def walk(node):
        name = node.getClass().getSimpleName()
        yield name, node
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        children = node.children()
        for child in [*inner, *[children.apply(i) for i in range(children.length())]]:
            yield from walk(child)

    return list(walk(df._jdf.queryExecution().executedPlan()))


def joined_rows(df):
    """Rows that the largest join made."""
    found = [node.metrics().apply("numOutputRows").value() for name, node in steps(df) if "Join" in name or "Cartesian" in name]
    return max(found, default=0)


def test_requests_do_not_meet_workers(spark):
    """1,000 workers, none of which beats another everywhere, and 20,000 requests of 50 shapes."""
    w = spark.range(1000).select(F.col("id").alias("worker_id"), F.lit(0).alias("state"), F.lit(False).alias("circuit_open"), F.lit(1).cast("long").alias("model_mask"), (F.col("id") * 10 + 500).alias("prefill_rate"), (F.col("id") + 100).alias("decode_rate"), F.lit(0).cast("long").alias("queue_depth"), F.lit(0).cast("long").alias("active"))
    q = spark.range(20_000).select(F.col("id").alias("request_id"), F.lit(0).cast("long").alias("model_id"), (F.col("id") % 50 * 7 + 20).alias("prompt_tokens"), F.lit(10).cast("long").alias("cached_tokens"), (F.col("id") % 50 + 1).alias("completion_tokens"), F.lit(1).cast("long").alias("deadline"))
    out = control.best_worker(q, w)
    assert joined_rows(out) <= 50 * 1000
    got = {r.request_id: r for r in out.collect()}
    assert len(got) == 20_000
    for i in random.Random(1).sample(range(20_000), 60):
        p, c = (i % 50 * 7 + 10) * 1_000_000, (i % 50 + 1) * 1_000_000
        s, k = min((p // (k * 10 + 500) + c // (k + 100), k) for k in range(1000))
        assert (got[i].worker_id, got[i].score) == (k, s)


@pytest.mark.parametrize("tile", [1 << 20, 64])
def test_attention_over_all_tokens_joins_no_pairs(spark, monkeypatch, tile):
    """Tiles of 16 rows, and one for all; ids leave gaps and come in no order."""
    monkeypatch.setattr(kv, "TILE", tile, raising=False)
    r = np.random.default_rng(5)
    token, x = r.permutation(300) * 3, r.normal(size=(300, 4)) * 3
    h = spark.createDataFrame([(int(t), 0, v, [*v[:3], 1.0]) for t, v in zip(token, x.tolist(), strict=True)], "token long, head long, k array<double>, v array<double>")
    q = spark.createDataFrame([(int(t) + 1, n, v) for t, v in zip(token, x.tolist(), strict=True) for n in (0, 1)], "qpos long, qhead long, q array<double>")
    out = kv.attention(q, h, 0, 4, group=2)
    assert joined_rows(out) <= 600
    got = {(g.qpos, g.qhead): g.out for g in out.collect()}
    assert len(got) == 600
    for (t, _), o in got.items():
        seen = token < t
        s = x[seen] @ x[token == t - 1][0] / 2
        w = np.exp(s - s.max())
        np.testing.assert_allclose(o, [*(w @ x[seen][:, :3] / w.sum()), 1.0], rtol=1e-9, atol=1e-12)


def test_attention_weighs_nothing_unseen(spark):
    """An infinite value at token 2 is no part of what tokens 0 and 1 see."""
    v = [(0, [1.0]), (1, [3.0]), (2, [float("inf")])]
    h = spark.createDataFrame([(t, 0, [0.0], x) for t, x in v], "token long, head long, k array<double>, v array<double>")
    q = spark.createDataFrame([(t, 0, [1.0]) for t in (-1, 0, 1, 2)], "qpos long, qhead long, q array<double>")
    assert {g.qpos: g.out for g in kv.attention(q, h, 0, 1).collect()} == {-1: [0.0], 0: [1.0], 1: [2.0], 2: [float("inf")]}


@pytest.mark.parametrize("odd", [None, "gap", "null", "nan"])
def test_products_join_no_pairs(spark, monkeypatch, odd):
    """Tiles of 16 rows; factors that are missing, null or not a number."""
    monkeypatch.setattr(kv, "FACTORS", 64, raising=False)
    r = np.random.default_rng(7)
    v = {(b, k): float(r.normal()) for b in range(40) for k in range(4)}
    w = {(m, k): (int(r.integers(-8, 8)), float(r.random() + 1)) for m in range(60) for k in range(4)}
    if odd == "gap":
        v = {(b, k): x for (b, k), x in v.items() if b > 1 or k == b}
        w = {(m, k): x for (m, k), x in w.items() if m > 1 or k == m}
    elif odd == "null":
        v |= {(3, k): None for k in range(4)} | {(4, 0): None}
    elif odd == "nan":
        v |= {(3, 0): float("nan")}
        w = {(m, k): x for (m, k), x in w.items() if m != 5 or k > 0}
    i = spark.createDataFrame([(b, k, x) for (b, k), x in v.items()], "b long, k int, v double")
    q = spark.createDataFrame([(m, k, *x) for (m, k), x in w.items()], "m long, k int, q int, s double")
    out = kv.matmul(i, q, 1)
    assert joined_rows(out) <= len(v) + len(w)
    got = {(g.b, g.m): g.y for g in out.collect()}
    expected = {}
    for b in range(40):
        for m in range(60):
            common = [k for k in range(4) if (b, k) in v and (m, k) in w]
            terms = [v[b, k] * (w[m, k][0] - 1) * w[m, k][1] for k in common if v[b, k] is not None]
            if common:
                expected[b, m] = sum(terms) if terms else None
    assert got.keys() == expected.keys()
    assert all(y is None and got[p] is None or y == pytest.approx(got[p], rel=1e-9, abs=1e-9, nan_ok=True) for p, y in expected.items())


def test_products_are_rounded_half_away_from_zero():
    y = np.array([0.5, -0.5, 2.5, 0.49999999999999994, -0.2, 1e300, np.inf, np.nan])
    assert [repr(float(x)) for x in kv.rounded(y, 0)] == ["1.0", "-1.0", "3.0", "0.0", "0.0", "1e+300", "inf", "nan"]
    assert repr(float(kv.rounded(np.array([-0.00004]), 4)[0])) == "0.0"


@pytest.mark.parametrize("name", ["seq_copy", "seq_shift"])
def test_a_task_groups_a_bounded_number_of_references(spark, monkeypatch, name):
    """60,000 line items dealt to parts of about 1,000, though the session has four shuffle partitions."""
    monkeypatch.setattr(cuts, "ROWS", 1000, raising=False)
    out = QUERIES[name](spark, "/root/testdata/sf0.01")
    largest = out.groupBy(F.spark_partition_id().alias("part")).count().agg(F.max("count")).first()[0]
    assert largest <= 2000
    compare(spark, QUERIES[name], ORACLES[name])


def test_a_copy_of_nothing_and_of_null(spark):
    refs = spark.createDataFrame([(3, 0, 0, 4, 1), (3, 0, None, 4, 2), (None, 0, 0, 4, 3), (3, 0, 8, 4, 4)], "seq_id int, layer int, begin long, n long, page_id long")
    out = store.copied(refs, 3, 9, 0, 8)
    assert out.schema["seq_id"].dataType == refs.schema["seq_id"].dataType and out.columns == refs.columns
    assert sorted((r.page_id, r.seq_id or 0) for r in out.collect()) == [(1, 3), (1, 9), (2, 3), (3, 0), (4, 3)]
