"""Generated streams with the shapes that index and codec tests need; every row depends on the seed and its own key alone."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _per_stream(spark: SparkSession, streams: int, schema: str, make) -> DataFrame:
    return spark.range(streams).withColumnRenamed("id", "stream_id").groupBy("stream_id").applyInPandas(lambda pdf: make(int(pdf["stream_id"].iloc[0])), schema)


def markov_runs(spark: SparkSession, streams: int, n: int, symbols: int, seed: int = 0) -> DataFrame:
    """Runs: the last symbol again 60 of 100 times, its neighbours 20 up and 10 down, any symbol 10."""

    def make(s: int) -> pd.DataFrame:
        r = np.random.default_rng([seed, s])
        kind, any_ = r.random(n), r.integers(0, symbols, n)
        step = np.where(kind < 0.6, 0, np.where(kind < 0.8, 1, -1))
        start = np.flatnonzero(np.concatenate([[True], kind[1:] >= 0.9]))
        run = np.cumsum(np.concatenate([[True], kind[1:] >= 0.9])) - 1
        walked = np.cumsum(np.where(kind >= 0.9, 0, step))
        return pd.DataFrame({"stream_id": s, "pos": np.arange(n), "sym": (any_[start][run] + walked - walked[start][run]) % symbols})

    return _per_stream(spark, streams, "stream_id long, pos long, sym int", make)


def markov_dirichlet(spark: SparkSession, streams: int, n: int, symbols: int, alpha: float = 0.1, seed: int = 0) -> DataFrame:
    """A chain over transition rows drawn from a Dirichlet distribution."""

    def make(s: int) -> pd.DataFrame:
        r = np.random.default_rng([seed, s])
        cum = np.cumsum(np.random.default_rng(seed).dirichlet(np.full(symbols, alpha), symbols), 1)
        out, u, at = np.empty(n, int), r.random(n), 0
        for i in range(n):
            at = out[i] = min(symbols - 1, int(np.searchsorted(cum[at], u[i])))
        return pd.DataFrame({"stream_id": s, "pos": np.arange(n), "sym": out})

    return _per_stream(spark, streams, "stream_id long, pos long, sym int", make)


def skewed_values(spark: SparkSession, n: int, peak: float = 0.0, seed: int = 0) -> DataFrame:
    """(idx, v): small values are likelier; with a peak, so many of them are 0."""
    v = F.when(F.rand(seed) < peak, F.lit(0)).otherwise(F.floor(-F.log(1 - F.rand(seed + 1)) * 8).cast("int"))
    return spark.range(n).select(F.col("id").alias("idx"), v.cast("int").alias("v"))


def near_copies(base: DataFrame, leaves: int, share: float, symbols: int, seed: int = 0) -> DataFrame:
    """(leaf, pos, val): deltas of so many leaves against base (pos, val), each position changed with this chance."""
    leaf = base.select("pos", "val", F.explode(F.sequence(F.lit(1), F.lit(leaves))).alias("leaf"))
    roll = F.pmod(F.xxhash64(F.lit(seed), "leaf", "pos"), F.lit(1_000_000)) / 1_000_000
    changed = leaf.where(roll < share).withColumn("new", F.pmod(F.col("val") + 1 + F.pmod(F.xxhash64(F.lit(seed + 1), "leaf", "pos"), F.lit(symbols - 1)), F.lit(symbols)).cast("int"))
    return changed.select(F.col("leaf").cast("long").alias("leaf"), "pos", F.col("new").alias("val"))
