"""Streams over files that are added one by one."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from seqpack.streaming import streams


def run(spark, tmp_path, schema, files, make, name):
    src = tmp_path / name
    src.mkdir()
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    q = make(df).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    try:
        q.processAllAvailable()
        return sorted(map(tuple, spark.table(name).collect()), key=repr)
    finally:
        q.stop()


def test_pages_are_sealed_and_gaps_refused(spark, tmp_path):
    files = [[(1, 0, "a"), (1, 1, "b"), (2, 1, "x")], [(1, 2, "c"), (1, 3, "d"), (1, 1, "b")]]
    out = run(spark, tmp_path, "stream_id long, pos long, sym string", files, lambda s: streams.append_seal(s, 2), "sealed")
    assert out == [(1, 0, 1, "b", "duplicate"), (1, 0, 2, "a b", "sealed"), (1, 1, 2, "c d", "sealed"), (2, 0, 1, "x", "gap")]


def test_any_symbol_stays_in_the_tail(spark, tmp_path):
    files = [[(1, 0, ""), (1, 1, "x\x1fy")], [(1, 2, None), (1, 3, "d"), (1, 4, "")], [(1, 5, ""), (1, 6, "e"), (1, 7, "f")]]
    out = run(spark, tmp_path, "stream_id long, pos long, sym string", files, lambda s: streams.append_seal(s, 4), "tail")
    assert out == [(1, 0, 4, " x\x1fy d", "sealed"), (1, 1, 4, "  e f", "sealed")]


def test_tokens_are_fresh_once(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    files = [[("n1", at), ("n1", at)], [("n1", at + dt.timedelta(seconds=5)), ("n2", at)]]
    out = run(spark, tmp_path, "nonce string, at timestamp", files, lambda s: streams.fresh(s, "nonce", "at", "1 minute").select("nonce"), "fresh")
    assert out == [("n1",), ("n2",)]


def test_sliding_windows_close(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    files = [[(at + dt.timedelta(minutes=m), float(m)) for m in range(10)], [(at + dt.timedelta(hours=2), 0.0)], [(at + dt.timedelta(hours=4), 0.0)]]
    out = run(spark, tmp_path, "at timestamp, value double", files, lambda s: streams.sliding_p95(s, "at", "value", "10 minutes", "5 minutes", "1 minute").select("n", F.col("p95")), "sliding")
    assert (10, 9.0) in out and (5, 4.0) in out


def test_keys_and_values_meet(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(0, 1, "k", at, "K"), (0, 1, "v", at, "V"), (0, 2, "k", at, "lonely")]
    both = lambda s: streams.paired(s.where("kind = 'k'"), s.where("kind = 'v'"), "at", "1 minute")
    assert run(spark, tmp_path, "layer int, step int, kind string, at timestamp, payload string", [rows], both, "paired") == [(0, 1, "K", "V")]
