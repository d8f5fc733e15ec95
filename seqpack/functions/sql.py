"""SQL table functions over a registered token table, for users of spark.sql; each is a parametrised view that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FUNCTIONS = (
    "seq_access(s BIGINT, p BIGINT) RETURNS TABLE (sym STRING) RETURN SELECT t.sym FROM {v} t WHERE t.stream_id = s AND t.pos = p",
    "seq_slice(s BIGINT, a BIGINT, b BIGINT) RETURNS TABLE (pos BIGINT, sym STRING) RETURN SELECT t.pos, t.sym FROM {v} t WHERE t.stream_id = s AND t.pos >= a AND t.pos < b",
    "seq_rank(s BIGINT, c STRING, i BIGINT) RETURNS TABLE (rank BIGINT) RETURN SELECT count(*) FROM {v} t WHERE t.stream_id = s AND t.sym = c AND t.pos < i",
    "seq_locate(a STRING, b STRING) RETURNS TABLE (stream_id BIGINT, pos BIGINT) RETURN SELECT x.stream_id, x.pos FROM {v} x JOIN {v} y ON x.stream_id = y.stream_id AND y.pos = x.pos + 1 WHERE x.sym = a AND y.sym = b",
    "seq_count(a STRING, b STRING) RETURNS TABLE (n BIGINT) RETURN SELECT count(*) FROM {v} x JOIN {v} y ON x.stream_id = y.stream_id AND y.pos = x.pos + 1 WHERE x.sym = a AND y.sym = b",
)


def register(spark: SparkSession, tokens: DataFrame, view: str = "seq_tokens") -> list[str]:
    """[U1, U5] Names the tokens (stream_id, pos, sym) as a view and registers seq_access, seq_slice, seq_rank, seq_locate and seq_count on it."""
    tokens.selectExpr("cast(stream_id as bigint) stream_id", "cast(pos as bigint) pos", "cast(sym as string) sym").createOrReplaceTempView(view)
    for f in _FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f.format(v=view)}")
    return [f.split("(")[0] for f in _FUNCTIONS]


def register_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """[S31] Profiles, compatibility, evidence and other small tables as views."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
