"""Readers and sinks: engine tables as Parquet, evidence as JSON with explicit schemas, raw token dumps, text metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of each table that the engine stores; none is inferred from data.
SCHEMAS = {
    "tokens": "stream_id long, pos long, sym int",
    "bits": "pos long, bit int",
    "suffix_array": "stream_id long, sa_rank long, pos long",
    "ctable": "sym int, c long",
    "rrr_bits": "stream_id long, block long, n int, ones int, offset int",
    "rrr_wavelet": "stream_id long, level int, block long, n int, ones int, offset int",
    "patterns": "pid string, syms array<int>",
    "expected": "pid string, n long, positions array<long>",
    "golden_access": "stream_id long, pos long, sym int",
    "golden_rank": "stream_id long, sym int, i long, rank long",
    "values": "idx long, v int",
    "blocks": "b int, data binary, state0 long",
    "base": "pos long, val int",
    "delta": "leaf long, pos long, val int",
    "embedding": "id long, vec array<float>",
    "weights": "m int, k int, q int",
    "inputs": "b int, k int, v float",
    "kv": "layer int, head int, token long, dim int, qk int, qv int",
    "queries": "seq_id long, layer int, qpos long, qhead int, q array<float>",
    "kv_pages": "page struct<layer:int,head:int,begin:long>, count int, codec int, keys binary, values binary, k_scales array<float>, v_scales array<float>, checksum binary",
}
EVIDENCE = "schema string, role string, fingerprint struct<model:string,runtime:string,hardware:string,workload:string,release_digest:string>, metrics struct<throughput:double,p50:double,p95:double,vram:double,capacity:double,correctness:boolean>"
SESSION = f"session_id string, baseline_runs array<struct<{EVIDENCE.replace(' string', ':string').replace(' struct<', ':struct<')}>>, candidate_runs array<struct<{EVIDENCE.replace(' string', ':string').replace(' struct<', ':struct<')}>>"
VERSION = 1


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One of SCHEMAS from Parquet (S1-S9). A table of another schema version is refused as soon as a row of it is read."""
    return spark.read.schema(SCHEMAS[kind]).parquet(path)


def write_table(df: DataFrame, path: str, partition: str | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def checked_version(df: DataFrame, column: str = "schema_version", version: int = VERSION) -> DataFrame:
    return df.where(F.assert_true(F.col(column) == version, F.lit("unknown schema version")).isNull())


def read_raw_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(stream_id, pos, sym) of raw dumps: each file an int64 count, then as many int32 symbols."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                n = int(np.frombuffer(content, "<i8", 1)[0])
                sym = np.frombuffer(content, "<i4", n, 8)
                for at in range(0, n, 1 << 20):
                    part = sym[at : at + (1 << 20)]
                    yield pd.DataFrame({"file": path, "pos": np.arange(at, at + len(part)), "sym": part})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, pos long, sym int").select(F.xxhash64("file").alias("stream_id"), "pos", "sym")


def raw_tokens(df: DataFrame) -> DataFrame:
    """(stream_id, content) in the raw dump's layout, for sinks of binary files; a stream is one task's work."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        sym = pdf.sort_values("pos")["sym"].to_numpy("<i4")
        return pd.DataFrame({"stream_id": [int(pdf["stream_id"].iloc[0])], "content": [np.int64(len(sym)).astype("<i8").tobytes() + sym.tobytes()]})

    return df.select("stream_id", "pos", "sym").groupBy("stream_id").applyInPandas(one, "stream_id long, content binary")


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence documents, one JSON a file, and whether every required field is there."""
    df = spark.read.schema(EVIDENCE).json(path, multiLine=True)
    needed = ("schema", "role", "fingerprint.model", "fingerprint.runtime", "fingerprint.hardware", "fingerprint.workload", "metrics.throughput", "metrics.p95", "metrics.correctness")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in needed]))
    return df.withColumn("missing", missing)


def read_session(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, role, run_no, fingerprint, metrics) of repeated-run sessions."""
    s = spark.read.schema(SESSION).json(path, multiLine=True)
    each = [s.select("session_id", F.lit(role).alias("role"), F.posexplode(f"{role}_runs").alias("run_no", "run")) for role in ("baseline", "candidate")]
    return each[0].unionByName(each[1]).select("session_id", "role", "run_no", "run.fingerprint", "run.metrics")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row for each crossover case, dense and compressed latencies as arrays."""
    schema = "cases array<struct<context:int,head_dim:int,queries:int,kv_heads:int,bits:int,compressed:array<double>,dense:array<double>,compressed_mib:double,dense_mib:double,max_error:double,tolerance:double>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("cases").alias("c")).select("c.*")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, idx, value, top1) of a run's logits."""
    schema = "model_sha256 string, prompt_tokens array<int>, generated_tokens array<int>, logits array<struct<values:array<double>,top1:int>>"
    runs = spark.read.schema(schema).json(path, multiLine=True).select(F.input_file_name().alias("file"), F.posexplode("logits").alias("position", "logit"))
    return runs.select("file", "position", F.posexplode("logit.values").alias("idx", "value"), "logit.top1")


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Snapshot columns with their defaults where null or missing."""
    return df.select(*df.columns, *[F.lit(None).cast(T.StringType() if isinstance(v, str) else T.DoubleType()).alias(k) for k, v in defaults.items() if k not in df.columns]).select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in [*df.columns, *[k for k in defaults if k not in df.columns]]])


def prometheus_lines(df: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """One text line for each row: name{label="..."} value (S23); write with df.write.text."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in labels])
    return df.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("value"))


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text for each row, for text or Kafka sinks."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("value"))


def markdown_lines(df: DataFrame) -> DataFrame:
    """The lines (at, value) of a markdown table: two of its head, then one for each row; write them in order of at."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"[|\n]", " ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(-2, "| " + " | ".join(df.columns) + " |"), (-1, "|" + "-|" * len(df.columns))], "at long, value string")
    return head.unionByName(df.select(F.monotonically_increasing_id().alias("at"), line.alias("value")))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def distinct_nodes(stream: DataFrame, key: str) -> DataFrame:
    """The first row of each node of a tapped stream, batch or streaming."""
    return stream.dropDuplicates([key])


class PageStore:
    """A persistent page store over Parquet: put appends, get reads by key, verify recomputes checksums, compact keeps the newest row of a key."""

    KEY = ("layer", "head", "begin")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, pages: DataFrame) -> None:
        """pages (layer, head, begin, generation, keys, values); the checksum covers both payloads in order."""
        pages.withColumn("checksum", self.checksum()).write.mode("append").parquet(self.path)

    @staticmethod
    def checksum():
        return F.sha2(F.concat(F.sha2("keys", 256), F.lit("|"), F.sha2("values", 256)), 256)

    def open(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def get(self, keys: DataFrame) -> DataFrame:
        return self.open().join(keys.select(*self.KEY).distinct(), list(self.KEY), "left_semi")

    def verify(self) -> DataFrame:
        """Pages whose checksum does not fit."""
        return self.open().where(F.col("checksum") != self.checksum())

    def newest(self) -> DataFrame:
        row = F.struct("generation", *[c for c in ("keys", "values", "checksum")])
        return self.open().groupBy(*self.KEY).agg(F.max(row).alias("r")).select(*self.KEY, "r.*")

    def compact(self, to: str) -> PageStore:
        self.newest().write.parquet(to)
        return PageStore(self.spark, to)

    def counters(self) -> DataFrame:
        return self.open().agg(F.count("*").alias("records"), F.countDistinct(*self.KEY).alias("pages"), F.sum(F.length("keys") + F.length("values")).alias("bytes"))
