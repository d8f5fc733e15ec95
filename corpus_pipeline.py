"""A corpus from raw documents: STAGES in order, each written as Parquet and read again as the next one's docs.

Toxic documents go; repeated line chunks are taken out (a document of which nothing is left goes with them); of each group of
near-duplicates one document stays; documents that hold benchmark items go; what stays is encoded, with its decoded text.
Extra columns pass through all stages but the last. A stage makes each decision from the rows that it gets alone; labels and
benchmark are read from sf_dir.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqpack.llm import bpe, common, decontam, line_dedup, near_dedup, toxicity

#: Whether a document is left out as toxic: from this score on.
TOXIC = 0.5
#: From which similarity on documents are near-duplicates, in hundredths; op2 has a threshold of its own.
NEAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = common.free_name(docs, "toxic_score")
    return toxicity.toxicity(docs, common.table(spark, sf_dir, "labels"), score).where(F.col(score) < TOXIC).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    removed = common.free_name(docs, "n_removed")
    left = line_dedup.dedup_lines(docs, count=removed)
    return left.where((F.col(removed) == 0) | F.col("text").rlike(r"\S")).select(*[F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the row with the least (doc_id, nulls last; text checksum) stays; rows without a word all stay."""
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_key")).alias("m")
    keepers = common.cut(near_dedup.near_duplicates(docs, NEAR).where("class is not null").groupBy("class").agg(least).select("m.*"))
    names = [common.free_name(docs, c) for c in ("none", "id", "text_key")]
    keys = docs.where(wordy).withColumns(dict(zip(names, (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64("text")), strict=True)))
    kept = keys.join(keepers.toDF(*names), names, "left_semi").dropDuplicates(names).select(*[f"`{c}`" for c in docs.columns])
    return kept.unionByName(docs.where(~wordy))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = common.free_name(docs, "benchmark_matches")
    return decontam.matches(docs, common.table(spark, sf_dir, "benchmark"), name).where(F.size(name) == 0).drop(name)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text."""
    return bpe.encode(docs).select("doc_id", F.size("ids").alias("n_tokens"), "ids", "decoded")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("decontamination", drop_benchmark), ("bpe", encode)]

#: Compression lengths, sketches and merges are beyond SQL: the tests hold each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the rows of the last."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        before = common.mark()
        (out := stage(spark, docs, sf_dir)).write.parquet(path)
        common.sweep(spark, before)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
