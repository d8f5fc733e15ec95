"""The engine's tables over the driver's: token streams, vectors, pages, workers, requests. Each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqpack.functions import hashes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_tokens(spark: SparkSession, d: str) -> DataFrame:
    """A stream for each user: event types in order of time."""
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, d, "events").select(F.col("user_id").alias("stream_id"), pos.cast("long").alias("pos"), F.col("event_type").alias("sym"))


EVENTS = "tok as (select user_id as stream_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, event_type as sym from events)"
#: Event types as numbers.
CODES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


def coded_events(spark: SparkSession, d: str) -> DataFrame:
    code = F.coalesce(*[F.when(F.col("sym") == k, v) for k, v in CODES.items()], F.lit(0))
    return event_tokens(spark, d).withColumn("sym", code.cast("int"))


CODED = EVENTS + ", coded as (select stream_id, pos, case sym " + " ".join(f"when '{k}' then {v}" for k, v in CODES.items()) + " else 0 end as sym from tok)"


def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    """A stream for each document: its text at single blanks."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("stream_id"), F.posexplode(F.split("text", " ")).alias("pos", "sym")).withColumn("pos", F.col("pos").cast("long"))


TEXTS = "tok as (select doc_id as stream_id, unnest(string_split(text, ' ')) as sym, generate_subscripts(string_split(text, ' '), 1) - 1 as pos from documents)"


def role_tokens(spark: SparkSession, d: str) -> DataFrame:
    """A stream for each conversation: the roles of its turns."""
    t = table(spark, d, "conversations")
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return t.select(F.col("conv_id").alias("stream_id"), pos.cast("long").alias("pos"), F.col("role").alias("sym"))


ROLES = "tok as (select conv_id as stream_id, row_number() over (partition by conv_id order by turn) - 1 as pos, role as sym from conversations)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(page, token, idx, dim, x): components of the embeddings, pages of 64 tokens."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("token"), F.posexplode("embedding").alias("dim", "v"))
    return e.select(F.expr("token div 64").alias("page"), "token", "dim", F.col("v").cast("double").alias("x"))


VECTORS = "vec as (select vec_id // 64 as page, vec_id as token, generate_subscripts(embedding, 1) - 1 as dim, unnest(embedding)::double as x from embeddings)"


def mixed_sql(source: str, columns: list[str]) -> str:
    """SQL steps of the 64-bit finaliser: the last, `mixed`, has the rows of source with m_<column> for each column of numbers from 0 on."""
    steps, last = [], source
    for k, (shift, factor) in enumerate(((30, hashes.MIX_1), (27, hashes.MIX_2))):
        own = [f"{c}::uhugeint" if not k else f"m_{c}" for c in columns]
        kept = "*" if not k else f"* exclude ({', '.join(f'm_{c}' for c in columns)})"
        steps.append(f"mixed{k} as (select {kept}, " + ", ".join(f"(xor({x}, {x} // {1 << shift}) * {factor}::uhugeint) % {1 << 64}::uhugeint as m_{c}" for c, x in zip(columns, own, strict=True)) + f" from {last})")
        last = f"mixed{k}"
    steps.append(f"mixed as (select * exclude ({', '.join(f'm_{c}' for c in columns)}), " + ", ".join(f"xor(m_{c}, m_{c} // {1 << 31}) as m_{c}" for c in columns) + f" from {last})")
    return ", ".join(steps)
