"""Positional operators over token streams (stream_id, pos, sym): access, slice, select, rank, bit planes, counts, entropy.

Row numbers in brackets are those of the operator inventory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 64


def access(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """[P1, P2] queries (qid, stream_id, pos) with the symbol there; null past the end."""
    return queries.join(tokens, ["stream_id", "pos"], "left").select("qid", "stream_id", "pos", "sym")


def slice_(tokens: DataFrame, begin: int, end: int) -> DataFrame:
    """[P3] Symbols at begin <= pos < end; the range reaches the scan."""
    return tokens.where(F.col("pos").between(begin, end - 1))


def select(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """[P4] queries (qid, stream_id, sym, k) with the position of the k-th (from 1) such symbol; null if there is none."""
    nth = tokens.withColumn("k", F.row_number().over(Window.partitionBy("stream_id", "sym").orderBy("pos")))
    return queries.join(nth, ["stream_id", "sym", "k"], "left").select("qid", "stream_id", "sym", "k", "pos")


def rank(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """[A1, A3] queries (qid, stream_id, sym, i) with how many such symbols stand before i: a join and a count."""
    t = tokens.select("stream_id", "sym", "pos")
    return queries.join(t, (queries.stream_id == t.stream_id) & (queries.sym == t.sym) & (t.pos < queries.i), "left").groupBy(queries.qid, queries.stream_id, queries.sym, queries.i).agg(F.count("pos").alias("rank"))


def rank_directory(tokens: DataFrame, block: int = BLOCK) -> DataFrame:
    """[A2, W5, P9] (stream_id, sym, blk, n, before, bits): counts in and before each block of at most 64 positions in which the symbol stands, and where it stands there, a bit a position."""
    if not 0 < block <= 64:
        raise ValueError("a block has 1 to 64 positions")
    blk = F.floor(F.col("pos") / block)
    bit = F.expr(f"shiftleft(1L, cast(pos % {block} as int))")
    counts = tokens.groupBy("stream_id", "sym", blk.alias("blk")).agg(F.count("*").alias("n"), F.bit_or(bit).alias("bits"))
    upto = Window.partitionBy("stream_id", "sym").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("stream_id", "sym", "blk", "n", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), "bits")


def rank_indexed(directory: DataFrame, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """[A2] As rank(), by the directory alone: the last block that is not past a query's, its count before and the bits below the query's position.

    Queries are ordered among the blocks of their stream and symbol; each takes the last block that it has passed, so no row meets
    a range of others.
    """
    d = directory.select("stream_id", "sym", "blk", F.lit(None).cast("long").alias("i"), F.lit(None).cast(queries.schema["qid"].dataType).alias("qid"), F.struct("blk", "n", "before", "bits").alias("at"))
    q = queries.select("stream_id", "sym", F.floor(F.col("i") / block).alias("blk"), "i", "qid", F.lit(None).cast(d.schema["at"].dataType).alias("at"))
    last = F.last("at", ignorenulls=True).over(Window.partitionBy("stream_id", "sym").orderBy("blk", F.col("qid").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    found = d.unionByName(q).withColumn("at", last).where("qid is not null")
    below = F.expr(f"bit_count(at.bits & (shiftleft(1L, cast(i % {block} as int)) - 1))")
    rank_ = F.when(F.col("at").isNull(), 0).when(F.col("at.blk") < F.col("blk"), F.col("at.before") + F.col("at.n")).otherwise(F.col("at.before") + below)
    return found.select("qid", "stream_id", "sym", "i", rank_.cast("long").alias("rank"))


def bit_planes(tokens: DataFrame, bits: int) -> DataFrame:
    """[P10] (stream_id, plane, pos, bit) of integer symbols, the highest bit as plane 0."""
    planes = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda l: F.struct(l.alias("plane"), F.expr("0").alias("zero"))))
    out = tokens.withColumn("p", planes)
    return out.select("stream_id", F.col("p.plane").alias("plane"), "pos", F.expr(f"cast((sym >> ({bits} - 1 - p.plane)) & 1 as int)").alias("bit"))


def rank1(planes: DataFrame, queries: DataFrame) -> DataFrame:
    """[A4] queries (qid, stream_id, plane, i) with the number of ones before i."""
    b = planes.where("bit = 1").select(F.col("stream_id").alias("s"), F.col("plane").alias("l"), "pos")
    return queries.join(b, (F.col("stream_id") == F.col("s")) & (F.col("plane") == F.col("l")) & (F.col("pos") < F.col("i")), "left").groupBy("qid", "stream_id", "plane", "i").agg(F.count("pos").alias("rank1"))


def stable_partition(planes: DataFrame) -> DataFrame:
    """[O3] Where each position goes when a plane is split stably by its bit: zeros first."""
    to = F.row_number().over(Window.partitionBy("stream_id", "plane").orderBy("bit", "pos")) - 1
    return planes.select("stream_id", "plane", "pos", "bit", to.cast("long").alias("new_pos"))


def c_table(tokens: DataFrame) -> DataFrame:
    """[A7] (stream_id, sym, n, c): count of each symbol and of all smaller ones."""
    before = Window.partitionBy("stream_id").orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    counts = tokens.groupBy("stream_id", "sym").agg(F.count("*").alias("n"))
    return counts.select("stream_id", "sym", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("c"))


def entropy(tokens: DataFrame) -> DataFrame:
    """[A8] (stream_id, h0): bits a symbol of order 0."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy("stream_id"))
    counts = tokens.groupBy("stream_id", "sym").agg(F.count("*").alias("n"))
    return counts.select("stream_id", p.alias("p")).groupBy("stream_id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("h0"))


def footprint(tokens: DataFrame) -> DataFrame:
    """[A34, P54] Bits a token: packed planes with 32-bit samples for each superblock of 512, against entropy."""
    sizes = tokens.groupBy("stream_id").agg(F.count("*").alias("n"), F.countDistinct("sym").alias("sigma"))
    bits = F.greatest(F.lit(1), F.ceil(F.log2(F.col("sigma") + 1)))
    packed = bits * (F.ceil(F.col("n") / 32) * 32 + F.ceil(F.col("n") / 512) * 32) / F.col("n")
    return sizes.join(entropy(tokens), "stream_id").select("stream_id", "n", "sigma", bits.cast("long").alias("levels"), packed.alias("packed_bits"), "h0")
