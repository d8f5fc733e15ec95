"""Operator 8, shards along a Hilbert curve.

Each row becomes a point of metadata dimensions, every one quantised to BITS bits: the language (a code of its first two
letters, so near codes are like languages), the source (a hash) and the size (steps of an eighth of a power of two). Rows are
sorted by the point's index on the Hilbert curve, ties by text checksum and doc_id, and the sorted rows are cut into runs: a
shard then spans a small box of every dimension, which file statistics can prune. Rows of equal text are a group: all take the point
of the group's least language and source, so they are neighbours and only a cut parts them. The law is `rows`: shard counts differ
by one at most, whatever group of copies there is.

Only keys and numbers are sorted, never texts. A row's place is the offset of its range partition plus its place there.

Defined results: a null text has size 16 and checksum 0; null doc_id, lang or source sort first; equal rows stay separate rows in
neighbouring slots, dealt to several tasks where there are many. Very long texts are read once, for size and checksum. Extra columns
are ignored, whatever their names. An empty table gives no rows. With fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqpack.llm import common
from seqpack.llm.common import cut

SHARDS, BITS, DIMENSIONS = 40, 7, 3
OVERHEAD = 16


def _let(value: Column, use) -> Column:
    """use(value), with value computed once a row."""
    return F.transform(F.array(value), use)[0]


def _turn(n: int, i: int, b: int):
    """The step for bit b of coordinate i: invert the first coordinate's lower bits, or swap them with those of i."""
    low = F.lit((1 << b) - 1)

    def turned(a):
        high = a[i].bitwiseAND(1 << b) != 0
        swap = a[0].bitwiseXOR(a[i]).bitwiseAND(low)
        at = [a[k] for k in range(n)]
        at[0] = F.when(high, a[0].bitwiseXOR(low)).otherwise(a[0].bitwiseXOR(swap))
        if i:
            at[i] = F.when(high, a[i]).otherwise(a[i].bitwiseXOR(swap))
        return F.array(*at)

    return turned


def hilbert_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """The index on the Hilbert curve of integer coordinates below 2**bits, in built-in functions alone.

    Coordinates are turned in place, from the highest bit down, into the transposed index; Gray decoding follows.
    """
    n = len(coordinates)
    x = F.array(*[c.cast("long") for c in coordinates])
    for b in range(bits - 1, 0, -1):
        for i in range(n):
            x = _let(x, _turn(n, i, b))

    def gray(a):
        at = [a[0]]
        for k in range(1, n):
            at.append(a[k].bitwiseXOR(at[-1]))
        t = F.lit(0).cast("long")
        for b in range(bits - 1, 0, -1):
            t = F.when(at[-1].bitwiseAND(1 << b) != 0, t.bitwiseXOR(F.lit((1 << b) - 1))).otherwise(t)
        return _let(F.array(*at, t), lambda s: F.array(*[s[k].bitwiseXOR(s[n]) for k in range(n)]))

    def woven(a):
        out = F.lit(0).cast("long")
        for b in range(bits):
            for k in range(n):
                out = out + F.shiftleft(F.shiftright(a[k], b).bitwiseAND(1), b * n + n - 1 - k)
        return out

    return _let(_let(x, gray), woven)


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the Hilbert index of each row."""
    top = (1 << BITS) - 1
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long")
    lang = F.coalesce(F.lower("lang"), F.lit(""))
    letter = lambda k: F.greatest(F.lit(0), F.least(F.lit(25), F.ascii(F.substring(lang, k, 1)) - 97))
    dims = [
        F.shiftright(letter(1) * 26 + letter(2), 10 - BITS),
        F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(top + 1)),
        F.least(F.lit(top), F.floor(F.log2(size.cast("double")) * 8 - 32)),
    ]
    crc = F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32")
    own = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc, F.md5(F.coalesce(F.encode("text", "UTF-8"), F.lit(b"\0null"))).alias("text_md5"), *[d.cast("long").alias(f"d{k}") for k, d in enumerate(dims)]))
    groups = cut(own.groupBy("text_md5").agg(F.count("*").alias("n"), F.min(F.struct("d0", "d1")).alias("least")).where("n > 1"))
    many = F.col("n") > F.lit(own.count() // common.HOT)
    hot, rest = F.broadcast(groups.where(many).select("text_md5", "least")), groups.where(~many).select("text_md5", "least").hint("merge")
    near = own.join(hot, "text_md5").unionByName(own.join(hot, "text_md5", "left_anti").join(rest, "text_md5", "left"))
    point = [F.coalesce("least.d0", "d0"), F.coalesce("least.d1", "d1"), F.col("d2")]
    return near.select("doc_id", "size", "text_crc32", hilbert_index(point).alias("h"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, h) of each row of docs (doc_id, text, lang, source, ...)."""
    order = ["h", "text_crc32", "doc_id", "size", "salt"]
    own = cut(points(docs).withColumn("salt", F.monotonically_increasing_id()))  # written, so that rows equal in all else can be dealt to several tasks
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    run = cut(own.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", at))
    part, inner = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = run.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range partition, as many as the setting says
    ends = cut(counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total")))
    rank = F.col("before") + inner
    placed = run.join(F.broadcast(ends), part == ends.part).select("doc_id", "size", "text_crc32", "h", "total", rank.alias("rank"))
    base, longer = F.expr(f"total div {shards}"), F.expr(f"total % {shards}")
    head = longer * (base + 1)
    number = F.when(F.col("rank") < head, F.expr(f"rank div (total div {shards} + 1)")).otherwise(longer + F.floor((F.col("rank") - head) / F.greatest(base, F.lit(1))))
    placed = placed.withColumn("shard", number.cast("int"))
    begin = F.col("shard") * base + F.least(F.col("shard").cast("long"), longer)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "h")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write docs as one folder for each shard, rows in slot order; each row goes where shard() puts its doc_id."""
    placed = shard(docs, shards).select("doc_id", "text_crc32", "shard", "slot").dropDuplicates(["doc_id", "text_crc32"])
    keyed = docs.withColumn("text_crc32", F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long")).withColumnRenamed("doc_id", "_id")
    rows = keyed.join(placed.withColumnRenamed("text_crc32", "_crc"), (F.col("_id").eqNullSafe(F.col("doc_id"))) & (F.col("text_crc32") == F.col("_crc")))
    rows.repartition(shards, "shard").sortWithinPartitions("shard", "slot").drop("_id", "_crc", "text_crc32", "slot").write.partitionBy("shard").parquet(path)


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.table(spark, sf_dir, "documents"))
