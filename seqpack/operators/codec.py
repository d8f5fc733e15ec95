"""Quantization of pages of numbers (page, idx, x) and what it costs: scales, codes, page analysis, codec choice.

Codes are logical integers; the rounding and clamping of each operator is kept as it is defined, they differ on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the codecs: bits, largest code for scales, least and largest stored code.
CODECS = {2: (1, -2, 1), 4: (7, -8, 7), 8: (127, -128, 127), 16: (1, -32768, 32767)}


def finite(x: Column) -> Column:
    """x, or 0 where it is NaN or infinite: such values have code 0 and no part in scales."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def scale(x: Column, keys: list[str], qmax: int) -> Column:
    """[P17, P53] The largest finite magnitude over qmax within keys, 1 where all are 0."""
    top = F.max(F.abs(finite(x))).over(Window.partitionBy(*keys))
    return F.when(top > 0, top / qmax).otherwise(F.lit(1.0))


def half_away(x: Column, s: Column, q: int = 7) -> Column:
    """[P15] Round half away from zero, symmetric clamp; the clamp comes before the whole number."""
    return F.greatest(F.lit(float(-q)), F.least(F.lit(float(q)), F.round(finite(x) / s))).cast("int")


def half_even(x: Column, s: Column, low: int = -8, high: int = 7) -> Column:
    """[P16, P25] Round half to even, clamp to the stored range, whole number."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.rint(finite(x) / s))).cast("int")


def zero_point(x: Column, s: Column) -> Column:
    """[P23] Int4 codes around zero point 8."""
    return half_even(x, s) + 8


def quantized(values: DataFrame, keys: list[str], bits: int, rounding: str = "even") -> DataFrame:
    """values with scale s, code q and the value that q gives back."""
    qmax, low, high = CODECS[bits]
    s = values.withColumn("s", scale(F.col("x"), keys, qmax))
    q = half_away(F.col("x"), F.col("s"), qmax) if rounding == "away" else half_even(F.col("x"), F.col("s"), low, high)
    return s.withColumn("q", q).withColumn("back", F.col("q") * F.col("s"))


def blockwise(values: DataFrame, block: int = 32) -> DataFrame:
    """[P23, P24] Int4 codes with zero point by blocks of idx within a page, and whether a value was saturated."""
    b = values.withColumn("blk", F.expr(f"idx div {block}"))
    s = b.withColumn("s", scale(F.col("x"), ["page", "blk"], 7))
    raw = F.rint(F.col("x") / F.col("s"))
    return s.withColumn("q", zero_point(F.col("x"), F.col("s"))).withColumn("saturated", ((raw < -8) | (raw > 7)).cast("int"))


def raw16(x: Column) -> Column:
    """[P25, P29] The uncompressed codec stores whole numbers: a lossy choice that is kept."""
    return F.rint(F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), finite(x)))).cast("int")


def packed_bytes(bits: Column, count: Column) -> Column:
    """[P26]"""
    return F.when(bits == 2, F.floor((count + 3) / 4)).when(bits == 4, F.floor((count + 1) / 2)).when(bits == 8, count).otherwise(count * 2).cast("long")


def analysed(values: DataFrame) -> DataFrame:
    """[A12, P30] One row a page: range, variance, outliers above three quarters of the range, error estimates, unsound values."""
    x, top = F.col("x"), F.max(F.abs("x")).over(Window.partitionBy("page"))
    sound = values.withColumn("top", top)
    return sound.groupBy("page").agg(
        F.count("*").alias("n"), F.max(F.abs(x)).alias("abs_max"), F.var_pop(x).alias("variance"),
        (F.count_if(F.abs(x) > F.col("top") * 0.75) / F.count("*")).alias("outlier_ratio"),
        (F.max(F.abs(x)) / 3).alias("error2"), (F.max(F.abs(x)) / 15).alias("error4"), (F.max(F.abs(x)) / 255).alias("error8"),
        F.count_if(F.isnan(x)).alias("nan_values"), F.count_if(F.abs(x) == float("inf")).alias("inf_values"),
    )


def chosen(analysis: DataFrame, max_error: float, min_bits: int = 2, max_bits: int = 16) -> DataFrame:
    """[P27, P28] analysis with the narrowest codec within the error budget; 16 where none fits."""
    bits = F.lit(16)
    for b in (8, 4, 2):
        if min_bits <= b <= max_bits:
            bits = F.when(F.col(f"error{b}") <= max_error, b).otherwise(bits)
    return analysis.withColumn("bits", bits).withColumn("bytes", packed_bytes(F.col("bits"), F.col("n")))


def distribution(choice: DataFrame) -> DataFrame:
    """[A13] Pages, bytes and bytes saved against 4-byte numbers, for each codec."""
    raw = F.col("n") * 4
    return choice.groupBy("bits").agg(F.count("*").alias("pages"), F.sum("bytes").alias("bytes"), F.sum(F.greatest(F.lit(0), raw - F.col("bytes"))).alias("saved"))


def encoded(values: DataFrame, choice: DataFrame, block: int = 32) -> DataFrame:
    """[P28] Codes of each page in its chosen codec, and what they decode to."""
    v = values.join(choice.select("page", "bits"), "page").withColumn("blk", F.expr(f"idx div {block}"))
    top = F.max(F.abs("x")).over(Window.partitionBy("page", "blk"))
    qmax = F.when(F.col("bits") == 2, 1).when(F.col("bits") == 4, 7).when(F.col("bits") == 8, 127).otherwise(1)
    v = v.withColumn("s", F.when(top > 0, top / qmax).otherwise(F.lit(1.0)))
    q = F.lit(None).cast("int")
    for b, (_, low, high) in CODECS.items():
        q = F.when(F.col("bits") == b, raw16(F.col("x")) if b == 16 else half_even(F.col("x"), F.col("s"), low, high)).otherwise(q)
    return v.withColumn("q", q).withColumn("back", F.when(F.col("bits") == 16, F.col("q").cast("double")).otherwise(F.col("q") * F.col("s")))


def nibbles(codes: DataFrame, keys: list[str]) -> DataFrame:
    """[P22, P24] (keys, payload): pairs of codes -8..7 at idx 2k and 2k+1 in one byte as two's complement, the even one low."""
    pair = codes.groupBy(*keys, F.expr("idx div 2").alias("k")).agg(F.max(F.when(F.col("idx") % 2 == 0, F.pmod("q", F.lit(16)))).alias("lo"), F.max(F.when(F.col("idx") % 2 == 1, F.pmod("q", F.lit(16)))).alias("hi"))
    byte = F.lpad(F.hex((F.coalesce("hi", F.lit(0)) * 16 + F.coalesce("lo", F.lit(0))).cast("long")), 2, "0")
    ordered = F.array_sort(F.collect_list(F.struct("k", byte.alias("b"))))
    return pair.groupBy(*keys).agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["b"]), "")).alias("payload"), (F.max("k") * 2 + 2 - F.max_by(F.col("hi").isNull().cast("int"), "k")).alias("n"))


def from_nibbles(packed: DataFrame, keys: list[str]) -> DataFrame:
    """[P22, P24] (keys, idx, q) of packed payloads."""
    bytes_ = packed.select(*keys, "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("payload")), lambda i: F.conv(F.hex(F.substring("payload", i, F.lit(1))), 16, 10).cast("int"))).alias("k", "b"))
    two = bytes_.select(*keys, "n", F.explode(F.array(F.struct((F.col("k") * 2).alias("idx"), (F.col("b") % 16).alias("u")), F.struct((F.col("k") * 2 + 1).alias("idx"), F.expr("b div 16").cast("int").alias("u")))).alias("x"))
    return two.where("x.idx < n").select(*keys, F.col("x.idx").alias("idx"), F.when(F.col("x.u") >= 8, F.col("x.u") - 16).otherwise(F.col("x.u")).alias("q"))
