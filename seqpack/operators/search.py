"""Pattern operators over token streams: n-grams, count, locate, suffix arrays, ranges, continuations.

A pattern search is an equi-join of the stream's n-grams with the patterns, not a backward search: one exchange for each side,
and the number of hits needs no extra pass. Mixed lengths are joined length by length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqpack.functions.cuts import dense_ranks, written

SENTINEL = "$"


def ngrams(tokens: DataFrame, n: int) -> DataFrame:
    """[W4] (stream_id, pos, gram) for every n symbols in a row."""
    w = Window.partitionBy("stream_id").orderBy("pos")
    cols = [F.lead("sym", k).over(w).alias(f"s{k}") for k in range(n)]
    return tokens.select("stream_id", "pos", *cols).where(F.col(f"s{n - 1}").isNotNull()).select("stream_id", "pos", F.array(*[f"s{k}" for k in range(n)]).alias("gram"))


def _literal(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ngrams_of_rows(rows: DataFrame, n: int, first: tuple[str, ...] = ()) -> DataFrame:
    """[W4] As ngrams(), of streams that are rows of arrays (stream_id, syms): nothing is shuffled. With first, only grams that begin with one of its symbols are made."""
    where = f"filter(sequence(0, size(syms) - {n}), i -> syms[i] in ({', '.join(map(_literal, first))}))" if first else f"sequence(0, size(syms) - {n})"
    at = F.expr(f"explode(if(size(syms) < {n}, array(), transform({where}, i -> struct(cast(i as bigint) as pos, slice(syms, i + 1, {n}) as gram))))")
    return rows.select("stream_id", at.alias("g")).select("stream_id", "g.pos", "g.gram")


def counted(grams: DataFrame, patterns: DataFrame) -> DataFrame:
    """[A5] patterns (pid, syms) with their number of occurrences among grams of one length, 0 included."""
    found = grams.groupBy("gram").agg(F.count("*").alias("k"))
    return patterns.join(found, patterns.syms == found.gram, "left").select("pid", "syms", F.coalesce("k", F.lit(0)).alias("n"))


def _by_length(tokens: DataFrame, patterns: DataFrame, lengths: list[int], join) -> DataFrame:
    if not lengths or min(lengths) < 1:
        raise ValueError("patterns of length 0 have no occurrences")
    out = None
    for n in lengths:
        part = join(ngrams(tokens, n), patterns.where(F.size("syms") == n))
        out = part if out is None else out.unionByName(part)
    return out


def count(tokens: DataFrame, patterns: DataFrame, lengths: list[int]) -> DataFrame:
    """[A5, J23] patterns (pid, syms) with their number of occurrences, 0 included. Grams are counted before they meet the patterns."""
    return _by_length(tokens, patterns, lengths, counted)


def locate(tokens: DataFrame, patterns: DataFrame, lengths: list[int]) -> DataFrame:
    """[J5, U5] (pid, stream_id, pos) of every occurrence."""
    return _by_length(tokens, patterns, lengths, lambda grams, some: grams.join(some, some.syms == grams.gram).select("pid", "stream_id", "pos"))


def located_lists(found: DataFrame) -> DataFrame:
    """[O6] (pid, stream_id, positions) in order."""
    return found.groupBy("pid", "stream_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def continuations(tokens: DataFrame, n: int) -> DataFrame:
    """(gram, next, n): how often each symbol follows each n-gram."""
    grams = ngrams(tokens, n + 1)
    return grams.groupBy(F.slice("gram", 1, n).alias("gram"), F.element_at("gram", n + 1).alias("next")).agg(F.count("*").alias("n"))


def next_symbol(tokens: DataFrame, n: int) -> DataFrame:
    """[O4] (gram, next, n): the likeliest continuation; ties go to the least symbol."""
    best = F.row_number().over(Window.partitionBy("gram").orderBy(F.desc("n"), "next"))
    return continuations(tokens, n).withColumn("r", best).where("r = 1").drop("r")


def draft_hit_rate(tokens: DataFrame, n: int) -> DataFrame:
    """[A32] How often the likeliest continuation is the one that follows."""
    grams = ngrams(tokens, n + 1).select(F.slice("gram", 1, n).alias("gram"), F.element_at("gram", n + 1).alias("real"))
    real = grams.groupBy("gram", "real").agg(F.count("*").alias("k"))
    return real.join(next_symbol(tokens, n).select("gram", "next"), "gram").agg(F.sum("k").alias("queries"), F.sum(F.when(F.col("real") == F.col("next"), F.col("k")).otherwise(0)).alias("hits")).select("queries", "hits", (F.col("hits") / F.col("queries")).alias("hit_rate"))


def _doubling(symbols: list) -> np.ndarray:
    """The suffix array of one stream and its sentinel, by prefix doubling with dense ranks [O1, O2, W3, W4]."""
    _, rank = np.unique(np.array(symbols, object).astype(str) if symbols and isinstance(symbols[0], str) else np.array(symbols), return_inverse=True)
    rank = np.concatenate([rank + 1, [0]]).astype(np.int64)
    k, n = 1, len(rank)
    while True:
        ahead = np.concatenate([rank[k:], np.zeros(min(k, n), np.int64)]) if k < n else np.zeros(n, np.int64)
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], (key[order][1:] != key[order][:-1]).astype(np.int64)]).cumsum()
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        k *= 2


def suffix_array(tokens: DataFrame) -> DataFrame:
    """[O1, O2] (stream_id, sa_rank, pos) with the sentinel's empty suffix at rank 0. A stream is one task's work; streams are independent. For long ones: suffix_array_long()."""
    kind = dict(tokens.dtypes)["stream_id"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        sa = _doubling(pdf["sym"].tolist())
        return pd.DataFrame({"stream_id": pdf["stream_id"].iloc[0], "sa_rank": np.arange(len(sa)), "pos": sa})

    return tokens.select("stream_id", "pos", "sym").groupBy("stream_id").applyInPandas(one, f"stream_id {kind}, sa_rank long, pos long")


def suffix_array_long(tokens: DataFrame) -> DataFrame:
    """[O1, O2, W3, W4] As suffix_array(), for streams of any length: prefix doubling over all streams at once, as joins and ranks.

    A round pairs the rank of each suffix with that of the suffix k symbols on (none: the stream has ended, the least) and ranks
    the pairs; k doubles until all ranks of a stream differ. No stream is in one task, and each round is written. Ranks are
    counted within a stream at the end, by the first rank of each stream. Positions run from 0 without gaps.
    """
    ends = tokens.groupBy("stream_id").agg((F.max("pos") + 1).alias("pos"))
    rows = tokens.select("stream_id", "pos", "sym").unionByName(ends.withColumn("sym", F.lit(None).cast(tokens.schema["sym"].dataType)))
    ranked = _first_ranks(rows)
    k = 1
    while True:
        state = written(ranked)
        if not state.where("_size > 1").limit(1).count():
            break
        ahead = state.select("stream_id", (F.col("pos") - k).alias("pos"), F.col("rank").alias("next"))
        both = state.drop("_size").join(ahead, ["stream_id", "pos"], "left").na.fill(-1, ["next"])
        ranked = dense_ranks(both, ["stream_id", "rank", "next"], "fresh").select("stream_id", "pos", F.col("fresh").alias("rank"), "_size")
        k *= 2
    first = state.groupBy("stream_id").agg(F.min("rank").alias("first"))
    return state.join(first, "stream_id").select("stream_id", (F.col("rank") - F.col("first")).alias("sa_rank"), "pos")


def _first_ranks(rows: DataFrame) -> DataFrame:
    """Ranks by stream and symbol, the end (null) before all symbols."""
    return dense_ranks(rows.withColumn("sym", F.struct(F.col("sym").isNotNull().alias("is"), F.col("sym").alias("s"))), ["stream_id", "sym"], "rank").select("stream_id", "pos", "rank", "_size")


def sampled(sa: DataFrame, every: int) -> DataFrame:
    """[O8] Every so-many-th position with the number of marks before it."""
    marks = F.row_number().over(Window.partitionBy("stream_id").orderBy("sa_rank")) - 1
    return sa.where(F.col("pos") % every == 0).select("stream_id", "sa_rank", "pos", marks.cast("long").alias("mark_rank"))


def bwt(tokens: DataFrame, sa: DataFrame) -> DataFrame:
    """[W8] (stream_id, sa_rank, sym): the symbol before each suffix, the sentinel before the first."""
    before = tokens.select("stream_id", (F.col("pos") + 1).alias("pos"), F.col("sym").cast("string").alias("sym"))
    return sa.join(before, ["stream_id", "pos"], "left").select("stream_id", "sa_rank", F.coalesce("sym", F.lit(SENTINEL)).alias("sym"))


def ranges(tokens: DataFrame, sa: DataFrame, patterns: DataFrame, lengths: list[int]) -> DataFrame:
    """[A6] (pid, stream_id, lo, hi): the run [lo, hi) of suffix ranks that begin with each pattern, where there is one."""
    found = locate(tokens, patterns, lengths).join(sa, ["stream_id", "pos"])
    return found.groupBy("pid", "stream_id").agg(F.min("sa_rank").alias("lo"), (F.max("sa_rank") + 1).alias("hi"))
