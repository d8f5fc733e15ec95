"""Pages and sequences as tables: pages (page_id, layer, head, begin, n, bytes), refs (seq_id, layer, begin, n, page_id).

Set-based forms work on whole tables; fold() replays an ordered log of operations key by key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqpack.operators import codec

PAGE = 64


def sealed(rows: DataFrame, keys: list[str], page: int = PAGE) -> DataFrame:
    """[T1, X1] rows (keys, idx, ...) with their page and whether it is sealed: only the last partial page of a key is active."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("page", F.expr(f"idx div {page}")).withColumn("is_sealed", (F.col("page") + 1) * page <= n)


def aligned(tails: DataFrame, keys: list[str]) -> DataFrame:
    """[T2] Keys whose heads have tails of different lengths: (keys, lengths)."""
    return tails.groupBy(*keys).agg(F.countDistinct("tail").alias("lengths")).where("lengths > 1")


def invalid(pages: DataFrame, page: int = PAGE) -> DataFrame:
    """Pages that are not sound, with the reasons."""
    why = F.array_compact(F.array(F.when(F.col("n") < 1, F.lit("empty")), F.when(F.col("n") > page, F.lit("too long")), F.when(F.col("begin") < 0, F.lit("negative begin")), F.when(F.col("bytes") <= 0, F.lit("no payload"))))
    return pages.withColumn("reasons", why).where(F.size("reasons") > 0)


#: Positions that a bucket of pages spans.
SPAN = 1 << 16


def overlaps(pages: DataFrame, span: int = SPAN) -> DataFrame:
    """[J6] Pages that begin before an earlier page of their layer and head has ended, and how far that page covers.

    Two ordered passes, and no pair of rows is joined: pages are dealt to buckets by where they begin, each bucket learns how far
    the buckets before it cover (one small row for each bucket is ordered within layer and head), then pages are ordered within theirs.
    """
    dealt = pages.withColumn("_bucket", F.floor(F.col("begin") / span)).withColumn("_end", F.col("begin") + F.col("n"))
    keys = ["layer", "head"]
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    most = dealt.groupBy(*keys, "_bucket").agg(F.max("_end").alias("_most")).select(*keys, "_bucket", F.max("_most").over(upto).alias("_before"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy("begin", "page_id").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest("_before", F.max("_end").over(inner))
    return dealt.join(most, [*keys, "_bucket"]).withColumn("covered", covered).where("begin < covered").drop("_bucket", "_end", "_before")


def snapshot(refs: DataFrame, pages: DataFrame, sequences: DataFrame) -> DataFrame:
    """[J10, J11] The pages of live sequences in reading order; refs of other sequences are left out."""
    live = refs.join(sequences, "seq_id", "left_semi").join(pages.select("page_id", "head", "bytes"), "page_id")
    return live.withColumn("slot", F.row_number().over(Window.partitionBy("seq_id", "layer").orderBy("begin", "page_id")) - 1)


def unknown_items(batch: DataFrame, sequences: DataFrame) -> DataFrame:
    """[J11, X5] Batch items of sequences that do not exist."""
    return batch.join(sequences, "seq_id", "left_anti")


def reclaimable(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """[J12, T12] Pages that no sequence refers to."""
    return pages.join(refs.select("page_id"), "page_id", "left_anti")


def refcount_audit(recorded: DataFrame, refs: DataFrame) -> DataFrame:
    """[J13, A37] Pages whose recorded count is not the number of refs, missing ones on either side included."""
    real = refs.groupBy("page_id").agg(F.count("*").alias("real"))
    both = recorded.join(real, "page_id", "full_outer")
    return both.select("page_id", F.coalesce("refcount", F.lit(0)).alias("refcount"), F.coalesce("real", F.lit(0)).alias("real")).where("refcount <> real")


def stats(pages: DataFrame, tails: DataFrame) -> DataFrame:
    """[A10, A11] Per layer: sealed pages, tokens and bytes, tokens in tails."""
    p = pages.groupBy("layer").agg(F.count("*").alias("pages"), F.sum("n").alias("sealed_tokens"), F.sum("bytes").alias("sealed_bytes"))
    return p.join(tails.groupBy("layer").agg(F.sum("tail").alias("tail_tokens")), "layer", "full_outer").na.fill(0)


def copied(refs: DataFrame, source: int, target: int, begin: int, end: int) -> DataFrame:
    """[T7] refs and those of target: pages of source that lie whole inside [begin, end) are shared by reference."""
    mine = (F.col("seq_id") == source) & (F.col("begin") >= begin) & (F.col("begin") + F.col("n") <= end)
    copy = F.lit(target).cast(refs.schema["seq_id"].dataType)
    # one pass that leaves rows where they are dealt, where a union would have them shuffled again
    return refs.withColumn("seq_id", F.explode(F.when(mine, F.array("seq_id", copy)).otherwise(F.array("seq_id"))))


def removed(refs: DataFrame, seq: int, begin: int, end: int) -> DataFrame:
    """[T8] refs without the pages of seq in [begin, end); a bound inside a page is refused when rows are read."""
    mine = F.col("seq_id") == seq
    split = mine & (F.col("begin") < end) & (F.col("begin") + F.col("n") > begin) & ((F.col("begin") < begin) | (F.col("begin") + F.col("n") > end))
    inside = mine & (F.col("begin") >= begin) & (F.col("begin") + F.col("n") <= end)
    return refs.where(F.assert_true(~split, F.lit("range is not aligned to pages")).isNull()).where(~inside)


def shifted(refs: DataFrame, seq: int, begin: int, end: int, delta: int) -> DataFrame:
    """[T9] refs with the pages of seq inside [begin, end) moved by delta; a begin below 0 is refused when rows are read."""
    inside = (F.col("seq_id") == seq) & (F.col("begin") >= begin) & (F.col("begin") + F.col("n") <= end)
    moved = F.when(inside, F.col("begin") + delta).otherwise(F.col("begin"))
    return refs.where(F.assert_true(moved >= 0, F.lit("position below 0")).isNull()).withColumn("begin", moved)


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """[X4] rows with accepted: the first of each key; later ones are rejects."""
    return rows.withColumn("accepted", F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1)


def latest_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """[T20] The last row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


FOLDED = "seq_id long, seq_no long, op string, ok boolean, length long, speculating boolean"


def fold(ops: DataFrame) -> DataFrame:
    """[T3, T6, T10, T11, T23] Replay of ops (seq_id, seq_no, op, n): the state after each operation, and whether it was accepted.

    create, append n, remove n (from the end), begin, commit n (n accepted tokens of those appended since begin), rollback,
    destroy. One sequence is one task's work.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        length, mark, live, out = 0, None, False, []
        for r in pdf.sort_values("seq_no").itertuples():
            n, ok = int(r.n), live
            if r.op == "create":
                ok = not live
                if ok:
                    live, length, mark = True, 0, None
            elif r.op == "append":
                ok = live and n > 0
                length += n if ok else 0
            elif r.op == "remove":
                ok = live and mark is None and 0 < n <= length
                length -= n if ok else 0
            elif r.op == "begin":
                ok = live and mark is None
                mark = length if ok else mark
            elif r.op == "commit":
                ok = live and mark is not None and 0 <= n <= length - mark
                if ok:
                    length, mark = mark + n, None
            elif r.op == "rollback":
                ok = live and mark is not None
                if ok:
                    length, mark = mark, None
            elif r.op == "destroy":
                if ok:
                    live, length, mark = False, 0, None
            else:
                ok = False
            out.append((r.seq_id, r.seq_no, r.op, ok, length, mark is not None))
        return pd.DataFrame(out, columns=[c.split()[0] for c in FOLDED.split(", ")])

    return ops.groupBy("seq_id").applyInPandas(one, FOLDED)


#: [T5] The steps of sealing pages, with a fault point before each.
SEAL_STEPS = ("validate", "quantize", "pack", "checksum", "stage", "publish", "release")


class SealFault(RuntimeError):
    """A step that could not be done; nothing was published."""


def seal(values: DataFrame, keys: list[str], page: int, stage, publish, release=None, fault: str | None = None) -> DataFrame:
    """[T5] Full pages of values (keys, idx, x) quantized, packed, summed up and published, all of them or none.

    validate refuses values that are not finite; quantize gives int4 codes by page; pack puts two codes in a byte; checksum digests
    scale and payload; stage(df) writes the pages where nobody reads them and returns them as written; publish(df) makes them
    visible in one atomic act; release() lets the tail's memory go. A fault before publish leaves the tail full and nothing
    visible; one after it keeps the pages. Returns the published pages.
    """

    def at(step: str) -> None:
        if step == fault:
            raise SealFault(step)

    at("validate")
    full = sealed(values, keys, page).where("is_sealed")
    if full.where(F.isnan("x") | (F.abs("x") == float("inf")) | F.col("x").isNull()).limit(1).count():
        raise SealFault("validate")
    at("quantize")
    codes = codec.quantized(full, [*keys, "page"], 4)
    at("pack")
    nibble = F.array_sort(F.collect_list(F.struct("idx", F.col("q").bitwiseAND(15).alias("q"))))
    rows = codes.groupBy(*keys, "page").agg(F.first("s").alias("scale"), F.count("*").cast("int").alias("n"), nibble.alias("c"))
    pairs = F.transform(F.sequence(F.lit(0), F.expr("(n + 1) div 2 - 1")), lambda k: F.get("c", (k * 2).cast("int"))["q"] + F.coalesce(F.get("c", (k * 2 + 1).cast("int"))["q"], F.lit(0)) * 16)
    rows = rows.withColumn("payload", F.unhex(F.array_join(F.transform(pairs, lambda b: F.lpad(F.hex(b), 2, "0")), ""))).drop("c")
    at("checksum")
    rows = rows.withColumn("checksum", F.sha2(F.concat(F.encode(F.col("scale").cast("string"), "UTF-8"), F.col("payload")), 256))
    at("stage")
    staged = stage(rows)
    at("publish")
    publish(staged)
    at("release")
    if release:
        release()
    return staged
