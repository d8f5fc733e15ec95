"""Queries on vectors: codecs, gathers, products, attention."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqpack.operators import codec, kv
from seqpack.plans import bindings as B
from seqpack.plans.registry import query

V = f"with {B.VECTORS}"


def _pages(spark, d):
    return B.vectors(spark, d).withColumn("idx", F.expr("(token % 64) * 64 + dim"))


PAGED = f"with {B.VECTORS}, pg as (select *, (token % 64) * 64 + dim as idx from vec)"


def _histogram(df):
    return df.groupBy("q").agg(F.count("*").alias("n"))


def _codes(partition, qmax, code):
    return f"{V}, s as (select *, max(abs(x)) over (partition by {partition}) as top from vec), c as (select *, case when top > 0 then top / {qmax} else 1 end as s from s) select {code} as q, count(*) as n from c group by 1"


@query("quant_int4_half_away", _codes("page, dim // 16, dim", 7, "greatest(-7, least(7, round(x / s)::int))"))
def quant_int4_half_away(spark, d):
    """[P15, P17, P18] Int4 codes by channel, half away from zero."""
    v = B.vectors(spark, d).withColumn("head", F.expr("dim div 16"))
    return _histogram(codec.quantized(v, ["page", "head", "dim"], 4, "away"))


@query("quant_int4_half_even", _codes("page, token, dim // 16", 7, "greatest(-8, least(7, round_even(x / s, 0)::int))"))
def quant_int4_half_even(spark, d):
    """[P16, P17] Int4 codes by token and head, half to even."""
    v = B.vectors(spark, d).withColumn("head", F.expr("dim div 16"))
    return _histogram(codec.quantized(v, ["page", "token", "head"], 4))


@query("quant_int8", _codes("page, dim", 127, "greatest(-128, least(127, round_even(x / s, 0)::int))"))
def quant_int8(spark, d):
    """[P16] Int8 codes by channel."""
    return _histogram(codec.quantized(B.vectors(spark, d), ["page", "dim"], 8))


@query("quant_int2", _codes("page, dim", 1, "greatest(-2, least(1, round_even(x / s, 0)::int))"))
def quant_int2(spark, d):
    """[P25, P26] Int2 codes by channel."""
    return _histogram(codec.quantized(B.vectors(spark, d), ["page", "dim"], 2))


@query("quant_blockwise", f"{PAGED}, s as (select *, idx // 32 as blk, max(abs(x)) over (partition by page, idx // 32) / 7 as s from pg) select page, blk, sum(greatest(-8, least(7, round_even(x / s, 0)::int)) + 8)::bigint as code_sum, count_if(round_even(x / s, 0) not between -8 and 7)::bigint as saturated from s group by all")
def quant_blockwise(spark, d):
    """[P23] Int4 codes with zero point 8 by blocks of 32."""
    return codec.blockwise(_pages(spark, d)).groupBy("page", "blk").agg(F.sum("q").alias("code_sum"), F.sum("saturated").alias("saturated"))


@query("page_dequantize", f"{PAGED}, s as (select *, max(abs(x)) over (partition by page, dim) / 7 as s from pg) select page, round(sum(greatest(-8, least(7, round_even(x / s, 0))) * s), 5) + 0 as back_sum from s group by all")
def page_dequantize(spark, d):
    """[P21] What the codes of a page give back."""
    return codec.quantized(_pages(spark, d), ["page", "dim"], 4).groupBy("page").agg((F.round(F.sum("back"), 5) + F.lit(0.0)).alias("back_sum"))


ANALYSIS = f"{PAGED}, t as (select *, max(abs(x)) over (partition by page) as top from pg), a as (select page, count(*) as n, max(abs(x)) as abs_max, var_pop(x) as variance, count_if(abs(x) > top * 0.75) / count(*) as outlier_ratio, max(abs(x)) / 3 as error2, max(abs(x)) / 15 as error4, max(abs(x)) / 255 as error8, count_if(isnan(x))::bigint as nan_values, count_if(isinf(x))::bigint as inf_values from t group by page)"
CHOICE = f"{ANALYSIS}, ch as (select *, case when error2 <= 0.02 then 2 when error4 <= 0.02 then 4 when error8 <= 0.02 then 8 else 16 end as bits from a), b as (select *, case bits when 2 then (n + 3) // 4 when 4 then (n + 1) // 2 when 8 then n else n * 2 end as bytes from ch)"
BUDGET = 0.02


@query("page_analysis", f"{ANALYSIS} select page, n, round(abs_max, 6) as abs_max, round(variance, 6) as variance, round(outlier_ratio, 6) as outlier_ratio, round(error2, 6) as error2, round(error4, 6) as error4, round(error8, 6) as error8, nan_values, inf_values from a")
def page_analysis(spark, d):
    """[A12, P30] Range, spread, outliers and error estimates of each page."""
    a = codec.analysed(_pages(spark, d))
    return a.select("page", "n", *[F.round(c, 6).alias(c) for c in ("abs_max", "variance", "outlier_ratio", "error2", "error4", "error8")], "nan_values", "inf_values")


@query("adaptive_codec", f"{CHOICE} select page, bits, bytes::bigint as bytes from b")
def adaptive_codec(spark, d):
    """[P26, P27] The codec of each page under an error budget."""
    return codec.chosen(codec.analysed(_pages(spark, d)), BUDGET).select("page", "bits", "bytes")


@query("codec_distribution", f"{CHOICE} select bits, count(*) as pages, sum(bytes)::bigint as bytes, sum(greatest(0, n * 4 - bytes))::bigint as saved from b group by all")
def codec_distribution(spark, d):
    """[A13] Pages and bytes of each codec."""
    return codec.distribution(codec.chosen(codec.analysed(_pages(spark, d)), BUDGET))


@query("roundtrip_error", f"{CHOICE}, e as (select pg.*, bits, max(abs(x)) over (partition by pg.page, idx // 32) / case bits when 2 then 1 when 4 then 7 when 8 then 127 end as s from pg join b on b.page = pg.page), r as (select page, abs(x - case bits when 2 then greatest(-2, least(1, round_even(x / s, 0))) * s when 4 then greatest(-8, least(7, round_even(x / s, 0))) * s when 8 then greatest(-128, least(127, round_even(x / s, 0))) * s else round_even(x, 0) end) as e from e) select page, round(max(e), 6) as max_error, round(avg(e), 6) as mean_error from r group by all")
def roundtrip_error(spark, d):
    """[P28] Largest and mean error of the encoded pages."""
    p = _pages(spark, d)
    e = codec.encoded(p, codec.chosen(codec.analysed(p), BUDGET)).withColumn("e", F.abs(F.col("x") - F.col("back")))
    return e.groupBy("page").agg(F.round(F.max("e"), 6).alias("max_error"), F.round(F.avg("e"), 6).alias("mean_error"))


@query("recompress_error", f"{PAGED}, a as (select *, max(abs(x)) over (partition by page, idx // 32) / 127 as s8 from pg), b as (select *, greatest(-128, least(127, round_even(x / s8, 0))) * s8 as y from a), c as (select *, max(abs(y)) over (partition by page, idx // 32) / 7 as s4 from b) select page, round(max(abs(y - greatest(-8, least(7, round_even(y / s4, 0))) * s4)), 6) as max_error from c group by all")
def recompress_error(spark, d):
    """[P28] From int8 to int4 pages."""
    p = _pages(spark, d).withColumn("blk", F.expr("idx div 32"))
    once = codec.quantized(p, ["page", "blk"], 8).select("page", "idx", "blk", F.col("back").alias("x"))
    twice = codec.quantized(once, ["page", "blk"], 4)
    return twice.groupBy("page").agg(F.round(F.max(F.abs(F.col("x") - F.col("back"))), 6).alias("max_error"))


@query("nibble_roundtrip", f"{PAGED}, s as (select *, max(abs(x)) over (partition by page) / 7 as s from pg) select page, idx::int as idx, greatest(-8, least(7, round_even(x / s, 0)::int)) as q from s")
def nibble_roundtrip(spark, d):
    """[P22, P24] Codes of all pages packed in half bytes and unpacked."""
    q = codec.quantized(_pages(spark, d), ["page"], 4).select("page", "idx", "q")
    return codec.from_nibbles(codec.nibbles(q, ["page"]), ["page"]).withColumn("idx", F.col("idx").cast("int"))


def _ids(spark, d):
    """Event streams whose symbols are vector ids."""
    n = B.table(spark, d, "embeddings").agg((F.max("vec_id") + 1).alias("n"))
    t = B.table(spark, d, "events").select("user_id", "ts", "event_id")
    from pyspark.sql.window import Window

    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return t.crossJoin(n).select(F.col("user_id").alias("stream_id"), pos.cast("long").alias("pos"), (F.col("event_id") % F.col("n")).alias("sym"))


def _embedding(spark, d):
    return B.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


IDS = "t as (select user_id as stream_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, event_id % (select max(vec_id) + 1 from embeddings) as sym from events)"
GATHER = "with {ids}, q as (select distinct stream_id, unnest({at}) as pos from t) select t.stream_id, t.pos, vec_id as id, round(embedding[1]::double, 6) + 0 as first, round(list_sum(embedding::double[]), 5) + 0 as total from q join t using (stream_id, pos) join embeddings on vec_id = sym"


def _gathered(f, spark, d, at):
    t = _ids(spark, d)
    q = t.select("stream_id").distinct().select("stream_id", F.explode(F.array(*[F.lit(x).cast("long") for x in at])).alias("pos")).withColumn("qid", F.col("stream_id"))
    out = f(q, t, _embedding(spark, d))
    return out.select("stream_id", "pos", "id", (F.round(F.col("vec")[0], 6) + F.lit(0.0)).alias("first"), (F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 5) + F.lit(0.0)).alias("total"))


@query("embed_gather", GATHER.format(ids=IDS, at="[0, 3]"))
def embed_gather(spark, d):
    """[J1] Rows of the symbols at two positions of every stream."""
    return _gathered(kv.gather, spark, d, (0, 3))


@query("sparse_gather", GATHER.format(ids=IDS, at="[7]"))
def sparse_gather(spark, d):
    """[J2] Rows of a few positions, without decoding the rest."""
    return _gathered(kv.gather, spark, d, (7,))


@query("gather_after_full_decode", GATHER.format(ids=IDS, at="[7]"))
def gather_after_full_decode(spark, d):
    """[J3] The same after decoding everything."""
    return _gathered(kv.gather_decoded, spark, d, (7,))


DELTA = f"with {B.ROLES}, k as (select pos, sym, count(*) as n from tok group by all), base as (select pos, sym as val from k qualify row_number() over (partition by pos order by n desc, sym) = 1), delta as (select stream_id as leaf, tok.pos, sym as val from tok join base on base.pos = tok.pos and base.val <> tok.sym)"


def _cluster(spark, d):
    from pyspark.sql.window import Window

    t = B.role_tokens(spark, d)
    n = t.groupBy("pos", "sym").agg(F.count("*").alias("n"))
    base = n.withColumn("r", F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("n"), "sym"))).where("r = 1").select("pos", F.col("sym").alias("val"))
    delta = t.join(base, "pos").where("sym <> val").select(F.col("stream_id").alias("leaf"), "pos", F.col("sym").alias("val"))
    return t, base, delta


@query("delta_fetch", f"{DELTA}, q as (select distinct stream_id as leaf, unnest([0, 1, 5, 1000]) as pos from tok) select q.leaf, q.pos::bigint as pos, coalesce(delta.val, base.val, '-1') as val from q left join delta on delta.leaf = q.leaf and delta.pos = q.pos left join base on base.pos = q.pos")
def delta_fetch(spark, d):
    """[J4] Values of leaves stored as deltas to the most common ones."""
    t, base, delta = _cluster(spark, d)
    q = t.select(F.col("stream_id").alias("leaf")).distinct().select("leaf", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 1, 5, 1000)])).alias("pos"))
    return kv.delta_fetch(q, base, delta)


@query("delta_footprint", f"{DELTA} select b as base_n, e as delta_n, w as whole_n, b * 4 + e * 8 as stored_bytes, w * 4 as whole_bytes, round(w * 4 / (b * 4 + e * 8), 6) as ratio from (select count(*) as b from base), (select count(*) as e from delta), (select count(*) as w from tok)")
def delta_footprint(spark, d):
    """[A33] What the deltas save."""
    t, base, delta = _cluster(spark, d)
    return kv.delta_footprint(base, delta, t).withColumn("ratio", F.round("ratio", 6))


@query("quant_matmul", f"{V}, w as (select token as m, dim as k, x, max(abs(x)) over (partition by token) / 7 as s from vec), i as (select page as b, dim as k, avg(x) as v from vec group by all) select b, m, round(sum(v * greatest(-8, least(7, round_even(x / s, 0))) * s), 4) + 0 as y from i join w using (k) group by all")
def quant_matmul(spark, d):
    """[A30, P12] The mean vector of each page times the int4 rows of all tokens."""
    v = B.vectors(spark, d)
    w = codec.quantized(v, ["token"], 4).select(F.col("token").alias("m"), F.col("dim").alias("k"), "q", "s")
    i = v.groupBy(F.col("page").alias("b"), F.col("dim").alias("k")).agg(F.avg("x").alias("v"))
    return kv.matmul(i, w, digits=4)


HEAD = 16
ATTN = f"{V}, h as (select token, dim // {HEAD} as head, list(x order by dim) as v from vec group by all)"


def _attn(pairs, key="k", value="v", out="o"):
    return f"p as ({pairs}), m as (select *, max(s) over (partition by qpos, qhead) as top from p), w as (select *, exp(s - top) as w from m), z as (select qpos, qhead, sum(w) as z from w group by all), x as (select qpos, qhead, w, unnest(vv) as c, generate_subscripts(vv, 1) - 1 as i from w), {out} as (select x.qpos, x.qhead, i, sum(w * c) / any_value(z) as o from x join z using (qpos, qhead) group by all)"


def _hist(spark, d):
    h = kv.heads(B.vectors(spark, d), HEAD)
    return h.select(F.col("token").alias("qpos"), F.col("head").alias("qhead"), F.col("v").alias("q")), h.select("token", "head", F.col("v").alias("k"), "v")


def _flat(df, *keys):
    return df.select(*(keys or ("qpos", "qhead")), F.posexplode("out").alias("i", "o")).withColumn("o", F.round("o", 5) + F.lit(0.0))


def _pairs(window, group=1, heads="q.head"):
    bound = f"and h.token > q.token - {window}" if window else ""
    return f"select q.token as qpos, {heads} as qhead, list_dot_product(q.v, h.v) / sqrt({HEAD}) as s, h.v as vv from h q join h on h.head = {heads} // {group} and h.token <= q.token {bound}"


@query("attention_window", f"{ATTN}, {_attn(_pairs(16))} select qpos, qhead, i::int as i, round(o, 5) + 0 as o from o")
def attention_window(spark, d):
    """[J7, J8, A9, W1] Each token attends to the last 16."""
    q, h = _hist(spark, d)
    return _flat(kv.attention(q, h, 16, HEAD))


@query("attention_full", f"{ATTN}, {_attn(_pairs(0))} select qpos, qhead, i::int as i, round(o, 5) + 0 as o from o")
def attention_full(spark, d):
    """[J7] Each token attends to its whole history."""
    q, h = _hist(spark, d)
    return _flat(kv.attention(q, h, 0, HEAD))


@query("attention_gqa", f"{ATTN}, g as (select token, unnest([head * 2, head * 2 + 1]) as qhead, v from h), {_attn(f'select g.token as qpos, g.qhead, list_dot_product(g.v, h.v) * (1 + g.qhead % 2) / sqrt({HEAD}) as s, h.v as vv from g join h on h.head = g.qhead // 2 and h.token between g.token - 7 and g.token')} select qpos, qhead, i::int as i, round(o, 5) + 0 as o from o")
def attention_gqa(spark, d):
    """[J7, P41] Two query heads share each head; the odd one asks with twice its length."""
    q, h = _hist(spark, d)
    two = q.select("qpos", F.explode(F.array(F.lit(0), F.lit(1))).alias("odd"), "qhead", "q").select("qpos", (F.col("qhead") * 2 + F.col("odd")).alias("qhead"), F.transform("q", lambda x: x * (F.col("odd") + 1)).alias("q"))
    return _flat(kv.attention(two, h, 8, HEAD, group=2))


TAIL = f"{V}, edge as (select max(token) // 64 * 64 as first from vec), s as (select *, max(abs(x)) over (partition by page, dim) / 7 as s from vec), c as (select token, dim, x, case when token < first then greatest(-7, least(7, round(x / s))) * s else x end as y from s, edge), h as (select token, dim // {HEAD} as head, list(y order by dim) as v from c group by all), qq as (select token, dim // {HEAD} as head, list(x order by dim) as v from vec group by all), "


@query("attention_paged_tail", TAIL + _attn(f"select q.token as qpos, q.head as qhead, list_dot_product(q.v, h.v) / sqrt({HEAD}) as s, h.v as vv from qq q join h on h.head = q.head and h.token between q.token - 15 and q.token") + " select qpos, qhead, i::int as i, round(o, 5) + 0 as o from o")
def attention_paged_tail(spark, d):
    """[X1, J7, P18, T2, A38] Sealed int4 pages and the dense tail are one history."""
    v = B.vectors(spark, d)
    edge = v.agg((F.expr("max(token) div 64") * 64).alias("first"))
    v = v.crossJoin(edge)
    sealed = codec.quantized(v.where("token < first"), ["page", "dim"], 4, "away").select("token", "dim", F.col("back").alias("x"))
    history = kv.heads(sealed.unionByName(v.where("token >= first").select("token", "dim", "x")), HEAD)
    q, _ = _hist(spark, d)
    return _flat(kv.attention(q, history.select("token", "head", F.col("v").alias("k"), "v"), 16, HEAD))


@query("softmax_merge", f"{V} select token, round(sum(exp(x) * dim) / sum(exp(x)), 6) as out from vec group by all")
def softmax_merge(spark, d):
    """[A9, U2, W2] States of four parts merged; the weights are of x, the values are dims."""
    scores = B.vectors(spark, d).select("token", F.expr("dim div 16").alias("part"), F.col("x").alias("s"), F.col("dim").cast("double").alias("x"))
    return kv.merged_states(kv.softmax_states(scores, ["token", "part"]), ["token"]).withColumn("out", F.round("out", 6))


QUANT = "{v}, s as (select *, max(abs(x)) over (partition by page, dim) / 7 as s from vec), c as (select token, dim // 16 as head, list(greatest(-8, least(7, round_even(x / s, 0))) * s order by dim) as kq, list(x order by dim) as v from s group by all)"
ERR = QUANT.format(v=V) + f", pr as (select q.token as qpos, q.head as qhead, h.v, list_dot_product(q.v, h.v) / 4 as s, list_dot_product(q.v, h.kq) / 4 as sq from c q join c h on h.head = q.head and h.token between q.token - 15 and q.token), " + _attn("select qpos, qhead, s, v as vv from pr", out="o1").replace("p as", "p1 as", 1).replace("from p)", "from p1)").replace("m as", "m1 as", 1).replace("from m)", "from m1)").replace(" w as (select *,", " w1 as (select *,", 1).replace("from w group", "from w1 group").replace("from w)", "from w1)").replace(" z as (select qpos", " z1 as (select qpos", 1).replace("join z using", "join z1 using").replace(" x as (select qpos", " x1 as (select qpos", 1).replace("from x join", "from x1 x join") + ", " + _attn("select qpos, qhead, sq as s, v as vv from pr", out="o2")


@query("attention_error", ERR + " select o1.qhead, round(max(abs(o1.o - o2.o)), 5) as max_error, round(avg(abs(o1.o - o2.o)), 5) as mean_error from o1 join o2 using (qpos, qhead, i) group by all")
def attention_error(spark, d):
    """[A25] Attention over int4 keys against dense keys, by head."""
    q, h = _hist(spark, d)
    keys = kv.heads(codec.quantized(B.vectors(spark, d), ["page", "dim"], 4).select("token", "dim", F.col("back").alias("x")), HEAD)
    coded = h.select("token", "head", "v").join(keys.select("token", "head", F.col("v").alias("k")), ["token", "head"])
    out = kv.compared(kv.attention(q, coded, 16, HEAD), kv.attention(q, h, 16, HEAD), ["qpos", "qhead"], ["qhead"])
    return out.select("qhead", F.round("max_error", 5).alias("max_error"), F.round("mean_error", 5).alias("mean_error"))


FRONT = f"{PAGED}, " + ", ".join(f"f{b}{g} as (select '{b}-bit by {g}' as config, abs(x - greatest({lo}, least({hi}, round_even(x / s, 0))) * s) as e from (select x, max(abs(x)) over (partition by page, {g}) / {m} as s from pg))" for b, m, lo, hi in ((4, 7, -8, 7), (8, 127, -128, 127)) for g in ("dim", "token"))


@query("quantizer_frontier", FRONT + " select config, round(avg(e), 6) as mean_error, round(max(e), 6) as max_error from (" + " union all ".join(f"select * from f{b}{g}" for b in (4, 8) for g in ("dim", "token")) + ") group by all")
def quantizer_frontier(spark, d):
    """[A31, P53] Errors of four configurations."""
    out = None
    for bits in (4, 8):
        for by in ("dim", "token"):
            e = codec.quantized(_pages(spark, d), ["page", by], bits).select(F.lit(f"{bits}-bit by {by}").alias("config"), F.abs(F.col("x") - F.col("back")).alias("e"))
            out = e if out is None else out.unionByName(e)
    return out.groupBy("config").agg(F.round(F.avg("e"), 6).alias("mean_error"), F.round(F.max("e"), 6).alias("max_error"))
