"""Queries on token streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqpack.operators import search, succinct
from seqpack.plans import bindings as B
from seqpack.plans.registry import query

GRAMS = "g as (select stream_id, pos, sym as a, lead(sym, 1) over w as b, lead(sym, 2) over w as c from tok window w as (partition by stream_id order by pos))"
PATTERNS = "p as (select distinct a, b, c from g where c is not null and pos = 5 union select 'view', 'none', 'view')"


def _patterns(spark: SparkSession, tokens: DataFrame) -> DataFrame:
    seen = search.ngrams(tokens, 3).where("pos = 5").select("gram")
    never = spark.range(1).select(F.array(F.lit("view"), F.lit("none"), F.lit("view")).alias("gram"))
    return seen.union(never).distinct().select(F.concat_ws(" ", "gram").alias("pid"), F.col("gram").alias("syms"))


@query("pattern_count", f"with {B.EVENTS}, {GRAMS}, {PATTERNS} select p.a, p.b, p.c, count(g.pos) as n from p left join g on p.a = g.a and p.b = g.b and p.c = g.c group by all")
def pattern_count(spark, d):
    """[A5] How often each three-symbol pattern occurs in the event streams, patterns that never occur included."""
    t = B.event_tokens(spark, d)
    return search.count(t, _patterns(spark, t), [3]).select(*[F.col("syms")[k].alias(c) for k, c in enumerate("abc")], "n")


@query("pattern_locate", f"with {B.EVENTS}, {GRAMS}, {PATTERNS} select a || ' ' || b || ' ' || c as pid, stream_id, pos from g join p using (a, b, c)")
def pattern_locate(spark, d):
    """[J5] Where each of the patterns stands."""
    t = B.event_tokens(spark, d)
    return search.locate(t, _patterns(spark, t), [3])


@query("located_positions", f"with {B.EVENTS}, {GRAMS}, {PATTERNS} select a || ' ' || b || ' ' || c as pid, stream_id, string_agg(pos::varchar, ',' order by pos) as positions from g join p using (a, b, c) group by all")
def located_positions(spark, d):
    """[O6] The positions of each pattern in order."""
    return search.located_lists(pattern_locate(spark, d)).select("pid", "stream_id", F.concat_ws(",", F.col("positions").cast("array<string>")).alias("positions"))


@query("text_pattern_count", f"with {B.TEXTS}, g as (select sym as a, lead(sym) over (partition by stream_id order by pos) as b from tok) select a || ' ' || b as pid, count(*) as n from g where a in ('the', 'of', 'de') and b is not null group by all")
def text_pattern_count(spark, d):
    """[A5] Pairs of words that begin with one of three words: other pairs are never made, and counts are summed before anything is shuffled."""
    rows = B.table(spark, d, "documents").select(F.col("doc_id").alias("stream_id"), F.split("text", " ").alias("syms"))
    return search.ngrams_of_rows(rows, 2, ("the", "of", "de")).groupBy(F.concat_ws(" ", "gram").alias("pid")).agg(F.count("*").alias("n"))


NEXT = "g as (select stream_id, pos, sym as a, lead(sym, 1) over w as b, lead(sym, 2) over w as nxt from tok window w as (partition by stream_id order by pos)), k as (select a, b, nxt, count(*) as n from g where nxt is not null group by all), best as (select * from k qualify row_number() over (partition by a, b order by n desc, nxt) = 1)"


@query("next_symbol", f"with {B.EVENTS}, {NEXT} select a, b, nxt as next, n from best")
def next_symbol(spark, d):
    """[O4] The likeliest symbol after each pair."""
    return search.next_symbol(B.event_tokens(spark, d), 2).select(F.col("gram")[0].alias("a"), F.col("gram")[1].alias("b"), "next", "n")


@query("draft_hit_rate", f"with {B.EVENTS}, {NEXT} select count(*) as queries, count_if(g.nxt = best.nxt)::bigint as hits, round(count_if(g.nxt = best.nxt) / count(*), 6) as hit_rate from g join best using (a, b) where g.nxt is not null")
def draft_hit_rate(spark, d):
    """[A32, J23] How often that symbol follows."""
    return search.draft_hit_rate(B.event_tokens(spark, d), 2).withColumn("hit_rate", F.round("hit_rate", 6))


def _asked(spark, d):
    return B.table(spark, d, "events").select(F.col("user_id").alias("stream_id")).distinct()


@query("seq_access", f"with {B.EVENTS}, q as (select distinct stream_id, unnest([0, 3, 1000000]) as pos from tok) select q.stream_id * 10 + q.pos % 10 as qid, q.stream_id, q.pos::bigint as pos, sym from q left join tok using (stream_id, pos)")
def seq_access(spark, d):
    """[P1, P2] The symbol at a position."""
    q = _asked(spark, d).select("stream_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 3, 1000000)])).alias("pos"))
    return succinct.access(B.event_tokens(spark, d), q.withColumn("qid", F.col("stream_id") * 10 + F.col("pos") % 10))


@query("seq_slice", f"with {B.EVENTS} select stream_id, pos, sym from tok where pos between 2 and 4")
def seq_slice(spark, d):
    """[P3] A stretch of every stream."""
    return succinct.slice_(B.event_tokens(spark, d), 2, 5)


@query("seq_select", f"with {B.EVENTS}, n as (select *, row_number() over (partition by stream_id, sym order by pos) as k from tok), q as (select distinct stream_id, unnest(['view', 'click']) as sym from tok) select q.stream_id, q.sym, 2 as k, pos from q left join n on n.stream_id = q.stream_id and n.sym = q.sym and n.k = 2")
def seq_select(spark, d):
    """[P4] Where a symbol stands for the second time."""
    q = _asked(spark, d).select("stream_id", F.explode(F.array(F.lit("view"), F.lit("click"))).alias("sym")).withColumn("k", F.lit(2)).withColumn("qid", F.col("stream_id"))
    return succinct.select(B.event_tokens(spark, d), q).drop("qid")


RANK = f"with {B.EVENTS}, q as (select distinct stream_id, unnest(['view', 'purchase']) as sym from tok), i as (select *, unnest([0, 5, 64, 100]) as i from q) select i.stream_id as qid, i.stream_id, i.sym, i.i::bigint as i, count(tok.pos) as rank from i left join tok on tok.stream_id = i.stream_id and tok.sym = i.sym and tok.pos < i.i group by all"


def _ranked(spark, d):
    q = _asked(spark, d).select(F.col("stream_id").alias("qid"), "stream_id", F.explode(F.array(F.lit("view"), F.lit("purchase"))).alias("sym"))
    return q.select("*", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 5, 64, 100)])).alias("i"))


@query("seq_rank", RANK)
def seq_rank(spark, d):
    """[A1, A3] How often a symbol stands before a position."""
    return succinct.rank(B.event_tokens(spark, d), _ranked(spark, d))


@query("seq_rank_indexed", RANK)
def seq_rank_indexed(spark, d):
    """[A2] The same by a block directory alone."""
    t = B.event_tokens(spark, d)
    return succinct.rank_indexed(succinct.rank_directory(t), _ranked(spark, d))


@query("rank_directory", f"with {B.EVENTS}, k as (select stream_id, sym, pos // 4 as blk, count(*) as n, bit_or(1::bigint << (pos % 4)::int) as bits from tok group by all) select stream_id, sym, blk, n, coalesce(sum(n) over (partition by stream_id, sym order by blk rows between unbounded preceding and 1 preceding), 0)::bigint as before, bits from k")
def rank_directory(spark, d):
    """[W5, P9] Counts before each block."""
    return succinct.rank_directory(B.event_tokens(spark, d), 4)


PLANES = f"{B.CODED}, planes as (select stream_id, pos, l.plane, ((sym >> (2 - l.plane)) & 1)::int as bit from coded, (select unnest([0, 1, 2]) as plane) l)"


@query("bit_planes", f"with {PLANES} select stream_id, plane, count(*) as n, sum(bit)::bigint as ones from planes group by all")
def bit_planes(spark, d):
    """[P10] Ones of each bit plane of the coded symbols."""
    return succinct.bit_planes(B.coded_events(spark, d), 3).groupBy("stream_id", "plane").agg(F.count("*").alias("n"), F.sum("bit").alias("ones"))


@query("bitplane_rank1", f"with {PLANES}, q as (select distinct stream_id, plane, unnest([0, 5, 40]) as i from planes) select q.stream_id, q.plane, q.i::bigint as i, count(p.pos) as rank1 from q left join (select * from planes where bit = 1) p on p.stream_id = q.stream_id and p.plane = q.plane and p.pos < q.i group by all")
def bitplane_rank1(spark, d):
    """[A4] Ones before a position."""
    planes = succinct.bit_planes(B.coded_events(spark, d), 3)
    q = _asked(spark, d).select(F.col("stream_id").alias("qid"), "stream_id", F.explode(F.array(*[F.lit(x) for x in range(3)])).alias("plane"))
    q = q.select("*", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 5, 40)])).alias("i"))
    return succinct.rank1(planes, q).drop("qid")


@query("wavelet_partition", f"with {PLANES} select stream_id, plane, pos, bit, row_number() over (partition by stream_id, plane order by bit, pos) - 1 as new_pos from planes")
def wavelet_partition(spark, d):
    """[O3] Stable partition of each plane."""
    return succinct.stable_partition(succinct.bit_planes(B.coded_events(spark, d), 3))


@query("c_table", f"with {B.EVENTS}, k as (select stream_id, sym, count(*) as n from tok group by all) select stream_id, sym, n, coalesce(sum(n) over (partition by stream_id order by sym rows between unbounded preceding and 1 preceding), 0)::bigint as c from k")
def c_table(spark, d):
    """[A7] Counts of smaller symbols."""
    return succinct.c_table(B.event_tokens(spark, d))


H0 = "k as (select stream_id, sym, count(*) as n from tok group by all), e as (select stream_id, -sum(p * log2(p)) as h0 from (select stream_id, n / sum(n) over (partition by stream_id) as p from k) group by all)"


@query("entropy_h0", f"with {B.EVENTS}, {H0} select stream_id, round(h0, 6) + 0 as h0 from e")
def entropy_h0(spark, d):
    """[A8] Order-0 entropy."""
    return succinct.entropy(B.event_tokens(spark, d)).select("stream_id", (F.round("h0", 6) + F.lit(0.0)).alias("h0"))


@query("footprint", f"with {B.EVENTS}, {H0}, s as (select stream_id, count(*) as n, count(distinct sym) as sigma, greatest(1, ceil(log2(count(distinct sym) + 1))) as levels from tok group by all) select stream_id, n, sigma, levels::bigint as levels, round(levels * (ceil(n / 32) * 32 + ceil(n / 512) * 32) / n, 6) as packed_bits, round(h0, 6) + 0 as h0 from s join e using (stream_id)")
def footprint(spark, d):
    """[A34, P54] Packed bits a token against entropy."""
    return succinct.footprint(B.event_tokens(spark, d)).select("stream_id", "n", "sigma", "levels", F.round("packed_bits", 6).alias("packed_bits"), (F.round("h0", 6) + F.lit(0.0)).alias("h0"))


SA = f"{B.ROLES}, l as (select stream_id, list(sym order by pos) as s from tok group by all), sfx as (select stream_id, s, unnest(range(0, len(s) + 1)) as pos from l), sa as (select stream_id, pos, row_number() over (partition by stream_id order by s[pos + 1:]) - 1 as sa_rank from sfx)"


@query("suffix_array", f"with {SA} select stream_id, sa_rank, pos from sa")
def suffix_array(spark, d):
    """[O1, O2, W3] Suffix arrays of the conversations, by prefix doubling within each stream."""
    return search.suffix_array(B.role_tokens(spark, d))


@query("suffix_array_long", "with s as (select string_agg(substr(event_type, 1, 1), '' order by event_id) as s from events), f as (select unnest(range(0, length(s) + 1)) as pos, s from s) select 0::bigint as stream_id, row_number() over (order by substr(s, pos + 1)) - 1 as sa_rank, pos from f")
def suffix_array_long(spark, d):
    """[O1, O2, W3, W4] All events as one stream: rounds of joins and ranks, no task holds the stream."""
    t = B.table(spark, d, "events").select(F.lit(0).cast("long").alias("stream_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("sym"))
    return search.suffix_array_long(t)


@query("sampled_suffix_array", f"with {SA} select stream_id, sa_rank, pos, row_number() over (partition by stream_id order by sa_rank) - 1 as mark_rank from sa where pos % 2 = 0")
def sampled_suffix_array(spark, d):
    """[O8] Every second position and its mark."""
    return search.sampled(suffix_array(spark, d), 2)


@query("bwt", f"with {SA} select sa.stream_id, sa_rank, coalesce(tok.sym, '$') as sym from sa left join tok on tok.stream_id = sa.stream_id and tok.pos = sa.pos - 1")
def bwt(spark, d):
    """[W8] The Burrows-Wheeler transform."""
    return search.bwt(B.role_tokens(spark, d), suffix_array(spark, d))


@query("pattern_ranges", f"with {SA}, g as (select stream_id, pos, sym as a, lead(sym) over (partition by stream_id order by pos) as b from tok) select a || ' ' || b as pid, g.stream_id, min(sa_rank) as lo, max(sa_rank) + 1 as hi from g join sa on sa.stream_id = g.stream_id and sa.pos = g.pos where b is not null group by all")
def pattern_ranges(spark, d):
    """[A6] The rank ranges of every pair of roles."""
    t = B.role_tokens(spark, d)
    patterns = search.ngrams(t, 2).select(F.concat_ws(" ", "gram").alias("pid"), F.col("gram").alias("syms")).distinct()
    return search.ranges(t, suffix_array(spark, d), patterns, [2])


SORTED = f"with {B.EVENTS} select stream_id, pos, sym from tok order by all"


@query("seq_access_sorted", SORTED)
def seq_access_sorted(spark, d):
    """[O7, P1] Access at sorted positions, every one of every stream: neither side is small."""
    t = B.event_tokens(spark, d)
    q = t.select(F.col("stream_id").alias("qid"), "stream_id", "pos")
    return succinct.access(t, q).drop("qid")


@query("seq_access_contiguous", f"with {B.EVENTS} select stream_id, pos, sym from tok where pos < 20")
def seq_access_contiguous(spark, d):
    """[O7, P1] Access at contiguous positions: the head of every stream."""
    t = B.event_tokens(spark, d)
    return succinct.access(t, t.where("pos < 20").select(F.col("stream_id").alias("qid"), "stream_id", "pos")).drop("qid")


@query("sql_functions", f"with {B.EVENTS}, a as (select stream_id, pos, sym as x, lead(sym) over (partition by stream_id order by pos) as y from tok) select 'locate' as f, stream_id, pos, null::bigint as n from a where x = 'view' and y = 'click' union all select 'count', null, null, count(*) from a where x = 'view' and y = 'click' union all select 'rank', 3, 10, (select count(*) from tok where stream_id = 3 and sym = 'view' and pos < 10) union all select 'slice', 3, pos, length(sym) from tok where stream_id = 3 and pos >= 2 and pos < 5")
def sql_functions(spark, d):
    """[U1, U5] The table functions that spark.sql users call."""
    from seqpack.functions import sql

    sql.register(spark, B.event_tokens(spark, d))
    return spark.sql("""
        select 'locate' as f, stream_id, pos, cast(null as bigint) as n from seq_locate('view', 'click')
        union all select 'count', null, null, n from seq_count('view', 'click')
        union all select 'rank', 3, 10, rank from seq_rank(3, 'view', 10)
        union all select 'slice', 3, pos, cast(length(sym) as bigint) from seq_slice(3, 2, 5)""")
