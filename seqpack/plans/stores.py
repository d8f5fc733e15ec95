"""Queries on pages, sequences, placement, leases, security and scheduling."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqpack.functions import cuts, hashes
from seqpack.operators import control, store
from seqpack.plans import bindings as B
from seqpack.plans.registry import query

#: Pages: one for each order, 1 to 64 tokens long, on two layers and four heads; every third begins a little early.
PAGES = "pages as (select o_orderkey as page_id, (o_custkey % 2)::int as layer, (o_custkey // 2 % 4)::int as head, o_orderkey * 32 - case when o_orderkey % 3 = 0 then 20 else 0 end as begin, 1 + o_orderkey % 64 as n, 256 + 4 * (o_orderkey % 64) as bytes from orders)"
#: References: an order's line items refer to the page of their order, but for those on its first line in every fifth order.
REFS = "refs as (select l_suppkey as seq_id, (o_custkey % 2)::int as layer, o_orderkey * 32 - case when o_orderkey % 3 = 0 then 20 else 0 end as begin, 1 + o_orderkey % 64 as n, o_orderkey as page_id from lineitem join orders on o_orderkey = l_orderkey where o_orderkey % 5 > 0)"


def pages(spark, d):
    o = B.table(spark, d, "orders")
    return o.selectExpr("o_orderkey as page_id", "cast(o_custkey % 2 as int) as layer", "cast(o_custkey div 2 % 4 as int) as head", "o_orderkey * 32 - if(o_orderkey % 3 = 0, 20, 0) as begin", "1 + o_orderkey % 64 as n", "256 + 4 * (o_orderkey % 64) as bytes")


def refs(spark, d):
    """Line items and pages are dealt by page to parts of bounded size, so what a task sorts and groups does not grow with the tables."""
    line = B.table(spark, d, "lineitem")
    l = line.selectExpr("l_suppkey as seq_id", "l_orderkey as page_id").where("page_id % 5 > 0")
    p = pages(spark, d).select("page_id", "layer", "begin", "n")
    return cuts.dealt(l, line, "page_id").join(cuts.dealt(p, line, "page_id"), "page_id").select("seq_id", "layer", "begin", "n", "page_id")


@query("page_overlap", f"with {PAGES} select page_id, begin, covered from (select *, max(begin + n) over (partition by layer, head order by begin, page_id rows between unbounded preceding and 1 preceding) as covered from pages) where begin < covered")
def page_overlap(spark, d):
    """[J6, F2] Pages that begin before an earlier one ends."""
    return store.overlaps(pages(spark, d)).select("page_id", "begin", "covered")


@query("page_overlap_pairs", f"with {PAGES} select distinct b.page_id from pages a join pages b on a.layer = b.layer and a.head = b.head and (a.begin, a.page_id) < (b.begin, b.page_id) and b.begin < a.begin + a.n")
def page_overlap_pairs(spark, d):
    """[J6] The same pages as a theta join finds, by the ordered pass."""
    return store.overlaps(pages(spark, d)).select("page_id")


@query("page_validity", f"with {PAGES} select page_id, case when begin < 0 then 'negative begin' end as reasons from pages where begin < 0")
def page_validity(spark, d):
    """Unsound pages."""
    return store.invalid(pages(spark, d)).select("page_id", F.concat_ws(",", "reasons").alias("reasons"))


@query("page_refcount_audit", f"with {REFS}, real as (select page_id, count(*) as real from refs group by all), rec as (select l_orderkey as page_id, count(*) as refcount from lineitem where l_linenumber > 1 group by all) select coalesce(rec.page_id, real.page_id) as page_id, coalesce(refcount, 0) as refcount, coalesce(real, 0) as real from rec full join real on rec.page_id = real.page_id where coalesce(refcount, 0) <> coalesce(real, 0)")
def page_refcount_audit(spark, d):
    """[J13, A37] Pages whose recorded and real counts differ."""
    recorded = B.table(spark, d, "lineitem").where("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.count("*").alias("refcount"))
    return store.refcount_audit(recorded, refs(spark, d))


@query("page_reclaim", f"with {PAGES}, {REFS} select page_id, bytes from pages where page_id not in (select page_id from refs)")
def page_reclaim(spark, d):
    """[J12, T12] Pages nothing refers to."""
    return store.reclaimable(pages(spark, d), refs(spark, d)).select("page_id", "bytes")


TAILS = "tails as (select (c_custkey % 2)::int as layer, c_custkey % 63 as tail from customer)"


@query("cache_stats", f"with {PAGES}, {TAILS}, p as (select layer, count(*) as pages, sum(n)::bigint as sealed_tokens, sum(bytes)::bigint as sealed_bytes from pages group by all) select * from p join (select layer, sum(tail)::bigint as tail_tokens from tails group by all) using (layer)")
def cache_stats(spark, d):
    """[A10, A11] Pages, tokens and bytes of each layer."""
    tails = B.table(spark, d, "customer").selectExpr("cast(c_custkey % 2 as int) as layer", "c_custkey % 63 as tail")
    return store.stats(pages(spark, d), tails)


@query("tail_alignment", "select c_nationkey as layer, count(distinct c_custkey % 2) as lengths from customer group by all having count(distinct c_custkey % 2) > 1")
def tail_alignment(spark, d):
    """[T2] Layers whose heads have tails of different lengths."""
    t = B.table(spark, d, "customer").selectExpr("c_nationkey as layer", "c_custkey % 2 as tail")
    return store.aligned(t, ["layer"])


@query("seal_pages", f"with {B.EVENTS} select stream_id, pos // 16 as page, count(*) as n, bool_and((pos // 16 + 1) * 16 <= total) as is_sealed from (select *, count(*) over (partition by stream_id) as total from tok) group by all")
def seal_pages(spark, d):
    """[T1, X1] Full pages and the active tail of each stream."""
    t = B.event_tokens(spark, d).withColumnRenamed("pos", "idx")
    return store.sealed(t, ["stream_id"], 16).groupBy("stream_id", "page").agg(F.count("*").alias("n"), F.bool_and("is_sealed").alias("is_sealed"))


LIVE = "live as (select s_suppkey as seq_id from supplier where s_acctbal > 0)"


def _live(spark, d):
    return B.table(spark, d, "supplier").where("s_acctbal > 0").selectExpr("s_suppkey as seq_id")


@query("sequence_snapshot", f"with {PAGES}, {REFS}, {LIVE} select refs.seq_id, refs.layer, count(*) as pages, sum(bytes)::bigint as bytes, min(refs.begin) as first from refs join live using (seq_id) join pages using (page_id) group by all")
def sequence_snapshot(spark, d):
    """[J10, J11, T13] What a batch of live sequences reads."""
    s = store.snapshot(refs(spark, d), pages(spark, d), _live(spark, d))
    return s.groupBy("seq_id", "layer").agg(F.count("*").alias("pages"), F.sum("bytes").alias("bytes"), F.min("begin").alias("first"))


@query("batch_validation", f"with {LIVE} select event_id, user_id % 100 as seq_id from events where user_id % 100 not in (select seq_id from live)")
def batch_validation(spark, d):
    """[J11, X5] Items of sequences that are not live."""
    batch = B.table(spark, d, "events").selectExpr("event_id", "user_id % 100 as seq_id")
    return store.unknown_items(batch, _live(spark, d)).select("event_id", "seq_id")


@query("seq_copy", f"with {REFS} select seq_id, layer, page_id, count(*) as n from (select * from refs union all select 100000, layer, begin, n, page_id from refs where seq_id = 3 and begin >= 0 and begin + n <= 40000) group by all")
def seq_copy(spark, d):
    """[T7] A sequence and its copy share pages."""
    return store.copied(refs(spark, d), 3, 100000, 0, 40000).groupBy("seq_id", "layer", "page_id").agg(F.count("*").alias("n"))


@query("seq_remove", f"with {REFS} select seq_id, count(*) as n from refs where not (seq_id = 3 and begin >= -100 and begin + n <= 1000000) group by all")
def seq_remove(spark, d):
    """[T8] Pages of a range gone."""
    return store.removed(refs(spark, d), 3, -100, 1000000).groupBy("seq_id").agg(F.count("*").alias("n"))


@query("seq_shift", f"with {REFS} select seq_id, page_id, case when seq_id = 3 and begin >= 64 and begin + n <= 100000 then begin + 128 else begin end as begin, count(*) as k from refs where begin >= 0 group by all")
def seq_shift(spark, d):
    """[T9] Pages of a range moved."""
    return store.shifted(refs(spark, d).where("begin >= 0"), 3, 64, 100000, 128).groupBy("seq_id", "page_id", "begin").agg(F.count("*").alias("k"))


@query("registration", "select event_id, event_type, row_number() over (partition by user_id order by ts, event_id) = 1 as accepted from events")
def registration(spark, d):
    """[X4] The first registration of an id wins."""
    return store.first_wins(B.table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "event_type", "accepted")


@query("circuit_states", "select user_id, event_id, event_type from events where event_type in ('error', 'signup') qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def circuit_states(spark, d):
    """[T20] The last opening or recovery of each worker."""
    e = B.table(spark, d, "events").where("event_type in ('error', 'signup')").withColumn("at", F.struct("ts", "event_id"))
    return store.latest_wins(e, ["user_id"], "at").select("user_id", "event_id", "event_type")


#: An ordered fold as a recursive query: the state after each operation of each sequence.
SPECULATION = f"""with recursive {B.EVENTS},
ops as (select stream_id as seq_id, pos as seq_no, pos % 3 as n, case when pos = 0 then 'create' when sym = 'click' then 'begin' when sym = 'purchase' then 'commit' when sym = 'error' then 'rollback' else 'append' end as op from tok),
f as (
  select seq_id, seq_no, op, true as ok, 0::bigint as length, null::bigint as mark from ops where seq_no = 0
  union all
  select o.seq_id, o.seq_no, o.op, t.ok,
    case when not t.ok then f.length when o.op = 'append' then f.length + o.n when o.op = 'commit' then f.mark + o.n when o.op = 'rollback' then f.mark else f.length end,
    case when not t.ok then f.mark when o.op = 'begin' then f.length when o.op in ('commit', 'rollback') then null else f.mark end
  from f join ops o on o.seq_id = f.seq_id and o.seq_no = f.seq_no + 1,
  lateral (select case o.op when 'append' then o.n > 0 when 'begin' then f.mark is null when 'commit' then f.mark is not null and o.n <= f.length - f.mark when 'rollback' then f.mark is not null else false end as ok) t)
select seq_id, seq_no, op, ok, length, mark is not null as speculating from f"""


@query("speculation_replay", SPECULATION)
def speculation_replay(spark, d):
    """[T6, T10, T11, T23] Replay of a log for each user: an ordered fold."""
    op = F.when(F.col("pos") == 0, "create").when(F.col("sym") == "view", "append").when(F.col("sym") == "click", "begin").when(F.col("sym") == "purchase", "commit").when(F.col("sym") == "error", "rollback").otherwise("append")
    t = B.event_tokens(spark, d).select(F.col("stream_id").alias("seq_id"), F.col("pos").alias("seq_no"), op.alias("op"), (F.col("pos") % 3).alias("n"))
    return store.fold(t)


DEVICES = "dev as (select n_nationkey as ordinal, n_regionkey as peer_group from nation)"


def devices(spark, d):
    return B.table(spark, d, "nation").selectExpr("n_nationkey as ordinal", "n_regionkey as peer_group")


@query("placement_layers", f"with {DEVICES} select l as layer, l * (select count(*) from dev) // 80 as ordinal from range(80) r(l)")
def placement_layers(spark, d):
    """[P42] A device for each layer."""
    return control.layer_devices(80, devices(spark, d))


@query("placement_sequences", f"with v as (select c_custkey as seq_id, xor(c_custkey::uhugeint, 7::uhugeint) as v from customer), {B.mixed_sql('v', ['v'])}, m as (select user_id as seq_id, max_by(event_id % 25, event_id) as moved from events where event_type = 'error' group by all) select seq_id, coalesce(moved, m_v % 25)::int as device from mixed left join m using (seq_id)")
def placement_sequences(spark, d):
    """[P32, T21] By the mixed hash of id and seed unless moved."""
    moves = B.table(spark, d, "events").where("event_type = 'error'").selectExpr("user_id as seq_id", "event_id as seq_no", "cast(event_id % 25 as int) as device")
    return control.placed(B.table(spark, d, "customer").selectExpr("c_custkey as seq_id"), 25, moves, 7)


@query("peer_links", f"with {DEVICES} select x.ordinal as a, y.ordinal as b from dev x join dev y on x.peer_group = y.peer_group and x.ordinal < y.ordinal")
def peer_links(spark, d):
    """[J18] Links within groups."""
    return control.peer_links(devices(spark, d))


@query("transfer_accounting", f"with {DEVICES}, m as (select c_nationkey as source, s_nationkey as target, l_quantity::bigint as bytes from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey), t as (select *, case when source = target then 'local' when x.peer_group = y.peer_group then 'peer' else 'staged' end as transport from m join dev x on x.ordinal = source join dev y on y.ordinal = target) select transport, count(*) as transfers, sum(bytes)::bigint as bytes from t group by all")
def transfer_accounting(spark, d):
    """[J19, T22] Transfers and bytes of each way."""
    t = lambda n: B.table(spark, d, n)
    m = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    moves = m.selectExpr("c_nationkey as source", "s_nationkey as target", "cast(l_quantity as bigint) as bytes")
    return control.transports(moves, devices(spark, d)).groupBy("transport").agg(F.count("*").alias("transfers"), F.sum("bytes").alias("bytes"))


WORKERS = "w as (select s_suppkey as worker_id, case s_suppkey % 2 when 0 then 'prefill' else 'decode' end as role, s_acctbal > 0 as healthy, s_suppkey % 7 > 0 as model_loaded, 1000000 + s_suppkey * 1000 as free_vram, s_suppkey % 5 as active, s_suppkey % 3 as backlog from supplier)"


def workers(spark, d):
    return B.table(spark, d, "supplier").selectExpr("s_suppkey as worker_id", "if(s_suppkey % 2 = 0, 'prefill', 'decode') as role", "s_acctbal > 0 as healthy", "s_suppkey % 7 > 0 as model_loaded", "1000000 + s_suppkey * 1000 as free_vram", "s_suppkey % 5 as active", "s_suppkey % 3 as backlog")


@query("route_best_workers", f"with {WORKERS} select role, worker_id, free_vram // (active + 1 + case role when 'decode' then backlog else 0 end) as score from w where healthy and model_loaded qualify row_number() over (partition by role order by score desc, worker_id) = 1")
def route_best_workers(spark, d):
    """[J17, F8] The best worker of each role."""
    return control.routed(workers(spark, d))


@query("route_cached_prefix", "with m as (select (p_partkey % 40)::varchar as model, p_size * 16 as upto from part where p_retailprice > 1000), best as (select model, max(upto) as upto from m group by all), r as (select o_orderkey as request_id, (o_custkey % 50)::varchar as model, 1 + o_orderkey % 600 as tokens from orders) select request_id, model, tokens, least(tokens, coalesce(upto, 0)) as cached, tokens - least(tokens, coalesce(upto, 0)) as suffix, (tokens - least(tokens, coalesce(upto, 0))) * 1024 as transfer_bytes from r left join best using (model)")
def route_cached_prefix(spark, d):
    """[J17] The prefix that a request finds cached."""
    m = B.table(spark, d, "part").selectExpr("cast(p_partkey % 40 as string) as model", "cast(16 as long) as page_size", "p_size - 1 as page_index", "p_retailprice as expires_at")
    r = B.table(spark, d, "orders").selectExpr("o_orderkey as request_id", "cast(o_custkey % 50 as string) as model", "1 + o_orderkey % 600 as tokens")
    return control.cached_prefix(r, m, F.lit(1000.0))


@query("lease_fencing", "with l as (select s_suppkey as page, s_suppkey % 3 as g, 't' || s_suppkey % 4 as t, s_acctbal as expires_at from supplier), c as (select l_orderkey as id, l_linenumber, l_suppkey + 10 as page, l_linenumber % 3 as generation, 't' || l_orderkey % 4 as token from lineitem) select verdict, count(*) as n from (select case when g is null then 'no lease' when g <> generation or t <> token then 'stale' when expires_at <= 1000 then 'expired' else 'held' end as verdict from c left join l using (page)) group by all")
def lease_fencing(spark, d):
    """[J14, F9] Claims on pages against their leases."""
    l = B.table(spark, d, "supplier").selectExpr("s_suppkey as page", "s_suppkey % 3 as generation", "concat('t', s_suppkey % 4) as token", "s_acctbal as expires_at")
    c = B.table(spark, d, "lineitem").selectExpr("l_suppkey + 10 as page", "l_linenumber % 3 as generation", "concat('t', l_orderkey % 4) as token")
    return control.fenced(c, l, F.lit(1000)).groupBy("verdict").agg(F.count("*").alias("n"))


#: A token names page, owner and generation, so claims of these stand for tokens here.
LEASES = f"""with recursive {B.EVENTS},
ops as (select stream_id as page, pos as seq_no, case when sym in ('view', 'error') then 'acquire' when sym = 'click' then 'renew' else 'transfer' end as op, pos % 7 as worker, pos // 4 + 1 as generation, (pos + 6) % 7 as holder, pos * 10 as at from tok),
f as (
  select page, -1::bigint as seq_no, ''::varchar as op, false as ok, 0::bigint as owner, 0::bigint as generation, -1::bigint as expires_at from (select distinct page from ops)
  union all
  select o.page, o.seq_no, o.op, t.ok, case when t.ok and o.op <> 'renew' then o.worker else f.owner end, case when t.ok and o.op <> 'renew' then f.generation + 1 else f.generation end, case when t.ok then o.at + 25 else f.expires_at end
  from f join ops o on o.page = f.page and o.seq_no = f.seq_no + 1,
  lateral (select case when o.op = 'acquire' then o.worker <> 0 and f.expires_at <= o.at else f.generation > 0 and o.generation = f.generation and o.holder = f.owner and (o.op = 'renew' or o.worker <> 0) end as ok) t)
select page, seq_no, op, ok, owner, generation, expires_at from f where seq_no >= 0"""


@query("lease_replay", LEASES)
def lease_replay(spark, d):
    """[T17, P35] Leases acquired, renewed and transferred under generation and token: an ordered fold."""
    op = F.when(F.col("sym").isin("view", "error"), "acquire").when(F.col("sym") == "click", "renew").otherwise("transfer")
    t = B.event_tokens(spark, d).select(F.col("stream_id").alias("page"), F.col("pos").alias("seq_no"), op.alias("op"), (F.col("pos") % 7).alias("worker"), (F.expr("pos div 4") + 1).alias("generation"), (F.col("pos") * 10).alias("at"))
    t = t.withColumn("token", control.page_token(F.col("page"), (F.col("seq_no") + 6) % 7, F.col("generation")))
    return control.leases(t, 25).drop("token")


@query("transfer_verdicts", "select case when l_returnflag = 'R' then 'not authenticated' when l_tax > 0.07 then 'integrity' when l_linestatus = 'O' and l_discount > 0.05 then 'incomplete' when l_quantity > 45 then 'size' else 'accepted' end as verdict, count(*) as n from lineitem group by all")
def transfer_verdicts(spark, d):
    """[F10, T18] Why transfers are refused."""
    t = B.table(spark, d, "lineitem").selectExpr("l_returnflag <> 'R' as authenticated", "not l_tax > 0.07 as integrity_ok", "not (l_linestatus = 'O' and l_discount > 0.05) as complete", "l_quantity as bytes", "least(l_quantity, 45) as expected_bytes")
    return t.groupBy(control.transfer_verdict().alias("verdict")).agg(F.count("*").alias("n"))


@query("replica_recovery", "select s_suppkey as worker_id, count(*) as pages, count_if(l_linenumber > 1)::bigint as recoverable, count_if(l_linenumber <= 1)::bigint as lost from lineitem join supplier on s_suppkey = l_suppkey where s_acctbal < 0 group by all")
def replica_recovery(spark, d):
    """[J15] What failed workers owned."""
    m = B.table(spark, d, "lineitem").selectExpr("l_suppkey as owner", "l_linenumber as replicas")
    return control.recovery(m, B.table(spark, d, "supplier").where("s_acctbal < 0").selectExpr("s_suppkey as worker_id"))


ROLE = "case event_type when 'view' then 'router' when 'click' then 'prefill' when 'purchase' then 'decode' when 'signup' then 'admin' else 'scheduler' end"
OPERATION = "case event_id % 9 " + " ".join(f"when {i} then '{o}'" for i, o in enumerate(control.OPERATIONS)) + " else 'unknown' end"


@query("authz_matrix", f"with m as (select unnest({[f'{r}/{o}' for o, roles in control.OPERATIONS.items() for r in roles]}) as pair), e as (select {ROLE} as role, {OPERATION} as operation, user_id % 4 as tenant, event_id % 4 as resource_tenant from events) select role, operation, count(*) as n, count_if((role || '/' || operation) in (select pair from m) and (role = 'admin' or resource_tenant = 0 or tenant = resource_tenant))::bigint as allowed from e group by all")
def authz_matrix(spark, d):
    """[P39, F12, T15] Which requests a role may make."""
    e = B.table(spark, d, "events").selectExpr(f"{ROLE} as role", f"{OPERATION} as operation", "user_id % 4 as tenant", "event_id % 4 as resource_tenant")
    return control.authorized(e, control.role_table(spark)).groupBy("role", "operation").agg(F.count("*").alias("n"), F.count_if("allowed").alias("allowed"))


@query("identity_checks", "select case when k not in (2, 3) then 'stale key' when k = 3 and now > 300 then 'out of grace' when now < 20 or now > 450 then 'outside its time' when k = 2 then 'valid' else 'grace' end as verdict, count(*) as n from (select event_id % 4 as k, floor(value)::bigint as now from events where value is not null) group by all")
def identity_checks(spark, d):
    """[F11, T15] Peers by time and key generation: 2 is current, 3 follows, within 200 of a rotation at 100."""
    e = B.table(spark, d, "events").where("value is not null").select((F.col("event_id") % 4).alias("key_generation"), F.floor("value").alias("now"), F.lit(20).alias("not_before"), F.lit(450).alias("not_after"))
    return e.groupBy(control.identity_verdict(F.col("now"), F.lit(2), F.lit(3), F.lit(100), F.lit(200)).alias("verdict")).agg(F.count("*").alias("n"))


@query("key_rotation", "with r as (select event_id as seq_no, event_id % 9 as following, event_id * 10 as moment from events where event_type = 'signup'), l as (select following, moment from r where following > 4 qualify row_number() over (order by seq_no desc) = 1) select 4 as current, coalesce((select following from l), 0) as following, coalesce((select moment from l), 0) as rotated_at")
def key_rotation(spark, d):
    """[T15] The last rotation to a later key."""
    r = B.table(spark, d, "events").where("event_type = 'signup'").selectExpr("event_id as seq_no", "event_id % 9 as following", "event_id * 10 as at")
    return control.rotated(spark.range(1).select(F.lit(4).alias("current")), r)


TOKENS = "t as (select event_id as token_id, user_id % 3 as peer, event_id // 4 % 50 as nonce, event_id // 100 * 100 as issued_at, user_id % 2 as operation, event_id - event_id % 7 as seen_at from events)"


@query("replay_dedupe", f"with {TOKENS}, {B.mixed_sql('t', ['peer', 'nonce', 'issued_at', 'operation'])}, v as (select *, xor(xor(m_peer, m_nonce), xor(m_issued_at, m_operation)) as h, peer <> 0 and nonce <> 0 as sound, issued_at between greatest(0, seen_at - 60) and seen_at + 60 as timely from mixed) select token_id, case when not sound then 'invalid' when not timely then 'outside the window' when row_number() over (partition by h, sound and timely order by seen_at, token_id) = 1 then 'accepted' else 'replayed' end as verdict from v")
def replay_dedupe(spark, d):
    """[F13, P33, T14] Tokens accepted once."""
    t = B.table(spark, d, "events").selectExpr("event_id as token_id", "user_id % 3 as peer", "event_id div 4 % 50 as nonce", "event_id div 100 * 100 as issued_at", "user_id % 2 as operation", "event_id - event_id % 7 as seen_at")
    return control.fresh_tokens(t, 60).select("token_id", "verdict")


@query("audit_chain", f"with recursive {B.EVENTS}, c as (select stream_id, pos, sha256(sym) as chain from tok where pos = 0 union all select tok.stream_id, tok.pos, sha256(c.chain || tok.sym) from c join tok on tok.stream_id = c.stream_id and tok.pos = c.pos + 1), n as (select stream_id, count(*) as links from tok group by all) select c.stream_id, c.chain, n.links from c join n on n.stream_id = c.stream_id and c.pos = n.links - 1")
def audit_chain(spark, d):
    """[W7] The head of each user's hash chain."""
    t = B.event_tokens(spark, d).select("stream_id", F.col("pos").alias("seq_no"), F.col("sym").alias("event"))
    return control.audit_chain(t, "stream_id")


@query("manifest_signatures", "select count(*) as manifests, count_if(o_orderkey % 10 > 0)::bigint as sound from orders")
def manifest_signatures(spark, d):
    """[T16, P51] Signed manifests, one in ten tampered with."""
    fields = ["o_orderkey", "o_custkey", "o_orderstatus"]
    s = control.signed(B.table(spark, d, "orders").select(*fields), fields, "key")
    tampered = s.withColumn("o_custkey", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return control.verified(tampered, fields, "key").agg(F.count("*").alias("manifests"), F.count_if("sound").alias("sound"))


@query("release_manifest", "with f as (select p_name as name, case when p_partkey % 9 = 0 then 'bad' else sha256(p_brand) end as digest from part) select name, digest, case when digest = 'bad' then 'digest' end as why, count(*) as n from f where digest = 'bad' or name in (select name from f group by all having count(*) > 1) group by all")
def release_manifest(spark, d):
    """[F14, E9] Files of a release with unsound digests or names."""
    f = B.table(spark, d, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 9 == 0, "bad").otherwise(F.sha2("p_brand", 256)).alias("digest"))
    out = control.release_problems(f).withColumn("why", F.when(F.array_contains("problems", "digest"), "digest"))
    return out.groupBy("name", "digest", "why").agg(F.count("*").alias("n"))


REQ = "r as (select o_orderkey as request_id, o_custkey % 4 as model_id, 50 + o_orderkey % 900 as prompt_tokens, o_orderkey % 100 as cached_tokens, 1 + o_orderkey % 300 as completion_tokens, o_orderkey % 2 as deadline from orders)"
CAP = "c as (select s_suppkey as worker_id, s_suppkey % 4 as state, s_suppkey % 6 = 0 as circuit_open, 1 + s_suppkey % 15 as model_mask, 500 + s_suppkey * 10 as prefill_rate, 100 + s_suppkey as decode_rate, s_suppkey % 5 as queue_depth, s_suppkey % 4 as active from supplier)"


@query("scheduler_best_worker", f"with {REQ}, {CAP}, s as (select request_id, worker_id, greatest(0, prompt_tokens - cached_tokens) * 1000000 // prefill_rate as prefill_us, completion_tokens * 1000000 // decode_rate as decode_us, deadline, queue_depth, active from r, c where state < 2 and not circuit_open and (model_mask & (1::bigint << model_id::int)) <> 0) select request_id, worker_id, prefill_us, decode_us, case when deadline > 0 then prefill_us + decode_us else 0 end + (queue_depth + active) * 1000 as score from s qualify row_number() over (partition by request_id order by score, worker_id) = 1")
def scheduler_best_worker(spark, d):
    """[J16, O5, P36, P38, F7] The worker of least score for each request."""
    r = B.table(spark, d, "orders").selectExpr("o_orderkey as request_id", "o_custkey % 4 as model_id", "50 + o_orderkey % 900 as prompt_tokens", "o_orderkey % 100 as cached_tokens", "1 + o_orderkey % 300 as completion_tokens", "o_orderkey % 2 as deadline")
    c = B.table(spark, d, "supplier").selectExpr("s_suppkey as worker_id", "s_suppkey % 4 as state", "s_suppkey % 6 = 0 as circuit_open", "1 + s_suppkey % 15 as model_mask", "500 + s_suppkey * 10 as prefill_rate", "100 + s_suppkey as decode_rate", "s_suppkey % 5 as queue_depth", "s_suppkey % 4 as active")
    return control.best_worker(r, c)


@query("fairness_scores", "with t as (select o_custkey as tenant, sum(floor(o_totalprice)::bigint)::bigint as virtual_runtime from orders group by all) select tenant, greatest(0, virtual_runtime // (1 + tenant % 4) - (tenant % 3) * 1000)::bigint as score from t")
def fairness_scores(spark, d):
    """[P37, W6] Virtual runtime by weight, less the bonus of priority."""
    t = B.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("tenant")).agg(F.sum(F.floor("o_totalprice")).alias("virtual_runtime"))
    return t.withColumn("weight", 1 + F.col("tenant") % 4).withColumn("priority", F.col("tenant") % 3).select("tenant", control.fairness().alias("score"))


_OP = "case when s_suppkey % 4 = 3 then 'complete' when s_suppkey % 13 = 6 then 'cancel' else 'admit' end"
#: The log of decisions: suppliers in order of their key. The state of three tenants and all held requests goes from row to row.
SCHEDULER = f"""with recursive ops as (
  select row_number() over (order by s_suppkey) - 1 as seq_no, s_suppkey as k, {_OP} as op, s_suppkey - case when s_suppkey % 4 = 3 then 2 when s_suppkey % 13 = 6 then 1 else 0 end as request_id, (s_suppkey * 7 % 5)::int as tenant, s_suppkey % 5 as model_id, s_suppkey % 3 as priority,
    10 + s_suppkey % 40 as prompt_tokens, 20 + s_suppkey % 30 as completion_tokens, s_suppkey % 9 as cached_tokens, s_suppkey % 2 as deadline, s_suppkey % 25 as generated, 100 * (s_suppkey % 11) as gpu_us from supplier),
w as (select n_nationkey + 1 as worker_id, n_nationkey % 4 as state, n_nationkey % 6 = 0 as circuit_open, 1 + n_nationkey % 15 as model_mask, 500 + n_nationkey * 10 as prefill_rate, 100 + n_nationkey as decode_rate, n_nationkey % 5 + n_nationkey % 4 as load from nation),
best as (
  select seq_no, worker_id, greatest(0, prompt_tokens - cached_tokens) * 1000000 // prefill_rate as prefill_us, completion_tokens * 1000000 // decode_rate as decode_us
  from ops join w on op = 'admit' and state < 2 and not circuit_open and (model_mask & (1::bigint << model_id::int)) <> 0
  qualify row_number() over (partition by seq_no order by case when deadline > 0 then greatest(0, prompt_tokens - cached_tokens) * 1000000 // prefill_rate + completion_tokens * 1000000 // decode_rate else 0 end + load * 1000, worker_id) = 1),
p as (select tenant, 1 + tenant as weight, 2 + tenant as concurrent, 2 as waiting, 900 - 100 * tenant as prompt_quota, 600 as completion_quota, 3000 as gpu_budget from (select unnest([0, 1, 2, 3]) as tenant)),
log as (select ops.*, coalesce(worker_id, 0) as worker_id, coalesce(prefill_us, 0) as prefill_us, coalesce(decode_us, 0) as decode_us, coalesce(weight, 0) as weight, coalesce(concurrent, 0) as concurrent, coalesce(waiting, 0) as waiting, coalesce(prompt_quota, 0) as prompt_quota, coalesce(completion_quota, 0) as completion_quota, coalesce(gpu_budget, 0) as gpu_budget from ops left join best using (seq_no) left join p using (tenant)),
f as (
  select -1::bigint as seq_no, ''::varchar as result, 0::bigint as place, 0::bigint as fair, list_value(0, 0, 0, 0, 0)::bigint[] as active, list_value(0, 0, 0, 0, 0)::bigint[] as queued, list_value(0, 0, 0, 0, 0)::bigint[] as prompt, list_value(0, 0, 0, 0, 0)::bigint[] as done, list_value(0, 0, 0, 0, 0)::bigint[] as gpu, list_value(0, 0, 0, 0, 0)::bigint[] as runtime, []::struct(id bigint, t integer, q boolean)[] as held, []::bigint[] as billed
  union all
  select l.seq_no, r.result, case when r.result = 'queue' then list_sum(f.queued) + 1 else 0 end::bigint, case when r.result in ('now', 'queue') then greatest(0, (f.runtime[l.tenant + 1] + l.prompt_tokens + l.completion_tokens) // l.weight - l.priority * 1000) else 0 end::bigint,
    list_transform(f.active, lambda x, i: x + case when r.result = 'now' and i = l.tenant + 1 then 1 when r.result = 'done' and not h.h.q and i = h.h.t + 1 then -1 else 0 end)::bigint[],
    list_transform(f.queued, lambda x, i: x + case when r.result = 'queue' and i = l.tenant + 1 then 1 when r.result = 'done' and h.h.q and i = h.h.t + 1 then -1 else 0 end)::bigint[],
    list_transform(f.prompt, lambda x, i: x + case when r.result in ('now', 'queue') and i = l.tenant + 1 then l.prompt_tokens else 0 end)::bigint[],
    list_transform(f.done, lambda x, i: x + case when r.result = 'done' and l.op = 'complete' and i = h.h.t + 1 then l.generated else 0 end)::bigint[],
    list_transform(f.gpu, lambda x, i: x + case when r.result = 'done' and l.op = 'complete' and i = h.h.t + 1 then l.gpu_us else 0 end)::bigint[],
    list_transform(f.runtime, lambda x, i: x + case when r.result in ('now', 'queue') and i = l.tenant + 1 then l.prompt_tokens + l.completion_tokens else 0 end)::bigint[],
    case when r.result in ('now', 'queue') then list_append(f.held, struct_pack(id := l.request_id, t := l.tenant, q := r.result = 'queue')) when r.result = 'done' then list_filter(f.held, lambda x: x.id <> l.request_id) else f.held end,
    case when r.result = 'done' and l.op = 'complete' then list_append(f.billed, l.request_id) else f.billed end
  from f join log l on l.seq_no = f.seq_no + 1,
  lateral (select list_filter(f.held, lambda x: x.id = l.request_id)[1] as h) h,
  lateral (select case
    when l.op = 'admit' then case when l.request_id = 0 or h.h is not null or l.weight = 0 then 'refused' when f.prompt[l.tenant + 1] + l.prompt_tokens > l.prompt_quota or f.done[l.tenant + 1] + l.completion_tokens > l.completion_quota or f.gpu[l.tenant + 1] >= l.gpu_budget then 'quota' when l.worker_id = 0 then 'model'
      when list_sum(f.active) < 8 and f.active[l.tenant + 1] < l.concurrent then 'now' when list_sum(f.queued) >= 5 or f.queued[l.tenant + 1] >= l.waiting then 'overload' else 'queue' end
    when h.h is null then 'refused' when l.op = 'complete' and list_contains(f.billed, l.request_id) then 'duplicate' else 'done' end as result) r)
select l.seq_no, l.op, l.request_id, l.tenant::bigint as tenant, f.result, case when f.result in ('now', 'queue') then l.worker_id else 0 end::bigint as worker_id, case when f.result in ('now', 'queue') then prefill_us else 0 end::bigint as prefill_us, case when f.result in ('now', 'queue') then decode_us else 0 end::bigint as decode_us,
  case when f.result in ('now', 'queue') then prompt_tokens * 1024 else 0 end::bigint as kv_bytes, f.place as queue_position, f.fair as fairness, list_sum(f.active)::bigint as active, list_sum(f.queued)::bigint as queued
from f join log l on l.seq_no = f.seq_no"""


@query("scheduler_replay", SCHEDULER)
def scheduler_replay(spark, d):
    """[T19, F6, A35, J16, O5] A log of decisions replayed under quotas, models, concurrency and queues: one ordered fold."""
    place = F.row_number().over(Window.orderBy("s_suppkey")) - 1  # a log of decisions is one order
    ops = B.table(spark, d, "supplier").withColumn("seq_no", place.cast("long")).selectExpr(
        "seq_no", f"{_OP} as op", "s_suppkey - case when s_suppkey % 4 = 3 then 2 when s_suppkey % 13 = 6 then 1 else 0 end as request_id", "s_suppkey * 7 % 5 as tenant", "s_suppkey % 5 as model_id", "s_suppkey % 3 as priority",
        "10 + s_suppkey % 40 as prompt_tokens", "20 + s_suppkey % 30 as completion_tokens", "s_suppkey % 9 as cached_tokens", "s_suppkey % 2 as deadline", "s_suppkey % 25 as generated", "100 * (s_suppkey % 11) as gpu_us",
    )
    tenants = spark.range(4).selectExpr("id as tenant", "1 + id as weight", "2 + id as concurrent", "2L as queued", "900 - 100 * id as prompt_quota", "600L as completion_quota", "3000L as gpu_budget")
    w = B.table(spark, d, "nation").selectExpr("n_nationkey + 1 as worker_id", "n_nationkey % 4 as state", "n_nationkey % 6 = 0 as circuit_open", "1 + n_nationkey % 15 as model_mask", "500 + n_nationkey * 10 as prefill_rate", "100 + n_nationkey as decode_rate", "n_nationkey % 5 as queue_depth", "n_nationkey % 4 as active")
    return control.replay(ops, tenants, w, 8, 5)


@query("scale_plan", "with q as (select count_if(o_orderstatus = 'P') as queued from orders), h as (select count_if(s_suppkey % 4 = 0 and s_suppkey % 6 <> 0) as healthy from supplier) select (greatest(1, healthy // 2) + case when queued > 10 then 1 else 0 end)::bigint as prefill, (greatest(2, healthy - healthy // 2) + case when queued > 10 then 1 else 0 end)::bigint as decode, (case when queued > 10 then 2 else 1 end)::int as replicas from q, h")
def scale_plan(spark, d):
    """[A36] Wanted workers."""
    t = B.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("tenant")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("queued"))
    c = B.table(spark, d, "supplier").selectExpr("s_suppkey as worker_id", "s_suppkey % 4 as state", "s_suppkey % 6 = 0 as circuit_open")
    return control.scale_plan(t, c, 10)


@query("shard_validity", f"with {DEVICES}, s as (select l_orderkey, l_linenumber, (l_suppkey % 30)::int as device, case l_linenumber when 1 then 2 when 2 then 4 when 3 then 8 when 4 then 16 else 3 end as bits, l_partkey - 20 as begin from lineitem) select concat_ws(',', case when device not in (select ordinal from dev) then 'device' end, case when bits not in (2, 4, 8, 16) then 'codec' end, case when begin < 0 then 'range' end) as reasons, count(*) as n from s group by all")
def shard_validity(spark, d):
    """Why shards are refused."""
    s = B.table(spark, d, "lineitem").selectExpr("cast(l_suppkey % 30 as int) as device", "case l_linenumber when 1 then 2 when 2 then 4 when 3 then 8 when 4 then 16 else 3 end as bits", "l_partkey - 20 as begin", "1 as n")
    return control.valid_shards(s, devices(spark, d)).groupBy(F.concat_ws(",", "reasons").alias("reasons")).agg(F.count("*").alias("n"))


NAMES = list(control.SCENARIOS)


@query("scenario_coverage", f"with s as (select unnest({NAMES}) as name, generate_subscripts({NAMES}, 1) - 1 as i) select name, (select count(*) from events where event_id % 11 = i) as evidence from s")
def scenario_coverage(spark, d):
    """[E4, E5] How much evidence there is of each scenario."""
    e = B.table(spark, d, "events").groupBy((F.col("event_id") % 11).cast("int").alias("scenario_id")).agg(F.count("*").alias("evidence"))
    return control.scenarios(spark).join(e, "scenario_id", "left").select("name", F.coalesce("evidence", F.lit(0)).alias("evidence"))


_WORDS = "p as (select p_partkey, p_size::bigint as tenant, p_partkey % 5 as model, p_partkey * 1000003 as page, 1 + p_size::bigint * 64 as bytes, p_partkey * 31 as checksum, p_partkey % 4 as lease, p_partkey % 10 as owner, (1::bigint << 32) | 2 as versions from part)"


def _sql_digest() -> tuple[str, str]:
    """The digest's first word as a chain of SQL steps, each word mixed into the state with its place, and the last step."""
    out, source = "", f"(select *, xor(1::uhugeint, {hashes.DIGEST_START}::uhugeint) as v from p)"
    words = ("tenant", "model", "page", "bytes", "checksum", "lease", "owner", "versions")
    for k in range(len(words) + 2):
        steps = B.mixed_sql(source, ["v"])
        for name in ("mixed0", "mixed1", "mixed"):
            steps = re.sub(rf"\b{name}\b", f"s{k}_{name}", steps)
        out += (", " if k else "") + steps
        word = f"xor(xor(m_v, {words[k]}::uhugeint), {k}::uhugeint)" if k < len(words) else "m_v"
        source = f"(select * exclude (v, m_v), {word} as v from s{k}_mixed)"
    return out, f"s{len(words) + 1}_mixed"


_DIGEST, _LAST = _sql_digest()


@query("manifest_digests", f"with {_WORDS}, {_DIGEST} select p_partkey, printf('%016x', m_v::ubigint) as head from {_LAST}")
def manifest_digests(spark, d):
    """[P33, T16] The first word of each manifest's 32-byte digest under key generation 1."""
    p = B.table(spark, d, "part").selectExpr("p_partkey", "cast(p_size as long) as tenant", "p_partkey % 5 as model", "p_partkey * 1000003 as page", "1 + cast(p_size as long) * 64 as bytes", "p_partkey * 31 as checksum", "p_partkey % 4 as lease", "p_partkey % 10 as owner", "(1L << 32) | 2L as versions")
    digest = hashes.digest32([F.col(c) for c in ("tenant", "model", "page", "bytes", "checksum", "lease", "owner", "versions")], F.lit(1))
    first = F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring("digest", i * 2 + 1, F.lit(2)))), "")
    return p.withColumn("digest", digest).select("p_partkey", first.alias("head"))
