"""Queries on measurements and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqpack.operators import evidence
from seqpack.plans import bindings as B
from seqpack.plans.registry import query

REQ = "q as (select event_id, user_id % 8 as tenant, value * 10 as ttft, value / 4 as per_token, event_type = 'error' as failed, event_id * 1000 as accounted, event_id * 1000 + user_id as observed, ts, event_id % 997 = 5 and user_id % 8 = 2 as prompt_present, event_type || ':' || (event_id % (1 + user_id % 8)) as series from events)"
POLICY = {"ttft": 4800.0, "token": 118.0, "availability": 78.0, "samples": 5, "series": 30}


def requests(spark, d):
    return B.table(spark, d, "events").selectExpr("event_id", "user_id % 8 as tenant", "value * 10 as ttft", "value / 4 as per_token", "event_type = 'error' as failed", "event_id * 1000 as accounted", "event_id * 1000 + user_id as observed", "ts", "event_id % 997 = 5 and user_id % 8 = 2 as prompt_present", "concat(event_type, ':', event_id % (1 + user_id % 8)) as series")


@query("slo_p95", f"with {REQ} select tenant, count(*) as samples, round(quantile_disc(ttft, 0.95), 6) as ttft_p95, round(quantile_disc(per_token, 0.95), 6) as token_p95 from q group by all")
def slo_p95(spark, d):
    """[A14] Nearest-rank percentiles."""
    return requests(spark, d).groupBy("tenant").agg(F.count("*").alias("samples"), F.round(evidence.p95("ttft"), 6).alias("ttft_p95"), F.round(evidence.p95("per_token"), 6).alias("token_p95"))


@query("slo_verdict", f"with {REQ}, s as (select tenant, count(*) as samples, count_if(failed)::bigint as errors, quantile_disc(ttft, 0.95) as t, quantile_disc(per_token, 0.95) as k, max(abs(accounted - observed)) as memory_delta, not bool_or(prompt_present) as redacted, count(distinct series) <= 30 as bounded from q group by all), r as (select s_suppkey % 10 as tenant, sum(case when s_suppkey % 10 = 4 then 1 else 0 end) as left_over from supplier group by all) select tenant, samples, errors, round(t, 6) as ttft_p95, round(k, 6) as token_p95, memory_delta, round(100.0::double * (samples - errors) / samples, 6) as availability, coalesce(left_over, 0) = 0 as reconciled, redacted, bounded, t <= 4800 and k <= 118 and 100.0::double * (samples - errors) / samples >= 78 and samples >= 5 and coalesce(left_over, 0) = 0 and redacted and bounded as passed from s left join r using (tenant)")
def slo_verdict(spark, d):
    """[A15, F16] Service levels of each tenant: latencies, availability, references, redaction, series."""
    refs = B.table(spark, d, "supplier").selectExpr("s_suppkey % 10 as tenant", "if(s_suppkey % 10 = 4, 1, 0) as page_refs", "0 as snapshot_refs", "cast(null as int) as lease_refs", "0 as request_refs")
    s = evidence.slo(requests(spark, d), POLICY, ["tenant"], refs)
    return s.select("tenant", "samples", "errors", *[F.round(c, 6).alias(c) for c in ("ttft_p95", "token_p95", "availability")], "memory_delta", "reconciled", "redacted", "bounded", "passed")


@query("trace_validity", "select l_orderkey, l_linenumber, l_returnflag <> 'R' and l_linenumber % 4 > 0 and l_discount - 0.01 >= 0 as sound from lineitem")
def trace_validity(spark, d):
    """[F16] Traces that name everything and have no time below 0."""
    l = B.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "nullif(l_returnflag, 'R') as trace_id", "if(l_linenumber % 4 = 0, '', 'r') as request_id", "'t' as tenant_id", "'m' as model_id", "'w' as worker_id", "'d' as release_digest", "l_discount - 0.01 as ttft_ms", "0.0 as queue_ms")
    return l.select("l_orderkey", "l_linenumber", evidence.sound_trace(("ttft_ms", "queue_ms")).alias("sound"))


RC1 = (
    "with r as (select user_id % 20 as release, value as ttft, value / 10 as inter_token, event_type = 'signup' and event_id % 500 = 0 as leaked, user_id % 20 = 3 and event_id % 700 = 1 as incorrect, user_id % 20 = 5 and event_id % 300 = 2 as cuda_error, user_id % 20 = 7 and event_id % 200 = 3 as contaminated, event_id from events), "
    "m as (select event_id % 17 as release, event_id as seq_no, 1000 + event_id % 50 as accounted, case when event_id % 101 = 0 then 0 else 1000 end as observed from events), "
    "u as (select event_id % 19 as release, max_by(case when event_id % 19 = 9 then 2 else 0 end, event_id) as unreconciled from events group by all), "
    "a as (select release, count(*) as requests, quantile_disc(ttft, 0.95) as t, quantile_disc(inter_token, 0.95) as k, count_if(leaked)::bigint as leaked, count_if(incorrect)::bigint as incorrect, count_if(cuda_error)::bigint as cuda_error, count_if(contaminated)::bigint as contaminated from r group by all), "
    "b as (select release, max_by(abs(accounted - observed) / observed, seq_no) as e from m where observed > 0 group by all) "
    "select release, requests, leaked, incorrect, cuda_error, contaminated, coalesce(unreconciled, 0)::bigint as unreconciled, round(t, 6) as ttft_p95, round(k, 6) as token_p95, round(e, 6) as memory_error, "
    "case when e is null then 'INCOMPLETE' when leaked + incorrect + cuda_error + contaminated + coalesce(unreconciled, 0) > 0 or t > 478 or k > 48 or e > 0.04 then 'FAIL' else 'PASS' end as decision from a left join b using (release) left join u using (release)"
)


@query("rc1_verdict", RC1)
def rc1_verdict(spark, d):
    """[A16, A17] PASS, FAIL or INCOMPLETE of each release."""
    e = B.table(spark, d, "events")
    marks = ("event_type = 'signup' and event_id % 500 = 0 as leaked", "user_id % 20 = 3 and event_id % 700 = 1 as incorrect", "user_id % 20 = 5 and event_id % 300 = 2 as cuda_error", "user_id % 20 = 7 and event_id % 200 = 3 as contaminated")
    r = e.selectExpr("user_id % 20 as release", "value as ttft", "value / 10 as inter_token", *marks)
    m = e.selectExpr("event_id % 17 as release", "event_id as seq_no", "1000 + event_id % 50 as accounted", "if(event_id % 101 = 0, 0, 1000) as observed")
    u = e.selectExpr("event_id % 19 as release", "event_id as seq_no", "if(event_id % 19 = 9, 2, 0) as page_refs", "0 as snapshot_refs", "0 as lease_refs", "0 as request_refs")
    out = evidence.rc1(r, m, {"ttft": 478, "token": 48, "memory": 0.04}, "release", u)
    return out.select("release", "requests", *evidence.FAULTS, "unreconciled", *[F.round(c, 6).alias(c) for c in ("ttft_p95", "token_p95", "memory_error")], "decision")


@query("series_cardinality", "select count(distinct event_type || ':' || user_id) as series, count(distinct event_type || ':' || user_id) <= 1000 as bounded from events")
def series_cardinality(spark, d):
    """[A18, P50] Distinct series within a bound."""
    return evidence.cardinality(B.table(spark, d, "events"), ["event_type", "user_id"], 1000)


RUNS = "runs as (select l_linestatus as role, l_returnflag as metric, l_suppkey % 5 as run, avg(l_extendedprice / l_quantity) as value from lineitem group by all)"
SUMMARY = f"{RUNS}, s as (select role, metric, count(*) as runs, median(value) as median, avg(value) as mean, coalesce(stddev_samp(value), 0) as stdev, min(value) as least, max(value) as most from runs group by all), t as (select *, case when mean = 0 then 0 else stdev / abs(mean) * 100 end as cv from s)"
NUMBERS = ("median", "mean", "stdev", "cv", "least", "most")


def runs(spark, d):
    l = B.table(spark, d, "lineitem")
    return l.groupBy(F.col("l_linestatus").alias("role"), F.col("l_returnflag").alias("metric"), (F.col("l_suppkey") % 5).alias("run")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))


@query("session_summary", f"with {SUMMARY} select role, metric, runs, {', '.join(f'round({c}, 5) as {c}' for c in NUMBERS)} from t")
def session_summary(spark, d):
    """[A19, A28] Repeated runs summed up."""
    return evidence.summary(runs(spark, d), ["role", "metric"], "value").select("role", "metric", "runs", *[F.round(c, 5).alias(c) for c in NUMBERS])


SESSION = f"{SUMMARY}, m as (select b.metric, (c.median - b.median) / b.median * 100 as delta, b.cv > 5 or c.cv > 5 as unstable, b.metric as name from t b join t c on c.metric = b.metric and b.role = 'F' and c.role = 'O'), v as (select metric, delta, unstable, case when metric = 'R' then delta > 5 else delta < -5 end as regression, case when metric = 'R' then delta < 0 else delta > 0 end as win from m)"


def _session(spark, d):
    s = evidence.summary(runs(spark, d), ["role", "metric"], "value").withColumn("model", F.lit("m"))
    return evidence.session(s.where("role = 'F'"), s.where("role = 'O'"), ["R"], ["model"])


@query("session_verdict", f"with {SESSION} select metric, round(delta, 5) + 0 as delta, unstable, regression, win from v")
def session_verdict(spark, d):
    """[A20, J20, X3, P44] Candidate against baseline, a row a metric."""
    return _session(spark, d).select("metric", (F.round("delta", 5) + F.lit(0.0)).alias("delta"), "unstable", "regression", "win")


@query("pair_verdict", f"with {SESSION} select count(*) as metrics, count_if(regression)::bigint as regressions, count_if(unstable)::bigint as unstable, case when bool_or(regression) then 'FAIL' when bool_or(unstable) then 'INCOMPLETE' when bool_or(win) then 'PASS' else 'FAIL' end as state from v having count(*) > 0")
def pair_verdict(spark, d):
    """[A20, A21, A24, A39] The state of the comparison."""
    return evidence.session_state(_session(spark, d), ["model"]).drop("model")


@query("regression_gates", f"with {RUNS} select a.metric, a.run, case when a.value <= 0 or b.value < 0 then -1 when (b.value - a.value) / a.value * 100 <= 1 then 1 else 0 end as gate from runs a join runs b on a.metric = b.metric and a.run = b.run and a.role = 'F' and b.role = 'O'")
def regression_gates(spark, d):
    """[P45] Gates of each run."""
    r = runs(spark, d)
    both = r.where("role = 'F'").select("metric", "run", F.col("value").alias("b")).join(r.where("role = 'O'").select("metric", "run", F.col("value").alias("c")), ["metric", "run"])
    return both.select("metric", "run", evidence.regression_gate(F.col("b"), F.col("c"), 1.0).alias("gate"))


@query("crossover_grid", "select c.context, h.head_dim, q.queries, k.kv_heads, b.bits from (select unnest([4096, 8192, 16384, 32768, 65536]) as context) c, (select unnest([64, 96, 128]) as head_dim) h, (select unnest([1, 8, 32, 64]) as queries) q, (select unnest([2, 4, 8]) as kv_heads) k, (select unnest([4, 8]) as bits) b")
def crossover_grid(spark, d):
    """[J22] The campaign's 360 cases."""
    return evidence.grid(spark, {"context": [4096, 8192, 16384, 32768, 65536], "head_dim": [64, 96, 128], "queries": [1, 8, 32, 64], "kv_heads": [2, 4, 8], "bits": [4, 8]})


#: A case for each supplier and ship mode: runs of either side, memory, and a correctness error beyond the tolerance here and there.
CASES = (
    "cs as (select l_suppkey * 10 + l_linenumber as case_id, list(100 + l_tax * 20) filter (l_linestatus = 'F') as compressed, list(100 + l_discount * 10) filter (l_linestatus = 'O') as dense, any_value(l_suppkey) as s from lineitem group by all), "
    "ca as (select case_id, compressed, dense, 10 + s % 3 as compressed_mib, case when s % 13 > 0 then 11.5 end as dense_mib, case when s % 7 = 0 then 0.001 else 0.0001 end as max_error, case when s % 21 = 0 then 0.01 else 0.0002 end as tolerance from cs), "
    "cr as (select *, list_median(compressed) / list_median(dense) as r, coalesce(list_stddev_samp(compressed), 0) / list_avg(compressed) * 100 as cvc, coalesce(list_stddev_samp(dense), 0) / list_avg(dense) * 100 as cvd from ca), "
    "wy as (select *, case when compressed is null or dense is null or dense_mib is null then 'missing' when len(compressed) < 3 or len(dense) < 3 then 'few' when cvc > 0.5 or cvd > 0.35 + 0.15 then 'noise' when max_error > tolerance then 'tolerance' end as reason from cr), "
    "st as (select case_id, reason, case when reason is null then r end as ratio, case when reason is null then compressed_mib < dense_mib end as memory_improved, case when reason is not null then 'INCOMPLETE' when r <= 0.98 and compressed_mib < dense_mib then 'WIN' when r <= 1.02 and compressed_mib < dense_mib then 'PARITY' else 'NO_CROSSOVER' end as state from wy)"
).replace("0.35 + 0.15", "0.5")


def _cases(spark, d):
    l = B.table(spark, d, "lineitem")
    pick = lambda s, v: F.collect_list(F.when(F.col("l_linestatus") == s, v))
    c = l.groupBy((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("case_id"), F.col("l_suppkey").alias("s")).agg(pick("F", 100 + F.col("l_tax") * 20).alias("compressed"), pick("O", 100 + F.col("l_discount") * 10).alias("dense"))
    some = lambda a: F.when(F.size(a) > 0, F.col(a)).alias(a)
    c = c.selectExpr("case_id", "compressed", "dense", "10 + s % 3 as compressed_mib", "if(s % 13 > 0, 11.5, null) as dense_mib", "if(s % 7 = 0, 0.001, 0.0001) as max_error", "if(s % 21 = 0, 0.01, null) as tolerance")
    return evidence.crossover(c.select("case_id", some("compressed"), some("dense"), "compressed_mib", "dense_mib", "max_error", "tolerance"), 0.5)


@query("crossover_cases", f"with {CASES} select case_id, reason, memory_improved, round(ratio, 6) as ratio, state from st")
def crossover_cases(spark, d):
    """[A22] Ratio, state and reason of each case."""
    return _cases(spark, d).select("case_id", "reason", "memory_improved", F.round("ratio", 6).alias("ratio"), "state")


@query("crossover_states", f"with {CASES}, n as (select count(*) as cases, count_if(state = 'WIN')::bigint as win, count_if(state = 'PARITY')::bigint as parity, count_if(state = 'NO_CROSSOVER')::bigint as no_crossover, count_if(state = 'INCOMPLETE')::bigint as incomplete from st) select *, case when win > 0 then 'WIN' when parity > 0 then 'PARITY' when incomplete = cases then 'INCOMPLETE' else 'NO_CROSSOVER' end as state from n")
def crossover_states(spark, d):
    """[A23] The overall state, and cases of each state."""
    return evidence.overall(_cases(spark, d))


@query("first_divergence", f"with {B.ROLES}, l as (select stream_id // 2 as pair, pos, sym as x from tok where stream_id % 2 = 0), r as (select stream_id // 2 as pair, pos, sym as y from tok where stream_id % 2 = 1) select coalesce(l.pair, r.pair) as pair, count_if(x is not null and y is not null)::bigint as compared, count_if(x is not distinct from y)::bigint as agreeing, min(case when x is distinct from y then coalesce(l.pos, r.pos) end) as first_difference from l full join r on l.pair = r.pair and l.pos = r.pos group by all")
def first_divergence(spark, d):
    """[A26, J21] Where neighbouring conversations part."""
    t = B.role_tokens(spark, d).withColumn("pair", F.expr("stream_id div 2"))
    return evidence.first_divergence(t.where("stream_id % 2 = 0"), t.where("stream_id % 2 = 1"), ["pair"])


@query("logit_compare", "with p as (select a.vec_id // 2 as pair, a.embedding::double[] as x, b.embedding::double[] as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 and a.vec_id % 2 = 0), e as (select pair, x, y, unnest(x) as u, unnest(y) as v from p) select pair % 10 as bucket, round(max(abs(u - v)), 6) as max_error, round(avg(abs(u - v)), 6) as mean_error from e group by all")
def logit_compare(spark, d):
    """[A25, J21] Differences of neighbouring vectors."""
    from seqpack.operators import kv

    e = B.table(spark, d, "embeddings").select((F.expr("vec_id div 2")).alias("pair"), (F.col("vec_id") % 2).alias("odd"), F.col("embedding").cast("array<double>").alias("out"), F.expr("vec_id div 2 % 10").alias("bucket"))
    out = kv.compared(e.where("odd = 0"), e.where("odd = 1"), ["pair", "bucket"], ["bucket"])
    return out.select("bucket", F.round("max_error", 6).alias("max_error"), F.round("mean_error", 6).alias("mean_error"))


@query("cosine_pairs", "select a.vec_id // 2 as pair, round(coalesce(list_dot_product(a.embedding::double[], b.embedding::double[]) / nullif(sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])), 0), 0), 6) + 0 as mean_cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 and a.vec_id % 2 = 0")
def cosine_pairs(spark, d):
    """[P46] Cosines of neighbouring vectors."""
    from seqpack.operators import kv

    e = B.table(spark, d, "embeddings").select((F.expr("vec_id div 2")).alias("pair"), (F.col("vec_id") % 2).alias("odd"), F.col("embedding").cast("array<double>").alias("out"))
    return kv.compared(e.where("odd = 0"), e.where("odd = 1"), ["pair"], ["pair"]).select("pair", (F.round("mean_cosine", 6) + F.lit(0.0)).alias("mean_cosine"))


@query("capacity_prefix_max", f"with {B.EVENTS}, s as (select stream_id, pos as context, sym <> 'error' as ok from tok where pos > 0), f as (select stream_id, min(context) as failed_at from s where not ok group by all) select s.stream_id, coalesce(max(context) filter (failed_at is null or context < failed_at), 0) as capacity from s left join f using (stream_id) group by all")
def capacity_prefix_max(spark, d):
    """[A27] The largest context before the first failure."""
    t = B.event_tokens(spark, d).where("pos > 0").select("stream_id", F.col("pos").alias("context"), (F.col("sym") != "error").alias("ok"))
    return evidence.prefix_capacity(t, ["stream_id"])


@query("soak_summary", f"with {REQ} select tenant, count(*) as samples, count_if(failed)::bigint as failures, max_by(observed, event_id) - min_by(observed, event_id) as growth from q group by all")
def soak_summary(spark, d):
    """[A29] Failures and growth of a long run."""
    return evidence.soak(requests(spark, d).withColumn("at", F.col("event_id")).withColumn("memory", F.col("observed")), ["tenant"])


@query("evidence_rules", "with docs as (select o_orderkey as doc_id, unnest(['price', 'status', 'priority']) as path, unnest([o_totalprice::varchar, case when o_orderkey % 50 > 0 then o_orderstatus end, o_orderpriority]) as value, o_totalprice from orders) select doc_id, 'orders' as family, path, case path when 'price' then 'number_max' when 'status' then 'required' else 'matches' end as op from docs where (path = 'price' and o_totalprice > 400000) or (path = 'status' and value is null) or (path = 'priority' and not regexp_matches(value, '^[1-3]'))")
def evidence_rules(spark, d):
    """Orders as documents against a table of rules."""
    o = B.table(spark, d, "orders")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("path"), v.alias("value")) for k, v in (("price", F.col("o_totalprice").cast("string")), ("status", F.when(F.col("o_orderkey") % 50 > 0, F.col("o_orderstatus"))), ("priority", F.col("o_orderpriority")))]))
    docs = o.select(F.col("o_orderkey").alias("doc_id"), pairs.alias("p")).select("doc_id", "p.path", "p.value")
    rules = spark.createDataFrame([("orders", "price", "number_max", "400000"), ("orders", "status", "required", None), ("orders", "priority", "matches", "^[1-3]")], "family string, path string, op string, operand string")
    return evidence.violations(docs, rules)


@query("reference_drift", "with b as (select l_suppkey as owner, count(*) as n from lineitem where l_linestatus = 'F' group by all), a as (select l_suppkey as owner, count(*) as n from lineitem where l_linestatus = 'O' group by all) select coalesce(b.owner, a.owner) as owner, coalesce(b.n, 0) as before, coalesce(a.n, 0) as after, coalesce(a.n, 0) - coalesce(b.n, 0) as drift from b full join a on a.owner = b.owner where coalesce(a.n, 0) <> coalesce(b.n, 0)")
def reference_drift(spark, d):
    """[A40] References before and after."""
    n = lambda s: B.table(spark, d, "lineitem").where(F.col("l_linestatus") == s).groupBy(F.col("l_suppkey").alias("owner")).agg(F.count("*").alias("n"))
    return evidence.drift(n("F"), n("O"), ["owner"])


@query("missing_scenarios", "select s as event_type from (select unnest(['view', 'click', 'refund', 'logout']) as s) where s not in (select event_type from events)")
def missing_scenarios(spark, d):
    """[X2] Required scenarios that have no event."""
    return evidence.missing(["view", "click", "refund", "logout"], B.table(spark, d, "events"), "event_type")


@query("gauge_peaks", "with e as (select user_id, ts, event_id, case event_type when 'view' then 1 when 'error' then -1 else 0 end as change from events), l as (select *, sum(change) over (partition by user_id order by ts, event_id rows unbounded preceding) as level from e) select user_id, max(level)::bigint as peak, max_by(level, row(ts, event_id))::bigint as final from l group by all")
def gauge_peaks(spark, d):
    """[A35] Peak and last level of a gauge."""
    e = B.table(spark, d, "events").withColumn("change", F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "error", -1).otherwise(0))
    return evidence.running_peak(e, ["user_id"], ["ts", "event_id"], "change")


@query("sliding_p95", "with j as (select unnest([time_bucket(interval 6 hour, ts), time_bucket(interval 6 hour, ts) - interval 6 hour]) as start, value from events where ts is not null) select start, count(*) as n, round(quantile_disc(value, 0.95), 6) as p95 from j group by all")
def sliding_p95(spark, d):
    """[W9] Percentiles of 12 hours, every 6."""
    e = B.table(spark, d, "events")
    out = e.groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(evidence.p95("value"), 6).alias("p95"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "p95")


@query("redacted_props", "select event_id, regexp_replace(props, '[0-9]+', '#', 'g') as props from events")
def redacted_props(spark, d):
    """[P47] Numbers in properties masked."""
    return B.table(spark, d, "events").select("event_id", F.regexp_replace("props", "[0-9]+", "#").alias("props"))
