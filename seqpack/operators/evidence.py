"""Verdicts over measurements: percentiles, service levels, repeated runs, crossovers, rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def p95(c: str) -> Column:
    """[A14] Nearest rank."""
    return F.expr(f"percentile_disc(0.95) within group (order by {c})")


#: What a request's trace has to name, and the times in it that cannot be below 0.
NAMED = ("trace_id", "request_id", "tenant_id", "model_id", "worker_id", "release_digest")


def sound_trace(times: tuple[str, ...]) -> Column:
    """[F16] Whether a trace names everything and its times are no less than 0."""
    ok = [F.coalesce(F.col(c) != "", F.lit(False)) for c in NAMED] + [F.coalesce(F.col(c) >= 0, F.lit(False)) for c in times]
    return F.forall(F.array(*ok), lambda x: x)


def slo(requests: DataFrame, policy: dict, by: list[str], references: DataFrame | None = None) -> DataFrame:
    """[A15, F16] requests (ttft, per_token, failed, accounted, observed, prompt_present, series) against a policy (ttft, token, availability, samples, series).

    Passed: enough samples, latencies and availability within the policy, no reference left (references: keys, page_refs,
    snapshot_refs, lease_refs, request_refs; keys without a row have none), no prompt's content in a trace, and no more distinct series than the policy has.
    """
    out = requests.groupBy(*by).agg(
        F.count("*").alias("samples"), F.count_if("failed").alias("errors"), p95("ttft").alias("ttft_p95"), p95("per_token").alias("token_p95"), F.max(F.abs(F.col("accounted") - F.col("observed"))).alias("memory_delta"),
        (~F.bool_or(F.coalesce("prompt_present", F.lit(False)))).alias("redacted"), (F.countDistinct("series") <= policy["series"]).alias("bounded"),
    )
    if references is None:
        out = out.withColumn("reconciled", F.lit(True))
    else:
        left = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("page_refs", "snapshot_refs", "lease_refs", "request_refs")), F.lit(0))
        out = out.join(references.groupBy(*by).agg(F.max(left).alias("_left")), by, "left").withColumn("reconciled", F.coalesce("_left", F.lit(0)) == 0).drop("_left")
    availability = 100.0 * (F.col("samples") - F.col("errors")) / F.col("samples")
    ok = (F.col("ttft_p95") <= policy["ttft"]) & (F.col("token_p95") <= policy["token"]) & (F.col("availability") >= policy["availability"]) & (F.col("samples") >= policy["samples"])
    return out.withColumn("availability", availability).withColumn("passed", ok & F.col("reconciled") & F.col("redacted") & F.col("bounded"))


#: The marks of a request that fail a release candidate.
FAULTS = ("leaked", "incorrect", "cuda_error", "contaminated")


def rc1(requests: DataFrame, memory: DataFrame, limits: dict, by: str, references: DataFrame | None = None) -> DataFrame:
    """[A16, A17] PASS, FAIL or INCOMPLETE of each group of requests (ttft, inter_token, leaked, incorrect, cuda_error, contaminated).

    memory (accounted, observed, seq_no): the last sample with an observed value above 0 counts; without one nothing is decided.
    references (page_refs, snapshot_refs, lease_refs, request_refs, seq_no): the last sample is what is left unreconciled.
    """
    r = requests.groupBy(by).agg(F.count("*").alias("requests"), p95("ttft").alias("ttft_p95"), p95("inter_token").alias("token_p95"), *[F.count_if(c).alias(c) for c in FAULTS])
    ratio = F.max_by(F.abs(F.col("accounted") - F.col("observed")) / F.col("observed"), "seq_no")
    both = r.join(memory.where("observed > 0").groupBy(by).agg(ratio.alias("memory_error")), by, "left")
    if references is None:
        both = both.withColumn("unreconciled", F.lit(0).cast("long"))
    else:
        last = F.max_by(F.col("page_refs") + F.col("snapshot_refs") + F.col("lease_refs") + F.col("request_refs"), "seq_no").cast("long")
        both = both.join(references.groupBy(by).agg(last.alias("unreconciled")), by, "left").na.fill(0, ["unreconciled"])
    bad = (F.col("ttft_p95") > limits["ttft"]) | (F.col("token_p95") > limits["token"]) | (F.col("memory_error") > limits["memory"]) | (F.col("unreconciled") != 0)
    for c in FAULTS:
        bad = bad | (F.col(c) > 0)
    return both.withColumn("decision", F.when(F.col("memory_error").isNull() | (F.col("requests") == 0), "INCOMPLETE").when(bad, "FAIL").otherwise("PASS"))


def cardinality(events: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """[A18, P50] Distinct series and whether they are within the limit."""
    return events.agg(F.countDistinct(F.concat_ws(":", *keys)).alias("series")).withColumn("bounded", F.col("series") <= limit)


def summary(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """[A19, A28] median, mean, sample deviation, variation in percent, least and largest of repeated runs."""
    sd, mean = F.coalesce(F.stddev_samp(value), F.lit(0.0)), F.avg(value)
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.median(value).alias("median"), mean.alias("mean"), sd.alias("stdev"), F.when(mean == 0, 0.0).otherwise(sd / F.abs(mean) * 100).alias("cv"), F.min(value).alias("least"), F.max(value).alias("most"))


def delta_percent(base: Column, new: Column) -> Column:
    """[P44] A zero baseline is an error."""
    return F.when(F.assert_true(base != 0, F.lit("baseline is zero")).isNull(), (new - base) / base * 100)


def regression_gate(base: Column, new: Column, most: float) -> Column:
    """[P45] 1 within the limit, 0 beyond, -1 for values that cannot be compared."""
    return F.when((base <= 0) | (new < 0), -1).when((new - base) / base * 100 <= most, 1).otherwise(0)


def session(baseline: DataFrame, candidate: DataFrame, lower_is_better: list[str], keys: list[str], unstable_cv: float = 5.0, most: float = 5.0) -> DataFrame:
    """[A20, A21, A24, J20, X3] One row a metric that both have: delta of medians, unstable, regression, win."""
    b, c = (x.select(*keys, "metric", *[F.col(v).alias(f"{p}_{v}") for v in ("median", "cv")]) for x, p in ((baseline, "b"), (candidate, "c")))
    both = b.join(c, [*keys, "metric"]).withColumn("delta", delta_percent(F.col("b_median"), F.col("c_median")))
    lower = F.col("metric").isin(lower_is_better)
    both = both.withColumn("unstable", (F.col("b_cv") > unstable_cv) | (F.col("c_cv") > unstable_cv))
    return both.withColumn("regression", F.when(lower, F.col("delta") > most).otherwise(F.col("delta") < -most)).withColumn("win", F.when(lower, F.col("delta") < 0).otherwise(F.col("delta") > 0))


def session_state(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """[A20, A39] FAIL on a regression, INCOMPLETE when unstable, PASS with a win, else FAIL."""
    state = F.when(F.bool_or("regression"), "FAIL").when(F.bool_or("unstable"), "INCOMPLETE").when(F.bool_or("win"), "PASS").otherwise("FAIL")
    return metrics.groupBy(*keys).agg(F.count("*").alias("metrics"), F.count_if("regression").alias("regressions"), F.count_if("unstable").alias("unstable"), state.alias("state"))


def _squared_gap(mean: Column):
    return lambda x: (x - mean) * (x - mean)


#: The error that a case may have where it names no tolerance of its own, and the ratios of the states.
TOLERANCE, WIN, PARITY = 0.0002, 0.98, 1.02


def crossover(cases: DataFrame, most_cv: float = 5.0) -> DataFrame:
    """[A22] cases (..., compressed, dense, compressed_mib, dense_mib, max_error, tolerance) of latency arrays: state and reason, ratio of medians.

    INCOMPLETE: something is missing, fewer than three runs of a side, runs that vary by more than most_cv percent, or an error
    beyond the tolerance. Then WIN or PARITY by the ratio where less memory is used, else NO_CROSSOVER. The ratio is null where
    the case is INCOMPLETE.
    """
    stats = lambda a: (F.expr(f"aggregate({a}, cast(0 as double), (s, x) -> s + x, s -> s / size({a}))"), F.array_sort(a))
    out = cases
    for c in ("compressed", "dense"):
        mean, ordered = stats(c)
        n = F.size(c)
        var = F.aggregate(F.transform(c, _squared_gap(mean)), F.lit(0.0), lambda s, x: s + x) / F.greatest(n - 1, F.lit(1))
        half = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
        out = out.withColumn(f"{c}_median", half).withColumn(f"{c}_cv", F.when(mean == 0, float("inf")).otherwise(F.try_divide(F.sqrt(var), mean) * 100))
    needed = ("compressed", "dense", "compressed_mib", "dense_mib", "max_error")
    lacking = F.exists(F.array(*[F.col(c).isNull() for c in needed]), lambda x: x)
    why = (
        F.when(lacking, "missing").when((F.size("compressed") < 3) | (F.size("dense") < 3), "few").when((F.col("compressed_cv") > most_cv) | (F.col("dense_cv") > most_cv), "noise")
        .when(F.col("max_error") > F.coalesce("tolerance", F.lit(TOLERANCE)), "tolerance")
    )
    ratio = F.try_divide(F.col("compressed_median"), F.col("dense_median"))
    smaller = F.col("compressed_mib") < F.col("dense_mib")
    out = out.withColumn("reason", why).withColumn("ratio", F.when(F.col("reason").isNull(), ratio)).withColumn("memory_improved", F.when(F.col("reason").isNull(), smaller))
    state = F.when(F.col("reason").isNotNull(), "INCOMPLETE").when((F.col("ratio") <= WIN) & smaller, "WIN").when((F.col("ratio") <= PARITY) & smaller, "PARITY").otherwise("NO_CROSSOVER")
    return out.withColumn("state", state)


def overall(cases: DataFrame) -> DataFrame:
    """[A23] One row: the overall state, and cases of each state. Any WIN wins, then any PARITY; INCOMPLETE if no case is anything else."""
    n = cases.agg(F.count("*").alias("cases"), *[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("WIN", "PARITY", "NO_CROSSOVER", "INCOMPLETE")])
    state = F.when(F.col("win") > 0, "WIN").when(F.col("parity") > 0, "PARITY").when(F.col("incomplete") == F.col("cases"), "INCOMPLETE").otherwise("NO_CROSSOVER")
    return n.withColumn("state", state)


def grid(spark, dims: dict[str, list]) -> DataFrame:
    """[J22] Every combination of the listed values; as many rows as they have combinations."""
    out = None
    for name, values in dims.items():
        d = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
        out = d if out is None else out.crossJoin(d)
    return out


def first_divergence(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """[A26, J21] Sequences (keys, pos, sym): positions compared, agreeing ones, the first that differs; past the shorter one it differs."""
    l, r = a.select(*keys, "pos", F.col("sym").alias("x")), b.select(*keys, "pos", F.col("sym").alias("y"))
    both = l.join(r, [*keys, "pos"], "full_outer")
    same = F.col("x").eqNullSafe(F.col("y"))
    return both.groupBy(*keys).agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("compared"), F.count_if(same).alias("agreeing"), F.min(F.when(~same, F.col("pos"))).alias("first_difference"))


def prefix_capacity(sweep: DataFrame, keys: list[str]) -> DataFrame:
    """[A27] sweep (keys, context, ok): the largest context before the first failure."""
    first = sweep.where("not ok").groupBy(*keys).agg(F.min("context").alias("failed_at"))
    both = sweep.join(first, keys, "left").where("failed_at is null or context < failed_at")
    return sweep.select(*keys).distinct().join(both.groupBy(*keys).agg(F.max("context").alias("capacity")), keys, "left").na.fill(0, ["capacity"])


def soak(samples: DataFrame, keys: list[str]) -> DataFrame:
    """[A29] Samples, failures and growth from the first to the last."""
    return samples.groupBy(*keys).agg(F.count("*").alias("samples"), F.count_if("failed").alias("failures"), (F.max_by("memory", "at") - F.min_by("memory", "at")).alias("growth"))


def violations(documents: DataFrame, rules: DataFrame) -> DataFrame:
    """documents (doc_id, path, value) against rules (family, path, op, operand): the rules each document breaks.

    One engine for all families: `required`, `number_min`, `number_max`, `equals`, `matches`.
    """
    values = documents.groupBy("doc_id").agg(F.collect_list(F.struct("path", "value")).alias("values"))
    table = rules.agg(F.collect_list(F.struct("family", "path", "op", "operand")).alias("rules"))  # one row: rules are a few for each family
    each = values.crossJoin(table).select("doc_id", "values", F.explode("rules").alias("r"))
    own = F.transform(F.filter("values", lambda v: v["path"] == F.col("r.path")), lambda v: v["value"])
    all_ = each.select("doc_id", "r.*", F.explode_outer(own).alias("value"))
    n = F.expr("try_cast(value as double)")
    o = F.expr("try_cast(operand as double)")
    ok = (
        F.when(F.col("op") == "required", F.col("value").isNotNull())
        .when(F.col("op") == "number_min", n >= o)
        .when(F.col("op") == "number_max", n <= o)
        .when(F.col("op") == "equals", F.col("value") == F.col("operand"))
        .when(F.col("op") == "matches", F.expr("value rlike operand"))
    )
    return all_.where(~F.coalesce(ok, F.lit(False))).select("doc_id", "family", "path", "op")


def drift(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """[A40] References that changed between two counts."""
    both = before.select(*keys, F.col("n").alias("before")).join(after.select(*keys, F.col("n").alias("after")), keys, "full_outer").na.fill(0, ["before", "after"])
    return both.where("before <> after").withColumn("drift", F.col("after") - F.col("before"))


def missing(required: list[str], present: DataFrame, name: str) -> DataFrame:
    """[X2] Required names that are not present."""
    all_ = present.sparkSession.createDataFrame([(x,) for x in required], f"{name} string")
    return all_.join(present.select(name).distinct(), name, "left_anti")


def running_peak(events: DataFrame, keys: list[str], order: list[str], change: str) -> DataFrame:
    """[A35, W6] Running sum of changes and its peak."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("level", F.sum(change).over(w)).groupBy(*keys).agg(F.max("level").alias("peak"), F.max_by("level", F.struct(*order)).alias("final"))
