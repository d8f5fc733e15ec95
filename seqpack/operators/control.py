"""Placement, routing, leases, security and scheduling over small fact tables joined to large ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqpack.functions import cuts, hashes

#: The roles that may do each operation.
OPERATIONS = {
    "register_worker": ("router", "scheduler", "admin"),
    "publish_manifest": ("prefill", "decode"),
    "read_page": ("prefill", "decode", "router"),
    "transfer_lease": ("prefill", "decode", "scheduler"),
    "route_request": ("router", "scheduler"),
    "update_policy": ("admin",),
    "drain_worker": ("admin",),
    "inspect_usage": ("admin",),
}


def layer_devices(layers: int, devices: DataFrame) -> DataFrame:
    """[P42] (layer, ordinal): layer * D div L."""
    n = devices.agg(F.count("*").alias("d"))
    return devices.sparkSession.range(layers).crossJoin(n).select(F.col("id").alias("layer"), F.expr(f"id * d div {layers}").alias("ordinal"))


def peer_links(devices: DataFrame) -> DataFrame:
    """[J18] (a, b) of devices of one group, a before b."""
    a, b = devices.alias("a"), devices.alias("b")
    return a.join(b, (F.col("a.peer_group") == F.col("b.peer_group")) & (F.col("a.ordinal") < F.col("b.ordinal"))).select(F.col("a.ordinal").alias("a"), F.col("b.ordinal").alias("b"))


def transports(moves: DataFrame, devices: DataFrame) -> DataFrame:
    """[J19, T22] moves (source, target, bytes) with how they go: local, peer within a group, staged between groups."""
    s = devices.select(F.col("ordinal").alias("source"), F.col("peer_group").alias("gs"))
    t = devices.select(F.col("ordinal").alias("target"), F.col("peer_group").alias("gt"))
    how = F.when(F.col("source") == F.col("target"), "local").when(F.col("gs") == F.col("gt"), "peer").otherwise("staged")
    return moves.join(s, "source").join(t, "target").withColumn("transport", how)


def placed(sequences: DataFrame, devices: int, moves: DataFrame, seed: int = 0) -> DataFrame:
    """[P32, T21] (seq_id, device): by the mixed hash of id and seed, or where the last move has put it."""
    last = moves.groupBy("seq_id").agg(F.max_by("device", "seq_no").alias("moved"))
    own = hashes.mixed_slot(F.col("seq_id"), devices, seed)
    return sequences.withColumn("own", own).join(last, "seq_id", "left").select("seq_id", F.coalesce("moved", "own").alias("device"))


def eligible(workers: DataFrame) -> DataFrame:
    """[F7, F8]"""
    return workers.where("healthy and model_loaded")


def routed(workers: DataFrame) -> DataFrame:
    """[J17] The best worker of each role: free memory a sequence, backlog counted for decoding; ties to the least id."""
    load = F.col("active") + 1 + F.when(F.col("role") == "decode", F.col("backlog")).otherwise(0)
    scored = eligible(workers).withColumn("score", F.floor(F.col("free_vram") / load))
    best = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("score"), "worker_id"))
    return scored.withColumn("r", best).where("r = 1").select("role", "worker_id", "score")


def cached_prefix(requests: DataFrame, manifests: DataFrame, now: Column) -> DataFrame:
    """[J17] requests (request_id, model, tokens) with the longest live cached prefix of their model, and what is left to do."""
    live = manifests.where(F.col("expires_at") > now).groupBy("model").agg(F.max(F.col("page_size") * (F.col("page_index") + 1)).alias("upto"))
    cached = F.least("tokens", F.coalesce("upto", F.lit(0)))
    return requests.join(live, "model", "left").select("request_id", "model", "tokens", cached.alias("cached"), (F.col("tokens") - cached).alias("suffix"), ((F.col("tokens") - cached) * 1024).alias("transfer_bytes"))


def fenced(claims: DataFrame, leases: DataFrame, now: Column) -> DataFrame:
    """[F9, J14, T17] claims (page, generation, token) with whether the page's lease is that one and still runs."""
    own = leases.select("page", F.col("generation").alias("g"), F.col("token").alias("t"), "expires_at")
    verdict = F.when(F.col("g").isNull(), "no lease").when((F.col("g") != F.col("generation")) | (F.col("t") != F.col("token")), "stale").when(F.col("expires_at") <= now, "expired").otherwise("held")
    return claims.join(own, "page", "left").withColumn("verdict", verdict)


LEASED = "page long, seq_no long, op string, ok boolean, owner long, generation long, token string, expires_at long"


def leases(ops: DataFrame, duration: int) -> DataFrame:
    """[T17, P35] Replay of ops (page, seq_no, op, worker, generation, token, at): acquire, renew, transfer; the lease after each, or a refusal.

    Acquiring takes an expired lease or none, and a worker; renewing and transferring the lease's generation and token, expired or
    not. A lease's token follows from page, owner and generation. A page is one task's work.
    """
    own = ops.withColumn("page_hash", hashes.fnv1a(F.encode(F.col("page").cast("string"), "UTF-8")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        owner, generation, until, held, out = 0, 0, -1, None, []
        for r in pdf.sort_values("seq_no").itertuples():
            if r.op == "acquire":
                ok = r.worker != 0 and until <= r.at
            else:
                ok = generation > 0 and r.generation == generation and r.token == held and (r.op == "renew" or r.op == "transfer" and r.worker != 0)
            if ok:
                if r.op != "renew":
                    owner, generation = int(r.worker), generation + 1
                    held = hashes.token_of(r.page_hash, owner, generation)
                until = int(r.at) + duration
            out.append((r.page, r.seq_no, r.op, bool(ok), owner, generation, held, until))
        return pd.DataFrame(out, columns=[c.split()[0] for c in LEASED.split(", ")])

    return own.groupBy("page").applyInPandas(one, LEASED)


def page_token(page: Column, owner: Column, generation: Column) -> Column:
    """[P35] The token of a page's lease under an owner and generation."""
    return hashes.lease_token(hashes.fnv1a(F.encode(page.cast("string"), "UTF-8")), owner, generation)


def transfer_verdict() -> Column:
    """[F10, T18] Why a transfer (authenticated, integrity_ok, complete, bytes, expected_bytes) is refused, or `accepted`."""
    return F.when(~F.col("authenticated"), "not authenticated").when(~F.col("integrity_ok"), "integrity").when(~F.col("complete"), "incomplete").when(F.col("bytes") != F.col("expected_bytes"), "size").otherwise("accepted")


def recovery(manifests: DataFrame, failed: DataFrame) -> DataFrame:
    """[J15, T18] Per failed worker: its pages, those with another replica, those lost."""
    own = manifests.join(failed, manifests.owner == failed.worker_id)
    return own.groupBy("worker_id").agg(F.count("*").alias("pages"), F.count_if(F.col("replicas") > 1).alias("recoverable"), F.count_if(F.col("replicas") <= 1).alias("lost"))


def role_table(spark) -> DataFrame:
    return spark.createDataFrame([(r, o) for o, roles in OPERATIONS.items() for r in roles], "role string, operation string")


def authorized(requests: DataFrame, table: DataFrame) -> DataFrame:
    """[P39, F12, T15] requests (role, operation, tenant, resource_tenant) with allowed: the role may do it, within its tenant unless it is admin or no tenant (0) is meant."""
    may = requests.join(table.withColumn("may", F.lit(True)), ["role", "operation"], "left")
    bound = (F.col("role") == "admin") | (F.col("resource_tenant") == 0) | (F.col("tenant") == F.col("resource_tenant"))
    return may.withColumn("allowed", F.coalesce("may", F.lit(False)) & bound).drop("may")


def identity_verdict(now: Column, current: Column, following: Column, rotated_at: Column, grace: Column) -> Column:
    """[F11, T15] Whether a peer (not_before, not_after, key_generation) is valid: in time, both bounds included, with the current key, or the following one within the grace after a rotation.

    following and rotated_at are 0 when no rotation has begun.
    """
    key = F.col("key_generation")
    is_next = (following != 0) & (key == following)
    within = (rotated_at != 0) & (now <= rotated_at + grace)
    timely = (F.col("not_before") <= now) & (now <= F.col("not_after"))
    return F.when((key != current) & ~is_next, "stale key").when((key != current) & ~within, "out of grace").when(~timely, "outside its time").otherwise(F.when(key == current, "valid").otherwise("grace"))


def rotated(config: DataFrame, requests: DataFrame) -> DataFrame:
    """[T15] config (current, ...) after the last rotation (seq_no, following, at) to a later key than the current one: following and rotated_at, 0 without any."""
    best = F.max(F.struct("seq_no", "following", "at")).alias("m")
    last = config.join(requests, F.col("following") > F.col("current")).agg(best)
    return config.join(last).select(config["*"], F.coalesce("m.following", F.lit(0)).alias("following"), F.coalesce("m.at", F.lit(0)).alias("rotated_at"))


def fresh_tokens(tokens: DataFrame, window: int) -> DataFrame:
    """[F13, P33, T14] tokens (token_id, peer, nonce, issued_at, operation, seen_at): accepted the first time they are seen within window of their issue.

    A token is named by the hash of peer, nonce, time and operation; a sight outside the window is no sight. Peers or nonces of 0 are refused.
    What was seen is kept, however much it is.
    """
    sound = (F.col("peer") != 0) & (F.col("nonce") != 0)
    timely = F.col("issued_at").between(F.greatest(F.lit(0), F.col("seen_at") - window), F.col("seen_at") + window)
    named = tokens.withColumn("hash", hashes.replay_hash(*map(F.col, ("peer", "nonce", "issued_at", "operation")))).withColumn("good", sound & timely)
    first = F.row_number().over(Window.partitionBy("hash", "good").orderBy("seen_at", "token_id")) == 1
    return named.withColumn("verdict", F.when(~sound, "invalid").when(~timely, "outside the window").when(first, "accepted").otherwise("replayed")).drop("hash", "good")


def audit_chain(events: DataFrame, key: str) -> DataFrame:
    """[W7] Per key the head of its hash chain: each link digests the one before and its event, in order of seq_no."""
    ordered = F.array_sort(F.collect_list(F.struct("seq_no", "event")))
    return events.groupBy(key).agg(F.aggregate(ordered, F.lit(""), lambda h, e: F.sha2(F.concat(h, e["event"]), 256)).alias("chain"), F.count("*").alias("links"))


def signed(manifests: DataFrame, fields: list[str], secret: str) -> DataFrame:
    """[T16, P51] manifests with a keyed digest of their sorted fields."""
    return manifests.withColumn("signature", _signature(fields, secret))


def verified(manifests: DataFrame, fields: list[str], secret: str) -> DataFrame:
    return manifests.withColumn("sound", F.col("signature") == _signature(fields, secret))


def _signature(fields: list[str], secret: str) -> Column:
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(fields)]))
    return F.sha2(F.concat(F.lit(secret), F.sha2(F.concat(F.lit(secret), body), 256)), 256)


def release_problems(files: DataFrame) -> DataFrame:
    """[F14, E9] Files (name, digest) whose digest is no 64 hex digits or whose name stands twice."""
    n = F.count("*").over(Window.partitionBy("name"))
    why = F.array_compact(F.array(F.when(~F.coalesce(F.col("digest").rlike("^[0-9a-f]{64}$"), F.lit(False)), F.lit("digest")), F.when(n > 1, F.lit("duplicate"))))
    return files.withColumn("problems", why).where(F.size("problems") > 0)


def valid_shards(shards: DataFrame, devices: DataFrame) -> DataFrame:
    """shards (device, bits, begin, n) with the reasons against them: unknown device, codec, range."""
    known = shards.join(devices.select(F.col("ordinal").alias("device"), F.lit(True).alias("known")), "device", "left")
    why = F.array_compact(F.array(F.when(F.col("known").isNull(), F.lit("device")), F.when(~F.col("bits").isin(2, 4, 8, 16), F.lit("codec")), F.when((F.col("begin") < 0) | (F.col("n") < 1), F.lit("range"))))
    return known.withColumn("reasons", why).drop("known")


#: The scenarios that a qualification has to hold evidence of.
SCENARIOS = ("cache-cold", "cache-warm", "multi-tenant-overload", "cancellation", "decode-worker-failure", "network-fault", "certificate-rotation", "rolling-upgrade", "rollback")


def scenarios(spark) -> DataFrame:
    """[E4]"""
    return spark.createDataFrame([(i, n) for i, n in enumerate(SCENARIOS)], "scenario_id int, name string")


def supports(mask: Column, model: Column) -> Column:
    """[P38] Whether a mask has a model's bit; models from 64 on are in none."""
    return F.when((model >= 0) & (model < 64), F.getbit(mask.cast("long"), model.cast("int")) == 1).otherwise(False)


def estimates() -> tuple[Column, Column]:
    """[P36] Prefill and decode microseconds of a request on a worker."""
    return F.expr("greatest(0, prompt_tokens - cached_tokens) * 1000000 div greatest(1, prefill_rate)"), F.expr("completion_tokens * 1000000 div greatest(1, decode_rate)")


def fairness() -> Column:
    """[P37]"""
    return F.expr("greatest(0, virtual_runtime div greatest(1, weight) - priority * 1000)")


#: Cells of workers, and answers to shapes, that are broadcast at most; more of them are met in a shuffle, in so many parts for each model.
BROADCAST, PARTS = 10_000, 64
#: Cells for each e-fold of a rate: rates of one cell differ by a thirty-second at most.
FINE = 32


def able_workers(workers: DataFrame) -> DataFrame:
    """Per model the eligible workers with the cell of their rates; of those that are alike in load and rates the least id."""
    load = (F.col("queue_depth") + F.col("active")).alias("load")
    rates = [F.greatest(F.lit(1), c).alias(c) for c in ("prefill_rate", "decode_rate")]
    able = workers.where("state < 2 and not circuit_open").select("worker_id", "model_mask", load, *rates)
    models = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")), lambda m: F.getbit(F.col("model_mask").cast("long"), m.cast("int")) == 1)
    able = able.select(F.explode(models).alias("model_id"), "worker_id", "load", "prefill_rate", "decode_rate")
    same = able.groupBy("model_id", "load", "prefill_rate", "decode_rate").agg(F.min("worker_id").alias("worker_id"))
    return same.withColumns({f"_{c}": F.floor(F.log(c) * FINE) for c in ("prefill_rate", "decode_rate")})


def best_worker(requests: DataFrame, workers: DataFrame) -> DataFrame:
    """[J16, O5] Per request (request_id, model_id, ...) the eligible worker of least score, ties to the least id; requests without one have no row.

    A tenant's fairness is the same for all workers, so it never decides between them. Requests never meet workers: what decides
    is a request's shape (model, tokens to prefill and to decode, none of either without a deadline), so each shape is answered
    once. A shape first meets cells of workers alike in load and nearly alike in rates; the slowest and the fastest rates of a
    cell bound its scores, and only workers of cells whose least score is not above the least upper bound are scored.
    """
    urgent, work, slots = F.col("deadline") > 0, F.expr("greatest(0, prompt_tokens - cached_tokens)"), F.coalesce("completion_tokens", F.lit(0))
    asked = requests.select("request_id", "model_id", "prompt_tokens", "cached_tokens", "completion_tokens", *[F.when(urgent, c).otherwise(0).cast("long").alias(n) for c, n in ((work, "_prompt"), (slots, "_completion"))], F.coalesce(urgent, F.lit(False)).alias("_urgent"))
    shape, cell = ["model_id", "_prompt", "_completion"], ["model_id", "load", "_prefill_rate", "_decode_rate"]
    score = lambda fast, slow: F.expr(f"_prompt * 1000000 div {fast} + _completion * 1000000 div {slow} + load * 1000")
    able = able_workers(workers)
    cells = able.groupBy(*cell).agg(*[f(c).alias(f"{n}_{c}") for c in ("prefill_rate", "decode_rate") for f, n in ((F.min, "least"), (F.max, "most"))])
    few = cells.limit(BROADCAST + 1).count() <= BROADCAST

    def met(shapes: DataFrame) -> DataFrame:
        if few:
            return shapes.join(F.broadcast(cells), "model_id")
        parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
        return shapes.withColumn("_part", F.pmod(F.xxhash64(*shape), F.lit(PARTS)).cast("int")).join(cells.withColumn("_part", parts), ["model_id", "_part"])

    bounds = met(asked.select(*shape).distinct()).groupBy(*shape).agg(F.min(score("least_prefill_rate", "least_decode_rate")).alias("_bound"))
    near = met(bounds).where(score("most_prefill_rate", "most_decode_rate") <= F.col("_bound")).select(*shape, *cell[1:])
    best = F.min(F.struct(score("prefill_rate", "decode_rate").alias("score"), "worker_id", "prefill_rate", "decode_rate")).alias("m")
    chosen = cuts.written(near.join(able, cell).groupBy(*shape).agg(best).select(*shape, "m.*"))
    if chosen.limit(BROADCAST + 1).count() <= BROADCAST:
        answered = asked.join(F.broadcast(chosen), shape)
    else:
        # all requests without a deadline share a shape for each model: their answers are copied to parts
        free, parts = (F.col("_prompt") == 0) & (F.col("_completion") == 0), F.sequence(F.lit(0), F.lit(PARTS - 1))
        spread = asked.withColumn("_part", F.when(free, F.pmod(F.xxhash64("request_id"), F.lit(PARTS)).cast("int")).otherwise(0))
        answered = spread.join(chosen.withColumn("_part", F.explode(F.when(free, parts).otherwise(F.array(F.lit(0))))), [*shape, "_part"])
    prefill, decode = estimates()
    scored = answered.withColumn("prefill_us", prefill).withColumn("decode_us", decode)
    scored = scored.select("request_id", F.when(~F.col("_urgent") | F.col("decode_us").isNotNull(), F.col("score")).alias("score"), "worker_id", "prefill_us", "decode_us")
    # a request_id that stands twice has one row
    one = cuts.dealt(scored, requests, "request_id").groupBy("request_id").agg(F.min(F.struct("score", "worker_id", "prefill_us", "decode_us")).alias("m"))
    return one.select("request_id", "m.worker_id", "m.prefill_us", "m.decode_us", "m.score")


def scale_plan(tenants: DataFrame, workers: DataFrame, threshold: int) -> DataFrame:
    """[A36] Wanted prefill and decode workers and replicas, by healthy workers and queued requests."""
    q, h = tenants.agg(F.coalesce(F.sum("queued"), F.lit(0)).alias("queued")), workers.agg(F.count_if((F.col("state") == 0) & ~F.col("circuit_open")).alias("healthy"))
    over = F.when(F.col("queued") > threshold, 1).otherwise(0)
    return q.crossJoin(h).select((F.greatest(F.lit(1), F.expr("healthy div 2")) + over).alias("prefill"), (F.greatest(F.lit(2), F.expr("healthy - healthy div 2")) + over).alias("decode"), (over + 1).alias("replicas"))


REPLAYED = "seq_no long, op string, request_id long, tenant long, result string, worker_id long, prefill_us long, decode_us long, kv_bytes long, queue_position long, fairness long, active long, queued long"


def replay(ops: DataFrame, tenants: DataFrame, workers: DataFrame, max_active: int, max_queued: int) -> DataFrame:
    """[T19, F6, A35, J16] Replay of ops (seq_no, op, request_id, tenant, model_id, priority, prompt_tokens, completion_tokens, cached_tokens, deadline, generated, gpu_us).

    op: admit, complete, cancel. tenants (tenant, weight, concurrent, queued, prompt_quota, completion_quota, gpu_budget) and
    workers stand as they are for the whole log. An admission is refused for an id that is held, an unknown tenant, or one of its
    numbers being 0; then quotas are looked at (prompt tokens of all admissions, generated tokens and GPU time of all
    completions), then whether a worker has the model, then whether it runs now or waits (all active requests, the tenant's own)
    and whether there is room to wait (all, the tenant's). Completing adds usage, once for each id; cancelling does not. Queued
    requests are not promoted. A row's active and queued are the totals after it.

    Each request's worker is found before, in parallel. Totals over all tenants decide the rest, so the log is one key and one
    task's work: meant for logs of decisions, not for facts.
    """
    asked = ops.where("op = 'admit'").select("request_id", "seq_no", "model_id", "prompt_tokens", "cached_tokens", "completion_tokens", "deadline")
    best = best_worker(asked.withColumn("request", F.col("request_id")).withColumn("request_id", F.col("seq_no")), workers).select(F.col("request_id").alias("seq_no"), "worker_id", "prefill_us", "decode_us")
    policy = tenants.select("tenant", "weight", "concurrent", F.col("queued").alias("waiting"), "prompt_quota", "completion_quota", "gpu_budget")
    log = ops.join(best, "seq_no", "left").join(policy, "tenant", "left").na.fill(0)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names = ("active", "queued", "prompt", "generated", "gpu", "runtime")
        state: dict = {}
        held: dict = {}
        billed: set = set()
        total = {"active": 0, "queued": 0}
        out = []
        for r in pdf.sort_values("seq_no").itertuples():
            result, place, fair, fresh = "refused", 0, 0, False
            if r.op == "admit" and r.request_id and r.request_id not in held and r.weight and r.prompt_tokens and r.completion_tokens:
                own = state.setdefault(r.tenant, dict.fromkeys(names, 0))
                if own["prompt"] + r.prompt_tokens > r.prompt_quota or own["generated"] + r.completion_tokens > r.completion_quota or own["gpu"] >= r.gpu_budget:
                    result = "quota"
                elif not r.worker_id:
                    result = "model"
                else:
                    side = "queued" if total["active"] >= max_active or own["active"] >= r.concurrent else "active"
                    if side == "queued" and (total["queued"] >= max_queued or own["queued"] >= r.waiting):
                        result = "overload"
                    else:
                        result, fresh = "queue" if side == "queued" else "now", True
                        place = total["queued"] + 1 if side == "queued" else 0
                        own[side] += 1
                        total[side] += 1
                        held[r.request_id] = (side, r.tenant)
                        own["prompt"] += r.prompt_tokens
                        own["runtime"] += r.prompt_tokens + r.completion_tokens
                        fair = max(0, own["runtime"] // r.weight - r.priority * 1000)
            elif r.op == "complete" and r.request_id in held and r.request_id in billed:
                result = "duplicate"
            elif r.op in ("complete", "cancel") and r.request_id in held:
                side, tenant = held.pop(r.request_id)
                state[tenant][side] -= 1
                total[side] -= 1
                if r.op == "complete":
                    state[tenant]["generated"] += r.generated
                    state[tenant]["gpu"] += r.gpu_us
                    billed.add(r.request_id)
                result = "done"
            out.append((r.seq_no, r.op, r.request_id, r.tenant, result, *((r.worker_id, r.prefill_us, r.decode_us, r.prompt_tokens * 1024) if fresh else (0, 0, 0, 0)), place, fair, total["active"], total["queued"]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in REPLAYED.split(", ")])

    return log.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(one, REPLAYED)
