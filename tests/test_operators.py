"""Operators on hand-made rows: empty inputs, misses, refusals, and what SQL cannot say."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from seqpack.functions import bytecodes, hashes
from seqpack.operators import codec, control, evidence, kv, search, store, succinct
from seqpack.sources import generators, tables

TOKENS = "stream_id long, pos long, sym string"


def tokens(spark, *streams):
    rows = [(s, p, c) for s, text in enumerate(streams) for p, c in enumerate(text)]
    return spark.createDataFrame(rows, TOKENS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_patterns_without_hits_are_counted_as_zero(spark):
    t = tokens(spark, "abab", "b")
    p = spark.createDataFrame([("ab", ["a", "b"]), ("ba", ["b", "a"]), ("zz", ["z", "z"]), ("b", ["b"])], "pid string, syms array<string>")
    assert [(r.pid, r.n) for r in search.count(t, p, [1, 2]).orderBy("pid").collect()] == [("ab", 2), ("b", 3), ("ba", 1), ("zz", 0)]
    assert rows(search.locate(t, p, [2])) == [("ab", 0, 0), ("ab", 0, 2), ("ba", 0, 1)]


def test_empty_patterns_are_refused(spark):
    with pytest.raises(ValueError):
        search.count(tokens(spark, "a"), spark.createDataFrame([("", [])], "pid string, syms array<string>"), [0])


def test_no_tokens_give_no_rows(spark):
    t = tokens(spark)
    assert search.ngrams(t, 2).count() == succinct.c_table(t).count() == succinct.entropy(t).count() == search.suffix_array(t).count() == 0


def test_access_and_rank_at_the_edges(spark):
    t = tokens(spark, "abca")
    q = spark.createDataFrame([(1, 0, 0), (2, 0, 4)], "qid long, stream_id long, pos long")
    assert [r.sym for r in succinct.access(t, q).orderBy("qid").collect()] == ["a", None]
    r = spark.createDataFrame([(1, 0, "a", 0), (2, 0, "a", 4), (3, 0, "z", 4)], "qid long, stream_id long, sym string, i long")
    for f in (succinct.rank(t, r), succinct.rank_indexed(succinct.rank_directory(t, 2), r, 2)):
        assert [x["rank"] for x in f.orderBy("qid").collect()] == [0, 2, 0]


@pytest.mark.parametrize("text", ["banana", "aaaa", "a", "mississippi"])
def test_suffix_arrays_sort_the_suffixes(spark, text):
    sa = [r.pos for r in search.suffix_array(tokens(spark, text)).orderBy("sa_rank").collect()]
    assert sa == sorted(range(len(text) + 1), key=lambda i: text[i:])


def test_the_two_roundings_differ_on_ties(spark):
    v = spark.createDataFrame([(0, i, x) for i, x in enumerate((7.0, 0.5, -0.5, 1.5, -7.0))], "page long, idx long, x double")
    q = lambda rounding: [r.q for r in codec.quantized(v, ["page"], 4, rounding).orderBy("idx").collect()]
    assert q("away") == [7, 1, -1, 2, -7]
    assert q("even") == [7, 0, 0, 2, -7]


def test_a_page_of_zeros_has_scale_one(spark):
    v = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.0)], "page long, idx long, x double")
    assert {(r.s, r.q) for r in codec.quantized(v, ["page"], 4).collect()} == {(1.0, 0)}


def test_unsound_values_are_counted(spark):
    v = spark.createDataFrame([(0, 0, float("nan")), (0, 1, float("-inf")), (0, 2, 1.0)], "page long, idx long, x double")
    r = codec.analysed(v).first()
    assert (r.nan_values, r.inf_values) == (1, 1)


def test_nibbles_of_an_odd_count(spark):
    q = spark.createDataFrame([(0, i, x) for i, x in enumerate((-8, 7, -1))], "page long, idx long, q int")
    back = codec.from_nibbles(codec.nibbles(q, ["page"]), ["page"])
    assert rows(back.select("idx", "q")) == [(0, -8), (1, 7), (2, -1)]


def test_queries_that_see_nothing_give_zeros(spark):
    h = spark.createDataFrame([(5, 0, [1.0, 0.0], [3.0, 4.0])], "token long, head long, k array<double>, v array<double>")
    q = spark.createDataFrame([(4, 0, [1.0, 1.0]), (5, 0, [1.0, 1.0]), (7, 0, [1.0, 1.0])], "qpos long, qhead long, q array<double>")
    for window, seen in ((2, {4: [0.0, 0.0], 5: [3.0, 4.0], 7: [0.0, 0.0]}), (0, {4: [0.0, 0.0], 5: [3.0, 4.0], 7: [3.0, 4.0]})):
        assert {r.qpos: r.out for r in kv.attention(q, h, window, 2).collect()} == seen


def test_delta_fetch_past_the_base(spark):
    base = spark.createDataFrame([(0, 5), (1, 6)], "pos long, val int")
    delta = spark.createDataFrame([(1, 1, 9)], "leaf long, pos long, val int")
    q = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (1, 7)], "leaf long, pos long")
    assert rows(kv.delta_fetch(q, base, delta)) == [(1, 0, 5), (1, 1, 9), (1, 7, -1), (2, 1, 6)]


def test_overlapping_pages(spark):
    p = spark.createDataFrame([(1, 0, 0, 0, 4, 8), (2, 0, 0, 3, 4, 8), (3, 0, 0, 7, 4, 8), (4, 0, 1, 3, 4, 8)], "page_id long, layer int, head int, begin long, n long, bytes long")
    assert [r.page_id for r in store.overlaps(p).collect()] == [2]


def test_sequence_log(spark):
    log = [("create", 0), ("create", 0), ("append", 10), ("begin", 0), ("append", 4), ("begin", 0), ("commit", 5), ("commit", 3), ("rollback", 0), ("remove", 14), ("remove", 3), ("destroy", 0), ("append", 1)]
    ops = spark.createDataFrame([(7, i, op, n) for i, (op, n) in enumerate(log)], "seq_id long, seq_no long, op string, n long")
    out = store.fold(ops).orderBy("seq_no").collect()
    assert [r.ok for r in out] == [True, False, True, True, True, False, False, True, False, False, True, True, False]
    assert [r.length for r in out] == [0, 0, 10, 10, 14, 14, 14, 13, 13, 13, 10, 0, 0]


def test_ranges_must_keep_to_pages(spark):
    refs = spark.createDataFrame([(1, 0, 0, 64, 1), (1, 0, 64, 64, 2)], "seq_id long, layer int, begin long, n long, page_id long")
    assert [r.page_id for r in store.removed(refs, 1, 0, 64).collect()] == [2]
    with pytest.raises(Exception, match="not aligned"):
        store.removed(refs, 1, 0, 65).collect()
    with pytest.raises(Exception, match="below 0"):
        store.shifted(refs, 1, 0, 64, -64).collect()


@pytest.mark.parametrize("fault", [None, *store.SEAL_STEPS])
def test_pages_are_published_whole_or_not_at_all(spark, fault):
    values = spark.createDataFrame([(s, i, float(i - 3 * s)) for s in (1, 2) for i in range(7)], "seq long, idx long, x double")
    visible, released = [], []
    seal = lambda: store.seal(values, ["seq"], 3, lambda df: df.collect(), visible.extend, lambda: released.append(1), fault)
    if fault:
        with pytest.raises(store.SealFault, match=fault):
            seal()
    else:
        seal()
    assert len(visible) == (4 if fault in (None, "release") else 0) and bool(released) == (fault is None)
    for r in visible:
        x = [float(r.page * 3 + k - 3 * r.seq) for k in range(3)]
        codes = [max(-8, min(7, round(v / r.scale))) & 15 for v in x]
        assert r.n == 3 and bytes(r.payload) == bytes([codes[0] | codes[1] << 4, codes[2]]) and len(r.checksum) == 64


def test_pages_with_unsound_values_are_not_sealed(spark):
    values = spark.createDataFrame([(1, 0, float("nan")), (1, 1, 1.0)], "seq long, idx long, x double")
    with pytest.raises(store.SealFault, match="validate"):
        store.seal(values, ["seq"], 2, lambda df: df, lambda df: None)


def test_values_that_are_not_finite_have_code_0(spark):
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate([7.0, -3.0, float("nan"), float("inf"), float("-inf")])], "page long, idx long, x double")
    for rounding in ("away", "even"):
        assert [r.q for r in codec.quantized(df, ["page"], 4, rounding).orderBy("idx").collect()] == [7, -3, 0, 0, 0]
    assert [r.q for r in codec.blockwise(df).orderBy("idx").collect()] == [15, 5, 8, 8, 8]


def test_lease_log(spark):
    token = lambda owner, generation: spark.range(1).select(control.page_token(F.lit(9), F.lit(owner), F.lit(generation))).first()[0]
    one, two, wrong = token(1, 1), token(3, 2), token(2, 1)
    assert len({one, two, wrong}) == 3 and len(one) == 64
    log = [("acquire", 1, 0, "", 0), ("acquire", 2, 0, "", 5), ("renew", 0, 1, one, 6), ("renew", 0, 1, wrong, 6), ("transfer", 3, 1, one, 7), ("renew", 0, 1, one, 8), ("renew", 0, 2, two, 100), ("acquire", 0, 0, "", 200), ("acquire", 4, 0, "", 200)]
    ops = spark.createDataFrame([(9, i, *x) for i, x in enumerate(log)], "page long, seq_no long, op string, worker long, generation long, token string, at long")
    out = control.leases(ops, 10).orderBy("seq_no").collect()
    assert [(r.ok, r.owner, r.generation) for r in out] == [(True, 1, 1), (False, 1, 1), (True, 1, 1), (False, 1, 1), (True, 3, 2), (False, 3, 2), (True, 3, 2), (False, 3, 2), (True, 4, 3)]
    assert out[0].token == one and out[4].token == two


OPS = "seq_no long, op string, request_id long, tenant long, model_id long, priority long, prompt_tokens long, completion_tokens long, cached_tokens long, deadline long, generated long, gpu_us long"


def scheduler(spark, ops, quota=1000, gpu=10_000_000, waiting=2):
    tenants = spark.createDataFrame([(1, 1, 1, waiting, quota, 1000, gpu), (2, 2, 1, waiting, quota, 1000, gpu)], "tenant long, weight long, concurrent long, queued long, prompt_quota long, completion_quota long, gpu_budget long")
    workers = spark.createDataFrame([(10, 0, False, 2, 1000, 200, 0, 0), (11, 0, False, 2, 1500, 300, 0, 0)], "worker_id long, state int, circuit_open boolean, model_mask long, prefill_rate long, decode_rate long, queue_depth long, active long")
    return control.replay(spark.createDataFrame([(i, *x) for i, x in enumerate(ops)], OPS), tenants, workers, 2, 8).orderBy("seq_no").collect()


def test_scheduler_log(spark):
    """Two tenants of one running request each: the fast worker is taken, the second request of a tenant waits."""
    admit = lambda i, t, p, c, prio=0, cached=0, model=1: ("admit", i, t, model, prio, p, c, cached, 1000, 0, 0)
    end = lambda op, i, n=0, us=0, t=1: (op, i, t, 0, 0, 0, 0, 0, 0, n, us)
    out = scheduler(spark, [admit(100, 1, 128, 32, 10, 64), admit(101, 1, 128, 32, 1), admit(102, 2, 64, 16, 5), end("cancel", 101), end("complete", 100, 24, 5000), end("complete", 100, 24, 5000), end("complete", 102, 12, 3000, t=1)])
    assert [(r.result, r.worker_id) for r in out] == [("now", 11), ("queue", 11), ("now", 11), ("done", 0), ("done", 0), ("refused", 0), ("done", 0)]
    assert (out[0].prefill_us, out[0].decode_us, out[0].kv_bytes) == (64 * 1_000_000 // 1500, 32 * 1_000_000 // 300, 128 * 1024)
    assert [(r.active, r.queued) for r in out] == [(1, 0), (1, 1), (2, 1), (2, 0), (1, 0), (1, 0), (0, 0)] and out[1].queue_position == 1
    again = scheduler(spark, [admit(1, 1, 10, 5), end("complete", 1, 1, 1), admit(1, 1, 10, 5), end("complete", 1, 1, 1), admit(2, 1, 10, 5, model=3), admit(3, 9, 10, 5), admit(4, 1, 0, 5), admit(0, 1, 10, 5)])
    assert [r.result for r in again] == ["now", "done", "now", "duplicate", "model", "refused", "refused", "refused"]


def test_scheduler_quotas(spark):
    admit = lambda i, p=10, c=5: ("admit", i, 1, 1, 0, p, c, 0, 0, 0, 0)
    end = lambda i, n, us: ("complete", i, 1, 0, 0, 0, 0, 0, 0, n, us)
    assert [r.result for r in scheduler(spark, [admit(1, 600), end(1, 0, 0), admit(2, 401), admit(3, 400)])] == ["now", "done", "quota", "now"]
    assert [r.result for r in scheduler(spark, [admit(1, c=900), end(1, 900, 0), admit(2, c=101), admit(3, c=100)])] == ["now", "done", "quota", "now"]
    assert [r.result for r in scheduler(spark, [admit(1), end(1, 1, 50), admit(2)], gpu=50)] == ["now", "done", "quota"]
    assert [r.result for r in scheduler(spark, [admit(1), admit(2), admit(3)], waiting=1)] == ["now", "queue", "overload"]


@pytest.mark.parametrize("most", [10_000, 0])
def test_the_best_worker_is_that_of_a_loop(spark, monkeypatch, most):
    monkeypatch.setattr(control, "BROADCAST", most)
    r = random.Random(3)
    workers = [(i, r.randint(0, 3), r.random() < 0.1, r.randint(1, 15), r.randint(1, 9) * 100, r.randint(1, 9) * 50, r.randint(0, 3), r.randint(0, 3)) for i in range(60)]
    requests = [(i, r.randint(0, 5), r.randint(1, 900), r.randint(0, 90), r.randint(1, 300), r.randint(0, 1)) for i in range(300)]
    w = spark.createDataFrame(workers, "worker_id long, state int, circuit_open boolean, model_mask long, prefill_rate long, decode_rate long, queue_depth long, active long")
    q = spark.createDataFrame(requests, "request_id long, model_id long, prompt_tokens long, cached_tokens long, completion_tokens long, deadline long")
    expected = set()
    for i, m, p, c, n, deadline in requests:
        scores = []
        for k, state, open_, mask, fast, slow, depth, active in workers:
            if state < 2 and not open_ and mask >> m & 1:
                pre, dec = max(0, p - c) * 1_000_000 // fast, n * 1_000_000 // slow
                scores.append(((pre + dec if deadline else 0) + (depth + active) * 1000, k, pre, dec))
        if scores:
            s, k, pre, dec = min(scores)
            expected.add((i, k, pre, dec, s))
    assert {tuple(x) for x in control.best_worker(q, w).collect()} == expected


def test_identities_and_tenants(spark):
    """Key 1 is current; key 2 follows, from a rotation at 1200 on for 30,000."""
    peers = spark.createDataFrame([("now", 1, 1, 100_000), ("next", 2, 1, 100_000), ("old", 0, 1, 100_000), ("early", 1, 1301, 100_000), ("last", 1, 1, 1300)], "name string, key_generation int, not_before long, not_after long")
    verdicts = lambda now, started: {r.name: r.v for r in peers.select("name", control.identity_verdict(F.lit(now), F.lit(1), F.lit(2 if started else 0), F.lit(started), F.lit(30_000)).alias("v")).collect()}
    assert verdicts(1300, 1200) == {"now": "valid", "next": "grace", "old": "stale key", "early": "outside its time", "last": "valid"}
    assert verdicts(31_201, 1200)["next"] == "out of grace" and verdicts(1000, 0)["next"] == "stale key"
    asked = spark.createDataFrame([("router", "route_request", 7, 7), ("router", "update_policy", 7, 7), ("router", "route_request", 7, 8), ("router", "route_request", 7, 0), ("admin", "update_policy", 1, 8), ("nobody", "read_page", 1, 1)], "role string, operation string, tenant long, resource_tenant long")
    out = {(r.role, r.operation, r.resource_tenant): r.allowed for r in control.authorized(asked, control.role_table(spark)).collect()}
    assert out == {("router", "route_request", 7): True, ("router", "update_policy", 7): False, ("router", "route_request", 8): False, ("router", "route_request", 0): True, ("admin", "update_policy", 8): True, ("nobody", "read_page", 1): False}
    config = spark.createDataFrame([(1,)], "current int")
    turns = spark.createDataFrame([(1, 2, 1200), (2, 1, 1300), (3, 0, 1400)], "seq_no int, following int, at int")
    assert tuple(control.rotated(config, turns).first()) == (1, 2, 1200) and tuple(control.rotated(config, turns.limit(0)).first()) == (1, 0, 0)


def test_untimely_tokens_are_no_sights(spark):
    rows_ = [(1, 10, 99, 1000, 55, 70_000), (2, 10, 99, 1000, 55, 1000), (3, 10, 99, 1000, 55, 1000), (4, 10, 99, 1000, 56, 1000), (5, 11, 99, 1000, 55, 1001), (6, 0, 99, 1000, 55, 1000), (7, 10, 98, 61_000, 55, 1000), (8, 10, 98, 61_001, 55, 1000)]
    tokens = spark.createDataFrame(rows_, "token_id long, peer long, nonce long, issued_at long, operation long, seen_at long")
    out = {r.token_id: r.verdict for r in control.fresh_tokens(tokens, 60_000).collect()}
    assert out == {1: "outside the window", 2: "accepted", 3: "replayed", 4: "accepted", 5: "accepted", 6: "invalid", 7: "accepted", 8: "outside the window"}


def test_digests_and_slots_are_those_of_a_loop(spark):
    m = (1 << 64) - 1

    def mix(v):
        v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 & m
        v = (v ^ v >> 27) * 0x94D049BB133111EB & m
        return v ^ v >> 31

    words, generation = [7, 11, 22, 4096, 33, 4, 12, 1 << 32 | 1], 1
    state = mix(hashes.DIGEST_START ^ generation)
    for k, w in enumerate(words):
        state = mix(state ^ w ^ k)
    digest = b"".join(mix(state ^ k * hashes.DIGEST_STEP & m).to_bytes(8, "little") for k in range(4)).hex()
    row = spark.range(1).select(hashes.digest32([F.lit(w) for w in words], F.lit(1)).alias("d"), hashes.replay_hash(*[F.lit(x) for x in (10, 99, 1000, 55)]).alias("r"), hashes.mixed_slot(F.lit(-5), 7, 42).alias("s")).first()
    assert row.d == digest and row.r & m == mix(10) ^ mix(99) ^ mix(1000) ^ mix(55) and row.s == mix((-5 & m) ^ 42) % 7
    assert spark.range(1).select(hashes.lease_token(F.lit(5), F.lit(-3), F.lit(9)).alias("t")).first().t == hashes.token_of(5, -3, 9)


def test_profiles_of_goals(spark):
    rows_ = [("longer-context", 90, 0, 1, 100), ("longer-context", 10, 0, 1, 100), ("more-users", 10, 0, 1, 100), ("balanced", None, 0, 1, 100), ("other", 10, 0, 1, 100)]
    df = spark.createDataFrame(rows_, "goal string, model long, context long, users long, vram long")
    out = df.select(hashes.recommended(*map(F.col, ("goal", "model", "context", "users", "vram"))).alias("r")).select("r.*").collect()
    assert [tuple(x) for x in out] == [("maximum-context", "high", "medium"), ("safe", "low", "medium"), ("high-concurrency", "low", "medium"), ("balanced", "unknown", "medium"), (None, "low", "medium")]


MARKS = "rel string, ttft double, inter_token double, leaked boolean, incorrect boolean, cuda_error boolean, contaminated boolean"


def test_release_candidate_verdicts(spark):
    r = spark.createDataFrame([("a", 125.0 + i, 40 + i / 2, False, False, False, False) for i in range(20)] + [(x, 1.0, 1.0, *[k == i for k in range(4)]) for i, x in enumerate("bcde")] + [("f", 1.0, 1.0, False, False, False, False), ("g", 1.0, 1.0, False, False, False, False), ("h", 1.0, 1.0, False, False, False, False)], MARKS)
    m = spark.createDataFrame([(x, 0, 1000, 1000) for x in "abcdefh"] + [("g", 0, 1000, 0), ("h", 1, 1000, 900)], "rel string, seq_no long, accounted long, observed long")
    u = spark.createDataFrame([("a", 0, 1, 0, 0, 0), ("a", 1, 0, 0, 0, 0), ("f", 0, 0, 0, 1, 0)], "rel string, seq_no long, page_refs long, snapshot_refs long, lease_refs long, request_refs long")
    out = evidence.rc1(r, m, {"ttft": 500, "token": 80, "memory": 0.05}, "rel", u)
    assert {x.rel: x.decision for x in out.collect()} == {"a": "PASS", "b": "FAIL", "c": "FAIL", "d": "FAIL", "e": "FAIL", "f": "FAIL", "g": "INCOMPLETE", "h": "FAIL"}


def test_service_levels_need_redaction_and_bounds(spark):
    rows_ = [(t, 1.0, 1.0, False, 5, 5, t == "leak", f"s{i if t == 'wide' else 0}") for t in ("good", "leak", "wide", "held") for i in range(4)]
    q = spark.createDataFrame(rows_, "tenant string, ttft double, per_token double, failed boolean, accounted long, observed long, prompt_present boolean, series string")
    refs = spark.createDataFrame([("held", 0, None, 1, 0)], "tenant string, page_refs long, snapshot_refs long, lease_refs long, request_refs long")
    out = evidence.slo(q, {"ttft": 2, "token": 2, "availability": 99, "samples": 4, "series": 3}, ["tenant"], refs)
    assert {r.tenant: r.passed for r in out.collect()} == {"good": True, "leak": False, "wide": False, "held": False}


def test_crossover_states(spark):
    fast, slow, wild = [90.0, 90.5, 91.0], [100.0, 100.0, 101.0], [50.0, 100.0, 150.0]
    rows_ = [("win", fast, slow, 1.0, 2.0, 0.0, None), ("parity", slow, slow, 1.0, 2.0, 0.0001, None), ("memory", fast, slow, 2.0, 2.0, 0.0, None), ("slow", [120.0] * 3, slow, 1.0, 2.0, 0.0, None), ("few", fast[:2], slow, 1.0, 2.0, 0.0, None), ("noise", wild, slow, 1.0, 2.0, 0.0, None), ("wrong", fast, slow, 1.0, 2.0, 0.001, None), ("loose", fast, slow, 1.0, 2.0, 0.001, 0.01), ("missing", fast, slow, None, 2.0, 0.0, None)]
    cases = spark.createDataFrame(rows_, "name string, compressed array<double>, dense array<double>, compressed_mib double, dense_mib double, max_error double, tolerance double")
    out = evidence.crossover(cases)
    assert {r["name"]: r.state for r in out.collect()} == {"win": "WIN", "parity": "PARITY", "memory": "NO_CROSSOVER", "slow": "NO_CROSSOVER", "few": "INCOMPLETE", "noise": "INCOMPLETE", "wrong": "INCOMPLETE", "loose": "WIN", "missing": "INCOMPLETE"}
    state = lambda names: evidence.overall(out.where(F.col("name").isin(names))).first().state
    assert [state(x) for x in (["win", "slow"], ["parity", "few"], ["few", "slow"], ["few", "noise"], ["none"])] == ["WIN", "PARITY", "NO_CROSSOVER", "INCOMPLETE", "INCOMPLETE"]


def test_a_zero_baseline_is_an_error(spark):
    with pytest.raises(Exception, match="baseline is zero"):
        spark.range(1).select(evidence.delta_percent(F.lit(0.0), F.lit(1.0))).collect()


@pytest.mark.parametrize("text", ["banana", "aaaaaaa", "a", "abcabcabcab"])
def test_long_suffix_arrays_sort_the_suffixes(spark, text):
    streams = {1: text, 2: text[::-1]}
    t = spark.createDataFrame([(s, i, c) for s, x in streams.items() for i, c in enumerate(x)], "stream_id long, pos long, sym string")
    got = sorted(map(tuple, search.suffix_array_long(t).collect()))
    assert got == sorted((s, k, i) for s, x in streams.items() for k, (_, i) in enumerate(sorted((x[i:], i) for i in range(len(x) + 1))))


def test_pages_overlap_across_buckets(spark):
    r = random.Random(6)
    pages = [(i, i % 2, 0, r.randint(0, 400), r.randint(1, 60)) for i in range(120)]
    df = spark.createDataFrame(pages, "page_id long, layer int, head int, begin long, n long")
    expected = {i for i, layer, _, b, n in pages if any(l2 == layer and (b2, j) < (b, i) and b2 + n2 > b for j, l2, _, b2, n2 in pages)}
    for span in (1, 7, 100, 1 << 16):
        assert {x.page_id for x in store.overlaps(df, span).collect()} == expected


def test_rules_find_fabricated_evidence(spark):
    docs = spark.createDataFrame([(1, "p95", "10"), (1, "ok", "true"), (2, "p95", "zero"), (3, "p95", "-1"), (3, "ok", "false")], "doc_id long, path string, value string")
    rules = spark.createDataFrame([("f", "p95", "number_min", "0"), ("f", "ok", "equals", "true")], "family string, path string, op string, operand string")
    assert rows(evidence.violations(docs, rules).select("doc_id", "path")) == [(2, "ok"), (2, "p95"), (3, "ok"), (3, "p95")]


def test_fnv_is_that_of_a_loop(spark):
    data = [b"", b"a", b"foobar", bytes(range(256)), None]
    df = spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in enumerate(data)], "i int, b binary")
    got = [r.h for r in df.select("i", hashes.fnv1a(F.col("b")).alias("h")).orderBy("i").collect()]
    assert got[-1] is None
    assert [g & 0xFFFFFFFFFFFFFFFF for g in got[:-1]] == [hashes.fnv1a_bytes(x) for x in data[:-1]]


@pytest.mark.parametrize("values", [[3], [1, 1, 1], [1, 2, 3, 4, 5, 1, 1, 1], list(range(200)), [0] * 500 + [9]])
def test_byte_codecs_are_lossless(values):
    lengths, data = bytecodes.huffman_encode(values)
    assert bytecodes.huffman_decode(lengths, data, len(values)) == values
    freq = bytecodes.frequencies(values)
    assert bytecodes.rans_decode(*bytecodes.rans_encode(values, freq), freq, len(values)) == values


def test_codes_are_these_bytes():
    """Worked out by hand: codes 0, 10, 11; states of frequencies a half; the second of the words with two ones."""
    lengths, data = bytecodes.huffman_encode([0, 0, 0, 1, 2])
    assert lengths == {0: 1, 1: 2, 2: 2} and data == bytes([0b00010110])
    assert bytecodes.rans_encode([0, 1], {0: 2048, 1: 2048}) == (8193 << 12, b"") and bytecodes.rans_encode([5], {5: 4096}) == (1 << 23, b"")
    assert [bytecodes.rrr_encode(w) for w in (0, 1, 0b10, 0b11, 0b101, 0b110, 0x7FFF, 1 << 14)] == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (15, 0), (1, 14)]


def test_bit_blocks_are_ranked_without_gaps():
    words = [w for w in range(1 << bytecodes.RRR_BLOCK) if w.bit_count() == 4]
    assert sorted(bytecodes.rrr_encode(w)[1] for w in words) == list(range(len(words)))
    assert all(bytecodes.rrr_decode(*bytecodes.rrr_encode(w)) == w for w in words[::7])


def test_generators_are_deterministic(spark):
    one, two = (rows(generators.markov_runs(spark, 2, 50, 8, 1)) for _ in range(2))
    assert one == two and len(one) == 100 and all(0 <= s < 8 for *_, s in one)
    assert generators.markov_dirichlet(spark, 1, 20, 4).count() == 20
    base = spark.createDataFrame([(i, i % 5) for i in range(200)], "pos long, val int")
    delta = generators.near_copies(base, 3, 0.1, 5)
    assert 20 < delta.count() < 120 and delta.join(base, ["pos", "val"]).count() == 0
    assert generators.skewed_values(spark, 100, 0.5).count() == 100


def test_raw_dumps_come_back(spark, tmp_path):
    t = spark.createDataFrame([(1, i, i * i) for i in range(10)], "stream_id long, pos long, sym int")
    content = tables.raw_tokens(t).first().content
    (tmp_path / "a.bin").write_bytes(content)
    assert [r.sym for r in tables.read_raw_tokens(spark, str(tmp_path)).orderBy("pos").collect()] == [i * i for i in range(10)]


def test_page_store_keeps_the_newest_and_sees_damage(spark, tmp_path):
    s = tables.PageStore(spark, str(tmp_path / "store"))
    page = lambda g, k: spark.createDataFrame([(0, 0, 0, g, bytearray(k), bytearray(b"v"))], "layer int, head int, begin long, generation long, keys binary, values binary")
    s.put(page(1, b"old"))
    s.put(page(2, b"new"))
    assert s.counters().first().records == 2 and s.verify().count() == 0
    assert bytes(s.compact(str(tmp_path / "small")).open().first()["keys"]) == b"new"
    page(3, b"x").withColumn("checksum", F.lit("0")).write.mode("append").parquet(s.path)
    assert s.verify().count() == 1
    assert s.get(page(0, b"")).count() == 3


def test_evidence_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema": "v1", "role": "baseline", "fingerprint": {"model": "m", "runtime": "r", "hardware": "h", "workload": "w"}, "metrics": {"throughput": 1.0, "p95": 2.0, "correctness": True}}))
    (tmp_path / "b.json").write_text(json.dumps({"schema": "v1", "role": "baseline", "fingerprint": {}, "metrics": {}}))
    assert sorted(len(r.missing) for r in tables.read_evidence(spark, str(tmp_path)).collect()) == [0, 7]


def test_sessions_and_runs(spark, tmp_path):
    run = {"schema": "v", "role": "x", "fingerprint": {"model": "m"}, "metrics": {"p95": 1.0}}
    (tmp_path / "s.json").write_text(json.dumps({"session_id": "s", "baseline_runs": [run] * 3, "candidate_runs": [run] * 2}))
    assert tables.read_session(spark, str(tmp_path / "s.json")).groupBy("role").count().count() == 2
    (tmp_path / "r.json").write_text(json.dumps({"logits": [{"values": [0.1, 0.9], "top1": 1}]}))
    assert tables.read_run(spark, str(tmp_path / "r.json")).count() == 2


def test_markdown_tables(spark):
    out = tables.markdown_lines(spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string")).orderBy("at").collect()
    assert [r.value for r in out] == ["| n | t |", "|-|-|", "| 1 | a b |", "| 2 |  |"]


def test_text_sinks(spark):
    df = spark.createDataFrame([("a", 1.5)], "model string, p95 double")
    assert tables.prometheus_lines(df, "latency", ["model"], "p95").first().value == 'latency{model="a"} 1.5'
    assert json.loads(tables.json_lines(df).first().value) == {"model": "a", "p95": 1.5}
    assert tables.with_defaults(df.select("model"), {"p95": 3.0}).first().p95 == 3.0


def test_mixing_is_that_of_a_loop(spark):
    def mix(v):
        m = 0xFFFFFFFFFFFFFFFF
        v &= m
        v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 & m
        v = (v ^ v >> 27) * 0x94D049BB133111EB & m
        return v ^ v >> 31

    data = [0, 1, -1, 2**62, -(2**63)]
    df = spark.createDataFrame([(x,) for x in data], "x long").select("x", hashes.mix64(F.col("x")).alias("h"))
    assert {r.x: r.h & 0xFFFFFFFFFFFFFFFF for r in df.collect()} == {x: mix(x) for x in data}
