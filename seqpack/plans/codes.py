"""Queries on hashes and byte codecs; round trips are held against their source."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqpack.functions import bytecodes, hashes
from seqpack.operators import succinct
from seqpack.plans import bindings as B
from seqpack.plans.registry import query

SOURCE = f"with {B.CODED} select stream_id, pos, sym from coded"


@query("huffman_roundtrip", SOURCE)
def huffman_roundtrip(spark, d):
    """[P11, P12, P14, P19, P20] Streams packed in Huffman blocks and unpacked."""
    return bytecodes.unpacked(bytecodes.packed(B.coded_events(spark, d), "huffman"), "huffman")


@query("rans_roundtrip", SOURCE)
def rans_roundtrip(spark, d):
    """[P13] The same in rANS blocks."""
    return bytecodes.unpacked(bytecodes.packed(B.coded_events(spark, d), "rans"), "rans")


@query("rrr_roundtrip", f"with {B.CODED} select stream_id, pos, (sym & 1)::int as bit from coded")
def rrr_roundtrip(spark, d):
    """[P5, P6, P7, P8] The lowest plane in class and offset blocks."""
    low = succinct.bit_planes(B.coded_events(spark, d), 3).where("plane = 2").select("stream_id", "pos", "bit")
    return bytecodes.rrr_unpacked(bytecodes.rrr_packed(low))


@query("rrr_rank1", f"with {B.CODED} select stream_id, count(*) as n, sum(sym & 1)::bigint as ones from coded group by all")
def rrr_rank1(spark, d):
    """[A4, P5] Ones of a plane from block classes alone, without decoding offsets."""
    low = succinct.bit_planes(B.coded_events(spark, d), 3).where("plane = 2").select("stream_id", "pos", "bit")
    return bytecodes.rrr_packed(low).groupBy("stream_id").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))


#: An unsigned 64-bit number as a signed one, in SQL.
_SIGNED = "case when {0} >= 9223372036854775808 then {0}::hugeint - 18446744073709551616 else {0}::hugeint end"


@query("fnv_hashes", f"with b as (select p_partkey, list_transform(string_split(p_name, ''), lambda c: ord(c)::uhugeint) as b from part), h as (select p_partkey, list_reduce(list_prepend({hashes.FNV_OFFSET}::uhugeint, b), lambda h, x: (xor(h, x) * {hashes.FNV_PRIME}::uhugeint) % {1 << 64}::uhugeint) as h from b) select p_partkey, ({_SIGNED.format('h')})::bigint as hash from h")
def fnv_hashes(spark, d):
    """[P31] Wrapping hashes of names."""
    return B.table(spark, d, "part").select("p_partkey", hashes.fnv1a(F.encode("p_name", "UTF-8")).alias("hash"))


SEED = 42


@query("mixed_placement", f"with o as (select o_orderkey, xor(o_orderkey::uhugeint, {SEED}::uhugeint) as v from orders), {B.mixed_sql('o', ['v'])} select o_orderkey, (m_v % 25)::int as device from mixed")
def mixed_placement(spark, d):
    """[P32, T21] Orders dealt to 25 devices by the unsigned remainder of a mixed hash."""
    return B.table(spark, d, "orders").select("o_orderkey", hashes.mixed_slot(F.col("o_orderkey"), 25, SEED).alias("device"))


_GOAL = "['longer-context', 'more-users', 'shared-prefix', 'lowest-risk', 'balanced'][s_suppkey % 5 + 1]"


@query("profile_choice", f"with g as (select s_suppkey, {_GOAL} as goal, greatest(0, floor(s_acctbal)::bigint) * 1000000 as model_bytes, 1000 * (s_suppkey % 7) as context, s_suppkey % 3 as users, case when s_suppkey % 11 = 0 then 0 else 8000000000 end as vram from supplier), r as (select *, case when model_bytes > 0 and vram > 0 then (model_bytes + context * users * 262144) / vram end as ratio from g), l as (select *, case when ratio is null then 'unknown' when ratio > 0.95 then 'critical' when ratio > 0.75 then 'high' when ratio > 0.5 then 'moderate' else 'low' end as pressure from r) select s_suppkey, pressure, case when pressure = 'low' and goal not in ('shared-prefix', 'more-users') then 'safe' else case goal when 'longer-context' then 'maximum-context' when 'more-users' then 'high-concurrency' when 'shared-prefix' then 'shared-prefix' when 'lowest-risk' then 'safe' else 'balanced' end end as profile, case when vram > 0 then 'medium' else 'low' end as confidence from l")
def profile_choice(spark, d):
    """[P48, E1] The profile of a goal under the memory pressure of a model and its history."""
    goals = F.array(*[F.lit(g) for g in ("longer-context", "more-users", "shared-prefix", "lowest-risk", "balanced")])
    s = B.table(spark, d, "supplier").selectExpr("s_suppkey", "greatest(0L, floor(s_acctbal)) * 1000000 as model_bytes", "1000 * (s_suppkey % 7) as context", "s_suppkey % 3 as users", "if(s_suppkey % 11 = 0, 0L, 8000000000L) as vram")
    r = hashes.recommended(F.get(goals, (F.col("s_suppkey") % 5).cast("int")), F.col("model_bytes"), F.col("context"), F.col("users"), F.col("vram"))
    return s.select("s_suppkey", r.alias("r")).select("s_suppkey", "r.pressure", "r.profile", "r.confidence")


@query("safe_versions", "select p_partkey, regexp_replace(regexp_replace(trim(p_type || ' (v)'), '[^A-Za-z0-9._\\-]+', '-', 'g'), '^[.\\-_]+|[.\\-_]+$', '', 'g') as version from part")
def safe_versions(spark, d):
    """[P52] Names that are safe in paths."""
    return B.table(spark, d, "part").select("p_partkey", hashes.safe_version(F.concat("p_type", F.lit(" (v)"))).alias("version"))


@query("pressure_profiles", "select s_suppkey, case when s_acctbal / 10000 > 0.95 then 'critical' when s_acctbal / 10000 > 0.75 then 'high' when s_acctbal / 10000 > 0.5 then 'moderate' else 'low' end as pressure from supplier")
def pressure_profiles(spark, d):
    """[P48] Buckets of memory pressure."""
    return B.table(spark, d, "supplier").select("s_suppkey", hashes.pressure(F.col("s_acctbal"), F.lit(10000.0)).alias("pressure"))


@query("error_names", "select event_id, coalesce(['none', 'admission_quota', 'admission_overload', 'worker_unavailable', 'transfer_auth', 'transfer_integrity', 'lease_stale', 'checkpoint_incompatible', 'cuda_oom', 'cuda_runtime', 'release_incompatible'][event_id % 13 + 1], 'unknown') as name from events")
def error_names(spark, d):
    """[P40] Names of error codes."""
    return B.table(spark, d, "events").select("event_id", hashes.error_name((F.col("event_id") % 13).cast("int")).alias("name"))


@query("layer_names", "select s_suppkey, case when s_suppkey % 3 > 0 then s_suppkey::int end as layer from supplier")
def layer_names(spark, d):
    """[P49] Layer numbers out of tensor names."""
    name = F.concat(F.lit("Kcur"), F.when(F.col("s_suppkey") % 3 > 0, "-").otherwise(":"), F.col("s_suppkey").cast("string"))
    return B.table(spark, d, "supplier").select("s_suppkey", hashes.layer_of(name).alias("layer"))


@query("canonical_digests", "select n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}') as digest from nation")
def canonical_digests(spark, d):
    """[P51] Digests of rows as canonical JSON."""
    return B.table(spark, d, "nation").select("n_nationkey", F.sha2(F.to_json(F.struct("n_name", "n_regionkey")), 256).alias("digest"))
