"""64-bit wrapping hashes as Arrow-batched functions; ANSI arithmetic refuses to wrap, numpy does not."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of FNV-1a with 64 bits.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211


def fnv1a_bytes(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a(column: Column) -> Column:
    """[P31] FNV-1a of a binary column, as a signed 64-bit number: all rows of a batch advance together, byte by byte."""

    @F.pandas_udf("long")
    def run(data: pd.Series) -> pd.Series:
        length = data.map(lambda b: -1 if b is None else len(b)).to_numpy()
        order = np.argsort(-length, kind="stable")
        rows = [data.iat[i] or b"" for i in order]
        size = np.maximum(length[order], 0)
        flat, at = np.frombuffer(b"".join(rows), np.uint8).astype(np.uint64), np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        h = np.full(len(rows), FNV_OFFSET, np.uint64)
        for k in range(int(size.max()) if len(size) else 0):
            n = int(np.searchsorted(-size, -k, side="left"))
            h[:n] = (h[:n] ^ flat[at[:n] + k]) * np.uint64(FNV_PRIME)
        out = np.empty(len(rows), np.uint64)
        out[order] = h
        return pd.Series(pd.arrays.IntegerArray(out.view(np.int64), length < 0))

    return run(column)


#: Fixed values of the 64-bit finaliser.
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_U = np.uint64


def mixed(v: np.ndarray) -> np.ndarray:
    """The finaliser of unsigned 64-bit numbers."""
    v = (v ^ (v >> _U(30))) * _U(MIX_1)
    v = (v ^ (v >> _U(27))) * _U(MIX_2)
    return v ^ (v >> _U(31))


def _unsigned(x: pd.Series) -> np.ndarray:
    return x.fillna(0).to_numpy(np.int64).view(np.uint64)


def mix64(column: Column) -> Column:
    """[P32] A finaliser of 64-bit numbers, as a signed number."""

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(pd.arrays.IntegerArray(mixed(_unsigned(x)).view(np.int64), x.isna().to_numpy()))

    return run(column)


def mixed_slot(column: Column, slots: int, seed: int = 0) -> Column:
    """[P32, T21] The slot of an id among so many: the unsigned remainder of its mixed hash, after a seed is folded in."""

    @F.pandas_udf("int")
    def run(x: pd.Series) -> pd.Series:
        slot = mixed(_unsigned(x) ^ _U(seed)) % _U(slots)
        return pd.Series(pd.arrays.IntegerArray(slot.astype(np.int32), x.isna().to_numpy()))

    return run(column)


#: Fixed values of the digest: what its state begins with, and what parts its four words.
DIGEST_START, DIGEST_STEP = 0x4348524F4D4F464F, 0x9E3779B97F4A7C15


def digest32(words: list[Column], generation: Column) -> Column:
    """[P33] 32 bytes (hex) of integer words under a key generation: each word is mixed into the state with its place, then four words are drawn."""

    @F.pandas_udf("string")
    def run(generation: pd.Series, *words: pd.Series) -> pd.Series:
        state = mixed(_unsigned(generation) ^ _U(DIGEST_START))
        for k, w in enumerate(words):
            state = mixed(state ^ _unsigned(w) ^ _U(k))
        out = np.stack([mixed(state ^ _U(k * DIGEST_STEP & 0xFFFFFFFFFFFFFFFF)) for k in range(4)], 1)
        return pd.Series([row.tobytes().hex() for row in out.astype("<u8")])

    return run(generation, *words)


def replay_hash(*fields: Column) -> Column:
    """[P33] The hash that names a token: its mixed fields, folded together."""

    @F.pandas_udf("long")
    def run(*fields: pd.Series) -> pd.Series:
        out = np.zeros(len(fields[0]), np.uint64)
        for x in fields:
            out ^= mixed(_unsigned(x))
        return pd.Series(out.view(np.int64))

    return run(*fields)


def lease_token(page_hash: Column, owner: Column, generation: Column) -> Column:
    """[P35] 32 bytes (hex) drawn by xorshift from a page's hash, its owner and the lease's generation."""

    @F.pandas_udf("string")
    def run(page: pd.Series, owner: pd.Series, generation: pd.Series) -> pd.Series:
        seed = _unsigned(page) ^ _unsigned(owner) ^ _unsigned(generation) * _U(DIGEST_STEP)
        out = np.empty((len(seed), 32), np.uint8)
        for k in range(32):
            seed = seed ^ (seed >> _U(12))
            seed = seed ^ (seed << _U(25))
            seed = seed ^ (seed >> _U(27))
            out[:, k] = seed.astype(np.uint8)
        return pd.Series([row.tobytes().hex() for row in out])

    return run(page_hash, owner, generation)


def token_of(page: int, owner: int, generation: int) -> str:
    """[P35] One lease's token."""
    m, out = 0xFFFFFFFFFFFFFFFF, bytearray()
    seed = (page ^ owner ^ generation * DIGEST_STEP) & m
    for _ in range(32):
        seed ^= seed >> 12
        seed = (seed ^ seed << 25) & m
        seed ^= seed >> 27
        out.append(seed & 255)
    return out.hex()


def page_checksum(keys: Column, values: Column) -> Column:
    """One digest of both payloads in order, so that swapped or equal payloads are told apart."""
    return F.sha2(F.concat(F.sha2(keys, 256), F.lit("|"), F.sha2(values, 256)), 256)


#: The names of error codes from 0 on.
ERRORS = ("none", "admission_quota", "admission_overload", "worker_unavailable", "transfer_auth", "transfer_integrity", "lease_stale", "checkpoint_incompatible", "cuda_oom", "cuda_runtime", "release_incompatible")


def error_name(code: Column) -> Column:
    """[P40]"""
    return F.coalesce(F.get(F.array(*[F.lit(e) for e in ERRORS]), code), F.lit("unknown"))


def layer_of(name: Column) -> Column:
    """[P49] The number at the end of a tensor's name; null without one."""
    return F.when(name.rlike(r"-\d+$"), F.regexp_extract(name, r"-(\d+)$", 1).cast("int"))


def safe_version(version: Column) -> Column:
    """[P52] Runs of anything but letters, digits, dots, underscores and dashes are one dash; none of these at the ends. Null where nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.trim(version), r"[^A-Za-z0-9._\-]+", "-"), r"^[.\-_]+|[.\-_]+$", ""), F.lit(""))


def redacted(text: Column) -> Column:
    """[P47] Key-like assignments and long hex runs masked."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)((?:token|secret|password|api[_-]?key)\"?\s*[:=]\s*\"?)[^\",\s}]+", "$1***"), r"\b[0-9a-fA-F]{32,}\b", "***")


def pressure(used: Column, total: Column) -> Column:
    """[P48] How full memory is; `unknown` without numbers."""
    share = F.try_divide(used, total)
    return F.when(share > 0.95, "critical").when(share > 0.75, "high").when(share > 0.5, "moderate").when(share.isNotNull(), "low").otherwise("unknown")


#: The profile of each goal, the goals that keep theirs when memory is free, and the profile of low pressure.
PROFILES = {"longer-context": "maximum-context", "more-users": "high-concurrency", "shared-prefix": "shared-prefix", "lowest-risk": "safe", "balanced": "balanced"}
KEPT_GOALS, LOW_PROFILE, KV_BYTES = ("shared-prefix", "more-users"), "safe", 256 * 1024


def recommended(goal: Column, model_bytes: Column, context: Column, concurrency: Column, vram: Column) -> Column:
    """[P48, E1] The profile of a goal and the pressure that a model and its estimated history put on memory; null for an unknown goal."""
    known = (F.coalesce(model_bytes, F.lit(0)) > 0) & (F.coalesce(vram, F.lit(0)) > 0)
    need = model_bytes + F.greatest(F.lit(0).cast("long"), context * concurrency * KV_BYTES)
    level = F.when(known, pressure(need.cast("double"), vram.cast("double"))).otherwise("unknown")
    own = F.try_element_at(F.create_map(*[F.lit(x) for kv in PROFILES.items() for x in kv]), goal)
    profile = F.when((level == "low") & own.isNotNull() & ~goal.isin(*KEPT_GOALS), LOW_PROFILE).otherwise(own)
    return F.struct(profile.alias("profile"), level.alias("pressure"), F.when(F.coalesce(vram, F.lit(0)) > 0, "medium").otherwise("low").alias("confidence"))


def checked_add(a: Column, b: Column) -> Column:
    """[P43] Null where the sum does not fit."""
    return F.try_add(a, b)


def checked_multiply(a: Column, b: Column) -> Column:
    """[P43] Null where the product does not fit."""
    return F.try_multiply(a, b)
