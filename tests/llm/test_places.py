"""Neighbours and shards: brute force, ties, odd rows."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqpack.llm import ann, sharding


def brute(rows, k=ann.K):
    sound = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and len(v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {}
    for q, x in {i: v for i, v in sound if i % 100 == 0}.items():
        near = sorted((float(ann.distances(x, v[None])[0]), i) for i, v in sound if i != q and len(v) == len(x))[:k]
        out[q] = [(n + 1, i, d) for n, (d, i) in enumerate(near)]
    return out


@pytest.mark.parametrize("scale", [1e-300, 1e-160, 1e-3, 1.0, 1e3, 1e12, 1e160, 1e300])
def test_neighbours_are_those_of_a_loop(spark, scale):
    g = np.random.default_rng(1)
    x = g.normal(size=(700, 16)) * scale
    x[50:120] = x[3]  # ties with a query's neighbours
    x[200] = x[3]
    x[300:340] = x[0] + g.normal(size=(40, 16)) * 1e-4 * scale
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, [1.0, 2.0]), (5001, [2.0, 1.0]), (700, None), (800, [0.0] * 16), (900, [float("nan")] + [1.0] * 15), (1000, [None] + [1.0] * 15), (None, [1.0] * 16), (1100, [float("inf")] * 16), (1200, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = defaultdict(list)
    for r in ann.nearest(df).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(v) for q, v in got.items()} == brute(rows)
    assert ann.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e8, 1e160])
def test_neighbours_of_sign_vectors(spark, scale):
    """Quantisation errs by nothing here, and distances are small beside the vectors' lengths."""
    g = np.random.default_rng(3)
    x = np.sign(g.normal(size=(200, 16))) * scale
    x[1::2] = x[::2] * (1 + 1e-9 * g.normal(size=(100, 16)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(v) for q, v in got.items()} == brute(rows)
    assert all(np.isfinite(d) and d > 0 for v in got.values() for _, _, d in v)


def test_lengths_of_all_sizes_in_one_tile(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(300, 8)) * 10.0 ** g.integers(-300, 300, size=(300, 1))
    x[101:110] = x[100] * (1 + 1e-12 * g.normal(size=(9, 8)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(v) for q, v in got.items()} == brute(rows)


def test_the_error_bound_holds():
    g = np.random.default_rng(2)
    q, r = g.normal(size=(20, 32)), g.normal(size=(300, 32))
    best = np.full(20, np.inf)
    left = ann.survivors(ann.quantised(q), ann.quantised(r), 5, best, np.zeros((20, 300), bool))
    for i in range(20):
        nearest = np.argsort(ann.distances(q[i], r))[:5]
        assert left[i, nearest].all() and left[i].sum() < 60


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3)])
def test_the_curve_steps_to_neighbours(spark, n, bits):
    side = 1 << bits
    cells = spark.range(side**n).select(*[F.expr(f"id div {side**k} % {side}").alias(f"c{k}") for k in range(n)])
    out = cells.select("*", sharding.hilbert_index([F.col(f"c{k}") for k in range(n)], bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in out] == list(range(side**n))
    assert all(sum(abs(a[k] - b[k]) for k in range(n)) == 1 for a, b in zip(out, out[1:], strict=False))


def check_shards(out, rows, shards=sharding.SHARDS):
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    counts = [len(slots.get(k, [])) for k in range(shards)]
    assert sum(counts) == rows and max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(r.law == "rows" and r.grown_shard is None for r in out)


def test_shards_of_odd_rows(spark, odd_docs, no_docs):
    out = sharding.shard(odd_docs).collect()
    check_shards(out, odd_docs.count())
    expected = sorted((len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in odd_docs.select("text").collect())
    assert sorted((r.size, r.text_crc32) for r in out) == expected
    assert sharding.shard(no_docs).count() == 0


def plain_index(x, bits):
    """The Hilbert index of a point: axes to transposed index to number, one integer at a time."""
    x, n = list(x), len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    return sum(((x[i] ^ t) >> b & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))


def test_shards_are_those_of_a_loop(spark):
    import xxhash

    docs = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    rows, points, group = [], {}, {}
    for k, r in enumerate(docs):
        size, lang = len((r.text or "").encode()) + 16, (r.lang or "").lower()
        letter = [max(0, min(25, ord(lang[k : k + 1] or "\0") - 97)) for k in (0, 1)]
        source = (xxhash.xxh64_intdigest((r.source or "").encode(), seed=42) + (1 << 63)) % (1 << 64) - (1 << 63)
        points[k] = ((letter[0] * 26 + letter[1]) >> 3, source % 128, min(127, math.floor(math.log2(size) * 8 - 32)))
        group[r.text] = min(group.get(r.text, points[k]), points[k])
    for r in docs:
        rows.append((plain_index(group[r.text], 7), zlib.crc32((r.text or "").encode()), r.doc_id, len((r.text or "").encode()) + 16))
    rows.sort()
    least, longer = divmod(len(rows), 40)
    expected, at = [], 0
    for shard in range(40):
        n = least + (shard < longer)
        expected += [(doc, size, crc, "rows", shard, slot, None) for slot, (_, crc, doc, size) in enumerate(rows[at : at + n])]
        at += n
    got = sharding.op8_hilbert_shards(spark, "/root/testdata/sf0.01").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_equal_texts_are_neighbours(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id % 700)) as text", "if(id % 2 = 0, 'en', 'fr') as lang", "concat('s', id % 5) as source")
    out = sharding.shard(docs).collect()
    check_shards(out, 3000)
    texts = [r.text_crc32 for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert sum(a != b for a, b in zip(texts, texts[1:], strict=False)) == len(set(texts)) - 1


def test_equal_rows_are_dealt_to_several_tasks(spark):
    docs = spark.range(4000).selectExpr("cast(7 as long) as doc_id", "'same' as text", "'en' as lang", "'s' as source")
    out = sharding.shard(docs)
    check_shards(out.collect(), 4000)


def test_shards_are_runs_of_the_curve(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "repeat('x', cast(id % 300 as int)) as text", "if(id % 2 = 0, 'en', 'fr') as lang", "concat('s', id % 5) as source")
    out = sharding.shard(docs).collect()
    check_shards(out, 1000)
    by = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.h for r in by] == sorted(r.h for r in out)


def test_shards_are_written(spark, tmp_path):
    docs = spark.range(100).selectExpr("id as doc_id", "concat('t', id) as text", "'en' as lang", "'s' as source")
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [25] * 4
