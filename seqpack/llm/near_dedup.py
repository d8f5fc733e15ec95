"""Operator 2, near-duplicate documents by MinHash.

A text's set holds its distinct word shingles (of 5 words, A-Z folded; a text with fewer words has its whole sequence as one).
Sketches are made by fast similarity sketching: in round r every element throws its hash of that round into one of t
coordinates, first at random, from round t on into coordinate r - t alone, so that after 2t rounds at most none is empty;
a coordinate keeps its least (round, hash). Runs of coordinates are banded into bucket keys.

No pairs are listed. In a first pass every bucket's sets are compared whole with its least set: sets near that one meet in chunks
of bounded size. Buckets whose sets are all linked with it are done, which those of true copies are mostly. The sets of the other
buckets, directly or through shared ones, form families. A family's sets are dealt to blocks of bounded size, those linked with
one set, if they are many, to blocks of their own; every two blocks meet but those of one such star. Inside a task every two sets
of different stars that share a key and fit in size are compared whole. So any two sets that share a bucket are linked through
others or were compared. Links of both passes are closed to components, which are the classes.

Defined results: null or empty text: empty set, linked with nothing. Equal sets form one class whatever doc_id they carry; rows
that repeat a doc_id keep a row each. A null doc_id never names a component unless all of its members lack one. Extra columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqpack.llm import common
from seqpack.llm.common import U64, cut, mix

#: A pair at the threshold PERCENT meets in a bucket but for 4 in 100,000.
SHINGLE, BANDS, ROWS = 5, 32, 8
COORDINATES = BANDS * ROWS
PERCENT = 85
#: Bands and rows for lower thresholds, down to LEAST: there a pair at 80 is missed as seldom.
LEAST, LOW_BANDS, LOW_ROWS = 80, 34, 6
#: Sets, and shingles of them, in one block of a family.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1_500_000
_PLACES = mix(np.arange(101, 101 + 64, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    starts, ends, first = common.words(data, offsets)
    hashes = common.span_hashes(data, starts, ends)
    whole = np.zeros(max(0, len(hashes) - size + 1), U64)
    for k in range(size):
        whole += hashes[k : k + len(whole)] * _PLACES[k]
    whole = mix(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            out.append(mix(np.array([(hashes[a:b] * _PLACES[: b - a]).sum() + U64(b - a)], U64)))
        else:
            out.append(hashes[:0])
    return out


def sketch(elements: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The fast similarity sketch of a non-empty set: t values, the round in the top ten bits: up to 512 coordinates, no later round is less than an earlier one."""
    out, low, done, n = np.full(t, np.iinfo(U64).max, U64), U64((1 << 54) - 1), 0, len(elements)
    while done < 2 * t:
        rounds = np.arange(done, min(2 * t, done + max(1, math.ceil(1.3 * t * math.log(t) / n))), dtype=U64)
        if done < t:
            rounds = rounds[rounds < t]
        thrown = mix(elements[None, :] ^ mix((rounds + U64(1)) * U64(0xD1342543DE82EF95))[:, None])
        value = (thrown & low) | (rounds << U64(54))[:, None]
        if done < t:
            np.minimum.at(out, ((thrown >> U64(40)) * U64(t) >> U64(24)).astype(np.intp).ravel(), value.ravel())
        else:
            at = (rounds - U64(t)).astype(np.intp)
            out[at] = np.minimum(out[at], value.min(axis=1))
        done += len(rounds)
        if out.max() != np.iinfo(U64).max:
            break
    return out


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows that a threshold takes."""
    if percent < LEAST:
        raise ValueError(f"percent below {LEAST}")
    return (BANDS, ROWS) if percent >= PERCENT else (LOW_BANDS, LOW_ROWS)


def bucket_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = values.reshape(-1, rows)
    key = np.arange(1, len(bands) + 1, dtype=U64) * U64(0xA24BAED4963EE407)
    for k in range(rows):
        key = mix(key + bands[:, k])
    return key.view(np.int64)


def _name(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return np.array([mix(s).sum() + U64(len(s)), mix(s ^ U64(0x6A09E667F3BCC909)).sum()], U64).tobytes()


def _sketched(batches, percent):
    bands, rows = banding(percent)
    for b in common.slices(batches, "text"):
        sets = shingle_sets(*common.raw(b.column("text")))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_name(s) if len(s) else None for s in sets], pa.binary()), pa.array([bucket_keys(sketch(s, bands * rows), rows) if len(s) else None for s in sets], pa.list_(pa.int64()))],
            ["doc_id", "text_key", "n_shingles", "node", "keys"],
        )


def _with_sets(batches):
    for b in common.slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("keys"), pa.array([s.tobytes() for s in shingle_sets(*common.raw(b.column("text")))], pa.binary())], ["node", "keys", "elements"])


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the least node of its component. Least labels spread over edges, then jump."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct().select("a", F.col("b").alias("node")))
    hubs = common.hot_keys(both, "node")
    labels = cut(both.groupBy("a").agg(F.least(F.first("a"), F.min("node")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        offered = common.spread_join(both, labels, "node", hubs).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer"))
        spread = cut(labels.join(offered, "node").select("node", F.least("label", "offer").alias("label"), (F.col("offer") < F.col("label")).alias("moved")))
        if not spread.where("moved").limit(1).count():
            return spread.select("node", "label")
        upper = spread.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        labels = spread.join(upper, "label").select("node", F.least("label", "higher").alias("label"))


def linked(sets: list[np.ndarray], keys: np.ndarray, side: np.ndarray, percent: int = PERCENT, classes: list | None = None) -> list[tuple[int, int]]:
    """Links that join all sets of a class, over links of two sets that share a key and stand on different sides, or both on side 2; sets of one of classes are joined before."""
    root, size, out = list(range(len(sets))), np.array([len(s) for s in sets]), []

    def top(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    first: dict = {}
    for i, c in enumerate(classes or ()):
        root[i] = first.setdefault(c, i)
    order = np.argsort(size, kind="stable")
    size, keys, side = size[order], keys[order], side[order]
    ends = np.searchsorted(size * percent, size * 100, side="right")
    for x, end in enumerate(ends.tolist()):
        near = x + 1 + np.flatnonzero((keys[x + 1 : end] == keys[x]).any(axis=1) & ((side[x + 1 : end] != side[x]) | (side[x] == 2)))
        i = int(order[x])
        for j in order[near].tolist():
            a, b = top(i), top(j)
            if a != b and alike(sets[i], sets[j], percent):
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _links(rows: list[tuple], percent: int) -> tuple[list, list]:
    """Links (a, b) of a group of rows (node, side, keys, label, elements)."""
    found = linked([np.frombuffer(r[4], U64) for r in rows], np.array([r[2] for r in rows]), np.array([r[1] for r in rows]), percent, [r[3] for r in rows])
    return [rows[i][0] for i, _ in found], [rows[j][0] for _, j in found]


def _linked(batches, percent):
    """Rows come sorted by group; each group is one task's block, or pair of blocks."""
    group, rows = None, []
    for b in batches:
        out: tuple[list, list] = ([], [])
        for own, *row in zip(*(b.column(c).to_pylist() for c in ("group", "node", "side", "keys", "label", "elements")), strict=True):
            if own != group:
                if len(rows) > 1:
                    for x, y in zip(out, _links(rows, percent), strict=True):
                        x += y
                group, rows = own, []
            rows.append(row)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], ["a", "b"])
    if len(rows) > 1:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in _links(rows, percent)], ["a", "b"])


def _compared(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside the groups of dealt (group, node, side, label), by full sets (node, keys, elements)."""
    together = dealt.join(sets, "node").select("group", "node", "side", "keys", "label", "elements").repartition("group").sortWithinPartitions("group", "node")
    return together.mapInArrow(partial(_linked, percent=percent), "a binary, b binary")


def _blocks(count: str, total: str) -> Column:
    """How many blocks so many sets with so many shingles take."""
    return F.greatest(F.ceil(F.col(count) / F.lit(BLOCK_SETS)), F.ceil(F.col(total) / F.lit(BLOCK_SHINGLES))).cast("int")


def _stars(edges: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the edges (a, node): each a meets its nodes in chunks."""
    sized = cut(edges.join(nodes.select("node", "n"), "node"))
    chunks = cut(sized.groupBy("a").agg(F.count("*").alias("c"), F.sum("n").alias("s")).select("a", _blocks("c", "s").alias("k")))
    near = common.spread_join(sized, chunks, "a", common.hot_keys(sized, "a")).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    near = near.select(F.struct("a", "chunk").alias("group"), "node", F.lit(1).alias("side"), F.col("node").alias("label"))
    hubs = chunks.select(F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("chunk"))
    hubs = hubs.select(F.struct(F.col("node").alias("a"), "chunk").alias("group"), "node", F.lit(0).alias("side"), F.col("node").alias("label"))
    return _compared(near.unionByName(hubs), sets, percent)


def _families(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the members (family, node, n, label) of each family but those within a label."""
    size = families.groupBy("family", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    size = size.withColumn("apart", (F.col("c") * 2 >= BLOCK_SETS) | (F.col("s") * 2 >= BLOCK_SHINGLES)).withColumn("own", F.when(F.col("apart"), F.col("label")).otherwise(F.lit(b"")))
    size = cut(size)
    blocks = cut(size.groupBy("family", "own").agg(F.sum("c").alias("c"), F.sum("s").alias("s")).select("family", "own", _blocks("c", "s").alias("k")))
    place = size.select("family", "label", "own").join(blocks.select("family", "own", "k"), ["family", "own"])
    placed = cut(families.join(place, ["family", "label"]).withColumn("block", F.struct("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int").alias("i"))).select("family", "node", "label", "block"))
    each = blocks.select("family", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i")).select("family", F.struct("own", "i").alias("block"))
    one, two = each.select("family", F.col("block").alias("p")), each.select("family", F.col("block").alias("q"))
    same = (F.col("p.own") != F.lit(b"")) & (F.col("q.own") == F.col("p.own"))
    pairs = cut(one.join(two, "family").where((F.col("p") <= F.col("q")) & ~same))
    group = F.struct("family", "p", "q").alias("group")
    alone = pairs.where("p = q").select("family", F.col("p").alias("block"), group, F.lit(2).alias("side"))
    left = pairs.where("p < q").select("family", F.col("p").alias("block"), group, F.lit(0).alias("side"))
    right = pairs.where("p < q").select("family", F.col("q").alias("block"), group, F.lit(1).alias("side"))
    dealt = placed.join(alone.unionByName(left).unionByName(right), ["family", "block"]).select("group", "node", "side", "label")
    return _compared(dealt, sets, percent)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class binary, text_key) for each row of docs (doc_id, text, ...).

    class names the component (null for empty sets): its rows are near-duplicates of one another, by links of at least percent. text_key is a checksum of the text.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    seen = cut(keyed.mapInArrow(partial(_sketched, percent=percent), "doc_id long, text_key long, n_shingles long, node binary, keys array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "n_shingles", "keys")).alias("m")
    nodes = cut(seen.where("node is not null").groupBy("node").agg(first).select("node", "m.doc_id", "m.text_key", F.col("m.n_shingles").alias("n"), "m.keys"))
    members = cut(nodes.select("node", F.explode("keys").alias("key")))
    buckets = cut(members.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("key", "a"))
    hot = common.hot_keys(members, "key")
    shared = cut(common.spread_join(members, buckets, "key", hot))
    wanted = cut(shared.select("node").distinct().join(nodes, "node"))
    sets = cut(_fetch(keyed, wanted.select("node", "keys", F.col("doc_id").alias("its"), F.col("text_key").alias("own"))))
    links = cut(_stars(shared.where("node <> a").select("a", "node").distinct(), nodes, sets, percent))
    pairs = links.select("a", F.col("b").alias("node")).unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("node")))
    open_ = cut(shared.where("node <> a").join(pairs, ["a", "node"], "left_anti").select("key").distinct())
    if open_.limit(1).count():
        near = pairs.groupBy("node").agg(F.min("a").alias("label")).select("node", F.least("node", "label").alias("label"))
        rest = common.spread_join(shared, open_, "key", hot).select("a", "node").distinct()
        rest = cut(rest.join(near, "node", "left").select("a", "node", F.coalesce("label", "node").alias("label")))
        families = components(rest.where("node <> a").select("a", F.col("node").alias("b"))).withColumnRenamed("label", "family")
        families = cut(rest.select("node", "label").distinct().join(families, "node").join(nodes.select("node", "n"), "node"))
        links = links.unionByName(_families(families, sets, percent))
    labels = components(links)
    classes = nodes.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("class"))
    least_id = cut(classes.groupBy("class").agg(F.min("doc_id").alias("component_id")))
    classes = cut(classes.join(least_id, "class").select("node", "class", "component_id"))
    out = seen.select("doc_id", "text_key", "n_shingles", "node").join(classes, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "class", "text_key")


def _fetch(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, keys, elements) of the wanted (node, keys, its, own), each from one of the rows that it names."""
    rows = keyed.join(wanted, (F.col("text_key") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("its")))
    return rows.select("node", "keys", "text").dropDuplicates(["node"]).mapInArrow(_with_sets, "node binary, keys array<long>, elements binary")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).drop("class", "text_key")


ORACLE = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select distinct doc_id, case when len(w) < {SHINGLE} then w else w[i:i + {SHINGLE} - 1] end as g from (select doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE} + 1, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by all),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select c.a, c.b from c join n x on x.doc_id = c.a join n y on y.doc_id = c.b where 100 * c.c >= {PERCENT} * (x.n + y.n - c.c)),
u as (select a, b from e union all select b, a from e),
r as (select a, b from u union select r.a, u.b from r join u on r.b = u.a),
m as (select a, min(b) as least from r group by all)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) as component_id, d.doc_id <= coalesce(m.least, d.doc_id) as kept
from documents d left join n on n.doc_id = d.doc_id left join m on m.a = d.doc_id
"""
