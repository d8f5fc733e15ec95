"""Operator 9, benchmark decontamination by q-gram lemma filtering.

Texts are folded (lower case, white space runs as one blank). An item is sought as units: whole up to UNIT characters, else in
windows of that length that begin every STRIDE characters, so that a passage of an item is found as well: each of
UNIT + STRIDE - 1 characters or more, and shorter ones that hold a window. A unit of m characters may differ by
k = RATE * m edits; a match then shares at least m - Q + 1 - k * Q q-grams with the text, on diagonals at most k apart. Shared
q-grams are counted in bands of diagonals twice as wide that overlap by half; bands that reach the bound are verified by an
alignment within the band, with free ends in the text. Items of fewer than SHORTEST characters are sought exactly, where no
letter or digit goes on at either end.

The benchmark is dealt into blocks of bounded size; a block's items are broadcast and indexed where they are used. A task holds one
index at a time: with several blocks it gathers some texts, then meets them block by block, all in one pass over the documents.

Defined results: null or empty texts are clean. Items that have no character after folding, or a null text, are not sought. An
item of one common word marks every text that has the word. Rows that repeat a doc_id are judged each by its own text. An item that
is there twice counts once for each item_id. Very long texts are searched whole. Extra columns pass through; the column of matches
gets another name where it is taken. Empty tables: no documents give no rows, no items leave every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqpack.llm import common
from seqpack.llm.common import U64, mix

Q, RATE, UNIT, STRIDE, SHORTEST = 10, 0.06, 100, 10, 24
#: Characters of benchmark text in one block; bits of the table that a q-gram is looked up in first.
BLOCK, BITS = 4_000_000, 22
#: Pairs of a text's and the index's equal q-grams that are held at once.
PAIRS = 1_000_000
_B = 0x5851F42D4C957F2D


def fold(text: str | None) -> str:
    return " ".join((text or "").replace("\0", " ").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hashes of the q-grams of c, by doubling."""
    if len(c) < q:
        return np.zeros(0, U64)
    power, parts, width = 1, {1: c.astype(U64) + U64(1)}, 1
    base = {1: U64(_B)}
    while width * 2 <= q:
        h = parts[width]
        parts[width * 2] = h[:-width] * base[width] + h[width:]
        base[width * 2] = U64(pow(_B, 2 * width, 1 << 64))
        width *= 2
    out, have = None, 0
    while width:
        if q & width:
            part = parts[width][have : have + len(c) - q + 1]
            out = part.copy() if out is None else out * base[width] + part
            have += width
        width //= 2
    return mix(out)


def units(items: list[tuple[int, str]]) -> list[tuple[int, str]]:
    out = []
    for item, text in items:
        s = fold(text)
        if len(s) >= SHORTEST:
            begins = range(0, len(s) - UNIT, STRIDE) if len(s) > UNIT else ()
            out += [(item, s[a : a + UNIT]) for a in begins] + [(item, s[max(0, len(s) - UNIT) :])]
    return out


def bounds(c: np.ndarray) -> np.ndarray:
    """Before which of the characters, and at the end, no letter or digit goes on (n + 1)."""
    each, of = np.unique(c, return_inverse=True)
    inside = np.array([chr(x).isalnum() for x in each.tolist()], bool)[of]
    return ~(np.concatenate([[False], inside]) & np.concatenate([inside, [False]]))


class Index:
    """The q-grams of the units of one block, and its short items by length."""

    def __init__(self, items: list[tuple[int, str]]):
        self.units = [(item, codes(s)) for item, s in units(items)]
        self.m = np.array([len(c) for _, c in self.units], np.int64)
        self.k = np.minimum((self.m * RATE).astype(np.int64), np.maximum(0, (self.m - Q) // Q))
        self.bound = np.maximum(1, self.m - Q + 1 - self.k * Q)
        each = [grams(c) for _, c in self.units]
        hashes = np.concatenate([*each, np.zeros(0, U64)])
        unit, at = np.repeat(np.arange(len(each)), [len(g) for g in each]), np.concatenate([*(np.arange(len(g)) for g in each), np.zeros(0, np.int64)])
        order = np.argsort(hashes, kind="stable")
        self.unit, self.at = unit[order], at[order]
        self.hashes, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << BITS, bool)
        self.table[(self.hashes >> U64(64 - BITS)).astype(np.intp)] = True
        self.short: dict[int, dict[str, set[int]]] = {}
        for item, s in ((item, fold(text)) for item, text in items):
            if 0 < len(s) < SHORTEST:
                self.short.setdefault(len(s), {}).setdefault(s, set()).add(item)
        self.short_hashes = {q: np.array([grams(codes(s), q)[0] for s in strings], U64) for q, strings in self.short.items()}

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, begin, edits) of matches; begin counts characters of the folded text."""
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)])
        c = codes("\0".join(texts) + "\0")
        yield from self._exact(c, begin)
        h = grams(c)
        near = np.flatnonzero(self.table[(h >> U64(64 - BITS)).astype(np.intp)])
        if not len(near) or not len(self.hashes):
            return
        where = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
        real = self.hashes[where] == h[near]
        near, where = near[real], where[real]
        keys, hits = self._banded(near, where, begin)
        span, low = 2 * len(c) + 4, len(c) + 2
        candidates = keys[hits >= self.bound[keys // span % len(self.units)]]
        done = set()
        for key in candidates.tolist():
            t, u, b = key // span // len(self.units), key // span % len(self.units), key % span - low
            item, pattern = self.units[u]
            if (t, item) not in done:
                k = int(self.k[u])
                lo, hi = max(int(begin[t]), b * (k + 1) - k), min(int(begin[t + 1]) - 1, (b + 2) * (k + 1) + len(pattern) + k)
                edits = aligned(pattern, c[lo:hi], b * (k + 1) - k - lo, 4 * k + 3)
                if edits <= k:
                    done.add((t, item))
                    yield t, item, max(0, b * (k + 1) - int(begin[t])), edits

    def _exact(self, c: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """The first place of each short item in each text."""
        if not self.short:
            return
        free, done = bounds(c), set()
        for q, strings in self.short.items():
            h = grams(c, q)
            at = np.flatnonzero(free[: len(h)] & free[q : q + len(h)])
            at = at[np.isin(h[at], self.short_hashes[q])]
            for p, t in zip(at.tolist(), (np.searchsorted(begin, at, side="right") - 1).tolist(), strict=True):
                for item in strings.get(c[p : p + q].tobytes().decode("utf-32-le", "surrogatepass"), ()):
                    if (t, item) not in done:
                        done.add((t, item))
                        yield t, item, p - int(begin[t]), 0

    def _banded(self, near: np.ndarray, where: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shared q-grams counted by text, unit and band, each band as one number; PAIRS at a time, however often a text repeats a q-gram."""
        n = self.count[where]
        upto = np.cumsum(n)
        span, low = 2 * int(begin[-1]) + 4, int(begin[-1]) + 2
        keys, hits, a = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while a < len(near):
            z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
            k = n[a:z]
            entry = np.repeat(self.first[where[a:z]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            place, unit = np.repeat(near[a:z], k), self.unit[entry]
            text = np.searchsorted(begin, place, side="right") - 1
            band = np.floor_divide(place - self.at[entry], self.k[unit] + 1)
            own = (text * len(self.units) + unit) * span + band + low
            new, many = np.unique(np.concatenate([own, own - 1]), return_counts=True)
            if len(keys):
                keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
                hits = np.bincount(at, np.concatenate([hits, many]), len(keys)).astype(np.int64)
            else:
                keys, hits = new, many
            a = z
        return keys, hits


def aligned(pattern: np.ndarray, text: np.ndarray, low: int, width: int) -> int:
    """Least edits that turn pattern into some stretch of text, over alignments on the diagonals low to low + width."""
    size, far = width + 1, 1 << 20
    padded = np.concatenate([text.astype(np.int64), np.full(1, -1)])
    offsets, steps = np.arange(size), np.arange(size)
    at = low + offsets  # text characters used, for each diagonal, before the first pattern character
    row = np.where((at >= 0) & (at <= len(text)), 0, far)
    for ch in pattern.tolist():
        same = padded[np.where((at >= 0) & (at < len(text)), at, len(text))] == ch
        new = row + np.where(same, 0, 1)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        at = at + 1
        new = np.where((at >= 0) & (at <= len(text)), new, far)
        row = np.minimum.accumulate(new - steps) + steps
        row = np.where((at >= 0) & (at <= len(text)), row, far)
    return int(row.min())


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text) of each block; one block at a time comes to the driver."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = -(-(UNIT // STRIDE) * (items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK) or 1
    for block in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block) if n > 1 else items
        yield [tuple(r) for r in part.collect()]


def matches(docs: DataFrame, benchmark: DataFrame, name: str = "matches", text: bool = True) -> DataFrame:
    """docs with an array of (item_id, begin, edits), one for each item of which a unit stands in the text; without its text on request.

    One pass over the documents, and no shuffle. name is lengthened where docs has such a column.
    """
    kind = "array<struct<item_id:long,begin:long,edits:int>>"
    to = pa.list_(pa.struct([("item_id", pa.int64()), ("begin", pa.int64()), ("edits", pa.int32())]))
    name = common.free_name(docs, name)
    sought = [docs.sparkSession.sparkContext.broadcast(items) for items in blocks(benchmark)]
    out = docs.withColumn(name, F.array().cast(kind))

    def run(batches):
        for group, each in common.blockwise(batches, "text", sought, Index):
            found: list[list[dict]] = [[{} for _ in range(b.num_rows)] for b in group]
            texts = [[fold(x) for x in b.column("text").to_pylist()] for b in group]
            for _, index in each:
                for k, own in enumerate(texts):
                    for t, item, begin, edits in index.search(own):
                        found[k][t].setdefault(item, {"item_id": item, "begin": begin, "edits": edits})
            for b, own in zip(group, found, strict=True):
                yield b.set_column(b.schema.get_field_index(name), pa.field(name, to), pa.array([sorted(x.values(), key=lambda y: (y["item_id"] is None, y["item_id"])) for x in own], to))

    out = out.mapInArrow(run, out.schema)
    return out if text else out.drop("text")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = matches(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"), text=False)
    return judged.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.size("matches").alias("n_items"), F.get("matches", F.lit(0))["item_id"].alias("first_item"))
