"""Operator 5, URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

The rules label the urls that they fit; there are no other labels. Trees are fitted to at most SAMPLE different labelled urls (least
hashes first, so the choice does not depend on partitioning) and judge every url that no rule fits. Features: lengths, depth, digit
ratio, entropy, parameter counts, marks of the host, and suffix statistics: the share of blocked labels for the host's last label
and last two, smoothed. Where a labelled url is learned from, its shares come from the other folds of FOLDS alone, so its own label
is not among its features. Features are computed where the urls are, over whole batches of bytes; numbers alone go to the driver,
which grows the trees in numpy.

Defined results: null urls and urls without `://` have empty host and path; the trees judge them too. Without any labelled url
the verdict is `allow`. Of rules of equal length the one listed first counts. Repeated rows keep a row each; null page_id stays null.
Very long urls are judged whole. Extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from seqpack.llm import common

#: (host, path prefix, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Labelled urls that the trees are fitted to, and the shape of the ensemble.
SAMPLE, TREES, DEPTH, BINS, RATE, LEAST = 20_000, 40, 3, 32, 0.2, 10
#: Folds for the shares of blocked labels, and the labels' weight of the base share in them.
FOLDS, PRIOR = 5, 5
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "host_digits", "entropy", "host_entropy", "parameters", "query_length", "has_fragment", "hyphens", "longest_label", "secure", "ends_in_slash", "suffix_rate", "domain_rate")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: the host with A-Z lower-cased, the path up to the query or fragment; both empty without `://`."""
    rest = F.coalesce(F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits. Of equally long ones the one listed first."""
    text = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


class _Bytes:
    """Counts over the bytes of each row of an array."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = common.raw(column)
        self.begin, self.end = self.offsets[:-1], self.offsets[1:]
        self.length = self.end - self.begin

    def count(self, mask: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask)])
        return upto[self.end if end is None else end] - upto[self.begin if begin is None else begin]

    def find(self, byte: int) -> np.ndarray:
        """Where the byte first stands in each row, else the row's end."""
        out, at = self.end.copy(), np.flatnonzero(self.data == byte)[::-1]
        out[np.searchsorted(self.offsets, at, side="right") - 1] = at
        return out

    def entropy(self) -> np.ndarray:
        n = len(self.length)
        p = np.bincount(np.repeat(np.arange(n), self.length) * 256 + self.data, minlength=n * 256).reshape(n, 256) / np.maximum(self.length, 1)[:, None]
        return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)

    def longest(self, byte: int) -> np.ndarray:
        """The longest stretch between such bytes."""
        at = np.flatnonzero(self.data == byte)
        size = np.sort(np.concatenate([at, self.end])) - np.sort(np.concatenate([self.begin, at + 1]))
        out = np.zeros(len(self.length), np.int64)
        np.maximum.at(out, np.repeat(np.arange(len(out)), self.count(self.data == byte) + 1), size)
        return out


def lexical(url: pa.Array, host: pa.Array, path: pa.Array) -> np.ndarray:
    """The features of urls (n, all but the shares); lengths are in bytes."""
    u, h, p = map(_Bytes, (url, host, path))
    is_in = lambda b, chars: np.isin(b.data, np.frombuffer(chars, np.uint8))
    digits = b"0123456789"
    fragment = u.find(ord("#"))
    query = np.minimum(u.find(ord("?")) + 1, fragment)
    start = pc.utf8_lower(pc.utf8_slice_codeunits(url.cast(pa.string()), 0, 8))
    columns = (
        u.length, h.length, p.length, p.count(is_in(p, b"/")), h.count(is_in(h, b".")) + 1, u.count(is_in(u, digits)) / np.maximum(u.length, 1), h.count(is_in(h, digits)), u.entropy(), h.entropy(),
        u.count(is_in(u, b"=&"), query, fragment), fragment - query, fragment < u.end, u.count(is_in(u, b"-")), h.longest(ord(".")), pc.equal(start, "https://").to_numpy(zero_copy_only=False), pc.ends_with(path.cast(pa.string()), "/").to_numpy(zero_copy_only=False),
    )
    return np.stack([np.asarray(c, float) for c in columns], 1)


class Shares:
    """The share of blocked labels of each suffix (by hash), smoothed towards that of all."""

    def __init__(self, suffixes: np.ndarray, blocked: np.ndarray):
        """suffixes: (n, kinds) hashes; blocked: 0 or 1."""
        self.base = float(blocked.mean()) if len(blocked) else 0.0
        self.tables = []
        for k in range(suffixes.shape[1]):
            keys, at = np.unique(suffixes[:, k], return_inverse=True)
            self.tables.append((keys, (np.bincount(at, blocked, len(keys)) + PRIOR * self.base) / (np.bincount(at, minlength=len(keys)) + PRIOR)))

    def of(self, suffixes: np.ndarray) -> np.ndarray:
        out = np.full(suffixes.shape, self.base)
        for k, (keys, share) in enumerate(self.tables):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, suffixes[:, k]), len(keys) - 1)
                out[:, k] = np.where(keys[at] == suffixes[:, k], share[at], self.base)
        return out


class Boosted:
    """Boosted regression trees on the log loss, grown level by level on binned features with second-order gains."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.prior = float(np.clip(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)), -4, 4))
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], 1)
        self.trees, raw = [], np.full(len(y), self.prior)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, p - y, np.maximum(p * (1 - p), 1e-9))
            self.trees.append(tree)
            raw += self._apply(tree, x)

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple[int, float, float]]:
        """Nodes in heap order as (feature or -1, threshold, value): left when the feature is at most the threshold."""
        nodes, at, penalty = [(-1, 0.0, 0.0)] * (2 ** (DEPTH + 1) - 1), np.zeros(len(g), int), 1.0
        for node in range(len(nodes)):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            nodes[node] = (-1, 0.0, -RATE * gs / (hs + penalty))
            if 2 * node + 2 >= len(nodes) or len(rows) < 2 * LEAST:
                continue
            best = (1e-6, -1, 0)
            for k, edges in enumerate(self.edges):
                if len(edges):
                    b = binned[rows, k]
                    gl, hl, nl = (np.bincount(b, w, len(edges) + 1).cumsum()[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                    gain = gl**2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs**2 / (hs + penalty)
                    gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = 0
                    if gain.max() > best[0]:
                        best = (gain.max(), k, int(gain.argmax()))
            if best[1] >= 0:
                nodes[node] = (best[1], float(self.edges[best[1]][best[2]]), nodes[node][2])
                at[rows] = 2 * node + 1 + (binned[rows, best[1]] > best[2])
        return nodes

    def _apply(self, tree: list[tuple[int, float, float]], x: np.ndarray) -> np.ndarray:
        feature, limit, value = (np.array(v) for v in zip(*tree, strict=True))
        at, rows = np.zeros(len(x), int), np.arange(len(x))
        for _ in range(DEPTH):
            f = feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > limit[at]))
        return value[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-sum((self._apply(t, x) for t in self.trees), np.full(len(x), self.prior))))


class Judge:
    """Trees and shares, from lexical features (n, 16), suffix hashes (n, 2), labels and folds."""

    def __init__(self, features: np.ndarray, suffixes: np.ndarray, blocked: np.ndarray, fold: np.ndarray):
        shares = np.zeros(suffixes.shape)
        for k in range(FOLDS):
            shares[fold == k] = Shares(suffixes[fold != k], blocked[fold != k]).of(suffixes[fold == k])
        self.trees, self.shares = Boosted(np.concatenate([features, shares], 1), blocked), Shares(suffixes, blocked)

    def score(self, features: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
        return self.trees.score(np.concatenate([features, self.shares.of(suffixes)], 1))


@F.arrow_udf(ArrayType(DoubleType()))
def _features(url: pa.Array, host: pa.Array, path: pa.Array) -> pa.Array:
    x = lexical(url, host, path)
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())) if len(x) else pa.array([], pa.list_(pa.float64()))


def labelled(ruled: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, suffix hashes, labels and folds of at most sample different urls (url, host, path, suffix, domain, by_rule)."""
    some = common.cut(ruled.where("by_rule is not null").select("url", "host", "path", "suffix", "domain", "by_rule").dropDuplicates(["url"]))
    chosen = common.least_hashes(some, "url", sample).select(_features("url", "host", "path").alias("x"), "suffix", "domain", (F.col("by_rule") == "block").alias("blocked"), F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int").alias("fold"))
    rows = sorted(map(tuple, chosen.collect()))
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    x = np.array(columns[0], float).reshape(len(rows), len(FEATURES) - 2)
    return x, np.array([columns[1], columns[2]], np.int64).T.reshape(len(rows), 2), np.array(columns[3], float), np.array(columns[4], int)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row of pages (page_id, url, ...); score is the trees' share for block, null under a rule."""
    ruled = parted(pages, rules)
    x, suffixes, blocked, fold = labelled(ruled, sample)
    known = pages.sparkSession.sparkContext.broadcast(Judge(x, suffixes, blocked, fold) if len(x) else None)

    @F.arrow_udf("double")
    def score(url: pa.Array, host: pa.Array, path: pa.Array, suffix: pa.Array, domain: pa.Array, free: pa.Array) -> pa.Array:
        out, at = np.zeros(len(url)), np.flatnonzero(free.to_numpy(zero_copy_only=False))
        if known.value is not None and len(at):
            out[at] = known.value.score(lexical(*(c.take(pa.array(at)) for c in (url, host, path))), np.stack([suffix.to_numpy()[at], domain.to_numpy()[at]], 1))
        return pa.array(out, mask=~free.to_numpy(zero_copy_only=False))

    scored = ruled.withColumn("score", score("url", "host", "path", "suffix", "domain", F.col("rule").isNull()))
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), "score")


def parted(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, url, host, path, suffix, domain, rule, by_rule): a url's parts, hashes of its host's last label and last two, and its rule."""
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    suffix = lambda n: F.xxhash64(F.substring_index("host", ".", -n))
    return parts.select("*", suffix(1).alias("suffix"), suffix(2).alias("domain"), rule.alias("rule"), verdict.alias("by_rule"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))
