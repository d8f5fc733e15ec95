"""Operator 3, toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary texts. Training follows the cover scheme: overlapping
GRAM-byte grams are counted by document, those that mark a class (by odds and significance against the other class) get a value,
and word segments are taken greedily by the value of the grams that they newly cover. A text is folded and cut at blanks into
windows of about WINDOW bytes; each window is compressed with either dictionary. Both dictionaries end in the same pad and every
window begins with it, so that every block is compressed rather than stored and one word more or less shows in its length. How
often the toxic dictionary saves how many bytes makes a text's features; logistic regression weighs them, and its threshold is
moved to the best F1 of the learned rows, so that 0.5 is the calibrated cut.

Learning takes at most SAMPLE labelled documents and SAMPLE_BYTES of text: least hashes of doc_id first, one row for each doc_id,
each class up to its share of the labels (the rarer one up to RARE of the sample at least), a text that does not fit passed over.
Rows are chosen by their lengths, then only the chosen texts go to the driver. Every text is scored whole.

Defined results: null and empty texts have no window and get the score of a text without any saving. Without labels of both
classes every score is 0. Of labels that repeat a doc_id the highest counts; null labels are left out. Rows that repeat a doc_id
are scored each. Extra columns pass through; the score's column gets another name where it is taken. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqpack.llm import common

SAMPLE, SAMPLE_BYTES, RARE = 6_000, 24_000_000, 0.05
GRAM, WINDOW, TOXIC_BYTES, ORDINARY_BYTES = 6, 28, 1200, 600
LEAST, ODDS, SIGMAS = 4, 1.0, 4.0
PAD = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STEPS = np.arange(1, 9)
FOLDS = 5
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def fold(text: str | None) -> bytes:
    """Lower case, ASCII punctuation and white space as single blanks, a blank at either end."""
    return b" " + b" ".join((text or "").lower().encode().translate(_FOLD).split()) + b" "


def windows(folded: bytes) -> list[bytes]:
    """Stretches of about WINDOW bytes from blank to blank, the blanks shared; a longer word is cut."""
    out, i, n = [], 0, len(folded)
    while i < n - 1:
        j = folded.rfind(b" ", i + 1, i + WINDOW) if i + WINDOW < n else n - 1
        if j <= i:
            j = min(n - 1, i + WINDOW - 1)
        out.append(PAD + folded[i : j + 1])
        i = j
    return out


def _grams(folded: bytes) -> np.ndarray:
    b = np.frombuffer(folded, np.uint8).astype(np.int64)
    code = np.zeros(max(0, len(b) - GRAM + 1), np.int64)
    for k in range(GRAM):
        code = code << 8 | b[k : k + len(code)]
    return np.unique(code)


def _counted(folded: list[bytes], most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Grams and in how many texts each stands, merged whenever so many wait."""
    codes, n, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    for k, f in enumerate(folded):
        waiting.append(_grams(f))
        if k == len(folded) - 1 or sum(map(len, waiting)) > most:
            codes, at = np.unique(np.concatenate([codes, *waiting]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, np.ones(sum(map(len, waiting)), np.int64)]), len(codes)).astype(np.int64)
            waiting = []
    return codes, n


def _values(own: tuple[np.ndarray, np.ndarray, int], other: tuple[np.ndarray, np.ndarray, int]) -> dict[bytes, float]:
    """The grams that mark own against other, each with its value: documents times log odds."""
    codes, n, docs = own
    at = np.minimum(np.searchsorted(other[0], codes), max(0, len(other[0]) - 1))
    there = np.where(other[0][at] == codes, other[1][at], 0) if len(other[0]) else np.zeros(len(codes))
    p, q = (n + 0.5) / (docs + 1), (there + 0.5) / (other[2] + 1)
    odds, sigmas = np.log(p / q), (p - q) / np.sqrt((p * (1 - p) + q * (1 - q)) / docs)
    keep = (n >= LEAST) & (odds > ODDS) & (sigmas > SIGMAS)
    return {int(c).to_bytes(GRAM, "big"): float(v) for c, v in zip(codes[keep], (odds * n)[keep], strict=True)}


def cover(values: dict[bytes, float], words: set[bytes], size: int) -> bytes:
    """A dictionary's content: segments of words, the most valuable last."""
    segments = set()
    for word in words:
        w = b" " + word + b" "
        if hit := [i for i in range(len(w) - GRAM + 1) if w[i : i + GRAM] in values]:
            segments.add(w[hit[0] : hit[-1] + GRAM])
    covered: set[bytes] = set()
    grams = lambda s: {s[i : i + GRAM] for i in range(len(s) - GRAM + 1)} - covered
    worth = lambda s: sum(values.get(g, 0.0) for g in grams(s)) / (len(s) + 2)
    heap, out, total = [(-worth(s), s) for s in sorted(segments)], [], 0
    heapq.heapify(heap)
    while heap and total < size:
        _, s = heapq.heappop(heap)
        w = worth(s)
        if heap and w < -heap[0][0]:
            heapq.heappush(heap, (-w, s))
        elif w > 0:
            out.append(s)
            total += len(s)
            covered |= grams(s)
    return b"".join(out[::-1])


class Classifier:
    """The two dictionaries and the weights of the features."""

    def __init__(self, texts: list[str | None], toxic: np.ndarray):
        folded, counted = [fold(t) for t in texts], []
        for label in (True, False):
            own = [f for f, t in zip(folded, toxic, strict=True) if t == label]
            codes, n = _counted(own)
            counted.append(((codes, n, len(own)), set().union(*(f.split() for f in own))))
        (bad, bad_words), (good, good_words) = counted
        self.contents = cover(_values(bad, good), bad_words, TOXIC_BYTES), cover(_values(good, bad), good_words, ORDINARY_BYTES)
        x, y = self.features(folded), toxic.astype(float)
        self.weights = self._fit(x, y)
        p = self._share(x)
        order = np.argsort(-p, kind="stable")
        f1 = 2 * np.cumsum(y[order]) / (np.arange(1, len(y) + 1) + y.sum())
        best = int(f1.argmax())
        cut = (p[order[best]] + p[order[min(best + 1, len(p) - 1)]]) / 2
        self.weights[-1] -= np.log(cut / (1 - cut))

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        parameters = zstandard.ZstdCompressionParameters(window_log=12, chain_log=11, hash_log=11, search_log=3, min_match=5, target_length=16, strategy=zstandard.STRATEGY_BTOPT, write_checksum=False, write_content_size=False, write_dict_id=False)
        return [zstandard.ZstdCompressor(compression_params=parameters, dict_data=zstandard.ZstdCompressionDict(c + PAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for c in self.contents]

    def features(self, folded: list[bytes], most: int = 1 << 20) -> np.ndarray:
        """A row for each text; texts are cut into windows so many bytes at a time."""
        size = np.cumsum([0, *map(len, folded)])
        cuts = [0, *np.flatnonzero(size[1:-1] // most > size[:-2] // most) + 1, len(folded)]
        return np.concatenate([self._features(folded[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])

    def _features(self, folded: list[bytes]) -> np.ndarray:
        each = [windows(f) for f in folded]
        n = np.array([len(w) for w in each], np.int64)
        flat = [w for ws in each for w in ws]
        toxic, ordinary = (np.fromiter(map(len, c.multi_compress_to_buffer(flat)), np.int64, len(flat)) if flat else np.zeros(0, np.int64) for c in self._compressors())
        saved, owner = ordinary - toxic, np.repeat(np.arange(len(folded)), n)
        many = np.stack([np.bincount(owner, saved >= k, len(folded)) for k in STEPS], 1)
        top = np.zeros(len(folded))
        np.maximum.at(top, owner, np.minimum(saved, 10))
        return np.column_stack([many / (n + 2)[:, None], np.log1p(many), many[:, 3:7] > 0, top / 10, np.log1p(n) / 5, np.ones(len(folded))])

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        return w

    def _share(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self._share(self.features([fold(t) for t in texts]))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, size: int = SAMPLE_BYTES) -> Classifier | None:
    """A classifier from at most rows labelled documents (doc_id, toxic) and size bytes of their texts."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    known = common.cut(known.join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi"))
    n = {t: known.where(F.col("toxic") == t).count() for t in (True, False)}
    if not all(n.values()):
        return None
    rare = min(n, key=n.get)
    quota = {rare: min(n[rare], max(rows * n[rare] // sum(n.values()), int(rows * RARE), 1))}
    quota[not rare] = max(1, min(n[not rare], rows - quota[rare]))
    some = common.cut(common.least_hashes(known.where("toxic"), "doc_id", quota[True]).unionByName(common.least_hashes(known.where("not toxic"), "doc_id", quota[False])))
    keyed = docs.select(F.col("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), F.xxhash64("text").alias("key"))
    own = common.cut(keyed.join(F.broadcast(some), "doc_id"))
    row = F.min(F.struct("key", "n")).alias("m")
    sizes = own.groupBy("doc_id", "toxic").agg(row).select("doc_id", "toxic", "m.key", "m.n", F.xxhash64("doc_id").alias("h")).collect()
    chosen, left = [], {t: size * quota[t] // sum(quota.values()) for t in quota}
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        if r.n <= left[r.toxic]:
            left[r.toxic] -= r.n
            chosen.append((r.doc_id, r.key))
    if not chosen:
        return None
    wanted = spark.createDataFrame(chosen, f"doc_id {dict(own.dtypes)['doc_id']}, key long")
    got = own.join(F.broadcast(wanted), ["doc_id", "key"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").collect()
    got.sort(key=lambda r: r.doc_id)
    texts, toxic = [r.text for r in got], [r.toxic for r in got]
    return Classifier(texts, np.array(toxic)) if any(toxic) and not all(toxic) else None


def scored(docs: DataFrame, classifier: Classifier | None, name: str = "score") -> DataFrame:
    """docs (doc_id, text, ...) with a score of 0 to 1, the last column."""
    name = common.free_name(docs, name)
    known = docs.sparkSession.sparkContext.broadcast(classifier)
    out = docs.withColumn(name, F.lit(0.0))

    def run(batches):
        for b in common.slices(batches, "text", 1 << 20):
            p = known.value.score(b.column("text").to_pylist()) if known.value else np.zeros(b.num_rows)
            yield b.set_column(b.schema.get_field_index(name), pa.field(name, pa.float64()), pa.array(p, pa.float64()))

    return out.mapInArrow(run, out.schema)


def toxicity(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """docs with a score, learned from the labels whose fold is not 0."""
    fold_ = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    return scored(docs, learn(docs, labels.where(fold_ != 0)), name)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fold_ = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    out = toxicity(docs, common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(fold_ == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
