"""Operator 10, language identification by interpolated Kneser-Ney character models.

Letters are lower-cased code points, everything between them is one blank; a model of order ORDER is kept for each language.
Counts of full n-grams cover every learned document: each task counts its own batches, the sums are shuffled and written. Lower
orders use continuation counts, which follow from the distinct n-grams above. A model is stored as sorted arrays of 64-bit n-gram
hashes with log-probabilities, and of context hashes with back-off weights, which scoring looks up by binary search. Languages
come to the driver a few at a time and go out in blocks of BLOCK n-grams; a task meets one block at a time. A text's cross-entropy
with each language is divided by its length; the lowest wins.

score is the winner's share among the languages, at the temperature that makes the learned rows likeliest. All learned rows
calibrate: they lie in PARTS folds (by text hash, so a language's equal texts share one), and each is scored by models of the counts
without its fold. Likelihoods are summed over all rows. Each language's bound is the least cross-entropy that SHARE of its rows keep
within, of those that these models name rightly (of all languages' rows together, where a language has fewer than FEW such rows): a
rank among all of them, found exactly; `rejected` is true beyond it. The final models count all folds. Only rows that no such model
can judge take no part: texts without a letter, and a text that is the only one of its language (copies do not count). If there are
no others, the temperature is 8 and no text with a letter is rejected.

Defined results: `und` with score 0, rejected, for null texts and texts without a letter, and for all if nothing was learned; ties
go to the language that sorts first. Rows whose lang is null are not learned from. A null doc_id is in no fold: such a row is
learned from and counts as not held out. Repeated rows count as often as they stand. Very long texts are scored whole. Extra
columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqpack.llm import common
from seqpack.llm.common import U64, cut, mix

ORDER, ALPHABET = 4, 0x110000
FOLDS, HELD_OUT = 4, 2
DISCOUNT_FLOOR = 0.1
#: Folds that calibrate, the share of rows within a language's bound, and how many rows a bound of its own takes.
PARTS, SHARE, FEW = 5, Fraction(995, 1000), 50
#: Columns of counts, one for each fold; the key of the models that count all of them.
_FOLDS, WHOLE = [f"n{k}" for k in range(PARTS)], -1
TEMPERATURES = [2**k for k in np.arange(-1, 6.01, 0.25)]
#: Log-likelihoods are summed as whole multiples of 1 / GRAIN, so that no order of rows changes a sum.
GRAIN = 1 << 16
#: n-grams that are gathered, sent and looked up at once; distinct n-grams that a task sums before it hands them on.
BLOCK, SUMS = 4_000_000, 1_000_000
#: n-grams of so few letters are numbered by a table, those of more by sorting.
TABLE = 1 << 25
_POINT = 21


def _letters() -> np.ndarray:
    """The lower-case code point of each letter of the first plane, 0 for what is no letter."""
    out = np.zeros(65536, np.uint32)
    for c in map(chr, range(65536)):
        if c.isalpha():
            out[ord(c)] = ord(c.lower()[0])
    return out


_table: list[np.ndarray] = []


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, each text begun and ended by a blank (0) and runs of blanks made one; n + 1 offsets."""
    if not _table:
        _table.append(_letters())
    code = np.frombuffer("\0".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    far = code > 65535
    c = _table[0][np.where(far, 0, code)]
    if far.any():
        at = np.flatnonzero(far)
        each, of = np.unique(code[at], return_inverse=True)
        c[at] = np.array([ord(chr(x).lower()[0]) if chr(x).isalpha() else 0 for x in each.tolist()], np.uint32)[of]
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    blank = c == 0
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    run = np.cumsum(first)
    edged = np.zeros(int(run[-1]) + 1, bool)
    edged[run[begin]] = True  # runs at a text's begin or end have the blank there
    keep = ~blank | first & ~edged[run]
    keep[begin] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    return c[keep], place[begin]


_room: list[np.ndarray] = []


class Grams:
    """The n-grams that end at each scored symbol of some texts (all but a text's first blank, its closing blank included).

    grams: the distinct ones (m, ORDER); at: the number of each place's; begin: where each text's places begin; letters: which
    texts have a letter. The first n-grams of a text do not see the text before it.
    """

    def __init__(self, texts: list[str]):
        c, begin = symbols(texts)
        seen = np.zeros(ALPHABET, bool)
        seen[c] = seen[0] = True
        alphabet = np.flatnonzero(seen)
        number = np.zeros(ALPHABET if len(alphabet) and alphabet[-1] > 65535 else 65536, np.int64)
        number[alphabet] = np.arange(len(alphabet))
        dense, size = number[c], len(alphabet)
        shifted = [dense]
        for k in range(1, ORDER):
            back = np.concatenate([np.zeros(min(k, len(dense)), np.int64), dense[: max(0, len(dense) - k)]])
            for j in range(1, k):
                at = begin[:-1] + j
                back[at[at < len(back)]] = 0
            shifted.append(back)
        shifted = [x[1:] for x in shifted[::-1]]
        self.begin, self.letters = begin[:-1], np.add.reduceat((c > 0).astype(np.int64), begin[:-1]) > 0
        self.lengths = np.diff([*begin[:-1], len(c) - 1])
        if size**ORDER <= TABLE:
            code = shifted[0]
            for x in shifted[1:]:
                code = code * size + x
            if not _room:
                _room.append(np.empty(TABLE, np.int32))  # only pages that are used take memory
            room, place = _room[0], np.arange(len(code), dtype=np.int32)
            room[code] = place
            first = np.flatnonzero(room[code] == place)
            room[code[first]] = np.arange(len(first), dtype=np.int32)
            self.at = room[code]
        else:
            code = np.zeros(len(shifted[0]), U64)
            for x in shifted:
                code = mix(code ^ (x.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
            _, first, self.at = np.unique(code, return_index=True, return_inverse=True)
        self.grams = np.stack([alphabet[x[first]] for x in shifted], 1).astype(np.uint32)

    def counts(self) -> np.ndarray:
        return np.bincount(self.at, minlength=len(self.grams))


def gram_hash(grams: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams (m, k), k from 0 on."""
    h = np.full(len(grams), U64(grams.shape[1] + 1))
    for k in range(grams.shape[1]):
        h = mix(h ^ (grams[:, k].astype(U64) + U64(1)) * U64(0xD1342543DE82EF95))
    return h


def _packed(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = grams.astype(np.int64)
    return g[:, 0] << _POINT | g[:, 1], g[:, 2] << _POINT | g[:, 3]


def _unpacked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = (1 << _POINT) - 1
    return np.stack([a >> _POINT, a & low, b >> _POINT, b & low], 1).astype(np.uint32)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams and their counts in each fold (m, PARTS), summed."""
    grams, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    _, first, at = np.unique(gram_hash(grams), return_index=True, return_inverse=True)
    return grams[first], np.stack([np.bincount(at, x, len(first)).astype(np.int64) for x in n.T], 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of each language: how many in the texts of each fold."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def handed():
        for lang, (grams, n) in sums.items():
            a, b = _packed(grams)
            for at in range(0, len(n), 50_000):
                s = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n[s]), pa.string()), pa.array(a[s]), pa.array(b[s]), *(pa.array(x[s]) for x in n.T)], ["lang", "a", "b", *_FOLDS])
        sums.clear()

    for b in common.slices(batches, "text", 1 << 20):
        langs, texts, fold = b.column("lang").to_pylist(), b.column("text").to_pylist(), b.column("fold").to_numpy()
        for lang in set(langs):
            own = [i for i, x in enumerate(langs) if x == lang]
            found = Grams([texts[i] for i in own])
            place = found.at.astype(np.int64) * PARTS + np.repeat(fold[own], found.lengths)
            new = found.grams, np.bincount(place, minlength=len(found.grams) * PARTS).reshape(-1, PARTS)
            sums[lang] = merged([sums[lang], new]) if lang in sums else new
        if sum(len(n) for _, n in sums.values()) > SUMS:
            yield from handed()
    yield from handed()


def _known(docs: DataFrame) -> DataFrame:
    """(lang, text, fold) of the rows that are learned from. Where all texts of a language would share a fold, the one of least hash goes apart."""
    rows = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("hash"))
    fold = F.pmod("hash", F.lit(PARTS)).cast("int")
    ends = rows.groupBy("lang").agg(F.min("hash").alias("least"), F.max("hash").alias("most"), F.min(fold).alias("low"), F.max(fold).alias("high"))
    alone = [(r.lang, r.least) for r in ends.where("low = high and least < most").collect()]
    if alone:
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(alone, "lang string, least long")), "lang", "left")
        fold = F.when(F.col("least").isNull(), fold).otherwise((F.col("hash") != F.col("least")).cast("int"))
    return rows.select("lang", "text", fold.alias("fold"))


def counts(known: DataFrame) -> DataFrame:
    """(lang, a, b, n0, n1, ...): how often each n-gram (packed in a and b) stands in the known texts of each language, fold by fold."""
    each = known.mapInArrow(_counted, "lang string, a long, b long, " + ", ".join(f"{x} long" for x in _FOLDS))
    return each.groupBy("lang", "a", "b").agg(*(F.sum(x).alias(x) for x in _FOLDS))


def _total() -> Column:
    return sum((F.col(x) for x in _FOLDS), F.lit(0))


class Model:
    """Interpolated Kneser-Ney of one language: for each order hashes and log-probabilities, and context hashes and log back-off weights."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        levels = {ORDER: (grams, n)}
        for k in range(ORDER - 1, 0, -1):
            above = levels[k + 1][0][:, 1:]
            _, first, kinds = np.unique(gram_hash(above), return_index=True, return_counts=True)
            levels[k] = above[first], kinds
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        hashes, lower = gram_hash(np.zeros((1, 0), np.uint32)), np.full(1, 1 / ALPHABET)
        for k in range(1, ORDER + 1):
            grams, n = levels[k]
            own, at, kinds = np.unique(gram_hash(grams[:, :-1]), return_inverse=True, return_counts=True)
            total = np.bincount(at, n, len(own))
            once, twice = int((n == 1).sum()), int((n == 2).sum())
            d = max(DISCOUNT_FLOOR, once / (once + 2 * twice)) if once else DISCOUNT_FLOOR
            weight = d * kinds / total
            p = (n - d) / total[at] + weight[at] * lower[np.searchsorted(hashes, gram_hash(grams[:, 1:]))]
            h = gram_hash(grams)
            order = np.argsort(h)
            hashes, lower = h[order], p[order]
            self.orders.append((hashes, np.log(lower).astype(np.float32), own, np.log(weight).astype(np.float32)))

    def score(self, keys: Keys) -> np.ndarray:
        """Log-probabilities of the n-grams that keys are of."""
        out, left, back = np.empty(len(keys.whole[0])), np.arange(len(keys.whole[0])), np.zeros(len(keys.whole[0]))
        for k in range(ORDER, 0, -1):
            hashes, logs, contexts, weights = self.orders[k - 1]
            wanted = keys.whole[k - 1][left]
            at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
            there = hashes[at] == wanted
            hit = left[there]
            out[hit] = back[hit] + logs[at[there]]
            left = left[~there]
            if not len(left):
                return out
            wanted = keys.contexts[k - 1][left]
            at = np.minimum(np.searchsorted(contexts, wanted), len(contexts) - 1)
            back[left] += np.where(contexts[at] == wanted, weights[at], 0)
        out[left] = back[left] - math.log(ALPHABET)
        return out


class Keys:
    """Hashes of n-grams' last k symbols and of their contexts, k from 1 to ORDER; sorted by the highest order, so that lookups run in one direction."""

    def __init__(self, grams: np.ndarray):
        self.whole = [gram_hash(grams[:, ORDER - k :]) for k in range(1, ORDER + 1)]
        self.contexts = [gram_hash(grams[:, ORDER - k : -1]) for k in range(1, ORDER + 1)]


def means(models: dict[str, Model], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean log-probability of each text's symbols in each language (texts, languages), and which texts have a letter."""
    found = Grams(texts)
    keys = Keys(found.grams)
    out = np.empty((len(texts), len(models)))
    for j, model in enumerate(models.values()):
        out[:, j] = np.add.reduceat(model.score(keys)[found.at], found.begin) / found.lengths
    return out, found.letters


class Calibration:
    """The temperature of shares and each language's bound on cross-entropy."""

    def __init__(self, temperature: float, bounds: np.ndarray):
        self.temperature, self.bounds = temperature, bounds

    def judge(self, mean: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each text's language, its share, and whether it is rejected."""
        best, top = mean.argmax(axis=1), mean.max(axis=1, keepdims=True)
        share = 1 / np.exp(self.temperature * (mean - top)).sum(axis=1)
        return best, np.where(letters, share, 0.0), ~letters | (-top[:, 0] > self.bounds[best])


def _models(table: DataFrame, columns: dict[int, Column]) -> tuple[list[str], list]:
    """The languages of a table of counts, sorted, and broadcasts of their models: {key: {language: model}}, by the count that columns has under the key, some neighbouring ones in each."""
    spark = table.sparkSession
    sizes = sorted(table.groupBy("lang").agg(*(F.count(F.when(c > 0, 1)) for c in columns.values())).collect())
    blocks: list[list[tuple[int, str]]] = []
    room = 0
    for j, key in enumerate(columns):
        for row in sizes:
            if not (k := row[j + 1]):
                continue
            if not blocks or room + k > BLOCK:
                blocks.append([])
                room = 0
            blocks[-1].append((key, row.lang))
            room += k
    out = []
    for block in blocks:
        each: dict[int, dict[str, Model]] = {}
        for key in dict.fromkeys(key for key, _ in block):
            some = [lang for x, lang in block if x == key]
            got = table.where(F.col("lang").isin(some) & (columns[key] > 0)).select("lang", "a", "b", columns[key].alias("n")).toArrow()
            langs = got.column("lang").combine_chunks().dictionary_encode()
            of, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
            a, b, n = (got.column(c).to_numpy() for c in ("a", "b", "n"))
            each[key] = {}
            for lang in some:
                own = of == names.index(lang)
                grams, k = _unpacked(a[own], b[own]), n[own]
                order = np.argsort(gram_hash(grams))  # the same model whatever order the rows come in
                each[key][lang] = Model(grams[order], k[order])
        out.append(spark.sparkContext.broadcast(each))
    return [row.lang for row in sizes], out


def _scored(docs: DataFrame, blocks: list, schema: str, columns) -> DataFrame:
    """docs through columns(batch, means, letters): a row for each text, all languages' blocks met one after the other."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for group, each in common.blockwise(batches, "text", blocks, lambda models: models[WHOLE], most=8 << 20):
            parts: list[list] = [[] for _ in group]
            letters: list = [None] * len(group)
            for _, models in each:
                for k, b in enumerate(group):
                    mean, letters[k] = means(models, [x or "" for x in b.column("text").to_pylist()])
                    parts[k].append(mean)
            for k, b in enumerate(group):
                yield pa.RecordBatch.from_arrays(columns(b, np.concatenate(parts[k], axis=1), letters[k]), names)

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) of each row of docs (doc_id, text, ...), by models of learned (text, lang, ...)."""
    known = _known(learned)
    table = cut(counts(known))
    schema = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    langs, blocks = _models(table, {WHOLE: _total()})
    if not langs:
        return asked.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    calibration = _calibrated(known, table, langs)

    def columns(b, mean, letters):
        best, share, rejected = calibration.judge(mean, letters)
        return [b.column("doc_id"), pa.array([langs[j] if ok else "und" for j, ok in zip(best.tolist(), letters.tolist(), strict=True)], pa.string()), pa.array(share), pa.array(-mean.max(axis=1), mask=~letters), pa.array(rejected)]

    return _scored(asked, blocks, schema, columns)


def _calibrated(known: DataFrame, table: DataFrame, langs: list[str]) -> Calibration:
    """Fitted on all known rows, each scored by models that have not counted its fold."""
    _, blocks = _models(table, {k: _total() - F.col(x) for k, x in enumerate(_FOLDS)})
    if not blocks:
        return Calibration(8.0, np.full(len(langs), np.inf))
    place = {lang: j for j, lang in enumerate(langs)}

    def run(batches):
        for group, each in common.blockwise(batches, "text", blocks, lambda models: models, limit=8 << 20, most=8 << 20):
            mean = [np.full((b.num_rows, len(langs)), -np.inf) for b in group]
            letters = [np.zeros(b.num_rows, bool) for b in group]
            for _, folds in each:
                for k, b in enumerate(group):
                    fold = b.column("fold").to_numpy()
                    for part, models in folds.items():
                        own, at = np.flatnonzero(fold == part), 0
                        for some in common.slices(iter([b.select(["text"]).take(pa.array(own))]), "text", 1 << 20):
                            rows = own[at : at + some.num_rows]
                            at += some.num_rows
                            got, letters[k][rows] = means(models, some.column("text").to_pylist())
                            mean[k][rows[:, None], [place[x] for x in models]] = got
            for k, b in enumerate(group):
                right = np.array([place[x] for x in b.column("lang").to_pylist()], int)
                yield from _judged(right, mean[k], letters[k])

    found = cut(known.mapInArrow(run, "lang int, entropy long, temperature int, likelihood long"))
    for block in blocks:
        block.destroy()
    sums = {r.temperature: r.likelihood for r in found.where("temperature is not null").groupBy("temperature").agg(F.sum("likelihood").alias("likelihood")).collect()}
    bounds = _bounds(found.where("lang is not null"), len(langs))
    return Calibration(float(TEMPERATURES[max(sorted(sums), key=sums.__getitem__)]) if sums else 8.0, bounds)


def _judged(right: np.ndarray, mean: np.ndarray, letters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The cross-entropy (a double's bits, which sort as it does) of each row that is named rightly, and the rows' log-likelihood at each temperature.

    right: the number of each row's language; mean: its mean log-probabilities, minus infinity where a language has no model.
    """
    names = ["lang", "entropy", "temperature", "likelihood"]
    rows = letters & (mean[np.arange(len(right)), right] > -np.inf)
    right, mean = right[rows], mean[rows]
    if not len(right):
        return
    gap = mean - mean.max(axis=1, keepdims=True)
    own = gap[np.arange(len(right)), right]
    sums = [int(np.rint(GRAIN * (t * own - np.log(np.exp(t * gap).sum(axis=1)))).astype(np.int64).sum()) for t in TEMPERATURES]
    size = len(sums)
    yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64()), pa.array(range(size), pa.int32()), pa.array(sums, pa.int64())], names)
    hit = mean.argmax(axis=1) == right
    entropy = np.abs(mean.max(axis=1)[hit])
    size = len(entropy)
    yield pa.RecordBatch.from_arrays([pa.array(right[hit], pa.int32()), pa.array(entropy.view(np.int64)), pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64())], names)


def _bounds(found: DataFrame, size: int) -> np.ndarray:
    """Each language's bound, of (lang, entropy) rows: the value at rank SHARE of its rows, of all rows where it has fewer than FEW.

    The rank is followed through the values' 64 bits, 16 at a time: a language has at most 65,536 counts a step, wherever its rows lie.
    """
    every = -1
    each = found.select(F.explode(F.array("lang", F.lit(every))).alias("lang"), "entropy")
    rows = {r.lang: r.n for r in each.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rows:
        return np.full(size, np.inf)
    at = [(lang, 0, math.ceil(SHARE * n)) for lang, n in rows.items() if lang == every or n >= FEW]
    for shift in (48, 32, 16, 0):
        wanted = found.sparkSession.createDataFrame(at, "lang int, head long, rank long")
        near = each.join(F.broadcast(wanted), "lang").where(F.shiftright("entropy", min(63, shift + 16)) == F.col("head"))
        bins = near.groupBy("lang", "rank", F.shiftright("entropy", shift).alias("head")).agg(F.count("*").alias("n"))
        upto = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("lang").orderBy("head"))).where("upto >= rank")
        least = upto.groupBy("lang").agg(F.min(F.struct("head", F.expr("rank - upto + n").alias("rank"))).alias("least"))
        at = [(r.lang, r.least.head, r.least.rank) for r in least.collect()]
    values = {lang: float(np.int64(head).view(np.float64)) for lang, head, _ in at}
    return np.array([values.get(j, values[every]) for j in range(size)])


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    found = identify(docs, docs.where(F.coalesce(fold != HELD_OUT, F.lit(True))))
    return found.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
