"""Toxicity, language, url filter, decontamination: held-out accuracy, brute force, odd rows."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_data import prose
from pyspark.sql import functions as F

from seqpack.llm import decontam, langid, toxicity, url_filter

DATA = "/root/testdata/sf0.01"


def read(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[y].mean() - (y.sum() - 1) / 2) / (~y).sum()


def test_planted_words_are_learned():
    r = random.Random(1)
    texts = [prose(r, r.randint(30, 300)) for _ in range(400)]
    toxic = np.arange(400) % 4 == 0
    mark = lambda t: " ".join(r.choice(["vilest", "rotten", "wretch"]) if r.random() < 0.04 else w for w in t.split()) + " vilest"
    texts = [mark(t) if bad else t for t, bad in zip(texts, toxic, strict=True)]
    c = toxicity.Classifier(texts[:300], toxic[:300])
    p = c.score(texts[300:])
    assert auc(p, toxic[300:]) > 0.97
    assert (p[toxic[300:]] >= 0.5).mean() > 0.85 and (p[~toxic[300:]] >= 0.5).mean() < 0.05
    assert b"vilest" in c.contents[0] and b"vilest" not in c.contents[1]
    assert c.score([]).shape == (0,) and 0 <= c.score([None])[0] == c.score([""])[0] <= 1


def test_windows_cover_the_text():
    r = random.Random(2)
    for text in (prose(r, 50), "x" * 200, "", "a", "é" * 100):
        folded = toxicity.fold(text)
        body = [w[len(toxicity.PAD) :] for w in toxicity.windows(folded)]
        joined = body[0] if body else folded
        for w in body[1:]:
            assert w[:1] == joined[-1:]
            joined += w[1:]
        assert joined == folded and all(len(w) <= toxicity.WINDOW + 1 for w in body)


def test_features_are_those_of_one_window_at_a_time():
    r = random.Random(3)
    texts = [prose(r, 40) + (" vile" if i % 3 == 0 else "") for i in range(90)]
    c = toxicity.Classifier(texts, np.array([i % 3 == 0 for i in range(90)]))
    asked = [texts[0], texts[1], "", None, prose(r, 500), "vile " * 30]
    got = c.features([toxicity.fold(t) for t in asked])
    for row, text in zip(got, asked, strict=True):
        saved = []
        for w in toxicity.windows(toxicity.fold(text)):
            toxic, ordinary = (len(z.compress(w)) for z in c._compressors())
            saved.append(ordinary - toxic)
        many = [sum(s >= k for s in saved) for k in toxicity.STEPS]
        plain = [m / (len(saved) + 2) for m in many] + [math.log1p(m) for m in many] + [float(m > 0) for m in many[3:7]] + [max([min(s, 10) for s in saved] + [0]) / 10, math.log1p(len(saved)) / 5, 1.0]
        assert np.allclose(row, plain)


def test_learning_takes_one_row_a_document_and_passes_over_what_does_not_fit(spark):
    r = random.Random(4)
    rows_ = [(i, prose(r, 30) + (" vile" if i % 4 == 0 else "")) for i in range(80)] + [(4, "vile " * 5)] * 50 + [(1, "x " * 200_000)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(5000, 1)], "doc_id long, toxic int")
    assert toxicity.learn(docs.where("doc_id <> 1").unionByName(docs.where("doc_id = 1 and length(text) > 1000")), labels, size=60_000) is not None
    assert toxicity.learn(docs, labels, size=0) is None and toxicity.learn(docs, labels.where("toxic = 0")) is None
    out = toxicity.toxicity(docs.withColumn("score", F.lit(7)), labels)
    assert out.columns == ["doc_id", "text", "score", "score_"] and {x.score for x in out.collect()} == {7}


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (8, 1, 0), (11, 0, 0), (12, 1, None), (None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.scored(odd_docs, toxicity.learn(odd_docs, labels), "p")
    assert out.count() == odd_docs.count() and out.where("p is null or p < 0 or p > 1").count() == 0
    assert toxicity.scored(odd_docs, toxicity.learn(odd_docs, labels.limit(0)), "p").where("p <> 0").count() == 0
    assert toxicity.scored(no_docs, toxicity.learn(odd_docs, labels), "p").count() == 0 and toxicity.learn(no_docs, labels) is None


def test_labels_beyond_the_folds_do_not_matter(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r.doc_id: r.score for r in toxicity.toxicity(docs, x).select("doc_id", "score").collect()} for x in (labels, flipped))
    assert one == two


def test_languages_held_out(spark):
    out = langid.op10_langid(spark, DATA).collect()
    lang = {r.doc_id: r.lang for r in read(spark, "documents").select("doc_id", "lang").collect()}
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in out)


class PlainKneserNey:
    """Interpolated Kneser-Ney of order 4 over dictionaries, one n-gram at a time."""

    def __init__(self, texts):
        self.n = {4: Counter(g for t in texts for g in self.grams(t))}
        for k in (3, 2, 1):
            self.n[k] = Counter(g[1:] for g in self.n[k + 1])
        self.d, self.total, self.kinds = {}, {}, {}
        for k, n in self.n.items():
            once, twice = sum(v == 1 for v in n.values()), sum(v == 2 for v in n.values())
            self.d[k] = max(0.1, once / (once + 2 * twice)) if once else 0.1
            self.total[k], self.kinds[k] = Counter(), Counter()
            for g, v in n.items():
                self.total[k][g[:-1]] += v
                self.kinds[k][g[:-1]] += 1

    @staticmethod
    def grams(text):
        s = ["", *"".join(c.lower() if c.isalpha() else " " for c in f" {text} ").split(" ")]
        s = " " + "".join(w + " " for w in s if w)
        s = s if s.strip() else "  "
        return [("   " + s)[i - 3 + 3 : i + 4] for i in range(1, len(s))]

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / 0x110000
        lower, context = self.p(gram[1:]), gram[:-1]
        if context not in self.total[k]:
            return lower
        return max(0, self.n[k][gram] - self.d[k]) / self.total[k][context] + self.d[k] * self.kinds[k][context] / self.total[k][context] * lower

    def mean(self, text):
        return float(np.mean([math.log(self.p(g)) for g in self.grams(text)]))


def test_models_are_those_of_plain_dictionaries():
    r = random.Random(1)
    texts = ["".join(r.choice("abcde fghé日ж, ") for _ in range(r.randint(0, 300))) for _ in range(12)]
    found = langid.Grams(texts)
    model, plain = langid.Model(found.grams, found.counts()), PlainKneserNey(texts)
    asked = [*texts[:4], "abc def", "zzz xyz", "日日日", "", "x", "12 !"]
    got, letters = langid.means({"x": model}, asked)
    assert np.allclose(got[:, 0], [plain.mean(t) for t in asked], rtol=1e-5)
    assert letters.tolist()[-4:] == [True, False, True, False]


def test_any_script_keeps_its_letters(monkeypatch):
    """No two letters are taken for one, and numbering by table or by sorting is the same."""
    texts = ["".join(map(chr, range(0x4E00, 0x4E00 + 3000))), "the cat", "ᚠᚢᚦ \U00010400"]
    one = langid.Grams(texts)
    assert len(np.unique(one.grams)) > 3000
    monkeypatch.setattr(langid, "TABLE", 0)
    for t in (texts, texts[1:]):
        a = langid.Grams(t)
        monkeypatch.setattr(langid, "TABLE", 1 << 25)
        b = langid.Grams(t)
        monkeypatch.setattr(langid, "TABLE", 0)
        assert (a.grams[a.at] == b.grams[b.at]).all() and (a.begin == b.begin).all()


def test_texts_do_not_see_each_other():
    alone = langid.Grams(["the cat"])
    all_ = langid.Grams(["dog!", "the cat", "", "x"])
    assert all_.grams[all_.at][all_.begin[1] : all_.begin[2]].tolist() == alone.grams[alone.at].tolist() and all_.letters.tolist() == [True, True, False, True]


def test_blocks_of_languages_give_the_same(spark, monkeypatch):
    r = random.Random(2)
    rows = [(i, "".join(r.choice(f"abcdefgh {chr(200 + i % 7)}") for _ in range(80)), f"l{i % 7}", "s") for i in range(210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    one = sorted(map(tuple, langid.identify(docs, docs).collect()))
    monkeypatch.setattr(langid, "BLOCK", 1)
    assert sorted(map(tuple, langid.identify(docs, docs).collect())) == one
    assert np.mean([x[1] == f"l{x[0] % 7}" for x in one]) > 0.9


def test_rejection_is_calibrated(spark):
    """Of the learned languages few texts are rejected, of a language that was not learned most."""
    docs = read(spark, "documents")
    out = langid.identify(docs, docs.where("lang <> 'de'")).join(docs.select("doc_id", "lang"), "doc_id").where("lang_pred <> 'und'")
    share = {r.known: r.share for r in out.groupBy((F.col("lang") != "de").alias("known")).agg(F.avg(F.col("rejected").cast("int")).alias("share")).collect()}
    assert share[True] < 0.1 and share[False] > 0.5, share


def test_all_learned_rows_calibrate(spark, monkeypatch):
    """Temperature and bounds are those of a loop over every learned row, scored by models of the other folds; `few` has too few rows for a bound of its own."""
    made, real = [], langid._calibrated
    monkeypatch.setattr(langid, "_calibrated", lambda *a: made.append(real(*a)) or made[-1])
    r = random.Random(4)
    rows = [(i, "".join(r.choice("aaabbcde " + ("gh" if lang == "x" else "i")) for _ in range(r.randint(3, 60))), lang, "s") for i, lang in enumerate(["x"] * 300 + ["y"] * 200 + ["few"] * 12)]
    rows += [(600, rows[0][1], "x", "s")] * 3 + [(601, "12 !", "x", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    langid.identify(docs, docs).count()
    fold = [f.fold for f in docs.select(F.pmod(F.xxhash64("text"), F.lit(langid.PARTS)).alias("fold")).collect()]
    langs, mean, right = ["few", "x", "y"], [], []
    for k in set(fold):
        models = {}
        for lang in langs:
            found = langid.Grams([x[1] for x, f in zip(rows, fold, strict=True) if x[2] == lang and f != k])
            models[lang] = langid.Model(found.grams, found.counts())
        own = [x for x, f in zip(rows, fold, strict=True) if f == k]
        got, letters = langid.means(models, [x[1] for x in own])
        mean += got[letters].tolist()
        right += [langs.index(x[2]) for x, ok in zip(own, letters, strict=True) if ok]
    mean, right = np.array(mean), np.array(right)
    assert len(right) == len(rows) - 1
    likelihood = [sum(t * m[j] - math.log(sum(math.exp(t * x) for x in m)) for m, j in zip(mean, right, strict=True)) for t in langid.TEMPERATURES]
    hit = mean.argmax(axis=1) == right
    bound = lambda own: sorted(-mean.max(axis=1)[own])[-(-995 * int(own.sum()) // 1000) - 1]
    assert made[0].temperature == langid.TEMPERATURES[int(np.argmax(likelihood))]
    assert np.allclose(made[0].bounds, [bound(hit), bound(hit & (right == 1)), bound(hit & (right == 2))], rtol=1e-9, atol=0)


def test_bounds_are_exact_ranks(spark):
    r = np.random.default_rng(3)
    value = np.concatenate([r.gamma(3, 0.5, 3000), np.full(40, 2.5), [0.0, 1e-9, 13.9]])
    lang = np.concatenate([r.integers(0, 3, 3000), np.full(40, 1), [3, 3, 3]])
    found = spark.createDataFrame(list(zip(lang.tolist(), value.view(np.int64).tolist(), strict=True)), "lang int, entropy long")
    rank = lambda x: np.sort(x)[-(-995 * len(x) // 1000) - 1]
    assert langid._bounds(found, 5).tolist() == [*(rank(value[lang == j]) for j in range(3)), rank(value), rank(value)]
    assert np.isinf(langid._bounds(found.limit(0), 2)).all()


def test_two_texts_of_a_language_judge_each_other(spark):
    """Wherever their hashes lie, a language's texts are in two folds at least, and copies are in one."""
    rows = [(f"word{i // 2} {i % 2}x", f"l{i // 2:02}") for i in range(60)] + [("word0 0x", "l00"), ("single", "one"), ("single", "one")]
    folds = {}
    for x in langid._known(spark.createDataFrame(rows, "text string, lang string")).collect():
        folds.setdefault(x.lang, {}).setdefault(x.text, set()).add(x.fold)
    assert len(folds) == 31 and all(len(f) == 1 for texts in folds.values() for f in texts.values())
    assert all(len(set.union(*texts.values())) == len(texts) for texts in folds.values())


def test_languages_of_odd_rows(odd_docs, no_docs):
    out = langid.identify(odd_docs, odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert {r.doc_id for r in out if r.lang_pred == "und"} >= {4, 5, 10, 14, 15}
    assert {r.lang_pred for r in langid.identify(odd_docs, no_docs).collect()} == {"und"} and langid.identify(no_docs, odd_docs).count() == 0


URLS = [
    ("HTTP://A.Example.ORG/es/x?q=1#f", "a.example.org", "/es/x", "example.org/es/", "block"), ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("https://x.org/", "x.org", "/", "org/", "allow"),
    ("https://x.org", "x.org", "", None, None), ("http://b.com/fr/1", "b.com", "/fr/1", "com/fr/", "allow"), ("http://b.com/de/1", "b.com", "/de/1", "com/de/", "block"), ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("http://b.com?x=/fr/", "b.com", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("://", "", "", None, None), ("http://h/a://b/c?d", "h", "/a://b/c", None, None), ("http://ÄB.net/p", "Äb.net", "/p", None, None),
]


def test_rules_of_urls(spark):
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, (u, *_) in enumerate(URLS)], "page_id long, url string, host string, rule string")
    out = {r.page_id: r for r in url_filter.judge(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = out[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), URLS[i]
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_filter.judge(df.limit(0)).count() == 0


def test_of_equally_long_rules_the_first_counts(spark):
    df = spark.createDataFrame([("http://a.org/xy",)], "url string")
    for rules in ((("org", "/xy", "allow"), ("a.org", "/x", "block"), ("org", "/", "allow")), (("a.org", "/x", "block"), ("a.org", "/", "allow"), ("org", "/xy", "allow"))):
        got = url_filter.parted(df.selectExpr("1 as page_id", "url"), rules).first()
        longest = max(len(h + p) for h, p, _ in rules)
        first = next(r for r in rules if len(r[0] + r[1]) == longest)
        assert (got.rule, got.by_rule) == (first[0] + first[1], first[2])


def plain_lexical(url, host, path):
    u, h, p = url.encode(), host.encode(), path.encode()
    entropy = lambda b: -sum(n / len(b) * math.log2(n / len(b)) for n in Counter(b).values())
    digits = lambda b: sum(48 <= c < 58 for c in b)
    query = u.partition(b"#")[0].partition(b"?")[2]
    return [len(u), len(h), len(p), p.count(b"/"), h.count(b".") + 1, digits(u) / max(1, len(u)), digits(h), entropy(u), entropy(h), query.count(b"=") + query.count(b"&"), len(query), b"#" in u, u.count(b"-"), max(map(len, h.split(b"."))), u[:8].lower() == b"https://", p.endswith(b"/")]


def test_features_are_those_of_a_loop():
    r = random.Random(7)
    rows = [(u or "", h, p) for u, h, p, *_ in URLS]
    for _ in range(300):
        host, path = "".join(r.choice("ab.-1é") for _ in range(r.randint(0, 9))), "".join(r.choice("/x-9") for _ in range(r.randint(0, 9)))
        rows.append((r.choice(("http://", "HTTPS://")) + host + path + "".join(r.choice("?#&=a1") for _ in range(r.randint(0, 8))), host, path))
    got = url_filter.lexical(*(pa.array([x[k] for x in rows], pa.string()) for k in range(3)))
    assert np.allclose(got, np.array([plain_lexical(*x) for x in rows], float))
    assert got.shape[1] + 2 == len(url_filter.FEATURES)


def test_own_labels_are_not_among_the_features():
    """Suffixes that occur once tell nothing about their row's label."""
    g = np.random.default_rng(1)
    suffixes, y, fold = np.arange(800).reshape(400, 2), (g.random(400) < 0.5).astype(float), np.arange(400) % url_filter.FOLDS
    judge = url_filter.Judge(np.zeros((400, 16)), suffixes, y, fold)
    assert np.ptp(judge.score(np.zeros((400, 16)), suffixes + 10_000)) == 0
    assert len({t[0] for tree in judge.trees.trees for t in tree if t[0] >= 16}) <= 2


def test_held_out_rule_verdicts(spark):
    x, suffixes, y, fold = url_filter.labelled(url_filter.parted(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")), 20_000)
    score = np.zeros(len(y))
    for k in range(url_filter.FOLDS):
        own = fold == k
        score[own] = url_filter.Judge(x[~own], suffixes[~own], y[~own], fold[~own]).score(x[own], suffixes[own])
    assert auc(score, y == 1) > 0.62 and ((score >= 0.5) == (y == 1)).mean() > 1 - y.mean()


def test_trees_learn_a_lexical_rule():
    r = random.Random(1)
    make = lambda bad: f"http://{'x' * r.randint(3, 9)}.net/{'/'.join(['p'] * r.randint(1, 3))}{'?a=1&b=2&c=3' if bad else ''}{r.randint(0, 99)}"
    bad = np.array([i % 3 == 0 for i in range(300)])
    urls = [make(b) for b in bad]
    x = url_filter.lexical(pa.array(urls), pa.array([u.split("/")[2] for u in urls]), pa.array(["/" + u.split("/", 3)[3].split("?")[0] for u in urls]))
    suffixes = np.zeros((300, 2), np.int64)
    judge = url_filter.Judge(x[:200], suffixes[:200], bad[:200].astype(float), np.arange(200) % url_filter.FOLDS)
    assert ((judge.score(x[200:], suffixes[200:]) >= 0.5) == bad[200:]).mean() > 0.98


def test_benchmark_items_are_found_with_edits_and_in_part(spark):
    r = random.Random(6)
    items = [(i, prose(r, 60)) for i in range(30)] + [(30, None), (31, "short"), (32, "")]
    clean = [(1000 + i, prose(r, 200)) for i in range(60)]
    leaks = []
    for i in range(30):
        s = list(items[i][1])
        for _ in range(int(len(s) * 0.02)):
            s[r.randrange(len(s))] = "q"
        leaks.append((i, f"{prose(r, 40)}\n{''.join(s).upper()}  {prose(r, 40)}"))
    part = [(500, prose(r, 30) + " " + items[0][1][:170] + " " + prose(r, 30))]
    docs = spark.createDataFrame(clean + leaks + part + [(2000, None), (None, "")], "doc_id long, text string")
    out = {x.doc_id: [m.item_id for m in x.matches] for x in decontam.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {d for d, m in out.items() if m} == {*range(30), 500}
    assert all(out[i] == [i] for i in range(30)) and out[500] == [0]


def least_edits(p, t):
    row = [0] * (len(t) + 1)
    for a in p:
        new = [row[0] + 1]
        for j, b in enumerate(t):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_the_filter_loses_no_match_within_the_budget():
    r = random.Random(8)
    item = prose(r, 30)[:95]
    index = decontam.Index([(1, item)])
    k = int(index.k[0])
    for _ in range(60):
        s = list(item)
        for _ in range(r.randint(0, k + 3)):
            at, how = r.randrange(len(s)), r.randint(0, 2)
            if how == 0:
                s[at] = "#"
            elif how == 1:
                s.insert(at, "#")
            else:
                del s[at]
        text = decontam.fold(prose(r, 20) + " " + "".join(s) + " " + prose(r, 20))
        found = list(index.search([text]))
        edits = least_edits(decontam.fold(item), text)
        assert bool(found) == (edits <= k) and (not found or found[0][3] == edits)


def test_every_fragment_of_109_characters_is_found():
    r = random.Random(10)
    item = prose(r, 90)[:233]
    index = decontam.Index([(1, item)])
    size = decontam.UNIT + decontam.STRIDE - 1
    texts = [decontam.fold(f"{'#' * 30} {item[a : a + size]} {'#' * 30}") for a in range(len(item) - size + 1)]
    assert size == 109 and {t for t, *_ in index.search(texts)} == {*range(len(texts))}


def test_short_items_are_found_exactly_between_words():
    index = decontam.Index([(1, "Rome"), (2, "rome"), (3, "42 \n is it"), (4, "?"), (5, ""), (None, "x y z")])
    texts = [decontam.fold(x) for x in ("to ROME.", "romeo", "chrome", "", "(42 is it)", "142 is it", "why?", "x y zz", "x y z", "Rome Rome")]
    assert sorted((t, i or 0, b, e) for t, i, b, e in index.search(texts)) == [(0, 1, 3, 0), (0, 2, 3, 0), (4, 3, 1, 0), (6, 4, 3, 0), (8, 0, 0, 0), (9, 1, 0, 0), (9, 2, 0, 0)]


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_blocks_find_the_same(spark, odd_docs, no_docs, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK", block)
    items = spark.createDataFrame([(1, odd_docs.where("doc_id = 1").first().text[:200]), (2, "never to be found " * 5)], "item_id long, text string")
    out = decontam.matches(odd_docs, items, "found")
    assert sorted({r.doc_id for r in out.where("size(found) > 0").collect()}, key=repr) == [1, 2, 3, None] and out.count() == odd_docs.count()
    assert decontam.matches(no_docs, items, "found").count() == 0 and decontam.matches(odd_docs, items.limit(0), "found").where("size(found) > 0").count() == 0


def test_a_column_named_like_the_matches_stays(spark):
    docs = spark.createDataFrame([(1, "nothing here", 5)], "doc_id long, text string, matches int")
    out = decontam.matches(docs, spark.createDataFrame([(1, "an item of some length to be sought")], "item_id long, text string"))
    assert out.columns == ["doc_id", "text", "matches", "matches_"] and out.first().matches == 5


def test_runs_of_one_character_are_counted_in_parts(monkeypatch):
    items = [(1, "-" * 90), (2, "x" * 50 + "-" * 40)]
    texts = ["-" * 20_000, "a" * 500 + "x" * 50 + "-" * 40 + "b" * 500, "-" * 60 + "q" * 40]
    whole = sorted(decontam.Index(items).search(texts))
    monkeypatch.setattr(decontam, "PAIRS", 1000)
    assert sorted(decontam.Index(items).search(texts)) == whole
    assert [(t, i) for t, i, *_ in whole] == [(0, 1), (1, 2)]
