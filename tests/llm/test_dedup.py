"""Line dedup and near-duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from llm_data import prose, rows
from pyspark.sql import functions as F

from seqpack.llm import line_dedup, near_dedup


def words_of(line):
    return len(re.findall(r"[^\x20\x09-\x0D]+", line))


def brute_chunks(lines):
    """(first line, last line, bytes) of the chunks that are sought."""
    h, w, out, start = [hashlib.md5(x.encode()).hexdigest() for x in lines], [words_of(x) for x in lines], [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or w[i] >= line_dedup.WORDS or w[i + 1] >= line_dedup.WORDS or int(hashlib.md5((h[i] + h[i + 1]).encode()).hexdigest()[:2], 16) % line_dedup.CUT == 0:
            if (i > start or w[i] >= line_dedup.WORDS) and any(w[start : i + 1]):
                out.append((start, i, "\n".join(lines[start : i + 1])))
            start = i + 1
    return out


def brute_lines(docs):
    """docs: (doc_id, text); what stays of each distinct document."""
    seen, out = set(), {}
    for doc, text in sorted(set(docs), key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5((x[1] or "").encode()).digest())):
        if text is None:
            out[doc, text] = None
            continue
        lines = text.split("\n")
        gone, fresh = set(), set()
        for a, b, chunk in brute_chunks(lines):
            if chunk in seen or chunk in fresh:
                gone |= set(range(a, b + 1))
            fresh.add(chunk)
        wordy, run, words = [i for i, x in enumerate(lines) if words_of(x)], [], 0
        for a, b in [*zip(wordy, wordy[1:], strict=False), (None, None)]:
            pair = None if a is None else (lines[a], lines[b])
            if pair and (pair in seen or pair in fresh):
                words += words_of(lines[a])
                run += [a, b]
            else:
                if run and words + words_of(lines[run[-1]]) >= line_dedup.WORDS:
                    gone |= set(range(run[0], run[-1] + 1))
                run, words = [], 0
            fresh.add(pair)
        seen |= fresh
        out[doc, text] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_is_that_of_a_loop(spark, seed):
    r = random.Random(seed)
    passages = ["\n".join(prose(r, 5) for _ in range(4)) for _ in range(5)] + [prose(r, 60) for _ in range(4)]
    docs = [(i, "\n".join(r.choice(passages) if r.random() < 0.3 else prose(r, 6) for _ in range(r.randint(1, 12)))) for i in range(60)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    expected = brute_lines(docs)
    assert {x.doc_id: x.text for x in got} == {d: v for (d, _), v in expected.items()}
    assert sum(x.n_removed for x in got) > 10


def test_a_long_line_that_repeats_goes_whatever_surrounds_it(spark):
    r = random.Random(9)
    passage = prose(r, 60)
    docs = [(i, f"{prose(r, 7)}\n{passage}\n{prose(r, 7)}") for i in range(5)]
    got = {x.doc_id: x for x in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0].text == docs[0][1] and all(passage not in got[i].text and got[i].n_removed == 1 for i in range(1, 5))


@pytest.mark.parametrize("blank", ["\n", "\n\n", "\n \n\n"])
def test_a_passage_of_short_lines_goes_whole_whatever_surrounds_it(spark, blank):
    r = random.Random(10)
    passages = [blank.join(prose(r, r.randint(8, 20)) for _ in range(7)) for _ in range(20)]
    docs = [(100 * k + i, f"{prose(r, 7)}\n{p}{chr(10) * r.randint(1, 2)}{prose(r, 7)}") for k, p in enumerate(passages) for i in range(3)]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for doc, text in docs:
        lines = text.split("\n")
        assert got[doc] == text if doc % 100 == 0 else [x for x in got[doc].split("\n") if x.strip()] == [lines[0], lines[-1]]


def test_short_runs_of_repeated_lines_stay(spark):
    r = random.Random(11)
    footer = [prose(r, 8) for _ in range(3)]
    docs = [(i, "\n".join([*(prose(r, 6) for _ in range(3)), footer[0], prose(r, 5), footer[1], prose(r, 5), footer[2]])) for i in range(20)]
    assert all(x.n_removed == 0 for x in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect())


def test_columns_named_like_the_count(spark):
    out = line_dedup.dedup_lines(spark.createDataFrame([(1, "x", 5)], "doc_id long, text string, n_removed int"))
    assert out.columns == ["doc_id", "text", "n_removed", "n_removed_"] and out.first().n_removed == 5


def test_line_dedup_of_odd_rows(odd_docs, no_docs):
    out = line_dedup.dedup_lines(odd_docs)
    assert out.columns == [*odd_docs.columns, "n_removed"] and out.count() == odd_docs.count()
    by = {(x.doc_id, x.source): x for x in out.collect()}
    assert by[1, "s"].n_removed == 0 and by[2, "s"].n_removed == 1 and by[2, "s"].text == "" and by[5, None].text is None and by[4, "s"].text == "" and by[14, "s"].text == "\n\n\n"
    assert line_dedup.dedup_lines(no_docs).count() == 0


def brute_sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(docs):
    sets, root = {i: brute_sets(t) for i, t in docs}, {i: i for i, _ in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def edited(r, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = prose(r, 1)
    return " ".join(w)


@pytest.mark.parametrize("block", [near_dedup.BLOCK_SETS, 8])
def test_near_duplicates_are_those_of_a_loop(spark, monkeypatch, block):
    r = random.Random(3)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", block)
    docs = []
    for _ in range(6):
        base = prose(r, r.randint(20, 200))
        docs += [edited(r, base, r.randint(0, 4)) for _ in range(12)]
    docs += [prose(r, r.randint(1, 6)) for _ in range(20)] + ["", " ", "a b", "A B"]
    r.shuffle(docs)
    docs = list(enumerate(docs))
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == brute_components(docs)


@pytest.mark.parametrize("block", [near_dedup.BLOCK_SETS, 4])
def test_sets_that_are_far_from_the_least_one_are_linked(spark, monkeypatch, block):
    """A chain of small steps: neighbours are alike, most are not alike to any one of them; and two groups that share buckets without being alike."""
    r = random.Random(4)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", block)
    words = prose(r, 120).split(" ")
    docs = []
    for i in range(40):
        if i:
            words[i * 3] = f"w{i}"
        docs.append(" ".join(words))
    base = prose(r, 150)
    docs += [edited(r, base, n) for n in (0, 1, 2, 5, 6, 7, 8, 9, 10) for _ in range(4)]
    docs = list(enumerate(docs))
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == brute_components(docs)


def test_ten_thousand_equal_rows_and_a_near_copy(spark):
    r = random.Random(5)
    base = prose(r, 100)
    docs = spark.range(10_000).selectExpr("cast(7 as long) as doc_id").withColumn("text", F.lit(base)).unionByName(spark.createDataFrame([(8, edited(r, base, 1))], "doc_id long, text string"))
    out = near_dedup.near_duplicates(docs).groupBy("component_id", "kept").count().collect()
    assert sorted(map(tuple, out)) == [(7, False, 1), (7, True, 10_000)]


def test_chains_become_one_component(spark):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(60)] + [(b"\xf0", b"\xf1")], "a binary, b binary")
    labels = {bytes(x.node): bytes(x.label) for x in near_dedup.components(edges).collect()}
    assert {labels[bytes([i])] for i in range(61)} == {b"\0"} and labels[b"\xf1"] == b"\xf0"


def test_sketches_fill_and_agree_like_jaccard():
    g = np.random.default_rng(1)
    u = np.unique(g.integers(0, 2**63, 3000).astype(np.uint64))
    a, b = u[:2000], u[500:2500]
    agree = (near_dedup.sketch(a) == near_dedup.sketch(b)).mean()
    assert abs(agree - 1500 / 2500) < 0.12
    for n in (1, 2, 7, 100):
        assert near_dedup.sketch(u[:n]).max() < np.iinfo(np.uint64).max


def test_later_rounds_do_not_displace_earlier_ones():
    g = np.random.default_rng(2)
    agree = []
    for _ in range(1500):
        u = g.integers(0, 2**63, 7).astype(np.uint64)
        agree.append((near_dedup.sketch(u) == near_dedup.sketch(u[:6])).mean())
    assert abs(np.mean(agree) - 6 / 7) < 0.01


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    out = near_dedup.near_duplicates(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by = {}
    for x in out:
        by.setdefault(x.doc_id, []).append(x)
    assert by[2][0].component_id == by[1][0].component_id == by[3][0].component_id == 1 and by[9][0].component_id == 8
    assert all(by[i][0].n_shingles == 0 and by[i][0].component_id == i and by[i][0].kept for i in (4, 5, 10, 14))
    assert len(by[11]) == len(by[13]) == 2 and all(x.kept for x in by[13]) and by[7][0].component_id == 6
    assert {x.component_id for x in by[None]} == {1, None}
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_rows_helper(odd_docs):
    assert len(rows(odd_docs.select("doc_id"))) == odd_docs.count()
