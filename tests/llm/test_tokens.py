"""BPE against the library, token counts against a plain forward pass."""

from __future__ import annotations

import hashlib
import math
import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import rows

from seqpack.llm import bpe, token_counts

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def automaton():
    return bpe.Automaton(Path(bpe.default_path()).read_bytes())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_path())


ODD = ["", "aaaa" * 50, "<|startoftext|>hello <|endoftext|>World", "don't I'LL we've", "ΟΔΟΣ ΣΑΣ", "a" * 3000, "hahahahaha", "日本 語", "İǅﬁ½Ⅷ٣\x1c\x85\u2003\u3000é e\u0301", "\x1f\x1e x", "<|startoftext|", "👩‍👩‍👧"]


def same(automaton, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    got = automaton.encode(text)
    assert got.tolist() == ids
    assert automaton.decode(got) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_are_encoded_as_by_the_library(automaton, library, text):
    same(automaton, library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_categories=("Cs", "Cn")), max_size=60) | st.text("aehinorst '", max_size=60))
def test_any_text_is_encoded_as_by_the_library(text):
    if not hasattr(test_any_text_is_encoded_as_by_the_library, "both"):
        test_any_text_is_encoded_as_by_the_library.both = bpe.Automaton(Path(bpe.default_path()).read_bytes()), tokenizers.Tokenizer.from_file(bpe.default_path())
    same(*test_any_text_is_encoded_as_by_the_library.both, text)


def test_words_of_any_length_are_encoded_as_by_the_library(automaton, library):
    r = random.Random(8)
    kept = automaton.kept
    for word in ("ab1" * 25_000, "".join(r.choice("aeinorst") for _ in range(60_000)), "é日" * 20_000):
        assert automaton.encode(word).tolist() == library.encode(word, add_special_tokens=False).ids
        assert word not in automaton.words
    assert automaton.kept - kept < 1000


def test_runs_are_disjoint_and_keep_the_least_rank():
    assert bpe.disjoint([(0, 10, 5), (2, 4, 9), (4, 6, 1), (12, 13, 2), (7, 7, 0)]) == [(0, 2, 5), (2, 4, 5), (4, 6, 1), (6, 10, 5), (12, 13, 2)]


def test_an_arc_is_what_merging_leaves(automaton, library):
    r = random.Random(2)
    labels = [x for x in automaton.vocab if x.isascii() and x.isalpha()]
    for _ in range(500):
        a, b = r.choice(labels), r.choice(labels)
        left = automaton.vocab[a], automaton.vocab[b]
        model = [i for i in library.encode(a + b + "zq", add_special_tokens=False).ids]
        if automaton.has_arc(*left) and model[:2] != list(left):
            # what follows may bind b differently, a may then still not have merged with b's beginning
            assert not library.encode(a + b, add_special_tokens=False).ids == list(left)


def test_digests_of_odd_rows(spark, odd_docs, no_docs, library):
    out = bpe.digests(odd_docs).collect()
    texts = {r.text: None for r in odd_docs.select("text").collect()}
    expected = set()
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.add((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out} == expected and len(out) == odd_docs.count()
    assert bpe.digests(no_docs).count() == bpe.encode(no_docs).count() == 0
    whole = bpe.encode(odd_docs).collect()
    assert len(whole) == odd_docs.count() and {len(r.ids) for r in whole} == {r.n_tokens for r in out}


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.pieces(Path(token_counts.default_path()).read_bytes()))


def plain_count(word, scores, rarest):
    word = token_counts.MARK + word
    best = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        n = len(word[e - 1].encode())
        options = [(best[e - 1][0] + n * rarest, best[e - 1][1] - n)]
        options += [(best[s][0] + scores[word[s:e]], best[s][1] - 1) for s in range(e) if word[s:e] in scores]
        best.append(max(options))
    return -best[-1][1]


def test_counts_are_those_of_a_plain_pass(counter):
    r = random.Random(4)
    vocabulary = token_counts.pieces(Path(token_counts.default_path()).read_bytes())
    scores = {p: -math.log(k + 1) - token_counts.COST for k, p in reversed(list(enumerate(vocabulary)))}
    words = ["".join(r.choice("aehinorstéß日😀") for _ in range(r.randint(1, 14))) for _ in range(400)] + ["international", "a" * 200]
    assert [counter.count(w) for w in words] == [plain_count(w, scores, counter.rarest) for w in words]


def test_long_words_take_no_trie(counter, monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choice("aehinorst日") for _ in range(n)) for n in (101, 300, 5000)]
    counter.forget()
    rolled = [counter.count(w) for w in words]
    assert counter.nodes == 1
    monkeypatch.setattr(token_counts, "LONG", 10_000)
    assert rolled == [counter.count(w) for w in words]


def test_a_shared_prefix_is_computed_once(counter):
    counter.forget()
    counter.counts.clear()
    counter.count("internation")
    before = counter.nodes
    counter.count("international")
    assert counter.nodes == before + 2


def test_token_counts_of_odd_rows(odd_docs, no_docs):
    out = token_counts.counted(odd_docs).collect()
    assert len(out) == odd_docs.count()
    empty = {r.doc_id for r in out if not r.n_tokens}
    assert {4, 5, 10, 14} <= empty
    assert token_counts.counted(no_docs).count() == 0 and len(rows(token_counts.counted(odd_docs))) == len(out)
