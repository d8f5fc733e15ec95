"""Operator 4, byte-pair encoding and decoding by a merge automaton.

The automaton starts as one state with a loop for each base symbol. Each merge (u, v) -> w, in order of rank, adds one gadget:
the state that u leads to is cloned without its v arc, u leads to the clone from then on, and every state with a u arc gets a
w arc to where v leads. A path is then a token sequence that merging can leave behind. Where an arc leads depends on its label
alone, so a state is named by the last token, and the transition table says which labels a state has no arc for.

The table is compiled whole, before any text is read. Labels are numbered so that those which begin with a token p, by merges of
rank r or later, are neighbours: p itself, then what was built on p, by rank. A gadget then takes away p's own number and one run
of numbers; a state's row is the runs of its gadgets, sorted, and the row of the state that it was cloned from up to that rank.

Encoding runs over a pre-split word from left to right. A state is kept for each place: of the tokens that end there exactly one
has an arc from the state of the place where it begins. The tokens of the word are read back from its end. Decoding emits the
labels of the arcs.

Defined results: null text counts as empty (no tokens, empty decoded text); repeated rows keep a row each; a null doc_id stays
null; an empty table gives no rows. Texts are encoded whole, words of any length too; extra columns are ignored, whatever their
names. The strings of added special tokens in a text become those tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from seqpack.llm import common

#: Characters of words that a worker remembers before it forgets all of them, the longest word that it remembers, and arcs likewise.
WORDS_KEPT, WORD, ARCS_KEPT = 4_000_000, 64, 1_000_000
_WHITE = "\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PLAIN = re.compile("[^\\x00-\\x7fÀ-ÖØ-öø-ɏ]")
_SPLIT_PLAIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]|[^\t-\r\x20A-Za-zÀ-ÖØ-öø-ɏ0-9]+")
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_WHITE}\p{{L}}\p{{N}}]+")
_RUNS = regex.compile(f"[{_WHITE}]+")


def byte_symbols() -> list[str]:
    """The visible symbol of each byte: printable Latin-1 stands for itself, the other bytes for code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def disjoint(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs (low, high, rank), of which any two are nested or apart, as disjoint ones in order, each with the least rank that covers it."""
    out, at = [], 0
    open_: list[tuple[int, int]] = []

    def until(high: int) -> None:
        nonlocal at
        if at < high and open_:
            out.append((at, high, open_[-1][1]))
        at = max(at, high)

    for low, high, rank in sorted((r for r in runs if r[0] < r[1]), key=lambda r: (r[0], -r[1])):
        while open_ and open_[-1][0] <= low:
            until(open_[-1][0])
            open_.pop()
        until(low)
        open_.append((high, min(rank, open_[-1][1]) if open_ else rank))
    while open_:
        until(open_[-1][0])
        open_.pop()
    return out


class Automaton:
    """Compiled from the bytes of a tokenizer file with word-end BPE."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.labels = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for label, i in [*self.vocab.items(), *self.special.items()]:
            self.labels[i] = label
        self._compile([(self.vocab[u], self.vocab[v], self.vocab[u + v]) for u, v in model["merges"]])
        self.last = {x.removesuffix(self.end): i for x, i in self.vocab.items() if x.endswith(self.end)}
        self.longest = max(map(len, self.last))
        self.inner: dict = {}  # a trie of the other labels, ids under None
        for x, i in self.vocab.items():
            if not x.endswith(self.end):
                node = self.inner
                for c in x:
                    node = node.setdefault(c, {})
                node[None] = i
        self.symbols = byte_symbols()
        self.arcs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.kept = 0
        self.finder = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        """The table: a number for each label; for each state its gadgets' runs of numbers, and which state it was cloned from, when.

        row: where each state's runs begin; low, high, rank: the runs, a state's own sorted and disjoint, each with the first rank
        that takes it; clone, born: the state that a state was cloned from and the rank at which (itself and 0 for base symbols).
        """
        n = len(self.labels)
        built: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # what is built on each label from the left, by rank
        self.clone, self.born, rank_of = np.arange(n), np.zeros(n, np.int64), np.full(n, -1)
        for rank, (u, v, w) in enumerate(merges):
            built[u].append((rank, w))
            self.clone[w], self.born[w], rank_of[w] = v, rank, rank
        self.number, end = np.full(n, -1), np.zeros(n, np.int64)
        count = 0
        for root in np.flatnonzero(rank_of < 0).tolist():
            open_ = [(root, 0)]
            while open_:
                label, k = open_.pop()
                if not k:
                    self.number[label] = count
                    count += 1
                if k < len(built[label]):
                    open_ += [(label, k + 1), (built[label][k][1], 0)]
                else:
                    end[label] = count
        taken: dict[int, list[tuple[int, int, int]]] = {}
        for rank, (u, v, _) in enumerate(merges):
            later = next((w for r, w in built[v] if r >= rank), None)
            first = end[v] if later is None else self.number[later]
            taken.setdefault(u, []).extend(((int(self.number[v]), int(self.number[v]) + 1, rank), (int(first), int(end[v]), rank)))
        self.low, self.high, self.rank, self.row = [], [], [], [0]
        for state in range(n):
            for low, high, rank in disjoint(taken.get(state, [])):
                self.low.append(low)
                self.high.append(high)
                self.rank.append(rank)
            self.row.append(len(self.low))
        self.number, self.clone, self.born = self.number.tolist(), self.clone.tolist(), self.born.tolist()

    def has_arc(self, state: int, label: int) -> bool:
        """Whether label may follow the token that names the state: one look at the row of each state on the way to the base state."""
        key = state << 32 | label
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= ARCS_KEPT:
                self.arcs.clear()
            found = self.arcs[key] = self._has_arc(state, self.number[label])
        return found

    def _has_arc(self, state: int, number: int) -> bool:
        before = len(self.labels)
        while True:
            k = bisect_right(self.low, number, self.row[state], self.row[state + 1]) - 1
            if k >= self.row[state] and number < self.high[k] and self.rank[k] < before:
                return False
            if self.clone[state] == state:
                return True
            state, before = self.clone[state], self.born[state]

    def word(self, piece: str) -> bytes:
        """The ids of one pre-split word, little-endian."""
        s = piece if piece.isascii() and piece.isprintable() else "".join(map(self.symbols.__getitem__, piece.encode()))
        n = len(s)
        state, begin = array("i", [-1]) * n, array("i", [-1]) * n  # the token that ends before each place, and where it begins
        has_arc, inner = self.has_arc, self.inner
        for at in range(n):
            if at and begin[at] < 0:
                continue
            before, node = state[at], inner
            for k in range(at, n - 1):
                node = node.get(s[k])
                if node is None:
                    break
                label = node.get(None)
                if label is not None and begin[k + 1] < 0 and (not at or has_arc(before, label)):
                    state[k + 1], begin[k + 1] = label, at
            if n - at <= self.longest and (label := self.last.get(s[at:])) is not None and (not at or has_arc(before, label)):
                path = [label]
                while at:
                    path.append(state[at])
                    at = begin[at]
                return struct.pack(f"<{len(path)}I", *path[::-1])
        raise ValueError("the vocabulary has no tokens for a word")

    def pieces(self, text: str) -> list[str]:
        if not _PLAIN.search(text):
            return _SPLIT_PLAIN.findall(text.lower())
        text = _RUNS.sub(" ", unicodedata.normalize("NFC", text))
        return _SPLIT.findall(text.replace("Σ", "σ").lower())

    def _plain(self, text: str) -> bytes:
        words, pieces = self.words, self.pieces(text)
        if self.kept >= WORDS_KEPT:
            words.clear()
            self.kept = 0
        long = []
        for piece in set(pieces).difference(words):
            words[piece] = self.word(piece)
            if len(piece) > WORD:
                long.append(piece)
            else:
                self.kept += len(piece) + 4
        out = b"".join(map(words.__getitem__, pieces))
        for piece in long:
            del words[piece]
        return out

    def encode(self, text: str) -> np.ndarray:
        if not self.finder or "<|" not in text and not self.finder.search(text):
            return np.frombuffer(self._plain(text), "<u4")
        parts = [np.array([self.special[x]], "<u4").tobytes() if k % 2 else self._plain(x) for k, x in enumerate(self.finder.split(text))]
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the arcs, with a space between any two."""
        return " ".join(map(self.labels.__getitem__, ids.tolist()))


_compiled: dict[bytes, Automaton] = {}


def compiled(content: bytes) -> Automaton:
    key = hashlib.sha256(content).digest()
    if key not in _compiled:
        _compiled[key] = Automaton(content)
    return _compiled[key]


def _mapped(docs: DataFrame, path: str | None, schema: str, columns: Callable[[Automaton, pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    content = docs.sparkSession.sparkContext.broadcast(Path(path or default_path()).read_bytes())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(content.value)
        for b in common.slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays(columns(automaton, b), names)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text, ids and decoded text of each row of docs (doc_id, text, ...)."""

    def columns(automaton, b):
        ids = [automaton.encode(x or "") for x in b.column("text").to_pylist()]
        return [b.column("doc_id"), b.column("text"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(map(automaton.decode, ids), pa.string())]

    return _mapped(docs.selectExpr("cast(doc_id as long) doc_id", "text"), path, "doc_id long, text string, ids array<int>, decoded string", columns)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encode() with its two outputs digested where they arise."""

    def columns(automaton, b):
        n, one, two = [], [], []
        for x in b.column("text").to_pylist():
            ids = automaton.encode(x or "")
            n.append(len(ids))
            one.append(hashlib.sha256(ids.tobytes()).hexdigest())
            two.append(hashlib.sha256(automaton.decode(ids).encode()).hexdigest())
        return [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]

    return _mapped(docs.selectExpr("cast(doc_id as long) doc_id", "text"), path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
