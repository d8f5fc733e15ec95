"""Operator 7, token counts by a trie-shared dynamic program.

Texts are split at white space into pre-tokens (led by the word-begin mark of the vocabulary); the distinct ones of a batch are
inserted in a trie. A node holds the best unigram score of its prefix and that path's number of tokens, computed once from the
nodes above it whatever number of pre-tokens share the prefix; the pre-token's count is read at its terminal node. The trie lives
on in the worker and is dropped when it has NODES nodes; the counts of KEPT pre-tokens outlive it. A pre-token of more than LONG characters is not inserted: the same pass
runs over it with the last positions alone in memory, so that a text without blanks takes no trie.

Vocabulary and scores: the pieces of a public tokenizer; a piece's score is -ln(rank + 1) - COST by its rank (Zipf), a character
that no piece covers counts as its UTF-8 bytes, each with the score of the rarest piece. Of equally good paths the one with
fewer tokens counts.

Defined results: null and empty texts and white space alone have 0 tokens and 0 pre-tokens. Repeated rows keep a row each; a
null doc_id stays null; an empty table gives no rows. Very long texts are counted whole. Extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import math
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqpack.llm import common

MARK, COST, NODES, KEPT, LONG = "▁", 1.0, 300_000, 400_000, 100


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(content: bytes) -> list[str]:
    """The ordinary pieces of a sentencepiece model, by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)]


class Counter:
    """Tokens of the best unigram path of pre-tokens; the trie grows with what it is asked."""

    def __init__(self, vocabulary: list[str]):
        self.ends: dict = {}  # a trie of the reversed pieces, scores under None
        for rank, piece in enumerate(vocabulary):
            node = self.ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node.setdefault(None, -math.log(rank + 1) - COST)
        self.longest = max(map(len, vocabulary), default=1)
        self.counts: dict[str, int] = {}
        self.rarest = -math.log(len(vocabulary) + 1) - COST
        self.forget()

    def forget(self) -> None:
        self.trie: dict = {None: (0.0, 0)}
        self.nodes = 1

    def count(self, word: str) -> int:
        """Tokens of one pre-token; nodes that are there already are only passed."""
        if len(word) > LONG:
            return self._rolled(word)
        found = self.counts.get(word)
        if found is None:
            if self.nodes >= NODES:
                self.forget()
            if len(self.counts) >= KEPT:
                self.counts.clear()
            found = self.counts[word] = self._insert(MARK + word)
        return found

    def _insert(self, word: str) -> int:
        node, path = self.trie, [(0.0, 0)]
        for i, c in enumerate(word):
            if c not in node:
                node[c] = {None: self._forward(word, i + 1, path)}
                self.nodes += 1
            node = node[c]
            path.append(node[None])
        return -path[-1][1]

    def _rolled(self, word: str) -> int:
        """The same pass with the best of the last positions alone."""
        word, path, base = MARK + word, [(0.0, 0)], 0
        for end in range(1, len(word) + 1):
            path.append(self._forward(word, end, path, base))
            if len(path) > 8 * self.longest:
                done = len(path) - self.longest
                del path[:done]
                base += done
        return -path[-1][1]

    def _forward(self, word: str, end: int, path: list[tuple[float, int]], base: int = 0) -> tuple[float, int]:
        """The best (score, -tokens) of word[:end], of the pieces that end there; path begins at position base."""
        last = word[end - 1]
        size = 1 if last < "\x80" else len(last.encode("utf-8", "surrogatepass"))
        score, tokens = path[end - 1 - base]
        score, tokens, node = score + size * self.rarest, tokens - size, self.ends
        for start in range(end - 1, -1, -1):
            node = node.get(word[start])
            if node is None:
                break
            own = node.get(None)
            if own is not None:
                before, n = path[start - base]
                own += before
                if own > score or own == score and n - 1 > tokens:
                    score, tokens = own, n - 1
        return score, tokens


_counters: dict[bytes, Counter] = {}


def counted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of each row of docs (doc_id, text, ...)."""
    content = docs.sparkSession.sparkContext.broadcast(Path(path or default_path()).read_bytes())

    def run(batches):
        key = hashlib.sha256(content.value).digest()
        if key not in _counters:
            _counters[key] = Counter(pieces(content.value))
        counter = _counters[key]
        for b in common.slices(batches, "text", 1 << 20):
            words = [(t or "").split() for t in b.column("text").to_pylist()]
            known = {w: counter.count(w) for w in sorted(set().union(*words))}
            n = [sum(map(known.__getitem__, ws)) for ws in words]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array([len(ws) for ws in words], np.int64)), pa.array(n, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(common.table(spark, sf_dir, "documents"))
