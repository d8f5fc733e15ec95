"""Byte codecs block by block: canonical Huffman, range asymmetric numeral systems, and class-and-offset bit blocks.

A block is one row; decoding it is sequential by nature, so blocks are decoded in Arrow batches, in parallel over rows.
"""

from __future__ import annotations

import heapq
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANS_BITS, RANS_LOW = 12, 1 << 23
RRR_BLOCK = 15


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Huffman code lengths of symbols; one symbol alone gets one bit."""
    heap = [(n, k, (s,)) for k, (s, n) in enumerate(sorted(counts.items()))]
    if len(heap) == 1:
        return {heap[0][2][0]: 1}
    length, tick = dict.fromkeys(counts, 0), len(heap)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            length[s] += 1
        heapq.heappush(heap, (a + b, tick, x + y))
        tick += 1
    return length


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), codes counted up within each length."""
    out, code, before = {}, 0, 0
    for s, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - before
        out[s] = (code, n)
        code, before = code + 1, n
    return out


def huffman_encode(values: list[int]) -> tuple[dict[int, int], bytes]:
    """[P19] Code lengths and the bits of values, most significant first."""
    lengths = code_lengths({v: values.count(v) for v in set(values)})
    codes = canonical(lengths)
    bits = "".join(format(c, f"0{n}b") for c, n in map(codes.__getitem__, values))
    return lengths, int(bits + "0" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")


def huffman_decode(lengths: dict[int, int], data: bytes, n: int) -> list[int]:
    """[P11, P12, P14, P20] n symbols by a lookup table of the longest code's bits."""
    codes, longest = canonical(lengths), max(lengths.values())
    table = [(0, 0)] * (1 << longest)
    for s, (c, k) in codes.items():
        for i in range(c << longest - k, c + 1 << longest - k):
            table[i] = (s, k)
    bits, have, at, out = 0, 0, 0, []
    for _ in range(n):
        while have < longest:
            bits, have = bits << 8 | (data[at] if at < len(data) else 0), have + 8
            at += 1
        s, k = table[bits >> have - longest & (1 << longest) - 1]
        out.append(s)
        have -= k
        bits &= (1 << have) - 1
    return out


def frequencies(values: list[int]) -> dict[int, int]:
    """Counts scaled to 2**RANS_BITS, at least one each."""
    total, size = len(values), 1 << RANS_BITS
    f = {s: max(1, values.count(s) * size // total) for s in sorted(set(values))}
    f[max(f, key=lambda s: (f[s], -s))] += size - sum(f.values())
    return f


def rans_encode(values: list[int], freq: dict[int, int]) -> tuple[int, bytes]:
    """State and bytes; renormalised by 8 bits, written backwards."""
    cum, total = {}, 0
    for s, n in sorted(freq.items()):
        cum[s] = total
        total += n
    state, out = RANS_LOW, bytearray()
    for v in reversed(values):
        f = freq[v]
        while state >= (RANS_LOW >> RANS_BITS << 8) * f:
            out.append(state & 255)
            state >>= 8
        state = (state // f << RANS_BITS) + state % f + cum[v]
    return state, bytes(out[::-1])


def rans_decode(state: int, data: bytes, freq: dict[int, int], n: int) -> list[int]:
    """[P13]"""
    slots, cum, at, out = [], {}, 0, []
    for s, f in sorted(freq.items()):
        cum[s] = len(slots)
        slots += [s] * f
    mask = (1 << RANS_BITS) - 1
    for _ in range(n):
        s = slots[state & mask]
        out.append(s)
        state = freq[s] * (state >> RANS_BITS) + (state & mask) - cum[s]
        while state < RANS_LOW and at < len(data):
            state, at = state << 8 | data[at], at + 1
    return out


def rrr_encode(block: int) -> tuple[int, int]:
    """[P6, P8] Class (number of ones) and offset (rank among the words of its class) of RRR_BLOCK bits."""
    ones, offset, left = block.bit_count(), 0, block.bit_count()
    for i in range(RRR_BLOCK - 1, -1, -1):
        if block >> i & 1:
            offset += comb(i, left)
            left -= 1
    return ones, offset


def rrr_decode(ones: int, offset: int) -> int:
    """[P5, P7]"""
    block = 0
    for i in range(RRR_BLOCK - 1, -1, -1):
        if ones and offset >= comb(i, ones):
            offset -= comb(i, ones)
            ones -= 1
            block |= 1 << i
    return block


def _blocks(tokens: DataFrame, size: int) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "sym"))), lambda x: x["sym"])
    return tokens.groupBy("stream_id", F.expr(f"pos div {size}").alias("block")).agg(ordered.alias("syms"))


TABLE = "stream_id long, block long, n int, syms array<int>, weights array<int>, state long, data binary"


def packed(tokens: DataFrame, codec: str, size: int = 64) -> DataFrame:
    """Blocks of tokens (stream_id, pos, sym), each with its own table: codec `huffman` or `rans`."""

    def run(batches):
        for pdf in batches:
            out = []
            for s, b, syms in zip(pdf["stream_id"], pdf["block"], pdf["syms"], strict=True):
                values = [int(v) for v in syms]
                if codec == "huffman":
                    weights, data = huffman_encode(values)
                    state = 0
                else:
                    weights = frequencies(values)
                    state, data = rans_encode(values, weights)
                out.append((s, b, len(values), list(weights), list(weights.values()), state, data))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TABLE.split(", ")])

    return _blocks(tokens, size).mapInPandas(run, TABLE)


def unpacked(blocks: DataFrame, codec: str, size: int = 64) -> DataFrame:
    """(stream_id, pos, sym) of packed blocks."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                weights = dict(zip([int(x) for x in r.syms], [int(x) for x in r.weights], strict=True))
                values = huffman_decode(weights, r.data, r.n) if codec == "huffman" else rans_decode(r.state, r.data, weights, r.n)
                out.append(pd.DataFrame({"stream_id": r.stream_id, "pos": r.block * size + np.arange(r.n), "sym": values}))
            if out:
                yield pd.concat(out)

    return blocks.mapInPandas(run, "stream_id long, pos long, sym int")


def rrr_packed(bits: DataFrame) -> DataFrame:
    """[P6, S2] (stream_id, block, n, class, offset) of bits (stream_id, pos, bit)."""
    word = F.sum(F.shiftleft(F.col("bit").cast("long"), 0) * F.pow(F.lit(2), F.pmod("pos", F.lit(RRR_BLOCK))).cast("long"))
    words = bits.groupBy("stream_id", F.expr(f"pos div {RRR_BLOCK}").alias("block")).agg(word.alias("word"), F.count("*").cast("int").alias("n"))

    def run(batches):
        for pdf in batches:
            pairs = [rrr_encode(int(w)) for w in pdf["word"]]
            yield pdf.assign(ones=[p[0] for p in pairs], offset=[p[1] for p in pairs])[["stream_id", "block", "n", "ones", "offset"]]

    return words.mapInPandas(run, "stream_id long, block long, n int, ones int, offset int")


def rrr_unpacked(blocks: DataFrame) -> DataFrame:
    """[P7] (stream_id, pos, bit)."""

    def run(batches):
        for pdf in batches:
            words = np.array([rrr_decode(int(c), int(o)) for c, o in zip(pdf["ones"], pdf["offset"], strict=True)], np.int64)
            n = pdf["n"].to_numpy()
            row = np.repeat(np.arange(len(pdf)), n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pd.DataFrame({"stream_id": pdf["stream_id"].to_numpy()[row], "pos": pdf["block"].to_numpy()[row] * RRR_BLOCK + inner, "bit": words[row] >> inner & 1})

    return blocks.mapInPandas(run, "stream_id long, pos long, bit int")
