"""Structured Streaming forms of the stateful operators: seal, replay check, sliding percentiles, key and value pairing.

The reference semantics have no late data: an append that does not continue its key is refused. Watermarks only bound state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SEALED = "stream_id long, page long, n int, syms string, status string"
STATE = "next long, tail array<string>"


def append_seal(stream: DataFrame, page: int) -> DataFrame:
    """[T1, T3, T26] A stream of appends (stream_id, pos, sym) as sealed pages of so many symbols, and refusals.

    State of a key: the next position and the active tail. Rows of a batch are put in order; a row that was appended before is
    refused as `duplicate`, one that leaves a gap as `gap`. Any symbol may stand in the tail, null and the empty one too; in a
    page's text a null symbol is left out.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, tail = state.get if state.exists else (0, [])
        tail_syms = list(tail)
        out = []
        rows = pd.concat(batches).sort_values("pos")
        for pos, sym in zip(rows["pos"], rows["sym"], strict=True):
            sym = None if sym is None or sym != sym else sym
            if pos != at:
                out.append((key[0], pos // page, 1, sym, "duplicate" if pos < at else "gap"))
                continue
            at += 1
            tail_syms.append(sym)
            if len(tail_syms) == page:
                out.append((key[0], (at - 1) // page, page, " ".join(x for x in tail_syms if x is not None), "sealed"))
                tail_syms = []
        state.update((at, tail_syms))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SEALED.split(", ")])

    return stream.groupBy("stream_id").applyInPandasWithState(step, SEALED, STATE, "append", GroupStateTimeout.NoTimeout)


def fresh(stream: DataFrame, key: str, at: str, window: str) -> DataFrame:
    """[T14, S29] Each token once; state is dropped after the window."""
    return stream.withWatermark(at, window).dropDuplicatesWithinWatermark([key])


def sliding_p95(stream: DataFrame, at: str, value: str, length: str, slide: str, late: str) -> DataFrame:
    """[W9] Counts and percentiles of sliding windows; approximate within one percent, since streams need mergeable state."""
    w = F.window(at, length, slide).alias("w")
    return stream.withWatermark(at, late).groupBy(w).agg(F.count("*").alias("n"), F.percentile_approx(value, 0.95, 10000).alias("p95")).select("w.start", "w.end", "n", "p95")


def paired(keys: DataFrame, values: DataFrame, at: str, within: str) -> DataFrame:
    """[T26] Keys and values (layer, step, at, ...) that arrive in any order, joined on layer and step."""
    k = keys.withWatermark(at, within).alias("k")
    v = values.withWatermark(at, within).alias("v")
    near = F.expr(f"v.{at} between k.{at} - interval {within} and k.{at} + interval {within}")
    return k.join(v, (F.col("k.layer") == F.col("v.layer")) & (F.col("k.step") == F.col("v.step")) & near).select(F.col("k.layer"), F.col("k.step"), F.col("k.payload").alias("key_payload"), F.col("v.payload").alias("value_payload"))


def each_batch(stream: DataFrame, hook) -> Any:
    """[U3] Calls hook(df, batch_id) with every micro-batch, as a running query."""
    return stream.writeStream.foreachBatch(hook).start()
