"""Shared plumbing: bounded Arrow slices, written cut points, vectorised byte hashing."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def least_hashes(df: DataFrame, key: str, most: int) -> DataFrame:
    """The rows of least hashes of key, at most so many. Rows far above the expected limit are dropped before the sort, so what tasks hand on does not grow with their number."""
    h, n = F.pmod(F.xxhash64(key), F.lit(1 << 30)), df.count()
    near = df.where(h < F.lit(int((1 << 30) * min(1.0, 2 * most / n)))) if n > 2 * most else df
    return near.orderBy(h, key).limit(most)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where the session names none, a temporary one in local mode, as in tests; a cluster has to name a shared one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="seqpack-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class _Made(threading.local):
    """The tables that a thread has written, oldest first."""

    def __init__(self):
        self.paths: list[str] = []


_made = _Made()


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    The table goes when sweep() is called or, at the latest, when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqpack-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    _made.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    return len(_made.paths)


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that cut() has written in this thread from mark since on; call it once nothing reads them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while len(_made.paths) > since:
        path = jvm.org.apache.hadoop.fs.Path(_made.paths.pop())
        path.getFileSystem(conf).delete(path, True)


#: A key is hot when it has more than one in so many of all rows; there are so many hot keys at most.
HOT = 4096


def hot_keys(many: DataFrame, key: str) -> DataFrame:
    """(key): the keys that have more than one in HOT of all rows, HOT of them at most; read from a written table of counts."""
    counted = cut(many.groupBy(key).agg(F.count("*").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    return counted.where((F.col("n") > F.lit(total // HOT)) & (F.col("n") > 1)).select(key)


def spread_join(many: DataFrame, few: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """many with the columns of few, whose keys are unique. Rows of hot keys stay where they are and meet few's rows of these keys, HOT at most, in a broadcast; the rest is shuffled."""
    own = F.broadcast(hot)
    here = many.join(own, key, "left_semi").join(F.broadcast(few.join(own, key, "left_semi")), key)
    return here.unionByName(many.join(own, key, "left_anti").join(few.join(own, key, "left_anti").hint("merge"), key))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each sum to limit bytes, or to one row where a row is longer."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary array end to end, and its n + 1 offsets; null counts as empty."""
    kind = pa.large_binary()
    array = pc.fill_null(column.cast(kind), b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a span that are hashed for all spans at once; the few longer ones are hashed one by one.
_SHORT = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]], eight bytes mixed in at a time; fold ignores the case of A-Z."""
    padded = np.concatenate([_LOWER[data] if fold else data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    size = ends - starts
    out = mix(size.astype(U64) * _GOLD + U64(1))
    live = np.arange(len(size))
    for at in range(0, _SHORT, 8):
        live = live[size[live] > at] if at else live[size[live] > 0]
        if not len(live):
            return out
        block = eights[starts[live] + at].view("<u8")[:, 0] & _MASKS[np.minimum(size[live] - at, 8)]
        out[live] = mix(out[live] ^ block * _GOLD)
    for i in live[size[live] > _SHORT].tolist():
        out[i : i + 1] = mix(out[i : i + 1] ^ U64(xxhash.xxh3_64_intdigest(padded[starts[i] + _SHORT : ends[i]])))
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of each text, and the first word's index of each text (n + 1)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def loaded(known: Any) -> Any:
    """A broadcast's value, not kept: many broadcasts are met one after the other, and one at a time is held. Workers read it from their file."""
    value = known.value
    if getattr(known, "_path", None):
        known.__dict__.pop("_value", None)
    return value


def blockwise(batches: Iterator[pa.RecordBatch], column: str, blocks: list[Any], make: Callable[[Any], Any], limit: int = 1 << 20, most: int = 32 << 20) -> Iterator[tuple[list[pa.RecordBatch], Iterator[tuple[int, Any]]]]:
    """Groups of slices, each with all blocks in order as make(value): one block is in memory at a time, and is met by texts of most bytes before the next.

    A single block is made once for a worker's task, and slices come one by one.
    """
    if len(blocks) == 1:
        only = [(0, make(loaded(blocks[0])))]
        for b in slices(batches, column, limit):
            yield [b], iter(only)
        return

    def each():
        for k, block in enumerate(blocks):
            yield k, make(loaded(block))

    waiting, size = [], 0
    for b in slices(batches, column, limit):
        waiting.append(b)
        size += b.nbytes
        if size >= most:
            yield waiting, each()
            waiting, size = [], 0
    if waiting:
        yield waiting, each()
