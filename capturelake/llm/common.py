"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_folder(context: SparkContext) -> None:
    """The folder named by the session. A cluster must name one; a local master, all in one process, may use a temporary one."""
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the cluster's shared folder; spark.cleaner.referenceTracking.cleanCheckpoints removes it when unused."""
    checkpoint_folder(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder as Parquet and read again."""
    context = df.sparkSession.sparkContext
    checkpoint_folder(context)
    path = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch that Spark hands to Python; a longer row is a batch of its own. Results don't depend on it.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well as by rows, so that a worker's memory doesn't follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Tables that tasks leave in a Python worker for later tasks of their kind, with what drops them.
_LEFT: dict[str, Callable[[], None]] = {}


@contextlib.contextmanager
def worker_memory(kind: str, drop: Callable[[], None] | None = None) -> Iterator[None]:
    """For the body of a task: what tasks of other kinds have left in this worker goes first, and freed memory goes back to the system at the end.

    A worker lives as long as its executor and serves all stages in turn; else each of them would add to what it holds.
    """
    for other in [k for k in _LEFT if k != kind]:
        _LEFT.pop(other)()
        give_back()
    if drop is not None:
        _LEFT[kind] = drop
    try:
        yield
    finally:
        give_back()


def give_back() -> None:
    """Returns memory that Python, Arrow and the C library have freed but keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def base_columns(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """Only the required columns, cast to the types the operator works with; extra columns cannot clash."""
    bounded_batches(df.sparkSession)
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in required.items()])


def hash_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows in hash order of the key; only keys are gathered to choose them."""
    ids = df.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(most).distinct()
    return df.join(F.broadcast(ids), key, "left_semi").limit(most)


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array and len+1 offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return flat, offsets - offsets[0]


def row_blocks(offsets: np.ndarray, most: int = 250_000):
    """Consecutive row ranges of about `most` bytes each; a longer row is a range of its own."""
    n, start = len(offsets) - 1, 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


# Fixed random constants of the hash functions below.
_RNG = np.random.default_rng(20240607)
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("p", _P), ("q", _P_INV)):
            out = np.empty(size, np.uint64)
            out[0], filled, step = 1, 1, base
            while filled < size:
                out[filled : 2 * filled] = out[:filled] * step
                filled, step = 2 * filled, step * step
            _POWERS[name] = out
    return _POWERS["p"], _POWERS["q"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], by differences of one running polynomial sum."""
    with np.errstate(over="ignore"):
        power, inverse = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data] * power[: len(data)], out=total[1:])
        return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all rows: lower-cased (A-Z) bytes' hashes, byte starts, and per row the first word's index (len+1)."""
    data = _LOWER[data]
    solid = ~_SPACE[data]
    if len(solid):
        before = np.empty(len(solid), bool)
        before[0], before[1:] = False, solid[:-1]
        edges = offsets[:-1][offsets[:-1] < len(solid)]
        before[edges] = False
        starts = np.flatnonzero(solid & ~before)
        after = np.empty(len(solid), bool)
        after[-1], after[:-1] = False, solid[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        after[last] = False
        ends = np.flatnonzero(solid & ~after) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    first = np.searchsorted(starts, offsets)
    return span_hashes(data, starts, ends), starts, first


def shingles(hashes: np.ndarray, first: np.ndarray, row: int, width: int) -> np.ndarray:
    """Hashes of the row's `width`-word shingles in order, repeats kept; fewer words: the whole sequence as one; none: empty."""
    h = hashes[first[row] : first[row + 1]]
    if len(h) == 0:
        return h
    with np.errstate(over="ignore"):
        k = min(width, len(h))
        out = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
        for i in range(k):
            out = mix64(out * _P + h[i : len(h) - k + 1 + i])
        return out
