"""Shared pieces: reading tables, the shared scratch folder, hash splits, Arrow text buffers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step looks at; a longer text is a step of its own.
STEP_BYTES = 1 << 19
#: Bytes of text that Spark hands to a Python worker at once, where the session says nothing else.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers a few MB at a time, so that a worker's memory does not follow the length of texts."""
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def freed(run):
    """run, a function for mapInArrow, with a release at its end: workers stay, and what several of them keep adds up."""

    def own(batches):
        yield from run(batches)
        release()

    return own


def scratch(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; where it is unset a local one, on a local master only."""
    where = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="retort-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: cuts the lineage and survives lost executors."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket(column: Column, modulus: int) -> Column:
    """crc32 of the column's text form (null: empty), modulo modulus: the fixed training split."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def texts(column: pa.Array, step: int = STEP_BYTES):
    """Yields (first row, uint8 buffer, row offsets) for runs of consecutive rows of at most step bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1)
        yield at, whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


# Word and window hashes: sums of random byte values times powers of an odd base modulo 2^64, so that any
# stretch of a buffer is hashed from two prefix sums.
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers_of(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


@functools.lru_cache(2)
def _kept_powers(base: int) -> np.ndarray:
    return _powers_of(base, STEP_BYTES + 1)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base; those of one step are kept, longer rows of them are not."""
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    return _kept_powers(base)[:n] if n <= STEP_BYTES + 1 else _powers_of(base, n)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased in UTF-8 bytes."""
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h with stretch(h, a, b) the hash of data[a:b]."""
    n = len(data)
    h = np.empty(n + 1, np.uint64)
    h[0] = 0
    np.cumsum(_BYTE[data] * powers(n), out=h[1:])
    return h


def stretch(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((h[end] - h[start]) * powers(len(h), inverse=True)[start])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of all rows, and the word offsets of the rows."""
    solid = ~SPACE[data]
    if not len(solid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(solid))]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def pieces(data: np.ndarray, step: int = STEP_BYTES):
    """Stretches of about step bytes of one long text, cut behind white space; a longer word is not cut."""
    at = 0
    while len(data) - at > step:
        blank = np.flatnonzero(SPACE[data[at : at + step]])
        if not len(blank):  # the first blank behind the step
            behind = at + step
            while behind < len(data) and not SPACE[data[behind : behind + step]].any():
                behind += step
            rest = np.flatnonzero(SPACE[data[behind : behind + step]])
            to = behind + int(rest[0]) + 1 if len(rest) else len(data)
        else:
            to = at + int(blank[-1]) + 1
        yield data[at:to]
        at = to
    if at < len(data):
        yield data[at:]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, A-Z lower-cased, and the word offsets of the rows. A row longer than a step is read piece by piece."""
    if len(data) > STEP_BYTES and len(offsets) == 2:
        own = np.concatenate([_hashes(x, np.array([0, len(x)]))[0] for x in pieces(data)])
        return own, np.array([0, len(own)])
    return _hashes(data, offsets)


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = lower(data)
    starts, ends, rows = words(data, offsets)
    return stretch(prefix_hashes(data), starts, ends), rows


def arrow_batches(columns: dict[str, pa.Array | list | np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)
