"""Shared parts: word pattern, shared folder, Arrow slices and vectorised word tables."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import ship

#: A word, in Java's and Python's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where none is named and executors are threads of the driver (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file:///tmp/checkpoints"
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quern-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and survives lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def released(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing will read again; other tables are left alone."""
    if path := getattr(df, "_quern_path", None):
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs that run inside send their Python workers so many rows at once, which bounds both sides' buffers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Return memory that was freed, but is still held by the allocators, to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, for mapInArrow, with memory given back when a task ends: its Python worker lives on through later stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text) -> F.Column:
    """Number of words of a text column, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def is_held_out(doc_id) -> F.Column:
    """Rows whose crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_mark(text) -> F.Column:
    """Tells apart the texts of rows that share an id."""
    return F.hash(text)


#: Bytes of a slice: whole arrays over it take about 50 times as much memory, so a worker stays under 200 MB.
SLICE_BYTES = (1 << 20) - 1024


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [first, last) of a batch with their UTF-8 bytes and offsets, at most max_bytes each unless one text is longer."""
    array = batch.column(batch.schema.get_field_index(column))
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    n = len(array)
    if not n:
        return
    _, off, buf = array.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multipliers); uint64 in, uint64 out."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            a, b = np.uint64(pow(self.base, k, 1 << 64)), np.uint64(pow(self.inverse, k, 1 << 64))
            self.up, self.down = np.concatenate([self.up, self.up * a]), np.concatenate([self.down, self.down * b])
        return self.up[:n], self.down[:n]


BYTES, WINDOWS, WINDOWS2 = Powers(0x9E3779B97F4A7C15 | 1), Powers(0xC2B2AE3D27D4EB4F | 1), Powers(0x165667B19E3779F9 | 1)
#: A fixed random value per byte, from a documented seed.
BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def byte_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte values times powers; prefix[j] - prefix[i], times the inverse power of i, identifies data[i:j]."""
    up, _ = BYTES.get(len(data) + 1)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes give equal values wherever they stand."""
    _, down = BYTES.get(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """span_hash of every word, by blocks of bytes, so that one word of many megabytes needs no array of its length."""
    if len(data) <= 2 * SLICE_BYTES:
        return span_hash(byte_prefix(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    total = np.zeros(len(starts), np.uint64)
    for a in range(0, len(data), SLICE_BYTES):
        b = min(len(data), a + SLICE_BYTES)
        prefix = byte_prefix(data[a:b])
        _, down = BYTES.get(len(prefix))
        some = slice(np.searchsorted(ends, a, "right"), np.searchsorted(starts, b))
        lo, hi = np.maximum(starts[some], a) - a, np.minimum(ends[some], b) - a
        part = (prefix[hi] - prefix[lo]) * down[lo]
        if len(part) and starts[some][0] < a:
            part[:1] *= np.uint64(pow(BYTES.base, int(a - starts[some][0]), 1 << 64))
        total[some] += part
    return mix(total + (ends - starts).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word and the row it belongs to; words never cross rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~IS_SPACE[data]
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin[inner] = solid[inner]
    stop[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def sequence_hashes(values: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """Hashes of every run of `length` consecutive values (uint64), by prefix sums."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers.get(len(values) + 1)
    prefix = np.empty(len(values) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix((prefix[length : length + n] - prefix[:n]) * down[:n])


#: Bits of a value's rank and of a position that share one integer in sliding_argmin, and windows per block.
POSITION_BITS, BLOCK = 20, 1 << 18


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` values, the position of its smallest value, the rightmost of equals.

    The high bits of a value and its position form one integer, so that doubling needs one minimum per level:
    O(n log width) on arrays that fit a cache. Only the high 44 bits rank, which depends on the values alone.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    low_mask = np.uint64((1 << POSITION_BITS) - 1)
    for first in range(0, n, BLOCK):
        count = min(BLOCK, n - first)
        part = values[first : first + count + width - 1]
        low = (part & ~low_mask) | (low_mask - np.arange(len(part), dtype=np.uint64))
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[:count], low[width - span : width - span + count])
        out[first : first + count] = first + (low_mask - (low[:count] & low_mask)).astype(np.int64)
    return out


def valid_windows(offsets: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows of `length` units that start at 0, 1, ... stay within one row; offsets count units."""
    n = int(offsets[-1]) - length + 1
    if n <= 0:
        return np.zeros(0, bool)
    edge = np.zeros(n + 1, np.int32)
    ends = offsets[1:-1]
    np.add.at(edge, np.clip(ends - length + 1, 0, n), 1)
    np.add.at(edge, np.clip(ends, 0, n), -1)
    return np.cumsum(edge[:n]) == 0
