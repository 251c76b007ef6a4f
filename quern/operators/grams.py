"""Token n-grams of whole texts in numpy over Arrow batches, kept only where a fixed-size filter of wanted grams allows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the cell number of a filter (2 MB whatever the number of grams), and bytes of text handled at once.
FILTER_BITS, PART = 24, 1 << 20
_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_BYTE = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _STEP = 0x5851F42D4C957F2D, 0x14057B7EF767814F


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as long as the longest part seen."""

    def __init__(self, base: int):
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, n), _powers(self.back, n)
        return self.up[:n], self.down[:n]


_BYTES, _TOKENS = _Powers(_BASE), _Powers(_STEP)


def _range_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray, powers: _Powers) -> np.ndarray:
    """Hashes of values[first:last], alike wherever equal values stand."""
    up, down = powers.of(len(values) + 1)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up[:-1], out=sums[1:])
    h = (sums[last] - sums[first]) * down[first]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def _token_bounds(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) byte of every token; a token ends where a row ends."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _TOKEN[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    cut = breaks[(breaks > 0) & (breaks < len(data))]
    cut = np.unique(cut[inside[cut] & inside[cut + 1]])
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends


def _parts(text: memoryview, n: int) -> Iterator[bytes]:
    """A long text in parts that share n - 1 tokens, so that each n-gram lies whole in one part at least."""
    at, size = 0, len(text)
    while at < size:
        width = PART
        while True:
            until = min(size, at + width)
            data = np.frombuffer(text[at:until], np.uint8)
            starts, _ = _token_bounds(data, np.zeros(0, np.int64))
            # The last token may go on behind the part; the next part begins n tokens before it.
            if until == size or len(starts) > n + 1:
                break
            width *= 2
        yield data
        at = size if until == size else at + int(starts[len(starts) - n - 1])


def gram_rows(df: DataFrame, key: str, text: str, n: int, wanted: np.ndarray | None = None) -> DataFrame:
    """key, gram, h: the n-grams of lower-cased ASCII alphanumeric tokens of every whole text, a repeated one once or more.

    wanted is a filter made by gram_filter: grams outside it never become rows. Texts that are null or have fewer
    tokens give no row; long texts are read in parts that overlap.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(wanted)

    def rows(ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch | None:
        starts, ends = _token_bounds(data, offsets)
        if len(starts) < n:
            return None
        row = np.searchsorted(offsets, starts, "right") - 1
        values = _range_hashes(_BYTE[data], starts, ends, _BYTES)
        first = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
        h = _range_hashes(values, first, first + n, _TOKENS)
        bits = shared.value
        if bits is not None:
            cell = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            hit = (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
            first, h = first[hit], h[hit]
        if not len(first):
            return None
        raw, a, b = data.tobytes(), starts.tolist(), ends.tolist()
        grams = [" ".join(raw[a[k] : b[k]].decode() for k in range(f, f + n)) for f in first.tolist()]
        return pa.record_batch({"key": ids.take(pa.array(row[first])), "gram": pa.array(grams, pa.string()), "h": pa.array(h.view(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).fill_null("").cast(pa.large_binary())
            _, off, buf = column.buffers()
            edges = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
            blob = memoryview(buf) if buf is not None else memoryview(b"")
            first = 0
            while first < len(column):
                last = max(first + 1, int(np.searchsorted(edges, edges[first] + PART, "right")) - 1)
                ids, own = batch.column(0).slice(first, last - first), blob[edges[first] : edges[last]]
                if len(own) > PART:
                    found = (rows(ids, part, np.array([0, len(part)])) for part in _parts(own, n))
                else:
                    found = [rows(ids, np.frombuffer(own, np.uint8), edges[first : last + 1] - edges[first])]
                yield from (x for x in found if x is not None)
                first = last

    kind = df.schema[key].dataType.simpleString()
    made = df.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text")).mapInArrow(run, f"key {kind}, gram string, h long")
    return made.withColumnRenamed("key", key)


def gram_filter(grams: DataFrame) -> np.ndarray:
    """A bit for each cell of hashes that some gram has: 2**FILTER_BITS bits, so it is small however many grams there are."""
    cells = grams.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).cast("long").alias("cell"))
    packed = cells.groupBy(F.expr("cell div 8").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(cell % 8 as int))")).alias("bits"))
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for byte, value in packed.toLocalIterator():
        bits[byte] = value
    return bits
