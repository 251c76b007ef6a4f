"""Repeated windows across documents by content-defined segments.

A window is L consecutive units (words or bytes) of one document. Its anchor is the k-gram with the smallest hash in
it, so equal windows have equal anchors at equal offsets. Consecutive windows with one anchor form a segment, named
by the anchor's hash H and the hash C of all its units and of the anchor's place in it. Segments equal in (H, C) are
equal window by window; only segments that share H but not C need a comparison of single windows, and of those one
representative per (H, C) suffices. This shuffles one narrow row per segment instead of one per window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import (
    BYTES,
    IS_SPACE,
    SLICE_BYTES,
    WINDOWS,
    WINDOWS2,
    byte_prefix,
    materialise,
    mix,
    sequence_hashes,
    sliding_argmin,
    span_hash,
    text_mark,
    text_slices,
    valid_windows,
    word_hashes,
    words_of,
)

SEGMENT_FIELDS = "doc_id long, mark int, lo int, n int, h long, c long"
#: Shards of a sketch row: the unit in which partition sketches are merged.
SHARDS = 64


class WordUnits:
    """Words of a slice as units: k-gram hashes, segment hashes and both window hashes.

    parts() gives a long text in parts cut at white space, each with the number of words before it.
    """

    length, k = 20, 8

    def __init__(self, data, offsets):
        self.data = data
        self.starts, self.ends, rows = words_of(data, offsets)
        self.offsets = np.searchsorted(rows, np.arange(len(offsets)))
        self.values = word_hashes(data, self.starts, self.ends)

    @classmethod
    def parts(cls, data):
        at = base = 0
        while True:
            width = SLICE_BYTES
            while True:
                until = min(len(data), at + width)
                while until < len(data) and not (space := IS_SPACE[data[until : until + SLICE_BYTES]]).any():
                    until = min(len(data), until + SLICE_BYTES)
                if until < len(data):
                    until += int(space.argmax())
                u = cls(data[at:until], np.array([0, until - at]))
                if until == len(data) or len(u.starts) >= 2 * cls.length:
                    break
                width *= 2
            yield u, base
            if until == len(data):
                return
            step = len(u.starts) - cls.length + 1
            base, at = base + step, at + int(u.starts[step])

    def grams(self):
        return sequence_hashes(self.values, self.k, WINDOWS2)

    def spans(self, start, end):
        return _run_hash(self.values, start, end)


class ByteUnits:
    """Bytes of a slice as units; parts() gives a long text in parts, each with the number of bytes before it."""

    length, k = 200, 32

    def __init__(self, data, offsets):
        self.data, self.offsets, self.prefix = data, offsets, byte_prefix(data)

    @classmethod
    def parts(cls, data):
        for at in range(0, max(1, len(data) - cls.length + 1), SLICE_BYTES):
            part = data[at : at + SLICE_BYTES + cls.length - 1]
            yield cls(part, np.array([0, len(part)])), at

    def grams(self):
        n = len(self.prefix) - self.k
        if n <= 0:
            return np.zeros(0, np.uint64)
        _, down = BYTES.get(len(self.prefix))
        return mix((self.prefix[self.k :] - self.prefix[:n]) * down[:n])

    def spans(self, start, end):
        return span_hash(self.prefix, start, end)


def unit_slices(batch: pa.RecordBatch, units) -> Iterator[tuple]:
    """(first, last, units, base) of the rows [first, last) of a batch; base units of a long row stand before.

    A text longer than a slice comes in parts that share length - 1 units, so each of its windows stands in one part.
    Parts depend on the text alone, so equal texts have equal segments; segments cut at the edge of a part differ from
    uncut ones in C only, and are compared by windows or bytes like others that share an anchor.
    """
    for first, last, data, offsets in text_slices(batch, "text"):
        if len(data) <= SLICE_BYTES:
            yield first, last, units(data, offsets), 0
        else:
            for u, base in units.parts(data):
                yield first, last, u, base


def _run_hash(values, start, end):
    up, down = WINDOWS.get(len(values) + 1)
    prefix = np.empty(len(values) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def segments(units) -> tuple[np.ndarray, ...]:
    """Row, first window (unit within the slice), number of windows, anchor and (H, C) of every segment of a slice."""
    length = units.length
    valid = valid_windows(units.offsets, length)
    if not len(valid) or not valid.any():
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    grams = units.grams()
    anchor = sliding_argmin(grams, length - units.k + 1)[: len(valid)]
    change = np.ones(len(valid), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    lo = np.flatnonzero(valid & change)
    last = np.zeros(len(valid), bool)
    last[:-1] = (anchor[1:] != anchor[:-1]) | ~valid[1:]
    last[-1] = True
    hi = np.flatnonzero(valid & last)
    at = anchor[lo]
    h = grams[at]
    c = mix(units.spans(lo, hi + length) + (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    row = np.searchsorted(units.offsets, lo, "right") - 1
    return row, lo, hi - lo + 1, at, h, c


class Sketch:
    """A merged count-min sketch reduced to one bit per cell: set where the count reaches two.

    A value whose bit is unset in any row occurs once at most; a value that occurs twice has every bit set, so the
    sketch never loses a repeat. Its size is fixed when it is made, whatever the corpus holds.
    """

    def __init__(self, bits: int, rows: list[np.ndarray]):
        self.bits, self.rows = bits, rows

    @staticmethod
    def cells(values: np.ndarray, row: int, bits: int) -> np.ndarray:
        return (mix(values + np.uint64(0x632BE59BD9B4E019 * (row + 1) & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int64)

    def repeated(self, values: np.ndarray) -> np.ndarray:
        keep = np.ones(len(values), bool)
        for row, packed in enumerate(self.rows):
            cell = self.cells(values, row, self.bits)
            keep &= (packed[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
        return keep


def expected_segments(docs: DataFrame, text: str, units) -> float:
    chars = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    per_unit = 6 if units is WordUnits else 1
    return 2 * chars / per_unit / (units.length - units.k + 2)


def build_sketch(docs: DataFrame, text: str, units, most_bits: int = 27) -> Sketch:
    """The merged sketch of the anchors of all windows."""

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, u, _ in unit_slices(batch, units):
            yield segments(u)[4]

    return merged_sketch(docs.select(F.col(text).alias("text")), anchors, expected_segments(docs, text, units), most_bits)


def merged_sketch(df: DataFrame, values: Callable[[pa.RecordBatch], Iterator[np.ndarray]], expected: float, most_bits: int = 27, depth: int = 2) -> Sketch:
    """The sketch of all values (uint64 arrays) of a table's batches; four cells for each value expected, at most 2**most_bits.

    Each task sends its non-empty cells by shard; a shard's cells are merged in a stream with two bits a cell. The
    driver receives depth * 2**bits / 8 bytes (32 MB at the defaults) and broadcasts them.
    """
    bits = max(12, min(most_bits, math.ceil(math.log2(4 * expected + 1))))
    shards = min(SHARDS, max(1, (1 << bits) >> 18))
    shift = bits - int(math.log2(shards))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h in values(batch):
                for row in range(depth):
                    cells, counts = np.unique(Sketch.cells(h, row, bits), return_counts=True)
                    cells = cells.astype(np.uint32)
                    edge = np.searchsorted(cells, np.arange(shards + 1, dtype=np.int64) << shift)
                    once = [cells[a:b] & np.uint32((1 << shift) - 1) for a, b in zip(edge, edge[1:])]
                    twice = [x[counts[a:b] > 1] for x, a, b in zip(once, edge, edge[1:])]
                    yield pa.record_batch(
                        {
                            "shard": pa.array(np.arange(shards, dtype=np.int32) + row * shards),
                            "once": pa.array([x.tobytes() for x in once], pa.binary()),
                            "twice": pa.array([x.tobytes() for x in twice], pa.binary()),
                        }
                    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, again = None, None, None

        def done():
            return pa.record_batch({"shard": pa.array([now], pa.int32()), "bits": pa.array([np.packbits(again).tobytes()], pa.binary())})

        for batch in batches:
            for shard, once, twice in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if shard != now:
                    if now is not None:
                        yield done()
                    now, seen, again = shard, np.zeros(1 << shift, bool), np.zeros(1 << shift, bool)
                ids = np.frombuffer(once, np.uint32)
                again[ids[seen[ids]]] = True
                again[np.frombuffer(twice, np.uint32)] = True
                seen[ids] = True
        if now is not None:
            yield done()

    parts = df.mapInArrow(local, "shard int, once binary, twice binary")
    merged = parts.repartition(depth * shards, "shard").sortWithinPartitions("shard").mapInArrow(merge, "shard int, bits binary")
    size = max(1, (1 << shift) // 8)
    rows = [np.zeros(shards * size, np.uint8) for _ in range(depth)]
    for shard, packed in merged.collect():
        row, k = divmod(shard, shards)
        rows[row][k * size : (k + 1) * size] = np.frombuffer(packed, np.uint8)
    return Sketch(bits, rows)


def marked_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, mark, text: a row is named by its id and its text, so rows that share an id keep apart."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), text_mark(F.col(text)).alias("mark"), F.col(text).alias("text"))


def segment_table(docs: DataFrame, key: str, text: str, units, sketch: Sketch) -> DataFrame:
    """Segments of all documents whose anchors the sketch estimates to be repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            for first, last, u, base in unit_slices(batch, units):
                row, lo, n, _, h, c = segments(u)
                keep = np.flatnonzero(shared.value.repeated(h))
                row, lo, n, h, c = row[keep], lo[keep], n[keep], h[keep], c[keep]
                rows = pa.array(row)
                yield pa.record_batch(
                    {
                        "doc_id": ids.slice(first, last - first).take(rows),
                        "mark": marks.slice(first, last - first).take(rows),
                        "lo": pa.array((lo - u.offsets[row] + base).astype(np.int32)),
                        "n": pa.array(n.astype(np.int32)),
                        "h": pa.array(h.view(np.int64)),
                        "c": pa.array(c.view(np.int64)),
                    }
                )

    return marked_texts(docs.filter(F.col(key).isNotNull()), key, text).mapInArrow(run, SEGMENT_FIELDS)


def grouped_segments(table: DataFrame, label: str) -> DataFrame:
    """h, c, copies, first: one row per (h, c) with how often it occurs and its first place (doc_id, lo, n, mark)."""
    return materialise(table.groupBy("h", "c").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "lo", "n", "mark")).alias("first")), label)


def kinds_of(first: DataFrame) -> DataFrame:
    """h, kinds of the anchors that have more than one kind of segment; counted in part before the shuffle."""
    return first.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1")


def with_spans(docs: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """doc_id, mark, text and the set of spans (lo, n) of every row, null where none."""
    listed = spans.groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).agg(F.collect_set(F.struct("lo", "n")).alias("spans"))
    left = marked_texts(docs, key, text)
    return left.join(listed, (left.doc_id == listed["__id"]) & (left.mark == listed["__mark"]), "left").drop("__id", "__mark")


def span_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, lo and n of all spans of a list<struct<lo, n>> column, by row and lo."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = column.flatten()
    row, lo, n = np.repeat(np.arange(len(column)), lengths), np.asarray(flat.field(0), dtype=np.int64), np.asarray(flat.field(1), dtype=np.int64)
    order = np.lexsort((lo, row))
    return row, lo[order], n[order]


def covered(begin: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of the maximal runs that spans cover; spans come by row and begin, and runs stay within a row."""
    if not len(begin):
        return begin, end, row
    top = np.maximum.accumulate(end)
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (begin[1:] > top[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(fresh)
    return begin[at], top[np.append(at[1:] - 1, len(end) - 1)], row[at]


def window_rows(docs_with_spans: DataFrame, units) -> DataFrame:
    """Two 64-bit hashes and the place of every window in the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            span_row, span_lo, span_n = span_arrays(batch.column(3))
            ids, marks = batch.column(0), batch.column(1)
            for first, last, u, base in unit_slices(batch, units):
                mine = slice(*np.searchsorted(span_row, [first, last]))
                row = span_row[mine] - first
                begin = np.maximum(span_lo[mine] - base, 0) + u.offsets[row]
                end = np.minimum(span_lo[mine] + span_n[mine] - base + u.offsets[row], u.offsets[row + 1] - u.length + 1)
                fits = begin < end
                row, begin, n = row[fits], begin[fits], (end - begin)[fits]
                if not len(row):
                    continue
                start = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rows = pa.array(np.repeat(row, n))
                yield pa.record_batch(
                    {
                        "doc_id": ids.slice(first, last - first).take(rows),
                        "mark": marks.slice(first, last - first).take(rows),
                        "lo": pa.array((start - u.offsets[np.asarray(rows)] + base).astype(np.int32)),
                        "h1": pa.array(u.spans(start, start + u.length).view(np.int64)),
                        "h2": pa.array(second_hash(u, start).view(np.int64)),
                    }
                )

    return docs_with_spans.mapInArrow(run, "doc_id long, mark int, lo int, h1 long, h2 long")


def second_hash(units, start: np.ndarray) -> np.ndarray:
    """A hash of word windows independent of spans(): another base."""
    return sequence_hashes(units.values, units.length, WINDOWS2)[start]
