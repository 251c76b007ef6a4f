"""Suffix-array dedup: bytes covered by 200-byte strings that also stand elsewhere, from an interval tree.

The suffixes sorted are those at content-defined anchors (see repeats): a 200-byte string and its copies hold the
same anchor at the same offset, so each anchor's suffixes form a suffix array of their own, and the arrays of
different anchors are built in different tasks. Segments equal in all bytes are one leaf that counts its copies.

An anchor that very many different segments hold (the edge of a passage that many documents share) has too large an
array for one task. It is cut along the tree: strings are dealt by how many of their bytes stand before the anchor,
and those of a range of such numbers by the bytes that all of them share, so equal strings stay in one array. A leaf
of a cut array holds only the bytes that its range of strings can reach, so segments that differ further out become
one leaf; a range of one number has one leaf for each string. So arrays are bounded, and each is scanned in one way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialise, text_slices
from quern.llm.repeats import ByteUnits, build_sketch, covered, grouped_segments, kinds_of, marked_texts, segment_table, segments, span_arrays, unit_slices, with_spans

LENGTH = ByteUnits.length
#: Bits of a cell number of the filter of large anchors (2 MB).
FILTER_BITS = 24
#: Numbers of bytes that can stand before the anchor of a 200-byte string, and parts into which a range of them is cut.
RANGE, CUTS = LENGTH - ByteUnits.k + 1, 4


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by one exclusive-or of both as integers."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every interval of the common-prefix tree of a sorted array, by one scan with a stack.

    lcp[i] is the common prefix of entries i and i + 1. An interval is maximal: no entry beside it shares the prefix.
    """
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > value:
            length, first = stack.pop()
            yield length, first, i
        if not stack or stack[-1][0] < value:
            stack.append((value, first))
    # the sentinel leaves itself on the stack


def maximal_repeats(lefts: list[bytes], rights: list[bytes], copies: list[int] | None = None, least: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members): maximal strings of at least `least` bytes around one anchor, with all their leaves.

    rights are the suffixes at the anchors, lefts the bytes before them, reversed. The suffixes are sorted and their
    common-prefix intervals scanned; an interval is right-maximal by construction. Within it the left contexts are
    scanned alike: where all left extensions agree the string can be extended, so only strings whose left
    extensions differ (or end) are put out, once for the right interval in which they are longest. A leaf of several
    copies is an interval of its own, whose members agree in all bytes.
    """
    for k, n in enumerate(copies or ()):
        if n > 1 and len(lefts[k]) + len(rights[k]) >= least:
            yield len(lefts[k]), len(rights[k]), [k]
    order = sorted(range(len(rights)), key=rights.__getitem__)
    lcp = [common_prefix(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    for right, first, last in intervals(lcp):
        if right <= 0:
            continue
        inside = order[first : last + 1]
        by_left = sorted(range(len(inside)), key=lambda k: lefts[inside[k]])
        lcs = [common_prefix(lefts[inside[a]], lefts[inside[b]]) for a, b in zip(by_left, by_left[1:])]
        for left, a, b in intervals(lcs):
            if left + right < least:
                continue
            places = sorted(by_left[a : b + 1])
            # Skipped where all members lie in one inner interval: the string there is longer to the right.
            if min(lcp[first + places[0] : first + places[-1]]) == right:
                yield left, right, [inside[k] for k in places]


LEAF_FIELDS = "h long, c long, copies int, left binary, right binary"


def _leaves(u: ByteUnits, wanted) -> pa.RecordBatch:
    """Leaves of the segments of a slice that wanted(lo, h) gives copies: h, c, copies, bytes before the anchor (reversed)
    and from it; segments that are equal come as one leaf with the sum of their copies."""
    _, lo, n, at, h, c = segments(u)
    copies = wanted(lo, h).astype(np.int64)
    some = np.flatnonzero(copies)
    some = some[np.lexsort((c[some], h[some]))]
    if len(some):
        fresh = np.flatnonzero(np.append(True, (h[some][1:] != h[some][:-1]) | (c[some][1:] != c[some][:-1])))
        total = np.add.reduceat(copies[some], fresh)
        some = some[fresh]
        copies[some] = total
    lo, n, at = lo[some].tolist(), n[some].tolist(), at[some].tolist()
    raw = u.data.tobytes() if len(some) else b""
    return pa.record_batch(
        {
            "h": pa.array(h[some].view(np.int64)),
            "c": pa.array(c[some].view(np.int64)),
            "copies": pa.array(copies[some].astype(np.int32)),
            "left": pa.array([raw[a:b][::-1] for a, b in zip(lo, at)], pa.binary()),
            "right": pa.array([raw[a : b + k - 1 + LENGTH] for a, b, k in zip(at, lo, n)], pa.binary()),
        }
    )


def leaf_texts(docs_with_spans: DataFrame) -> DataFrame:
    """Leaves of the segments that begin where a span does; the number in the span is the leaf's copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            span_row, span_lo, span_n = span_arrays(batch.column(3))
            for first, last, u, base in unit_slices(batch, ByteUnits):
                mine = slice(*np.searchsorted(span_row, [first, last]))
                if mine.start == mine.stop:
                    continue
                place = u.offsets[span_row[mine] - first] + span_lo[mine] - base

                def wanted(lo, h):
                    at = np.minimum(np.searchsorted(place, lo), len(place) - 1)
                    return np.where(place[at] == lo, span_n[mine][at], 0)

                yield _leaves(u, wanted)

    return docs_with_spans.mapInArrow(run, LEAF_FIELDS)


def large_leaves(docs: DataFrame, key: str, text: str, large: DataFrame) -> DataFrame:
    """Leaves of the anchors in large, one row for each (h, c), from one pass that shuffles nothing else.

    A bit filter of fixed size spares other segments from leaving their task. Copies are counted in part by slice and
    by task, and each leaf is one row before the semi-join on the anchor.
    """
    cells = large.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).cast("long").alias("cell"))
    packed = cells.groupBy(F.expr("cell div 8").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(cell % 8 as int))")).alias("bits"))
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for byte, value in packed.toLocalIterator():
        bits[byte] = value
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def wanted(lo, h):
            cell = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            return shared.value[cell >> 3] >> (cell & 7).astype(np.uint8) & 1

        for batch in batches:
            for _, _, u, _ in unit_slices(batch, ByteUnits):
                yield _leaves(u, wanted)

    found = marked_texts(docs.filter(F.col(key).isNotNull()), key, text).mapInArrow(run, LEAF_FIELDS)
    once = found.groupBy("h", "c").agg(F.least(F.sum("copies"), F.lit(2)).cast("int").alias("copies"), F.first("left").alias("left"), F.first("right").alias("right"))
    return materialise(once, "op10-large").join(large.select("h"), "h", "left_semi")


CUT_FIELDS = "h long, c long, copies int, back int, array long, leaf long, lo int, hi int, left binary, right binary"


def _name(*parts: bytes) -> int:
    d = hashlib.blake2b(digest_size=8)
    for p in parts:
        d.update(len(p).to_bytes(4, "little") + p)
    return int.from_bytes(d.digest(), "little", signed=True)


def cut_leaves(leaves: DataFrame) -> DataFrame:
    """Leaves of too large arrays, dealt to the arrays of the parts of their range [lo, hi).

    A leaf comes once for each part of which it has a string; `array` names the bytes that all strings of the part
    share, `leaf` all bytes that they reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CUT_FIELDS.split(", ")]
        for batch in batches:
            out = []
            for h, c, copies, back, array, _, lo, hi, left, right in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in names)):
                edges = sorted({lo + (hi - lo) * k // CUTS for k in range(CUTS + 1)})
                for x, y in zip(edges, edges[1:]):
                    a, b = left[: y - 1], right[: LENGTH - x]
                    if len(a) >= x and len(b) > LENGTH - y and len(a) + len(b) >= LENGTH:
                        part = array.to_bytes(8, "little", signed=True) + bytes([x, y])
                        out.append((h, c, copies, back, _name(part, left[:x], right[: LENGTH - y + 1]), _name(a, b), x, y, a, b))
            columns = list(zip(*out)) or [()] * len(names)
            kinds = [*[pa.int64()] * 2, *[pa.int32()] * 2, *[pa.int64()] * 2, *[pa.int32()] * 2, *[pa.binary()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names)

    return leaves.mapInArrow(run, CUT_FIELDS)


def bounded_arrays(leaves: DataFrame, largest: int) -> list[DataFrame]:
    """Tables of leaves (CUT_FIELDS) whose arrays have at most `largest` different leaves each and a string that may repeat.

    leaves are those of larger arrays. They are cut until no array is larger, at most four times.
    """
    done = []
    for step in range(1, 1 + next(k for k in range(9) if CUTS**k >= RANGE)):
        leaves = materialise(cut_leaves(leaves), f"op10-cut{step}")
        kinds = leaves.groupBy("array", "leaf").agg(F.sum("copies").alias("copies"))
        sizes = materialise(kinds.groupBy("array").agg(F.count("*").alias("kinds"), F.sum("copies").alias("strings")), "op10-sizes")
        repeated = sizes.filter((F.col("kinds") <= largest) & (F.col("strings") > 1)).select("array")
        done.append(leaves.join(repeated, "array", "left_semi"))
        large = sizes.filter(F.col("kinds") > largest).select("array")
        if not large.limit(1).count():
            return done
        leaves = leaves.join(large, "array", "left_semi")
    raise AssertionError("an array of one number of bytes before the anchor has one leaf")


def repeat_groups(leaves: DataFrame, groups: bool) -> DataFrame:
    """array, leaf, back, group, left, right: the maximal repeats of every array; leaves of an array are brought together.
    back is the leaf's bytes before the anchor.

    Without groups, the strings of a leaf that overlap are joined: left is the most bytes before the anchor at which
    a repeated 200-byte string begins, right such that the last one ends there; group is 0.
    """

    def solved(rows):
        found = maximal_repeats([r[3] for r in rows], [r[4] for r in rows], [r[2] for r in rows])
        if groups:
            for k, (left, right, members) in enumerate(found):
                for m in members:
                    yield *rows[m][:2], len(rows[m][3]), k, left, right
            return
        reach: dict[int, list[tuple[int, int]]] = {}
        for left, right, members in found:
            for m in members:
                reach.setdefault(m, []).append((-left, right))
        for m, spans in reach.items():
            merged: list[list[int]] = []
            for begin, end in sorted(spans):
                # Strings from -left on; the last begins at right - 200.
                if merged and begin <= merged[-1][1] - LENGTH + 1:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([begin, end])
            for begin, end in merged:
                yield *rows[m][:2], len(rows[m][3]), 0, -begin, end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        kinds = [*[pa.int64()] * 2, *[pa.int32()] * 4]

        def packed(found):
            columns = list(zip(*found)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["array", "leaf", "back", "group", "left", "right"])

        for batch in batches:
            found = []
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[0] != now:
                    found += solved(rows)
                    now, rows = r[0], []
                rows.append(r)
            yield packed(found)
        yield packed(list(solved(rows)))

    sorted_ = leaves.select("array", "leaf", "copies", "left", "right").repartition("array").sortWithinPartitions("array")
    return sorted_.mapInArrow(run, "array long, leaf long, back int, group int, left int, right int")


def _repeats(docs: DataFrame, key: str, text: str, sketch_bits: int, largest: int, groups: bool) -> DataFrame:
    """doc_id, mark, lo, n, array, group: every occurrence of the strings that the trees put out; n strings from byte lo on."""
    table = segment_table(docs, key, text, ByteUnits, build_sketch(docs, text, ByteUnits, sketch_bits))
    first = grouped_segments(table, "op10")
    kinds = kinds_of(first)
    known = first.join(kinds, "h", "left")
    # An array of one leaf is one interval, the leaf itself, where it has copies.
    strings = known.filter("kinds is null and copies > 1").select("h", "c", F.lit(0).alias("off"), F.col("first.n").alias("n"), F.col("h").alias("array"), F.lit(0).alias("group"))
    few = known.filter(F.col("kinds") <= largest).select("first.doc_id", "first.mark", "first.lo", F.least("copies", F.lit(2)).cast("int").alias("n"))
    found = repeat_groups(leaf_texts(with_spans(docs, key, text, few)).withColumnsRenamed({"h": "array", "c": "leaf"}), groups)
    n = (F.col("left") + F.col("right") - (LENGTH - 1)).alias("n")
    strings = strings.unionByName(found.select(F.col("array").alias("h"), F.col("leaf").alias("c"), (F.col("back") - F.col("left")).alias("off"), n, "array", "group"))
    large = kinds.filter(F.col("kinds") > largest)
    if large.limit(1).count():
        leaves = large_leaves(docs, key, text, large)
        leaves = leaves.select("h", "c", "copies", F.length("left").alias("back"), F.col("h").alias("array"), F.col("c").alias("leaf"), F.lit(0).alias("lo"), F.lit(RANGE).alias("hi"), "left", "right")
        for part in bounded_arrays(leaves, largest):
            once = part.groupBy("array", "leaf").agg(F.least(F.sum("copies"), F.lit(2)).cast("int").alias("copies"), F.first("left").alias("left"), F.first("right").alias("right"))
            found = repeat_groups(once, groups).drop("back")
            held = part.select("h", "c", "back", F.col("array").alias("__array"), F.col("leaf").alias("__leaf"))
            both = held.join(found, (F.col("__array") == found.array) & (F.col("__leaf") == found.leaf))
            strings = strings.unionByName(both.select("h", "c", (F.col("back") - F.col("left")).alias("off"), n, "array", "group"))
    strings = strings.withColumnsRenamed({"h": "gh", "c": "gc", "n": "m"})
    placed = table.join(strings, (table.h == F.col("gh")) & (table.c == F.col("gc")))
    return placed.select("doc_id", "mark", (F.col("lo") + F.col("off")).alias("lo"), F.col("m").alias("n"), "array", "group")


def maximal_repeat_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", sketch_bits: int = 27, largest: int = 256) -> DataFrame:
    """array, group, doc_id, mark, start, length: every group of maximal repeats with all its occurrences, a row each.

    A group is named by its array and its number there; mark tells apart rows that share an id. Strings are maximal
    within the segments around one anchor, so a longer repeat is put out as several groups that overlap; in an array
    that was cut, groups cover the strings of the array's range.
    """
    found = _repeats(docs, key, text, sketch_bits, largest, True)
    return found.select("array", "group", "doc_id", "mark", F.col("lo").alias("start"), (F.col("n") + LENGTH - 1).alias("length"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", sketch_bits: int = 27, largest: int = 256) -> DataFrame:
    """(doc_id, mark, lo, n): n 200-byte strings from byte lo on, each of which also starts elsewhere."""
    return _repeats(docs, key, text, sketch_bits, largest, False).select("doc_id", "mark", "lo", "n")


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", sketch_bits: int = 27, largest: int = 256, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (texts) the bytes left, per row.

    Texts are UTF-8 bytes; null counts as empty; texts under 200 bytes lose nothing; matches never cross documents; an
    empty table gives an empty result. Rows with a null id are returned whole and remove nothing. Rows that share an
    id are rows of their own; rows that repeat in all are copies of each other. Very long texts are read in parts that
    overlap, with the same result. Other columns are ignored, whatever their names. What is left can cut a character,
    so it is binary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            span_row, span_lo, span_n = span_arrays(batch.column(3))
            for first, last, data, offsets in text_slices(batch, "text"):
                mine = slice(*np.searchsorted(span_row, [first, last]))
                row = span_row[mine] - first
                begin = np.minimum(offsets[row] + span_lo[mine], offsets[row + 1])
                begin, end, row = covered(begin, np.minimum(begin + span_n[mine] - 1 + LENGTH, offsets[row + 1]), row)
                rows = len(offsets) - 1
                removed, runs = np.zeros(rows, np.int64), np.bincount(row, minlength=rows)
                np.add.at(removed, row, end - begin)
                edges, raw, left = np.searchsorted(row, np.arange(rows + 1)).tolist(), memoryview(data), []
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    some = slice(edges[k], edges[k + 1])
                    cuts = [a, *np.stack([begin[some], end[some]], 1).ravel().tolist(), b]
                    left.append(b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2])))
                out = {
                    "doc_id": batch.column(0).slice(first, last - first),
                    "n_bytes": pa.array(np.diff(offsets)),
                    "n_removed": pa.array(removed),
                    "n_spans": pa.array(runs.astype(np.int64)),
                    "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left]),
                }
                if texts:
                    out["kept"] = pa.array(left, pa.binary())
                yield pa.record_batch(out)

    spans = repeated_spans(docs, key, text, sketch_bits, largest)
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    return with_spans(docs, key, text, spans).mapInArrow(run, fields)
