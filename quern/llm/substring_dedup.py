"""Substring dedup: words in windows that occur earlier are removed; a count-min sketch bounds what is grouped."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import IS_SPACE, SLICE_BYTES, materialise, text_slices, words_of
from quern.llm.repeats import WordUnits, build_sketch, covered, grouped_segments, kinds_of, segment_table, span_arrays, window_rows, with_spans

LENGTH = WordUnits.length


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", sketch_bits: int = 27) -> DataFrame:
    """(doc_id, mark, lo, n): n windows of 20 words from word lo on, each equal to a window that starts earlier.

    Pass one merges the partitions' count-min sketches of window anchors. Pass two groups exactly the windows whose
    anchor is estimated to repeat: whole segments first, then the single windows of segments that share an anchor
    and differ. Earlier means a smaller document id, or the same document and a smaller start.
    """
    table = segment_table(docs, key, text, WordUnits, build_sketch(docs, text, WordUnits, sketch_bits))
    first = grouped_segments(table, "op2")
    known = first.join(kinds_of(first), "h", "left")
    several = known.filter("copies > 1").select(F.col("h").alias("gh"), F.col("c").alias("gc"), "first", "kinds")
    at_first = (table.doc_id == F.col("first.doc_id")) & (table.lo == F.col("first.lo"))
    # A copy at the first place stands in a row that shares the id; it is compared by windows like the first.
    copies = table.join(several, (table.h == several.gh) & (table.c == several.gc) & (~at_first | F.col("kinds").isNotNull()))
    copies = materialise(copies.select("doc_id", "mark", "lo", "n", (~at_first).alias("later")), "op2-copies")
    alone = known.filter("copies = 1 and kinds is not null").select("first.doc_id", "first.mark", "first.lo", "first.n")
    mixed = alone.unionByName(copies.filter("not later").drop("later"))
    windows = window_rows(with_spans(docs, key, text, mixed), WordUnits)
    leading = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "lo")).alias("lead"), F.count("*").alias("m")).filter("m > 1").drop("m")
    leading = leading.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "lead")
    single = windows.join(leading, (windows.h1 == leading.g1) & (windows.h2 == leading.g2) & (F.struct("doc_id", "lo") != F.col("lead")))
    return copies.filter("later").drop("later").unionByName(single.select("doc_id", "mark", "lo", F.lit(1).alias("n")))


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A slice, or a longer text in parts cut at white space."""
    at = 0
    while at < len(data) and len(offsets) == 2 and len(data) - at > SLICE_BYTES:
        until = at + SLICE_BYTES
        while until < len(data) and not (space := IS_SPACE[data[until : until + SLICE_BYTES]]).any():
            until += SLICE_BYTES
        until = until + int(space.argmax()) if until < len(data) else len(data)
        yield data[at:until], np.array([0, until - at])
        at = until
    yield (data, offsets) if not at else (data[at:], np.array([0, len(data) - at]))


def _kept(data, offsets, row, lo, n):
    """Words, removed words and the bytes left of each row of a slice; spans are windows of 20 words, by row and lo."""
    rows = len(offsets) - 1
    words, counts, texts, base = np.zeros(rows, np.int64), np.zeros(rows, np.int64), [b""] * rows, 0
    for part, edges in _parts(data, offsets):
        starts, ends, of = words_of(part, edges)
        first = np.searchsorted(of, np.arange(rows + 1))
        begin = np.maximum(lo - base, 0) + first[row]
        end = np.minimum(lo + n - 1 + LENGTH - base + first[row], first[row + 1])
        good = begin < end
        begin, end, _ = covered(begin[good], end[good], row[good])
        edge = np.zeros(len(starts) + 1, np.int8)
        edge[begin] += 1
        np.subtract.at(edge, end, 1)
        gone = np.cumsum(edge[:-1], dtype=np.int8) > 0
        total, removed = np.diff(first), np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
        blob, keep = part.tobytes(), ~gone
        out = np.flatnonzero(keep)
        at = np.searchsorted(out, first)
        a, b = starts[out].tolist(), ends[out].tolist()
        for k in np.flatnonzero(total > removed).tolist():
            if removed[k]:
                kept = b" ".join(blob[x:y] for x, y in zip(a[at[k] : at[k + 1]], b[at[k] : at[k + 1]]))
            else:
                kept = b" ".join(blob[edges[k] : edges[k + 1]].split())
            texts[k] = texts[k] + b" " + kept if texts[k] else kept
        words += total
        counts += removed
        base += len(starts)
    return words, counts, texts


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", sketch_bits: int = 27, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (texts) the kept words joined by single spaces, per row.

    A null or empty text has no words and no window; texts under 20 words lose nothing; an empty table gives an empty
    result. Rows with a null id are returned whole and remove nothing. Rows that share an id keep their own texts: of
    equal windows at the same start of both, neither is earlier; rows that repeat in all lose the same words. Very
    long texts are read in parts that overlap, with the same result. Other columns are ignored, whatever their names.
    Spaces are 0x20 and 0x09 to 0x0D; words are compared byte by byte (by two 64-bit hashes).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            span_row, span_lo, span_n = span_arrays(batch.column(3))
            for first, last, data, offsets in text_slices(batch, "text"):
                mine = slice(*np.searchsorted(span_row, [first, last]))
                words, gone, kept = _kept(data, offsets, span_row[mine] - first, span_lo[mine], span_n[mine])
                out = {
                    "doc_id": batch.column(0).slice(first, last - first),
                    "n_words": pa.array(words),
                    "n_removed": pa.array(gone),
                    "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                }
                if texts:
                    out["kept"] = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.record_batch(out)

    spans = repeated_spans(docs, key, text, sketch_bits)
    fields = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else "")
    return with_spans(docs, key, text, spans).mapInArrow(run, fields)
