"""Benchmark decontamination: template windows with typed placeholders, hash-joined, with consistent slots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WINDOWS, byte_prefix, lean, mix, sequence_hashes, span_hash, text_slices

#: Words that name a unit where they follow a number.
UNITS = (
    "m cm mm km kg g mg t lb lbs oz ml l cl s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months "
    "year years dollar dollars euro euros cent cents pound pounds percent mile miles foot feet inch inches yard yards gallon gallons liter liters "
    "litre litres meter meters metre metres gram grams kilogram kilograms degree degrees mph kmh kph hz w kw v a"
).split()

#: Tokens of a window, tokens that a shorter item must have, and share of a window's tokens that must be literal.
WINDOW, LEAST, LITERAL = 8, 5, 0.6
FILTER_BITS = 24
#: Bytes of text whose tokens are handled at once.
SLICE = 1 << 18
NUMBER, UNIT, NAME, RAW = (np.uint64(x) for x in (0xA11CE5ED00000001, 0xA11CE5ED00000003, 0xA11CE5ED00000005, 0xA11CE5ED00000007))

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 letter, 2 digit
_KIND[128:] = 1
_LOWER = np.arange(256, dtype=np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz":
    _KIND[_c] = _KIND[_c - 32] = 1
    _LOWER[_c - 32] = _c
for _c in b"0123456789":
    _KIND[_c] = 2
_ENDING = np.zeros(256, bool)
_ENDING[list(b".!?:;\n")] = True


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer("".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) for u in UNITS])
    return np.sort(span_hash(byte_prefix(data), ends - [len(u) for u in UNITS], ends))


class Template:
    """Tokens of a slice: place, row, value (hash of the lower-cased word or a placeholder) and whether it is a slot.

    A number is a run of digits with inner points and commas; a unit is a unit word after a number; a name is a
    capitalised word that does not begin a sentence. Letters are ASCII letters and all bytes from 0x80 on.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind = _KIND[data]
        if len(data) > 2:
            join = ((data[1:-1] == 0x2E) | (data[1:-1] == 0x2C)) & (kind[:-2] == 2) & (kind[2:] == 2)
            kind[1:-1][join] = 2
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[offsets] = True
        cuts = np.flatnonzero(edge)
        starts, ends = cuts[:-1], cuts[1:]
        solid = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
        self.starts, self.ends = starts[solid], ends[solid]
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        self.offsets = np.searchsorted(self.row, np.arange(len(offsets)))
        self.data = data
        lower = _LOWER[data]
        if len(data) > 1:
            capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
            lower[1:][capital] += 0x20
        n = len(self.starts)
        if not n:
            self.values, self.slot = np.zeros(0, np.uint64), np.zeros(0, bool)
            self.raw = self.values
            return
        self.raw = self.values = span_hash(byte_prefix(lower), self.starts, self.ends)
        number = kind[self.starts] == 2
        after_number = np.zeros(n, bool)
        after_number[1:] = number[:-1] & (self.row[1:] == self.row[:-1])
        unit = after_number & np.isin(self.values, _UNIT_HASHES)
        changed = lower != data
        upper = changed[self.starts] | ((data[self.starts] == 0xC3) & changed[np.minimum(self.starts + 1, len(data) - 1)])
        second = np.minimum(self.starts + 1 + (data[self.starts] == 0xC3), len(data) - 1)
        mixed = (self.starts + 1 < self.ends) & ~changed[second] & (kind[second] == 1)
        seen = np.concatenate([[0], np.cumsum(_ENDING[data])])
        inside = np.zeros(n, bool)
        inside[1:] = (seen[self.starts[1:]] == seen[self.ends[:-1]]) & (self.row[1:] == self.row[:-1])
        name = upper & mixed & inside & ~number & ~unit
        self.slot = number | unit | name
        self.values = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, self.values)))

    def windows(self, length: int, raw: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First token and hash of every window of a row: of its template, or of its own tokens."""
        h = sequence_hashes(self.raw if raw else self.values, length, WINDOWS)
        n = len(h)
        at = np.flatnonzero(self.row[:n] == self.row[length - 1 : length - 1 + n])
        return at, mix(h[at] + np.uint64(length) + (RAW if raw else np.uint64(0)))

    def literals(self, at: np.ndarray, length: int) -> np.ndarray:
        """Number of literal tokens of windows."""
        slots = np.concatenate([[0], np.cumsum(self.slot)])
        return length - (slots[at + length] - slots[at])

    def searched(self) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
        """Length, raw, first tokens and hashes of the windows by which the rows are searched.

        Template windows of WINDOW tokens (all tokens of a shorter row) with a share LITERAL of literal ones. A row that
        has none is searched by windows of its own tokens, and by template windows of half the row (at least WINDOW
        tokens, or all of a shorter row) that hold a literal token.
        """
        sizes = np.diff(self.offsets)
        dense = sizes >= LEAST
        for length in range(LEAST, WINDOW + 1):
            at, h = self.windows(length)
            good = (self.literals(at, length) >= LITERAL * length) & ((length == WINDOW) | (sizes[self.row[at]] == length))
            dense[self.row[at[good]]] = False
            yield length, False, at[good], h[good]
        for r in np.flatnonzero(dense):
            n = int(sizes[r])
            for raw, length in ((True, min(n, WINDOW)), (False, min(n, max(WINDOW, (n + 1) // 2)))):
                at, h = self.windows(length, raw)
                good = (self.row[at] == r) & (raw | (self.literals(at, length) > 0))
                yield length, raw, at[good], h[good]

    def slots(self, first: int, length: int) -> list[str]:
        """Values of the slots of a window, in order, lower-cased."""
        return [self.data[self.starts[k] : self.ends[k]].tobytes().decode("utf-8", "replace").lower() for k in range(first, first + length) if self.slot[k]]


_UNIT_HASHES = _unit_hashes()


def window_rows(batch: pa.RecordBatch, wanted: list[tuple[int, bool]] | None, chosen: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The rows of template_windows of a batch of (id, text)."""
    ids = batch.column(0)
    for first, last, data, offsets in text_slices(batch, "text", SLICE):
        t = Template(data, offsets)
        for length, raw, at, h in t.searched() if wanted is None else ((n, raw, *t.windows(n, raw)) for n, raw in wanted):
            if chosen is not None:
                cell = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                some = (chosen[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
                at, h = at[some], h[some]
            if not len(at):
                continue
            yield pa.record_batch(
                {
                    "id": ids.slice(first, last - first).take(pa.array(t.row[at])),
                    "pos": pa.array((at - t.offsets[t.row[at]]).astype(np.int32)),
                    "length": pa.array(np.full(len(at), length, np.int32)),
                    "raw": pa.array(np.full(len(at), raw)),
                    "hash": pa.array(h.view(np.int64)),
                    "slots": pa.array([t.slots(k, length) for k in at.tolist()], pa.list_(pa.string())),
                }
            )


def template_windows(texts: DataFrame, wanted: list[tuple[int, bool]] | None, chosen: np.ndarray | None) -> DataFrame:
    """id, pos, length, raw, hash, slots of windows.

    wanted None: the windows by which items are searched; else all windows of these lengths, of the template or raw.
    chosen: bit filter of hashes of interest; windows outside it are left out where they are found.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from window_rows(batch, wanted, shared.value)

    return texts.mapInArrow(lean(run), "id long, pos int, length int, raw boolean, hash long, slots array<string>")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", min_share: float = 0.3
) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, exact: documents that hold a benchmark item, re-parameterised or not.

    Windows of 8 template tokens (numbers, units and names are typed placeholders) are joined by hash; windows on
    one diagonal of a document and an item count where every item value stands for one document value throughout;
    where values conflict, only windows with the item's own values count.
    A pair is put out when at least min_share of the item's windows are found; exact says that all slots agree.
    Items under 8 tokens are one window, items under 5 are not checked. An item without a window of enough literal
    tokens is searched both by windows of its own tokens and by template windows of half its length with a literal token;
    where all its tokens are slots, only by its own tokens. The counts are those of the kind of which the larger share was found. Null texts and ids match nothing. Items
    that repeat are found each; rows that share an id are one document. A fixed bit filter of the benchmark's hashes
    (2 MB) spares the rest of the corpus from leaving its task; the join behind it is exact.
    """
    items = benchmark.filter(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("text"))
    left = template_windows(items, None, None).select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "length", "raw", "hash", F.col("slots").alias("item_slots"))
    cells = left.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).cast("long").alias("cell")).distinct()
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    wanted = sorted(tuple(r) for r in left.select("length", "raw").distinct().collect())
    packed = cells.groupBy(F.expr("cell div 8").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(cell % 8 as int))")).alias("bits"))
    for byte, value in packed.toLocalIterator():
        bits[byte] = value
    chosen = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    right = template_windows(chosen, wanted or [(WINDOW, False)], bits).withColumnRenamed("id", "doc_id")
    pairs = F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    joined = right.join(left, ["hash", "length", "raw"]).filter(F.size("slots") == F.size("item_slots")).withColumn("pairs", pairs)
    literal = F.forall("pairs", lambda p: p["i"] == p["d"])
    runs = joined.groupBy("doc_id", "item_id", "raw", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(
        F.collect_set("item_pos").alias("any_place"),
        F.collect_set(F.when(literal, F.col("item_pos"))).alias("literal_place"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"])))
    runs = runs.withColumn("places", F.when(consistent, F.col("any_place")).otherwise(F.col("literal_place"))).filter(F.size("places") > 0)
    totals = left.groupBy("item_id", "raw").agg(F.count_distinct("item_pos").alias("item_windows"))
    found = (
        runs.groupBy("doc_id", "item_id", "raw")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_windows"),
            F.max(F.forall("pairs", lambda p: p["i"] == p["d"])).alias("exact"),
        )
        .join(totals, ["item_id", "raw"])
        .filter(F.col("n_windows") >= min_share * F.col("item_windows"))
    )
    best = F.max_by(F.struct("n_windows", "item_windows"), F.struct(F.col("n_windows") / F.col("item_windows"), "raw"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best"), F.max("exact").alias("exact")).select("doc_id", "item_id", "best.n_windows", "best.item_windows", "exact")
