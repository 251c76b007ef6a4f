"""Near copies by five-word shingles: MinHash bands propose pairs, exact Jaccard similarity confirms them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WINDOWS, byte_prefix, lean, materialise, mix, released, sequence_hashes, small_batches, span_hash, text_slices, words_of
from quern.llm.components import connected_components
from quern.llm.repeats import merged_sketch
from quern.llm.simhash import near_duplicates

#: Words of a shingle, least similarity in tenths, and bands of so many minima: a pair at 0.8 shares no band with
#: probability (1 - 0.8 ** 4) ** 18 = 8e-5.
WORDS, TENTHS, BANDS, ROWS = 5, 8, 18, 4
#: Bytes of text whose shingles are handled at once.
SLICE = 1 << 18
_DRAWN = np.random.default_rng(5).integers(1, 1 << 63, (3, BANDS * ROWS), dtype=np.uint64)
FACTORS, MASKS, WEIGHTS = _DRAWN[0] << np.uint64(1) | np.uint64(1), _DRAWN[1], _DRAWN[2] | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of the different five-word shingles of every row, by row and hash; words are lower-cased in A-Z, and
    a row of fewer words is one shingle."""
    starts, ends, row = words_of(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lower = data.copy()
    lower[(data >= 0x41) & (data <= 0x5A)] += 0x20
    values = span_hash(byte_prefix(lower), starts, ends)
    hashes, rows = [], []
    count = np.bincount(row, minlength=len(offsets) - 1)
    for length in range(1, WORDS + 1):
        h = sequence_hashes(values, length, WINDOWS)
        at = np.flatnonzero((row[: len(h)] == row[length - 1 : length - 1 + len(h)]) & ((length == WORDS) | (count[row[: len(h)]] == length)))
        hashes.append(mix(h[at] + np.uint64(length)))
        rows.append(row[at])
    h, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def set_names(hashes: np.ndarray, edges: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mix(np.add.reduceat(mix(hashes), edges) + sizes.astype(np.uint64))


def set_marks(docs: DataFrame, sets: bool) -> DataFrame:
    """doc_id, node (a hash that names the set), n_shingles, and the set's hashes or its bands, of every text with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch, "text", SLICE):
                h, r = shingle_sets(data, offsets)
                if not len(h):
                    continue
                edges = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                sizes = np.diff(np.append(edges, len(h)))
                if sets:
                    parts = pa.ListArray.from_arrays(pa.array(np.append(edges, len(h)).astype(np.int32)), pa.array(h.view(np.int64)))
                else:
                    bands = np.zeros((len(edges), BANDS), np.uint64)
                    for k in range(BANDS * ROWS):
                        bands[:, k // ROWS] += mix(np.minimum.reduceat((h ^ MASKS[k]) * FACTORS[k], edges)) * WEIGHTS[k]
                    parts = pa.ListArray.from_arrays(pa.array(np.arange(len(edges) + 1, dtype=np.int32) * BANDS), pa.array(mix(bands.ravel()).view(np.int64)))
                ids = batch.column(0).slice(first, last - first).take(pa.array(r[edges]))
                yield pa.record_batch({"doc_id": ids, "node": pa.array(set_names(h, edges, sizes).view(np.int64)), "n_shingles": pa.array(sizes.astype(np.int64)), "parts": parts})

    return docs.mapInArrow(lean(run), "doc_id long, node long, n_shingles long, parts array<long>")


def alike(common, a, b):
    """Whether sets of a and b shingles with so many in common are similar enough."""
    return 10 * common >= TENTHS * (a + b - common)


def sets_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n_shingles, parts (the hashes of the set) of every node of (node, doc_id)."""
    chosen = nodes.select(F.col("node").alias("chosen"), F.col("doc_id").alias("id"))
    some = texts.join(chosen.select("id").distinct(), texts.doc_id == F.col("id"), "left_semi")
    found = set_marks(some, True).join(chosen, (F.col("doc_id") == F.col("id")) & (F.col("node") == F.col("chosen")))
    return found.select("node", "n_shingles", "parts").dropDuplicates(["node"])


def shared_shingles(sets: DataFrame) -> DataFrame:
    """node, common: at least as many of a set's shingles as stand in another set too, by a sketch that counts no shingle
    of two sets as one."""

    def values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        parts = batch.column(0)
        for first in range(0, len(parts), 4096):
            yield np.asarray(parts.slice(first, 4096).flatten()).view(np.uint64)

    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    shared = sets.sparkSession.sparkContext.broadcast(merged_sketch(sets.select("parts"), values, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                parts = batch.column(1).slice(first, 4096)
                again = np.concatenate([[0], np.cumsum(shared.value.repeated(np.asarray(parts.flatten()).view(np.uint64)))])
                edges = np.concatenate([[0], np.cumsum(np.asarray(parts.value_lengths()))])
                yield pa.record_batch({"node": batch.column(0).slice(first, 4096), "common": pa.array(np.diff(again[edges]))})

    return sets.select("node", "parts").mapInArrow(lean(run), "node long, common long")


def confirmed(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of pairs of nodes (a, b) whose sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("parts").alias("pa"))
    right = sets.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("parts").alias("pb"))
    common = F.size(F.array_intersect("pa", "pb"))
    return pairs.join(left, "a").join(right, "b").filter(alike(common, F.col("na"), F.col("nb"))).select(*pairs.columns)


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, component_id of every id that is not null: components of op5's links and of pairs of texts whose
    five-word shingles have a Jaccard similarity of 0.8 and more.

    Texts with one set are one node. A pair is proposed where it shares a MinHash band, its components are not yet one
    and both sets have enough shingles that stand in other sets too: what a set has alone is missing in any other. First
    every node meets the hubs of its band (the node with the largest share of such shingles, and the least node), then,
    with the components these give, all pairs of a band that still join two components, each in the first band it
    shares. So a group of near copies is mostly linked by its hub and not pair by pair, texts too far from all others
    pair with none, and no pair that could join two components is left out. Null texts and texts without a word are
    linked by op5's rule only; an empty table gives an empty result; rows that share an id are one document here; other
    columns are ignored.
    """
    texts = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession):
        near, edges = _linked(texts)
    roots = connected_components(edges).select(F.col("node").alias("__node"), "root")
    return near.join(roots, near.component_id == roots["__node"], "left").select("doc_id", F.coalesce("root", "component_id").alias("component_id"))


def _linked(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, component_id by op5's rule, and the links (a, b) of these components by shingles; both are written tables."""
    near = materialise(near_duplicates(texts).select("doc_id", "component_id").distinct(), "near-bits")
    marks = materialise(set_marks(texts, False), "near-marks")
    homes = marks.select("doc_id", "node").join(near, "doc_id").groupBy("node", "component_id").agg(F.lit(1).alias("__one")).drop("__one")
    homes = materialise(homes, "near-homes")
    home = homes.groupBy("node").agg(F.min("component_id").alias("comp"))
    nodes = marks.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("parts").alias("bands"))
    nodes = materialise(nodes.join(home, "node"), "near-nodes")
    released(marks)
    other = homes.join(home, "node").filter("comp <> component_id").select(F.col("comp").alias("x"), F.col("component_id").alias("y"))
    edges = materialise(other.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near-same")

    def rooted(rows: DataFrame) -> DataFrame:
        """Rows with comp, and the root of that component by the links so far."""
        roots = connected_components(edges).select(F.col("node").alias("__node"), F.col("root").alias("__root"))
        return rows.join(roots, rows.comp == roots["__node"], "left").withColumn("root", F.coalesce("__root", "comp")).drop("__node", "__root")

    def mixed(rows: DataFrame) -> DataFrame:
        """Bands that hold more than one component."""
        return rows.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select(F.col("band").alias("__band"))

    banded = rooted(nodes).select("node", "doc_id", "n", "comp", "root", "bands", F.posexplode("bands").alias("place", "band"))
    bands = mixed(banded)
    held = materialise(banded.join(bands, banded.band == bands["__band"]).drop("__band"), "near-bands")
    sets = materialise(sets_of(texts, held.select("node", "doc_id").distinct()), "near-sets")
    shared = materialise(held.join(shared_shingles(sets), "node"), "near-shared")
    released(held)
    done = None
    for everyone in (False, True):
        if everyone:
            again = rooted(shared.drop("root"))
            bands = mixed(again)
            rows = again.join(bands, again.band == bands["__band"], "left_semi")
            firsts = rows
        else:
            rows = shared
            hubs = shared.groupBy(F.col("band").alias("__b")).agg(F.max_by("node", F.struct(F.col("common") / F.col("n"), "node")).alias("hub"), F.min("node").alias("least"))
            firsts = shared.join(hubs, shared.band == hubs["__b"]).filter("node = hub or node = least")
        firsts = firsts.select(
            F.col("band").alias("__band"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("common").alias("ca"), F.col("comp").alias("x"), F.col("root").alias("rx"), F.col("bands").alias("bx")
        )
        possible = alike(F.least("common", "ca"), F.col("n"), F.col("na"))
        sized = 10 * F.least("n", "na") >= TENTHS * F.greatest("n", "na")
        once = F.expr("array_position(zip_with(bands, bx, (p, q) -> p = q), true) = place + 1")
        order = F.col("a") < rows.node if everyone else F.col("a") != rows.node
        pairs = rows.join(firsts, (rows.band == F.col("__band")) & order & (F.col("rx") != rows.root) & sized & possible & once)
        pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"), F.least("x", "comp").alias("x"), F.greatest("x", "comp").alias("y")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        done = materialise(pairs, "near-pairs")
        links = confirmed(sets, done).filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = materialise(edges.unionByName(links).distinct(), "near-edges")
    released(sets)
    released(shared)
    return near, edges
