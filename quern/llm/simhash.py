"""SimHash near-dedup: fingerprints of word shingles, generalised pigeonhole search, components of links."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import lean, materialise, text_slices, words_of
from quern.llm.components import connected_components

SHINGLE, SEED, BITS = 4, 42, 64


def fingerprints_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SimHash of each row of a slice: words lower-cased in A-Z, 4-word shingles joined by spaces, majority of bits."""
    rows = len(offsets) - 1
    out = np.zeros(rows, np.uint64)
    starts, ends, row = words_of(data, offsets)
    if not len(starts):
        return out
    lower = data.copy()
    lower[(data >= 0x41) & (data <= 0x5A)] += 0x20
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] += 1
    np.add.at(mark, ends, -1)
    keep = np.cumsum(mark[:-1], dtype=np.int8) > 0
    after = ends[ends < len(data)]
    after = after[~keep[after]]
    lower[after] = 0x20
    keep[after] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    text = lower[keep].tobytes()
    first = np.searchsorted(row, np.arange(rows))
    count = np.diff(np.append(first, len(row)))
    shingles = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    which = np.repeat(np.arange(rows), shingles)
    begin = np.repeat(first, shingles) + np.arange(len(which)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = begin + np.minimum(SHINGLE, count[which]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(place[starts[begin]].tolist(), place[ends[last]].tolist())), np.uint64, len(begin))
    full = np.flatnonzero(shingles)
    edges = np.cumsum(shingles)[full] - shingles[full]
    # Rows are summed in parts, so that unpacked bits stay small.
    for a in range(0, len(full), 64):
        some, lo = full[a : a + 64], edges[a]
        hi = edges[a + 64] if a + 64 < len(full) else len(hashes)
        bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, edges[a : a + 64] - lo, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > shingles[some][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (long with the fingerprint's bits) of every whole text; null and wordless texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch, "text", 1 << 18):
                yield pa.record_batch({"doc_id": batch.column(0).slice(first, last - first), "fp": pa.array(fingerprints_of(data, offsets).view(np.int64))})

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


@dataclass
class Pigeonhole:
    """Partitions of the bits and their thresholds: fingerprints that differ in at most `most` bits agree, in some
    partition, up to its threshold (thresholds plus one sum to most + 1; -1 leaves a partition out)."""

    parts: list[list[int]]
    thresholds: list[int]


def grouped_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of near-equal width; each grows by the bit most correlated with those it has."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    sd = bits.std(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.abs(np.nan_to_num(np.corrcoef(bits.T))) if len(sample) > 2 else np.zeros((BITS, BITS))
    c[sd == 0] = c[:, sd == 0] = 0
    free, parts = set(range(BITS)), []
    for k in range(m):
        width = (BITS * (k + 1)) // m - (BITS * k) // m
        part = [min(free, key=lambda b: (-c[b, list(free)].sum(), b))]
        free.discard(part[0])
        while len(part) < width:
            part.append(min(free, key=lambda b: (-c[b, part].sum(), b)))
            free.discard(part[-1])
        parts.append(sorted(part))
    return parts


def gather(values: np.ndarray, part: list[int]) -> np.ndarray:
    """The bits of a partition as a compact integer."""
    out = np.zeros(len(values), np.uint64)
    for k, b in enumerate(part):
        out |= (values >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
    return out


def flips(width: int, threshold: int) -> np.ndarray:
    """All masks of at most `threshold` of `width` bits."""
    return np.array([sum(1 << b for b in some) for t in range(threshold + 1) for some in combinations(range(width), t)], np.uint64)


def plan(sample: np.ndarray, total: int, most: int, widest: int = 2, probe_cost: float = 4.0) -> Pigeonhole:
    """Cheapest partitions and thresholds: for 2 to most + 1 partitions, a dynamic programme over them.

    The cost of a partition under a threshold is its probes plus the candidates estimated by probing the sample with
    itself, scaled to all fingerprints (with the share that uniform bits would give as the least).
    """
    best = None
    for m in range(2, most + 2):
        parts = grouped_bits(sample, m)
        cost = []
        for part in parts:
            values = gather(sample, part)
            known, counts = np.unique(values, return_counts=True)
            row = {-1: 0.0}
            for t in range(min(widest, most) + 1):
                masks = flips(len(part), t)
                near = 0.0
                for mask in masks:
                    at = np.searchsorted(known, known ^ mask)
                    at = np.minimum(at, len(known) - 1)
                    hit = known[at] == known ^ mask
                    near += float((counts * np.where(hit, counts[at], 0)).sum()) - (float(len(sample)) if mask == 0 else 0.0)
                uniform = total * len(masks) / 2.0 ** len(part)
                row[t] = probe_cost * len(masks) + max(uniform, near / max(1, len(sample)) * total / max(1, len(sample)))
            cost.append(row)
        table = {0: (0.0, [])}
        for row in cost:
            new: dict[int, tuple[float, list[int]]] = {}
            for used, (c, ts) in table.items():
                for t, x in row.items():
                    k = used + t + 1
                    if k <= most + 1 and (k not in new or c + x < new[k][0]):
                        new[k] = (c + x, [*ts, t])
            table = new
        if most + 1 in table and (best is None or table[most + 1][0] < best[0]):
            best = (table[most + 1][0], Pigeonhole(parts, table[most + 1][1]))
    return best[1]


def probes(distinct: DataFrame, scheme: Pigeonhole, index: bool) -> DataFrame:
    """part, value, fp: an index row per partition, or a probe row for each value within the partition's threshold."""
    jobs = [(k, part, flips(len(part), 0 if index else t)) for k, (part, t) in enumerate(zip(scheme.parts, scheme.thresholds)) if t >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            for a in range(0, len(fp), 20_000):
                some = fp[a : a + 20_000]
                for k, part, masks in jobs:
                    values = (gather(some, part)[:, None] ^ masks[None]).ravel()
                    # One long names partition and value; partitions are under 60 bits wide.
                    yield pa.record_batch({"probe": pa.array((values | np.uint64(k << 60)).view(np.int64)), "fp": pa.array(np.repeat(some, len(masks)).view(np.int64))})

    return distinct.select("fp").mapInArrow(run, "probe long, fp long")


def links(distinct: DataFrame, most: int, sample_rows: int = 20_000) -> DataFrame:
    """(a, b) with a < b: pairs of different fingerprints at most `most` bits apart; a pair can come more than once.

    The plan is fitted on a bounded sample; the search covers every fingerprint whatever the plan is.
    """
    total = distinct.count()
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp")).limit(sample_rows).collect()], np.int64).view(np.uint64)
    if total < 2:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    scheme = plan(sample, total, most)
    left = probes(distinct, scheme, False).withColumnRenamed("fp", "a")
    right = probes(distinct, scheme, True).select(F.col("probe").alias("value"), F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
    return left.join(right, (left.probe == right.value) & (F.col("a") < F.col("b")) & near).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id of every document.

    Equal fingerprints are one node, so a group of exact copies costs one row after its first aggregation. The
    component of a document is the smallest id that links reach from it, itself included. Null and wordless texts
    have fingerprint zero and are linked like any other; rows that share an id are separate; an empty table gives an
    empty result. A null id never names a component unless no other id is in it.
    """
    prints = materialise(fingerprints(docs, key, text), "op5-prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "op5-nodes")
    edges = materialise(links(nodes, most).distinct(), "op5-links")
    members = connected_components(edges)
    named = nodes.join(members, nodes.fp == members.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = named.select("fp", "root").join(names, "root").select(F.col("fp").alias("node"), "component_id")
    return prints.join(labelled, prints.fp == labelled.node).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
