"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import materialise, n_words

#: Fractional part of the golden ratio, and of 2**26 times it (so that slots up to 2**52 keep their precision).
GOLDEN = 0.6180339887498949
GOLDEN_HIGH = (GOLDEN * (1 << 26)) % 1.0
#: Slots in a chunk, the unit in which ranks are counted.
CHUNK = 1 << 16
#: Words in a block, at most, and blocks of a source, at least (as far as it has words).
BLOCK_WORDS, LEAST_BLOCKS = 4096, 1024
#: Documents in a bucket of a source's shuffled order, about, and buckets of a source, at most: groups of one size,
#: whatever a source's share, and few sums to add up in order.
BUCKET_DOCS, MOST_BUCKETS = 500, 100_000


def target_sizes(sizes: Sequence[int], weights: Sequence[float], most: float) -> list[float]:
    """Targets that share the sum of sizes by weight, each at most `most` times its size; the excess is reshared."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > most * sizes[i]] if whole else []
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole if whole else 0.0
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


def slot_sources(slots: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The source of each slot: golden-ratio points mapped through cumulative weights."""
    high, low = slots >> 26, slots & ((1 << 26) - 1)
    u = (0.5 + (high * GOLDEN_HIGH) % 1.0 + (low * GOLDEN) % 1.0) % 1.0
    return np.minimum(np.searchsorted(bounds, u, "right"), len(bounds) - 1)


def schedule(spark, slots: int, bounds: np.ndarray, blocks: np.ndarray, most: int) -> DataFrame:
    """slot, source_no, block, epoch: slots ranked per source and dealt to its blocks in turn.

    Ranks come from counts by chunk of slots, summed before each chunk, so chunks are ranked apart.
    """
    chunks = -(-slots // CHUNK)
    base = spark.range(chunks, numPartitions=max(1, min(chunks, 2000)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                s = slot_sources(np.arange(chunk * CHUNK, min(slots, (chunk + 1) * CHUNK), dtype=np.int64), bounds)
                n = np.bincount(s, minlength=len(bounds))
                yield pa.record_batch({"chunk": pa.array([chunk] * len(n), pa.int64()), "source_no": pa.array(np.arange(len(n), dtype=np.int32)), "n": pa.array(n.astype(np.int64))})

    counts = base.mapInArrow(counted, "chunk long, source_no int, n long")
    before = W.partitionBy("source_no").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
        .groupBy("chunk")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("source_no", "before"))), lambda x: x["before"]).alias("before"))
    )

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                slot = np.arange(chunk * CHUNK, min(slots, (chunk + 1) * CHUNK), dtype=np.int64)
                s = slot_sources(slot, bounds)
                order = np.argsort(s, kind="stable")
                n = np.bincount(s, minlength=len(bounds))
                rank = np.empty(len(s), np.int64)
                rank[order] = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
                rank += np.asarray(before, np.int64)[s]
                epoch = rank // blocks[s]
                keep = epoch < most
                yield pa.record_batch(
                    {"slot": pa.array(slot[keep]), "source_no": pa.array(s[keep].astype(np.int32)), "block": pa.array((rank % blocks[s])[keep]), "epoch": pa.array(epoch[keep].astype(np.int32))}
                )

    return offsets.mapInArrow(dealt, "slot long, source_no int, block long, epoch int")


class Mix:
    """A mix of documents: sources (driver list), sized rows with their place in the source's shuffled words, uses.

    Sources are ordered by code point, null last, and weighted by `weights`, repeating. The list of sources is as
    long as a list of weights that a user sets, and is kept on the driver.
    """

    def __init__(self, docs: DataFrame, key="doc_id", text="text", source="source", weights=(5.0, 2.0, 1.0), most=3, seed=7):
        spark = docs.sparkSession
        h = F.xxhash64(F.col(key), F.lit(seed))
        sized = materialise(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), h.alias("h")), "op1-sizes")
        found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["size"] for r in found]
        self.targets = target_sizes(sizes, [weights[i % len(weights)] for i in range(len(found))], most)
        self.block_words = [max(1, min(BLOCK_WORDS, -(-s // LEAST_BLOCKS))) for s in sizes]
        blocks = np.array([max(1, -(-s // b)) for s, b in zip(sizes, self.block_words)], np.int64)
        wanted = np.array([t * b / s if s else 0.0 for t, b, s in zip(self.targets, blocks, sizes)])
        slots = int(round(wanted.sum()))
        buckets = [max(1, min(MOST_BUCKETS, r["docs"] // BUCKET_DOCS)) for r in found]
        table = [(i, r["source"], r["size"], self.targets[i], self.block_words[i], buckets[i]) for i, r in enumerate(found)]
        self.sources = spark.createDataFrame(table, "source_no int, source_name string, source_size long, target double, block_words long, buckets long")
        bounds = np.cumsum(wanted) / wanted.sum() if slots else np.ones(1)
        self.schedule = schedule(spark, slots, bounds, blocks, int(most))
        self.uses = self.schedule.groupBy("source_no", "block").agg(F.count("*").alias("uses"))
        bucket = F.floor((F.col("h") / 2.0**64 + 0.5) * F.col("buckets")).cast("long")
        rows = sized.join(self.sources, sized.source.eqNullSafe(F.col("source_name"))).withColumn("bucket", bucket)
        # Places in the shuffled order: sums by bucket first, so that a large source is not one window.
        sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
        earlier = W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))).drop("n")
        inside = W.partitionBy("source_no", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
        placed = rows.join(sums, ["source_no", "bucket"]).withColumn("first", F.col("before") + F.sum("size").over(inside) - F.col("size"))
        self.rows = placed.select("doc_id", "source_no", "source_name", "size", "source_size", "target", "block_words", "first")

    def pieces(self) -> DataFrame:
        """One row per document and block it reaches into: the words there."""
        last = F.col("first") + F.col("size")
        b = F.col("block_words")
        block = F.explode(F.sequence(F.floor(F.col("first") / b), F.floor((last - 1) / b)))
        words = F.least(last, (F.col("block") + 1) * b) - F.greatest(F.col("first"), F.col("block") * b)
        return self.rows.filter("size > 0").withColumn("block", block).withColumn("words", words)

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken, source of every row of the documents."""
        keep = ["doc_id", "source_no", "source_name", "size", "source_size", "target", "first"]
        used = (
            self.pieces()
            .join(self.uses, ["source_no", "block"], "left")
            .groupBy(*keep)
            .agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).cast("long").alias("taken"))
        )
        none = self.rows.filter("size = 0").select(*keep, F.lit(0).cast("long").alias("taken"))
        return used.unionByName(none).select("doc_id", "size", "source_size", "target", "taken", F.col("source_name").alias("source"))

    def copies(self) -> DataFrame:
        """doc_id, copies: how often the mix takes the block with a document's first word."""
        starts = self.rows.filter("size > 0").withColumn("block", F.floor(F.col("first") / F.col("block_words")))
        return starts.join(self.uses, ["source_no", "block"]).select("doc_id", F.col("uses").cast("int").alias("copies"))


def mix_sources(docs: DataFrame, **parameters) -> DataFrame:
    """What a mix takes of every document, in words, repeats counted.

    Null and empty texts have size 0 and are taken 0 times; a source without words has target 0; null is a source of
    its own, last in order; an empty table gives an empty result. Rows that share an id are rows of their own. The
    order of documents within a source is that of a keyed hash, so that a rerun takes the same words.
    """
    return Mix(docs, **parameters).taken()
