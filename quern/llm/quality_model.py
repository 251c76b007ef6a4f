"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import is_held_out, text_slices

#: Bytes a filter sees and steps over, dimensions of a byte's embedding, filters.
WIDTH, STRIDE, DIMENSIONS, FILTERS = 8, 4, 8, 24
#: Positions pooled to a block; blocks of a chunk and blocks from one chunk to the next: chunks overlap by one block.
BLOCK, CHUNK_BLOCKS, CHUNK_STEP = 16, 16, 15
BLOCK_BYTES = BLOCK * STRIDE
#: Positions convolved at a time.
PART = 1 << 14


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each filled with zero bytes to whole blocks (one at least); first block of each row."""
    blocks = np.maximum(1, -(-np.diff(offsets) // BLOCK_BYTES))
    edge = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(edge[-1] * BLOCK_BYTES + WIDTH, np.uint8)
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        at = edge[row] * BLOCK_BYTES
        out[at : at + b - a] = data[a:b]
    return out, edge


def chunk_bounds(edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last block (exclusive) of every chunk, and its row."""
    blocks = np.diff(edge)
    chunks = np.maximum(1, -(-(blocks - (CHUNK_BLOCKS - CHUNK_STEP)) // CHUNK_STEP))
    row = np.repeat(np.arange(len(blocks)), chunks)
    k = np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    first = edge[row] + k * CHUNK_STEP
    return first, np.minimum(first + CHUNK_BLOCKS, edge[row + 1]), row


class ByteNetwork:
    """Embedding, filters, pooling by chunk, mean and maximum over chunks, one logistic unit."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.5, (256, DIMENSIONS)).astype(np.float32),
            "w": rng.normal(0, (2 / (WIDTH * DIMENSIONS)) ** 0.5, (WIDTH * DIMENSIONS, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "v": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }

    def blocks(self, text: np.ndarray, edge: np.ndarray, places: bool = False):
        """Largest response of each filter in each block and, for training, where.

        The last position of a row would see the next row's bytes and is left out; the one before it sees all of its own.
        """
        positions, final = int(edge[-1]) * BLOCK, edge[1:] * BLOCK - 1
        out = np.empty((positions // BLOCK, FILTERS), np.float32)
        where = np.empty((positions // BLOCK, FILTERS), np.int64) if places else None
        for first in range(0, positions, PART):
            n = min(PART, positions - first)
            part = self.p["e"][text[first * STRIDE : (first + n - 1) * STRIDE + WIDTH]]
            view = np.lib.stride_tricks.as_strided(part, (n, WIDTH * DIMENSIONS), (STRIDE * DIMENSIONS * 4, 4))
            z = view @ self.p["w"]
            z[final[slice(*np.searchsorted(final, [first, first + n]))] - first] = -np.inf
            z = z.reshape(-1, BLOCK, FILTERS)
            at = slice(first // BLOCK, (first + n) // BLOCK)
            if places:
                arg = z.argmax(axis=1)
                where[at] = arg + first + BLOCK * np.arange(len(arg))[:, None]
                out[at] = np.take_along_axis(z, arg[:, None, :], 1)[:, 0]
            else:
                out[at] = z.max(axis=1)
        out += self.p["b"]
        return np.maximum(out, 0), where

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, edge = padded(data, offsets)
        pooled, _ = self.blocks(text, edge)
        first, last, row = chunk_bounds(edge)
        chunks = _reduce(np.maximum, pooled, first, last)
        rows = np.searchsorted(row, np.arange(len(offsets) - 1))
        count = np.diff(np.append(rows, len(row)))
        mean = np.add.reduceat(chunks, rows, axis=0) / count[:, None]
        most = np.maximum.reduceat(chunks, rows, axis=0)
        z = np.hstack([mean, most]) @ self.p["v"] + self.p["c"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))

    def gradients(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss; only the pooled positions carry any."""
        data = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        text, edge = padded(data, offsets)
        pooled, where = self.blocks(text, edge, True)
        first, last, row = chunk_bounds(edge)
        grid = np.minimum(first[:, None] + np.arange(CHUNK_BLOCKS), last[:, None] - 1)
        best = pooled[grid].argmax(axis=1)
        block = np.take_along_axis(grid, best, 1)
        chunks = np.take_along_axis(pooled, block, 0)
        position = np.take_along_axis(where, block, 0)
        n = len(texts)
        rows = np.searchsorted(row, np.arange(n))
        count = np.diff(np.append(rows, len(row)))
        mean, most = np.add.reduceat(chunks, rows, axis=0) / count[:, None], np.maximum.reduceat(chunks, rows, axis=0)
        h = np.hstack([mean, most])
        p = 1 / (1 + np.exp(-np.clip(h @ self.p["v"] + self.p["c"], -40, 40)))
        g = ((p - y) * weight / weight.sum()).astype(np.float32)
        gh = g[:, None] * self.p["v"][None]
        gc = gh[row, :FILTERS] / count[row][:, None]
        top = (chunks == most[row]) & (chunks > 0)
        gc = (gc + gh[row, FILTERS:] * top / np.maximum(1, np.add.reduceat(top.astype(np.float32), rows, axis=0))[row]) * (chunks > 0)
        gw, ge = np.zeros_like(self.p["w"]), np.zeros_like(self.p["e"])
        for f in range(FILTERS):
            some = np.flatnonzero(gc[:, f])
            window = text[position[some, f][:, None] * STRIDE + np.arange(WIDTH)]
            gw[:, f] = gc[some, f] @ self.p["e"][window].reshape(len(some), -1)
            np.add.at(ge, window, gc[some, f][:, None, None] * self.p["w"][:, f].reshape(WIDTH, DIMENSIONS)[None])
        return {"e": ge, "w": gw, "b": gc.sum(axis=0), "v": h.T @ g, "c": g.sum(keepdims=True)}


def _reduce(ufunc, values, first, last):
    """ufunc over values[first:last] for ranges that may overlap."""
    ends = np.empty(2 * len(first), np.int64)
    ends[::2], ends[1::2] = first, last
    return ufunc.reduceat(np.vstack([values, values[-1:]]), ends, axis=0)[::2]


def train(texts: list[str], labels: list[int], share: float, epochs: int = 16, rate: float = 0.004, batch: int = 32, seed: int = 3) -> ByteNetwork:
    """Adam on the weighted log loss; rows are weighted so that label 1 has its share of all labelled rows."""
    net, rng = ByteNetwork(seed), np.random.default_rng(seed)
    texts, labels = list(texts), list(labels)
    # Short good texts are rare in a sample: every third good text also lends a snippet, which is good as well.
    for t in [t for t, y in zip(texts, labels) if y == 1][::3]:
        words = t.split()
        if words:
            at = int(rng.integers(len(words)))
            texts.append(" ".join(words[at : at + int(rng.integers(1, 13))]))
            labels.append(1)
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    y = np.array(labels, np.float32)
    if not len(y):
        return net
    ones = y.mean()
    weight = np.where(y == 1, share / max(ones, 1e-6), (1 - share) / max(1 - ones, 1e-6)).astype(np.float32)
    m, s, t = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for first in range(0, len(order), batch):
            some = order[first : first + batch]
            grads = net.gradients([raw[k] for k in some], y[some], weight[some])
            t += 1
            now = rate * (1 - epoch / epochs) + 1e-4
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                net.p[k] = (net.p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def fit_quality_model(docs: DataFrame, labels: DataFrame, key="doc_id", text="text", label="quality", most_per_label: int = 1500, seed: int = 11) -> ByteNetwork:
    """Fit on labelled rows that are not held out; most_per_label bounds the sample collected for each label.

    The sample is chosen from the narrow label table by keyed hash, so the documents are joined with at most
    4 * most_per_label rows and their texts are not shuffled. Repeated label rows count once, and an id with several
    texts lends the least one, so reruns agree and no id, however many rows share it, adds more than one text a label.
    Null texts count as empty; without labelled rows the weights stay as drawn.
    """
    rows = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~is_held_out(F.col(key))).select(key, label).distinct()
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count("*")).collect()}
    total = sum(counts.values())
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == value, F.lit(min(1.0, most_per_label / n))).otherwise(share)
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 24)) / float(1 << 24)
    chosen = rows.filter(u < share).orderBy(u, key, label).limit(4 * most_per_label).select(F.col(key).alias("__id"), F.col(label).cast("int").alias("label"))
    texts = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col(key) == F.col("__id"))
    found = texts.groupBy(key, "label").agg(F.min("text").alias("text")).select(key, "text", "label").collect()
    found.sort(key=lambda r: (r[0], r[2], r[1]))
    return train([r["text"] for r in found], [r["label"] for r in found], counts.get(1, 0) / total if total else 0.5)


def quality_scores(docs: DataFrame, model: ByteNetwork, key: str = "doc_id", text: str = "text", limit: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text; null counts as empty, and empty texts are scored too.

    A document's chunks cover all its bytes and overlap; a very long text only adds chunks. Rows are independent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch, "text", 2 << 20):
                score = shared.value.scores(data, offsets)
                yield pa.record_batch(
                    {"doc_id": batch.column(0).slice(first, last - first), "score": pa.array(score), "predicted": pa.array((score >= limit).astype(np.int32))}
                )

    found = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
