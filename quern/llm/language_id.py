"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD, with calibrated rejection."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import is_held_out, lean, text_slices

UNKNOWN = "und"
#: Orders of the byte n-grams, hash buckets (one more stands for "no feature") and dimensions of an embedding.
ORDERS, BUCKETS, DIMENSIONS = (2, 3, 4), 1 << 16, 16
_LETTER = re.compile(r"[^\W\d_]")


def _folded() -> np.ndarray:
    table = np.full(256, 0x20, np.uint8)
    table[128:] = np.arange(128, 256)
    for c in b"abcdefghijklmnopqrstuvwxyz":
        table[c] = table[c - 32] = c
    return table


FOLDED = _folded()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


def subword_buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram at every byte, BUCKETS where there is none.

    ASCII letters are lower-cased, Latin-1 capitals folded, other ASCII made a space; an n-gram lies in one word
    with the spaces beside it, and in one row.
    """
    folded = FOLDED[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        folded[1:][capital] += 0x20
    space = folded == 0x20
    wide = folded.astype(np.uint32)
    ends = offsets[1:]
    for n in ORDERS:
        count = len(data) - n + 1
        if count <= 0:
            continue
        code = wide[:count].copy()
        inner = np.zeros(count, bool)
        for k in range(1, n):
            code = code * np.uint32(257) + wide[k : k + count]
            if k < n - 1:
                inner |= space[k : k + count]
        bucket = ((code ^ (code >> np.uint32(15))) * np.uint32(2654435761 + 2 * n) >> np.uint32(16)).astype(np.int32)
        bucket[inner | (space[:count] & space[n - 1 : n - 1 + count])] = BUCKETS
        for k in range(1, n):
            cross = ends - k
            bucket[cross[(cross >= 0) & (cross < count)]] = BUCKETS
        yield bucket


def _row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values that start in each row; the last bytes of a slice may have none."""
    edge = np.minimum(offsets, len(values))
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64)
    filled = np.flatnonzero(edge[1:] > edge[:-1])
    if len(filled):
        out[filled] = np.add.reduceat(values, edge[filled], axis=0, dtype=np.float64)
    return out


@dataclass
class LanguageModel:
    """Labels, a table of each bucket's scores (embedding times output weights), bias, temperature and rejection limit."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count = np.zeros((len(offsets) - 1, len(self.labels))), np.zeros(len(offsets) - 1)
        for bucket in subword_buckets(data, offsets):
            total += _row_sums(self.table[bucket], offsets)
            count += _row_sums((bucket < BUCKETS).astype(np.float32), offsets)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _softmax(self.logits(data, offsets) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def train(texts: list[str], languages: list[str], epochs: int = 6, rate: float = 4.0, keep_share: float = 0.999, seed: int = 5) -> LanguageModel | None:
    """Fit on whole texts and on short snippets of them; a fifth of the texts sets temperature and rejection limit.

    The limit is the largest score below which at most 1 - keep_share of the rightly predicted texts fall, 0.5 at most.
    """
    labels = sorted(set(languages))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    number = {x: k for k, x in enumerate(labels)}
    examples, y, fold = [], [], []
    for k, (text, language) in enumerate(zip(texts, languages)):
        words = text.split()
        if not words:
            continue
        at, size = int(rng.integers(len(words))), int(rng.integers(1, 9))
        for x in (text, " ".join(words[at : at + size])):
            examples.append(x.encode())
            y.append(number[language])
            fold.append(k % 5 == 0 and len(texts) >= 10)
    y, fold = np.array(y), np.array(fold)
    if not len(y):
        return None
    features = []
    for x in examples:
        data, offsets = _flat([x])
        parts = [b[b < BUCKETS] for b in subword_buckets(data, offsets)]
        ids, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int32), return_counts=True)
        features.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w, bias = np.zeros((DIMENSIONS, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    w += rng.normal(0, 0.1, w.shape).astype(np.float32)
    fit = np.flatnonzero(~fold)
    steps = max(1, epochs * len(fit) // 16)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(fit)
        for first in range(0, len(order), 16):
            batch = order[first : first + 16]
            now = rate * max(0.05, 1 - step / steps)
            step += 1
            ids = np.concatenate([features[k][0] for k in batch])
            weight = np.concatenate([features[k][1] for k in batch])
            row = np.repeat(np.arange(len(batch)), [len(features[k][0]) for k in batch])
            mean = np.zeros((len(batch), DIMENSIONS), np.float32)
            np.add.at(mean, row, e[ids] * weight[:, None])
            p = _softmax(mean @ w + bias)
            p[np.arange(len(batch)), y[batch]] -= 1
            p = (p / len(batch)).astype(np.float32)
            grad = p @ w.T
            w -= now * mean.T @ p
            bias -= 0.1 * now * p.sum(axis=0)
            np.add.at(e, ids, (-now * 16) * grad[row] * weight[:, None])
    table = np.vstack([e @ w, np.zeros((1, len(labels)), np.float32)]).astype(np.float32)
    model = LanguageModel(labels, table, bias.astype(np.float64))
    held = np.flatnonzero(fold)
    if len(held):
        data, offsets = _flat([examples[k] for k in held])
        logits, truth = model.logits(data, offsets), y[held]
        losses = {t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), truth], 1e-12)).mean() for t in np.geomspace(0.05, 5, 60)}
        model.temperature = float(min(losses, key=losses.get))
        p = _softmax(logits / model.temperature)
        whole = (np.arange(len(held)) % 2 == 0) & (p.argmax(axis=1) == truth)
        if whole.any():
            model.limit = float(min(0.5, np.quantile(p.max(axis=1)[whole], 1 - keep_share) * 0.999))
    return model


def training_sample(docs: DataFrame, key: str, text: str, label: str, most_per_label: int, seed: int) -> DataFrame:
    """About most_per_label rows of each label, at most twice that: rows whose keyed hash falls under the label's share,
    the least hashes first where the bound binds; ties end in the id, the label and the text, so reruns agree."""
    rows = docs.filter(~is_held_out(F.col(key)) & F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count("*")).collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == value, F.lit(min(1.0, most_per_label / n))).otherwise(share)
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 24)) / float(1 << 24)
    found = rows.filter(u < share).select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(label).alias("label"), u.alias("u"))
    return found.orderBy("u", "doc_id", "label", "text").limit(2 * most_per_label * max(1, len(counts))).select("doc_id", "text", "label")


def fit_language_model(docs: DataFrame, key="doc_id", text="text", language="lang", most_per_label: int = 800, seed: int = 11) -> LanguageModel | None:
    """Fit on the rows that are not held out; most_per_label bounds the sample collected for each language."""
    rows = training_sample(docs, key, text, language, most_per_label, seed).collect()
    rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["label"], r["text"]))
    return train([r["text"] for r in rows], [r["label"] for r in rows])


def predict_languages(docs: DataFrame, model: LanguageModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every whole text.

    Null texts and texts without a letter are `und` with score 0, and rejected; others get the likeliest learned
    language with its calibrated probability, and are rejected where that is under the model's limit. Without a
    model (no labelled row) every text is `und`. Rows are independent, repeats give repeats.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column(1)
            for first, last, data, offsets in text_slices(batch, "text", 1 << 18):
                lettered = np.array([has_letter(t) for t in column.slice(first, last - first).to_pylist()])
                label, score = np.full(last - first, UNKNOWN, object), np.zeros(last - first)
                limit = np.inf
                if m is not None:
                    p = m.probabilities(data, offsets)
                    best = p.argmax(axis=1)
                    label[lettered] = np.array(m.labels, object)[best[lettered]]
                    score[lettered] = p[np.arange(len(best)), best][lettered]
                    limit = m.limit
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(first, last - first),
                        "lang_pred": pa.array(label, pa.string()),
                        "score": pa.array(np.clip(score, 0, 1)),
                        "rejected": pa.array(~lettered | (score < limit)),
                    }
                )

    found = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def language_filter(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """The rows that the model does not reject, with all their columns, in one pass over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for first, last, data, offsets in text_slices(batch, text, 1 << 18):
                keep = np.array([has_letter(t) for t in column.slice(first, last - first).to_pylist()])
                if m is not None:
                    keep &= m.probabilities(data, offsets).max(axis=1) >= m.limit
                else:
                    keep[:] = False
                yield batch.slice(first, last - first).filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)
