"""Token-ID output: sequences in a keyed training order, in fixed-stride binary shards."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import IS_SPACE, byte_prefix, lean, materialise, shared_path, small_batches, span_hash, text_slices

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits a text into pieces for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
#: PATTERN for the regex module, with white space as Unicode has it.
_PIECES = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
#: Runs without white space from this length on are looked at piece by piece; pieces of more bytes than BLOCK are
#: encoded in blocks (merging is quadratic in a piece), of which the last MARGIN bytes wait for the next block.
LONG_RUN, BLOCK, MARGIN = 2048, 1024, 192
_RUN = re.compile(rf"\S{{{LONG_RUN}}}")
ROUNDS = 4
#: Bytes of text whose chunks are told apart together: whole arrays over it and powers that stay take about 70 times as much.
SLICE = 2 << 20


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts can be cut so that their parts encode as they do in the whole: at spaces before a visible character.

    PATTERN takes one space with the characters after it, so a piece always begins there. Characters that might be
    white space beyond ASCII are not counted as visible.
    """
    begin = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        after = data[1:]
        visible = ((after < 0x80) & ~IS_SPACE[after]) | ((after >= 0xC3) & (after < 0xE0))
        begin[:-2] = (data[:-1] == 0x20) & visible
    begin[offsets] = True
    return np.flatnonzero(begin[:-1])


class Tokenizer:
    """Byte-level BPE from a rank file; made once in each Python worker from the file's bytes.

    A slice is cut into chunks (a space and a word, mostly); its different chunks, told apart by a 64-bit hash of bytes
    and length, are encoded once, in one call for those that begin with a space and end visibly.
    """

    _made: dict[int, object] = {}
    _widths: dict[int, np.ndarray] = {}

    def __init__(self, ranks: bytes):
        self.ranks = ranks

    def encoding(self):
        key = hash(self.ranks)
        if key not in self._made:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            self._made[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        return self._made[key]

    def widths(self) -> np.ndarray:
        """Bytes of every token."""
        key = hash(self.ranks)
        if key not in self._widths:
            table = {int(b): len(base64.b64decode(a)) for a, b in map(bytes.split, self.ranks.splitlines())}
            self._widths[key] = np.array([table.get(k, 0) for k in range(max(table) + 1)], np.int64)
        return self._widths[key]

    def _ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoding()._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text, those of the tokenizer itself however long its runs without white space are."""
        if len(text) < LONG_RUN or not _RUN.search(text):
            return self._ids(text)
        one, out = self.encoding()._core_bpe.encode_single_piece, []
        for m in _PIECES.finditer(text):
            piece = m.group().encode()
            out += one(piece) if len(piece) <= BLOCK else self._long_piece(piece)
        return np.array(out, np.uint32)

    def _long_piece(self, piece: bytes) -> list[int]:
        """Ids of one long piece, in time linear in its length.

        A sequence of tokens is what merging gives for its bytes exactly if every two neighbours are what merging gives
        for theirs. So blocks are encoded apart, each from a token's end on, and every seam is tested; where a seam
        does not hold, the next block begins a token earlier and is twice as long.
        """
        core, widths = self.encoding()._core_bpe, self.widths()
        ids, at, size = [], 0, BLOCK
        while True:
            block = core.encode_single_piece(piece[at : at + size])
            if ids and at:
                left = core.decode_single_token_bytes(ids[-1])
                right = core.decode_single_token_bytes(block[0])
                if core.encode_single_piece(left + right) != [ids[-1], block[0]]:
                    at -= len(left)
                    ids.pop()
                    size *= 2
                    continue
            if at + size >= len(piece):
                return ids + block
            ends = np.cumsum(widths[block])
            kept = max(1, int(np.searchsorted(ends, size - MARGIN, "right")))
            ids += block[:kept]
            at, size = at + int(ends[kept - 1]), BLOCK

    def encode_slices(self, batch: pa.RecordBatch, ids: bool = True) -> Iterator[tuple]:
        """(first, last, ids, edges) of the rows of a batch, or (first, last, number of ids, None).

        A text over a slice is encoded in parts cut where PATTERN begins a piece, so only its ids are held as a whole.
        """
        for first, last, data, offsets in text_slices(batch, "text", SLICE):
            if len(data) <= SLICE:
                yield first, last, *(self.encode_rows(data, offsets) if ids else (self.encode_rows(data, offsets, False), None))
                continue
            made, at = [], 0
            while at < len(data):
                until = at + SLICE // 2
                while until < len(data):
                    starts = chunk_starts(data[until : until + SLICE // 2], np.array([0, min(len(data) - until, SLICE // 2)]))
                    if len(starts) > 1:
                        until += int(starts[1])
                        break
                    until += SLICE // 2
                part = data[at : min(until, len(data))]
                found = self.encode_rows(part, np.array([0, len(part)]), ids)
                made.append(found[0] if ids else found)
                at += len(part)
            yield first, last, *((both := np.concatenate(made), np.array([0, len(both)])) if ids else (sum(made), None))

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray, ids: bool = True):
        """(ids, edges): the token ids of all rows one after another, and where each row's begin and end; or, without
        ids, how many there are."""
        starts = chunk_starts(data, offsets)
        if not len(starts):
            return (np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)) if ids else 0
        ends = np.append(starts[1:], len(data))
        h = span_hash(byte_prefix(data), starts, ends)
        order = np.argsort(h)
        fresh = np.ones(len(h), bool)
        fresh[1:] = h[order[1:]] != h[order[:-1]]
        keys = order[fresh]
        a, b = starts[keys], ends[keys]
        last, before = data[b - 1], data[np.maximum(b - 2, 0)]
        closed = ((last < 0x80) & ~IS_SPACE[last]) | ((last >= 0x80) & (before >= 0xC3) & (before < 0xE0))
        plain = np.flatnonzero((data[a] == 0x20) & closed & (b - a < LONG_RUN))
        sizes, at = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        parts, held = [], 0
        if len(plain):
            width = b[plain] - a[plain]
            edge = np.cumsum(width)
            blob = data[np.arange(edge[-1]) + np.repeat(a[plain] - (edge - width), width)]
            made = self._ids(blob.tobytes().decode())
            until = np.searchsorted(np.cumsum(self.widths()[made]), edge) + 1
            sizes[plain] = np.diff(until, prepend=0)
            at[plain] = until - sizes[plain]
            parts, held = [made], len(made)
        rest = np.setdiff1d(np.arange(len(keys)), plain)
        for k, x, y in zip(rest.tolist(), a[rest].tolist(), b[rest].tolist()):
            parts.append(self.encode(data[x:y].tobytes().decode()))
            sizes[k], at[k] = len(parts[-1]), held
            held += len(parts[-1])
        if not ids:
            return int((sizes * np.diff(np.flatnonzero(np.append(fresh, True)))).sum())
        inverse = np.empty(len(h), np.int64)
        inverse[order] = np.cumsum(fresh) - 1
        counts = sizes[inverse]
        total = np.concatenate([[0], np.cumsum(counts)])
        edges = total[np.searchsorted(starts, offsets)]
        return np.concatenate(parts)[np.arange(total[-1]) + np.repeat(at[inverse] - total[:-1], counts)], edges


class Feistel:
    """A keyed permutation of 0 .. n - 1: a balanced Feistel network over the next even number of bits, walked along
    its cycle until the value is under n."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, (max(1, n - 1).bit_length() + 1) // 2)
        rng = np.random.default_rng(key)
        self.keys = rng.integers(1, 1 << 63, ROUNDS, dtype=np.uint64)

    def _round(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x + k) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(32)) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & np.uint64((1 << self.half) - 1)
        for k in self.keys:
            left, right = right, left ^ self._round(right, k)
        return left << np.uint64(self.half) | right

    def slots(self, index: np.ndarray) -> np.ndarray:
        out = self._once(index.astype(np.uint64))
        while (out >= self.n).any():
            over = np.flatnonzero(out >= self.n)
            out[over] = self._once(out[over])
        return out.astype(np.int64)


@dataclass
class Layout:
    """What a reader needs: sequences, tokens of each, sequences of a shard, bytes of a token, folder."""

    path: str
    sequences: int
    length: int
    per_shard: int
    token_bytes: int
    key: int

    @property
    def stride(self) -> int:
        return self.length * self.token_bytes

    def place(self, slot: int) -> tuple[str, int]:
        return f"{self.path}/shard-{slot // self.per_shard:06d}.bin", slot % self.per_shard * self.stride


def _file(uri: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return fs, path


def read_sequences(layout: Layout, first: int, count: int) -> Iterator[np.ndarray]:
    """Sequences of the slots first, first + 1, ...: a reader resumes at any slot by one seek in a shard."""
    kind = np.uint16 if layout.token_bytes == 2 else np.uint32
    for slot in range(first, min(first + count, layout.sequences)):
        uri, offset = layout.place(slot)
        fs, path = _file(uri)
        with fs.open_input_file(path) as f:
            f.seek(offset)
            yield np.frombuffer(f.read(layout.stride), kind)


class _Stream:
    """Packs the tokens of a task's documents, each followed by END, into sequences, the last filled with END."""

    def __init__(self, length: int):
        self.length, self.parts, self.docs, self.held = length, [], [], 0

    def add(self, doc_id, ids: np.ndarray):
        self.parts += [ids, np.array([END], np.uint32)]
        self.docs.append((doc_id, len(ids) + 1))
        self.held += len(ids) + 1

    def take(self, last: bool = False):
        """(tokens, document ids of each sequence, tokens used) of what is full, or of all."""
        n = self.held // self.length + (1 if last and self.held % self.length else 0)
        if not n:
            return None
        flat = np.concatenate(self.parts)
        used = min(self.held, n * self.length)
        block = np.full(n * self.length, END, np.uint32)
        block[:used] = flat[:used]
        lists, fill = [[] for _ in range(n)], np.full(n, self.length, np.int32)
        fill[-1] = used - (n - 1) * self.length
        at, rest = 0, []
        for doc_id, size in self.docs:
            for k in range(at // self.length, min(n - 1, (at + size - 1) // self.length) + 1):
                lists[k].append(doc_id)
            if at + size > used:
                rest.append((doc_id, at + size - max(at, used)))
            at += size
        self.parts, self.docs, self.held = ([flat[used:]] if used < self.held else []), rest, self.held - used
        return block.reshape(n, self.length), lists, fill


def write_training_order(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 512, shard_bytes: int = 32 << 20, seed: int = 2024, tokenizer: str = TOKENIZER, path: str | None = None
) -> tuple[Layout, DataFrame]:
    """Write shards and return their layout and the index: slot, shard, byte_offset, n_tokens, doc_ids, crc32.

    Documents of an input partition are encoded and packed in the order in which they are read; a first pass counts
    the sequences of each partition, so that every sequence has a dense number; the Feistel permutation makes it a
    slot. Rows are dealt to shards by slot range, so that each task writes one file from front to back: to a name of
    its attempt, renamed when complete, so that a lost or repeated task leaves one whole shard. docs must be read
    from files (a scan gives the same partitions twice; a difference between the passes stops the job). Null texts
    are skipped, empty ones give one END. Repeated rows are written each, rows without an id too (their id is null in
    doc_ids). Very long texts and runs have the tokenizer's own ids. Other columns are ignored, whatever their names. An
    empty table gives no shard. The index is a written table: shards are written once, however often it is read.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        ranks = f.read()
    shared = spark.sparkContext.broadcast(Tokenizer(ranks))
    token_bytes = 2 if max(END, ranks.count(b"\n")) < 1 << 16 else 4
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, total, n = shared.value, 0, 0
        for batch in batches:
            for first, last, made, _ in tokenizer.encode_slices(batch, ids=False):
                total += made + last - first
                n += last - first
        yield pa.record_batch({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "tokens": pa.array([total], pa.int64()), "docs": pa.array([n], pa.int64())})

    with small_batches(spark):
        counts = {r["part"]: (r["tokens"], r["docs"]) for r in rows.mapInArrow(lean(counted), "part int, tokens long, docs long").collect()}
    parts = max(counts, default=-1) + 1
    sequences = np.array([-(-counts.get(p, (0, 0))[0] // length) for p in range(parts)], np.int64)
    total = int(sequences.sum())
    base = np.cumsum(sequences) - sequences
    path = path or shared_path(spark, "shards")
    layout = Layout(path, total, length, max(1, shard_bytes // (length * token_bytes)), token_bytes, seed)
    plan = spark.sparkContext.broadcast((base, sequences, Feistel(max(1, total), seed)))
    kind = np.uint16 if token_bytes == 2 else np.uint32

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, expected, permutation = plan.value
        tokenizer, part, done, stream = shared.value, TaskContext.get().partitionId(), 0, _Stream(length)

        def packed(taken):
            nonlocal done
            block, lists, fill = taken
            if done + len(block) > expected[part]:
                raise RuntimeError("the documents changed between the two passes")
            slots = permutation.slots(base[part] + done + np.arange(len(block)))
            done += len(block)
            return pa.record_batch(
                {
                    "slot": pa.array(slots),
                    "shard": pa.array((slots // layout.per_shard).astype(np.int32)),
                    "tokens": pa.array([x.tobytes() for x in block.astype(kind)], pa.binary()),
                    "n_tokens": pa.array(fill),
                    "doc_ids": pa.array(lists, pa.list_(pa.int64())),
                }
            )

        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, last, ids, edges in tokenizer.encode_slices(batch):
                for doc_id, a, b in zip(names[first:last], edges[:-1].tolist(), edges[1:].tolist()):
                    stream.add(doc_id, ids[a:b])
                    if stream.held >= 1 << 20:
                        yield packed(stream.take())
        if (taken := stream.take(True)) is not None:
            yield packed(taken)
        if part < len(expected) and done != expected[part]:
            raise RuntimeError("the documents changed between the two passes")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        out = now = fs = None
        attempt = TaskContext.get().taskAttemptId()

        def close():
            out.close()
            final = f"{layout.path}/shard-{now:06d}.bin"
            source, target = _file(final + f".{attempt}")[1], _file(final)[1]
            try:
                fs.move(source, target)
            except OSError:
                # Another attempt has put the same bytes there, on a store that does not replace files.
                if fs.get_file_info(target).type == pyarrow.fs.FileType.NotFound:
                    raise
                fs.delete_file(source)

        for batch in batches:
            slots, shards = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            offsets, sums = [], []
            for slot, shard, tokens in zip(slots.tolist(), shards.tolist(), batch.column(2)):
                if shard != now:
                    if out is not None:
                        close()
                    now, expected = shard, shard * layout.per_shard
                    fs, name = _file(f"{layout.path}/shard-{shard:06d}.bin.{attempt}")
                    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(name)
                if slot != expected:
                    raise RuntimeError(f"slot {slot} where {expected} belongs")
                expected += 1
                raw = tokens.as_py()
                out.write(raw)
                offsets.append(slot % layout.per_shard * layout.stride)
                sums.append(zlib.crc32(raw))
            yield pa.record_batch(
                {
                    "slot": batch.column(0),
                    "shard": batch.column(1),
                    "byte_offset": pa.array(offsets, pa.int64()),
                    "n_tokens": batch.column(3),
                    "doc_ids": batch.column(4),
                    "crc32": pa.array(sums, pa.int64()),
                }
            )
        if out is not None:
            close()

    shards = max(1, -(-total // layout.per_shard))
    dealt = rows.mapInArrow(lean(placed), "slot long, shard int, tokens binary, n_tokens int, doc_ids array<long>")
    index = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot").mapInArrow(written, "slot long, shard int, byte_offset long, n_tokens int, doc_ids array<long>, crc32 long")
    with small_batches(spark):
        index = materialise(index, "op8-index")
    fs, name = _file(f"{path}/layout.json")
    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(name) as f:
        f.write(json.dumps(asdict(layout)).encode())
    return layout, index


def training_order(docs: DataFrame, **parameters) -> DataFrame:
    """The index of the written sequences."""
    return write_training_order(docs, **parameters)[1]
