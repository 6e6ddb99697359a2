"""Packing of tokenised documents into sequences of fixed capacity by reciprocal-capacity classes.

A document's ids and an end id are cut into pieces. Whole pieces of the capacity stand alone. The
rest is cut by powers of two down to ``LEAST``, and what then remains (under ``LEAST`` ids) is the
last piece. A piece of length L is in class k = capacity // L, and a bin of class k takes exactly k
pieces, with no look at any other bin. Each worker fills the bins of its own rows; pieces of bins
that it can't fill are packed largest first into a few common sequences, and the emptiest of
those is cut at powers of two, at which no padding is needed.

So padding comes from last pieces alone. Memory is that of a batch of rows and of the open bins,
of which there are at most ``LEAST`` + log2(capacity).

Null texts are empty: their document is the end id alone. Repeated rows are documents of their
own; under one id, or none, their pieces can't be told apart in the result but by their sequences.
Other columns are not read. An empty table gives no pieces. A sequence's id holds the worker's partition in its high bits.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import batches_of, bounded_batches, distinct, flat, gathered, table

CAPACITY, LEAST, END_ID = 1024, 64, 0
#: Chunks that a worker process remembers.
KNOWN = 250_000


#: Bytes that may stand beside a cut: no ASCII white space, and no first byte of a character that may be white space.
_SAFE_NEXT = np.ones(256, bool)
_SAFE_NEXT[[*range(0x00, 0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False
#: A letter's piece ends before these; of U+00C0 to U+00FF all but the signs 00D7 and 00F7 are letters.
_STOP, _LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[[0x97, 0xB7]] = True


class ByteEncoder:
    """Ids of a byte-level BPE tokenizer file, as little-endian 32-bit bytes.

    A space or line end between two characters that aren't white space always starts a new piece
    of such a tokenizer's pattern, and so does a stop after a letter. Texts are cut before them; of a
    batch's chunks each distinct one is encoded once, and Arrow's kernels put the texts' ids together.

    Chunks of Latin letters are encoded by ranks. That may merge a pair of tokens which the file's
    merges don't have; tokens side by side are BPE's if each two are, so each two that occur are
    tried once with the library, and a chunk with two that fail, like any other chunk, is the library's.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [i for i in range(256) if i not in shown]
        byte_of = {chr(i): i for i in shown} | {chr(256 + n): i for n, i in enumerate(hidden)}
        special = self.tokenizer.get_added_tokens_decoder()
        self.token = {i: bytes(byte_of[x] for x in t) for t, i in self.tokenizer.get_vocab().items() if i not in special}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in self.token.items()}, special_tokens={})._core_bpe
        self.known: dict[bytes, bytes] = {}
        self.sound: dict[int, bool] = {}

    @staticmethod
    def _cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where chunks start and, last, end; how many chunks lie before each text's end)."""
        n = len(data)
        at = np.flatnonzero((data == 0x20) | (data == 0x0A))
        at = at[(at > 0) & (at < n - 1)]
        before, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        safe = ((before > 0x20) & (before != 0x7F)) & ((before < 0x80) | ((two != 0xC2) & ~((three >= 0xE1) & (three <= 0xE3)))) & _SAFE_NEXT[data[at + 1]]
        edge = np.zeros(n + 1, bool)
        edge[at[safe]] = True
        at = np.flatnonzero(_STOP[data])
        at = at[at > 1]
        edge[at[_LETTER[data[at - 1]] | ((data[at - 2] == 0xC3) & ~_SIGN[data[at - 1]])]] = True
        edge[offsets] = True
        cuts = np.flatnonzero(edge)
        return cuts, np.searchsorted(cuts, offsets[1:])

    def _by_library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]

    def _sound(self, pairs: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each pair of tokens side by side."""
        coded = pa.array(pairs).dictionary_encode()
        met = coded.dictionary.to_pylist()
        if len(self.sound) > KNOWN:
            self.sound.clear()
        new = [p for p in met if p not in self.sound]
        spelled = [self.token[p >> 20] + self.token[p & 0xFFFFF] for p in new]
        texts = [x.decode(errors="replace") for x in spelled]
        for p, x, t, ids in zip(new, spelled, texts, self._by_library(texts), strict=True):
            self.sound[p] = t.encode() == x and ids == [p >> 20, p & 0xFFFFF]
        return np.array([self.sound[p] for p in met], bool)[coded.indices.to_numpy()]

    def _learn(self, chunks: list[bytes]) -> None:
        fast, slow, got = [], [], []
        encode, known = self.ranks.encode_ordinary, self.known
        for c in chunks:
            text = c.decode()
            if len(c) < 64 and (len(c) == len(text) or max(text) < "\u0100") and b"<" not in c:
                fast.append(c)
                got.append(encode(text))
            else:
                slow.append(c)
        if fast:
            ends = np.cumsum([len(x) for x in got])
            ids = np.fromiter(chain.from_iterable(got), np.int64, int(ends[-1]))
            inside = np.ones(len(ids), bool)  # not the first of its chunk
            inside[np.concatenate([[0], ends[:-1]])] = False
            at = np.flatnonzero(inside)
            unsound = at[~self._sound(ids[at - 1] << 20 | ids[at])] if len(at) else at
            raw, last = ids.astype("<u4").tobytes(), 0
            for c, end in zip(fast, ends.tolist(), strict=True):
                known[c] = raw[4 * last : 4 * end]
                last = end
            slow += [fast[i] for i in np.unique(np.searchsorted(ends, unsound, "right")).tolist()]
        for c, ids in zip(slow, self._by_library([c.decode() for c in slow]), strict=True):
            known[c] = np.array(ids, "<u4").tobytes()

    def _encoded(self, chunks: list[bytes]) -> list[bytes]:
        known = self.known
        missing = [c for c in chunks if c not in known]
        if len(known) + len(missing) > KNOWN:  # what this batch needs stays
            known = self.known = {c: known[c] for c in chunks if c in known}
        if missing:
            self._learn(missing)
        return [known[c] for c in chunks]

    def __call__(self, texts: pa.Array) -> list[memoryview]:
        """The ids of each text of a string column."""
        data, offsets = flat(texts)
        cuts, ends = self._cuts(data, offsets)
        codes, chunks = distinct(data, cuts)
        return gathered(pa.array(self._encoded(chunks.to_pylist()), pa.binary()), codes, ends)


class HarmonicBins:
    """Pieces in, finished sequences out. A piece is (key, start, ids as bytes, ids of its document)."""

    def __init__(self, capacity: int = CAPACITY, least: int = LEAST):
        self.capacity, self.least = capacity, least
        self.bins: dict[int, list[tuple]] = {}

    def cuts(self, n: int) -> Iterator[tuple[int, int]]:
        """(start, length) of the pieces of n ids."""
        at = 0
        while n - at >= self.capacity:
            yield at, self.capacity
            at += self.capacity
        size = 1 << (self.capacity.bit_length() - 1)
        while size >= self.least:
            if n - at >= size:
                yield at, size
                at += size
            size >>= 1
        if n > at:
            yield at, n - at

    def add(self, key: object, ids: bytes) -> Iterator[list[tuple]]:
        n = len(ids) // 4
        for start, length in self.cuts(n):
            k = self.capacity // length
            piece = (key, start, ids[4 * start : 4 * (start + length)], n)
            if k == 1:
                yield [piece]
                continue
            held = self.bins.setdefault(k, [])
            held.append(piece)
            if len(held) == k:
                yield self.bins.pop(k)

    def rest(self) -> Iterator[list[tuple]]:
        """The pieces of bins that never filled: largest first, each to the first sequence with room."""
        pieces = sorted((p for held in self.bins.values() for p in held), key=lambda p: -len(p[2]))
        self.bins = {}
        sequences: list[list[tuple]] = []
        room: list[int] = []
        for p in pieces:
            length = len(p[2]) // 4
            at = next((i for i, r in enumerate(room) if r >= length), None)
            if at is None:
                sequences.append([])
                room.append(self.capacity)
                at = len(room) - 1
            sequences[at].append(p)
            room[at] -= length
        if sequences:
            emptiest = max(range(len(room)), key=room.__getitem__)
            for i, s in enumerate(sequences):
                if i != emptiest:
                    yield s
            yield from self._by_powers(sequences[emptiest], self.capacity - room[emptiest])

    @staticmethod
    def _by_powers(pieces: list[tuple], total: int) -> Iterator[list[tuple]]:
        pieces = pieces[::-1]
        for bit in range(total.bit_length() - 1, -1, -1):
            size, out = 1 << bit, []
            if not total & size:
                continue
            while size:
                key, start, ids, n = pieces.pop()
                take = min(size, len(ids) // 4)
                out.append((key, start, ids[: 4 * take], n))
                if 4 * take < len(ids):
                    pieces.append((key, start + take, ids[4 * take :], n))
                size -= take
            yield out


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", capacity: int = CAPACITY, least: int = LEAST, end_id: int = END_ID) -> DataFrame:
    """One row per piece: the id, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    chosen = docs.select(id_col, F.col("text").cast("string").alias("text"))
    bounded_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = _encoder(path), HarmonicBins(capacity, least)
        sequence, rows = TaskContext.get().partitionId() << 40, []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, f) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "ids", "doc_tokens", "sequence_id", "offset"])

        def place(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for key, start, ids, n in pieces:
                rows.append((key, start, ids, n, sequence, offset))
                offset += len(ids) // 4
            sequence += 1

        kinds = [None, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for b in batches_of(batches):
            kinds[0] = b.column(0).type
            for key, ids in zip(b.column(0).to_pylist(), encode(b.column(1)), strict=True):
                for s in bins.add(key, b"".join((ids, end))):
                    place(s)
                if len(rows) >= 4000:
                    yield flush()
        for s in bins.rest():
            place(s)
        if rows:
            yield flush()

    kind = chosen.schema[id_col].dataType.simpleString()
    return chosen.mapInArrow(apply, f"`{id_col}` {kind}, start long, ids binary, doc_tokens long, sequence_id long, offset long")


_ENCODERS: dict[str, ByteEncoder] = {}


def _encoder(path: str) -> ByteEncoder:
    """One per worker process, so that what it remembers serves all its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pieces with their ids' length and checksum in place of the ids."""
    return pieces.select(id_col, "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents")))
