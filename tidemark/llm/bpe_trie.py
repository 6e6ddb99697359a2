"""BPE with word ends by depth-first traversal of a trie of distinct words.

In BPE, the encoding of a prefix is known by its last token: if the last token of s[:i] is t, the
rest is the encoding of s[:i - len(t)]. So every trie node holds the last token of its prefix. A
token that ends at a node is that node's last token if it can stand after the last token of the
node where it begins, which ranks of merges tell without any merging (``_stands``). The traversal
goes through the distinct words of a batch in sorted order and keeps the states of the current
path, so that a prefix that words share is solved once. A word's last symbol carries the word-end
mark and is a leaf of its own.

Texts are cut at ASCII white space and before a stop after a letter, which no word of the
tokenizer's pattern crosses; a batch's distinct chunks are encoded, those seen lately are remembered,
and Arrow's kernels put the texts together. White space is dropped by the tokenizer, so that decoding joins
the token strings by spaces, as the library does for a file without a decoder.

Null texts are empty and have no tokens. Repeated rows are encoded each. Special tokens' strings
in a text are their ids, as in the library. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Words, batches_of, bounded_batches, gathered, lowered, table

#: Chunks that a worker process remembers.
KNOWN = 200_000


class TrieBpe:
    """Encodings of pre-tokenised words by a tokenizer file's merges."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.suffix = suffix
        self.plain = {t: i for t, i in vocab.items() if not t.endswith(suffix) or t == suffix}
        self.final = {t[: -len(suffix)]: i for t, i in vocab.items() if t.endswith(suffix) and t != suffix}
        self.rank, self.parts, self.pair = {}, {}, {}
        for r, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.pair.setdefault((x, y), r)
            if z not in self.rank:
                self.rank[z], self.parts[z] = r, (x, y)
        self.plain_lengths, self.final_lengths = self._lengths(self.plain), self._lengths(self.final)
        self._memo: dict[int, bool] = {}
        self._made: dict[int, bool] = {}

    def _stands(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a and b, side by side, as they are."""
        rank, parts, pair = self.rank, self.parts, self.pair
        limit = 1 << 60
        while True:
            merged = pair.get((a, b))
            if merged is not None and merged < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra > rb:
                limit, a = ra, parts[a][1]
            elif rb >= 0:
                limit, b = rb + 1, parts[b][0]  # of equal merges the left one comes first
            else:
                return True

    def _follows(self, a: int, b: int) -> bool:
        key = a << 20 | b
        got = self._memo.get(key)
        if got is None:
            if len(self._memo) > 1_000_000:
                self._memo.clear()
            got = self._memo[key] = self._stands(a, b)
        return got

    def _whole(self, token: int) -> bool:
        """Whether BPE makes this token of its own characters."""
        if token not in self.parts:
            return True
        got = self._made.get(token)
        if got is None:
            a, b = self.parts[token]
            # No merge across the cut comes before the one that makes the token, and both sides are made.
            got = self._made[token] = self._meets(a, b, self.rank[token]) and self._whole(a) and self._whole(b)
        return got

    def _meets(self, a: int, b: int, at: int) -> bool:
        rank, parts, pair = self.rank, self.parts, self.pair
        if max(rank.get(a, -1), rank.get(b, -1)) > at:
            return False
        limit = None
        while True:
            merged = pair.get((a, b))
            if limit is not None and merged is not None and merged < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra > rb:
                limit, a = ra, parts[a][1]
            elif rb >= 0:
                limit, b = rb + 1, parts[b][0]
            else:
                return True

    @staticmethod
    def _lengths(vocab: dict[str, int]) -> dict[str, tuple[int, ...]]:
        """Lengths of the tokens that end in three characters, longest first; two and one always count."""
        found: dict[str, set[int]] = {}
        for t in vocab:
            if len(t) > 2:
                found.setdefault(t[-3:], set()).add(len(t))
        return {end: (*sorted(lengths, reverse=True), 2, 1) for end, lengths in found.items()}

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of distinct words, in sorted order."""
        # Of the current path, by length of the prefix: its last token, and where that begins.
        last, begins = [-1], [0]
        memo, follows, whole = self._memo, self._follows, self._whole
        before, few = "", (2, 1)
        for word in sorted(words):
            size = len(word)
            shared, most = 0, min(len(last) - 1, size - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], begins[shared + 1 :]
            vocab, lengths = self.plain, self.plain_lengths
            for i in range(shared + 1, size + 1):
                if i == size:
                    vocab, lengths = self.final, self.final_lengths
                for n in lengths.get(word[i - 3 : i], few) if i > 2 else few:
                    begin = i - n
                    if begin < 0:
                        continue
                    token = vocab.get(word[begin:i])
                    if token is None:
                        continue
                    if begin:
                        key = last[begin] << 20 | token
                        ok = memo.get(key)
                        if ok is None:
                            ok = follows(last[begin], token)
                        if ok:
                            break
                    elif whole(token):
                        break
                else:
                    raise ValueError(f"no token ends at {i} of {word!r}")
                if i < size:
                    last.append(token)
                    begins.append(begin)
            ids = [token]
            while begin:
                ids.append(last[begin])
                begin = begins[begin]
            ids.reverse()
            yield word, ids
            before = word


_STOP, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class TextEncoder:
    """Whole texts to ids and back, for a tokenizer file that drops white space and marks word ends."""

    _ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
    _LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.bpe = TrieBpe(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"])
        self.token = {i: t for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        #: Of each token, its id and its string as they stand in a text, after a space.
        self.shown = {i: (f" {i}".encode(), f" {t}".encode()) for i, t in self.token.items()}
        #: (number of ids, ids, decoded text) of chunks; ids and text begin with a space
        self.chunks: dict[bytes, tuple[int, bytes, bytes]] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        #: The visible stand-ins of bytes in byte-level vocabularies: bytes that show stand for themselves.
        self.stand_in = {i: i if i in shown else next(hidden) for i in range(256)}

    def _pieces(self, text: str) -> list[str]:
        """The pre-tokenised words of a text without white space of ASCII."""
        if text.isascii() and text.isprintable():
            return [text.lower()] if text.isalpha() else self._ASCII.findall(text.lower())
        if max(text) < "\u0250" and text.isprintable() and unicodedata.is_normalized("NFC", text):
            return [p.encode().decode("latin-1").translate(self.stand_in) for p in self._LATIN.findall(text.lower())]
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def _made(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        shown = [self.shown[i] for i in ids]
        return len(ids), b"".join([a for a, _ in shown]), b"".join([b for _, b in shown])

    def _learn(self, chunks: list[bytes]) -> None:
        split: list[tuple[bytes, list]] = []
        fresh: set[str] = set()
        for c in chunks:
            text = c.decode()
            if "<|" in text:
                pieces: list = []
                for part in self.split.split(text):
                    if part in self.special:
                        pieces.append(self.special[part])
                    elif part:
                        pieces += self._pieces(part)
                fresh.update([p for p in pieces if isinstance(p, str)])
            else:
                pieces = self._pieces(text)
                fresh.update(pieces)
            split.append((c, pieces))
        made = self._made
        words = {w: made(ids) for w, ids in self.bpe.encode_words(fresh)}
        for c, pieces in split:
            if len(pieces) == 1 and pieces[0] in words:
                self.chunks[c] = words[pieces[0]]
            else:
                parts = [made([p]) if isinstance(p, int) else words[p] for p in pieces]
                self.chunks[c] = sum([p[0] for p in parts]), b"".join([p[1] for p in parts]), b"".join([p[2] for p in parts])

    @staticmethod
    def _prepared(data: np.ndarray) -> np.ndarray:
        """A-Z in lower case, but before a byte that isn't ASCII (a mark may join the letter) and where special tokens may be."""
        if b"<|" in data.tobytes():
            return data
        after = np.append(data[1:], np.uint8(0xFF))
        return np.where(after < 0x80, lowered(data), data)

    @staticmethod
    def _cuts(data: np.ndarray) -> np.ndarray:
        """Places of stops that follow an ASCII letter: no word of the pattern goes across."""
        at = np.flatnonzero(_STOP[data])
        at = at[at > 0]
        return at[_LETTER[data[at - 1]]]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, memoryview, memoryview]]:
        """(number of ids, decimal ids joined by one space, decoded text) of each text of a string column."""
        words = Words(texts, self._prepared, self._cuts)
        chunks = words.distinct.to_pylist()
        known = self.chunks
        missing = [c for c in chunks if c not in known]
        if len(known) + len(missing) > KNOWN:  # what this batch needs stays
            known = self.chunks = {c: known[c] for c in chunks if c in known}
        if missing:
            self._learn(missing)
        got = [known[c] for c in chunks]
        counts = np.array([g[0] for g in got], np.int64)[words.codes] if got else np.empty(0, np.int64)
        total = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], words.ends])]
        ids, decoded = (gathered(pa.array([g[i] for g in got], pa.binary()), words.codes, words.ends) for i in (1, 2))
        for n, a, b in zip(np.diff(total).tolist(), ids, decoded, strict=True):
            yield n, a[1:], b[1:]

    def ids(self, text: str) -> list[int]:
        return list(map(int, bytes(next(self.encode(pa.array([text])))[1]).split()))


_ENCODERS: dict[str, TextEncoder] = {}


def _encoder(path: str) -> TextEncoder:
    """One per worker process, so that what it remembers serves all its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """One row per text: the id, n_tokens, ids (array of int), decoded."""
    return _mapped(docs, tokenizer, id_col, "ids array<int>, decoded string", [pa.list_(pa.int32()), pa.string()], lambda ids, text: (list(map(int, bytes(ids).split())), bytes(text).decode()))


def _mapped(docs: DataFrame, tokenizer: str | None, id_col: str, columns: str, kinds: list, made) -> DataFrame:
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    names = [id_col, "n_tokens", *(c.split(" ")[0] for c in columns.split(", "))]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for b in batches_of(batches):
            rows = [(n, *made(ids, text)) for n, ids, text in encoder.encode(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), *kinds], strict=True))], names=names)

    bounded_batches(docs.sparkSession)
    chosen = docs.select(id_col, F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(apply, f"`{id_col}` {chosen.schema[id_col].dataType.simpleString()}, n_tokens long, {columns}")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda x: hashlib.sha256(x).hexdigest()
    return _mapped(table(spark, sf_dir, "documents"), None, "doc_id", "ids_sha256 string, decoded_sha256 string", [pa.string(), pa.string()], lambda ids, text: (digest(ids), digest(text)))
