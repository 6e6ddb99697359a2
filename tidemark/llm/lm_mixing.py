r"""Language-model scores by online logistic mixing of hashed-context bit predictors.

Texts are words ``[^\x20\x09-\x0D]+`` (A-Z lower-cased) and one end each, coded in order. A token is
coded as its head, one of a bounded alphabet (the most frequent words, and the first two bytes or
first byte of all others), and then, where the head isn't the whole word, the rest of its spelling,
byte by byte to a last space. Heads and bytes are Huffman codes; each bit of a code is a decision.

For each bit several predictors look up how often 0 and 1 came in a hashed context:

* of heads: the code's node alone; the head before; the two heads before; the word before; and
  the text so far, counted along the text;
* of spelling: the 1, 2, 3 and 4 bytes before, and the word so far.

Their log-odds are added up with weights that a gate picks (how often two or three of the
contexts were seen). Along each text the weights are refined from block to block of tokens, starting from the
trained ones, and a last stage corrects the mixed log-odds by what came of such odds before.

* Word counts are grouped over all training documents, and every training word counts once in every
  spelling predictor. Head predictors count every token of every training document. Tables are
  hashed and of fixed size; what is shuffled to fill them follows the corpus.
* Weights and the last stage are some thousand numbers, fitted on all training documents and words
  while these are counted: a task first predicts each part of its rows from what it has counted so
  far, to which they are new, and then counts them. It adds up the terms of a Newton step around
  the weights that its own earlier parts give; the sums of all tasks are solved once.
* Spelling costs don't depend on the text: each distinct word is spelled once. Frequent words are
  broadcast, at most ``HEAD`` of them; all others reach their documents by a join.

Documents whose crc32 of the id's text, modulo 7, is 2 are held out of all learning. Null texts
are empty: the end alone. Repeated rows count, and are scored, each. A null id's text is empty. A
corpus without training documents gives even odds for every bit. An empty table gives no rows, and
other columns are not read.
"""

from __future__ import annotations

import contextlib
import ctypes
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, Words, batches_of, flat, lowered, mix, string_hashes, table, words_hashes

#: Heads: whole words, and prefixes of two bytes; there are always 256 of one byte, and the end.
WHOLE, PAIRS = 512, 512
#: Slots of the predictors' tables, as powers of two.
HEAD_BITS, SPELL_BITS = (11, 20, 21, 21), (14, 17, 19, 19, 20)
#: Bytes of the first part of a task's rows; each later part has as many as all before it, up to the last number.
FIRST_PART, LAST_PART = 1 << 13, 1 << 20
#: Decisions that wait at most to be counted while their part is predicted.
WAITING = 1 << 21
#: Broadcast words at most.
HEAD = 400_000
#: Tokens of a text's first blocks; each later block is twice as long, up to the last number.
FIRST_BLOCK, LAST_BLOCK = 32, 4096
#: Texts that are scored side by side, and tokens whose bits are looked at at once: what is made of them stays in a core's cache.
SIDE, SLICE = 1024, 1 << 13
BLOCK_BITS, STEPS, PULL = 14, 32, 0.5
#: Input splits whose counts one task adds up.
SPLITS = 4
LEVEL_ENDS = np.array([1, 2, 4, 16], np.float32)
LEVELS = len(LEVEL_ENDS) + 1
END = b""
_SALT = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Code:
    """A Huffman code: symbol s has the decisions start[s] to start[s + 1], each a node and a bit."""

    start: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    @property
    def nodes(self) -> int:
        return int(self.node.max(initial=0)) + 1

    # What is looked up for each decision, by its place in ``node`` and ``bit``.
    @cached_property
    def salt(self) -> np.ndarray:
        return salts(self.node)

    @cached_property
    def among(self) -> np.ndarray:
        return self.node.astype(np.uint64) & np.uint64(7)

    @cached_property
    def chosen(self) -> np.ndarray:
        """Where the bit is counted in a row of pairs of counts, one of each node."""
        return self.node * 2 + self.bit

    @cached_property
    def against(self) -> np.ndarray:
        """The sign of log-odds that speak against the bit."""
        return (1 - 2 * self.bit).astype(np.float32)

    @staticmethod
    def of(counts: np.ndarray) -> Code:
        n = len(counts)
        heap = [(int(c), s, s) for s, c in enumerate(counts.tolist())]
        heapq.heapify(heap)
        parent, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
        made = n
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for bit, x in enumerate((a, b)):
                parent[x[2]], side[x[2]] = made, bit
            heapq.heappush(heap, (a[0] + b[0], made, made))
            made += 1
        root, paths = made - 1, []
        named = Code._named(parent, n, root)
        for s in range(n):
            path, at = [], s
            while at != root:
                path.append((named[int(parent[at])], int(side[at])))
                at = int(parent[at])
            paths.append(path[::-1])
        start = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
        flat_ = np.array([x for p in paths for x in p], np.int64).reshape(-1, 2)
        return Code(start, flat_[:, 0], flat_[:, 1].astype(np.int8))

    @staticmethod
    def _named(parent: np.ndarray, n: int, root: int) -> dict[int, int]:
        """Numbers of the inner nodes: a node, the two below it and the four below those are among the same eight, since they are looked up together."""
        below: dict[int, list[int]] = {}
        for x in range(n, root):
            below.setdefault(int(parent[x]), []).append(x)
        named: dict[int, int] = {}
        blocks, free = 0, [[] for _ in range(9)]  # free: the first free number of blocks, by how many are free
        tops = [root] if root >= n else []
        for top in tops:
            own, level = [], [top]
            for _ in range(3):
                own += level
                level = [y for x in level for y in below.get(x, [])]
            tops += level
            room = next((r for r in range(len(own), 9) if free[r]), 0)
            if not room:
                free[room := 8].append(blocks * 8)
                blocks += 1
            at = free[room].pop()
            named |= zip(own, range(at, at + len(own)))  # noqa: B905
            free[room - len(own)].append(at + len(own))
        return named

    def places(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of its symbol, place in ``node`` and ``bit``) of each decision; where each symbol's decisions start."""
        size = (self.start[1:] - self.start[:-1]).take(symbols)
        ends = np.cumsum(size)
        first = ends - size
        owner = np.repeat(np.arange(len(symbols)), size)
        return owner, np.arange(len(owner)) + (self.start.take(symbols) - first).take(owner), first

    def bits(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of its symbol, node, bit) of each decision."""
        owner, at, _ = self.places(symbols)
        return owner, self.node.take(at), self.bit.take(at)


def salts(node: np.ndarray) -> np.ndarray:
    """Of the eight nodes, by number, that each node is among."""
    return ((node >> 3).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * _SALT


def placed(contexts: list[np.ndarray], owner: np.ndarray, salted: np.ndarray, among: np.ndarray, bits: tuple[int, ...]) -> list[np.ndarray]:
    """The slot of each decision in each predictor's table: eight nodes of a context have eight slots beside each other.

    contexts: times _SALT; salted: salts of the decisions' nodes; among: which of its eight each node is.
    """
    out = []
    for c, b in zip(contexts, bits, strict=True):
        slot = c.take(owner)
        slot += salted
        slot >>= np.uint64(64 - b)
        slot ^= among
        out.append(slot.view(np.int64))
    return out


def slots_of(contexts: list[np.ndarray], owner: np.ndarray, node: np.ndarray, bits: tuple[int, ...]) -> list[np.ndarray]:
    """The slot of each decision in each predictor's table."""
    return placed([c * _SALT for c in contexts], owner, salts(node), node.astype(np.uint64) & np.uint64(7), bits)


def levels(seen: np.ndarray) -> np.ndarray:
    """Which of LEVELS a number of occurrences is in."""
    out = np.zeros(len(seen), np.int8)
    for end in LEVEL_ENDS:
        out += (seen >= end).view(np.int8)
    return out


def chosen_of(slots: list[np.ndarray], bit: np.ndarray) -> list[np.ndarray]:
    """Where the bits are counted in each predictor's table; the slots become this."""
    for s in slots:
        s *= 2
        s += bit
    return slots


def added(chosen: list[np.ndarray], total: list[np.ndarray]) -> None:
    for at, t in zip(chosen, total, strict=True):
        if len(t) <= len(at):
            t += np.bincount(at, minlength=len(t)).astype(np.uint32)
        else:
            np.add.at(t, at, np.uint32(1))


def counted(slots: list[np.ndarray], bit: np.ndarray, total: list[np.ndarray]) -> None:
    added([s * 2 + bit for s in slots], total)


def blank_counts(bits: tuple[int, ...]) -> list[np.ndarray]:
    out = [np.empty(2 << b, np.uint32) for b in bits]  # zeros would come without the large pages that lookups all over a table need
    for t in out:
        t.fill(0)
    return out


def odds(n0: np.ndarray, n1: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    ratio = n1 + np.float32(0.4)
    ratio /= n0 + np.float32(0.4)
    return np.log(ratio, out=out)


def pairs_at(counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often 0 and 1 came, both counts in one look."""
    pair = counts.view(np.uint64).take(at).view(counts.dtype)
    return pair[::2].astype(np.float32), pair[1::2].astype(np.float32)


@dataclass
class Predictors:
    """What a predictor says of each slot: log-odds, and of the two predictors that the gate asks how often the context was seen."""

    bits: tuple[int, ...]
    counts: list[np.ndarray]
    odds: list[np.ndarray] = field(default_factory=list)
    seen: list[np.ndarray] = field(default_factory=list)
    both: list[np.ndarray] = field(default_factory=list)

    def settle(self) -> Predictors:
        pairs = [c.reshape(-1, 2).astype(np.float32) for c in self.counts]
        self.odds = [odds(p[:, 0], p[:, 1]).astype(np.float16) for p in pairs]  # to a thousandth, as they are broadcast
        self.seen = [np.searchsorted(LEVEL_ENDS, p.sum(1), "right").astype(np.int8) for p in pairs[-2:]]
        return self

    def opened(self) -> Predictors:
        """With tables as a task looks them up: log-odds in 32 bits, whose last ones, empty after 16, hold how often the context was seen."""
        if self.both:
            return self
        both = [o.astype(np.float32).view(np.uint32) for o in self.odds]
        for b, seen in zip(both[-2:], self.seen, strict=True):
            b |= seen.view(np.uint8)
        return replace(self, both=both)

    def inputs(self, slots: list[np.ndarray], more: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(log-odds by predictor, gate). more: rows left for further predictors."""
        x = np.empty((len(slots) + more, len(slots[0])), np.float32)
        gate = np.zeros(len(slots[0]), np.uint32)
        for i, (b, s) in enumerate(zip(self.opened().both, slots, strict=True)):
            own = b.take(s)
            if i >= len(slots) - 2:
                gate *= np.uint32(LEVELS)
                gate += own & np.uint32(7)
                own &= np.uint32(0xFFFFFFF8)
            x[i] = own.view(np.float32)
        return x, gate.astype(np.int64)


def stepped(z: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """The index of each gate and of the step nearest to the mixed log-odds."""
    near = z + np.float32(12)
    near *= np.float32((STEPS - 1) / 24)
    near += np.float32(0.5)
    out = gate * STEPS
    out += near.astype(np.int64)
    return out


def chance(z: np.ndarray) -> np.ndarray:
    """Of a one, from log-odds."""
    p = np.negative(z)
    np.exp(p, out=p)
    p += np.float32(1)
    return np.divide(np.float32(1), p, out=p)


@dataclass
class Mixer:
    """weights: inputs x gates; refine: log-odds met, gates x STEPS."""

    weights: np.ndarray
    refine: np.ndarray

    @staticmethod
    def blank(inputs: int, gates: int = LEVELS * LEVELS) -> Mixer:
        return Mixer(np.full((inputs, gates), 1.2 / inputs, np.float32), np.broadcast_to(np.linspace(-12, 12, STEPS, dtype=np.float32), (gates, STEPS)).copy())

    def mixed(self, x: np.ndarray, gate: np.ndarray, change: np.ndarray | None = None, text: np.ndarray | None = None) -> np.ndarray:
        """change: of the weights, for each text; text: of each decision."""
        z = np.zeros(x.shape[1], np.float32)
        for i in range(len(x)):
            w = self.weights[i].take(gate)
            if change is not None:
                w += change[i].take(text)
            w *= x[i]
            z += w
        return np.clip(z, np.float32(-11.9), np.float32(11.9), out=z)

    def refined(self, z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Half the mixed log-odds, half those met at the step nearest to them."""
        apart = ((self.refine - np.linspace(-12, 12, STEPS, dtype=np.float32)) * np.float32(0.5)).ravel()
        out = apart.take(stepped(z, gate))
        out += z
        return out

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, rounds: int = 3) -> None:
        """Newton steps on all decisions at once, pulled to the weights there are; then what came of the mixed odds."""
        if not len(bit):
            return
        n, gates = len(x), len(self.refine)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-self.mixed(x, gate)))
            err, curve = bit - p, p * (1 - p) + 1e-4
            slope = np.stack([np.bincount(gate, err * x[i], gates) for i in range(n)])
            hess = np.stack([[np.bincount(gate, curve * x[i] * x[j], gates) for j in range(n)] for i in range(n)])
            step = np.linalg.solve(hess.transpose(2, 0, 1) + np.eye(n) * 20, slope.T[:, :, None])[:, :, 0].T
            self.weights = np.clip(self.weights + step, -1.5, 3).astype(np.float32)
        z = self.mixed(x, gate)
        step = np.rint((z + 12) * ((STEPS - 1) / 24)).astype(np.int64)
        met = np.bincount((gate * STEPS + step) * 2 + bit, minlength=gates * STEPS * 2).reshape(gates, STEPS, 2)
        self.refine = met_odds(met)


@dataclass
class Fit:
    """Terms of a Newton step for a mixer's weights and what came of its mixed odds, added up over decisions.

    squares: gates x inputs x inputs; pulls: gates x inputs; met: gates x STEPS x 2. Between tasks they travel
    as whole numbers, whose sum doesn't depend on the order.
    """

    start: Mixer
    mixer: Mixer
    squares: np.ndarray
    pulls: np.ndarray
    met: np.ndarray

    @staticmethod
    def blank(inputs: int, gates: int) -> Fit:
        start = Mixer.blank(inputs, gates)
        return Fit(start, start, np.zeros((gates, inputs, inputs)), np.zeros((gates, inputs)), np.zeros((gates, STEPS, 2)))

    def add(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> None:
        z = self.mixer.mixed(x, gate)
        p = chance(z)
        curve = np.float32(1) - p
        curve *= p
        curve += np.float32(1e-4)
        pull = curve * z
        pull -= p
        pull += bit
        # Decisions of a gate stand together, so that sums need no scatter.
        order = np.argsort(gate.astype(np.uint8 if len(self.met) <= 256 else np.int64), kind="stable")
        size = np.bincount(gate, minlength=len(self.met))
        gates = np.flatnonzero(size)
        start = (np.cumsum(size) - size)[gates]
        curve, pull, ordered = curve.take(order), pull.take(order), [row.take(order) for row in x]
        for i, own in enumerate(ordered):
            self.pulls[gates, i] += np.add.reduceat(pull * own, start)
            bent = curve * own
            for j, other in enumerate(ordered[: i + 1]):
                sums = np.add.reduceat(bent * other, start)
                self.squares[gates, i, j] += sums
                if j < i:
                    self.squares[gates, j, i] += sums
        step = stepped(z, gate)
        step *= 2
        step += bit
        self.met += np.bincount(step, minlength=self.met.size).reshape(self.met.shape)

    def settle(self) -> Mixer:
        """The mixer that all decisions so far give; further ones are taken around its weights."""
        n = self.pulls.shape[1]
        weights = np.linalg.solve(self.squares + np.eye(n) * 20, (self.pulls + self.start.weights.T * 20)[:, :, None])[:, :, 0].T
        self.mixer = Mixer(np.clip(weights, -1.5, 3).astype(np.float32), met_odds(self.met))
        return self.mixer

    def dump(self) -> bytes:
        return np.rint(np.concatenate([self.squares.ravel(), self.pulls.ravel(), self.met.ravel()]) * 65536).astype("<i8").tobytes()

    def load(self, raw: bytes) -> Fit:
        parts = np.split(np.frombuffer(raw, "<i8") / 65536, np.cumsum([self.squares.size, self.pulls.size]))
        self.squares, self.pulls, self.met = (a.reshape(b.shape) for a, b in zip(parts, (self.squares, self.pulls, self.met), strict=True))
        return self


def met_odds(met: np.ndarray) -> np.ndarray:
    """Log-odds met at each gate and step, pulled to the mixed ones."""
    p = 1 / (1 + np.exp(-np.linspace(-12, 12, STEPS)))
    return np.log((met[..., 1] + 30 * p) / (met[..., 0] + 30 * (1 - p))).astype(np.float32)


def so_counted(slots: list[np.ndarray], total: list[np.ndarray], more: tuple[tuple[np.ndarray, np.ndarray], ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """What ``Predictors.inputs`` gives, from counts as they stand. more: how often 0 and 1 came in further predictors, which the gate asks too."""
    x, gate = np.empty((len(slots) + len(more), len(slots[0])), np.float32), np.zeros(len(slots[0]), np.int8)
    for i, (s, t) in enumerate(zip(slots, total, strict=True)):
        n0, n1 = pairs_at(t, s)
        if i >= len(slots) - 2:
            gate = gate * np.int8(LEVELS) + levels(n0 + n1)
        odds(n0, n1, x[i])
    for i, (n0, n1) in enumerate(more, len(slots)):
        gate = gate * np.int8(LEVELS) + levels(n0 + n1)
        odds(n0, n1, x[i])
    return x, gate.astype(np.int64)


def cost(z: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Natural logarithm of one over the chance of each bit."""
    return cost_against(np.where(bit == 1, -z, z))


def cost_against(z: np.ndarray) -> np.ndarray:
    """The same from log-odds that speak against the bit, which become the costs."""
    np.exp(z, out=z)
    z += np.float32(1)
    return np.log(z, out=z)


class Found:
    """Looks hashes up among some in order. A hash's first bits tell nearly where it is."""

    def __init__(self, known: np.ndarray):
        self.known, self.shift = known, np.uint64(63 - len(known).bit_length())
        size = np.bincount((known >> self.shift).view(np.int64), minlength=1 << (64 - int(self.shift)))
        self.first, self.steps = np.cumsum(size) - size, int(size.max()) - 1

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each hash is, if it is there; whether it is)."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = self.first.take((hashes >> self.shift).view(np.int64))
        for _ in range(self.steps):
            at += self.known.take(at, mode="clip") < hashes
        np.minimum(at, len(self.known) - 1, out=at)
        return at, self.known.take(at) == hashes


@dataclass(frozen=True)
class Heads:
    """The alphabet of heads: whole words (sorted hashes), prefixes of two bytes, of one, and the end."""

    whole: np.ndarray
    pairs: np.ndarray
    code: Code

    @cached_property
    def found(self) -> Found:
        return Found(self.whole)

    @property
    def end(self) -> int:
        return len(self.whole) + int((self.pairs >= 0).sum()) + 256

    def of(self, words: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(head, how many bytes it covers; -1 is all) of each word."""
        data, offsets = flat(words)
        size = np.diff(offsets)
        first = data[offsets[:-1]].astype(np.int64) if len(size) else np.empty(0, np.int64)
        second = np.where(size > 1, data[np.minimum(offsets[:-1] + 1, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.int64)
        pair = np.where(size > 1, self.pairs[first << 8 | second], -1)
        n_pairs = int((self.pairs >= 0).sum())
        head = np.where(pair >= 0, len(self.whole) + pair, len(self.whole) + n_pairs + first)
        covers = np.where(pair >= 0, 2, 1)
        if len(self.whole):
            at, is_whole = self.found(hashes)
            head, covers = np.where(is_whole, at, head), np.where(is_whole, -1, covers)
        return head, covers


@dataclass
class Text:
    """The tokens of a column of texts, each text's words and then its end."""

    words: Words
    hashes: np.ndarray
    heads: np.ndarray
    before: np.ndarray
    owner: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(texts: pa.Array, heads: Heads) -> Text:
        words = Words(texts, lowered)
        h = string_hashes(words.distinct)
        head = heads.of(words.distinct, h)[0]
        n = len(words.ends)
        size = np.diff(np.concatenate([[0], words.ends])) + 1
        owner = np.repeat(np.arange(n), size)
        first = np.cumsum(size) - size
        place = np.arange(len(owner)) - first[owner]
        seq, known = np.full(len(owner), heads.end, np.int64), np.zeros(len(owner), np.uint64)
        is_word = np.ones(len(owner), bool)
        is_word[first + size - 1] = False
        seq[is_word], known[is_word] = head[words.codes], h[words.codes]
        before = np.zeros(len(owner), np.uint64)
        before[1:] = known[:-1]
        before[first] = 0
        return Text(words, h, seq, before, owner, place)

    def side_by_side(self, low: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(the tokens of SIDE texts from ``low`` on, the text of each, and block by block which of them)."""
        mine = slice(*np.searchsorted(self.owner, [low, low + SIDE]).tolist())
        block = blocks(self.place[mine])
        order = np.argsort(block.astype(np.uint8) if block.max(initial=0) < 256 else block, kind="stable")
        return np.arange(mine.start, mine.stop), self.owner[mine] - low, np.split(order, np.cumsum(np.bincount(block))[:-1])

    def contexts(self, end: int) -> list[np.ndarray]:
        one, two = np.full(len(self.heads), end, np.int64), np.full(len(self.heads), end, np.int64)
        one[1:], two[2:] = self.heads[:-1], self.heads[:-2]
        one[self.place == 0] = end
        two[self.place < 2] = end
        c = one.astype(np.uint64)
        return [np.zeros(len(c), np.uint64), mix(c + np.uint64(1 << 20)), mix((c << np.uint64(16)) + two.astype(np.uint64) + np.uint64(1 << 40)), mix(self.before + np.uint64(3))]


def blocks(place: np.ndarray) -> np.ndarray:
    """The block of each place in a text: the first two have FIRST_BLOCK tokens, each later one as many as all before it, LAST_BLOCK at most."""
    units = np.arange(2 * LAST_BLOCK // FIRST_BLOCK)
    doubling = np.floor(np.log2(np.maximum(units, 1))).astype(np.int64) + (units > 0)
    most = (LAST_BLOCK // FIRST_BLOCK).bit_length()
    out = doubling.take(place // FIRST_BLOCK, mode="clip")
    far = np.flatnonzero(place >= 2 * LAST_BLOCK)
    out[far] = most + place[far] // LAST_BLOCK - 1
    return out


@dataclass
class HeadModel:
    heads: Heads
    tables: Predictors
    mixer: Mixer

    def count(self, texts: pa.Array, total: list[np.ndarray]) -> None:
        t = Text.of(texts, self.heads)
        contexts = t.contexts(self.heads.end)
        for at in range(0, len(t.heads), SLICE):
            own = [c[at : at + SLICE] for c in contexts]
            owner, node, bit = self.heads.code.bits(t.heads[at : at + SLICE])
            counted(slots_of(own, owner, node, HEAD_BITS), bit, total)

    def learn(self, texts: pa.Array, total: list[np.ndarray], fit: Fit) -> None:
        """Predicts the texts from what is counted, for the mixer's sake, and then counts them."""
        t, code = Text.of(texts, self.heads), self.heads.code
        n, nodes, contexts = len(t.words.ends), code.nodes, [c * _SALT for c in t.contexts(self.heads.end)]
        waiting: list[tuple] = []
        size = 0
        for low in range(0, n, SIDE):
            mine, part, block = t.side_by_side(low)
            so_far = np.zeros(min(SIDE, n - low) * nodes * 2, np.float32)
            for own in block:
                later = []
                for at in range(0, len(own), SLICE):
                    which = mine[own[at : at + SLICE]]
                    owner, place, _ = code.places(t.heads.take(which))
                    slots, bit = placed([c.take(which) for c in contexts], owner, code.salt.take(place), code.among.take(place), HEAD_BITS), code.bit.take(place)
                    here = (part.take(own[at : at + SLICE]) * (2 * nodes)).take(owner)
                    here += code.chosen.take(place)
                    fit.add(*so_counted(slots, total, (pairs_at(so_far, here >> 1),)), bit)
                    later.append(here)
                    waiting.append(chosen_of(slots, bit))
                    size += len(bit)
                for at in later:
                    np.add.at(so_far, at, np.float32(1))
                if size > WAITING:
                    self._counted(waiting, total)
                    size = 0
        self._counted(waiting, total)

    @staticmethod
    def _counted(waiting: list[tuple], total: list[np.ndarray]) -> None:
        for at in waiting:
            added(at, total)
        waiting.clear()

    def score(self, t: Text, learn: bool = False) -> np.ndarray:
        """Natural logarithm of each text's heads' chance. learn: fits the mixer to these texts."""
        n, code, inputs, tables = len(t.words.ends), self.heads.code, len(self.mixer.weights), self.tables.opened()
        nodes, contexts = code.nodes, [c * _SALT for c in t.contexts(self.heads.end)]
        out = np.zeros(n)
        kept: list[tuple] = []
        for low in range(0, n, SIDE):
            mine, part, block = t.side_by_side(low)
            side = min(SIDE, n - low)
            so_far = np.zeros(side * nodes * 2, np.float32)
            change, seen = np.zeros((inputs, side), np.float32), np.zeros(side)
            for own in block:
                later, slope, fresh = [], np.zeros_like(change), np.zeros(side)
                for at in range(0, len(own), SLICE):
                    which, tokens = mine[own[at : at + SLICE]], part.take(own[at : at + SLICE])
                    owner, place, first = code.places(t.heads.take(which))
                    slots = placed([c.take(which) for c in contexts], owner, code.salt.take(place), code.among.take(place), HEAD_BITS)
                    text = tokens.take(owner)
                    here = text * (2 * nodes)
                    here += code.chosen.take(place)
                    n0, n1 = pairs_at(so_far, here >> 1)
                    x, gate = tables.inputs(slots, 1)
                    odds(n0, n1, x[-1])
                    gate *= LEVELS
                    gate += levels(n0 + n1)
                    z = self.mixer.mixed(x, gate, change, text)
                    # Texts stand in order here.
                    new = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
                    met, start, against = tokens[new], first[new], code.against.take(place)
                    out[low + met] -= np.add.reduceat(cost_against(self.mixer.refined(z, gate) * against), start, dtype=np.float64)
                    later.append(here)
                    err = chance(z * against)  # of the mixed odds, which the weights make
                    err *= against
                    for i in range(inputs):
                        slope[i, met] -= np.add.reduceat(err * x[i], start)
                    fresh[met] += np.diff(np.append(start, len(owner)))
                    if learn:
                        kept.append((x, gate, code.bit.take(place)))
                for at in later:
                    np.add.at(so_far, at, np.float32(1))
                seen += fresh
                change += (PULL * slope / (seen + 400)).astype(np.float32)
        if learn and kept:
            together = [np.concatenate([k[i] for k in kept], axis=-1) for i in range(3)]
            kept.clear()
            self.mixer.learn(together[0], together[1], together[2].astype(np.int64))
        return out


@dataclass
class SpellModel:
    """Spelling of the rest of words after their heads."""

    heads: Heads
    code: Code
    tables: Predictors
    mixer: Mixer

    def _rest(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(bytes to spell, each with its word's index, and their contexts)."""
        data, offsets = flat(words)
        size = np.diff(offsets)
        covers = self.heads.of(words, string_hashes(words))[1]
        # Each word with a space behind it.
        n = len(size)
        at = offsets[:-1] + np.arange(n)
        whole = np.full(len(data) + n, 0x20, np.uint8)
        is_byte = np.ones(len(whole), bool)
        is_byte[at + size] = False
        whole[is_byte] = data
        owner = np.repeat(np.arange(n), size + 1)
        place = np.arange(len(whole)) - at[owner]
        x = whole.astype(np.uint64) + np.uint64(1)
        back, contexts = np.zeros(len(x), np.uint64), []
        for order in range(1, 5):
            before = np.zeros(len(x), np.uint64)
            before[order:] = x[:-order] if order < len(x) else 0
            before[place < order] = 0
            back = back * np.uint64(259) + before
            contexts.append(mix(back + np.uint64(order << 56)))
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(mix((place.astype(np.uint64) << np.uint64(8)) * _SALT + x), out=total[1:])
        contexts.append(mix(total[:-1] - total[at][owner] + place.astype(np.uint64)))
        ok = (covers[owner] >= 0) & (place >= covers[owner])
        return whole[ok].astype(np.int64), owner[ok], [c[ok] for c in contexts]

    def _slices(self, words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        symbols, word, contexts = self._rest(words)
        for at in range(0, len(symbols), SLICE):
            owner, place, _ = self.code.places(symbols[at : at + SLICE])
            yield word[at : at + SLICE].take(owner), self.code.bit.take(place), placed([c[at : at + SLICE] * _SALT for c in contexts], owner, self.code.salt.take(place), self.code.among.take(place), SPELL_BITS)

    def count(self, words: pa.Array, total: list[np.ndarray]) -> None:
        for _, bit, slots in self._slices(words):
            counted(slots, bit, total)

    def learn(self, words: pa.Array, total: list[np.ndarray], fit: Fit) -> None:
        """Predicts the words from what is counted, for the mixer's sake, and then counts them."""
        for _, bit, slots in self._slices(words):
            fit.add(*so_counted(slots, total), bit)
            counted(slots, bit, total)

    def score(self, words: pa.Array, learn: bool = False) -> np.ndarray:
        """Natural logarithm of the chance of each word's rest."""
        out, kept, tables = np.zeros(len(words)), [], self.tables.opened()
        for word, bit, slots in self._slices(words):
            x, gate = tables.inputs(slots)
            out -= np.bincount(word, cost(self.mixer.refined(self.mixer.mixed(x, gate), gate), bit), len(out))
            if learn:
                kept.append((x, gate, bit))
        if learn and kept:
            together = [np.concatenate([k[i] for k in kept], axis=-1) for i in range(3)]
            kept.clear()
            self.mixer.learn(together[0], together[1], together[2].astype(np.int64))
        return out


def _token_counts(docs: DataFrame) -> DataFrame:
    """(word, c): occurrences in training documents, 0 for words of held-out documents alone."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def rows() -> Iterator[pa.RecordBatch]:
            if held:
                summed = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])
                held.clear()
                yield from summed.to_batches()

        size = 0
        for b in batches_of(batches):
            words, training = Words(b.column(0), lowered), ~b.column(1).to_numpy(zero_copy_only=False)
            learned = words.codes[np.repeat(training, np.diff(words.ends, prepend=0))]
            c = np.append(np.bincount(learned, minlength=len(words.distinct)), training.sum())
            held.append(pa.table({"word": pa.concat_arrays([words.distinct.cast(pa.binary()), pa.array([END], pa.binary())]), "c": pa.array(c, pa.int64())}))
            size += len(words.distinct)
            if size > 800_000:
                yield from rows()
                size = 0
        yield from rows()

    return docs.select("text", "held_out").mapInArrow(apply, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def keep_freed() -> None:
    """Has the allocator keep what arrays of a few megabytes leave, which tasks here make by the thousand, instead of asking the system for zeroed pages again. A task's end gives it back."""
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        libc = ctypes.CDLL("libc.so.6")
        for option, size in ((-3, 32 << 20), (-1, 128 << 20), (-2, 16 << 20)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_TOP_PAD
            libc.mallopt(option, size)


def parts_of(column: pa.Array, done: int) -> Iterator[pa.Array]:
    """The column's values in parts. done: bytes that came before."""
    ends, at = flat(column)[1], 0
    while at < len(column):
        most = min(max(done + int(ends[at]), FIRST_PART), LAST_PART)
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield column.slice(at, end - at)
        at = end


def _sums(rows: DataFrame, bits: tuple[int, ...], count, fit: tuple[int, int] | None = None) -> tuple[list[np.ndarray], Mixer | None]:
    """The counts that ``count`` makes of the first column's values in all tasks, added up block by block. The tables' size is fixed.

    fit: inputs and gates of a mixer, which ``count`` then fits to the same values.
    """
    per = 2 << BLOCK_BITS
    first = np.cumsum([0, *(max(1, (2 << b) // per) for b in bits)])
    sizes = [min(per, 2 << b) for b in bits for _ in range(max(1, (2 << b) // per))]
    # A task sends whole tables, however little it has counted: tasks count several splits each.
    splits = rows.rdd.getNumPartitions()
    rows = rows.coalesce(max(1, min(splits, max(rows.sparkSession.sparkContext.defaultParallelism, splits // SPLITS))))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        total, any_, done = blank_counts(bits), False, 0
        mine = Fit.blank(*fit) if fit else None
        for b in batches_of(batches):
            any_ = True
            if mine is None:
                count(b.column(0), total)
                continue
            for values in parts_of(b.column(0), done):
                count(values, total, mine)
                mine.settle()
            done += int(flat(b.column(0))[1][-1])
        if any_:
            for t, low in zip(total, first, strict=False):
                for i, own in enumerate(np.array_split(t, max(1, len(t) // per))):
                    most = int(own.max())
                    if most:  # in as few bytes as they need
                        yield pa.RecordBatch.from_arrays([pa.array([int(low) + i], pa.int32()), pa.array([own.astype(np.uint16 if most < 1 << 16 else np.uint32).tobytes()], pa.binary())], names=["block", "counts"])
            if mine:
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([mine.dump()], pa.binary())], names=["block", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(raw, "<i8") if block < 0 else np.frombuffer(raw, np.uint16 if len(raw) == 2 * sizes[block] else np.uint32).astype(np.uint32)
                sums[block] = sums[block] + own if block in sums else own
        for block, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["block", "counts"])

    out, mixer = blank_counts(bits), Mixer.blank(*fit) if fit else None
    added = rows.mapInArrow(part, "block int, counts binary").repartition("block").mapInArrow(add_up, "block int, counts binary")
    for row in added.toLocalIterator():
        if row.block < 0:
            mixer = Fit.blank(*fit).load(row.counts).settle()
            continue
        k = int(np.searchsorted(first, row.block, "right")) - 1
        at, own = (row.block - int(first[k])) * per, np.frombuffer(row.counts, np.uint32)
        out[k][at : at + len(own)] = own
    return out, mixer


def learn_heads(words: DataFrame) -> Heads:
    """The alphabet and its code, from the counts of all training words. At most WHOLE, PAIRS and 256 rows come to the driver."""
    known = words.where("c > 0 AND octet_length(word) > 0")
    whole = known.orderBy(F.desc("c"), "word").limit(WHOLE).select("word", "c").collect()
    hashes = words_hashes([bytes(r.word) for r in whole])
    order = np.argsort(hashes)
    rest = known.where(~F.hex("word").isin([bytes(r.word).hex().upper() for r in whole]))
    two = rest.where("octet_length(word) > 1").groupBy(F.substring("word", 1, 2).alias("p")).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "p").limit(PAIRS).collect()
    one = rest.groupBy(F.substring("word", 1, 1).alias("p")).agg(F.sum("c").alias("c")).collect()
    pairs = np.full(1 << 16, -1, np.int64)
    single = np.ones(256, np.int64)
    for r in one:
        single[r.p[0]] += r.c
    for i, r in enumerate(two):
        pairs[r.p[0] << 8 | r.p[1]] = i
        single[r.p[0]] -= r.c
    ends = words.where("octet_length(word) = 0").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    counts = np.concatenate([np.array([r.c for r in whole], np.int64)[order], np.array([r.c for r in two], np.int64), np.maximum(single, 1), [ends + 1]])
    return Heads(hashes[order], pairs, Code.of(counts))


def learn_spelling(words: DataFrame, heads: Heads) -> SpellModel:
    """Each training word counts once, whatever its frequency: it is how new words are spelled that counts."""
    known = words.where("c > 0 AND octet_length(word) > 0").select("word")

    def bytes_met(column: pa.Array, total: list[np.ndarray]) -> None:
        total[0][:256] += np.bincount(flat(column)[0], minlength=256).astype(np.uint32)
        total[0][0x20] += len(column)

    met = _sums(known, (BLOCK_BITS,), bytes_met)[0][0][:256]
    model = SpellModel(heads, Code.of(met.astype(np.int64) + 1), Predictors(SPELL_BITS, []), Mixer.blank(len(SPELL_BITS)))
    # What counts needs no tables, and tasks are sent none.
    learn = SpellModel(heads, model.code, Predictors(SPELL_BITS, []), Mixer.blank(1)).learn
    model.tables.counts, model.mixer = _sums(known, SPELL_BITS, learn, (len(SPELL_BITS), LEVELS**2))
    model.tables.settle().counts = []
    return model


def learn_sequence(docs: DataFrame, heads: Heads) -> HeadModel:
    """Every training document is counted, and fits the weights."""
    learn = HeadModel(heads, Predictors(HEAD_BITS, []), Mixer.blank(1)).learn
    counts, mixer = _sums(docs.where("NOT held_out").select("text"), HEAD_BITS, learn, (len(HEAD_BITS) + 1, LEVELS**3))
    model = HeadModel(heads, Predictors(HEAD_BITS, counts).settle(), mixer)
    model.tables.counts = []
    return model


def least_count(sizes: list, most: int) -> int:
    """The least power of two such that at most ``most`` words occur as often. sizes: words by the power of two of their counts, largest first."""
    floor, kept = 1 << 62, 0
    for row in sizes:
        kept += row["count"]
        if kept > most:
            break
        floor = 1 << row.e
    return floor


def score(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", head: int = HEAD) -> DataFrame:
    """One row per document: the id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("held_out", F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2)
    words = scratch.settle(_token_counts(own), "words")
    counts = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.coalesce(F.max(F.when(F.octet_length("word") == 0, F.col("c"))), F.lit(0)).alias("docs")).first()
    n, v, n_ends = counts.n, counts.v, counts.docs
    sizes = words.where("c > 0").groupBy(F.floor(F.log2("c")).cast("int").alias("e")).count().orderBy(F.desc("e")).collect()
    heads = learn_heads(words)
    spelling = spark.sparkContext.broadcast(learn_spelling(words, heads))

    def with_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        model = replace(spelling.value, tables=spelling.value.tables.opened())
        for b in batches_of(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(string_hashes(b.column(0)).view(np.int64)), b.column(1), pa.array(model.score(b.column(0)) / math.log(10))], names=["h", "c", "lp"])

    scored = scratch.settle(words.where("octet_length(word) > 0").mapInArrow(with_scores, "h long, c long, lp double"), "scored")
    scratch.drop("words")
    spelling.destroy()
    top = scored.where(F.col("c") >= least_count(sizes, head)).toPandas()
    hashes = top.h.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    common = spark.sparkContext.broadcast((hashes[order], top.c.to_numpy(np.int64)[order], top.lp.to_numpy(np.float64)[order]))
    sequence = spark.sparkContext.broadcast(learn_sequence(own, heads))
    log_z = math.log10(n + v + 1)

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        known_h, known_c, known_lp = common.value
        found = Found(known_h)
        model, base = replace(sequence.value, tables=sequence.value.tables.opened()), TaskContext.get().partitionId() << 40
        for b in batches_of(batches, 2 << 20):
            t = Text.of(b.column(2), heads)
            ends, codes, texts = t.words.ends, t.words.codes, b.num_rows
            is_common = np.zeros(len(t.hashes), bool)
            c, lp = np.zeros(len(t.hashes), np.int64), np.zeros(len(t.hashes))
            if len(known_h):
                at, is_common = found(t.hashes)
                c, lp = np.where(is_common, known_c[at], 0), np.where(is_common, known_lp[at], 0.0)
            text = np.repeat(np.arange(texts), np.diff(np.concatenate([[0], ends])))
            total = lambda each: np.bincount(text, each[codes], texts)  # noqa: B023, E731
            size = np.diff(t.words.offsets)
            rare = np.flatnonzero(~is_common[codes])
            end = (math.log10(n_ends + 1) - log_z, int(n_ends > 0))
            # First the documents themselves, then their rare words.
            rid = base + np.arange(texts)
            base += texts
            of_text = [np.diff(np.concatenate([[0], ends])) + 1, size, total(is_common.astype(float)) + end[1], total(np.where(is_common, np.log10(c + 1) - log_z, 0.0)) + end[0], model.score(t) / math.log(10) + total(lp)]
            columns = [pa.concat_arrays([b.column(0), pa.nulls(len(rare), b.column(0).type)]), pa.concat_arrays([b.column(1), pa.nulls(len(rare), pa.bool_())])]
            columns += [pa.array(np.concatenate([rid, rid[text[rare]]])), pa.concat_arrays([pa.nulls(texts, pa.int64()), pa.array(t.hashes[codes[rare]].view(np.int64))])]
            columns += [pa.concat_arrays([pa.array(x.astype(np.float64 if i > 2 else np.int64)), pa.nulls(len(rare), pa.float64() if i > 2 else pa.int64())]) for i, x in enumerate(of_text)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "held_out", "rid", "h", "tokens", "size", "known", "base", "lp"])

    kind = own.schema[id_col].dataType.simpleString()
    placed = own.select(id_col, "held_out", "text").mapInArrow(of_documents, f"`{id_col}` {kind}, held_out boolean, rid long, h long, tokens long, size long, known long, base double, lp double")
    # A row's number is given once and written, so that a task which runs again can't give another.
    places = scratch.settle(placed, "places")
    rare = places.where("h IS NOT NULL").select("rid", "h").join(scored, "h")
    sums = rare.groupBy("rid").agg(F.count_if(F.col("c") > 0).alias("k"), F.sum(F.log10(F.col("c") + 1) - log_z).alias("b"), F.sum(scored.lp).alias("s"))
    total = F.col("lp") + F.coalesce("s", F.lit(0.0))
    return (
        places.where("h IS NULL")
        .join(sums, "rid", "left")
        .select(
            id_col, "held_out", F.col("tokens").alias("n_tokens"), (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), total.alias("score"), (-total * math.log2(10) / F.greatest("size", F.lit(1))).alias("bits_per_byte"),
        )
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), Scratch(spark, "op3"))
