r"""Quality rules: base counts of a text, and a linear-chain conditional random field over its lines.

Words are ``[^\x20\x09-\x0D]+``. Each line gets features (shares of symbols, capitals, digits and
repeated words, its length, its end and so on); Viterbi decoding marks lines as content or
boilerplate, and a text whose words stand on content lines for less than ``min_content`` of all
is rejected, as is one that fails the base rule (under ``min_words`` words, or more than
``max_repeat_percent`` % of its words in repeated 5-word windows).

The field is fitted on a bounded sample of labelled rows, ``TRAIN_ROWS`` rows and ``TRAIN_LINES``
lines of each: lines of a text labelled good are content, lines of one labelled bad are not. Good
and bad texts are also spliced, one inside the other, so that the field learns where lines change
from the one to the other within a text. Without labels every line is content, so that the base
rule alone decides.

Null texts have no words, fail the base rule and are not kept. Repeated rows are judged each, and
rows without an id as well. Labels that are null or have no document are left out of the fit; of
repeated rows of a labelled id the least text is fitted on, once for each label. An empty table gives
no rows; a line of any length is one line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Words, as_bytes, batches_of, bounded_batches, shingle_hashes, table

TRAIN_ROWS, TRAIN_LINES = 4000, 200
SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGIT, _MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b"!?;:=_~^{}[]\\/@+"
FEATURES = ("one", "blank", "short", "words", "long", "symbols", "bar", "upper", "digits", "marks", "repeats", "duplicate", "mean_word", "sentence_end", "first", "last")
N = len(FEATURES)


@dataclass(frozen=True)
class Base:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    def failed(self, min_words: int = 10, max_repeat_percent: int = 20) -> bool:
        return self.n_words < min_words or 100 * self.n_repeat_words > max_repeat_percent * self.n_words


def repeat_words(hashes: np.ndarray, k: int = 5) -> int:
    """Words in k-word windows that are found twice or more, the first included."""
    windows = shingle_hashes(hashes, k)
    if len(windows) < 2:
        return 0
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    at = np.searchsorted(twice, windows)
    starts = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == windows)
    edge = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: bytes, n_chars: int, hashes: np.ndarray) -> Base:
    """hashes: of the text's words."""
    words = text.split()
    spaces = len(text) - sum(map(len, words))
    seen: set[bytes] = set()
    dup = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                dup += bool(line.split())
            else:
                seen.add(line)
    return Base(len(words), n_chars - spaces, len(text) - len(text.translate(None, SYMBOLS)), dup, repeat_words(hashes))


def line_features(text: bytes, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x FEATURES, words of each line)."""
    lines = text.split(b"\n")
    count = len(lines)
    lines = lines[:most]
    x = np.zeros((len(lines), N), np.float32)
    n_words = np.zeros(len(lines), np.int64)
    seen: set[bytes] = set()
    for i, line in enumerate(lines):
        words = line.split()
        w = n_words[i] = len(words)
        if not w:
            x[i, :2] = 1
            continue
        n = len(line)
        bar = line.count(b"|")
        x[i] = (
            1, 0, w < 4, min(w, 60) / 60, w > 150,
            min(1.0, 4 * (n - len(line.translate(None, SYMBOLS))) / n), min(1.0, 4 * bar / w), (n - len(line.translate(None, _UPPER))) / n,
            (n - len(line.translate(None, _DIGIT))) / n, min(1.0, 4 * (n - len(line.translate(None, _MARKS))) / n),
            1 - len(set(words)) / w if w > 8 else 0, line in seen, min((n - w + 1) / w, 15) / 15, words[-1][-1:] in b".!?", i == 0, i == count - 1,
        )
        seen.add(line)
    return x, n_words


@dataclass(frozen=True)
class LineField:
    """emit: FEATURES x 2; move: 2 x 2, from and to. Label 1 is content."""

    emit: np.ndarray
    move: np.ndarray

    @staticmethod
    def blank() -> LineField:
        return LineField(np.zeros((N, 2)), np.zeros((2, 2)))

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi: the likeliest labels; content where both are as likely."""
        scores = (x @ self.emit).tolist()
        (stay0, to1), (to0, stay1) = self.move.tolist()
        a, b = scores[0]
        back = []
        for e0, e1 in scores[1:]:
            p0, p1 = a + stay0 > b + to0, a + to1 > b + stay1  # true: the line before is boilerplate
            back.append((p0, p1))
            a, b = (a + stay0 if p0 else b + to0) + e0, (a + to1 if p1 else b + stay1) + e1
        label = int(b >= a)
        out = [label]
        for p in reversed(back):
            label = int(not p[label])
            out.append(label)
        return np.array(out[::-1])

    def content_share(self, text: bytes) -> float:
        x, n_words = line_features(text)
        total = n_words.sum()
        return float(n_words[self.decode(x) == 1].sum() / total) if total else 0.0


def spliced(docs: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, label of each line) of the texts, and of pairs of a good and a bad one with either inside the other."""
    out = [(x, np.full(len(x), y)) for x, y in docs]
    good, bad = ([x for x, y in docs if y == label] for label in (1, 0))
    for i, (a, b) in enumerate(zip(good, bad)):
        for outer, inner, label in ((a, b, 1), (b, a, 0)):
            at = i % len(outer) if len(outer) else 0
            x = np.concatenate([outer[:at], inner, outer[at:]])
            x[:, -2:] = 0
            x[0, -2], x[-1, -1] = 1, 1  # first and last lines
            y = np.full(len(x), label)
            y[at : at + len(inner)] = 1 - label
            out.append((x, y))
    return out


def fit(docs: list[tuple[np.ndarray, int]], steps: int = 150, rate: float = 0.15, l2: float = 1e-4) -> LineField:
    """Maximum likelihood by gradient steps (Adam) on (features, label) of texts and of texts spliced from two, all at once."""
    docs = [d for d in docs if len(d[0])]
    if not docs or len({y for _, y in docs}) < 2:
        return LineField.blank()
    docs = spliced(docs)
    docs.sort(key=lambda d: -len(d[0]))
    length = np.array([len(x) for x, _ in docs])
    d, t = len(docs), int(length[0])
    x = np.zeros((t, d, N), np.float32)
    for i, (f, _) in enumerate(docs):
        x[: len(f), i] = f
    y = np.zeros((t, d), np.int64)
    for i, (_, v) in enumerate(docs):
        y[: len(v), i] = v
    alive = [int((length > s).sum()) for s in range(t)]
    weight = 1 / np.sqrt(length)  # a long text counts more than a short one, but not by its lines
    weight /= weight.sum()
    theta = np.zeros(2 * N + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        emit, move = theta[: 2 * N].reshape(N, 2), theta[2 * N :].reshape(2, 2)
        e = x @ emit
        alpha = np.empty((t, d, 2))
        alpha[0] = e[0]
        for s in range(1, t):
            n = alive[s]
            alpha[s, :n] = np.logaddexp(alpha[s - 1, :n, :1] + move[0], alpha[s - 1, :n, 1:] + move[1]) + e[s, :n]
        beta = np.zeros((t, d, 2))
        log_z = np.empty(d)
        g_emit, g_move = np.zeros((N, 2)), np.zeros((2, 2))
        last = np.logaddexp(alpha[length - 1, np.arange(d), 0], alpha[length - 1, np.arange(d), 1])
        log_z[:] = last
        for s in range(t - 1, -1, -1):
            n = alive[s]
            if s + 1 < t and alive[s + 1]:
                k = alive[s + 1]
                ahead = e[s + 1, :k] + beta[s + 1, :k]
                beta[s, :k, 0] = np.logaddexp(ahead[:, 0] + move[0, 0], ahead[:, 1] + move[0, 1])
                beta[s, :k, 1] = np.logaddexp(ahead[:, 0] + move[1, 0], ahead[:, 1] + move[1, 1])
                pair = np.exp(alpha[s, :k, :, None] + move + ahead[:, None, :] - log_z[:k, None, None]) * weight[:k, None, None]
                g_move -= pair.sum(0)
                np.add.at(g_move, (y[s, :k], y[s + 1, :k]), weight[:k])
            p = np.exp(alpha[s, :n] + beta[s, :n] - log_z[:n, None])
            gap = -p
            gap[np.arange(n), y[s, :n]] += 1
            g_emit += x[s, :n].T @ (gap * weight[:n, None])
        grad = np.concatenate([g_emit.ravel(), g_move.ravel()]) - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return LineField(theta[: 2 * N].reshape(N, 2).copy(), theta[2 * N :].reshape(2, 2).copy())


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, lines: int = TRAIN_LINES) -> LineField:
    """The field fitted on at most ``rows`` labelled rows, those whose ids' hashes are smallest, and ``lines`` lines of each."""
    sample = (
        labels.where("quality IN (0, 1)").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id", "_y").limit(rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "_y").agg(F.min("text").alias("text")).select("doc_id", "text", "_y")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            found = [line_features(t, lines)[0].tobytes() for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), b.column(2)], names=["doc_id", "x", "y"])

    got = texts.mapInArrow(apply, "doc_id long, x binary, y int").toPandas().sort_values(["doc_id", "x"])
    return fit([(np.frombuffer(x, np.float32).reshape(-1, N), y) for x, y in zip(got.x, got.y, strict=True)])


class Judge:
    """Base counts and verdict of texts."""

    def __init__(self, field: LineField, min_words: int = 10, max_repeat_percent: int = 20, min_content: float = 0.5):
        self.field, self.min_words, self.max_repeat_percent, self.min_content = field, min_words, max_repeat_percent, min_content

    def __call__(self, text: bytes, n_chars: int, hashes: np.ndarray) -> tuple[Base, bool, float, bool]:
        base = base_counts(text, n_chars, hashes)
        failed = base.failed(self.min_words, self.max_repeat_percent)
        share = self.field.content_share(text)
        return base, failed, share, not failed and share >= self.min_content

    def all(self, texts: pa.Array) -> Iterator[tuple[Base, bool, float, bool]]:
        """Verdicts of a column of texts."""
        words = Words(texts)
        for t, h in zip(as_bytes(texts), words.by_text(words.hashes()), strict=True):
            yield self(t, _n_chars(t), h)


def _n_chars(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode())


def judge(docs: DataFrame, field: LineField, id_col: str = "doc_id", **rules) -> DataFrame:
    """One row per text: the id, base counts, base_failed, kept and content_share."""
    verdict = Judge(field, **rules)
    bounded_batches(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            rows = [(r[0].n_words, r[0].word_chars, r[0].n_symbols, r[0].n_dup_lines, r[0].n_repeat_words, r[1], r[3], r[2]) for r in verdict.all(b.column(1))]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()], strict=True))],
                names=[id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"],
            )

    chosen = docs.select(id_col, "text")
    kind = chosen.schema[id_col].dataType.simpleString()
    return chosen.mapInArrow(apply, f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")


def keep(docs: DataFrame, field: LineField, **rules) -> DataFrame:
    """The rows of docs, all columns, whose text is kept."""
    verdict, at = Judge(field, **rules), docs.columns.index("text")
    bounded_batches(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            yield b.filter(pa.array([r[3] for r in verdict.all(b.column(at))], pa.bool_()))

    return docs.mapInArrow(apply, docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
