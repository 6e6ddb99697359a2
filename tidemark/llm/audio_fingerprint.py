"""Chroma fingerprints of recordings, and their alignment by offset histograms and bit errors.

A recording's samples are cut into frames; the energies of a frame's spectrum are added up by
pitch class. Over the resulting picture (frames by 12 classes) its integral image gives the sums of
any rectangle, and 16 filters compare neighbouring rectangles. Each filter's value becomes two bits
(Gray-coded, so that neighbouring levels differ in one), and 16 filters make a packed 32-bit integer
per frame.

Two recordings are compared at all offsets with enough overlap: their bits' cross-correlation gives
the differing bits of each. Of the offsets with few enough errors, they are aligned where the agreeing
bits exceed the differing ones by most.

Recordings with equal fingerprints are one class, named by its smallest id, and are searched once,
so that a recording that is everywhere costs no more than any other. Every query class meets every
other class, in blocks, so that no match is missed; the work grows with the product of their numbers.

Vectors are heard as recordings: each number is a tone of ``TONE`` samples whose pitch it sets.
Nulls and numbers that aren't finite are silence. Recordings under ``WIDTH`` frames, and nulls,
have no fingerprint, class or match. Rows of one id are recordings each. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_ID, Scratch, table

RATE, FRAME, TONE, WIDTH, LOWEST = 8000, 1024, 1024, 16, 110.0
#: Frames' windows overlap: each begins half a frame after the last.
HOP = FRAME // 2
#: Differing bits in a hundred, at most, of recordings that match, and frames they must overlap in.
MOST_ERRORS, LEAST_OVERLAP = 30, 32
#: Frames of the recordings in one block, and numbers that a side of a comparison, or its pairs, hold at a time.
BLOCK_FRAMES, MOST_NUMBERS = 1 << 15, 1 << 23
#: Levels of a filter's value, in log ratios.
LEVELS = np.array([-0.25, 0.0, 0.25])
GRAY = np.array([0, 1, 3, 2], np.uint32)


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, lowest class, classes, frames) of the 16 filters: each kind at several sizes and places."""
    sizes = [(12, 16), (6, 8), (4, 4), (3, 16)]
    return [(kind, (3 * i + 2 * kind) % (12 - h + 1), h, w) for i, (h, w) in enumerate(sizes) for kind in range(4)]


FILTERS = filters()


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Pitch-class energies (recordings x frames x 12) of recordings of one length."""
    n = (samples.shape[1] - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((len(samples), 0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME, axis=1)[:, ::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=2)) ** 2
    pitch = np.fft.rfftfreq(FRAME, 1 / rate)
    used = np.flatnonzero((pitch >= LOWEST) & (pitch < 3520))
    into = np.zeros((len(pitch), 12))
    into[used, np.rint(12 * np.log2(pitch[used] / LOWEST)).astype(int) % 12] = 1
    out = power @ into
    total = np.sqrt((out**2).sum(2, keepdims=True))
    return np.divide(out, total, out=np.zeros_like(out), where=total > 1e-9)


def integers(image: np.ndarray) -> np.ndarray:
    """The packed integers (recordings x frames - WIDTH + 1) of chroma pictures."""
    n = image.shape[1] - WIDTH + 1
    if n <= 0:
        return np.zeros((len(image), 0), np.uint32)
    integral = np.zeros((len(image), image.shape[1] + 1, 13))
    integral[:, 1:, 1:] = image.cumsum(1).cumsum(2)

    def area(x: int, w: int, y: int, h: int) -> np.ndarray:
        a, b = integral[:, x : x + n], integral[:, x + w : x + w + n]
        return b[:, :, y + h] - b[:, :, y] - a[:, :, y + h] + a[:, :, y]

    out = np.zeros((len(image), n), np.uint32)
    for kind, y, h, w in FILTERS:
        if kind == 0:  # this frame against those to come
            one, two = area(0, w // 2, y, h), area(w // 2, w - w // 2, y, h)
        elif kind == 1:  # low classes against high ones
            one, two = area(0, w, y, h // 2), area(0, w, y + h // 2, h - h // 2)
        elif kind == 2:  # the corners against each other
            one = area(0, w // 2, y, h // 2) + area(w // 2, w - w // 2, y + h // 2, h - h // 2)
            two = area(w // 2, w - w // 2, y, h // 2) + area(0, w // 2, y + h // 2, h - h // 2)
        else:  # the middle against both sides
            third = max(1, w // 4)
            two = area(third, w - 2 * third, y, h)
            one = area(0, w, y, h) - two
        value = np.log((1 + one) / (1 + two))
        out = out << np.uint32(2) | GRAY[np.searchsorted(LEVELS, value, "right")]
    return out


def tones(vectors: np.ndarray) -> np.ndarray:
    """Recordings of vectors of one length: a tone for each number, as many semitones up or down as eighths of the vector's spread; silence where it isn't finite."""
    sounding = np.isfinite(vectors)
    size = np.where(sounding, vectors, 0.0)
    spread = np.sqrt((size**2).mean(1, keepdims=True))
    step = np.rint(np.clip(np.divide(size, spread, out=np.zeros_like(size), where=spread > 0), -3, 3) * 8)
    pitch = (LOWEST * 4) * 2 ** (step / 12)
    phase = 2 * np.pi * np.repeat(pitch, TONE, axis=1) * (np.arange(vectors.shape[1] * TONE) / RATE)
    return (np.sin(phase) * np.repeat(sounding, TONE, axis=1)).astype(np.float32)


def fingerprints(df: DataFrame, id_col: str, col: str, vectors: bool = False) -> DataFrame:
    """Rows (id, frames): the packed integers of each row's samples, or of its vector's tones. Empty where there are too few."""
    most = 64

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, most):
                part = b.slice(at, most)
                rows = [np.array([np.nan if x is None else x for x in v], np.float64) if v else np.zeros(0) for v in part.column(1).to_pylist()]
                out: list = [None] * len(rows)
                for length in {len(r) for r in rows}:
                    same = [i for i, r in enumerate(rows) if len(r) == length]
                    stack = np.array([rows[i] for i in same]).reshape(len(same), length)
                    samples = tones(stack) if vectors else np.nan_to_num(stack, posinf=0, neginf=0)
                    for i, f in zip(same, integers(chroma(samples)), strict=True):
                        out[i] = f.astype(np.int64).tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.int64()))], names=["id", "frames"])

    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(col).cast("array<double>").alias("v")).mapInArrow(apply, "id long, frames array<bigint>")


def classes(prints: DataFrame) -> DataFrame:
    """(class_id, frames, n, query): recordings with equal fingerprints, and whether an id of theirs is a query's."""
    return prints.where(F.size("frames") > 0).groupBy("frames").agg(F.min("id").alias("class_id"), F.count("*").alias("n"), F.min(F.when(F.col("id") % 50 == 0, F.col("id"))).alias("query_id"))


def spectra(frames: list[np.ndarray], n: int) -> np.ndarray:
    """Spectra (recordings x frequencies x 32) of the recordings' bits as 1 and -1, padded to n frames."""
    out = np.zeros((len(frames), n, 32), np.float32 if n <= 8192 else np.float64)
    for i, f in enumerate(frames):
        out[i, : len(f)] = (f[:, None] >> np.arange(32) & 1) * 2 - 1
    return np.fft.rfft(out, axis=1)


def fft_length(least: int) -> int:
    """The least 2^a or 3 * 2^a of at least ``least``."""
    power = 1 << max(least - 1, 1).bit_length()
    return power // 4 * 3 if power // 4 * 3 >= least else power


def compared(queries: list[np.ndarray], others: list[np.ndarray], most_errors: int, least_overlap: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(query, other, offset, votes, overlap, bit_errors) of all pairs that match at some offset. All have least_overlap frames."""
    size_q, size_c = (np.array([len(f) for f in side]) for side in (queries, others))
    n = fft_length(int(size_q.max() + size_c.max()) - least_overlap)
    # Of equally good offsets the smaller shift, then the smaller offset.
    offsets = np.arange(least_overlap - size_q.max(), size_c.max() - least_overlap + 1)
    offsets = offsets[np.lexsort((offsets, np.abs(offsets)))]
    step = max(1, MOST_NUMBERS // (n * 32))
    for c0 in range(0, len(others), step):
        c = spectra(others[c0 : c0 + step], n).transpose(1, 2, 0)
        rows = max(1, MOST_NUMBERS // (n * c.shape[2]))
        for q0 in range(0, len(queries), min(rows, step)):
            q = np.conj(spectra(queries[q0 : q0 + min(rows, step)], n)).transpose(1, 0, 2)
            agreeing = np.fft.irfft(np.matmul(q, c), n, axis=0)[offsets % n]
            sq, sc = size_q[q0 : q0 + q.shape[1]], size_c[c0 : c0 + c.shape[2]]
            if len(set(sq)) == len(set(sc)) == 1:
                sq, sc = sq[:1], sc[:1]
            at = offsets[:, None, None]
            overlap = np.minimum(sq[None, :, None] - np.maximum(-at, 0), sc[None, None, :] - np.maximum(at, 0))
            floor = np.where(overlap >= least_overlap, 32 * overlap - 2 * (32 * overlap * most_errors // 100), 1 << 40).astype(np.float32)
            ok = agreeing > floor - 0.5
            for i, j in np.argwhere(ok.any(0)):
                best = int(np.where(ok[:, i, j], np.rint(agreeing[:, i, j]), -(1 << 40)).argmax())
                offset, a, b = int(offsets[best]), queries[q0 + i], others[c0 + j]
                a, b = a[max(-offset, 0) :], b[max(offset, 0) :]
                shared = min(len(a), len(b))
                differing = a[:shared] ^ b[:shared]
                yield q0 + int(i), c0 + int(j), offset, int((differing == 0).sum()), shared, int(np.bitwise_count(differing).sum())


def blocks(known: DataFrame, name: str) -> DataFrame:
    """(name_ids, name_queries, name_sizes, name_frames): recordings of like lengths, about BLOCK_FRAMES frames of them in a row."""
    sized = known.withColumn("size", F.size("frames")).withColumn("power", F.floor(F.log2("size")).cast("int"))
    dealt = sized.groupBy("power").agg(F.ceil(F.sum("size") / BLOCK_FRAMES).alias("blocks"))
    dealt = sized.join(F.broadcast(dealt), "power").withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")))  # a row for each power of two
    rows = dealt.groupBy("power", "block").agg(F.collect_list(F.struct("class_id", "query_id", "size", "frames")).alias("r"))
    return rows.select(F.col("r.class_id").alias(f"{name}_ids"), F.col("r.query_id").alias(f"{name}_queries"), F.col("r.size").alias(f"{name}_sizes"), F.flatten("r.frames").alias(f"{name}_frames"))


def alignments(known: DataFrame, most_errors: int = MOST_ERRORS, least_overlap: int = LEAST_OVERLAP) -> DataFrame:
    """(q, query_id, class_id, offset, votes, overlap, bit_errors) of all query classes and other classes that match; votes are the equal integers."""
    names = ["q", "query_id", "class_id", "offset", "votes", "overlap", "bit_errors"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                qi, qq, qs, qf, ci, _, cs, cf = (c[at].values.to_numpy(zero_copy_only=False) for c in batch.columns)
                sides = (np.split(f, np.cumsum(s)[:-1]) for f, s in ((qf, qs), (cf, cs)))
                found = [(int(qi[i]), int(qq[i]), int(ci[j]), *rest) for i, j, *rest in compared(*sides, most_errors, least_overlap) if qi[i] != ci[j]]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)

    long = known.where(F.size("frames") >= max(least_overlap, 1))
    pairs = blocks(long.where("query_id IS NOT NULL"), "q").crossJoin(blocks(long, "c"))
    return pairs.mapInArrow(apply, ", ".join(f"{c} long" for c in names))


def search(prints: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """From prints that were written: vec_id, n_frames, class_id, class_size, query_id, offset, votes, overlap, bit_errors, query_class_id, best_query.

    Each recording has a row with its best query (best_query is true), by the share of differing
    bits; a query of the recording's own class matches it without an error. query_id is null where
    none matches. All other matches of a class with query classes are further rows of the recording
    that names the class (best_query is false). A match holds for all recordings of class_id and
    all queries of query_class_id; query_id is the smallest of these.
    """
    known = classes(prints)
    met = alignments(known)
    if scratch:
        met = scratch.settle(met, "alignments")
    share = F.col("bit_errors") / (F.col("overlap") * 32)
    rank = Window.partitionBy("class_id").orderBy(share, F.desc("votes"), "query_id", "q")
    ranked = met.withColumn("_r", F.row_number().over(rank))
    best = ranked.where("_r = 1").select("class_id", F.col("query_id").alias("best_id"), F.col("q").alias("best_q"), "offset", "votes", "overlap", "bit_errors")
    own = F.col("query_id").isNotNull()
    of_class = known.select("frames", "class_id", "query_id", "n").join(best, "class_id", "left")
    pick = lambda mine, theirs: F.when(own, mine).otherwise(F.col(theirs)).cast("long").alias(theirs)
    shown = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    size = F.size("frames")
    members = (
        prints.join(of_class, "frames", "left")
        .select(
            shown("id").alias("vec_id"), size.cast("long").alias("n_frames"), shown("class_id").alias("class_id"), F.col("n").alias("class_size"),
            F.coalesce("query_id", "best_id").alias("query_id"), pick(F.lit(0), "offset"), pick(size, "votes"), pick(size, "overlap"), pick(F.lit(0), "bit_errors"),
            F.when(own, shown("class_id")).otherwise(shown("best_q")).alias("query_class_id"), F.lit(True).alias("best_query"),
        )
    )
    about = known.select("class_id", size.cast("long").alias("n_frames"), "n", F.col("query_id").alias("own_id"))
    others = (
        ranked.join(about, "class_id")
        .where("_r > 1 OR own_id IS NOT NULL")
        .select(shown("class_id").alias("vec_id"), "n_frames", shown("class_id").alias("class_id"), F.col("n").alias("class_size"), "query_id", "offset", "votes", "overlap", "bit_errors", shown("q").alias("query_class_id"), F.lit(False).alias("best_query"))
    )
    return members.unionByName(others)


def op4_audio_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", vectors=True)
    scratch = Scratch(spark, "op4")
    return search(scratch.settle(prints, "prints"), scratch)
