"""Content-chosen anchors: which windows of a corpus may be repeated, without shuffling every window.

A window of fixed length holds several grams; the one with the least hash is its anchor, so that
equal windows have equal anchors at equal places in them. Neighbouring windows mostly share their
anchor: far fewer anchors than windows are shuffled. Only windows whose anchor occurs twice or more
in the corpus can be repeated; all others are settled.

Anchors travel packed, many to a row. A worker sends one of equal anchors of its batch, so that an
anchor that is everywhere costs a row per batch and not one per place. Where anchors meet, a task
holds one bucket at a time, a quarter of what a shuffle partition holds on average.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_ID, as_bytes, batches_of, partitions

#: Text of a worker's batch whose anchors are packed together.
BATCH_BYTES = 12 << 20


def keyed(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Columns k (the id; null sorts last), v and text (null is empty).

    v is 0, but where rows of one id have different texts it numbers these, ordered by digest:
    they are documents of their own.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digests = rows.select("k", F.sha2("text", 256).alias("sha"))
    twice = digests.groupBy("k").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a <> b")
    if twice.isEmpty():
        return rows.select("k", F.lit(0).alias("v"), "text")
    from pyspark.sql import Window

    numbered = digests.join(twice, "k", "left_semi").distinct().withColumn("v", F.row_number().over(Window.partitionBy("k").orderBy("sha")) - 1)
    return rows.withColumn("sha", F.sha2("text", 256)).join(numbered, ["k", "sha"], "left").select("k", F.coalesce("v", F.lit(0)).alias("v"), "text")


def sliding_anchors(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, place) of each run of windows with the same anchor.

    grams: a hash for each place, under 2**24 of them; a window has ``width`` places in a row.
    The least hash wins, the leftmost of equal ones.
    """
    n = len(grams) - width + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none
    low = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: n], low[width - span : width - span + n])
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    place = (low[first] & np.uint64((1 << 24) - 1)).astype(np.int64)
    return first, np.diff(np.append(first, n)), place


class Pack:
    """Columns of numbers of one length, as the bytes of a row."""

    def __init__(self, **kinds: str):
        self.kinds = kinds

    def dump(self, columns: dict[str, np.ndarray], at: np.ndarray) -> bytes:
        return b"".join([np.int64(len(at)).tobytes(), *(np.ascontiguousarray(columns[c][at], k).tobytes() for c, k in self.kinds.items())])

    def load(self, row: bytes) -> tuple[dict[str, np.ndarray], memoryview]:
        n = int(np.frombuffer(row, np.int64, 1)[0])
        out, at = {}, 8
        for c, k in self.kinds.items():
            out[c] = np.frombuffer(row, k, n, at)
            at += n * np.dtype(k).itemsize
        return out, memoryview(row)[at:]


ANCHORS = Pack(h="u8", k="i8", v="i4", first="i4", place="i4", n="i2", known="u1")


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows in it)."""
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else []
    for s, e in zip(starts, [*starts[1:], len(order)], strict=True):
        yield int(ordered[s]), order[s:e]


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(bucket, its packed rows), bucket after bucket, of rows that are sorted by bucket. Rows of buckets below 0 come as they are."""
    now, rows = None, []
    for b in batches:
        for bucket, row in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if bucket < 0:
                yield bucket, [row.as_py()]
                continue
            if bucket != now and rows:
                yield now, rows
                rows = []
            now = bucket
            rows.append(row.as_py())
    if rows:
        yield now, rows


def repeated_anchors(docs: DataFrame, find: Callable[[list[bytes]], Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]) -> DataFrame:
    """Per document (k, v) the runs of windows whose anchor occurs again in the corpus: ``runs``, an array of binary, each of RUN.

    find: texts -> (index of the text, hash, first window, place of the anchor, number of windows) of each run.
    """
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)

    def flush(parts: list[dict[str, np.ndarray]]) -> Iterator[tuple[int, bytes]]:
        c = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
        order = np.argsort(c["h"], kind="stable")
        h = c["h"][order]
        same = h[1:] == h[:-1]
        again, known = np.concatenate([[False], same]), np.zeros(len(h), bool)
        known[1:] |= same
        known[:-1] |= same
        c = {name: a[order] for name, a in c.items()} | {"known": known}
        for b, at in by_bucket((h[~again] % np.uint64(buckets)).astype(np.int64)):
            yield b, ANCHORS.dump(c, np.flatnonzero(~again)[at])
        rest = np.flatnonzero(again)  # known to be repeated: these only pass through, wherever there is room
        for i, at in enumerate(np.array_split(rest, max(1, len(rest) // 4096)) if len(rest) else []):
            yield -1 - int((int(h[at[0]]) + i) % buckets), ANCHORS.dump(c, at)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches_of(batches):
            k, v, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), as_bytes(b.column(2))
            for i, h, first, place, n in find(texts):
                parts.append({"h": h, "k": np.full(len(h), k[i]), "v": np.full(len(h), v[i]), "first": first, "place": place, "n": n})
            held += b.nbytes
            if held > BATCH_BYTES and parts:
                yield _pairs(flush(parts))
                parts, held = [], 0
        if parts:
            yield _pairs(flush(parts))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in buckets_of(batches_of(batches)):
            if bucket < 0:
                for row in rows:
                    got = ANCHORS.load(row)[0]
                    yield from _runs(got, np.ones(len(got["h"]), bool))
                continue
            parts = [ANCHORS.load(row)[0] for row in rows]
            c = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
            order = np.argsort(c["h"], kind="stable")
            h = c["h"][order]
            same = h[1:] == h[:-1]
            keep = c["known"][order].astype(bool)
            keep[1:] |= same
            keep[:-1] |= same
            yield from _runs({name: a[order] for name, a in c.items()}, keep)

    sent = docs.mapInArrow(send, "bucket int, packed binary")
    met = sent.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "k long, v int, runs binary")
    return met.groupBy("k", "v").agg(F.collect_list("runs").alias("runs"))


#: A run of windows: its first, how much further its anchor is, and how many windows it has.
RUN = np.dtype([("first", "<i4"), ("ahead", "<u2"), ("n", "<u2")])


def runs_of(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), RUN)


def _runs(c: dict[str, np.ndarray], keep: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(keep)
    if not len(at):
        return
    at = at[np.lexsort((c["first"][at], c["v"][at], c["k"][at]))]
    k, v = c["k"][at], c["v"][at]
    runs = np.empty(len(at), RUN)
    runs["first"], runs["ahead"], runs["n"] = c["first"][at], c["place"][at] - c["first"][at], c["n"][at]
    starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])]))
    raw, size = runs.tobytes(), RUN.itemsize
    ends = [*starts[1:], len(at)]
    yield pa.RecordBatch.from_arrays([pa.array(k[starts], pa.int64()), pa.array(v[starts], pa.int32()), pa.array([raw[s * size : e * size] for s, e in zip(starts, ends, strict=True)], pa.binary())], names=["k", "v", "runs"])


def _pairs(rows: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    buckets, packed = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "packed"])
