"""Removal of repeated byte strings by suffix sorting with bucket pointers.

Every byte is removed that a string of ``LENGTH`` bytes covers which also starts earlier: in a
document with a smaller id, or earlier in the same one. All is judged on the input.

1. Windows that can't be repeated are settled by anchors (see ``anchors``): the least-hashed
   ``GRAM``-byte gram of a window.
2. What remains is dealt by anchor as contexts, the bytes that a run of windows covers. Of equal
   contexts in a worker's batch only the first is sent; the others' windows start earlier there.
3. Where contexts of an anchor differ, their suffixes are sorted by bucket-pointer refinement:
   8-byte buckets are refined by sorting on the pointers of later offsets, and each refinement's
   pointers serve the next, until suffixes agree on ``LENGTH`` bytes. In a bucket the earliest
   window stays, all others are repeated.

A document whose whole text stands in a document with a smaller id is settled without that.

Null texts are empty. Texts under ``LENGTH`` bytes are never cut. Rows of one id and text are one
document, and each gets its row; rows of one id with different texts are documents of their own,
ordered by digest. A null id sorts last. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.anchors import Pack, buckets_of, by_bucket, keyed, repeated_anchors, runs_of, sliding_anchors
from tidemark.llm.common import NULL_ID, Scratch, as_bytes, batches_of, mix, partitions, table

LENGTH, GRAM = 100, 32
#: Bytes hashed at once, and the longest stretch of a text that is.
_CHUNK, STRETCH = 1 << 20, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int) -> np.ndarray:
    if base not in _POWERS:
        p = np.full(_CHUNK + STRETCH + 2 * LENGTH, base, np.uint64)
        p[0] = 1
        _POWERS[base] = np.multiply.accumulate(p)
    return _POWERS[base]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k bytes."""
    if len(data) < k:
        return np.empty(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE)[: len(data)], out=total[1:])
    return mix((total[k:] - total[:-k]) * _powers(_INVERSE)[: len(data) - k + 1])


def text_anchors(length: int, gram: int, stretch: int = STRETCH):
    """For ``repeated_anchors``: the runs of windows of ``length`` bytes by their ``gram``-byte anchor."""

    def of_chunk(pieces: list[tuple[int, int, bytes]]) -> Iterator[tuple]:
        h = gram_hashes(np.frombuffer(b"".join([p[2] for p in pieces]), np.uint8), gram)
        at = 0
        for i, offset, piece in pieces:
            own = h[at : at + len(piece) - gram + 1]
            first, n, place = sliding_anchors(own, length - gram + 1)
            if len(first):
                yield i, own[place], (first + offset).astype(np.int32), (place + offset).astype(np.int32), n.astype(np.int16)
            at += len(piece)

    def find(texts: list[bytes]) -> Iterator[tuple]:
        pieces, size = [], 0
        for i, t in enumerate(texts):
            for offset in range(0, max(1, len(t) - length + 1), stretch):
                piece = t[offset : offset + stretch + length - 1]
                if len(piece) < length:
                    continue
                pieces.append((i, offset, piece))
                size += len(piece)
                if size >= _CHUNK:
                    yield from of_chunk(pieces)
                    pieces, size = [], 0
        if pieces:
            yield from of_chunk(pieces)

    return find


def initial_buckets(data: np.ndarray) -> np.ndarray:
    """Pointers of the 8-byte buckets of all places: how many suffixes sort before the bucket."""
    n = len(data) - 7
    codes = np.zeros(n, np.uint64)
    for i in range(8):
        codes = codes << np.uint64(8) | data[i : i + n]
    order = np.argsort(codes)
    ordered = codes[order]
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ordered[1:] != ordered[:-1]]), np.arange(n), 0))
    pointer = np.empty(n, np.int64)
    pointer[order] = first
    return pointer


def refine(pointer: np.ndarray, places: np.ndarray, ahead: int) -> None:
    """Splits the buckets of ``places``, in place, by the pointers ``ahead`` further on. Buckets of one are done."""
    mine = pointer[places]
    size = np.bincount(mine, minlength=1)
    open_ = size[mine] > 1
    places, mine = places[open_], mine[open_]
    if not len(places):
        return
    later = pointer[places + ahead]
    order = np.lexsort((later, mine))
    a, b = mine[order], later[order]
    i = np.arange(len(order))
    new_bucket = np.concatenate([[True], a[1:] != a[:-1]])
    new_group = new_bucket | np.concatenate([[True], b[1:] != b[:-1]])
    pointer[places[order]] = a + np.maximum.accumulate(np.where(new_group, i, 0)) - np.maximum.accumulate(np.where(new_bucket, i, 0))


def window_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, pointers) of all windows of ``length`` bytes inside the stretches; equal windows have equal pointers, in order of their bytes."""

    def inside(depth: int) -> np.ndarray:
        n = np.maximum(ends - starts - depth + 1, 0)
        return np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())

    depth, pointer = 8, initial_buckets(data)
    while depth < length:
        ahead = min(depth, length - depth)
        places = inside(depth + ahead)
        refine(pointer, places, ahead)
        depth += ahead
    return places, pointer[places]


CONTEXTS = Pack(h="u8", k="i8", v="i4", first="i4", n="i4", size="i4")
SPANS = np.dtype([("k", "<i8"), ("v", "<i4"), ("start", "<i4"), ("end", "<i4")])


def _spans(k: np.ndarray, v: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans joined where they touch, by document."""
    order = np.lexsort((start, v, k))
    k, v, start, end = k[order], v[order], start[order], end[order]
    if not len(k):
        return np.empty(0, SPANS)
    other = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
    # The furthest end so far within a document: documents are set apart by a stride beyond all ends.
    stride = np.cumsum(other) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + stride) - stride
    fresh = other.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    out = np.empty(len(first), SPANS)
    out["k"], out["v"], out["start"] = k[first], v[first], start[first]
    out["end"] = reach[np.append(first[1:], len(k)) - 1]
    return out


def repeated_in(h: np.ndarray, k: np.ndarray, v: np.ndarray, first: np.ndarray, n: np.ndarray, contexts: list[bytes], length: int) -> np.ndarray:
    """Spans of the windows of contexts that stand earlier among them."""
    order = np.lexsort((first, v, k))  # earlier comes first from here on
    seen: dict[tuple, int] = {}
    whole, kept, of = [], [], {}
    for i in order.tolist():
        key = (int(h[i]), contexts[i])
        j = seen.setdefault(key, i)
        if j == i:
            kept.append(i)
            of[key[0]] = of.get(key[0], 0) + 1
        elif (k[i], v[i], first[i]) != (k[j], v[j], first[j]):
            whole.append(i)
    whole = np.array(whole, np.int64)
    out = [_spans(k[whole], v[whole], first[whole], first[whole] + n[whole] - 1 + length)]
    differ = [i for i in kept if of[int(h[i])] > 1]
    if differ:
        at = np.array(differ)
        sizes = np.array([len(contexts[i]) for i in differ])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        data = np.frombuffer(b"".join([contexts[i] for i in differ]) + bytes(length), np.uint8)
        places, pointers = window_buckets(data, starts, ends, length)
        # Contexts stand in order of (k, v, first), so the first place of a bucket is its earliest window.
        by = np.argsort(pointers, kind="stable")
        p = pointers[by]
        head = np.concatenate([[True], p[1:] != p[:-1]])
        lead = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
        owner = np.searchsorted(ends, places, side="right")
        begin = first[at][owner] + places - starts[owner]
        o, l = owner[by], owner[lead]
        late = (k[at][o] != k[at][l]) | (v[at][o] != v[at][l]) | (begin[by] != begin[lead])
        w, o = begin[by][late], at[o[late]]
        out.append(_spans(k[o], v[o], w, w + length))
    return np.concatenate(out)


def _span_rows(spans: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(spans):
        spans = _spans(spans["k"].copy(), spans["v"].copy(), spans["start"].copy(), spans["end"].copy())
        new = np.flatnonzero(np.concatenate([[True], (spans["k"][1:] != spans["k"][:-1]) | (spans["v"][1:] != spans["v"][:-1])]))
        pairs = np.stack([spans["start"], spans["end"]], 1).astype("<i4").tobytes()
        ends = [*new[1:], len(spans)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(spans["k"][new], pa.int64()), pa.array(spans["v"][new], pa.int32()), pa.array([pairs[8 * s : 8 * e] for s, e in zip(new, ends, strict=True)], pa.binary())], names=["k", "v", "spans"]
        )


def repeated_spans(docs: DataFrame, runs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Rows (k, v, spans): ``spans`` has little-endian 32-bit pairs (start, end) of repeated bytes. A document may have several rows."""
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)

    def flush(parts: list[tuple]) -> Iterator[tuple[int, bytes]]:
        c = {name: np.concatenate([p[0][name] for p in parts]) for name in parts[0][0]}
        contexts = [x for p in parts for x in p[1]]
        seen: dict[tuple, int] = {}
        first_of = [seen.setdefault((a, x), i) for i, (a, x) in enumerate(zip(c["h"].tolist(), contexts, strict=True))]
        # Of equal contexts the earliest is sent.
        order = np.lexsort((c["first"], c["v"], c["k"])).tolist()
        best: dict[int, int] = {}
        late = []
        for i in order:
            j = best.setdefault(first_of[i], i)
            if j != i and (c["k"][i], c["v"][i], c["first"][i]) != (c["k"][j], c["v"][j], c["first"][j]):
                late.append(i)
        late = np.array(late, np.int64)
        known = _spans(c["k"][late], c["v"][late], c["first"][late], c["first"][late] + c["n"][late] - 1 + length)
        for i in range(0, len(known), 4096):
            part = known[i : i + 4096]
            yield -1 - int((int(part["k"][0]) + i) % buckets), part.tobytes()
        sent = np.array(sorted(best.values()), np.int64)
        for b, at in by_bucket((c["h"][sent] % np.uint64(buckets)).astype(np.int64)):
            rows = sent[at]
            yield b, CONTEXTS.dump(c, rows) + b"".join([contexts[i] for i in rows.tolist()])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches_of(batches):
            for k, v, text, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True):
                r = runs_of(raw)
                first, size = r["first"], r["n"].astype(np.int32) - 1 + length
                place = (first + r["ahead"]).tolist()
                h = np.fromiter((xxhash.xxh3_64_intdigest(text[p : p + gram]) for p in place), np.uint64, len(r))
                parts.append(({"h": h, "k": np.full(len(r), k), "v": np.full(len(r), v), "first": first, "n": r["n"].astype(np.int32), "size": size}, [text[a : a + s] for a, s in zip(first.tolist(), size.tolist(), strict=True)]))
                held += int(size.sum())
            if held > 8 << 20:
                yield _rows(flush(parts))
                parts, held = [], 0
        if parts:
            yield _rows(flush(parts))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in buckets_of(batches_of(batches)):
            if bucket < 0:
                for row in rows:
                    yield from _span_rows(np.frombuffer(row, SPANS))
                continue
            parts = [CONTEXTS.load(row) for row in rows]
            c = {name: np.concatenate([p[0][name] for p in parts]) for name in parts[0][0]}
            contexts = []
            for own, raw in parts:
                at = 0
                for s in own["size"].tolist():
                    contexts.append(bytes(raw[at : at + s]))
                    at += s
            yield from _span_rows(repeated_in(c["h"], c["k"], c["v"], c["first"], c["n"], contexts, length))

    def _rows(rows: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
        bucket, packed = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "packed"])

    with_runs = docs.join(runs, ["k", "v"]).select("k", "v", "text", "runs")
    return with_runs.mapInArrow(send, "bucket int, packed binary").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "k long, v int, spans binary")


def cut(text: bytes, spans: list[bytes]) -> tuple[bytes, int]:
    """(what remains, number of maximal removed runs)."""
    pairs = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist()
    out, at, runs = [], 0, 0
    for start, end in pairs:
        if start > at or not runs:
            out.append(text[at:start])
            runs += 1
        at = max(at, end)
    out.append(text[at:])
    return b"".join(out), runs


def plan(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with k, v and text; spans by document; the first document of each text: sha, rep)."""
    rows = keyed(docs)
    first = scratch.settle(rows.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min(F.struct("k", "v")).alias("m"), F.count("*").alias("copies")).select("sha", "m.k", "m.v", "copies"), "texts")
    runs = repeated_anchors(rows, text_anchors(length, gram)).join(first.select("k", "v"), ["k", "v"], "left_semi")
    runs = scratch.settle(runs, "runs")
    spans = scratch.settle(repeated_spans(rows, runs, length, gram), "spans")
    joined = spans.groupBy("k", "v").agg(F.collect_list("spans").alias("spans"))
    return rows, joined, first


def digests(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, spans, first = plan(docs, scratch, length)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            got = [(len(t), *cut(t, s)) for t, s in zip(as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True)]
            columns = [pa.array([n - len(kept) for n, kept, _ in got], pa.int64()), pa.array([r for _, _, r in got], pa.int64()), pa.array([hashlib.sha256(kept).hexdigest() for _, kept, _ in got])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["k", "v", "removed", "runs", "kept"])

    changed = rows.join(spans, ["k", "v"]).select("k", "v", "text", "spans").mapInArrow(apply, "k long, v int, removed long, runs long, kept string").dropDuplicates(["k", "v"])
    # Rows whose text a smaller document has are settled by their digest.
    every = rows.select("k", "v", F.octet_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha"))
    owner = first.select("sha", F.col("k").alias("rk"), F.col("v").alias("rv"))
    copy = (F.col("k") > F.col("rk")) & (F.col("n") >= length)
    return (
        every.join(owner, "sha")
        .join(changed, ["k", "v"], "left")
        .select(
            F.when(F.col("k") != NULL_ID, F.col("k")).alias("doc_id"),
            F.col("n").alias("n_bytes"),
            F.when(copy, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
            F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        )
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), Scratch(spark, "op8"))


OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(CAST(n AS BIGINT) - 99)) AS s FROM d WHERE n >= 100),
g AS (SELECT w.doc_id, w.s, md5_number(substr(d.h, CAST(2 * w.s + 1 AS BIGINT), 200)) AS x FROM w JOIN d ON w.doc_id = d.doc_id),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM g),
dup AS (SELECT doc_id, s, s + 100 AS e FROM r WHERE k > 1),
edge AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM dup),
grp AS (SELECT doc_id, s, e, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS i FROM edge),
span AS (SELECT doc_id, i, min(s) AS s, max(e) AS e FROM grp GROUP BY doc_id, i),
gap AS (
  SELECT doc_id, e AS a, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS b FROM span
  UNION ALL SELECT doc_id, 0, min(s) FROM span GROUP BY doc_id
),
kept AS (SELECT gap.doc_id, string_agg(substr(d.h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (coalesce(b, d.n) - a) AS BIGINT)), '' ORDER BY a) AS h FROM gap JOIN d ON gap.doc_id = d.doc_id GROUP BY gap.doc_id),
tot AS (SELECT doc_id, sum(e - s) AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(t.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(t.spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN tot t ON d.doc_id = t.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
