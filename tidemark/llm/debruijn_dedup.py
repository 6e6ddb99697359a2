r"""Removal of repeated word spans by compaction of a de Bruijn graph.

Words are ``[^\x20\x09-\x0D]+``. Every run of ``WINDOW`` words is an edge of the graph, from its
first ``WINDOW`` - 1 words to its last. A word is removed where an edge covers it that also starts
in a document with a smaller id. All is judged on the input.

1. Edges that can't be repeated are settled by anchors (see ``anchors``): the least-hashed
   ``GRAM``-word gram of a window.
2. Places of the remaining edges are written as rows: the edge's 80-bit name, document, place, and
   16-bit hashes of the words before and after. A name's 64 and 16 bits come of independent hashes of
   the words, so that two words whose hashes fall together are still told apart. Grouping gives each repeated edge's source, the smallest
   document with it, and whether the same word always follows and precedes it.
3. Edges that stand side by side in their source, the one always followed and the other always
   preceded by the same word, are one nonbranching path: a join links them, and a path is named by
   the source coordinate where it starts.
4. Places of edges join their paths. In a document those of one path at one distance from their
   source coordinates are one span, and must be as many as the span is long. Spans that aren't
   (hashes of neighbours may agree by chance) are taken edge by edge.

Null texts have no words. Documents under ``WINDOW`` words are never cut. Rows of one id and text
are one document, and each gets its row; rows of one id with different texts are documents of
their own, neither smaller than the other. A null id sorts last. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.anchors import keyed, repeated_anchors, runs_of, sliding_anchors
from tidemark.llm.common import NULL_ID, Scratch, Words, as_bytes, batches_of, shingle_hashes, table

WINDOW, GRAM = 13, 5
#: Words of the longest stretch of a text that is looked at at once.
STRETCH = 1 << 22


def word_anchors(window: int, gram: int, stretch: int = STRETCH):
    """For ``repeated_anchors``: the runs of windows of ``window`` words by their ``gram``-word anchor."""

    def find(texts: list[bytes]) -> Iterator[tuple]:
        words = Words(pa.array(texts, pa.binary()))
        for i, h in enumerate(words.by_text(words.hashes())):
            for offset in range(0, max(1, len(h) - window + 1), stretch):
                part = h[offset : offset + stretch + window - 1]
                if len(part) < window:
                    continue
                grams = shingle_hashes(part, gram)
                first, n, place = sliding_anchors(grams, window - gram + 1)
                yield i, grams[place], (first + offset).astype(np.int32), (place + offset).astype(np.int32), n.astype(np.int16)

    return find


EDGES = "e long, c short, k long, at long, x int"


def edge_places(with_runs: DataFrame, window: int) -> DataFrame:
    """Rows (e, c, k, at, x): an edge's hash and second hash, document, v and place, and hashes of the words after and before."""
    kinds = [pa.int64(), pa.int16(), pa.int64(), pa.int64(), pa.int32()]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = []
        held = 0
        for b in batches_of(batches):
            words = Words(b.column(2))
            for k, v, h, other, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), words.by_text(words.hashes()), words.by_text(words.hashes(1)), b.column(3).to_pylist(), strict=True):
                runs = runs_of(raw)
                n = runs["n"].astype(np.int64)
                places = np.unique(np.repeat(runs["first"] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()))
                side = np.concatenate([[np.uint64(0)], h, [np.uint64(0)]])
                x = ((side[places + window + 1] >> np.uint64(48) << np.uint64(16)) | (side[places] >> np.uint64(48))).astype(np.uint32)
                c = shingle_hashes(other, window)[places] >> np.uint64(48)
                out.append([shingle_hashes(h, window)[places].view(np.int64), c.astype(np.uint16).view(np.int16), np.full(len(places), k), places + (v << 40), x.view(np.int32)])
                held += len(places)
            if held > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), t) for a, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["e", "c", "k", "at", "x"])
                out, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), t) for a, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["e", "c", "k", "at", "x"])

    return with_runs.select("k", "v", "text", "runs").mapInArrow(apply, EDGES)


def paths(edges: DataFrame) -> DataFrame:
    """Repeated edges (e, c) with their source coordinate (sk, sat) and the place where their nonbranching path starts (path)."""
    high = lambda c: F.shiftright(c, 16)
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFF))
    return (
        edges.groupBy("e", "c")
        .agg(F.min("k").alias("sk"), F.min_by("at", "k").alias("sat"), F.max("k").alias("last"), F.bit_and("x").alias("xa"), F.bit_or("x").alias("xo"))
        .where("last > sk")
        .select("e", "c", "sk", "sat", (high("xa") == high("xo")).alias("one_after"), (low("xa") == low("xo")).alias("one_before"))
    )


def compact(repeated: DataFrame) -> DataFrame:
    """Links edges to the one before them in their source where neither branches, and names paths by their start."""
    before = repeated.where("one_after").select("sk", (F.col("sat") + 1).alias("sat"), F.lit(True).alias("linked")).distinct()
    joined = repeated.join(before, ["sk", "sat"], "left")
    head = ~(F.coalesce("linked", F.lit(False)) & F.col("one_before"))
    along = Window.partitionBy("sk").orderBy("sat").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("path", F.max(F.when(head, F.col("sat"))).over(along)).select("e", "c", "sk", "sat", "path")


def repeated_spans(rows: DataFrame, runs: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    """Rows (k, v, start, end): word spans that edges of smaller documents cover."""
    edges = scratch.settle(edge_places(rows.join(runs, ["k", "v"]), window), "edges")
    repeated = scratch.settle(paths(edges), "repeated")
    named = scratch.settle(compact(repeated), "paths")
    places = edges.select("e", "c", "k", "at").join(named, ["e", "c"]).where("k > sk")
    by = ["k", F.shiftright("at", 40).cast("int").alias("v"), "sk", "path", (F.col("at") - F.col("sat")).alias("apart")]
    spans = scratch.settle(places.groupBy(*by).agg(F.min("at").alias("a"), F.max("at").alias("z"), F.count("*").alias("n")), "spans")
    scratch.drop("repeated")
    mask = F.lit((1 << 40) - 1)
    span = lambda a, z: [F.col("k"), F.col("v"), F.col(a).bitwiseAND(mask).cast("int").alias("start"), (F.col(z).bitwiseAND(mask) + window).cast("int").alias("end")]
    sure = F.col("n") == F.col("z") - F.col("a") + 1
    out = spans.where(sure).select(*span("a", "z"))
    odd = spans.where(~sure)
    if odd.isEmpty():
        return out
    single = places.select(*by, "at").join(odd.select("k", "v", "sk", "path", "apart"), ["k", "v", "sk", "path", "apart"], "left_semi")
    return out.unionByName(single.select(*span("at", "at")))


def plan(docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with k, v and text; spans by document; the first document of each text: sha, k, v)."""
    rows = keyed(docs)
    first = scratch.settle(rows.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min(F.struct("k", "v")).alias("m"), F.count("*").alias("copies"), F.countDistinct("k", "v").alias("keys")).select("sha", "m.k", "m.v", "copies", "keys"), "texts")
    runs = scratch.settle(repeated_anchors(rows, word_anchors(window, gram)).join(first.select("k", "v"), ["k", "v"], "left_semi"), "runs")
    once = rows if first.where("copies > keys").isEmpty() else rows.dropDuplicates(["k", "v"])
    spans = repeated_spans(once, runs, scratch, window)
    return rows, scratch.settle(spans.groupBy("k", "v").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "cuts"), first


def covered(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    at = np.array(spans, np.int64).reshape(-1, 2)
    np.add.at(edge, at[:, 0], 1)
    np.add.at(edge, at[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def digests(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    rows, spans, first = plan(docs, scratch, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            removed, digest = [], []
            for text, own in zip(as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True):
                words = text.split()
                gone = covered(len(words), [(s["start"], s["end"]) for s in own])
                removed.append(int(gone.sum()))
                digest.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(digest)], names=["k", "v", "removed", "kept"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            words = [t.split() for t in as_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(3), pa.array(map(len, words), pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words])], names=["k", "v", "sha", "n", "all"]
            )

    changed = rows.join(spans, ["k", "v"]).select("k", "v", "text", "spans").mapInArrow(cut, "k long, v int, removed long, kept string").dropDuplicates(["k", "v"])
    every = rows.select("k", "v", "text", F.sha2("text", 256).alias("sha")).mapInArrow(whole, "k long, v int, sha string, n long, all string")
    copy = (F.col("k") > F.col("rk")) & (F.col("n") >= window)
    return (
        every.join(first.select("sha", F.col("k").alias("rk")), "sha")
        .join(changed, ["k", "v"], "left")
        .select(
            F.when(F.col("k") != NULL_ID, F.col("k")).alias("doc_id"),
            F.col("n").alias("n_words"),
            F.when(copy, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "all")).alias("kept_sha256"),
        )
    )


def op6_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), Scratch(spark, "op6"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, len(w) AS n, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, s, md5_number(array_to_string(w[s : s + 12], ' ')) AS x FROM p),
r AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY x) AS m FROM g),
gone AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(s, s + 13))))) AS i FROM r WHERE m < doc_id GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(gone.i), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone.i IS NULL THEN array_to_string(d.w, ' ')
              ELSE array_to_string(list_filter(d.w, lambda x, j: NOT list_contains(gone.i, j)), ' ') END) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
"""
