r"""Near-duplicates by MinHash bands, sequential Bayesian verification and exact comparison.

Words are ``[^\x20\x09-\x0D]+`` after A-Z is lower-cased; a document's set has its distinct
``k``-word shingles, or with fewer words the whole sequence. Documents whose sets' intersection is
at least ``threshold`` of the union are linked; components of links are groups, and the smallest id
of a group is kept.

1. Documents with equal sets are one from here on. Signatures are cut into bands, as many as keep
   the chance that a pair at the threshold shares none under ``MISS``.
2. In each bucket of a band everything is compared with the smallest id alone: no bucket makes
   more pairs than it has rows. Signatures are compared in batches; after each, a pair goes whose
   posterior chance of reaching the threshold (uniform prior) is under ``MISS``. Survivors are
   verified on their whole sets.
3. Components of these links tell which buckets still hold several. There the rows outside the
   largest component are compared with all others of other components, in blocks, by the same
   test and then by sets of short hashes, and survivors are verified. So a link is lost only if it goes between documents that the
   other links join anyway.

Null texts and texts without words have empty sets and are linked with nothing. Rows of one id are
one document: it has the links of all its rows, and each row is returned. A null id sorts last. An
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_ID, Scratch, Words, among, batches_of, lowered, mix, partitions, shingle_hashes, table
from tidemark.llm.components import components

SHINGLE, PERCENT, ROWS, MISS, STEP = 4, 80, 4, 1e-6, 32
#: Rows of a bucket in one block. Low bits of a bucket's key, which number its band.
BLOCK, BAND_MASK = 1024, 255
SIGN = np.uint16


def bands(percent: int = PERCENT, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def posterior_floor(tried: int, percent: int, miss: float) -> int:
    """The fewest matches of ``tried`` hashes at which the similarity reaches the threshold with a chance of ``miss`` or more.

    With a uniform prior the posterior is Beta(m + 1, tried - m + 1), and its tail above s is the
    chance that of tried + 1 draws of chance s at most m succeed.
    """
    s, tail = percent / 100, 0.0
    for m in range(tried + 1):
        tail += math.comb(tried + 1, m) * s**m * (1 - s) ** (tried + 1 - m)
        if tail >= miss:
            return m
    return tried


class Sequential:
    """Compares signatures batch by batch and drops pairs below the posterior's floor."""

    def __init__(self, hashes: int, percent: int, miss: float, step: int = STEP):
        ends = [*range(step, hashes, step), hashes]
        self.tests = [(a, b, posterior_floor(b, percent, miss)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def alive(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Indices of the rows of a and b (signatures) that survive."""
        at = np.arange(len(a))
        matches = np.zeros(len(a), np.int32)
        for start, end, floor in self.tests:
            matches = matches + (a[at, start:end] == b[at, start:end]).sum(1, dtype=np.int32)
            ok = matches >= floor
            at, matches = at[ok], matches[ok]
            if not len(at):
                break
        return at


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, from its words' hashes."""
    if not len(h):
        return np.empty(0, np.uint64)
    if len(h) < k:
        return mix(shingle_hashes(h, len(h)) + np.uint64(len(h)))
    x = np.sort(shingle_hashes(h, k))
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sets of a column of texts."""
    words = Words(texts, lowered)
    return [shingle_set(h, k) for h in words.by_text(words.hashes())]


class Signer:
    """Minima of a set under several hashes, each cut to 16 bits: two may agree by chance once in 65,536, which loses no pair."""

    def __init__(self, hashes: int):
        rng = np.random.Generator(np.random.PCG64(20240229))
        self.a = rng.integers(0, 1 << 31, hashes, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, hashes, dtype=np.uint32)[:, None]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = None
        for at in range(0, len(x), 512):
            y = self.a * x[None, at : at + 512]
            y += self.b
            low = y.min(axis=1)
            out = low if out is None else np.minimum(out, low)
        return (out * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(SIGN)


def signatures(rows: DataFrame, k: int, hashes: int) -> DataFrame:
    """(k, n, set_key, sig) per row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(hashes)
        for b in batches_of(batches):
            sets = shingle_sets(b.column(1), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, sets), pa.int64()), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array([sign(s).tobytes() if len(s) else b"" for s in sets], pa.binary())],
                names=["k", "n", "set_key", "sig"],
            )

    return rows.mapInArrow(apply, "k long, n long, set_key binary, sig binary")


def band_keys(sets: DataFrame, rows: int) -> DataFrame:
    """(key, id) per set and band. A key's low bits are the band's number."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 1 << 20):
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), SIGN).reshape(b.num_rows, -1).astype(np.uint64)
            count = sig.shape[1] // rows
            key = np.tile(np.arange(1, count + 1, dtype=np.uint64), (len(sig), 1))
            for i in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, i : count * rows : rows])
            key = key & ~np.uint64(BAND_MASK) | np.arange(count, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), count))], names=["key", "id"])

    return sets.select("id", "sig").mapInArrow(apply, "key long, id long")


def survivors(pairs: DataFrame, sets: DataFrame, test: Sequential, percent: int) -> DataFrame:
    """The pairs (a, b) that their sizes and sequential verification leave."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            na, nb = (batch.column(c).to_numpy() for c in (4, 5))
            fit = np.flatnonzero(np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent)
            sig = [np.frombuffer(b"".join(batch.column(c).to_pylist()), SIGN).reshape(batch.num_rows, -1)[fit] for c in (2, 3)]
            at = fit[test.alive(*sig)]
            if len(at):
                yield batch.select(["a", "b"]).take(pa.array(at))

    side = lambda c: sets.select(F.col("id").alias(c), F.col("sig").alias(f"s{c}"), F.col("n").alias(f"n{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(apply, "a long, b long")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def verified(pairs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v): the pairs whose whole sets are similar enough. Only texts of pairs are shuffled, each once for every pair that it is in."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            ok, own = [], b.column(2).dictionary_encode()  # a leader's text comes once for each of its pairs
            lead = shingle_sets(own.dictionary, k)
            for i, other in zip(own.indices.to_pylist(), shingle_sets(b.column(3), k), strict=True):
                mine = lead[i]
                both = len(np.intersect1d(mine, other, assume_unique=True))
                ok.append(100 * both >= percent * (len(mine) + len(other) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    own = among(rows, _ids(pairs), "k")
    side = lambda c, t: own.select(F.col("k").alias(c), F.col("text").alias(t))
    joined = pairs.join(side("b", "tb"), "b").join(side("a", "ta"), "a").select("a", "b", "ta", "tb")
    return joined.mapInArrow(apply, "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def short_sets(rows: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, short): the sets of ``ids``, their hashes cut to 32 bits."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            short = [np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in shingle_sets(b.column(1), k)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(short, pa.binary())], names=["id", "short"])

    return among(rows, ids, "k").select(F.col("k").alias("id"), "text").join(ids, "id", "left_semi").mapInArrow(apply, "id long, short binary")


def _outside(members: DataFrame, sets: DataFrame, shorts: DataFrame, test: Sequential, percent: int, rows: int) -> DataFrame:
    """Pairs (a, b) of a bucket's rows outside its largest component with its rows of other components, for exact verification.

    members: (key, id, comp, lone, blocks); lone marks rows outside. Those are dealt over the
    bucket's blocks, and every row meets every block once. A task holds one block and streams the
    rest. A pair is tested in the first bucket it shares alone, by its signatures and then by its
    sets of short hashes, which may err by a few that fall together: what is one in a hundred
    below the threshold still passes.
    """
    n = partitions(members.sparkSession)
    block = F.when(F.col("lone"), F.array(F.pmod(F.xxhash64("id"), F.col("blocks")))).otherwise(F.array())
    dealt = members.withColumn("mine", block).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("held", F.array_contains("mine", F.col("block"))).join(sets.select("id", "n", "sig"), "id").join(shorts, "id")
    ordered = dealt.select("key", "block", "held", "id", "n", "comp", "lone", "sig", "short").repartition(n, "key", "block").sortWithinPartitions("key", "block", F.desc("held"))

    def close(a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True)) + 1
        return 100 * both >= (percent - 1) * (len(a) + len(b) - both)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, stacked = None, [], None
        for b in batches_of(batches):
            out: list[tuple[int, int]] = []
            for key, blk, is_held, i, size, comp, lone, sig, short in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, blk) != at:
                    at, held, stacked = (key, blk), [], None
                sig, short = np.frombuffer(sig, SIGN), np.frombuffer(short, np.uint32)
                if held:
                    if stacked is None or len(stacked[0]) != len(held):
                        stacked = np.array([h[3] for h in held]), np.array([h[0] for h in held]), np.array([h[1] for h in held]), np.array([h[2] for h in held])
                    sigs, ids, sizes, comps = stacked
                    # Two rows outside meet once: where the smaller one is held.
                    ok = (comps != comp) & (np.minimum(sizes, size) * 100 >= np.maximum(sizes, size) * percent)
                    if lone and not is_held:
                        ok &= ids < i
                    which = np.flatnonzero(ok)
                    if len(which):
                        same = sigs[which] == sig
                        count = same.shape[1] // rows
                        first = same[:, : count * rows].reshape(-1, count, rows).all(2).argmax(1)
                        which = which[first == (key & BAND_MASK)]
                        which = which[test.alive(sigs[which], np.broadcast_to(sig, (len(which), len(sig))))]
                        out += [(int(ids[j]), i) for j in which if close(held[j][4], short)]
                if is_held:
                    held.append((i, size, comp, sig, short))
            if out:
                a, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c), pa.int64()), pa.array(np.maximum(a, c), pa.int64())], names=["a", "b"])

    return ordered.mapInArrow(apply, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", k: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """One row per document: the id, n_shingles, component_id, kept."""
    hashes = rows * bands(percent, rows, miss)
    test = Sequential(hashes, percent, miss)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = scratch.settle(signatures(texts, k, hashes), "signed")
    sets = scratch.settle(signed.where("n > 0").groupBy("set_key").agg(F.min("k").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "sets")
    slim = scratch.settle(signed.select("k", "n", "set_key"), "slim")
    scratch.drop("signed")

    keys = band_keys(sets, rows)
    leaders = keys.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("c")).where("c > 1").drop("c")
    shared = scratch.settle(keys.join(leaders, "key"), "shared")
    pairs = shared.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    stars = scratch.settle(survivors(pairs, sets, test, percent), "stars")
    links = verified(stars, texts, k, percent)
    links = scratch.settle(links.unionByName(of_one_id(slim, sets)).distinct(), "links")
    joined = components(links, scratch, "first")

    # Buckets whose rows are not of one component yet.
    placed = shared.select("key", "id").join(joined.select(F.col("u").alias("id"), "v"), "id", "left").select("key", "id", F.coalesce("v", "id").alias("comp"))
    mixed = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = mixed.groupBy("key").agg(F.max_by("comp", "c").alias("largest"), F.sum("c").alias("all"), F.max("c").alias("most"), F.count("*").alias("comps")).where("comps > 1")
    mixed = mixed.select("key", "largest", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("long").alias("blocks"))
    members = scratch.settle(placed.join(mixed, "key").withColumn("lone", F.col("comp") != F.col("largest")), "members")
    scratch.drop("shared")
    shorts = scratch.settle(short_sets(texts, members.select("id").distinct(), k), "shorts")
    more = scratch.settle(_outside(members, sets, shorts, test, percent, rows), "outside")
    scratch.drop("members", "shorts")
    if not more.isEmpty():
        tried = scratch.settle(more.join(stars, ["a", "b"], "left_anti"), "untried")
        late = verified(tried, texts, k, percent)
        joined = components(links.unionByName(late), scratch, "second")

    named = sets.select("set_key", F.col("id").alias("rep")).join(joined.select(F.col("u").alias("rep"), "v"), "rep", "left").select("set_key", F.coalesce("v", "rep").alias("comp"))
    named = scratch.settle(named, "named")
    scratch.drop("sets", "stars", "links", "outside", "untried")
    # Empty sets go around the join: they would all be one key.
    full = slim.where("n > 0").join(named, "set_key").select("k", "n", "comp")
    every = full.unionByName(slim.where("n = 0").select("k", "n", F.col("k").alias("comp")))
    unless_null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return every.select(unless_null("k").alias(id_col), F.col("n").alias("n_shingles"), unless_null("comp").alias("component_id"), (F.col("k") == F.col("comp")).alias("kept"))


def of_one_id(slim: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between the sets of rows that share an id, each set named by its smallest id."""
    rows = slim.where("n > 0").select("k", "set_key").join(sets.select("set_key", F.col("id").alias("rep")), "set_key").select("k", "rep")
    least = rows.groupBy("k").agg(F.min("rep").alias("v"), F.max("rep").alias("z")).where("v < z").drop("z")
    return rows.join(least, "k").where("rep <> v").select(F.col("rep").alias("u"), "v")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op1"))


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, md5_number(array_to_string(w[s : s + 3], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS s FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM c JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * common >= 80 * (p.n + q.n - common)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, e.v FROM reach JOIN e ON reach.b = e.u),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN m ON d.doc_id = m.doc_id
"""
