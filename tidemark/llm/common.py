"""What several training-data operators share: table access, scratch tables, words and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id inside an operator; sorts after every real id.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(col, UPPER, LOWER)


class Scratch:
    """Written tables that cut lineage, under the shared folder of ``spark.checkpoint.dir``.

    A lost executor never costs such a table. Only where the session names no folder (as in
    local tests) is one made on this machine. ``drop`` frees a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        self.spark, self.root = spark, f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        bounded_batches(spark)

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back; the shuffle files behind it can then go."""
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        self.release()
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets Spark's cleaner remove shuffle files of finished plans now instead of at some later collection."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Frees tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def trim(spark: SparkSession) -> None:
    """Has executors give back heap that they hold without need: it grows to its limit in a step with large sorts, and a later step's Python workers need the room.

    A collection takes some 30 ms where little is in use. There are several for each core, so that none
    is likely to be left out; where one is, it only keeps its heap.
    """
    n = 4 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))).collect()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a Bloom filter at most; where it is too small, more rows pass than are wanted, and none is lost.
FILTER_BYTES = 16 << 20


def among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is one of ``ids`` (of one long column), and some others: a Bloom filter keeps most of these out of a later join's shuffle."""
    spark, name = rows.sparkSession, ids.columns[0]
    wanted = ids.select(F.col(name).cast("long").alias("x")).where("x IS NOT NULL")
    count = wanted.agg(F.approx_count_distinct("x")).first()[0]
    words = 1 << min(FILTER_BYTES.bit_length() - 4, max(6, (count // 5).bit_length()))
    bits = wanted.select(F.explode(F.array(*(F.pmod(F.xxhash64("x", F.lit(i)), F.lit(64 * words)) for i in range(3)))).alias("b"))
    held = bits.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toPandas()
    table_ = np.zeros(words, np.int64)
    table_[held.w.to_numpy(np.int64)] = held.v.to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(table_)
    at = [F.pmod(F.xxhash64(F.col(key).cast("long"), F.lit(i)), F.lit(64 * words)).alias(f"_b{i}") for i in range(3)]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = shared.value
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for i in (-3, -2, -1):
                x = b.column(b.num_columns + i).to_numpy()
                ok &= (table_[x >> 6] >> (x & 63)) & 1 == 1
            if ok.any():
                yield b.select(list(range(b.num_columns - 3))).filter(pa.array(ok))

    return rows.select("*", *at).mapInArrow(apply, rows.schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each value; null is empty."""
    binary = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [b"" if v is None else v for v in column.cast(binary).to_pylist()]


def batches_of(rows: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``most`` bytes: memory stays bounded where texts are long.

    After the last one the worker, which serves later tasks too, gives freed memory back.
    """
    for batch in rows:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; x is changed in place and returned."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_hashes(strings: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string: a random number for each byte at its place, added up."""
    data, offsets = flat(strings)
    size = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(((place << 8) + data).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x51_7CC1_B727_220A + 1)), out=total[1:])
    return mix((total[offsets[1:]] - total[offsets[:-1]]) * np.uint64(0xD6E8FEB86659FD93) + size.astype(np.uint64))


def words_hashes(words: list[bytes]) -> np.ndarray:
    return string_hashes(pa.array(words, pa.binary()))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, from the words' hashes; order within a run counts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[i : i + n]
        out ^= out >> np.uint64(29)
    return mix(out)


SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def white_at(data: np.ndarray) -> np.ndarray:
    """Which bytes are one of ``SPACE``."""
    return (data - np.uint8(0x09) < 5) | (data == 0x20)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bounds the Arrow batches that Python workers get by bytes: rows may hold very long texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not now or not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, str(most))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets from 0) of a string or binary column; null is empty."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, np.int64 if large else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(code of each string, the distinct strings); data[offsets[i] : offsets[i + 1]] is a string."""
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    binary = pa.binary() if kind is np.int32 else pa.large_binary()
    strings = pa.Array.from_buffers(binary, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, kind)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = strings.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def gathered(values: pa.Array, codes: np.ndarray, ends: np.ndarray) -> list[memoryview]:
    """The values of each text's codes, joined; ends[i] is where text i's codes end."""
    taken = values.take(pa.array(codes))
    data, offsets = flat(taken)
    cut = offsets[np.concatenate([[0], ends])].tolist()
    view = memoryview(data)
    return [view[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Words:
    """The words of a column of texts: codes of all words in order, the distinct words, and where each text's words end.

    prepare changes the texts' bytes, without changing their number; cut gives places before which words are cut besides.
    """

    def __init__(self, column: pa.Array, prepare: Callable[[np.ndarray], np.ndarray] | None = None, cut: Callable[[np.ndarray], np.ndarray] | None = None):
        data, offsets = flat(column)
        if prepare:
            data = prepare(data)
        white = white_at(data)
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        if cut:
            edge[cut(data)] = True
        before = np.ones(n + 1, bool)
        before[1:] = white
        starts = np.flatnonzero(~white & (before[:-1] | edge[:-1]))
        after = np.ones(n + 1, bool)
        after[:-1] = white
        stops = np.flatnonzero(~white & (after[1:] | edge[1:])) + 1
        self.ends = np.searchsorted(starts, offsets[1:], "left")
        #: Where each word starts in its column's bytes.
        self.starts, self.offsets = starts, offsets
        self.codes, self.distinct = distinct(data[~white], np.concatenate([[0], np.cumsum(stops - starts)]))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; those of different seeds are independent."""
        return string_hashes(self.distinct, seed)[self.codes]

    def by_text(self, values: np.ndarray) -> list[np.ndarray]:
        """One array per text of values that stand one to a word."""
        return np.split(values, self.ends[:-1]) if len(self.ends) else []
