"""What the corpus operators share: scratch tables in the cluster's shared folder, fast word hashing, components."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.staging import shared_dir

#: Set while a scratch table is written: the shuffle files of that job go when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of an Arrow batch, where the session sets none: texts are long, and the JVM and Python both hold a batch.
_BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH_BYTES[0], None) is None:
        spark.conf.set(*_BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plus(df: DataFrame, *names: str, **more: str) -> StructType:
    """The schema of df's columns `names` (all, if none are given) and more columns: name=type."""
    out = StructType([df.schema[n] for n in names or df.columns])
    for name, kind in more.items():
        out = out.add(name, kind)
    return out


class Shared:
    """An object broadcast with its class, so that workers need not find this package on their own path."""

    def __init__(self, spark: SparkSession, value: object):
        self._data, self._value = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    @property
    def value(self) -> object:
        if self._value is None:
            self._value = cloudpickle.loads(self._data.value)
        return self._value


class Scratch:
    """Tables of one run of an operator. A table cuts lineage, so a lost executor costs no more than its last step.

    Operators drop those that their result doesn't read. release() drops the rest, once the result is used.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    @contextlib.contextmanager
    def cleaning(self) -> Iterator[None]:
        conf, old = self.spark.conf, self.spark.conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            yield
        finally:
            conf.set(_CLEANUP, old) if old is not None else conf.unset(_CLEANUP)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        with self.cleaning():
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables of this run that nothing reads any more."""
        self._delete(*map(self.path, names))

    def release(self) -> None:
        self._delete(self.root)

    def _delete(self, *paths: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


# --- words and hashes, by numpy over the bytes of many texts at once -------------------------------------------------

#: A word is [^\x20\x09-\x0D]+.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes hashed at a time.
_BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each text begins (one offset more than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    offs = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches cut (without a copy) where a column's texts sum up to `most` bytes; a longer text is alone."""
    for b in batches:
        if not b.num_rows:
            continue
        _, offs = text_buffer(b.column(column)) if b.column(column).null_count == 0 else (None, np.cumsum([0, *(len(x.as_buffer()) if x.is_valid else 0 for x in b.column(column))]))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


class Words:
    """Words of a batch of texts: hash (uint64) of each, and the index of each text's first word."""

    _pow: np.ndarray | None = None
    _inv: np.ndarray | None = None

    def __init__(self, column: pa.Array, lower: bool = False, spans: bool = False):
        buf, offs = text_buffer(column)
        if Words._pow is None:
            Words._pow, Words._inv = powers(_BASE, 2 * _BLOCK), powers(pow(_BASE, -1, 1 << 64), 2 * _BLOCK)
        hashes, starts, ends, at = [], [], [], 0
        begun: tuple[int, int, int] | None = None  # the sum, bytes and begin of a word that goes on in the next block
        edge = np.zeros(len(buf) + 1, bool)
        edge[offs] = True
        while at < len(buf):
            to = min(at + _BLOCK, len(buf))
            while to < len(buf) and to - at < 2 * _BLOCK - 1 and not (_SPACE[buf[to]] or edge[to]):
                to += 1  # a block ends where a word ends, if that is not too far
            part = buf[at:to]
            solid = ~_SPACE[part]
            near = np.concatenate(([False], solid, [False]))
            s = np.flatnonzero(solid & (~near[:-2] | edge[at:to]))
            e = np.flatnonzero(solid & (~near[2:] | edge[at + 1 : to + 1])) + 1
            run = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(((_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)) * Words._pow[: len(part)], out=run[1:])
            total, size, s, e = (run[e] - run[s]) * Words._inv[s], (e - s).astype(np.uint64), s + at, e + at
            if begun:  # the first word of this block is its next part
                total[0] = (begun[0] + int(total[0]) * pow(_BASE, begun[1], 1 << 64)) & _M64
                size[0] += np.uint64(begun[1])
                s[0], begun = begun[2], None
            if to < len(buf) and not (_SPACE[buf[to - 1]] or _SPACE[buf[to]] or edge[to]):
                begun = (int(total[-1]), int(size[-1]), int(s[-1]))
                total, size, s, e = total[:-1], size[:-1], s[:-1], e[:-1]
            hashes.append(mix(total + size * np.uint64(0xD6E8FEB86659FD93)))
            starts.append(s)
            ends.append(e)
            at = to
        none = np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        begin = np.concatenate(starts) if starts else none
        self.first = np.searchsorted(begin, offs)
        if spans:
            self.buf, self.begin, self.end = buf, begin, np.concatenate(ends) if ends else none

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def window_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every n consecutive words."""
    base = (0xC2B2AE3D27D4EB4F + 2 * seed) & _M64
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h += words[j : j + m] * np.uint64(pow(base, j, 1 << 64))
    return mix(h ^ np.uint64(seed))


def whole_hash(words: np.ndarray, seed: int = 0) -> int:
    """A 64-bit hash, as a signed number, of all words in order."""
    h = (words * powers((0x8EBC6AF09C88C6E3 + 2 * seed) & _M64, len(words))[: len(words)]).sum(dtype=np.uint64)
    return int(mix(np.array([h + np.uint64(len(words))], np.uint64)).view(np.int64)[0])


def mask_hashes(words: np.ndarray, mask: tuple[int, ...], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the words at the mask's offsets, from every place where the mask fits."""
    base, m = (0xA0761D6478BD642F + 2 * seed) & _M64, len(words) - max(mask)
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for j, at in enumerate(mask):
        h += words[at : at + m] * np.uint64(pow(base, j, 1 << 64))
    return mix(h ^ np.uint64(seed + 1))


# --- connected components ---------------------------------------------------------------------------------------------


#: Edges that a task of a round works on, at least.
EDGES = 100_000


def components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for each end of the edges (a, b: long, a != b): root is the smallest node that can be reached.

    Large-star and small-star steps in turn, each round written to the shared folder; what comes to the driver is a
    count and a checksum. Minima are aggregated before any join, so a node with very many links is no hot task; the
    join that hands them back is a sort-merge join, which adaptive execution splits.
    """
    spark = scratch.spark
    now = scratch.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{name}-0")
    seen, turn = None, 0
    while True:
        n, check = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not n or (n, check) == seen:
            break
        seen, turn = (n, check), turn + 1
        tasks = -(-n // EDGES)  # few edges are few tasks' work, and few files
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = scratch.put(large.coalesce(tasks), f"{name}-{turn}-large")
        to = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(to, large.u == to.k).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(to.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u != v")
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        now = scratch.put(small.coalesce(tasks), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn}-large", f"{name}-{turn - 1}")
    root = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
