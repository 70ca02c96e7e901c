"""Exact top-k by inner product with a pivot-distance index.

One more component makes all vectors equally long, so that larger inner products are smaller distances. Each distinct
vector is keyed by its nearest pivot and its distance to it; in that order vectors are cut into slices (annuli around
a pivot) of a fixed size. A block of queries first meets the slices around its own place; the scores it finds bound how
far any better vector can be, and by the triangle inequality each query then opens only the annuli that reach into its
bound. Bounds are looked up in two levels: a table of groups of neighbouring slices goes to every task, and the slices
of the groups that are opened bring their own.

How much is opened depends on the data. Clustered vectors: a few per cent. Vectors that fill 64 dimensions evenly, as in
the test tables: all, since any two of them are about equally far apart; then this is a blocked comparison of all
queries with all vectors, whose cost grows with the product of both.

Equal vectors are merged before (of each, the ids that can be in a result are kept), so a vector that very many rows
share is one entry. Slices are joined with query blocks by group; nothing is compared by row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, Shared, table

K, QUERY_STEP, SCALE = 20, 20, 64
#: Pivots at most (about one for two slices), and distinct vectors they are chosen from.
PIVOTS, SAMPLE = 512, 8192
#: Vectors in a slice, queries in a block, and groups of slices about (their bounds, 28 bytes each, go to every task).
SLICE, BLOCK, GROUPS = 1024, 256, 1 << 15
#: Groups that a block meets first, and full slices (or blocks) for which a task is begun.
FIRST, FULL = 2, 4


def whole_numbers(vector: str) -> Column:
    """floor(64 x) of each component; null if the vector, or a component, is null or a component isn't finite."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)))


class Space:
    """The pivots, in the space with one more component."""

    def __init__(self, dims: int, longest: int):
        self.dims, self.longest = dims, longest
        self.pivots = np.zeros((1, dims + 1))
        #: How components are stored: no component is longer than its vector.
        self.kind = "<i2" if longest < 1 << 30 else "<f8"

    def fit(self, sample: np.ndarray, pivots: int) -> None:
        if not len(sample):
            return
        x = self.lifted(sample)
        at = [0]
        near = self._d2(x, x[:1])[:, 0]
        while len(at) < min(pivots, len(x)):  # farthest first, then means of what is nearest
            at.append(int(near.argmax()))
            near = np.minimum(near, self._d2(x, x[at[-1:]])[:, 0])
        p = x[at]
        for _ in range(6):
            own = self._d2(x, p).argmin(axis=1)
            p = np.stack([x[own == j].mean(axis=0) if (own == j).any() else p[j] for j in range(len(p))])
        self.pivots = p

    def packed(self, x: np.ndarray) -> bytes:
        return x.astype(self.kind).tobytes()

    def unpacked(self, data: pa.Scalar) -> np.ndarray:
        return np.frombuffer(data.as_buffer(), self.kind).reshape(-1, self.dims).astype(np.float64)

    @staticmethod
    def _d2(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        d = x @ (-2 * p.T)
        d += np.einsum("ij,ij->i", x, x)[:, None]
        d += np.einsum("ij,ij->i", p, p)[None, :]
        return np.maximum(0.0, d, out=d)

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.longest - (x * x).sum(axis=1)))
        return np.concatenate((x, more[:, None]), axis=1)

    def distances(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        return np.sqrt(self._d2(self.lifted(x, query), self.pivots))

    def reach(self, q: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How far from each query a vector of at least the bound's score can be."""
        return np.sqrt(np.maximum(0.0, (q * q).sum(axis=1) + self.longest - 2 * bound)) * (1 + 1e-9) + 1e-3

    def reaches(self, q: np.ndarray, bound: np.ndarray, pivot: int, lo: float, hi: float) -> np.ndarray:
        """Whether each query's bound reaches an annulus, by the triangle inequality."""
        own, reach = np.sqrt(self._d2(self.lifted(q, True), self.pivots[pivot : pivot + 1]))[:, 0], self.reach(q, bound)
        return (own - hi <= reach) & (lo - own <= reach)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Arrays of whole numbers as rows, short ones filled up with zeros."""
    offs = column.offsets.to_numpy(zero_copy_only=False)
    flat, n = column.values.to_numpy(zero_copy_only=False), np.diff(offs)
    if (n == dims).all():
        return flat[offs[0] : offs[-1]].reshape(-1, dims).astype(np.float64)
    out = np.zeros((len(n), dims))
    for i, (a, k) in enumerate(zip(offs[:-1], n, strict=True)):
        out[i, :k] = flat[a : a + k]
    return out


def _space(sample: DataFrame, dims: int, longest: int, pivots: int) -> Space:
    """The pivots of a sample (v), fitted in a task: what comes to the driver is the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_matrix(b.column(0), dims) for b in batches if b.num_rows]
        x, space = np.concatenate(parts) if parts else np.zeros((0, dims)), Space(dims, longest)
        space.fit(x[np.lexsort(x.T)], pivots)
        yield pa.RecordBatch.from_arrays([pa.array([space.pivots.tobytes()], pa.binary())], ["pivots"])

    space = Space(dims, longest)
    space.pivots = np.frombuffer(sample.select("v").coalesce(1).mapInArrow(run, "pivots binary").first().pivots).reshape(-1, dims + 1)
    return space


def _sliced(rows: DataFrame, n: int, shared, size: int, query: bool) -> DataFrame:
    """n rows (v: array<long>, ids: array<long>) in the order of pivot and distance, cut into slices of one pivot."""
    schema = "v array<long>, ids array<long>, pivot int, dist double"

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            if b.num_rows:
                d = s.distances(_matrix(b.column(0), s.dims), query)
                own = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(own)), own])], ["v", "ids", "pivot", "dist"])

    def emit(sid: int, part: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(part).combine_chunks()
        x, dist, ids = _matrix(t["v"].combine_chunks(), shared.value.dims), t["dist"].to_numpy(), t["ids"].combine_chunks()
        n = ids.value_lengths().to_numpy()
        return pa.RecordBatch.from_arrays(
            [pa.array([sid]), pa.array([t["pivot"][0].as_py()], pa.int32()), pa.array([float(dist.min())]), pa.array([float(dist.max())]), pa.array([len(x)], pa.int32()),
             pa.array([shared.value.packed(x)], pa.binary()), pa.array([ids.flatten().to_numpy().tolist()], pa.list_(pa.int64())), pa.array([n.tolist()], pa.list_(pa.int32()))],
            ["sid", "pivot", "lo", "hi", "n", "x", "ids", "counts"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part, have, pivot = TaskContext.get().partitionId() << 32, [], 0, None
        for b in batches:
            own, at = b.column(2).to_numpy(), 0
            while at < b.num_rows:
                if have and (own[at] != pivot or have >= size):
                    yield emit(number, part)
                    number, part, have = number + 1, [], 0
                pivot = own[at]
                other = np.flatnonzero(own[at:] != pivot)
                n = min(size - have, int(other[0]) if len(other) else b.num_rows - at)
                part.append(b.slice(at, n))
                have, at = have + n, at + n
        if have:
            yield emit(number, part)

    keyed = rows.select("v", "ids").mapInArrow(key, schema)
    # where a task ends, a slice ends: of few rows, many tasks would make many short slices, and pairs of them by the square
    parts = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // (FULL * size)))
    return keyed.repartitionByRange(parts, "pivot", "dist").sortWithinPartitions("pivot", "dist").mapInArrow(cut, "sid long, pivot int, lo double, hi double, n int, x binary, ids array<long>, counts array<int>")


def _probe(pairs: DataFrame, shared, k: int, compared: Accumulator | None) -> DataFrame:
    """(qid, score, id): for each pair of a query block and a slice, each query's k best, from its bound up.

    A query whose bound does not reach the slice is left out. compared: counts the vectors that queries meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            for r in range(b.num_rows):
                get = lambda name, r=r, b=b: b.column(b.schema.get_field_index(name))[r]
                q = s.unpacked(get("qx"))
                qid, bound = get("qids").values.to_numpy(), get("bound").values.to_numpy(zero_copy_only=False)
                open_ = np.flatnonzero(s.reaches(q, bound, get("pivot").as_py(), get("lo").as_py(), get("hi").as_py()))
                q, qid, bound = q[open_], qid[open_], bound[open_]
                if not len(q):
                    continue
                x = s.unpacked(get("x"))
                ids, counts = get("ids").values.to_numpy(), get("counts").values.to_numpy()
                begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
                exact = s.longest < 1 << 52
                scores = (q @ x.T).astype(np.int64) if exact else q.astype(np.int64) @ x.astype(np.int64).T
                if compared is not None:
                    compared.add(scores.size)
                cols: tuple[list, list, list] = ([], [], [])
                for i in range(len(q)):
                    row, reach = scores[i], bound[i]
                    if len(row) > k:
                        reach = max(reach, float(np.partition(row, len(row) - k)[len(row) - k]))
                    at = np.flatnonzero(row >= reach)
                    if len(at):
                        n = counts[at]
                        own = np.repeat(begin[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                        got, found = np.repeat(row[at], n), ids[own]
                        if len(got) > k:
                            best = np.lexsort((found, -got))[:k]
                            got, found = got[best], found[best]
                        cols[0].append(np.full(len(got), qid[i]))
                        cols[1].append(got)
                        cols[2].append(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in cols], ["qid", "score", "id"])

    return pairs.mapInArrow(run, "qid long, score long, id long")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return found.withColumn("r", rank).where(F.col("r") <= k)


def joined(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by shuffle. Spark takes a binary column for 100 bytes and a function's rows for as many as came in, so it would collect packed blocks in the driver to broadcast them."""
    return a.hint("merge").join(b, on, how)


def search(scratch: Scratch, vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", step: int = QUERY_STEP, compared: Accumulator | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by `step`, the k best of all other rows.

    Null ids and vectors that are null, or hold null or non-finite components, take no part. Repeated rows count once;
    a query's own id is no candidate. A shorter vector counts as filled up with zeros. Scores are exact while the
    longest vector's squared length is under 2^52, as whole numbers modulo 2^64 beyond.
    """
    spark, more = scratch.spark, k + 1
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), whole_numbers(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").distinct()
    rows = scratch.put(rows, "rows")
    # of equal vectors, the k+1 smallest ids are all that can be in results; the limit works before the shuffle, too
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= more)
    base = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asked = rows.where(F.col("id") % step == 0)
    base = scratch.put(base, "base")
    questions = scratch.put(asked.groupBy("v").agg(F.min("id").alias("first")).select("v", "first", F.xxhash64("v", "first").alias("qid")), "questions")
    n, dims, longest = base.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asking = questions.count()
    if not n or not asking:
        return none
    dims = max(1, dims)
    sample = base.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) <= (1 << 20) * SAMPLE // n).limit(2 * SAMPLE)
    # about two full slices a pivot: with more pivots slices would be parts, and pairs of them and blocks many
    pivots = max(1, min(PIVOTS, max(n // (2 * SLICE), min(16, math.isqrt(n)))))
    shared = Shared(spark, _space(sample, dims, int(longest), pivots))
    # neighbouring slices of a pivot make a group; a slice's number tells its place
    slices = _sliced(base, n, shared, SLICE, False)
    few = max(1, n // SLICE // GROUPS)
    slices = scratch.put(slices.withColumn("gid", F.xxhash64("pivot", F.shiftright("sid", 32), F.floor(F.col("sid").bitwiseAND((1 << 32) - 1) / few))), "slices")
    blocks = scratch.put(_sliced(questions.select("v", F.array("qid").alias("ids")), asking, shared, BLOCK, True), "blocks").select(F.col("x").alias("qx"), F.col("ids").alias("qids"))
    groups = slices.groupBy("gid").agg(F.first("pivot").alias("pivot"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    groups = groups.select("pivot", "lo", "hi", "gid").toArrow()
    bounds = np.empty(groups.num_rows, dtype="i4,f8,f8,i8")
    for name, column in zip(bounds.dtype.names, groups.columns, strict=True):
        bounds[name] = column.to_numpy()
    where = spark.sparkContext.broadcast(np.sort(bounds))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The groups nearest to the block's place."""
        s, w = shared.value, where.value
        for b in batches:
            for r in range(b.num_rows):
                q = s.unpacked(b.column(0)[r])
                d = np.median(s.distances(q, True), axis=0)
                gap = np.maximum(0, np.maximum(w["f1"] - d[w["f0"]], d[w["f0"]] - w["f2"])) + d[w["f0"]]
                gid = w["f3"][np.argsort(gap, kind="stable")[:FIRST]]
                m = len(gid)
                yield pa.RecordBatch.from_arrays([pa.array(gid), *(pa.concat_arrays([b.column(i).slice(r, 1)] * m) for i in (0, 1)), pa.array([[-np.inf] * len(q)] * m, pa.list_(pa.float64()))], ["gid", "qx", "qids", "bound"])

    pair = "gid long, qx binary, qids array<long>, bound array<double>"
    begun = scratch.put(blocks.mapInArrow(first, pair), "begun")
    near = scratch.put(_best(_probe(joined(begun, slices, "gid"), shared, more, compared), more), "near")
    # what a query has found so far bounds the rest: the score of the last of its k+1, if it has so many
    bound = near.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("s")).select("qid", F.when(F.col("n") >= more, F.col("s").cast("double")).otherwise(float("-inf")).alias("bound"))
    each = blocks.select(F.xxhash64("qids").alias("block"), F.posexplode("qids").alias("at", "qid"))
    bounds = joined(each, bound, "qid", "left").groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bound", F.lit(float("-inf"))).alias("b")))), lambda x: x["b"]).alias("bound"))
    seen = begun.groupBy(F.xxhash64("qids").alias("block")).agg(F.collect_set("gid").alias("seen"))
    bounded = joined(joined(blocks.withColumn("block", F.xxhash64("qids")), bounds, "block"), seen, "block").select("qx", "qids", "bound", "seen")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The groups not met yet, each with the queries whose bounds reach it."""
        s, w = shared.value, where.value
        for b in batches:
            for r in range(b.num_rows):
                q, qid = s.unpacked(b.column(0)[r]), b.column(1)[r].values.to_numpy()
                least = b.column(2)[r].values.to_numpy(zero_copy_only=False)
                d, reach = s.distances(q, True), s.reach(q, least)[:, None]
                for at in range(0, len(w), 4096):
                    part = w[at : at + 4096]
                    own = d[:, part["f0"]]
                    open_ = (own - part["f2"] <= reach) & (part["f1"] - own <= reach) & ~np.isin(part["f3"], b.column(3)[r].values.to_numpy())
                    for g in np.flatnonzero(open_.any(axis=0)).tolist():
                        some = np.flatnonzero(open_[:, g])
                        yield pa.RecordBatch.from_arrays([pa.array([part["f3"][g]]), pa.array([s.packed(q[some])], pa.binary()), pa.array([qid[some]], pa.list_(pa.int64())), pa.array([least[some]], pa.list_(pa.float64()))], ["gid", "qx", "qids", "bound"])

    more_pairs = bounded.mapInArrow(rest, pair)
    found = near.select("qid", "score", "id").unionByName(_probe(joined(more_pairs, slices, "gid"), shared, more, compared))
    best = _best(found, more).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "score", "id"))).alias("best"))
    mine = joined(joined(asked, questions.select("v", "qid"), "v").select(F.col("id").alias("query_id"), "qid"), best, "qid")
    top = mine.select("query_id", F.posexplode(F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("pos", "b"))
    return top.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return search(Scratch(spark, "op4"), table(spark, sf_dir, "embeddings"))


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
