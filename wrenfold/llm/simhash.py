"""SimHash near-duplicates by meet-in-the-middle ball hashing, and the 0.8 stage of the corpus pipeline.

A fingerprint sends itself to every value at most one bit away (65 values). Two fingerprints two or fewer bits apart
share such a value, and any two that share one are two or fewer bits apart. So within a value a chain of neighbours
links all of its fingerprints: at most 65 of them, since copies of a fingerprint are merged before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, Words, components, mix, pieces, table, text_buffer, whole_hash, window_hashes

SEED = 42
#: Shingle hashes whose bits are counted at a time.
_STEP = 1 << 15
_ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def majority(h: np.ndarray) -> int:
    """The 64-bit fingerprint of unsigned hashes: a bit is 1 if it is set in over half of them; none give zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _STEP):
        bits = np.unpackbits(h[at : at + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def shingle_hashes(text: bytes, n: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every n words (A-Z lower-cased, joined by a space); fewer words are one shingle, none give none."""
    words = text.translate(_ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(n, len(words))
    return np.array([digest(flat[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(id, fp: the fingerprint as a signed long) of every whole text; null and empty texts have zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            buf, offs = text_buffer(b.column(1))
            fps = [majority(shingle_hashes(buf[a:z].tobytes(), n)) for a, z in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], [id_col, "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"{id_col} long, fp long")


def _ball(prints: DataFrame) -> DataFrame:
    """(fp, v): each fingerprint with the values at most one bit away."""
    near = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.when(i < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    return prints.select("fp", F.explode(near).alias("v"))


def ball_pairs(prints: DataFrame) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints (column fp) two or fewer bits apart, a before b."""
    before = F.collect_list("fp").over(Window.partitionBy("v").orderBy("fp").rowsBetween(Window.unboundedPreceding, -1))
    return _ball(prints).select(F.col("fp").alias("b"), before.alias("before")).where(F.size("before") > 0).select(F.explode("before").alias("a"), "b").distinct()


def ball_links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) two or fewer bits apart, enough to reach all such pairs."""
    ball = _ball(prints)
    pairs = ball.select(F.col("fp").alias("b"), F.lag("fp").over(Window.partitionBy("v").orderBy("fp")).alias("a"))
    return pairs.where(F.col("a").isNotNull() & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b").distinct()


def clusters(scratch: Scratch, prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """prints (id, fp) with component_id: the smallest id that links reach. A null id never is one, if there is another."""
    lead = scratch.put(prints.groupBy("fp").agg(F.min(id_col).alias("lead")), "lead")
    links = scratch.put(ball_links(lead), "links")
    root = scratch.put(components(scratch, links), "roots")
    scratch.drop("links")
    named = root.join(lead, root.node == lead.fp).groupBy("root").agg(F.min("lead").alias("component_id"))
    known = root.join(named, "root").select(F.col("node").alias("fp"), "component_id")
    of = scratch.put(lead.join(known, "fp", "left").select("fp", F.coalesce("component_id", "lead").alias("component_id")), "of")
    return prints.join(of, "fp")


# --- near duplicates at a shingle similarity ---------------------------------------------------------------------------

#: Shingle length, similarity, bands and values in a band of the MinHash signature, hashes kept of a text, rounds in
#: which a bucket's members meet one of them before all pairs that are still in different groups meet.
N, SIMILARITY, BANDS, BAND, KEPT, ROUNDS = 5, 0.8, 20, 5, 1024, 5
#: Estimates of KEPT hashes between these are settled on all shingles; 0.8 is over six standard errors away from both.
DOUBT = (0.72, 0.88)
#: Members of a bucket that are compared with as many others at a time.
MEMBERS = 128
_FACTORS = mix(np.arange(1, BANDS * BAND + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sketch(h: np.ndarray) -> tuple[list[int], bytes]:
    """The band hashes and the KEPT smallest 32-bit hashes of distinct shingle hashes h; none give none."""
    if not len(h):
        return [], b""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 2048):
        np.minimum(least, (h[None, at : at + 2048] * _FACTORS[:, None]).min(axis=1), out=least)
    bands = window_hashes_rows(least.reshape(BANDS, BAND))
    return bands.view(np.int64).tolist(), np.unique((h >> np.uint64(32)).astype("<u4"))[:KEPT].tobytes()


def window_hashes_rows(rows: np.ndarray) -> np.ndarray:
    """One hash of each row; rows in different places differ."""
    return mix((rows * _FACTORS[: rows.shape[1]]).sum(axis=1, dtype=np.uint64) + np.arange(len(rows), dtype=np.uint64))


def similarity(a: bytes, b: bytes) -> float:
    """The Jaccard similarity of two texts' shingles by their sketches: exact for under KEPT shingles, else an estimate."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.concatenate((x, y))
    both.sort(kind="stable")  # two sorted runs: a merge
    twice = both[1:] == both[:-1]
    n = len(both) - int(twice.sum())
    if max(len(x), len(y)) >= KEPT and n > KEPT:  # the KEPT smallest of the union are a sample of it
        last = both[np.flatnonzero(np.concatenate(([True], ~twice)))[KEPT - 1]]
        return float((twice & (both[1:] <= last)).sum()) / KEPT
    return float(twice.sum()) / n


def sure(a: bytes, b: bytes) -> bool | None:
    """Whether two texts are similar enough, by their sketches; None if only all of their shingles can tell."""
    s = similarity(a, b)
    if max(len(a), len(b)) < 4 * KEPT:  # both sketches are whole
        return s >= SIMILARITY
    return None if DOUBT[0] < s < DOUBT[1] else s >= SIMILARITY


def shingles(words: np.ndarray) -> np.ndarray:
    """The distinct shingle hashes of a text's word hashes, sorted."""
    return np.unique(window_hashes(words, min(N, len(words)), N)) if len(words) else np.zeros(0, np.uint64)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k: hash of id and text, id, node: hash of the words, fp, bands, kept) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            words, rows = Words(b.column(2), lower=True), []
            for a, z in zip(words.first[:-1], words.first[1:], strict=True):
                w = words.hash[a:z]
                h = window_hashes(w, min(N, len(w)), N) if len(w) else np.zeros(0, np.uint64)
                rows.append((whole_hash(w), majority(h), *sketch(np.unique(h))))
            cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array(np.array([r[1] for r in rows], np.uint64).view(np.int64)), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["k", "id", "node", "fp", "bands", "kept"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.xxhash64(id_col, text).alias("k"), F.col(id_col).cast("long").alias("id"), text.alias("t"))
    return rows.mapInArrow(run, "k long, id long, node long, fp long, bands array<long>, kept binary")


def _verified(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """(a, b, sure): of edges (a, b) those whose texts are similar enough, and, not sure, those that sketches cannot tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [sure(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x is True for x in near], pa.bool_())], ["a", "b", "sure"])
            yield out.filter(pa.array([x is not False for x in near], pa.bool_()))

    both = edges.join(kept.select(F.col("node").alias("a"), F.col("kept").alias("x")), "a").join(kept.select(F.col("node").alias("b"), F.col("kept").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, sure boolean")


def _settled(scratch: Scratch, judged: DataFrame, texts: DataFrame, lead: DataFrame, name: str) -> DataFrame:
    """(a, b): the pairs of judged (a, b, sure) that are similar enough; those not sure are compared by all shingles.

    texts: (k, t) of all rows. Only those of unsure pairs are hashed again.
    """
    judged = scratch.put(judged, f"judged-{name}")
    known, doubt = judged.where("sure").select("a", "b"), judged.where("NOT sure").select("a", "b").distinct()
    if doubt.isEmpty():
        return known

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            words = Words(b.column(1), lower=True)
            full = [shingles(words.hash[a:z]).tobytes() for a, z in zip(words.first[:-1], words.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(full, pa.binary())], ["node", "full"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both / (len(x) + len(y) - both) >= SIMILARITY)
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    wanted = doubt.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(lead, "node").select("node", F.col("lead.k").alias("k"))
    full = scratch.put(texts.join(wanted, "k").select("node", "t").mapInArrow(hashed, "node long, full binary"), f"full-{name}")
    of = lambda end, col: full.select(F.col("node").alias(end), F.col("full").alias(col))
    found = doubt.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(compared, "a long, b long")
    out = scratch.put(known.unionByName(found), f"settled-{name}")
    scratch.drop(f"full-{name}", f"judged-{name}")
    return out


def _cell_links(here: int, x: int, y: int, block: np.ndarray, node: np.ndarray, root: np.ndarray, bands: np.ndarray, kept: list[bytes]) -> list[tuple[int, int, bool]]:
    """Links that join the groups of a cell: members of block x meet those of block y, but for pairs that are linked already.

    The third value is false for pairs that sketches cannot tell.

    A pair that shares several bands is compared in the smallest of their buckets alone.
    """
    sets = [np.frombuffer(k, "<u4") for k in kept]
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    flag, group, out = np.zeros(len(values), np.int64), root.copy(), []
    for i in np.flatnonzero(block == x).tolist():
        js = np.flatnonzero((block == y) & (group != group[i]))
        js = js[js > i] if x == y else js
        common = np.where(bands[js] == bands[i], bands[js], np.iinfo(np.int64).max).min(axis=1)
        js = js[(common == here) | (common == np.iinfo(np.int64).max)]  # in no band: a bucket of fingerprints
        if not len(js):
            continue
        own = ids[starts[i] : starts[i] + sizes[i]]
        flag[own] = 1
        both = np.add.reduceat(flag[ids], starts)[js]
        flag[own] = 0
        near = both / (sizes[i] + sizes[js] - both) >= SIMILARITY
        for k in np.flatnonzero(np.maximum(sizes[js], sizes[i]) >= KEPT).tolist():  # sketches of longer texts
            known = sure(kept[i], kept[js[k]])
            near[k] = bool(known)
            if known is None:
                out.append((int(node[i]), int(node[js[k]]), False))
        for j in js[near].tolist():
            if group[j] != group[i]:
                out.append((int(node[i]), int(node[j]), True))
                group[group == group[j]] = group[i]
    return out


def _rest(bucket: DataFrame, root: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, sure): links between the groups of each bucket, from all pairs of its members in different groups.

    Members are dealt into blocks of about MEMBERS, those of the bucket's largest group apart: these need not meet each
    other. Each two blocks that have to meet do so in a cell of their own, so no task holds a whole bucket.
    """
    of_group = bucket.join(root, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    sizes = of_group.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("groups"))
    blocks = lambda n: F.ceil(n / MEMBERS).cast("int")
    plan = sizes.where("groups > 1").select("bucket", F.col("most.root").alias("main"), blocks(F.col("most.n")).alias("many"), blocks(F.col("n") - F.col("most.n")).alias("few"))
    dealt = of_group.join(plan, "bucket").withColumn("block", F.when(F.col("root") == F.col("main"), F.col("few") + F.pmod(F.xxhash64("node"), F.col("many"))).otherwise(F.pmod(F.xxhash64("node"), F.col("few"))).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("few") + F.col("many") - 1), lambda k: F.struct(F.least(k, "block").alias("x"), F.greatest(k, "block").alias("y")))
    mains = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda k: F.struct(k.alias("x"), F.col("block").alias("y")))
    cells = dealt.join(nodes.select("node", "bands", "kept"), "node").withColumn("cell", F.explode(F.when(F.col("block") < F.col("few"), others).otherwise(mains)))
    cells = cells.groupBy("bucket", "cell").agg(F.collect_list(F.struct("block", "node", "root", "bands", "kept")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            members, out = b.column(3), []
            ends = members.offsets.to_pylist()
            for here, x, y, at, to in zip(*(b.column(c).to_pylist() for c in range(3)), ends[:-1], ends[1:], strict=True):
                block, node, root, bands, kept = (members.values.field(c).slice(at, to - at) for c in range(5))
                out += _cell_links(here, x, y, block.to_numpy(), node.to_numpy(), root.to_numpy(), np.array(bands.to_pylist(), np.int64), kept.to_pylist())
            cols = [pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b", "sure"])

    return cells.select("bucket", "cell.x", "cell.y", "members").mapInArrow(run, "a long, b long, sure boolean")


def _joined(scratch: Scratch, root: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """(node, root) after more links (a, b): only the groups that these join are worked on."""
    at = lambda end: root.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    both = found.join(at("a"), "a", "left").join(at("b"), "b", "left")
    ends = both.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).where("a != b")
    to = scratch.put(components(scratch, ends, f"cc-{name}"), f"to-{name}")
    new = to.select(F.col("node").alias("was"), F.col("root").alias("to"))
    # ends that had no link before are nodes of their own; the rest of `to` are roots
    old = root.join(new, root.root == new.was, "left").select("node", F.coalesce("to", "root").alias("root"))
    fresh = to.join(root.select("node"), "node", "left_anti")
    return scratch.put(old.unionByName(fresh), f"root-{name}")


def near_duplicates(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k): xxhash64 of id and text of the documents that stay: of each group of near duplicates the one of smallest id.

    Copies (the same words, A-Z lower-cased) are one group; texts whose sets of five-word shingles have a similarity of
    0.8 or more are linked. Candidates are the fingerprint links of ball hashing and, as two bits of 64 reach only
    similarities near 1, the buckets of a banded MinHash signature. First, in a few rounds, every member meets one
    member, chosen anew by a hash, of those buckets that still hold several groups, which joins most of a large family
    by few comparisons; a fingerprint, and each two of them within two bits, are buckets too. Then all pairs of a bucket that are still in different groups are compared.
    Null and empty texts are copies of each other.
    """
    every = scratch.put(sketches(docs, id_col, text_col), "sketches")
    lead = scratch.put(every.groupBy("node").agg(F.min(F.struct("id", "k")).alias("lead")), "lead")
    nodes = scratch.put(every.select("node", "fp", "bands", "kept").dropDuplicates(["node"]), "nodes")
    scratch.drop("sketches")
    kept = nodes.select("node", "kept")
    prints = scratch.put(nodes.groupBy("fp").agg(F.min("node").alias("one"), F.count("*").alias("n")), "prints")
    ends = scratch.put(ball_pairs(prints), "balls")
    of = lambda name: prints.select(F.col("fp").alias(name), F.col("one").alias(f"{name}_node"))
    balls = ends.join(of("a"), "a").join(of("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    same = nodes.join(prints, "fp").where("node != one").select(F.col("one").alias("a"), F.col("node").alias("b"))
    text = F.col(text_col).cast("string")
    texts = docs.select(F.xxhash64(id_col, text).alias("k"), text.alias("t")).where(F.length("t") >= KEPT)
    links = _settled(scratch, _verified(balls.unionByName(same), kept), texts, lead, "0")
    bucket = nodes.select("node", F.explode("bands").alias("bucket"))
    close = ends.select(F.xxhash64("a", "b").alias("bucket"), F.explode(F.array("a", "b")).alias("fp")).unionByName(prints.where("n > 1").select(F.xxhash64("fp").alias("bucket"), "fp"))
    bucket = bucket.unionByName(nodes.where(F.size("bands") > 0).select("node", "fp").join(close, "fp").select("node", "bucket"))
    crowded = bucket.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    bucket = scratch.put(bucket.join(crowded, "bucket"), "buckets")
    root = scratch.put(components(scratch, links, "cc-0"), "root-0")
    for turn in range(1, ROUNDS + 1):
        of_group = bucket.join(root, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
        pivot = of_group.groupBy("bucket").agg(F.min_by(F.struct("node", "root"), F.xxhash64("node", F.lit(turn))).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("bucket", "p")
        tried = of_group.join(pivot, "bucket").where("root != p.root").select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
        found = _settled(scratch, _verified(tried, kept), texts, lead, str(turn))
        if found.isEmpty():
            break
        root = _joined(scratch, root, found, str(turn))
    found = _settled(scratch, _rest(bucket, root, nodes), texts, lead, "rest")
    if not found.isEmpty():
        root = _joined(scratch, root, found, "rest")
    grouped = lead.join(root, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("lead").alias("lead"))
    return grouped.select(F.col("lead.k").alias("k"))


def deduplicated(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates; repeated rows stay once."""
    stay = scratch.put(near_duplicates(scratch, docs, id_col, text_col), "stay")
    keyed = docs.withColumn("_wrenfold_k", F.xxhash64(id_col, F.col(text_col).cast("string")))
    return keyed.join(stay.select(F.col("k").alias("_wrenfold_k")), "_wrenfold_k", "left_semi").dropDuplicates(["_wrenfold_k"]).drop("_wrenfold_k")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document."""
    scratch = Scratch(spark, "op10")
    prints = scratch.put(fingerprints(table(spark, sf_dir, "documents")), "prints")
    return clusters(scratch, prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
