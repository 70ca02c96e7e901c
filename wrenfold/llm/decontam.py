"""Benchmark decontamination by spaced-seed hashing.

Fixed masks keep six of up to twelve words and ignore the rest, so a hit stands although words between were
substituted. Of 12 to 25 words every pattern of at most a fifth substituted leaves one of the masks whole, and a longer
run holds such a part (of its halves one has at least the same share).

Seeds of both sides are joined by hash. A bitmap of the benchmark's hashes, of bounded size, keeps those of the texts
that can't meet any from the shuffle. What meets is a text, an item and the places of a hash in both; equal texts are
one. Then each text that was hit meets its items: the places give diagonals, and on each the overlap is scored and
kept if at least 80 % of at least 13 words (or the whole item, if shorter) are equal.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, mask_hashes, pieces, table

MASKS = ((0, 1, 3, 6, 7, 10), (0, 2, 3, 4, 8, 9), (0, 1, 2, 5, 7, 8), (0, 3, 4, 5, 6, 11), (0, 6, 8, 9, 10, 11), (0, 1, 2, 4, 5, 9))
SPAN = 12
MIN_WORDS = 13
#: Tenths of the words that have to be equal.
TENTHS = 8
#: Items under so many words have no word to spare: they are found where all of their words stand in order.
LEAST_ITEM = 5
#: The bitmap's bits, as a power of two: 8 MB for any benchmark.
BITS = 26
#: Rows of seeds, and rows and item ids of the result, that are broadcast at most; more are joined by shuffle.
BROADCAST_SEEDS, BROADCAST_FOUND = 300_000, 1_000_000
#: Parts that the items of one text are dealt into.
PARTS = 64


def _plain(text: str) -> F.Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", " ")


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of an item of n < SPAN words: of two parts more than words may be substituted, all but as many."""
    spare = n * (10 - TENTHS) // 10
    parts = [p.tolist() for p in np.array_split(np.arange(n), spare + 2)] if spare else [list(range(n))]
    return [tuple(x for p in some for x in p) for some in itertools.combinations(parts, len(parts) - spare)]


def masks_for(short: list[int]) -> list[tuple[tuple[int, ...], int, int]]:
    """(mask, its hash's seed, words of the items it is for: 0 for all of SPAN or more)."""
    return [*((mask, m, 0) for m, mask in enumerate(MASKS)), *((mask, 100 + 10 * n + m, n) for n in short for m, mask in enumerate(short_masks(n)))]


def _grouped(own: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Places put together by owner and hash: owner, hash (signed) and places of each."""
    order = np.lexsort((at, h, own))
    own, h, at = own[order], h[order], at[order]
    begin = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (h[1:] != h[:-1])))) if len(own) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate((begin, [len(own)])), pa.int32()), pa.array(at, pa.int32()))
    return own[begin], h[begin].view(np.int64), lists


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (j, t) to (h, j, places)."""
    for b in pieces(batches, 1):
        words, hs, own, at = Words(b.column(1)), [], [], []
        for k, (a, z) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            w = words.hash[a:z]
            for mask, seed, n in masks_for([len(w)] if 0 < len(w) < SPAN else []):
                if len(w) == n or not n and len(w) >= SPAN:
                    h = mask_hashes(w, mask, seed)
                    hs.append(h := h[:1] if n else h)
                    own.append(np.full(len(h), k))
                    at.append(np.arange(len(h)))
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        k, h, places = _grouped(cat(own, np.int64), cat(hs, np.uint64), cat(at, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(h), b.column(0).take(pa.array(k)), places], ["h", "j", "places"])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (j, t, i) to (j, i, w: the hashes of the words)."""
    for b in pieces(batches, 1):
        words = Words(b.column(1))
        w = [words.hash[a:z].tobytes() for a, z in zip(words.first[:-1], words.first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(w, pa.binary())], ["j", "i", "w"])


def best_overlap(same: np.ndarray) -> int:
    """Words of the longest run with at least TENTHS equal words of ten whose last word is equal."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0
    # a run is good if this sum does not fall from its begin to its end
    total = np.concatenate(([0], np.cumsum(10 * same.astype(np.int64) - TENTHS)))
    low = np.minimum.accumulate(total[:-1])
    return int((at + 1 - np.searchsorted(-low, -total[at + 1], "left")).max())


def overlap(words: np.ndarray, item: np.ndarray, shifts: np.ndarray) -> int:
    """Words of the longest overlap on the diagonals `shifts`; 0 if none goes far enough."""
    best, least = 0, min(MIN_WORDS, len(item))
    for shift in shifts.tolist():
        a, z = max(0, -shift), min(len(item), len(words) - shift)
        same = item[a:z] == words[a + shift : z + shift]
        whole = len(same) == len(item) <= MIN_WORDS and 10 * same.sum() >= TENTHS * len(item)
        best = max(best, len(item) if whole else best_overlap(same))
        if best == len(item):
            break
    return best if best >= least else 0


def diagonals(n_words: int, n_item: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The distinct differences between places in the text and places in the item, by a bitmap as long as both."""
    seen = np.zeros(n_words + n_item, bool)
    for at, places in pairs:
        few, many = (places, at) if len(places) <= len(at) else (at, places)
        for x in few.tolist():
            seen[(many - x if few is places else x - many) + n_item] = True
    return np.flatnonzero(seen) - n_item


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, t, hits: [(i, w, pairs: [(ats, places)])]) to (k, i, n)."""
    for b in pieces(batches, 1):
        words, ks, ids, ns = Words(b.column(1)), [], [], []
        for r in range(b.num_rows):
            w = words.hash[words.first[r] : words.first[r + 1]]
            for hit in b.column(2)[r]:
                item = np.frombuffer(hit["w"].as_buffer(), np.uint64)
                pairs = [(p["ats"].values.to_numpy(), p["places"].values.to_numpy()) for p in hit["pairs"]]
                if n := overlap(w, item, diagonals(len(w), len(item), pairs)):
                    ks.append(b.column(0)[r].as_py())
                    ids.append(hit["i"].as_py())
                    ns.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(ids, pa.int64()), pa.array(ns, pa.int32())], ["k", "i", "n"])


def found_in(scratch: Scratch, texts: DataFrame, bench: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(k, items, overlap) of the texts (k: hash of the text, t) that overlap an item."""
    spark = texts.sparkSession
    items = bench.select(F.col(item_col).cast("long").alias("i"), _plain(item_text).alias("t")).where("i IS NOT NULL").distinct().select(F.xxhash64("i", "t").alias("j"), "t", "i")
    items = scratch.put(items, "items")
    seeds = scratch.put(items.select("j", "t").mapInArrow(_item_seeds, "h long, j long, places array<int>"), "seeds")
    sized = items.select(F.size(F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda x: x != "")).alias("n"))
    masks = masks_for(sorted(r.n for r in sized.where((F.col("n") > 0) & (F.col("n") < SPAN)).distinct().collect()))
    n_seeds, drop = seeds.count(), 64 - BITS
    if not n_seeds:
        return spark.createDataFrame([], "k long, items array<long>, overlap int")
    # which values of a hash's leading bits the benchmark has, as bitmaps of 4 KB
    spot = F.shiftrightunsigned("h", drop) + 1
    maps = seeds.groupBy(F.bitmap_bucket_number(spot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("m")).collect()
    there = np.zeros(1 << (BITS - 3), np.uint8)
    for r in maps:
        there[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.m, np.uint8)
    shared = spark.sparkContext.broadcast(there.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8)
        for b in pieces(batches, 1):
            words, hs, own, at = Words(b.column(1)), [], [], []
            for mask, seed, n in masks:
                h = mask_hashes(words.hash, mask, seed)
                x = h >> np.uint64(drop)
                places = np.flatnonzero(bitmap[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8) & 1)
                doc = np.searchsorted(words.first, places, "right") - 1
                inside = places + max(mask) < words.first[doc + 1]
                h, places, doc = h[places][inside], places[inside], doc[inside]
                if 0 < n < LEAST_ITEM:  # one place in a text is enough
                    once = np.unique(np.stack((doc.astype(np.uint64), h)), axis=1, return_index=True)[1] if len(h) else np.zeros(0, np.int64)
                    h, places, doc = h[once], places[once], doc[once]
                hs.append(h)
                own.append(doc)
                at.append(places - words.first[doc])
            k, h, ats = _grouped(np.concatenate(own), np.concatenate(hs), np.concatenate(at))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(k)), pa.array(h), ats], ["k", "h", "ats"])

    met = texts.select("k", _plain("t").alias("t")).mapInArrow(run, "k long, h long, ats array<int>")
    by_hash = F.broadcast(seeds) if n_seeds <= BROADCAST_SEEDS else seeds
    # equal texts have equal rows: one of them is enough, and is chosen before the shuffle, too
    hits = met.join(by_hash, "h").groupBy("k", "h", "j").agg(F.first("ats").alias("ats"), F.first("places").alias("places"))
    hits = scratch.put(hits.groupBy("k", "j").agg(F.collect_list(F.struct("ats", "places")).alias("pairs")), "hits")
    words = items.mapInArrow(_item_words, "j long, i long, w binary")
    hit = hits.join(words, "j").groupBy("k", F.pmod(F.xxhash64("j"), F.lit(PARTS)).alias("part")).agg(F.collect_list(F.struct("i", "w", "pairs")).alias("hits"))
    which = scratch.put(hits.select("k").distinct(), "which")
    n_texts = which.count()
    once = texts.join(F.broadcast(which) if n_texts <= BROADCAST_FOUND else which, "k", "left_semi").groupBy("k").agg(F.first("t").alias("t")).select("k", _plain("t").alias("t"))
    found = once.join(hit, "k").select("k", "t", "hits").mapInArrow(_verify, "k long, i long, n int")
    found = scratch.put(found.groupBy("k").agg(F.array_sort(F.collect_set("i")).alias("items"), F.max("n").alias("overlap")), "found")
    scratch.drop("items", "seeds", "hits", "which")
    return found


def overlaps(rows: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """rows with items array<long> (benchmark items that the text overlaps, in order) and overlap int (words, the most).

    Items of under 13 words have to be there as a whole: 80 % of their words, so all words of an item of one to four (a
    common word as an item marks every document that has it). Null and empty texts, and an empty benchmark, overlap
    nothing. An item id that is null is left out; items that share an id count as one. Rows are kept as often as they come.
    """
    names = [c for c in rows.columns if c not in ("items", "overlap", "_wrenfold_k")]
    text = F.col(text_col).cast("string")
    rows = rows.select(*names).withColumn("_wrenfold_k", F.when(text.isNotNull(), F.xxhash64(text)))
    texts = rows.where("_wrenfold_k IS NOT NULL").select(F.col("_wrenfold_k").alias("k"), text.alias("t"))
    found = found_in(Scratch(rows.sparkSession, "decontam"), texts, bench, item_col, item_text).withColumnRenamed("k", "_wrenfold_k")
    size = found.agg(F.count("*") + F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]
    out = rows.join(F.broadcast(found) if size <= BROADCAST_FOUND else found, "_wrenfold_k", "left")
    return out.select(*names, F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("overlap", F.lit(0)).alias("overlap"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, items, overlap for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", "overlap")
