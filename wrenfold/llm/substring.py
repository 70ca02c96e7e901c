"""Substring deduplication by level-wise doubling.

Whether a window of n words repeats across documents is settled on a ladder of lengths (13: 7, 13; 50: 7, 13, 25, 50).
At the lowest, each window's smallest hash of 7 words stands for it (equal windows choose equal places), so about a
quarter of the places are shuffled. What repeats in another document is extended to twice the length; what does not
is gone. Only hashes and ids are shuffled to find repeats; texts meet, by id, the repeated hashes of their own
document. Minima are aggregated before the join that hands them back, which adaptive execution splits for hot hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, pieces, plus, table, window_hashes

N_WORDS = 13
_LOWEST = 8


def ladder(n: int) -> list[int]:
    """Lengths from the lowest (under 8, unless n is) to n, each at most twice the one before."""
    out = [n]
    while out[0] >= _LOWEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of w hashes, where its smallest is (the first, on ties)."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(h, w).argmin(axis=1) + np.arange(len(h) - w + 1)


def _texts(b: pa.RecordBatch, at: int) -> Iterator[np.ndarray]:
    words = Words(b.column(at))
    for a, z in zip(words.first[:-1], words.first[1:], strict=True):
        yield words.hash[a:z]


def _pairs(ids: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
    n = [len(x) for x in found]
    h = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(np.array(ids, np.int64), n))], ["h", "id"])


def seeds(rows: DataFrame, low: int, up: int) -> DataFrame:
    """(h, id): in each text the hashes of low words that stand for its windows of up words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            found = []
            for w in _texts(b, 1):
                h = window_hashes(w, low, low)
                found.append(np.unique(h[_least(h, up - low + 1)]))
            yield _pairs(b.column(0).to_pylist(), found)

    return rows.mapInArrow(run, "h long, id long")


def extended(rows: DataFrame, at: int, to: int, seeded: bool) -> DataFrame:
    """(h, id): windows of `to` words that the repeated windows of `at` words (column hits) leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            found, hits = [], b.column(2)
            for k, w in enumerate(_texts(b, 1)):
                h = window_hashes(w, at, at)
                known = np.isin(h, hits[k].values.to_numpy(zero_copy_only=False).view(np.uint64))
                fits = known[_least(h, to - at + 1)] if seeded else known[: max(0, len(h) - (to - at))] & known[to - at :]
                found.append(np.unique(window_hashes(w, to, to)[: len(fits)][fits]))
            yield _pairs(b.column(0).to_pylist(), found)

    return rows.mapInArrow(run, "h long, id long")


def _shared(pairs: DataFrame, last: bool) -> DataFrame:
    """(id, hits): hashes that other ids have too; on the last rung those that a smaller id has."""
    known = pairs.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h", "lo")
    both = pairs.join(known, "h")
    return (both.where("id > lo") if last else both).groupBy("id").agg(F.collect_list("h").alias("hits"))


def repeated(scratch: Scratch, docs: DataFrame, n: int = N_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hits): for each document the hashes of its windows of n words that a document with a smaller id has too."""
    rungs = ladder(n)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    if len(rungs) == 1:
        pairs = scratch.put(seeds(rows, n, n), f"pairs-{n}")
        return scratch.put(_shared(pairs, True), f"hits-{n}")
    pairs = scratch.put(seeds(rows, rungs[0], rungs[1]), f"pairs-{rungs[0]}")
    hits = scratch.put(_shared(pairs, False), f"hits-{rungs[0]}")
    scratch.drop(f"pairs-{rungs[0]}")
    for at, to in zip(rungs, rungs[1:], strict=False):
        pairs = scratch.put(extended(rows.join(hits, "id").select("id", "t", "hits"), at, to, at == rungs[0]), f"pairs-{to}")
        hits = scratch.put(_shared(pairs, to == n), f"hits-{to}")
        scratch.drop(f"pairs-{to}", f"hits-{at}")
    return hits


def cut(docs: DataFrame, hits: DataFrame, n: int = N_WORDS, id_col: str = "doc_id", text_col: str = "text", joined: bool = False) -> DataFrame:
    """docs with the words that a hit covers cut out of the text, and n_words and n_removed (long).

    joined: kept words are joined by one space; else the white space before a kept word stays as it was. Null texts
    stay null, with no words. A null id is in no repeat. Rows that share an id keep what no smaller id has.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, at):
            column, hit = b.column(at), b.column(len(names))
            words = Words(column, spans=True)
            kept: list[str | None] = []
            gone = np.zeros(len(column), np.int64)
            for k in range(len(column)):
                a, z = words.first[k], words.first[k + 1]
                if not column[k].is_valid:
                    kept.append(None)
                    continue
                keep = np.ones(z - a, bool)
                if hit[k].is_valid:
                    h = window_hashes(words.hash[a:z], n, n)
                    starts = np.flatnonzero(np.isin(h, hit[k].values.to_numpy(zero_copy_only=False).view(np.uint64)))
                    edge = np.zeros(z - a + 1, np.int64)
                    edge[starts] += 1
                    np.add.at(edge, starts + n, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    gone[k] = (z - a) - keep.sum()
                s, e = words.begin[a:z], words.end[a:z]
                if not joined and gone[k] == 0:
                    kept.append(column[k].as_py())
                elif joined:
                    text = words.buf[s[0] : e[-1]].tobytes() if z > a else b""
                    kept.append(b" ".join(w for w, x in zip(text.split(), keep.tolist(), strict=True) if x).decode() if gone[k] else b" ".join(text.split()).decode())
                else:
                    at_ = np.flatnonzero(keep)
                    before = np.where(at_ > 0, e[at_ - 1], s[0] if z > a else 0)
                    kept.append(b"".join(words.buf[x:y].tobytes() for x, y in zip(before, e[at_], strict=True)).decode().strip())
            out = [pa.array(kept, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(words.counts().astype(np.int64)), pa.array(gone)], [*names, "n_words", "n_removed"])

    hits = hits.select(F.col("id").alias("_hit_id"), F.col("hits").alias("_hits"))
    rows = docs.join(hits, docs[id_col] == hits["_hit_id"], "left").select(*[docs[c] for c in names], "_hits")
    return rows.mapInArrow(run, plus(docs, *names, n_words="long", n_removed="long"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = repeated(Scratch(spark, "op8"), docs)
    out = cut(docs, hits, joined=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS lo FROM win) WHERE doc_id > lo),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM hit, range(13) AS t(j)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
