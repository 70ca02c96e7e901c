"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed character n-grams (2 to 4 letters, word ends marked). Each language has
several centroids, found by spherical k-means over a bounded sample of labelled texts; the prediction is the language
of the nearest centroid by cosine. For rejection the similarity that random n-grams would have is taken off. Short texts
are less similar, so a text is rejected if the rest is under a part of the lowest that training texts up to its length
have; texts shorter than those known are not rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, pieces, plus, small_batches, table

#: Labelled texts the model is fitted on: about so many in all, and at least so many of each language.
SAMPLE, LEAST_SAMPLE = 2000, 20
DIMS = 1 << 12
CENTROIDS, ROUNDS = 3, 12
#: A text is rejected under this part of the lowest similarity of training texts; lengths (powers of 2 of n-grams) that
#: fewer training texts have reject nothing.
SLACK, LEAST_OF_LENGTH = 0.4, 10
UNKNOWN = "und"
_PIECE = 1 << 18


def held_out(id_col: str) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves no remainder by 5, or the id is null."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(True))


def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str, letter: np.ndarray) -> np.ndarray | None:
    """Counts of the text's hashed n-grams; None if it has no letter. Long texts are counted piece by piece."""
    out, any_letter = np.zeros(DIMS, np.int64), False
    for at in range(0, len(text), _PIECE):
        c = np.frombuffer(text[max(0, at - 3) : at + _PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        known = letter[c]
        if not known.any():
            continue
        any_letter = True
        c = np.where(known, c, 0).astype(np.uint64)
        c = np.concatenate(([0], c[(c > 0) | (np.concatenate(([1], c[:-1])) > 0)], [0])).astype(np.uint64)
        h = c.copy()
        for n in (2, 3, 4):
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
            inside = np.ones(len(h), bool)
            for j in range(1, n - 1):
                inside &= c[j : j + len(h)] > 0
            x = h[inside]
            out += np.bincount(((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(52)).astype(np.int64), minlength=DIMS)
    return out if any_letter else None


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts).astype(np.float32) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, cosine and whether it is rejected."""
        x = self.vectors(counts)
        sim = x @ self.centroids.T
        k = sim.argmax(axis=1)
        best, lang = sim[np.arange(len(k)), k], self.of[k]
        return lang, np.clip(best.astype(np.float64), 0.0, 1.0), self.above_chance(x, k, best) < SLACK * self.least[length(counts)]

    def above_chance(self, x: np.ndarray, k: np.ndarray, sim: np.ndarray) -> np.ndarray:
        """The similarity to centroid k beyond that of as many n-grams hashed at random."""
        return sim - self.centroids.mean(axis=1)[k] * x.sum(axis=1)


def length(counts: np.ndarray) -> np.ndarray:
    return np.minimum(31, np.log2(1 + counts.sum(axis=1)).astype(np.int64))


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; the first centroids are the mean's neighbour and then the farthest texts."""
    at = [int((x @ x.mean(axis=0)).argmax())]
    while len(at) < min(k, len(x)):
        at.append(int((x @ x[at].T).max(axis=1).argmin()))
    c = x[at]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fits on a sample of the labelled rows that are not held out; None if there are none."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang")).where(~held_out("id") & F.col("lang").isNotNull() & F.col("t").isNotNull())
    langs = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not langs:
        return None
    quota = max(LEAST_SAMPLE, SAMPLE // len(langs))
    share = F.create_map(*(F.lit(x) for lang, n in langs.items() for x in (lang, quota / n)))
    chance = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("lang")), F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letters()
        for b in batches:
            for lang, text in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True):
                if (x := grams(text, letter)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([x.astype("<i4").tobytes()])], ["lang", "x"])

    sample = sorted((r.lang, bytes(r.x)) for r in rows.where(chance < F.element_at(share, F.col("lang"))).select("t", "lang").mapInArrow(run, "lang string, x binary").collect())
    if not sample:
        return None
    counts = np.stack([np.frombuffer(x, "<i4") for _, x in sample]).astype(np.float32)
    names = sorted({lang for lang, _ in sample})
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    model = Model(names, idf, np.zeros((0, DIMS), np.float32), np.zeros(0, np.int64), np.zeros(32))
    x, y, cs = model.vectors(counts), np.array([names.index(lang) for lang, _ in sample]), []
    for k in range(len(names)):
        cs.append(_kmeans(x[y == k], CENTROIDS))
    model.of = np.repeat(np.arange(len(names)), [len(c) for c in cs])
    model.centroids = np.concatenate(cs).astype(np.float32)
    all_sim = x @ model.centroids.T
    near = all_sim.argmax(axis=1)
    own, sim = length(counts), model.above_chance(x, near, all_sim.max(axis=1))
    known = [sim[own == k].min() if (own == k).sum() >= LEAST_OF_LENGTH else 1.0 for k in range(32)]
    lowest = np.minimum.accumulate(known)
    model.least = np.where(lowest < 1.0, lowest, 0.0)
    return model


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (cosine, 0 to 1) and rejected.

    A text that is null or has no letter is of no language: `und`, 0, rejected. Without a model every text is.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    docs, at = docs.select(*names), names.index(text_col)
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, letter = shared.value, letters()
        for b in pieces(batches, at):
            texts, lang, score, out = b.column(at), [UNKNOWN] * b.num_rows, [0.0] * b.num_rows, [True] * b.num_rows
            for a in range(0, b.num_rows, 256):
                known = [(i, x) for i in range(a, min(a + 256, b.num_rows)) if m and texts[i].is_valid and (x := grams(texts[i].as_py(), letter)) is not None]
                if known:
                    for (i, _), k, s, r in zip(known, *m.nearest(np.stack([x for _, x in known])), strict=True):
                        lang[i], score[i], out[i] = m.langs[k], float(s), bool(r)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, plus(docs, lang_pred="string", score="double", rejected="boolean"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
