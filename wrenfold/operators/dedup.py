"""Exact duplicates by keyed fingerprints, blocks, and pairs of similar names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import fingerprint
from ..functions.similarity import alike, soundex
from ..functions.vocab import NAME_MAX, PAIR_BLOCK
from ..sources.staging import task_count

OVERFLOW, UNKNOWN = "_overflow", "_UNKNOWN"


def duplicate_groups(df: DataFrame, fp: str = "email_fp", id_col: str = "id", order: str = "_row_idx") -> DataFrame:
    """DUP5, AGG8: (fp, ids in order) of fingerprints that several records have."""
    found = df.where(F.col(fp).isNotNull()).groupBy(fp).agg(F.array_sort(F.collect_list(F.struct(order, id_col))).alias("g")).where(F.size("g") > 1)
    return found.select(fp, F.transform("g", lambda x: x[id_col]).alias("ids"))


def keep_first(df: DataFrame, key: Column, order: str = "_row_idx", name: str = "is_duplicate") -> DataFrame:
    """WIN1: flags all but the first record of each key; null keys are no duplicates. Firsts are aggregated and joined back."""
    keyed = df.withColumn("_key", key)
    first = keyed.where("_key IS NOT NULL").groupBy("_key").agg(F.min(order).alias("_first"))
    # rows without a key match nothing; a key of their own deals them out, where null would send all to one task
    keyed = keyed.withColumn("_key", F.coalesce("_key", F.concat(F.lit("\u0000"), F.col(order).cast("string"))))
    return keyed.join(first, "_key", "left").withColumn(name, F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).drop("_key", "_first")


def flag_duplicates(df: DataFrame, key: bytes, order: str = "_row_idx") -> DataFrame:
    """DUP6: is_duplicate, _hmac_fingerprint, _meta_deduped; rows are kept."""
    fp = F.when(F.col("email") != "", fingerprint(F.col("email"), key))
    return keep_first(df.withColumn("_hmac_fingerprint", fp), F.col("_hmac_fingerprint"), order).withColumn("_meta_deduped", F.lit(True))


def duplicate_ids(df: DataFrame, fp: str = "email_fp", id_col: str = "id", order: str = "_row_idx") -> DataFrame:
    """Ids of all but the first of each group. No group is collected: the firsts are aggregated and joined back."""
    return keep_first(df.where(F.col(fp).isNotNull()).select(id_col, fp, order), F.col(fp), order).where("is_duplicate").select(id_col).distinct()


def without_ids(df: DataFrame, gone: DataFrame, id_col: str = "id") -> DataFrame:
    """JON3."""
    return df.join(gone, id_col, "left_anti")


def blocks(df: DataFrame, name: str = "name", order: str = "_row_idx", size: int = PAIR_BLOCK) -> DataFrame:
    """DUP11, WIN4: block: the name's Soundex, or _UNKNOWN; past `size` records of one, _overflow.

    Which records are the first of a key is found with a limit that works before the shuffle, so a key that most
    records share is no hot task: the few thousand firsts are joined back.
    """
    keyed = df.withColumn("_key", F.coalesce(soundex(F.col(name)), F.lit(UNKNOWN)))
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(order))
    last = keyed.select("_key", order).withColumn("_rn", rank).where(F.col("_rn") <= size).groupBy("_key").agg(F.max(order).alias("_last"))
    return keyed.join(last, "_key").withColumn("block", F.when(F.col(order) <= F.col("_last"), F.col("_key")).otherwise(OVERFLOW)).drop("_key", "_last")


#: Records of a block that meet as many others in one cell, and records whose cells are one group.
PART, CELLS = 512, 1 << 12


def similar_pairs(df: DataFrame, block: str = "block", id_col: str = "id", name: str = "name", order: str = "_row_idx", size: int | None = PAIR_BLOCK) -> DataFrame:
    """JON5: (id_a, id_b, score) of pairs within a block, in order, with similar names.

    A block over `size` is an error; None: blocks of any size. A block's records are dealt into parts of about PART, and
    each two parts meet in a cell of their own, so no task holds a large block. A cell's different names are compared
    once each, and only those that share letters enough; all records that have them make the pairs.
    """
    parts = F.ceil(F.col("_n") / PART).cast("int")
    counts = df.groupBy(block).agg(F.count("*").alias("_n"))
    most, total = counts.agg(F.max("_n"), F.sum(F.col("_n") * parts)).first()
    if size is not None and (most or 0) > size:
        raise ValueError(f"block size {most} exceeds cap {size}")
    counts = counts.select(F.col(block).alias("_b"), parts.alias("_parts"))
    fine = df.where(F.col(order).isNotNull() & F.length(name).between(1, NAME_MAX))  # other names are like none
    rows = fine.join(counts, F.col(block) == F.col("_b")).withColumn("_part", F.pmod(F.xxhash64(order), F.col("_parts")).cast("int"))
    # a record goes to the cells of its part with every part; the pair of parts names the cell
    others = F.sequence(F.lit(0), F.col("_parts") - 1)
    celled = rows.select(F.col("_b").alias("k"), F.col(order).alias("o"), F.col(id_col).alias("id"), F.lower(name).alias("n"), F.col("_part").alias("p"), F.explode(others).alias("q"))
    celled = celled.withColumns({"x": F.least("p", "q"), "y": F.greatest("p", "q")})
    # cells are small or many, so about CELLS records' cells are worked on together
    group = F.pmod(F.xxhash64("k", "x", "y"), F.lit(-(-(total or 1) // CELLS)))
    celled = celled.select(group.alias("g"), F.struct("k", "x", "y").alias("c"), "o", "id", "n", (F.col("x") == F.col("y")).alias("same"), (F.col("p") == F.col("x")).alias("first"))
    kind = df.schema[id_col].dataType.simpleString()
    tasks = task_count(df.sparkSession, total or 1)
    return celled.withColumn("c", F.xxhash64("c")).repartition(tasks, "g").groupBy("g").applyInArrow(_cell_pairs, f"id_a {kind}, id_b {kind}, score double")


def _cell_pairs(cells: pa.Table) -> pa.Table:
    """The pairs of some cells. In a cell each two different names are compared once, however many records have them."""
    cells = cells.combine_chunks()
    at = pc.rank(cells["o"], tiebreaker="dense").to_numpy()
    names = pc.dictionary_encode(cells["n"].combine_chunks())
    n = len(names.dictionary)
    cell = pc.dictionary_encode(cells["c"].combine_chunks()).indices.to_numpy().astype(np.int64)
    same, first = (cells[c].to_numpy() for c in ("same", "first"))
    key = cell * n + names.indices.to_numpy()  # a name in a cell

    def entries(some: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows by key, the different keys, where each begins, and its number of rows."""
        rows = np.flatnonzero(some)
        rows = rows[np.argsort(key[rows], kind="stable")]
        return rows, *np.unique(key[rows], return_index=True, return_counts=True)

    left, kl, bl, nl = entries(first)
    right, kr, br, nr = entries(same | ~first)
    ends = np.searchsorted(kr, (kl // n + 1) * n)
    alone = same[left[bl]]  # in a cell of one part a name meets itself and those after it, else all of the other part
    begins = np.searchsorted(kr, np.where(alone, kl, kl // n * n))
    out = []
    for u, v, score in alike(names.dictionary.to_pylist(), kl % n, kr % n, begins, ends - begins):
        times = nl[u] * nr[v]
        # all records of one name with all of the other: the place within the product gives both
        pair = np.repeat(np.arange(len(u)), times)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
        i, j = left[bl[u][pair] + place // nr[v][pair]], right[br[v][pair] + place % nr[v][pair]]
        # records of one name in a cell of one part come both ways round
        once = np.where((alone[u] & (kl[u] == kr[v]))[pair], at[i] < at[j], at[i] != at[j])
        i, j, pair = i[once], j[once], pair[once]
        swap = at[i] > at[j]
        out.append((np.where(swap, j, i), np.where(swap, i, j), score[pair]))
    a, b, score = (np.concatenate(x) for x in zip((np.empty(0, int), np.empty(0, int), np.empty(0)), *out, strict=True))
    ids = cells["id"].combine_chunks()
    return pa.table({"id_a": ids.take(pa.array(a)), "id_b": ids.take(pa.array(b)), "score": pa.array(score)})
