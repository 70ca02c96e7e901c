"""Mixing sources to target weights, by DataFrame functions only.

Each row gets a hash-random key; the key's leading bits deal it to a cell of its source (a range of keys, so cells in
order are the source in key order). Sums by cell, a running sum over a source's cells and one inside each cell make
the distributed prefix sum; the source is cut at its exact budget, after as many whole epochs as fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 42
#: About so many rows lie in a cell.
CELL_ROWS = 4096
#: Columns that mix() adds.
ADDED = ("source_size", "target", "budget", "taken")


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """For (skey, source, source_size): target (double) and budget (long). All sources go through one task, a row each: fine for some millions."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("long")
    everything = Window.partitionBy(F.lit(1))
    s = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    s = s.withColumn("t", F.sum("source_size").over(everything)).withColumn("w", F.sum("weight").over(everything))
    # A source is filled to its limit if the water level of what is left, by weight, stands above it.
    level = Window.orderBy(F.col("most").cast("double") / F.col("weight"), F.col("source").isNull(), "source")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("c0", F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("w0", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("full", F.col("most") * (F.col("w") - F.col("w0")) <= F.col("weight") * (F.col("t") - F.col("c0")))
    s = s.withColumn("cf", F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(everything)).withColumn("wf", F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(everything))
    share = ((F.col("t") - F.col("cf")) * F.col("weight")).cast("double") / (F.col("w") - F.col("wf"))
    s = s.withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(share))
    return s.select("skey", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("budget"))


def mix(scratch: Scratch, rows: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", seed: int = SEED) -> DataFrame:
    """rows with source_size, target, budget and taken: the words that the mix takes of each row, repeats counted.

    A null source is a source; the keys of null ids come from their sizes; rows of size 0 take nothing; repeated
    rows are taken each on its own; no rows give no rows. Columns that have the added names are replaced.
    """
    rows = rows.drop(*ADDED, "_skey", "_hkey", "_cell", "_base", "_before")
    bits = min(30, max(0, math.ceil(math.log2(max(1, rows.count()) / CELL_ROWS))))
    rows = rows.withColumn("_skey", F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col))))
    rows = rows.withColumn("_hkey", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.col(size_col).cast("string"))))))
    rows = rows.withColumn("_cell", F.shiftright(F.conv(F.substring("_hkey", 1, 8), 16, 10).cast("long"), 32 - bits))
    cells = rows.groupBy("_skey", "_cell").agg(F.first(source_col).alias("source"), F.sum(size_col).alias("cell_size"))
    cells = scratch.put(cells.withColumnRenamed("_skey", "skey"), "cells")
    goal = targets(cells.groupBy("skey").agg(F.first("source").alias("source"), F.sum("cell_size").alias("source_size")))
    earlier = Window.partitionBy("skey").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select("skey", "_cell", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)).alias("_base")).join(goal, "skey")
    base = scratch.put(base.withColumnRenamed("skey", "_skey"), "base")
    scratch.drop("cells")
    inside = Window.partitionBy("_skey", "_cell").orderBy("_hkey", id_col, size_col).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(base, ["_skey", "_cell"]).withColumn("_before", F.col("_base") + F.coalesce(F.sum(size_col).over(inside), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    rest = F.col("budget") - whole * F.col("source_size")
    taken = whole * F.col(size_col) + F.least(F.col(size_col), F.greatest(F.lit(0), rest - F.col("_before")))
    return out.withColumn("taken", taken.cast("long")).drop("_skey", "_hkey", "_cell", "_base", "_before")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    scratch = Scratch(spark, "op1")
    sized = scratch.put(table(spark, sf_dir, "documents").select("doc_id", "source", n_words("text").alias("size")), "sized")
    return mix(scratch, sized).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, size, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || size)) AS hkey
      FROM (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CAST([5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS BIGINT) AS weight, 3 * source_size AS most FROM s),
p AS (SELECT *, sum(source_size) OVER () AS t, sum(weight) OVER () AS w,
        coalesce(sum(most) OVER l, 0) AS c0, coalesce(sum(weight) OVER l, 0) AS w0 FROM r
      WINDOW l AS (ORDER BY CAST(most AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, most * (w - w0) <= weight * (t - c0) AS filled FROM p),
g AS (SELECT *, sum(CASE WHEN filled THEN most ELSE 0 END) OVER () AS cf, sum(CASE WHEN filled THEN weight ELSE 0 END) OVER () AS wf FROM f),
goal AS (SELECT source, source_size, CASE WHEN filled THEN CAST(most AS DOUBLE) ELSE CAST((t - cf) * weight AS DOUBLE) / CAST(w - wf AS DOUBLE) END AS target FROM g),
o AS (SELECT d.doc_id, d.size, goal.source_size, goal.target, CAST(floor(goal.target + 0.5) AS BIGINT) AS budget,
        CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hkey, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM o)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + least(size, greatest(0, budget - whole * source_size - before)) AS BIGINT) AS taken FROM e
"""
