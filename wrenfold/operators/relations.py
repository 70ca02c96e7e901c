"""How tables are put together: look-ups of results, rows side by side, flags, firsts and bests of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import numbered


def looked_up(df: DataFrame, results: DataFrame, key: str, order: str) -> DataFrame:
    """JON1: df with the results of its key; of several results the last in `order` wins (on ties
    the greatest values), a key without any gets nulls.

    Results are reduced to one a key before the join, so rows of df stay as many as they are.
    """
    rest = [c for c in results.columns if c not in (key, order)]
    last = results.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("_last"))
    return df.join(last, key, "left").select(*df.columns, *(F.col(f"_last.{c}").alias(c) for c in rest))


def zipped(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """JON2: the rows of two tables side by side, by their places in the orders; a table that ends first leaves nulls."""
    a, b = numbered(left, left_order, name="_place"), numbered(right, right_order, name="_place")
    return a.join(b, "_place", "full").drop("_place")


def flagged(df: DataFrame, ids: DataFrame, id_col: str = "id", name: str = "is_duplicate") -> DataFrame:
    """JON4: whether each row's id is among ids; a null id is not."""
    known = ids.select(id_col).where(F.col(id_col).isNotNull()).distinct().withColumn("_in", F.lit(True))
    return df.join(known, id_col, "left").withColumn(name, F.col("_in").isNotNull()).drop("_in")


def best(df: DataFrame, key: str, value: str, by: Column, order: str) -> DataFrame:
    """SRT2: of each key the value of greatest `by`; the first in `order` (a number) on ties."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(by, -F.col(order))).alias(value))


def least(df: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """SRT1: of each key the value of least `by`; the least value on ties."""
    return df.groupBy(key).agg(F.min_by(value, F.struct(by, value)).alias(value))


def first_values(df: DataFrame, fields: list[str], order: str, n: int = 10) -> DataFrame:
    """LIM1: (field, place, value as text): the first n non-null values of each field, in one pass.

    The limit works before the shuffle, so a field's task holds n rows of each part.
    """
    each = df.select(order, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x"))
    place = F.row_number().over(Window.partitionBy("field").orderBy(order))
    return each.select(order, "x.*").where("value IS NOT NULL").withColumn("place", place).where(F.col("place") <= n).select("field", "place", "value")


def stacked(*tables: DataFrame) -> DataFrame:
    """SET1: the rows of all tables, by column name; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def sorted_json(**fields: Column) -> Column:
    """SRT3: JSON with its keys in order; nulls stay."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields.items()))), {"ignoreNullFields": "false"})
