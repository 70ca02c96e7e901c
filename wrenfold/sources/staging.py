"""Tables between the steps of a long plan: they cut lineage and keep plans small."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's.

    Where neither is set, a local master gets a new local folder; on a cluster that is an error, since executors would
    write to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="wrenfold-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found := f"file://{made}")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again."""
    df.write.parquet(path := new_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows for which a task is begun, and the most of a task once there are several tasks a core.
TASK_ROWS, MOST_ROWS = 1 << 13, 1 << 18


def task_count(spark: SparkSession, n: int) -> int:
    """How many tasks n rows are work for."""
    return max(1, min(-(-n // TASK_ROWS), max(4 * spark.sparkContext.defaultParallelism, -(-n // MOST_ROWS))))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df's rows dealt by the columns' hash into as many tasks as their number asks for.

    A table of many short rows is a small file, which Spark reads in one task or a few, and what is computed from a row
    would run there. Rows are counted, not bytes; df is counted, so it should be a table just read, or staged.
    """
    tasks = task_count(df.sparkSession, df.count())
    return df.repartition(tasks, *by) if tasks > 1 else df


def numbered(df: DataFrame, *order: str, name: str = "_row_idx") -> DataFrame:
    """df with its rows' positions, from 0 without gaps, in the given order (ties by chance).

    Rows are dealt by range and written once, so that their parts stay what they are; parts are counted, and a part's
    rows are numbered from the sum of those before it. No task sees more than a part.
    """
    dealt = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.join(parts, "_part").withColumn(name, (F.col("_from") + place).cast("long")).drop("_part", "_from")
