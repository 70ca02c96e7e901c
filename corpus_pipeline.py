"""The corpus pipeline: STAGES over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenfold.llm import decontam, langid, mixing, simhash, substring
from wrenfold.llm.common import Scratch, table

#: Words of the repeated passages that are cut out.
PASSAGE = 50


def _aside(docs: DataFrame, names: set[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage's rows with the columns of docs; those that have a name the stage uses are renamed meanwhile."""
    away = {c: f"_aside_{k}" for k, c in enumerate(docs.columns) if c in names}
    out = stage(docs.withColumnsRenamed(away))
    return out.select(*(F.col(away.get(c, c)).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters, or far from every known language, go."""
    return _aside(docs, {"lang_pred", "score", "rejected"}, lambda d: langid.identify(d, langid.fit(d)).where(~F.col("rejected")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.deduplicated(Scratch(spark, "near"), docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one of smaller id has; those of which nothing is left go. n_chars follows the text."""

    def stage(d: DataFrame) -> DataFrame:
        out = substring.cut(d, substring.repeated(Scratch(spark, "passages"), d, PASSAGE), PASSAGE).where("n_removed = 0 OR n_removed < n_words")
        return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))

    return _aside(docs, {"n_words", "n_removed", "_hits", "_hit_id"}, stage)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return _aside(docs, {"items", "overlap", "_wrenfold_k"}, lambda d: decontam.overlaps(d, table(spark, sf_dir, "benchmark")).where(F.size("items") == 0))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is taken: epoch, and words taken then. One that its source's budget cuts is cut."""
    names = [c for c in docs.columns if c not in ("size", "epoch", "words", *mixing.ADDED)]
    rows = docs.select(*names).withColumn("size", mixing.n_words("text"))
    mixed = mixing.mix(Scratch(spark, "mixture"), rows).where("taken > 0")
    each = mixed.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    each = each.withColumn("words", F.least("size", F.col("taken") - (F.col("epoch") - 1) * F.col("size")).cast("long"))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0)), 1, F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < F.col("size"), part).otherwise(F.col("text"))
    return each.withColumn("text", text).select(*names, "size", "source_size", "target", "epoch", "words")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("benchmark", benchmark),
    ("mixture", mixture),
]

#: Language models, clusters and tolerant overlaps are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.put(docs, name)
    return docs
