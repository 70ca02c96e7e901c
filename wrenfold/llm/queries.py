"""Queries over the corpus operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_text, langid, mixing, simhash, substring, topk, toxicity, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_html_text": html_text.op2_html_text,
    "op3_langid": langid.op3_langid,
    "op4_topk": topk.op4_topk,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_warc": warc.op7_warc,
    "op8_substring": substring.op8_substring,
    "op9_urlfilter": urlfilter.op9_urlfilter,
    "op10_simhash": simhash.op10_simhash,
}
SQL: dict[str, str] = {"op1_mixing": mixing.SQL, "op4_topk": topk.SQL, "op7_warc": warc.SQL, "op8_substring": substring.SQL, "op9_urlfilter": urlfilter.SQL}
