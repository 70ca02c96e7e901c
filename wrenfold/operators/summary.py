"""Field types, value counts and charts of a table, and its HTML report."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType
from pyspark.sql.window import Window

FIELDS, LABELS, PIE = 4, 10, 5


def field_kinds(df: DataFrame, by_first: str | None = None) -> tuple[list[str], list[str]]:
    """AGG3: numeric and other fields, by type; with by_first (the order), a number that is null in the first record is another."""
    number = {f.name for f in df.schema.fields if isinstance(f.dataType, (NumericType, BooleanType))}
    if by_first:
        head = df.orderBy(by_first).first()
        number = {c for c in number if head is not None and head[c] is not None}
    return [c for c in df.columns if c in number], [c for c in df.columns if c not in number]


def value_counts(df: DataFrame, fields: list[str], order: str) -> DataFrame:
    """AGG1: (field, value, n, first) of all fields in one pass; null counts as None."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("None")).alias("value")) for f in fields))
    return df.select(order, F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"), F.min(order).alias("first"))


def charts(df: DataFrame, fields: list[str], order: str) -> DataFrame:
    """AGG2: (field, chart_type, labels, data): pie for up to five values, else bar; the first ten values seen."""
    counts = value_counts(df, fields, order)
    kinds = counts.groupBy("field").agg(F.count("*").alias("values"))
    first = counts.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy("first", "value"))).where(F.col("r") <= LABELS)
    lists = first.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("r", "value", "n"))).alias("x"))
    shown = lists.join(kinds, "field")
    return shown.select("field", F.when(F.col("values") <= PIE, "pie").otherwise("bar").alias("chart_type"), F.transform("x", lambda v: v["value"]).alias("labels"), F.transform("x", lambda v: v["n"]).alias("data"))


def analyze(df: DataFrame, order: str, strict: bool = False) -> dict:
    """AGG3 with the charts of the first four fields that aren't numeric; at most 40 values come to the driver."""
    body = df.drop(order)
    total = df.count()
    if not total:
        return {"total_records": 0, "numeric_fields": [], "categorical_fields": [], "charts": []}
    numeric, other = field_kinds(df, order) if strict else field_kinds(body)
    other, numeric = [c for c in other if c != order], [c for c in numeric if c != order]
    found = {r["field"]: r.asDict() for r in charts(df, other[:FIELDS], order).collect()} if other else {}
    return {"total_records": total, "numeric_fields": numeric, "categorical_fields": other, "charts": [found[f] for f in other[:FIELDS] if f in found]}


def dashboard(analysis: dict, brand: str = "Report", logo_url: str = "", color: str = "#4f46e5", theme: str = "dark") -> str:
    """SNK5: a page of its own; every value is escaped."""
    e = html.escape
    back, fore = ("#0f172a", "#e2e8f0") if theme == "dark" else ("#ffffff", "#0f172a")
    data = json.dumps(analysis["charts"]).replace("<", "\\u003c")
    boxes = "".join(f'<section><h2>{e(c["field"])}</h2><canvas id="c{i}"></canvas></section>' for i, c in enumerate(analysis["charts"]))
    logo = f'<img src="{e(logo_url)}" alt="">' if logo_url else ""
    return (
        f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{e(brand)}</title><script src="https://cdn.jsdelivr.net/npm/chart.js"></script>'
        f"<style>body{{background:{back};color:{fore};font-family:sans-serif}}h1{{color:{e(color)}}}section{{width:45%;display:inline-block}}</style></head>"
        f"<body>{logo}<h1>{e(brand)}</h1><p>{analysis['total_records']} records, {len(analysis['numeric_fields'])} numeric and {len(analysis['categorical_fields'])} other fields</p>{boxes}"
        f"<script>const charts={data};charts.forEach((c,i)=>new Chart(document.getElementById('c'+i),{{type:c.chart_type,data:{{labels:c.labels,datasets:[{{data:c.data}}]}}}}));</script></body></html>"
    )


def report(df: DataFrame, order: str, brand: str = "Report", logo_url: str = "", color: str = "#4f46e5", currency_symbol: str = "$", theme: str = "dark") -> dict:
    """SUP4."""
    found = analyze(df, order)
    return {"analysis_summary": found, "white_label": {"brand_name": brand, "logo_url": logo_url, "primary_color": color, "currency_symbol": currency_symbol}, "html": dashboard(found, brand, logo_url, color, theme)}
