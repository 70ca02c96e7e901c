"""Reading contact records, and the shapes they are exported in."""

from __future__ import annotations

import functools
import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import EXPORT_TARGETS, Tenant
from .staging import numbered

def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC1: a header and inferred types; a schema saves the pass that infers."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_excel(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC2: the first sheet of a spreadsheet (.xlsx), its first row as names; types are inferred unless a schema is given.

    A sheet has at most 2^20 rows, so the driver reads it; the file may lie in any store that Spark reads.
    """
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    names, *rows = sheet_rows(data) or [[]]
    rows = [tuple([*r, *[None] * (len(names) - len(r))][: len(names)]) for r in rows]
    if schema or rows:
        return spark.createDataFrame(rows, schema or [str(n) for n in names])
    return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))


_SHEET = {"s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_rows(data: bytes) -> list[list]:
    """The cells of an .xlsx file's first sheet: text, whole numbers, floats, booleans; None where there is none."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        texts = lambda e: "".join(t.text or "" for t in e.iterfind(".//s:t", _SHEET))
        shared = [texts(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("s:si", _SHEET)] if "xl/sharedStrings.xml" in z.namelist() else []
        first = min((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: (len(n), n))
        out = []
        for row in ElementTree.fromstring(z.read(first)).iterfind(".//s:row", _SHEET):
            cells: list = []
            for c in row.iterfind("s:c", _SHEET):
                at = functools.reduce(lambda n, ch: 26 * n + ord(ch) - 64, re.match(r"[A-Z]*", c.get("r", ""))[0], 0) or len(cells) + 1
                v, kind = c.findtext("s:v", None, _SHEET), c.get("t", "n")
                if kind == "inlineStr":
                    value = texts(c)
                elif v is None:
                    value = None
                else:
                    value = shared[int(v)] if kind == "s" else v == "1" if kind == "b" else v if kind in ("str", "e", "d") else int(v) if re.fullmatch(r"-?\d{1,18}", v) else float(v)
                cells += [None] * (at - 1 - len(cells)) + [value]
            out.append(cells)
        return out


def sheet_of(names: list[str], rows: list[tuple]) -> bytes:
    """An .xlsx file of one sheet."""

    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        return f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [tuple(names), *rows])
    kinds, rels = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    types = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{kinds}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{types}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{types}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{kinds}/relationships"><Relationship Id="rId1" Type="{rels}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_SHEET["s"]}" xmlns:r="{rels}"><sheets><sheet name="1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{kinds}/relationships"><Relationship Id="rId1" Type="{rels}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_SHEET["s"]}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, f'<?xml version="1.0" encoding="UTF-8"?>{text}')
    return out.getvalue()


def write_excel(df: DataFrame, path: str) -> None:
    """A spreadsheet of at most 2^20 - 1 rows; more are an error."""
    rows = [tuple(r) for r in df.limit(1 << 20).collect()]
    if len(rows) == 1 << 20:
        raise ValueError("a sheet has at most 2^20 rows")
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(sheet_of(df.columns, rows))
    out.close()


def from_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """SRC3: the rows of a request; keys that a row lacks are null."""
    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(schema)
    return spark.createDataFrame([tuple(r.get(n) for n in kinds.names) for r in rows], kinds)


def from_json(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """SRC3 for JSON text, a record a row."""
    return lines.select(F.from_json(column, schema).alias("r")).select("r.*")


def with_order(df: DataFrame, *order: str) -> DataFrame:
    """_row_idx, from 0, in the order of a declared key."""
    return numbered(df, *order)


def _or(df: DataFrame, a: str, b: str) -> Column:
    x, y = (F.col(c) if c in df.columns else F.lit(None).cast("string") for c in (a, b))
    return F.coalesce(F.nullif(x, F.lit("")), y)


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def hubspot(df: DataFrame, status: str = "Cleaned") -> DataFrame:
    """SNK2."""
    pairs = {"email": _field(df, "email"), "firstname": _field(df, "first_name"), "lastname": _field(df, "last_name"), "phone": _field(df, "phone"), "company": _or(df, "company_name", "company"), "address": _field(df, "address"), "industry": _or(df, "industry_sector", "sector"), "hs_lead_status": F.lit(status)}
    return df.select(F.struct(*(c.alias(n) for n, c in pairs.items())).alias("properties"))


def gohighlevel(df: DataFrame, tag: str = "Cleaned") -> DataFrame:
    """SNK3."""
    sector = F.col("industry_sector") if "industry_sector" in df.columns else F.lit("Unclassified")
    pairs = {"email": _field(df, "email"), "firstName": _field(df, "first_name"), "lastName": _field(df, "last_name"), "phone": _field(df, "phone"), "companyName": _or(df, "company_name", "company"), "address1": _field(df, "address"), "tags": F.array(F.lit(tag), sector)}
    return df.select(*(c.alias(n) for n, c in pairs.items()))


def payload(df: DataFrame, target: str) -> DataFrame:
    """SUP3, SNK4: the export's shape; webhook, CSV and Salesforce take records as they are."""
    return hubspot(df) if target == "HUBSPOT" else gohighlevel(df) if target == "GOHIGHLEVEL" else df


def export(df: DataFrame, tenant_id: str, target: str = "CSV_DOWNLOAD") -> tuple[DataFrame, DataFrame]:
    """SNK1: the payload and a row of summary; an unknown target is CSV_DOWNLOAD."""
    Tenant(tenant_id)
    target = target if target in EXPORT_TARGETS else "CSV_DOWNLOAD"
    out = payload(df, target)
    return out, out.agg(F.count("*").alias("records_exported_count")).select(F.lit(tenant_id).alias("tenant_id"), F.lit(target).alias("export_target"), "records_exported_count", F.lit("READY_FOR_DELIVERY").alias("status"))


def write(df: DataFrame, path: str, target: str) -> None:
    """Writes a payload: CSV for downloads (lists and structs as JSON), else JSON lines."""
    if target == "CSV_DOWNLOAD":
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.option("header", True).csv(path)
    else:
        df.write.json(path)
