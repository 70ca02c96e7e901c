"""Text sanitation. ASCII without markup stays in Catalyst; other rows go through one Arrow function."""

from __future__ import annotations

import html
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .vocab import LIMITS, SALUTATIONS

_HIDDEN = r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}]"


def text_of(c: Column) -> Column:
    """TXT1: the value as text; null is empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def too_long(c: Column, kind: str = "generic") -> Column:
    """TXT2: the error of a text over its kind's limit, else null."""
    limit = LIMITS.get(kind, LIMITS["generic"])
    return F.when(F.length(c) > limit, F.concat(F.lit(f"{kind} field exceeds max length {limit} (got "), F.length(c).cast("string"), F.lit(")")))


def without_hidden(c: Column) -> Column:
    """TXT3: without control, format, private-use and surrogate characters."""
    return F.regexp_replace(c, _HIDDEN, "")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def markup_free(value: str) -> str:
    """TXT5 for one text: what an HTML parser takes for text, escaped again."""
    parser = _Text()
    try:
        parser.feed(value)
        parser.close()
    except Exception:  # a text that the parser can't read is no text
        return ""
    return html.escape("".join(parser.parts), quote=True)


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """TXT4."""
    return s.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(StringType())
def strip_markup(s: pd.Series) -> pd.Series:
    """TXT5."""
    return s.map(markup_free, na_action="ignore")


@F.pandas_udf(StringType())
def _slow(s: pd.Series) -> pd.Series:
    return s.map(lambda v: markup_free(unicodedata.normalize("NFKC", v)).strip(), na_action="ignore")


@F.pandas_udf(StringType())
def _no_marks(s: pd.Series) -> pd.Series:
    return s.map(lambda v: "".join(ch for ch in unicodedata.normalize("NFKD", v) if not unicodedata.combining(ch)), na_action="ignore")


def _plain(c: Column) -> Column:
    return ~c.rlike(r"[^\x00-\x7F]|[<&]")


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))


def sanitized_of(v: Column) -> Column:
    """Of a text without hidden characters: NFKC, markup, outer spaces. Only marked-up or non-ASCII rows meet Python."""
    return F.when(_plain(v), F.trim(escaped(v))).otherwise(_slow(F.when(~_plain(v), v)))


def sanitized(c: Column) -> Column:
    """TXT6 without its length check."""
    return sanitized_of(without_hidden(text_of(c)))


def without_marks(c: Column) -> Column:
    """TXT7: without diacritics."""
    other = c.rlike(r"[^\x00-\x7F]")
    return F.when(other, _no_marks(F.when(other, c))).otherwise(c)


def titled(c: Column) -> Column:
    """Each run of letters with a capital and small letters, as Python's title() does for ASCII."""
    runs = F.regexp_extract_all(c, F.lit(r"([\p{L}]+|[^\p{L}]+)"), F.lit(1))
    return F.concat_ws("", F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))))


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def name_parts(raw: Column) -> Column:
    """The words of a sanitised name."""
    kept = F.trim(F.regexp_replace(F.regexp_replace(without_marks(raw), r"[^A-Za-z '.-]", ""), " +", " "))
    return F.filter(F.split(kept, " "), lambda x: x != "")


def parsed_name_of(raw: Column, parts: Column) -> Column:
    """TXT8 of a sanitised name and its words."""
    head = F.lower(F.regexp_replace(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), r"\.+$", ""))
    named = head.isin(*SALUTATIONS)
    rest = F.when(named, F.slice(parts, 2, 1 << 20)).otherwise(parts)
    return F.struct(
        F.when(named, _capital(head)).alias("salutation"),
        F.coalesce(_capital(F.get(rest, F.lit(0))), F.lit("")).alias("first_name"),
        F.when(F.size(rest) > 1, F.array_join(F.transform(F.slice(rest, 2, 1 << 20), _capital), " ")).otherwise("").alias("last_name"),
        raw.alias("raw"),
    )


def with_name(df: DataFrame, c: Column, name: str = "parsed_name") -> DataFrame:
    """TXT8: a struct of salutation, first_name, last_name, raw. Built in steps, so that no step repeats another's work."""
    df = df.withColumn("_raw", without_hidden(text_of(c))).withColumn("_raw", sanitized_of(F.col("_raw")))
    return df.withColumn("_parts", name_parts(F.col("_raw"))).withColumn(name, parsed_name_of(F.col("_raw"), F.col("_parts"))).drop("_raw", "_parts")


def phone_text_of(v: Column) -> Column:
    """TXT9 of a sanitised text: digits and + ( ) . - and spaces; ten digits or more without + get one."""
    kept = F.trim(F.regexp_replace(v, r"[^0-9+() .-]", ""))
    return F.when(~kept.startswith("+") & (F.length(F.regexp_replace(kept, "[^0-9]", "")) >= 10), F.concat(F.lit("+"), kept)).otherwise(kept)


def address_text_of(v: Column) -> Column:
    """TXT10 of a sanitised text."""
    return titled(F.trim(F.regexp_replace(v, r"[<>;{}\\`]", "")))


def company_text_of(v: Column) -> Column:
    """TXT11 of a sanitised text."""
    return titled(F.trim(F.regexp_replace(v, r"[^A-Za-z0-9 '.&,()/-]", "")))
