"""Phone numbers: digits, dummy patterns, and the ladder of results."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from .vocab import DIGITS_MAX, DIGITS_MIN, LINE_TYPES, PHONE_MAX

try:
    import phonenumbers
except ImportError:  # an optional library; without it the ladder ends with DEPENDENCY_MISSING
    phonenumbers = None


@F.pandas_udf(StringType())
def _ascii_digits(s: pd.Series) -> pd.Series:
    return s.map(lambda v: "".join(str(unicodedata.digit(ch, -1)) if unicodedata.digit(ch, -1) >= 0 else ch for ch in v), na_action="ignore")


def ascii_digits(c: Column) -> Column:
    """PHN1: digits of any script as 0-9."""
    other = c.rlike(r"[^\x00-\x7F]")
    return F.when(other, _ascii_digits(F.when(other, c))).otherwise(c)


def raw_digits(c: Column) -> Column:
    """PHN2: digits, and a + if it is the first of them; nothing of null or of over 40 characters."""
    kept = F.regexp_replace(c, "[^0-9+]", "")
    return F.when(F.length(c) <= PHONE_MAX, F.regexp_replace(kept, r"(?<!^)\+", "")).otherwise("")


def repeating(d: Column) -> Column:
    """PHN3: one digit throughout."""
    return F.coalesce((F.length(d) > 0) & (F.size(F.array_distinct(F.split(d, ""))) == 1), F.lit(False))


def sequential(d: Column) -> Column:
    """PHN4: up or down by one (after 9 comes 0), or two digits in turn. For up to 20 digits."""
    up = "0123456789" * 3
    in_turn = d.rlike(r"^(.)(?!\1)(.)(?:\1\2)*\1?$")
    return F.coalesce((F.length(d) >= 4) & (F.lit(up).contains(d) | F.lit(up[::-1]).contains(d) | in_turn), F.lit(False))


def dummy_pattern(d: Column) -> Column:
    """PHN5."""
    return F.when(repeating(d), "REPEATING_DIGITS").when(sequential(d), "DUMMY_SEQUENCE")


@F.pandas_udf(StructType([StructField(n, t) for n, t in (("e164", StringType()), ("national", StringType()), ("country", IntegerType()), ("region", StringType()), ("kind", StringType()), ("parsed", BooleanType()), ("valid", BooleanType()), ("failed", BooleanType()))]))
def _parsed(digits: pd.Series, region: pd.Series) -> pd.DataFrame:
    names = ["e164", "national", "country", "region", "kind", "parsed", "valid", "failed"]
    rows = []
    for d, r in zip(digits, region, strict=True):
        row = (None, None, None, None, None, False, False, False)
        if d is not None:
            try:
                p = phonenumbers.parse(d, r)
                row = (None, None, p.country_code, r, None, True, False, False)
                if phonenumbers.is_valid_number(p):
                    kind = phonenumbers.PhoneNumberType.to_string(phonenumbers.number_type(p))
                    row = (phonenumbers.format_number(p, phonenumbers.PhoneNumberFormat.E164), str(p.national_number), p.country_code, phonenumbers.region_code_for_number(p) or r, kind, True, True, False)
            except phonenumbers.NumberParseException:
                pass
            except Exception:  # the library's failure is the record's, not the job's
                row = (None, None, None, None, None, False, False, True)
        rows.append(row)
    return pd.DataFrame(rows, columns=names).astype({"country": "Int32"})


def line_type(kind: Column) -> Column:
    """PHN7: the tag of the numbering-plan library's line type."""
    known = F.create_map(*(F.lit(x) for pair in LINE_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, kind), F.lit("LINE_UNKNOWN"))


def classified_phone(c: Column, region: str | None = "IN", text: bool = True) -> Column:
    """PHN6: struct of raw_input, e164, national_number, country_code, region_used, line_type_tag, tags, failed.

    failed: the library raised what it shouldn't. text: whether the column holds text; another type can't be parsed.
    """
    raw = c.cast("string")
    digits = raw_digits(ascii_digits(raw))
    n = F.length(F.regexp_replace(digits, r"^\++", ""))
    plus = digits.startswith("+")
    empty = raw.isNull() | (F.trim(F.regexp_replace(raw, r"\s", " ")) == "")
    early = F.when(empty, "EMPTY_INPUT")
    early = early.when(F.lit(not text), "UNPARSEABLE").when(F.length(raw) > PHONE_MAX, "OVERSIZED_INPUT").when((n < DIGITS_MIN) | (n > DIGITS_MAX), "INVALID_PHONE_LENGTH")
    none = F.lit(None).cast("string")
    shown = F.when(empty, "").when(F.length(raw) > PHONE_MAX, F.substring(raw, 1, PHONE_MAX) if text else raw).otherwise(raw)
    if phonenumbers is None:
        tag = F.coalesce(early, F.lit("DEPENDENCY_MISSING"))
        return F.struct(shown.alias("raw_input"), none.alias("e164"), none.alias("national_number"), F.lit(None).cast("int").alias("country_code"), none.alias("region_used"), F.lit("LINE_UNKNOWN").alias("line_type_tag"), F.array(tag).alias("tags"), F.lit(False).alias("failed"))
    early = F.coalesce(early, F.when(~plus & F.lit(not region), "AMBIGUOUS_REGION"))
    p = _parsed(F.when(early.isNull(), digits), F.lit(region))
    kind = F.when(p["valid"], line_type(p["kind"])).otherwise("LINE_UNKNOWN")
    tags = F.array_compact(F.array(F.lit("VALID_E164"), kind, dummy_pattern(p["national"]), F.when(kind == "LINE_VOIP", "VOIP_RISK"), F.when(kind == "LINE_PREMIUM_RATE", "PREMIUM_RATE_RISK")))
    tags = F.when(early.isNotNull(), F.array(early)).when(~p["valid"], F.array(F.lit("UNPARSEABLE"))).otherwise(tags)
    return F.struct(shown.alias("raw_input"), p["e164"].alias("e164"), p["national"].alias("national_number"), p["country"].alias("country_code"), p["region"].alias("region_used"), kind.alias("line_type_tag"), tags.alias("tags"), F.coalesce(p["failed"], F.lit(False)).alias("failed"))
