"""Columns found by name or content, and whole tables normalised."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.email import with_email
from ..functions.vocab import Tenant

# What a column's name has, by class, in order of precedence.
HEADERS = {
    "EMAIL": r"email|e-mail|mail|contact_email|user_email",
    "PHONE": r"phone|mobile|cell|contact|tel|whatsapp|number",
    "NAME": r"name|first_name|last_name|full_name|person|contact_person",
    "ADDRESS": r"address|street|city|state|zip|country|location",
    "COMPANY": r"company|organization|business|agency|firm|employer",
    "BIO": r"bio|description|note|notes|comment|about|summary|requirement",
}
SAMPLED, ENOUGH = 10, 2


def by_name(column: str) -> str | None:
    return next((k for k, p in HEADERS.items() if re.search(p, column.strip(), re.I)), None)


def classify(df: DataFrame, order: str | None = None) -> dict[str, str]:
    """CLS1: the class of each column: by its name, else by its first ten values that aren't null (LIM1)."""
    out = {c: by_name(c) for c in df.columns if c != order}
    for c in [c for c, k in out.items() if k is None]:
        some = df.where(F.col(f"`{c}`").isNotNull())
        first = [r[0] for r in (some.orderBy(order) if order else some).limit(SAMPLED).select(F.col(f"`{c}`").cast("string")).collect()]
        mail = sum("@" in v and "." in v for v in first)
        phone = sum(bool(re.search(r"\+?\d{7,15}", v)) for v in first)
        out[c] = "EMAIL" if mail >= ENOUGH else "PHONE" if phone >= ENOUGH else "GENERIC"
    return out


FIELDS = {"phone": T.phone_text_of, "address": T.address_text_of, "company": T.company_text_of, "bio": lambda v: v}


def with_record(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """CLS3: adds email_result, parsed_name, clean_phone, clean_address, clean_company, clean_bio, errors, in steps.

    columns: email, name, phone, address, company, bio. A field over its limit is empty, with an error.
    """
    df = with_email(T.with_name(df, columns["name"]), columns["email"])
    df = df.withColumns({f"_e_{k}": T.too_long(T.text_of(columns[k]), k) for k in ("name", *FIELDS)} | {f"_v_{k}": T.without_hidden(T.text_of(columns[k])) for k in FIELDS})
    df = df.withColumns({f"_v_{k}": T.sanitized_of(F.col(f"_v_{k}")) for k in FIELDS})
    none = F.struct(F.lit(None).cast("string").alias("salutation"), F.lit("").alias("first_name"), F.lit("").alias("last_name"), F.lit("").alias("raw"))
    done = {f"clean_{k}": F.when(F.col(f"_e_{k}").isNull(), clean(F.col(f"_v_{k}"))).otherwise("") for k, clean in FIELDS.items()}
    said = [F.concat(F.lit("parse_name: "), "_e_name"), *(F.concat(F.lit(f"sanitize_{k}: "), f"_e_{k}") for k in FIELDS)]
    df = df.withColumns({**done, "parsed_name": F.when(F.col("_e_name").isNull(), F.col("parsed_name")).otherwise(none), "errors": F.array_compact(F.array(*said))})
    return df.drop(*(f"_e_{k}" for k in ("name", *FIELDS)), *(f"_v_{k}" for k in FIELDS))


def normalize_table(df: DataFrame, tenant_id: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """CLS2, AGG4: the table with the first column of each class rewritten, and a row of audit counts."""
    Tenant(tenant_id)
    classes = classify(df, order)
    first = {k: next((c for c, v in classes.items() if v == k), None) for k in HEADERS}
    kept = [F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(df.columns)]
    where = {c: f"_in_{i}" for i, c in enumerate(df.columns)}
    value = lambda k: F.col(where[first[k]]) if first[k] else F.lit(None).cast("string")
    done = with_record(df.select(*kept), {k.lower(): value(k) for k in HEADERS})
    name = F.trim(F.concat_ws(" ", "parsed_name.first_name", "parsed_name.last_name"))
    new = {"EMAIL": F.coalesce("email_result.normalized", F.lit("")), "NAME": name, "PHONE": F.col("clean_phone"), "ADDRESS": F.col("clean_address"), "COMPANY": F.col("clean_company"), "BIO": F.col("clean_bio")}
    by_column = {first[k]: c for k, c in new.items() if first[k]}
    clean = done.select(*(by_column.get(c, F.col(where[c])).alias(c) for c in df.columns))
    counts = done.agg(
        F.count("*").alias("total_records_ingested"), F.count_if("email_result.is_valid_syntax").alias("valid_email_syntax_count"), F.count_if("email_result.was_typo_corrected").alias("typo_corrections_applied"),
        F.count_if("email_result.homoglyph_risk_detected").alias("homoglyph_threats_flagged"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("long").alias("processing_errors_caught"),
    )
    return clean, counts
