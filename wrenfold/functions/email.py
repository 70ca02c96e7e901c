"""E-mail normalisation and tags."""

from __future__ import annotations

import ipaddress
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from .text import sanitized_of, text_of, too_long, without_hidden
from .vocab import CONFUSABLES, DISPOSABLE, EMAIL_PATTERN, LIMITS, PROVIDERS, ROLES, TYPO_RATIO, TYPOS


def corrected_domain(domain: str) -> str:
    """EML2 for one domain: the known misspelling's target, else the nearest provider if near enough, else itself."""
    if domain in TYPOS:
        return TYPOS[domain]
    ratio, near = max(((SequenceMatcher(None, domain, p).ratio(), p) for p in PROVIDERS), key=lambda x: x[0])
    return near if ratio >= TYPO_RATIO else domain


def homoglyph_risk(domain: str) -> bool:
    """EML3 for one domain: look-alike letters, letters of several scripts, or an encoded name that can't be read."""
    if "xn--" in domain:
        try:
            domain = domain.encode("ascii").decode("idna")
        except UnicodeError:
            return True
    scripts = {unicodedata.name(ch, "").split(" ")[0] for ch in domain if ch.isalpha()}
    return len(scripts) > 1 or any(ch in CONFUSABLES for ch in domain)


@F.pandas_udf(StructType().add("domain", "string").add("homoglyph", "boolean"))
def _domain_facts(s: pd.Series) -> pd.DataFrame:
    facts = {d: (corrected_domain(d), homoglyph_risk(d)) for d in s.dropna().unique()}
    found = [facts.get(d, (None, None)) for d in s]
    return pd.DataFrame({"domain": [a for a, _ in found], "homoglyph": [b for _, b in found]})


@F.pandas_udf(BooleanType())
def public_ip(s: pd.Series) -> pd.Series:
    """EML7: an address that can be reached from outside."""

    def one(v: str) -> bool:
        try:
            ip = ipaddress.ip_address(v)
        except ValueError:
            return False
        return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified)

    return s.map(lambda v: one(v) if v is not None else False)


def domain_facts(domain: Column) -> Column:
    """EML2, EML3: struct of domain (corrected) and homoglyph. Providers spelt right and known misspellings stay in Catalyst."""
    known = domain.isin(*PROVIDERS, *TYPOS)
    fixed = F.create_map(*(F.lit(x) for pair in TYPOS.items() for x in pair))
    python = _domain_facts(F.when(~known, domain))
    return F.struct(F.when(known, F.coalesce(F.try_element_at(fixed, domain), domain)).otherwise(python["domain"]).alias("domain"), F.when(known, False).otherwise(python["homoglyph"]).alias("homoglyph"))


def one_at(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("@"), F.lit(""))) == 1


def email_value(sanitised: Column) -> Column:
    return F.replace(F.lower(sanitised), F.lit(" "), F.lit(""))


def email_struct(raw: Column, error: Column, value: Column, good: Column, facts: Column) -> Column:
    """EML1 from its parts: the text, its length error, the value without spaces, whether it has one @, and its domain's facts."""
    domain = F.substring_index(value, "@", -1)
    full = F.concat(F.substring_index(value, "@", 1), F.lit("@"), facts["domain"])
    fixed = F.coalesce(good & (facts["domain"] != domain), F.lit(False))
    valid = F.coalesce(good & full.rlike(EMAIL_PATTERN), F.lit(False))
    reason = F.when(error.isNotNull(), error).when(~good, F.lit("malformed_at_symbol")).when(~valid, F.lit("failed_syntax_check"))
    return F.struct(
        raw.alias("original"),
        F.when(valid, full).alias("normalized"),
        valid.alias("is_valid_syntax"),
        fixed.alias("was_typo_corrected"),
        F.when(fixed, F.concat(domain, F.lit("->"), facts["domain"])).alias("typo_correction_applied"),
        F.coalesce(good & facts["homoglyph"], F.lit(False)).alias("homoglyph_risk_detected"),
        reason.alias("rejection_reason"),
    )


def with_email(df: DataFrame, c: Column, name: str = "email_result") -> DataFrame:
    """EML1: a struct of seven fields, built in steps. A null has no @; a text over the limit is rejected for that."""
    df = df.withColumn("_text", text_of(c)).withColumns({"_error": too_long(F.col("_text"), "email"), "_value": without_hidden(F.col("_text"))})
    df = df.withColumn("_value", email_value(sanitized_of(F.col("_value")))).withColumn("_good", F.col("_error").isNull() & one_at(F.col("_value")))
    df = df.withColumn("_domain", F.when(F.col("_good"), F.substring_index("_value", "@", -1))).withColumn("_facts", domain_facts(F.col("_domain")))
    return df.withColumn(name, email_struct(*(F.col(x) for x in ("_text", "_error", "_value", "_good", "_facts")))).drop("_text", "_error", "_value", "_good", "_domain", "_facts")


def syntax(c: Column) -> Column:
    """EML4: struct of ok, local, domain."""
    ok = F.coalesce((c != "") & (F.length(c) <= LIMITS["email"]) & one_at(c) & c.rlike(EMAIL_PATTERN), F.lit(False))
    return F.struct(ok.alias("ok"), F.when(ok, F.substring_index(F.lower(c), "@", 1)).alias("local"), F.when(ok, F.substring_index(F.lower(c), "@", -1)).alias("domain"))


def disposable(domain: Column) -> Column:
    """EML5."""
    return F.coalesce(domain.isin(*DISPOSABLE), F.lit(False))


def role_based(local: Column) -> Column:
    """EML6."""
    return F.coalesce(local.isin(*ROLES), F.lit(False))
