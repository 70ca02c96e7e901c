"""The contact pipeline: normalise, deduplicate, verify, format, score, apply rules, throttle, audit."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import optional_fingerprint, tenant_key
from ..functions.phone import classified_phone
from ..functions.risk import with_risk, with_sector
from ..functions.vocab import BUCKET_CAPACITY, DLQ_CODES, HIGH_RISK, Tenant
from ..operators.classify import with_record
from ..operators.compliance import AuditEntry, audit
from ..operators.dedup import duplicate_ids, keep_first
from ..operators.rules import run_rules
from ..operators.throttle import throttle_burst
from ..operators.verify import MX_SCHEMA, verify
from ..sources.staging import dealt, staged
from ..sources.tables import export


# Fixed value: records of a batch in strict mode; otherwise there is no limit.
BATCH_LIMIT = 20_000


@dataclass(frozen=True)
class Options:
    """strict: the observed chain (drops and throttles keep the record, copies go by id, no audit) instead of what is meant.

    limit: records of a batch in strict mode; None: any number.
    """

    tenant_id: str
    pepper: bytes
    rules: list = field(default_factory=list)
    region: str | None = "IN"
    tokens: int = int(BUCKET_CAPACITY)
    strict: bool = False
    limit: int | None = BATCH_LIMIT
    batch_id: str | None = None
    previous: str | None = None


@dataclass
class Result:
    """What a run gives. The report needs no audit; clean and entry, which do, make it when the first of them is asked for."""

    dead: DataFrame
    report: DataFrame
    finish: Callable[[], tuple[DataFrame, AuditEntry | None]]

    @cached_property
    def _finished(self) -> tuple[DataFrame, AuditEntry | None]:
        return self.finish()

    @property
    def clean(self) -> DataFrame:
        return self._finished[0]

    @property
    def entry(self) -> AuditEntry | None:
        return self._finished[1]


FIELDS = ("email", "name", "phone", "address", "company", "bio")


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def normalized(df: DataFrame) -> DataFrame:
    """The eleven fields that go on, the errors and the order (_row_idx)."""
    filled = lambda c: F.nullif(c, F.lit(""))
    ids = F.coalesce(filled(_field(df, "id").cast("string")), filled(_field(df, "record_id").cast("string")), F.lit("unknown"))
    n = with_record(df.select("_row_idx", ids.alias("record_id"), *(_field(df, x).alias(f"_in_{x}") for x in FIELDS)), {x: F.col(f"_in_{x}") for x in FIELDS})
    email, name = F.col("email_result.normalized"), F.col("parsed_name")
    first, last = filled(name["first_name"]), filled(name["last_name"])
    return n.select(
        "_row_idx", "record_id", email.alias("email"), F.when(email.isNotNull(), F.substring_index(email, "@", -1)).alias("email_domain"), filled(F.col("clean_phone")).alias("phone"),
        filled(F.concat_ws(" ", first, last)).alias("contact_name"), first.alias("first_name"), last.alias("last_name"), filled(F.col("clean_address")).alias("address"),
        filled(F.col("clean_company")).alias("company_name"), filled(F.col("clean_company")).alias("company"), filled(F.col("clean_bio")).alias("bio"), "errors",
    )


def checked(df: DataFrame, tenant_id: str, mx: DataFrame, strict: bool) -> DataFrame:
    out = verify(df, tenant_id, mx)
    valid = F.col("has_mx_records") if strict else F.array_contains("verification_tags", "VALID_SYNTAX")
    new = {"is_disposable_email": F.col("is_disposable"), "is_role_based_email": F.col("is_role_based"), "is_catch_all_domain": F.coalesce("is_catch_all", F.lit(False)), "email_valid_syntax": valid}
    return out.withColumns(new).drop("is_disposable", "is_role_based", "is_catch_all", "verification_tags", "_meta_verified")


def formatted(df: DataFrame, region: str | None) -> DataFrame:
    out = df.withColumn("_p", classified_phone(F.col("phone"), region))
    new = {"phone": F.coalesce("_p.e164", "phone"), "line_type": F.col("_p.line_type_tag"), "is_voip_phone": F.col("_p.line_type_tag") == "LINE_VOIP", "country_code": F.col("_p.country_code"), "_tags": F.col("_p.tags"), "_failed": F.col("_p.failed")}
    return out.withColumns(new).drop("_p")


def scored(df: DataFrame, strict: bool) -> DataFrame:
    flags = {"disposable": F.col("is_disposable_email"), "role": F.col("is_role_based_email"), "catch_all": F.col("is_catch_all_domain")}
    if not strict:
        flags |= {"voip": F.col("is_voip_phone"), "dummy": F.array_contains("_tags", "DUMMY_SEQUENCE") | F.array_contains("_tags", "REPEATING_DIGITS")}
    company = F.coalesce("company_name", F.lit(""))
    df = with_risk(df, F.col("email_domain"), flags, F.coalesce("contact_name", F.lit("")), company).drop("risk_tags")
    return with_sector(df, company, F.col("email_domain"), "sector", "_c").withColumn("industry_sector", F.col("sector")).drop("_c", "_tags")


def run(df: DataFrame, options: Options, mx: DataFrame | None = None) -> Result:
    """Records (with _row_idx) come out once: clean, or counted by the report."""
    o, began, spark = options, time.monotonic(), df.sparkSession
    Tenant(o.tenant_id)
    if o.strict and o.limit is not None and df.limit(o.limit + 1).count() > o.limit:
        raise ValueError(f"a batch has at most {o.limit} records in strict mode")
    mx = spark.createDataFrame([], MX_SCHEMA) if mx is None else mx
    # each step is read several times (by the join that hands back firsts, the report, the audit): it is made once
    flow = staged(normalized(df).withColumn("_fp", optional_fingerprint(F.col("email"), tenant_key(o.tenant_id, o.pepper))), "normalized")
    total = flow.count()
    if o.strict:
        gone = duplicate_ids(flow, "_fp", "record_id")
        removed = gone.count()
        flow = flow.join(gone.withColumn("_dup", F.lit(True)), "record_id", "left").withColumn("_dup", F.coalesce("_dup", F.lit(False)))
    else:
        flow = keep_first(flow, F.col("_fp"), "_row_idx", "_dup")
    # nothing is asked of duplicates but their number, so they go no further; the rest is dealt out again, as few may be left in a part
    first = dealt(staged(flow.where(~F.col("_dup")).drop("_fp", "_dup"), "firsts"), "_row_idx")
    if not o.strict:
        removed = total - first.count()
    before = staged(scored(formatted(checked(first, o.tenant_id, mx, o.strict), o.region), o.strict), "scored")
    flow = run_rules(before.withColumn("id", F.col("record_id")), o.rules, o.tenant_id, keep_dropped=True)
    alive, lost = ~F.col("_failed"), F.col("_failed")
    if o.strict:  # a dropped record stays as it was before the rules; so the rules' own columns are null
        kept = flow.where(alive & ~F.col("is_dropped"))
        dropped = before.join(flow.where(alive & F.col("is_dropped")).select("_row_idx"), "_row_idx", "left_semi")
        clean = kept.unionByName(dropped, allowMissingColumns=True).drop("_failed", "is_dropped", "errors")
    else:
        clean = throttle_burst(flow.where(alive & ~F.col("is_dropped")).withColumn("_tenant", F.lit(o.tenant_id)), "_tenant", "_row_idx", o.tokens).where(~F.col("is_throttled"))
        clean = clean.drop("_tenant", "_failed", "is_dropped", "is_throttled", "throttle_tag", "_meta_throttled", "errors")
    passed = alive & ~F.col("is_dropped")
    n = lambda c: F.count_if(c)
    report = flow.agg(
        F.lit(total).cast("long").alias("total_records"), n(passed).alias("passed"), F.lit(removed).cast("long").alias("duplicates_removed"), n(alive & ~F.col("email_valid_syntax")).alias("invalid_emails"),
        n(alive & F.col("phone").isNull()).alias("invalid_phones"), n(alive & (F.col("risk_score") >= HIGH_RISK)).alias("high_risk_flags"), n(alive & F.col("is_dropped")).alias("dropped_via_rules"), n(alive).alias("alive"), n(lost).alias("dlq_count"),
    )
    if o.strict:
        report = report.withColumns({"clean_records_count": F.col("alive"), "throttled_count": F.lit(0).cast("long"), "dropped_via_rules": F.lit(0).cast("long")})
    else:
        report = report.withColumns({"clean_records_count": F.least("passed", F.lit(o.tokens).cast("long")), "throttled_count": F.greatest(F.col("passed") - o.tokens, F.lit(0).cast("long"))})
    # fields that can't be cleaned are empty and listed in errors; a record at which a library fails is dead, a stage that
    # fails as a whole fails the job
    dead = flow.where(lost).select("record_id", F.lit("PHONE_FORMATTING").alias("stage"), F.lit(DLQ_CODES[1]).alias("error_code"), F.lit("the phone library failed at the record").alias("error_message"), F.to_json(F.struct("record_id", "email", "phone")).alias("last_known_data"))
    names = ["total_records", "clean_records_count", "duplicates_removed", "invalid_emails", "invalid_phones", "high_risk_flags", "dropped_via_rules", "throttled_count", "dlq_count"]
    report = report.select(*names)
    if o.strict:
        return Result(dead, report, lambda: (clean, None))
    report = report.withColumn("processing_time_ms", F.lit(round((time.monotonic() - began) * 1000, 2)))
    return Result(dead, report, lambda: audit(clean, o.tenant_id, o.pepper, "DATA_INGESTION", o.batch_id, o.previous))


def response(result: Result, tenant_id: str, target: str, billing: dict) -> tuple[DataFrame, DataFrame]:
    """SNK6: the clean records in the export's shape, and a row of status, what was exported, billing and the report."""
    payload, exported = export(result.clean, tenant_id, target)
    bill = {f"billing_{k}": F.lit(v) for k, v in billing.items() if k != "tenant_id"}
    row = exported.withColumnRenamed("status", "export_status").crossJoin(F.broadcast(result.report.drop("processing_time_ms")))  # a row each
    return payload, row.withColumns({"status": F.lit("success"), **bill})


def reconciled(report: DataFrame) -> DataFrame:
    """AGG6: whether every record is accounted for."""
    whole = F.col("clean_records_count") + F.col("duplicates_removed") + F.col("dropped_via_rules") + F.col("throttled_count") + F.col("dlq_count")
    return report.select("total_records", whole.alias("accounted"), (whole == F.col("total_records")).alias("balanced"))
