"""All queries over the contact-data operators, by the inventory's names, and their SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import email as E
from ..functions import hashing as H
from ..functions import phone as P
from ..functions import risk as R
from ..functions import similarity as S
from ..functions import text as T
from ..functions import vocab as V
from ..operators import billing, classify, compliance, dedup, relations, rules, summary, throttle, verify
from ..operators.contacts import CONTACTS, contacts
from ..sources import tables
from ..sources.staging import new_path, staged
from ..streaming.bucket import throttled_stream
from . import duck as D
from . import pipeline as PL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TENANT, PEPPER = "acme", b"a pepper for tests, 32 bytes long"
KEY = H.tenant_key(TENANT, PEPPER)


def query(name: str, sql: str | None = None, on_contacts: bool = True):
    """Registers a query; sql is its twin, over the view `contacts` unless on_contacts is false."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = D.with_contacts(sql) if on_contacts else sql
        return f

    return add


def over_contacts(name: str, columns: Callable[[], dict], sql: dict[str, str] | None) -> None:
    """A query of id and columns over contacts, and its twin."""
    query(name, None if sql is None else "SELECT id, " + ", ".join(f"{x} AS {n}" for n, x in sql.items()) + " FROM contacts")(lambda spark, d: contacts(spark, d).select("id", *(c.alias(n) for n, c in columns().items())))


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def mx(spark: SparkSession, d: str, corrected: bool = True) -> DataFrame:
    """The table of exchangers that queries use in place of a resolver; corrected: with the providers, too."""
    # staged before the filter: Spark would work out a filter on the domain below the shuffle, in the few tasks of the file
    domains = staged(contacts(spark, d).select(E.syntax(F.col("email"))["domain"].alias("domain")).distinct(), "domains").where("domain IS NOT NULL")
    if corrected:
        domains = domains.union(spark.createDataFrame([(p,) for p in V.PROVIDERS], "domain string")).distinct()
    tag = F.when(F.col("domain").endswith(".tk"), "NO_MX_RECORD").when(F.col("domain").endswith(".org"), "DNS_TIMEOUT").otherwise("VALID_SYNTAX")
    return domains.select("domain", F.concat(F.lit("mx."), "domain").alias("mx_host"), F.when(tag == "VALID_SYNTAX", "8.8.8.8").alias("validated_ip"), tag.alias("tag"))


def mx_tag(d: str) -> str:
    return f"CASE WHEN ends_with({d}, '.tk') THEN 'NO_MX_RECORD' WHEN ends_with({d}, '.org') THEN 'DNS_TIMEOUT' ELSE 'VALID_SYNTAX' END"


C = F.col

# --- sources and sinks ------------------------------------------------------------------------------------------------


@query("src1", "SELECT n_nationkey, n_name, n_regionkey FROM nation", False)
def src1(spark, d):
    read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).csv(path := new_path(spark, "src1"))
    return tables.read_csv(spark, path)


@query("src2", "SELECT n_nationkey, n_name, n_regionkey, n_nationkey > 9 AS late FROM nation", False)
def src2(spark, d):
    tables.write_excel(read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey", (C("n_nationkey") > 9).alias("late")), path := new_path(spark, "src2") + ".xlsx")
    return tables.read_excel(spark, path, ", ".join(f"{n} {t}" for n, t in [*read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").dtypes, ("late", "boolean")]))


@query("src3", "SELECT c_custkey, c_name, c_acctbal FROM customer", False)
def src3(spark, d):
    lines = read(spark, d, "customer").select(F.to_json(F.struct("c_custkey", "c_name", "c_acctbal")).alias("line"))
    return tables.from_json(lines, "line", "c_custkey long, c_name string, c_acctbal double")


@query("src4", "SELECT _row_idx, id, email, name FROM contacts")
def src4(spark, d):
    return contacts(spark, d).select("_row_idx", "id", "email", "name")


def _export_source(spark, d):
    return T.with_name(contacts(spark, d), C("name")).select("id", "email", "parsed_name.first_name", "parsed_name.last_name", "phone", F.when(C("_row_idx") % 4 == 0, "").otherwise(C("company")).alias("company_name"), F.lit("Other").alias("company"), "address", C("tenant_id").alias("sector"))


_PARTS = D.name_parts("name")
_COMPANY = "CASE WHEN _row_idx % 4 = 0 THEN 'Other' ELSE company END"


@query("snk1", "SELECT 'acme' AS tenant_id, 'CSV_DOWNLOAD' AS export_target, count(*) AS records_exported_count, 'READY_FOR_DELIVERY' AS status FROM contacts")
def snk1(spark, d):
    return tables.export(contacts(spark, d), TENANT, "elsewhere")[1]


@query("snk2", f"SELECT email, {D.first_name(_PARTS)} AS firstname, {D.last_name(_PARTS)} AS lastname, phone, {_COMPANY} AS company, address, tenant_id AS industry, 'Cleaned' AS hs_lead_status FROM contacts")
def snk2(spark, d):
    return tables.payload(_export_source(spark, d), "HUBSPOT").select("properties.*")


@query("snk3", f"SELECT email, {D.first_name(_PARTS)} AS firstName, {D.last_name(_PARTS)} AS lastName, phone, {_COMPANY} AS companyName, address AS address1, 'Cleaned|Unclassified' AS tags FROM contacts")
def snk3(spark, d):
    return tables.payload(_export_source(spark, d), "GOHIGHLEVEL").withColumn("tags", F.array_join("tags", "|"))


@query("snk4", "SELECT id, email, name, phone FROM contacts")
def snk4(spark, d):
    return tables.payload(contacts(spark, d).select("id", "email", "name", "phone"), "SALESFORCE")


@query("snk5")
def snk5(spark, d):
    return spark.createDataFrame([(summary.report(contacts(spark, d).select("_row_idx", "tenant_id", "company"), "_row_idx")["html"],)], "html string")


# --- text -------------------------------------------------------------------------------------------------------------

over_contacts("txt1", lambda: {"t": T.text_of(C("phone"))}, {"t": D.text("phone")})
query("txt2", f"SELECT doc_id, {D.too_long('text', 'bio')} AS error FROM documents", False)(lambda spark, d: read(spark, d, "documents").select("doc_id", T.too_long(C("text"), "bio").alias("error")))
query("txt3", f"SELECT doc_id, sha256({D.hidden('text')}) AS h FROM documents", False)(lambda spark, d: read(spark, d, "documents").select("doc_id", F.sha2(T.without_hidden(C("text")), 256).alias("h")))
query("txt4", "SELECT doc_id, sha256(nfc_normalize(text)) AS h FROM documents", False)(lambda spark, d: read(spark, d, "documents").select("doc_id", F.sha2(T.nfkc(C("text")), 256).alias("h")))
over_contacts("txt5", lambda: {"t": T.strip_markup(C("address"))}, {"t": D.markup_free("address")})
over_contacts("txt6", lambda: {"a": T.sanitized(C("address")), "b": T.sanitized(C("bio"))}, {"a": D.sanitized("address"), "b": D.sanitized("bio")})
query("txt7", "SELECT doc_id, sha256(strip_accents(text)) AS h FROM documents", False)(lambda spark, d: read(spark, d, "documents").select("doc_id", F.sha2(T.without_marks(C("text")), 256).alias("h")))
_SALUTED = f"{D.name_head(_PARTS)} IN {D.listed(V.SALUTATIONS)}"
query("txt8", f"SELECT id, CASE WHEN {_SALUTED} THEN {D.capital(D.name_head(_PARTS))} END AS salutation, {D.first_name(_PARTS)} AS first_name, {D.last_name(_PARTS)} AS last_name FROM contacts")(lambda spark, d: T.with_name(contacts(spark, d), C("name")).select("id", "parsed_name.salutation", "parsed_name.first_name", "parsed_name.last_name"))
over_contacts("txt9", lambda: {"t": T.phone_text_of(T.sanitized(C("phone")))}, {"t": D.phone("phone")})
over_contacts("txt10", lambda: {"t": T.address_text_of(T.sanitized(C("address")))}, {"t": D.address("address")})
over_contacts("txt11", lambda: {"t": T.company_text_of(T.sanitized(C("company")))}, {"t": D.company("company")})
over_contacts("txt12", lambda: {"t": T.sanitized(C("bio"))}, {"t": D.sanitized("bio")})

# --- e-mail -----------------------------------------------------------------------------------------------------------

_REASON = f"CASE WHEN NOT {D.one_at(D.email_value('email'))} THEN 'malformed_at_symbol' WHEN NOT {D.email_valid('email')} THEN 'failed_syntax_check' END"
_DOM = f"split_part({D.email_value('email')}, '@', 2)"
_FIXED = f"({D.one_at(D.email_value('email'))} AND {_DOM} IN {D.listed(V.TYPOS)})"
query(
    "eml1",
    f"SELECT id, {D.text('email')} AS original, {D.normalized_email('email')} AS normalized, {D.email_valid('email')} AS is_valid_syntax, {_FIXED} AS was_typo_corrected, "
    f"CASE WHEN {_FIXED} THEN {_DOM} || '->' || {D.fixed_domain(_DOM)} END AS typo_correction_applied, false AS homoglyph_risk_detected, {_REASON} AS rejection_reason FROM contacts",
)(lambda spark, d: E.with_email(contacts(spark, d), C("email")).select("id", "email_result.*"))
over_contacts("eml2", lambda: {"domain": E.domain_facts(E.syntax(C("email"))["domain"])["domain"]}, {"domain": D.fixed_domain(f"({D.domain_of('email')})")})
over_contacts("eml3", lambda: {"risk": E.domain_facts(E.syntax(C("email"))["domain"])["homoglyph"]}, {"risk": f"CASE WHEN {D.syntax_ok('email')} THEN false END"})
query("eml4", f"SELECT id, {D.syntax_ok('email')} AS ok, {D.local_of('email')} AS local, {D.domain_of('email')} AS domain FROM contacts")(lambda spark, d: contacts(spark, d).select("id", E.syntax(C("email")).alias("s")).select("id", "s.*"))
over_contacts("eml5", lambda: {"disposable": E.disposable(E.syntax(C("email"))["domain"])}, {"disposable": D.disposable(D.domain_of("email"))})
over_contacts("eml6", lambda: {"role": E.role_based(E.syntax(C("email"))["local"])}, {"role": D.role(D.local_of("email"))})


@query("eml7", "SELECT e.k AS k, NOT (k % 256 IN (0, 10, 127) OR k % 256 >= 224) AS public FROM (SELECT event_id AS k FROM events) e", False)
def eml7(spark, d):
    return read(spark, d, "events").select(C("event_id").alias("k"), E.public_ip(F.concat((C("event_id") % 256).cast("string"), F.lit(".1.2.3"))).alias("public"))


query("eml8", f"SELECT domain, 'mx.' || domain AS mx_host, CASE WHEN {mx_tag('domain')} = 'VALID_SYNTAX' THEN '8.8.8.8' END AS validated_ip, {mx_tag('domain')} AS tag FROM (SELECT DISTINCT {D.domain_of('email')} AS domain FROM contacts) WHERE domain IS NOT NULL")(lambda spark, d: mx(spark, d, False))
_D, _L, _OK = D.domain_of("email"), D.local_of("email"), D.syntax_ok("email")
_TAGS = (
    f"CASE WHEN NOT {_OK} THEN 'INVALID_SYNTAX' ELSE array_to_string(list_filter(['VALID_SYNTAX', CASE WHEN {D.disposable(_D)} THEN 'DISPOSABLE_EMAIL' END, CASE WHEN {D.role(_L)} THEN 'ROLE_BASED' END, "
    f"CASE WHEN NOT {D.disposable(_D)} AND {mx_tag(_D)} <> 'VALID_SYNTAX' THEN {mx_tag(_D)} END], lambda x: x IS NOT NULL), '|') END"
)
query("eml13", f"SELECT id, {_TAGS} AS tags FROM contacts")(lambda spark, d: verify.verify(contacts(spark, d), TENANT, mx(spark, d)).select("id", F.array_join("verification_tags", "|").alias("tags")))
_HAS = f"NOT (contains({_TAGS}, 'NO_MX_RECORD') OR contains({_TAGS}, 'DNS_ERROR'))"
query(
    "eml14", f"SELECT id, {_OK} AND {D.disposable(_D)} AS is_disposable, {_OK} AND {D.role(_L)} AS is_role_based, CAST(NULL AS BOOLEAN) AS is_catch_all, {_TAGS} AS verification_tags, {_HAS} AS has_mx_records, true AS _meta_verified FROM contacts"
)(lambda spark, d: verify.verify(contacts(spark, d), TENANT, mx(spark, d)).select("id", "is_disposable", "is_role_based", "is_catch_all", F.array_join("verification_tags", "|").alias("verification_tags"), "has_mx_records", "_meta_verified"))

# --- phone ------------------------------------------------------------------------------------------------------------

_DIGITS = D.raw_digits("phone")
over_contacts("phn1", lambda: {"t": P.ascii_digits(F.translate("phone", "0123456789", "٠١٢٣٤٥٦٧٨٩"))}, {"t": "phone"})
over_contacts("phn2", lambda: {"digits": P.raw_digits(C("phone"))}, {"digits": _DIGITS})
over_contacts("phn3", lambda: {"same": P.repeating(P.raw_digits(C("phone")))}, {"same": D.repeating(f"({_DIGITS})")})
over_contacts("phn4", lambda: {"seq": P.sequential(P.raw_digits(C("phone")))}, {"seq": D.sequential(f"({_DIGITS})")})
over_contacts("phn5", lambda: {"tag": P.dummy_pattern(P.raw_digits(C("phone")))}, {"tag": D.dummy(f"({_DIGITS})")})
_SHOWN = "CASE WHEN phone IS NULL OR trim(phone) = '' THEN '' ELSE phone[1:40] END"
_NO_LIB = P.phonenumbers is None  # the twins know the ladder without the optional library


def _phn6(spark, d):
    p = contacts(spark, d).select("id", P.classified_phone(C("phone")).alias("p"))
    return p.select("id", "p.raw_input", "p.e164", "p.country_code", "p.line_type_tag", F.array_join("p.tags", "|").alias("tags"))


query("phn6", f"SELECT id, {_SHOWN} AS raw_input, CAST(NULL AS VARCHAR) AS e164, CAST(NULL AS INT) AS country_code, 'LINE_UNKNOWN' AS line_type_tag, {D.phone_tag('phone')} AS tags FROM contacts" if _NO_LIB else None)(_phn6)
over_contacts("phn7", lambda: {"tag": P.line_type(F.element_at(F.array(*map(F.lit, [*V.LINE_TYPES, "OTHER"])), (C("_row_idx") % 12 + 1).cast("int")))}, {"tag": "[" + ", ".join(map(D.q, [*V.LINE_TYPES.values(), "LINE_UNKNOWN"])) + "][_row_idx % 12 + 1]"})


def _phn8(spark, d):
    p = contacts(spark, d).withColumn("p", P.classified_phone(C("phone")))
    return p.select("id", F.coalesce("p.e164", "p.raw_input").alias("phone"), C("p.e164").alias("phone_e164"), C("p.line_type_tag").alias("phone_line_type"), F.array_join("p.tags", "|").alias("phone_tags"), F.lit(True).alias("_meta_phone_processed"))


query("phn8", f"SELECT id, {_SHOWN} AS phone, CAST(NULL AS VARCHAR) AS phone_e164, 'LINE_UNKNOWN' AS phone_line_type, {D.phone_tag('phone')} AS phone_tags, true AS _meta_phone_processed FROM contacts" if _NO_LIB else None)(_phn8)

# --- risk and sector --------------------------------------------------------------------------------------------------

query("rsk1", f"SELECT doc_id, {D.classify_text('text')} AS t FROM documents", False)(lambda spark, d: read(spark, d, "documents").select("doc_id", R.classify_text(C("text")).alias("t")))
query("rsk2", f"SELECT conv_id, turn, array_to_string({D.tokens('t')}, '|') AS t FROM (SELECT conv_id, turn, {D.classify_text('text')} AS t FROM conversations)", False)(lambda spark, d: read(spark, d, "conversations").select("conv_id", "turn", F.array_join(R.tokens(R.classify_text(C("text"))), "|").alias("t")))
over_contacts("rsk3", lambda: {"tld": R.tld(E.syntax(C("email"))["domain"])}, {"tld": D.tld(f"({_D})")})
query("rsk4", f"SELECT id, array_to_string(list_filter([CASE WHEN {D.trap(f'({_D})')} THEN 'SPAM_TRAP_MATCH' END, CASE WHEN {D.risky(f'({_D})')} THEN 'HIGH_RISK_TLD' END], lambda x: x IS NOT NULL), '|') AS tags, CASE WHEN {D.trap(f'({_D})')} THEN 60 ELSE 0 END + CASE WHEN {D.risky(f'({_D})')} THEN 20 ELSE 0 END AS points FROM contacts")(
    lambda spark, d: contacts(spark, d).select("id", F.array_join(R.domain_threats(E.syntax(C("email"))["domain"])[0], "|").alias("tags"), R.domain_threats(E.syntax(C("email"))["domain"])[1].alias("points"))
)
over_contacts("rsk5", lambda: {"bits": F.round(R.entropy(C("name")), 9)}, {"bits": f"round({D.entropy('name')}, 9)"})
over_contacts("rsk6", lambda: {"mash": R.keyboard_mash(C("name"))}, {"mash": D.mash("name")})
query("rsk7", f"SELECT id, {D.bot('name')} AS bot FROM contacts")(lambda spark, d: R.with_bot(contacts(spark, d), C("name"), "bot").select("id", "bot"))


def _rsk8(spark, d):
    return R.with_sector(contacts(spark, d).withColumn("domain", E.syntax(C("email"))["domain"]), C("company"), C("domain")).select("id", "sector", "confidence")


query("rsk8", D.sector_sql(f"(SELECT id, company, {_D} AS domain FROM contacts)", "company", "domain", "id"))(_rsk8)


def _scored(spark, d):
    v = verify.verify(contacts(spark, d), TENANT, mx(spark, d)).withColumn("domain", E.syntax(C("email"))["domain"])
    dummy = P.dummy_pattern(P.raw_digits(C("phone"))).isNotNull()
    return R.with_risk(v, C("domain"), {"disposable": C("is_disposable"), "role": C("is_role_based"), "catch_all": C("is_catch_all"), "dummy": dummy}, C("name"), C("company"))


_POINTS = [
    (D.trap("domain"), 60, "SPAM_TRAP_MATCH"), (D.risky("domain"), 20, "HIGH_RISK_TLD"), (D.disposable("domain"), 25, "DISPOSABLE_SIGNAL"), (f"(ok AND {D.role('local')})", 5, "ROLE_BASED_SIGNAL"),
    (f"{D.dummy('digits')} IS NOT NULL", 20, "DUMMY_PHONE_SIGNAL"), (f"({D.bot('name')} OR {D.bot('company')})", 30, "BOT_GENERATED_PATTERN"),
]
_RISK_SOURCE = f"(SELECT *, {_OK} AS ok, {_D} AS domain, {_L} AS local, {_DIGITS} AS digits FROM contacts)"
_SCORE = "CAST(least(100, " + " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n, _ in _POINTS) + ") AS INT)"
_RISK_TAGS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, _, t in _POINTS) + "], lambda x: x IS NOT NULL), '|')"
query("rsk9", f"SELECT id, {_SCORE} AS risk_score, {_RISK_TAGS} AS risk_tags FROM {_RISK_SOURCE}")(lambda spark, d: _scored(spark, d).select("id", "risk_score", F.array_join("risk_tags", "|").alias("risk_tags")))
query("rsk10", f"SELECT r.id, risk_score, risk_tags, sector AS industry_sector, confidence AS sector_confidence, true AS _meta_risk_evaluated FROM (SELECT id, {_SCORE} AS risk_score, {_RISK_TAGS} AS risk_tags FROM {_RISK_SOURCE}) r JOIN ({D.sector_sql(f'(SELECT id, company, {_D} AS domain FROM contacts)', 'company', 'domain', 'id')}) s ON r.id = s.id")(
    lambda spark, d: R.with_sector(_scored(spark, d), C("company"), C("domain")).select("id", "risk_score", F.array_join("risk_tags", "|").alias("risk_tags"), C("sector").alias("industry_sector"), C("confidence").alias("sector_confidence"), F.lit(True).alias("_meta_risk_evaluated"))
)

# --- rules ------------------------------------------------------------------------------------------------------------


def _rule_table(spark, d):
    """Orders under the rule language's field names."""
    o = read(spark, d, "orders")
    return o.select(C("o_orderkey").alias("id"), C("o_orderpriority").alias("sector"), C("o_totalprice").alias("risk_score"), F.when(C("o_orderkey") % 5 == 0, None).otherwise(C("o_orderstatus")).alias("line_type"), (C("o_custkey") % 2 == 0).alias("is_disposable"), C("o_totalprice").cast("long").cast("string").alias("phone"))


_ORDERS = "(SELECT o_orderkey AS id, o_orderpriority AS sector, o_totalprice AS risk_score, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS line_type, o_custkey % 2 = 0 AS is_disposable, CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) AS phone FROM orders)"


def is_(field: str, operator: str, value: object) -> dict:
    return {"type": "CONDITION", "field": field, "operator": operator, "value": value}


def _tests(name: str, tests: dict[str, tuple[dict, str]]) -> None:
    """A query of what each test says of each order."""

    def run(spark, d):
        t = _rule_table(spark, d)
        typed = rules._typed(t)
        return t.select("id", *(rules.condition(rules._node(raw, 0, [0]), typed).alias(n) for n, (raw, _) in tests.items()))

    query(name, "SELECT id, " + ", ".join(f"{sql} AS {n}" for n, (_, sql) in tests.items()) + f" FROM {_ORDERS}", False)(run)


_tests("rul1", {"a": (is_("line_type", "EQUALS", "F"), "line_type IS NOT DISTINCT FROM 'F'"), "b": (is_("line_type", "EQUALS", None), "line_type IS NULL"), "c": (is_("phone", "EQUALS", 5), "false"), "e": (is_("is_disposable", "EQUALS", 1), "is_disposable"), "f": (is_("email", "EQUALS", None), "true")})
_tests("rul2", {"a": (is_("line_type", "NOT_EQUALS", "F"), "line_type IS DISTINCT FROM 'F'"), "b": (is_("line_type", "NOT_EQUALS", None), "line_type IS NOT NULL")})
_tests("rul3", {"a": (is_("sector", "CONTAINS", "URG"), "contains(lower(sector), 'urg')"), "b": (is_("risk_score", "CONTAINS", "1"), "false"), "c": (is_("line_type", "CONTAINS", "f"), "coalesce(contains(lower(line_type), 'f'), false)")})
_tests("rul4", {"a": (is_("sector", "NOT_CONTAINS", "urg"), "NOT contains(lower(sector), 'urg')"), "b": (is_("line_type", "NOT_CONTAINS", "f"), "coalesce(NOT contains(lower(line_type), 'f'), true)")})
_tests("rul5", {"a": (is_("risk_score", "GREATER_THAN", 150000), "risk_score > 150000"), "b": (is_("phone", "GREATER_THAN", "99999.5"), "CAST(phone AS DOUBLE) > 99999.5"), "c": (is_("is_disposable", "GREATER_THAN", 0), "false"), "e": (is_("sector", "GREATER_THAN", 0), "false")})
_tests("rul6", {"a": (is_("risk_score", "LESS_THAN", 150000), "risk_score < 150000"), "b": (is_("phone", "LESS_THAN", 1e5), "CAST(phone AS DOUBLE) < 100000")})
_tests("rul7", {"a": (is_("line_type", "IN_LIST", ["F", None]), "line_type IS NULL OR line_type = 'F'"), "b": (is_("sector", "IN_LIST", ["1-URGENT", 3]), "sector = '1-URGENT'"), "c": (is_("line_type", "IN_LIST", []), "false")})
_tests("rul8", {"a": (is_("sector", "REGEX_MATCH", r"^[12]-\w+$"), r"regexp_matches(sector, '^[12]-\w+$')"), "b": (is_("line_type", "REGEX_MATCH", "F|O"), "coalesce(regexp_matches(line_type, 'F|O'), false)"), "c": (is_("risk_score", "REGEX_MATCH", "1"), "false"),
    # patterns that Java reads otherwise or not at all
    "d": (is_("sector", "REGEX_MATCH", r"^\d{,1}-(?P<word_1>[A-Z[&&]+)$"), r"regexp_matches(sector, '^\d{0,1}-[A-Z]+$')"), "e": (is_("sector", "REGEX_MATCH", r"^(1-)?(?(1)URGENT|.-LOW)\Z"), "sector IN ('1-URGENT', '5-LOW')"), "f": (is_("phone", "REGEX_MATCH", r"^(?#any)([0-9])\1"), "substr(phone, 1, 1) = substr(phone, 2, 1)"), "g": (is_("sector", "REGEX_MATCH", "{|}"), "false")})
_BOTH = {"type": "AND", "children": [is_("line_type", "EQUALS", "F"), {"type": "OR", "children": [is_("risk_score", "GREATER_THAN", 200000), {"type": "NOT", "child": is_("sector", "CONTAINS", "low")}]}]}
_tests("rul9", {"a": (_BOTH, "line_type IS NOT DISTINCT FROM 'F' AND (risk_score > 200000 OR NOT contains(lower(sector), 'low'))"), "b": ({"type": "NOT", "child": _BOTH}, "NOT (line_type IS NOT DISTINCT FROM 'F' AND (risk_score > 200000 OR NOT contains(lower(sector), 'low')))")})

RULES = [
    {"rule_id": "urgent", "condition": is_("sector", "EQUALS", "1-URGENT"), "actions": [{"action_type": "FLAG_RECORD", "value": "HOT"}, {"action_type": "ROUTE_TO_QUEUE", "queue_name": "first"}, {"action_type": "MASK_FIELD", "field": "phone"}]},
    {"rule_id": "masked", "condition": is_("phone", "CONTAINS", "*"), "actions": [{"action_type": "FLAG_RECORD", "value": 3}, {"action_type": "ROUTE_TO_QUEUE", "queue_name": "second"}]},
    {"rule_id": "low", "condition": is_("risk_score", "LESS_THAN", 20000), "actions": [{"action_type": "DROP_RECORD"}, {"action_type": "FLAG_RECORD", "value": "GONE"}]},
    {"rule_id": "bad field", "condition": is_("nothing", "EQUALS", 1), "actions": [{"action_type": "DROP_RECORD"}]},
    {"rule_id": "other", "condition": is_("line_type", "EQUALS", None), "actions": [{"action_type": "OVERWRITE_FIELD", "field": "line_type", "value": "NONE"}]},
]
_RULED = f"""SELECT id, sector, risk_score, is_disposable, CASE WHEN NOT low AND line_type IS NULL THEN 'NONE' ELSE line_type END AS line_type, CASE WHEN urgent THEN repeat('*', length(phone)) ELSE phone END AS phone,
  low AS is_dropped, array_to_string(list_filter([CASE WHEN urgent THEN 'HOT' END, CASE WHEN urgent THEN 'FLAGGED' END, CASE WHEN low THEN 'GONE' END], lambda x: x IS NOT NULL), '|') AS rule_flags,
  CASE WHEN urgent THEN 'second' END AS routed_queue, array_to_string(list_filter([CASE WHEN urgent THEN 'urgent' END, CASE WHEN urgent THEN 'masked' END, CASE WHEN low THEN 'low' END, CASE WHEN NOT low AND line_type IS NULL THEN 'other' END], lambda x: x IS NOT NULL), '|') AS matched_rule_ids
  FROM (SELECT *, sector = '1-URGENT' AS urgent, risk_score < 20000 AS low FROM {_ORDERS})"""


def _ruled(spark, d, keep):
    out = rules.run_rules(_rule_table(spark, d), RULES, TENANT, keep)
    return out.withColumns({c: F.array_join(c, "|") for c in ("rule_flags", "matched_rule_ids")}).drop("_meta_rules_evaluated")


query("rul10", f"SELECT id, is_dropped, rule_flags FROM ({_RULED})", False)(lambda spark, d: _ruled(spark, d, True).select("id", "is_dropped", "rule_flags"))
query("rul11", f"SELECT id, rule_flags FROM ({_RULED})", False)(lambda spark, d: _ruled(spark, d, True).select("id", "rule_flags"))
query("rul12", f"SELECT id, phone FROM ({_RULED})", False)(lambda spark, d: _ruled(spark, d, True).select("id", "phone"))
#: A text for a boolean field: the column becomes text.
_UNLIKE = {"rule_id": "unlike", "condition": is_("line_type", "EQUALS", "P"), "actions": [{"action_type": "OVERWRITE_FIELD", "field": "is_disposable", "value": "unknown"}]}
query("rul13", f"SELECT id, line_type, routed_queue, CASE WHEN NOT is_dropped AND line_type = 'P' THEN 'unknown' ELSE CAST(is_disposable AS VARCHAR) END AS is_disposable FROM ({_RULED})", False)(
    lambda spark, d: rules.run_rules(_rule_table(spark, d), [*RULES, _UNLIKE], TENANT, True).select("id", "line_type", "routed_queue", "is_disposable")
)


@query("rul14", "SELECT * FROM (VALUES ('^a+$', true), ('(a+)+', false), ('(a', false), ('a*b*c*d*e*', false), ('[', false), ('', false)) t(pattern, safe)", False)
def rul14(spark, d):
    return spark.createDataFrame([(p, rules.safe_pattern(p)) for p in ("^a+$", "(a+)+", "(a", "a*b*c*d*e*", "[", "")], "pattern string, safe boolean")


@query("rul15", "SELECT * FROM (VALUES ('urgent', 3), ('masked', 2), ('low', 2), ('other', 1)) t(rule_id, actions)", False)
def rul15(spark, d):
    return spark.createDataFrame([(r.rule_id, len(r.actions)) for r in rules.parse_rules(RULES)], "rule_id string, actions int")


query("rul16", f"SELECT * FROM ({_RULED}) WHERE NOT is_dropped", False)(lambda spark, d: _ruled(spark, d, False))

# --- joins, duplicates and similarity ---------------------------------------------------------------------------------


def _fps(spark, d):
    c = contacts(spark, d)
    return c.select("_row_idx", "id", "email", "name", *H.fingerprints(C("email"), C("phone"), F.lower(F.concat_ws(":", "name", "company")), KEY))


def _hm(x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN {D.hmac(x, KEY)} END"


_LATER = "email <> '' AND row_number() OVER (PARTITION BY email ORDER BY _row_idx) > 1"
query("jon1", "SELECT o_orderkey, l_suppkey, l_quantity FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_suppkey, {'n': l_linenumber, 's': l_suppkey, 'q': l_quantity}) AS l_suppkey, arg_max(l_quantity, {'n': l_linenumber, 's': l_suppkey, 'q': l_quantity}) AS l_quantity FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey) ON o_orderkey = l_orderkey", False)(
    lambda spark, d: relations.looked_up(read(spark, d, "orders").select("o_orderkey"), read(spark, d, "lineitem").where("l_returnflag <> 'R'").select(C("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_suppkey", "l_quantity"), "o_orderkey", "l_linenumber")
)
query("jon2", "SELECT c.id, x.c_name FROM (SELECT id, row_number() OVER (ORDER BY _row_idx) AS k FROM contacts) c FULL JOIN (SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS k FROM customer) x ON c.k = x.k")(
    lambda spark, d: relations.zipped(contacts(spark, d).select("_row_idx", "id"), read(spark, d, "customer").select("c_custkey", "c_name"), "_row_idx", "c_custkey").select("id", "c_name")
)
query("jon3", f"SELECT id FROM (SELECT id, coalesce({_LATER}, false) AS dup FROM contacts) WHERE NOT dup")(lambda spark, d: dedup.without_ids(contacts(spark, d), dedup.duplicate_ids(_fps(spark, d))).select("id"))
query("jon4", f"SELECT id, coalesce({_LATER}, false) AS is_duplicate FROM contacts")(lambda spark, d: relations.flagged(contacts(spark, d), dedup.duplicate_ids(_fps(spark, d))).select("id", "is_duplicate"))


def _parts(spark, d):
    """Parts in blocks by size, of names that differ little."""
    return read(spark, d, "part").select(C("p_partkey").alias("_row_idx"), C("p_partkey").cast("string").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("name"), F.concat_ws(":", C("p_size").cast("string"), "p_brand", (C("p_partkey") % 13).cast("string")).alias("block"))


_PAIRS = "(SELECT p_partkey AS k, p_name || ' ' || p_type AS name, concat_ws(':', CAST(p_size AS VARCHAR), p_brand, CAST(p_partkey % 13 AS VARCHAR)) AS block FROM part)"
query("jon5", f"SELECT CAST(a.k AS VARCHAR) AS id_a, CAST(b.k AS VARCHAR) AS id_b, round(jaro_winkler_similarity(lower(a.name), lower(b.name)), 6) AS score FROM {_PAIRS} a JOIN {_PAIRS} b ON a.block = b.block AND a.k < b.k WHERE jaro_winkler_similarity(lower(a.name), lower(b.name)) >= 0.9 AND length(a.name) BETWEEN 1 AND 200 AND length(b.name) BETWEEN 1 AND 200", False)(
    lambda spark, d: dedup.similar_pairs(_parts(spark, d), size=None).withColumn("score", F.round("score", 6))
)
over_contacts("jon6", lambda: {"known": E.syntax(C("email"))["domain"].isin(*V.DISPOSABLE, *V.SPAM_TRAPS)}, {"known": f"({_D}) IN {D.listed([*V.DISPOSABLE, *V.SPAM_TRAPS])}"})
over_contacts("dup2", lambda: {"fp": H.fingerprint(C("id"), KEY)}, {"fp": D.hmac("id", KEY)})
over_contacts("dup3", lambda: {"same": H.fingerprint(C("name"), KEY) == H.fingerprint(F.trim("name"), KEY)}, {"same": "name = trim(name)"})
query("dup4", f"SELECT id, {_hm('email')} AS email_fp, {_hm('phone')} AS phone_fp, {_hm(chr(40) + 'lower(concat_ws(chr(58), name, company))' + chr(41))} AS composite_fp FROM contacts")(lambda spark, d: _fps(spark, d).select("id", "email_fp", "phone_fp", "composite_fp"))
_GROUPS = f"SELECT {D.hmac('email', KEY)} AS email_fp, string_agg(id, '|' ORDER BY _row_idx) AS ids FROM contacts WHERE email <> '' GROUP BY email HAVING count(*) > 1"
query("dup5", _GROUPS)(lambda spark, d: dedup.duplicate_groups(_fps(spark, d)).select("email_fp", F.array_join("ids", "|").alias("ids")))
query("dup6", f"SELECT id, {_hm('email')} AS _hmac_fingerprint, coalesce({_LATER}, false) AS is_duplicate, true AS _meta_deduped FROM contacts")(lambda spark, d: dedup.flag_duplicates(contacts(spark, d), KEY).select("id", "_hmac_fingerprint", "is_duplicate", "_meta_deduped"))
_NEXT = "(SELECT p_partkey AS k, lower(p_name) AS a, lower(p_type) AS b FROM part)"


def _names(spark, d):
    return read(spark, d, "part").select(C("p_partkey").alias("k"), F.lower("p_name").alias("a"), F.lower("p_type").alias("b"))


query("dup7", f"SELECT k, round(jaro_similarity(a, b), 6) AS s FROM {_NEXT}", False)(lambda spark, d: _names(spark, d).select("k", F.round(S.jaro(C("a"), C("b")), 6).alias("s")))
query("dup8", "SELECT p_partkey AS k, round(jaro_winkler_similarity(p_name, p_name || p_brand), 6) AS s FROM part", False)(lambda spark, d: read(spark, d, "part").select(C("p_partkey").alias("k"), F.round(S.jaro_winkler(C("p_name"), F.concat("p_name", "p_brand")), 6).alias("s")))
query("dup9", "SELECT p_partkey AS k, CASE WHEN jaro_winkler_similarity(lower(p_name), lower(p_name || p_size)) >= 0.9 THEN round(jaro_winkler_similarity(lower(p_name), lower(p_name || p_size)), 6) END AS s FROM part", False)(lambda spark, d: read(spark, d, "part").select(C("p_partkey").alias("k"), F.round(S.fuzzy_names(C("p_name"), F.concat("p_name", C("p_size").cast("string"))), 6).alias("s")))
query("dup10", f"SELECT p_partkey AS k, {D.soundex('p_name')} AS s FROM part", False)(lambda spark, d: read(spark, d, "part").select(C("p_partkey").alias("k"), S.soundex(C("p_name")).alias("s")))
_BLOCKED = f"SELECT c_custkey AS _row_idx, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY c_custkey) <= 500 THEN k ELSE '_overflow' END AS block FROM (SELECT c_custkey, coalesce({D.soundex('c_name')}, '_UNKNOWN') AS k FROM customer)"
_customers = lambda spark, d: read(spark, d, "customer").select(C("c_custkey").alias("_row_idx"), C("c_name").alias("name"))
query("dup11", _BLOCKED, False)(lambda spark, d: dedup.blocks(_customers(spark, d)).select("_row_idx", "block"))

# --- aggregations, windows, limits ------------------------------------------------------------------------------------

_FIELDS = ["o_orderstatus", "o_orderpriority"]
_COUNTS = " UNION ALL ".join(f"SELECT '{f}' AS field, coalesce(CAST({f} AS VARCHAR), 'None') AS value, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY {f}" for f in _FIELDS)
query("agg1", _COUNTS, False)(lambda spark, d: summary.value_counts(read(spark, d, "orders"), _FIELDS, "o_orderkey"))
query("agg2", f"SELECT field, CASE WHEN max(total) <= 5 THEN 'pie' ELSE 'bar' END AS chart_type, string_agg(value, '|' ORDER BY first, value) AS labels, string_agg(CAST(n AS VARCHAR), '|' ORDER BY first, value) AS data FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY first, value) AS r, count(*) OVER (PARTITION BY field) AS total FROM ({_COUNTS})) WHERE r <= 10 GROUP BY field", False)(
    lambda spark, d: summary.charts(read(spark, d, "orders"), _FIELDS, "o_orderkey").select("field", "chart_type", F.array_join("labels", "|").alias("labels"), F.array_join(F.transform("data", lambda x: x.cast("string")), "|").alias("data"))
)


@query("agg3", "SELECT count(*) AS total_records, 'o_orderkey|o_custkey|o_totalprice' AS numeric_fields, 'o_orderstatus|o_orderdate|o_orderpriority' AS categorical_fields FROM orders", False)
def agg3(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    number, other = summary.field_kinds(o)
    return o.agg(F.count("*").alias("total_records")).withColumns({"numeric_fields": F.lit("|".join(number)), "categorical_fields": F.lit("|".join(other))})


_AUDIT = f"SELECT count(*) AS total_records_ingested, count(*) FILTER ({D.email_valid('email')}) AS valid_email_syntax_count, count(*) FILTER ({_FIXED}) AS typo_corrections_applied, 0::BIGINT AS homoglyph_threats_flagged, 0::BIGINT AS processing_errors_caught FROM contacts"
_fields6 = lambda spark, d: contacts(spark, d).select("_row_idx", "id", "email", "name", "phone", "address", "company", "bio")
query("agg4", _AUDIT)(lambda spark, d: classify.normalize_table(_fields6(spark, d), TENANT, "_row_idx")[1])


@query("agg7", f"WITH {D.merkle('SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, sha256(c_name) AS h FROM customer')} SELECT h AS root FROM m20", False)
def agg7(spark, d):
    leaf = tables.with_order(read(spark, d, "customer").select(C("c_custkey").alias("k"), F.sha2("c_name", 256).alias("leaf")), "k").select(C("_row_idx").alias("idx"), "leaf")
    return spark.createDataFrame([(H.merkle_root(leaf),)], "root string")


query("agg8", _GROUPS)(QUERIES["dup5"])
query("agg9", "SELECT o_custkey, count(*) AS credits_used, 1000 - count(*) AS credits_remaining FROM orders GROUP BY o_custkey", False)(lambda spark, d: billing.usage(read(spark, d, "orders").withColumn("n", F.lit(1)), "o_custkey", "n", F.lit(1000)))
query("agg10", "SELECT tenant_id, count(*) AS n FROM contacts GROUP BY tenant_id")(lambda spark, d: contacts(spark, d).groupBy("tenant_id").agg(F.count("*").alias("n")))
query("win1", f"SELECT id, coalesce({_LATER}, false) AS is_duplicate FROM contacts")(lambda spark, d: dedup.keep_first(contacts(spark, d), F.nullif(C("email"), F.lit(""))).select("id", "is_duplicate"))
_BURST = "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 20 AS is_throttled, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 20 THEN 'RATE_LIMIT_EXCEEDED' ELSE 'ALLOWED' END AS throttle_tag FROM events"
query("win2", _BURST, False)(lambda spark, d: throttle.throttle_burst(read(spark, d, "events"), "user_id", "event_id", 20).select("event_id", "is_throttled", "throttle_tag"))


@query("win3", "SELECT 1::BIGINT AS seq, true AS linked UNION ALL SELECT 2, true UNION ALL SELECT 3, true", False)
def win3(spark, d):
    from pyspark.sql.window import Window

    entries, before = [], None
    for k in range(3):
        _, e = compliance.audit(contacts(spark, d).where(C("_row_idx") % 3 == k), TENANT, PEPPER, batch_id=f"b{k}", previous=before, timestamp=float(k))
        entries, before = [*entries, asdict(e)], e.chain_hash
    t = spark.createDataFrame([(k + 1, e["prev_chain_hash"], e["chain_hash"]) for k, e in enumerate(entries)], "seq long, prev string, hash string")
    return t.select("seq", (C("prev") == F.coalesce(F.lag("hash").over(Window.orderBy("seq")), F.lit(H.genesis(TENANT, PEPPER)))).alias("linked"))


query("win4", f"SELECT block, count(*) AS n FROM ({_BLOCKED}) GROUP BY block", False)(lambda spark, d: dedup.blocks(_customers(spark, d)).groupBy("block").agg(F.count("*").alias("n")))
query("win5", f"SELECT id, array_to_string(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), '|') AS pairs FROM (SELECT id, {D.tokens('s')} AS t FROM (SELECT id, {D.classify_text('company')} AS s FROM contacts))")(
    lambda spark, d: contacts(spark, d).select("id", R.tokens(R.classify_text(C("company"))).alias("t")).select("id", F.array_join(F.when(F.size("t") >= 2, F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.array_join(F.slice("t", i, 2), " "))).otherwise(F.array().cast("array<string>")), "|").alias("pairs"))
)
over_contacts("win6", lambda: {"mash": R.keyboard_mash(C("company"))}, {"mash": D.mash("company")})
query("srt1", "SELECT l_orderkey, arg_min(l_suppkey, {'n': l_linenumber, 's': l_suppkey}) AS l_suppkey FROM lineitem GROUP BY l_orderkey", False)(lambda spark, d: relations.least(read(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_linenumber"))
query("srt2", "SELECT l_orderkey, arg_max(l_linenumber, {'q': l_quantity, 'f': -l_linenumber}) AS l_linenumber FROM lineitem GROUP BY l_orderkey", False)(lambda spark, d: relations.best(read(spark, d, "lineitem"), "l_orderkey", "l_linenumber", C("l_quantity"), "l_linenumber"))
query("srt3", "SELECT id, to_json({'a': email, 'b': id}) AS j FROM contacts")(lambda spark, d: contacts(spark, d).select("id", relations.sorted_json(b=C("id"), a=C("email")).alias("j")))
query("lim1", "SELECT * FROM (SELECT field, CAST(row_number() OVER (PARTITION BY field ORDER BY _row_idx) AS INT) AS place, value FROM (SELECT _row_idx, 'phone' AS field, phone AS value FROM contacts UNION ALL SELECT _row_idx, 'email', email FROM contacts UNION ALL SELECT _row_idx, 'company', company FROM contacts) WHERE value IS NOT NULL) WHERE place <= 10")(
    lambda spark, d: relations.first_values(contacts(spark, d), ["phone", "email", "company"], "_row_idx")
)
query("lim2", "SELECT _row_idx, id FROM contacts ORDER BY _row_idx LIMIT 2")(lambda spark, d: billing.gated(contacts(spark, d), False, "_row_idx").select("_row_idx", "id"))
query("set1", "SELECT n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_name, NULL FROM region", False)(lambda spark, d: relations.stacked(read(spark, d, "nation").select(C("n_name").alias("name"), C("n_regionkey").alias("region")), read(spark, d, "region").select(C("r_name").alias("name"))))


@query("cls1", "SELECT * FROM (VALUES ('id', 'GENERIC'), ('email', 'EMAIL'), ('name', 'NAME'), ('phone', 'PHONE'), ('address', 'ADDRESS'), ('company', 'COMPANY'), ('bio', 'BIO')) t(field, class)", False)
def cls1(spark, d):
    return spark.createDataFrame(list(classify.classify(_fields6(spark, d), "_row_idx").items()), "field string, class string")


_CLEAN = f"SELECT _row_idx, id, coalesce({D.normalized_email('email')}, '') AS email, trim(concat_ws(' ', {D.first_name(_PARTS)}, {D.last_name(_PARTS)})) AS name, {D.phone('phone')} AS phone, {D.address('address')} AS address, {D.company('company')} AS company, {D.sanitized('bio')} AS bio FROM contacts"
query("cls2", _CLEAN)(lambda spark, d: classify.normalize_table(_fields6(spark, d), TENANT, "_row_idx")[0])
query("cls3", f"SELECT id, {D.normalized_email('email')} AS email, {D.first_name(_PARTS)} AS first_name, {D.phone('phone')} AS phone, {D.company('company')} AS company, 0 AS errors FROM contacts")(
    lambda spark, d: classify.with_record(contacts(spark, d), {x: C(x) for x in PL.FIELDS}).select("id", C("email_result.normalized").alias("email"), "parsed_name.first_name", C("clean_phone").alias("phone"), C("clean_company").alias("company"), F.size("errors").alias("errors"))
)

# --- compliance -------------------------------------------------------------------------------------------------------

over_contacts("cmp1", lambda: {"p": H.fingerprint(F.lower(F.trim("name")), KEY)}, {"p": D.hmac("lower(trim(name))", KEY)})
_SAFE = f"CASE WHEN phone <> '' THEN {D.hmac('lower(trim(phone))', KEY)} ELSE phone END"


def _protected(spark, d):
    return compliance.protected(contacts(spark, d).select("id", "email", "name", "phone"), KEY, ("email", "bio"), ("phone", "email"))


query(
    "cmp2",
    f"SELECT id, CASE WHEN email <> '' THEN '[REDACTED]' ELSE email END AS email, name, {_SAFE} AS phone, CASE WHEN email <> '' THEN 'email' ELSE '' END AS redacted_fields, CASE WHEN phone <> '' THEN 'phone' ELSE '' END AS pseudonymized_fields, "
    "array_to_string(list_filter(['bio', CASE WHEN coalesce(email, '') = '' THEN 'email' END, 'email', CASE WHEN coalesce(phone, '') = '' THEN 'phone' END], lambda x: x IS NOT NULL), '|') AS failed_fields FROM contacts",
)(lambda spark, d: _protected(spark, d).withColumns({c: F.array_join(c, "|") for c in ("redacted_fields", "pseudonymized_fields", "failed_fields")}))
query("cmp3", f"SELECT id, CASE WHEN email <> '' THEN 'REDACTED' END AS email_hash, {D.hmac('lower(trim(name))', KEY)} AS name_hash, CASE WHEN phone <> '' THEN {D.hmac('(' + D.hmac('lower(trim(phone))', KEY) + ')', KEY)} END AS phone_hash FROM contacts")(
    lambda spark, d: (p := _protected(spark, d)).select("id", *compliance.safe_projection(p.select("id", "email", "name", "phone"), KEY))
)
_HASHED = D.json_text({f"{f}_hash": f"CASE WHEN {f} <> '' THEN {D.hmac(f'lower(trim({f}))', KEY)} END" for f in ("address", "email", "name", "phone")})
_LEAVES = f"SELECT row_number() OVER (ORDER BY _row_idx) - 1 AS i, sha256({_HASHED}) AS h FROM contacts"
query("cmp4", f"SELECT i AS idx, h AS leaf FROM ({_LEAVES})")(lambda spark, d: compliance.leaves(contacts(spark, d), KEY))


_GENESIS = H.genesis(TENANT, PEPPER)
_BODY = (
    f"""'{{"action_type":"DATA_NORMALIZATION","batch_id":"b","payload_merkle_root":"' || h || '","prev_chain_hash":"{_GENESIS}","record_count":' || CAST(n AS VARCHAR) || ',"schema_version":1,"tenant_id":"{TENANT}","timestamp":0.0}}{_GENESIS}'"""
)
SQL["cmp5"] = (
    f"WITH contacts AS ({CONTACTS}), {D.merkle(_LEAVES)} SELECT 1 AS schema_version, CAST(0 AS DOUBLE) AS timestamp, '{TENANT}' AS tenant_id, 'b' AS batch_id, 'DATA_NORMALIZATION' AS action_type, n AS record_count, "
    f"h AS payload_merkle_root, '{_GENESIS}' AS prev_chain_hash, sha256({_BODY}) AS chain_hash FROM m20, (SELECT count(*) AS n FROM contacts)"
)


@query("cmp5")
def cmp5(spark, d):
    out, e = compliance.audit(contacts(spark, d), TENANT, PEPPER, batch_id="b", timestamp=0.0)
    return spark.createDataFrame([tuple(asdict(e).values())], "schema_version int, timestamp double, tenant_id string, batch_id string, action_type string, record_count long, payload_merkle_root string, prev_chain_hash string, chain_hash string")


@query("cmp6", "SELECT * FROM (VALUES ('whole', true, -1), ('changed', false, 0)) t(chain, fine, position)", False)
def cmp6(spark, d):
    _, e = compliance.audit(contacts(spark, d), TENANT, PEPPER, batch_id="b", timestamp=0.0)
    bad = compliance.AuditEntry(**(asdict(e) | {"record_count": e.record_count + 1}))
    rows = [(n, *compliance.verify_chain(c, TENANT, PEPPER)) for n, c in (("whole", [e]), ("changed", [bad]))]
    return spark.createDataFrame([(n, f, -1 if k is None else k) for n, f, k in rows], "chain string, fine boolean, position int")


query("cmp7", f"SELECT id, CASE WHEN email <> '' THEN '[REDACTED]' ELSE email END AS email, {_SAFE} AS phone, 'b' AS _audit_batch_id, true AS _meta_compliance_audited FROM contacts")(
    lambda spark, d: compliance.audit(contacts(spark, d), TENANT, PEPPER, batch_id="b", timestamp=0.0, redact=("email",), pseudonymize=("phone",))[0].select("id", "email", "phone", "_audit_batch_id", "_meta_compliance_audited")
)

# --- state, billing, workflow -----------------------------------------------------------------------------------------

query("str1", "SELECT event_id, least(60.0, value + greatest(0.0, CAST(event_id % 7 - 3 AS DOUBLE)) * 2.0) AS tokens FROM events", False)(lambda spark, d: read(spark, d, "events").select("event_id", throttle.refilled(C("value"), F.lit(0.0), (C("event_id") % 7 - 3).cast("double"), F.lit(60.0), F.lit(2.0)).alias("tokens")))
_TIMED = """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT event_id, user_id, now, k, CAST(2 AS DOUBLE) AS t FROM e WHERE k = 1 UNION ALL
  SELECT e.event_id, e.user_id, e.now, e.k, least(CAST(2 AS DOUBLE), r.t - CASE WHEN r.t >= 1 THEN 1 ELSE 0 END + greatest(CAST(0 AS DOUBLE), e.now - r.now) * (CAST(1 AS DOUBLE) / 90000)) FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT event_id, t < 1 AS is_throttled, CASE WHEN t < 1 THEN 'RATE_LIMIT_EXCEEDED' ELSE 'ALLOWED' END AS throttle_tag FROM r
"""
query("str2", _TIMED, False)(lambda spark, d: throttle.throttle_timed(read(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 2.0, 1 / 90000).select("event_id", "is_throttled", "throttle_tag"))


@query("str2_stream", _TIMED, False)
def str2_stream(spark, d):
    """The same records as a stream of one micro-batch, with state in RocksDB."""
    conf, key = spark.conf, "spark.sql.streaming.stateStore.providerClass"
    old = conf.get(key, None)
    conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        read(spark, d, "events").select(C("user_id").cast("string").alias("tenant"), "event_id", "ts").write.parquet(source := new_path(spark, "str2-in"))
        rows = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        out = throttled_stream(rows, 2.0, 1 / 90000, None).writeStream.format("parquet").option("path", path := new_path(spark, "str2-out")).option("checkpointLocation", new_path(spark, "str2-state")).trigger(availableNow=True).start()
        out.awaitTermination()
    finally:
        conf.set(key, old) if old else conf.unset(key)
    return spark.read.parquet(path).select("event_id", (~C("allowed")).alias("is_throttled"), F.when(C("allowed"), "ALLOWED").otherwise("RATE_LIMIT_EXCEEDED").alias("throttle_tag"))


@query("str3", "SELECT * FROM (VALUES (0, true, 'CLOSED'), (1, false, 'OPEN'), (2, true, 'HALF_OPEN'), (3, false, 'HALF_OPEN'), (4, true, 'CLOSED')) t(step, allowed, state)", False)
def str3(spark, d):
    now = [0.0]
    b, rows = throttle.Breaker(lambda: now[0]), []

    def step():
        rows.append((len(rows), b.allow()[0], b.state))

    step()
    for _ in range(5):
        b.failure()
    step()
    now[0] = 31.0
    step()
    step()
    b.success()
    step()
    return spark.createDataFrame(rows, "step int, allowed boolean, state string")


_LOAD = "CAST(event_id % 6000 AS BIGINT) AS q, CAST(event_id % 1100 AS DOUBLE) - 1 AS m"
query("str7", f"SELECT event_id, CASE WHEN q >= 0 AND m >= 0 AND q < 5000 AND m < 1024 THEN 'ALLOWED' ELSE 'RESOURCE_THROTTLED' END AS tag FROM (SELECT event_id, {_LOAD} FROM events)", False)(lambda spark, d: read(spark, d, "events").select("event_id", throttle.backpressure(C("event_id") % 6000, (C("event_id") % 1100).cast("double") - 1).alias("tag")))
query("str8", "SELECT id, false AS is_throttled, 'ALLOWED' AS throttle_tag FROM (SELECT id FROM contacts ORDER BY _row_idx LIMIT 60)")(lambda spark, d: throttle.gate(contacts(spark, d), TENANT, "_row_idx").select("id", "is_throttled", "throttle_tag"))


@query("mtr2", "SELECT * FROM (VALUES (0, true, 400, 'APPROVED'), (1, false, 400, 'INSUFFICIENT_CREDITS')) t(step, billing_approved, credits_remaining, status)", False)
def mtr2(spark, d):
    c = billing.Credits()
    rows = [(k, r["billing_approved"], r["credits_remaining"], r["status"]) for k, r in enumerate([c.bill("t", 600), c.bill("t", 500)])]
    return spark.createDataFrame(rows, "step int, billing_approved boolean, credits_remaining int, status string")


_PRICE = "greatest(n / 1000.0 * 5.0, 2.0)"
_CODE = "CASE k % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'INR' ELSE 'JPY' END"
query("prc1", f"SELECT k, n, round(CAST({_PRICE} AS DOUBLE), 2) AS total_amount, {_CODE} AS currency, CASE k % 3 WHEN 0 THEN '$' WHEN 1 THEN '₹' ELSE 'JPY ' END || format('{{:,.2f}}', round(CAST({_PRICE} AS DOUBLE), 2)) AS formatted_price FROM (SELECT o_custkey AS k, count(*) * 100 AS n FROM orders GROUP BY 1)", False)(
    lambda spark, d: billing.invoices(read(spark, d, "orders").groupBy(C("o_custkey").alias("k")).agg((F.count("*") * 100).alias("n")), "n", F.when(C("k") % 3 == 0, "usd").when(C("k") % 3 == 1, "inr").otherwise("jpy"))
)
query("prc3", "SELECT _row_idx, id FROM contacts ORDER BY _row_idx LIMIT 2")(QUERIES["lim2"])


@query("wfl1", "SELECT tenant_id, records_count, status FROM (VALUES ('b', 20, 'PENDING_ADMIN_APPROVAL')) t(tenant_id, records_count, status)", False)
def wfl1(spark, d):
    jobs = billing.Jobs()
    a, b, c = (jobs.create(t, n) for t, n in (("a", 10), ("b", 5), ("c", 7)))
    jobs.approve(a), jobs.update(b, 20), jobs.reject(c)
    return billing.pending(jobs.table(spark)).select("tenant_id", "records_count", "status")


query("dup1", f"SELECT 'acme' AS tenant, {D.hmac(D.q(TENANT), PEPPER)} AS key", False)(lambda spark, d: spark.createDataFrame([(TENANT, H.tenant_key(TENANT, PEPPER).hex())], "tenant string, key string"))
query("sup5", "SELECT c_custkey, sha256(c_name) AS h FROM customer", False)(lambda spark, d: read(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("h")))


@query("str4", "SELECT 200 AS known, true AS same, true AS none_beyond", False)
def str4(spark, d):
    b = throttle.Breakers()
    found = [b.get(f"s{k}") for k in range(throttle.BREAKER_SERVICES + 1)]
    return spark.createDataFrame([(sum(x is not None for x in found), b.get("s0") is found[0], found[-1] is None)], "known int, same boolean, none_beyond boolean")


@query("str5", "SELECT CAST(k AS INT) AS attempt, true AS within FROM range(-1, 12) t(k)", False)
def str5(spark, d):
    return spark.createDataFrame([(k, 0 <= throttle.backoff(k) <= min(30.0, 0.5 * 2 ** max(0, k))) for k in range(-1, 12)], "attempt int, within boolean")


@query("str6", "SELECT * FROM (VALUES ('works', true, 1), ('third time', true, 3), ('never', false, 4)) t(operation, fine, attempts)", False)
def str6(spark, d):
    tries = iter([0, 0, 1])
    runs = {"works": lambda: 1, "third time": lambda: 1 / next(tries), "never": lambda: 1 / 0}
    done = {n: throttle.retry(f, 4, lambda s: None) for n, f in runs.items()}
    return spark.createDataFrame([(n, r[0], r[2]) for n, r in done.items()], "operation string, fine boolean, attempts int")


@query("mtr1", "SELECT * FROM (VALUES ('FREE', true, 0), ('FREE', false, 0), ('ENTERPRISE', true, -1)) t(tier, approved, remaining)", False)
def mtr1(spark, d):
    c = billing.Credits()
    c.account("e", "ENTERPRISE")
    rows = [("FREE", *c.deduct("f", 1000)), ("FREE", *c.deduct("f", 1)), ("ENTERPRISE", *c.deduct("e", 1_000_001))]
    return spark.createDataFrame(rows, "tier string, approved boolean, remaining int")


@query("prc2", "SELECT CAST(7.5 AS DOUBLE) AS rate, 'EUR' AS currency, '€7.50' AS price", False)
def prc2(spark, d):
    p = billing.Prices().updated(rate_per_1000=7.5, currency="EUR", minimum_fee=None, nonsense=1)
    return spark.createDataFrame([(p.rate_per_1000, p.currency, billing.invoice(1000, p)["formatted_price"])], "rate double, currency string, price string")


@query("lim3", "SELECT true AS refused", False)
def lim3(spark, d):
    many = spark.range(PL.BATCH_LIMIT + 1).select(C("id").alias("_row_idx"), C("id").cast("string").alias("id"))
    try:
        PL.run(many, _options(True))
    except ValueError:
        return spark.createDataFrame([(True,)], "refused boolean")
    return spark.createDataFrame([(False,)], "refused boolean")


# --- the pipeline -----------------------------------------------------------------------------------------------------

PIPELINE_RULES = [
    {"rule_id": "traps", "condition": is_("email_domain", "EQUALS", "spamtrap-example.com"), "actions": [{"action_type": "DROP_RECORD"}]},
    {"rule_id": "risky", "condition": is_("risk_score", "GREATER_THAN", 29), "actions": [{"action_type": "FLAG_RECORD", "value": "REVIEW"}, {"action_type": "ROUTE_TO_QUEUE", "queue_name": "review"}]},
]


def _options(strict: bool = False, tokens: int = 1_000_000, limit: int | None = PL.BATCH_LIMIT) -> PL.Options:
    return PL.Options(TENANT, PEPPER, PIPELINE_RULES, tokens=tokens, strict=strict, limit=limit, batch_id="b")


_NORM = f"(SELECT _row_idx, id AS record_id, {D.normalized_email('email')} AS email, nullif({D.phone('phone')}, '') AS phone, nullif({D.company('company')}, '') AS company, nullif(concat_ws(' ', nullif({D.first_name(_PARTS)}, ''), nullif({D.last_name(_PARTS)}, '')), '') AS contact_name FROM contacts)"
_NODUP = f"(SELECT *, coalesce(email IS NOT NULL AND row_number() OVER (PARTITION BY email ORDER BY _row_idx) > 1, false) AS dup, split_part(email, '@', 2) AS domain, {D.local_of('email')} AS local, {D.syntax_ok('email')} AS ok, {D.raw_digits('phone')} AS digits FROM {_NORM})"


def _flow_score(strict: bool) -> str:
    name, company = "coalesce(contact_name, '')", "coalesce(company, '')"
    parts = [(D.trap("domain"), 60), (D.risky("domain"), 20), (D.disposable("domain"), 25), (f"(ok AND {D.role('local')})", 5), (f"({D.bot(name)} OR {D.bot(company)})", 30)]
    return "CAST(least(100, " + " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in parts) + ") AS INT)"


def _flow(strict: bool) -> str:
    return f"(SELECT *, {_flow_score(strict)} AS risk_score, coalesce(domain = 'spamtrap-example.com', false) AS dropped, CASE WHEN ok AND NOT {D.disposable('domain')} THEN {mx_tag('domain')} ELSE 'VALID_SYNTAX' END AS mx FROM {_NODUP})"


_REVIEW = "risk_score > 29"
query("pipeline_contacts", f"SELECT record_id, email, phone, company, risk_score, CASE WHEN {_REVIEW} THEN 'REVIEW' ELSE '' END AS rule_flags, CASE WHEN {_REVIEW} THEN 'review' END AS routed_queue, mx NOT IN ('NO_MX_RECORD', 'DNS_ERROR') AS has_mx_records, 'b' AS _audit_batch_id FROM {_flow(False)} WHERE NOT dup AND NOT dropped" if _NO_LIB else None)(
    lambda spark, d: PL.run(contacts(spark, d), _options(), mx(spark, d)).clean.select("record_id", "email", "phone", "company", "risk_score", F.array_join("rule_flags", "|").alias("rule_flags"), "routed_queue", "has_mx_records", "_audit_batch_id")
)
_N = "count(*) FILTER"
query(
    "agg5",
    f"SELECT count(*) AS total_records, least({_N} (NOT dup AND NOT dropped), 200) AS clean_records_count, {_N} (dup) AS duplicates_removed, {_N} (NOT dup AND NOT ok) AS invalid_emails, {_N} (NOT dup AND phone IS NULL) AS invalid_phones, "
    f"{_N} (NOT dup AND risk_score >= 70) AS high_risk_flags, {_N} (NOT dup AND dropped) AS dropped_via_rules, greatest({_N} (NOT dup AND NOT dropped) - 200, 0) AS throttled_count, 0::BIGINT AS dlq_count FROM {_flow(False)}" if _NO_LIB else None,
)(lambda spark, d: PL.run(contacts(spark, d), _options(tokens=200), mx(spark, d)).report.drop("processing_time_ms"))
query("agg6", "SELECT count(*) AS total_records, count(*) AS accounted, true AS balanced FROM contacts")(lambda spark, d: PL.reconciled(PL.run(contacts(spark, d), _options(tokens=200), mx(spark, d)).report))
query("pipeline_strict", f"SELECT record_id, email, risk_score, CASE WHEN NOT dropped THEN CASE WHEN {_REVIEW} THEN 'REVIEW' ELSE '' END END AS rule_flags, mx NOT IN ('NO_MX_RECORD', 'DNS_ERROR') AS email_valid_syntax FROM {_flow(True)} WHERE NOT dup" if _NO_LIB else None)(
    lambda spark, d: PL.run(contacts(spark, d), _options(True, limit=None), mx(spark, d)).clean.select("record_id", "email", "risk_score", F.array_join("rule_flags", "|").alias("rule_flags"), "email_valid_syntax")
)
_REPORT = (
    f"count(*) AS total_records, {_N} (NOT dup AND NOT dropped) AS clean_records_count, {_N} (dup) AS duplicates_removed, {_N} (NOT dup AND NOT ok) AS invalid_emails, {_N} (NOT dup AND phone IS NULL) AS invalid_phones, "
    f"{_N} (NOT dup AND risk_score >= 70) AS high_risk_flags, {_N} (NOT dup AND dropped) AS dropped_via_rules, 0::BIGINT AS throttled_count, 0::BIGINT AS dlq_count"
)
query("snk6", f"SELECT '{TENANT}' AS tenant_id, 'HUBSPOT' AS export_target, {_N} (NOT dup AND NOT dropped) AS records_exported_count, 'READY_FOR_DELIVERY' AS export_status, {_REPORT}, 'success' AS status, 'FREE' AS billing_tier, 400 AS billing_records_billed, 600 AS billing_credits_remaining, true AS billing_billing_approved, 'APPROVED' AS billing_status FROM {_flow(False)}" if _NO_LIB else None)(
    lambda spark, d: PL.response(PL.run(contacts(spark, d), _options(), mx(spark, d)), TENANT, "HUBSPOT", billing.Credits().bill(TENANT, 400))[1]
)
