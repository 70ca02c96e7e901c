"""Vocabularies and limits of the contact-data operators."""

from __future__ import annotations

from dataclasses import dataclass

# Longest field text, by kind of field.
LIMITS = {"email": 320, "name": 100, "phone": 32, "address": 300, "company": 200, "bio": 2000, "generic": 500}

# Mail providers that misspelt domains are compared with, in order, and known misspellings.
PROVIDERS = ("gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com", "aol.com", "protonmail.com", "live.com", "msn.com", "zoho.com")
TYPOS = {
    "gamil.com": "gmail.com", "gmial.com": "gmail.com", "gmai.com": "gmail.com", "gmail.co": "gmail.com", "gmail.cm": "gmail.com",
    "yaho.com": "yahoo.com", "yahho.com": "yahoo.com", "yahoo.co": "yahoo.com",
    "hotmal.com": "hotmail.com", "hotmial.com": "hotmail.com",
    "outlok.com": "outlook.com", "outllook.com": "outlook.com",
}
TYPO_RATIO = 0.86
# Letters that look like Latin ones.
CONFUSABLES = "аеорсухіѕјԁɡαορτυ"
# Forms of address.
SALUTATIONS = ("mr", "mrs", "ms", "miss", "dr", "prof", "sir", "madam", "rev")
# Fixed value: the accepted form of an e-mail address.
EMAIL_PATTERN = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?){1,8}$"

# Throw-away mail domains and role names.
DISPOSABLE = (
    "10minutemail.com", "guerrillamail.com", "tempmail.com", "temp-mail.org", "mailinator.com", "throwawaymail.com", "yopmail.com", "fakeinbox.com",
    "getnada.com", "trashmail.com", "sharklasers.com", "dispostable.com", "maildrop.cc", "mintemail.com", "mohmal.com", "spamgourmet.com",
)
ROLES = (
    "admin", "administrator", "info", "sales", "support", "billing", "jobs", "careers", "hr", "contact", "help", "office", "noreply", "no-reply",
    "webmaster", "postmaster", "marketing", "abuse", "security",
)

# Risky top-level domains, spam traps, keyboard rows.
RISKY_TLDS = ("xyz", "top", "tk", "work", "click", "gq", "cf", "ml", "loan", "racing", "review", "download", "stream", "win", "bid", "party")
SPAM_TRAPS = ("spamtrap-example.com", "honeypot-test.net", "trap-domain.org")
KEYBOARD_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
ENTROPY_HIGH, ENTROPY_LETTERS, ENTROPY_LENGTH = 3.8, 5, 6

# Sectors in order, their words and phrases.
SECTORS = {
    "IT & SaaS / Software": "software saas cloud api tech app platform data ai digital systems solutions labs",
    "Healthcare & Pharma": "health medical pharma clinic hospital care diagnostics biotech wellness therapeutics",
    "BFSI (Banking & Finance)": "bank finance capital invest insurance credit wealth fintech lending asset",
    "E-Commerce & Retail": "shop store retail ecommerce commerce mart market boutique goods",
    "Real Estate & Property": "realty property estate realtor housing homes land developers",
    "Manufacturing & Heavy Industry": "manufacturing industries factory steel machinery industrial fabrication engineering",
    "Education & EdTech": "school university college academy edtech learning education institute training",
    "Marketing & Advertising": "marketing advertising agency media branding creative digital campaigns pr",
    "Media & Entertainment": "media entertainment studio films music gaming broadcast production",
    "Logistics & Supply Chain": "logistics supply freight shipping cargo transport warehouse fleet",
    "Automotive & EV": "auto automotive motors vehicle ev cars mobility garage",
    "Energy & Renewable Utilities": "energy solar power utilities renewable electric grid wind",
    "Telecommunications": "telecom wireless network communications broadband mobile carrier",
    "Hospitality & Tourism": "hotel hospitality travel tourism resort restaurant leisure",
    "Professional Services": "consulting advisory legal law accounting audit services partners",
    "Agriculture & FoodTech": "agriculture farm food agritech crop dairy harvest",
    "Consumer Goods (FMCG)": "fmcg consumer goods brands products packaged",
    "Aerospace & Defense": "aerospace defense aviation aircraft military space",
    "Government & Public Services": "government municipal public federal state gov administration",
    "NGO & Non-Profit": "foundation nonprofit ngo charity trust relief welfare",
}
PHRASES = {
    "IT & SaaS / Software": ("machine learning", "web development"),
    "BFSI (Banking & Finance)": ("venture capital", "private equity"),
    "Real Estate & Property": ("real estate",),
    "Energy & Renewable Utilities": ("renewable energy", "solar power"),
    "Government & Public Services": ("public sector",),
}
NO_SECTOR = "Unknown / Unclassified"
TEXT_LIMIT, TOKEN_LIMIT = 300, 60

# Tags.
VERIFICATION_TAGS = (
    "VALID_SYNTAX", "INVALID_SYNTAX", "DISPOSABLE_EMAIL", "ROLE_BASED", "NO_MX_RECORD", "DNS_TIMEOUT", "DNS_ERROR", "SSRF_BLOCKED", "SMTP_TIMEOUT",
    "SMTP_CONNECT_FAILED", "MAILBOX_LIKELY_VALID", "MAILBOX_LIKELY_INVALID", "CATCH_ALL_DOMAIN", "CIRCUIT_OPEN", "UNPARSEABLE",
)
PHONE_TAGS = (
    "VALID_E164", "INVALID_PHONE_LENGTH", "EMPTY_INPUT", "OVERSIZED_INPUT", "AMBIGUOUS_REGION", "UNPARSEABLE", "DUMMY_SEQUENCE", "REPEATING_DIGITS", "DEPENDENCY_MISSING",
    "LINE_MOBILE", "LINE_LANDLINE", "LINE_TOLL_FREE", "LINE_PREMIUM_RATE", "LINE_VOIP", "LINE_UNKNOWN", "VOIP_RISK", "PREMIUM_RATE_RISK",
)
RISK_TAGS = (
    "SPAM_TRAP_MATCH", "HIGH_RISK_TLD", "DISPOSABLE_SIGNAL", "ROLE_BASED_SIGNAL", "CATCH_ALL_SIGNAL", "VOIP_PHONE_SIGNAL", "DUMMY_PHONE_SIGNAL",
    "BOT_GENERATED_PATTERN", "UNKNOWN_RISK", "UNKNOWN_SECTOR", "OVERSIZED_INPUT",
)
THROTTLE_TAGS = ("ALLOWED", "RATE_LIMIT_EXCEEDED", "CIRCUIT_OPEN_BACKPRESSURE", "RESOURCE_THROTTLED", "REGISTRY_CAPACITY_EXCEEDED")
CIRCUIT_STATES = ("CLOSED", "OPEN", "HALF_OPEN")
COMPLIANCE_TAGS = ("SUCCESS", "COMPLIANCE_HASH_ERROR", "REDACTION_FAILED", "INVALID_ACTION_TYPE", "OVERSIZED_BATCH")
STATUSES = ("RAW", "NORMALIZED", "DEDUPED", "VERIFIED", "FORMATTED", "SCORED", "EVALUATED", "THROTTLED", "AUDITED")
DLQ_CODES = ("NORMALIZATION_FAILURE", "STAGE_ENGINE_FAILURE", "ORCHESTRATION_ERROR")
EXPORT_TARGETS = ("CSV_DOWNLOAD", "WEBHOOK", "HUBSPOT", "SALESFORCE", "GOHIGHLEVEL")
JOB_STATES = ("PENDING_ADMIN_APPROVAL", "APPROVED_WAITING_PAYMENT", "REJECTED_BY_ADMIN", "COMPLETED_AND_DELIVERED")

# Phone limits, and line types of the numbering-plan library, by its names.
PHONE_MAX, DIGITS_MIN, DIGITS_MAX = 40, 4, 15
LINE_TYPES = {
    "MOBILE": "LINE_MOBILE", "FIXED_LINE": "LINE_LANDLINE", "FIXED_LINE_OR_MOBILE": "LINE_MOBILE", "TOLL_FREE": "LINE_TOLL_FREE", "PREMIUM_RATE": "LINE_PREMIUM_RATE", "VOIP": "LINE_VOIP",
    "PERSONAL_NUMBER": "LINE_UNKNOWN", "PAGER": "LINE_UNKNOWN", "UAN": "LINE_UNKNOWN", "VOICEMAIL": "LINE_UNKNOWN", "UNKNOWN": "LINE_UNKNOWN",
}

# Rule language.
RULE_FIELDS = (
    "email", "email_domain", "phone", "phone_e164", "phone_country_code", "phone_line_type", "phone_national", "company_name", "company", "contact_name", "name", "first_name",
    "last_name", "address", "sector", "industry_sector", "sector_confidence", "risk_score", "line_type", "is_disposable", "is_role_based", "is_catch_all", "has_mx_records",
    "is_duplicate", "is_disposable_email", "is_role_based_email", "is_voip_phone", "is_catch_all_domain", "country_code",
)
RULE_OPERATORS = ("EQUALS", "NOT_EQUALS", "CONTAINS", "NOT_CONTAINS", "GREATER_THAN", "LESS_THAN", "IN_LIST", "REGEX_MATCH")
RULE_ACTIONS = ("DROP_RECORD", "FLAG_RECORD", "MASK_FIELD", "OVERWRITE_FIELD", "ROUTE_TO_QUEUE")
MAX_RULES, MAX_NODES, MAX_DEPTH, MAX_LIST = 100, 300, 15, 500
MAX_PATTERN, MAX_SUBJECT, MAX_QUANTIFIERS = 200, 1000, 4
NESTED_QUANTIFIERS = ("+)+", "+)*", "*)*", "*)+", "{2,}){2,}")

# Compliance.
ACTION_TYPES = ("DATA_INGESTION", "DATA_NORMALIZATION", "DATA_ENRICHMENT", "DATA_REDACTION", "DATA_EXPORT", "DATA_DELETION", "RULE_EVALUATION")
PII_FIELDS = ("email", "phone", "contact_name", "first_name", "last_name", "address", "name")
METADATA_FIELDS = (
    "sector", "industry_sector", "sector_confidence", "risk_score", "risk_tags", "is_disposable", "is_role_based", "is_catch_all", "has_mx_records", "is_duplicate",
    "is_disposable_email", "is_role_based_email", "is_voip_phone", "is_catch_all_domain", "line_type", "phone_line_type", "country_code", "phone_country_code", "routed_queue",
)
TOMBSTONE = "[REDACTED]"

# Token bucket, breaker, backpressure, backoff.
BUCKET_CAPACITY, BUCKET_RATE, BUCKET_TENANTS, BUCKET_IDLE = 60.0, 1.0, 10_000, 3600.0
BREAKER_FAILURES, BREAKER_SECONDS, BREAKER_SERVICES = 5, 30.0, 200
QUEUE_LIMIT, MEMORY_LIMIT_MB = 5000, 1024.0
BACKOFF_BASE, BACKOFF_MAX, BACKOFF_TRIES = 0.5, 30.0, 8

# Credits, currencies, prices.
TIERS = {"FREE": 1000, "PRO": 50000, "ENTERPRISE": 1000000}
CURRENCIES = {"INR": "₹", "USD": "$", "EUR": "€", "GBP": "£", "AED": "AED ", "CAD": "CA$", "AUD": "A$", "SGD": "S$", "SAR": "SAR "}
RATE_PER_1000, MINIMUM_FEE = 5.0, 2.0
HIGH_RISK = 70
PAIR_BLOCK, JW_THRESHOLD, NAME_MAX = 500, 0.90, 200


@dataclass(frozen=True)
class Tenant:
    """Whose data it is. Every operator that works by tenant asks for a name that is not empty."""

    tenant_id: str

    def __post_init__(self) -> None:
        if not self.tenant_id:
            raise ValueError("tenant_id is missing")
