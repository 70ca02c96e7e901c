"""E-mail verification against a table of mail exchangers. Domains are looked up once each, outside the row pipeline."""

from __future__ import annotations

import random
import smtplib
import socket
import string
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import email as E
from ..functions.vocab import Tenant

try:
    import dns.resolver as dns_resolver
except ImportError:  # an optional library; without it a domain's own address is looked up
    dns_resolver = None

MX_SCHEMA = "domain string, mx_host string, validated_ip string, tag string"
PROBE_SCHEMA = "domain string, catch_all boolean, smtp_tag string, smtp_code int"
DNS_SECONDS, SMTP_SECONDS, GAP = 2.0, 3.0, (0.15, 0.45)
#: A lookup table up to this many rows is broadcast.
BROADCAST_ROWS = 50_000


def _public(ip: str) -> bool:
    return bool(E.public_ip.func(pd.Series([ip])).iloc[0])


def resolve(domain: str) -> tuple[str, str | None, str | None, str]:
    """EML8 for one domain: the exchanger of lowest preference (SRT1) and its first public address."""
    if dns_resolver is None:
        try:
            found = {x[4][0] for x in socket.getaddrinfo(domain, 25, proto=socket.IPPROTO_TCP)}
        except (OSError, UnicodeError):
            return domain, None, None, "DNS_ERROR"
        ip = next((x for x in sorted(found) if _public(x)), None)
        return (domain, domain, ip, "VALID_SYNTAX") if ip else (domain, domain, None, "SSRF_BLOCKED")
    r = dns_resolver.Resolver()
    r.lifetime = DNS_SECONDS
    try:
        host = min(r.resolve(domain, "MX"), key=lambda x: x.preference).exchange.to_text().rstrip(".")
        ip = next((x.to_text() for x in r.resolve(host, "A") if _public(x.to_text())), None)
    except (dns_resolver.NXDOMAIN, dns_resolver.NoAnswer):
        return domain, None, None, "NO_MX_RECORD"
    except dns_resolver.LifetimeTimeout:
        return domain, None, None, "DNS_TIMEOUT"
    except Exception:  # any other failure of the resolver is the domain's, not the job's
        return domain, None, None, "DNS_ERROR"
    return (domain, host, ip, "VALID_SYNTAX") if ip else (domain, host, None, "SSRF_BLOCKED")


def probe(ip: str, host: str, sender: str, address: str) -> tuple[str, int | None]:
    """EML9: asks the exchanger whether it takes mail for the address."""
    try:
        with smtplib.SMTP(timeout=SMTP_SECONDS) as s:
            s.connect(ip, 25)
            s.ehlo()
            s.mail(sender)
            code, _ = s.rcpt(address)
    except TimeoutError:
        return "SMTP_TIMEOUT", None
    except (OSError, smtplib.SMTPException):
        return "SMTP_CONNECT_FAILED", None
    return ("MAILBOX_LIKELY_VALID" if 200 <= code < 300 else "MAILBOX_LIKELY_INVALID"), code


def mx_table(domains: DataFrame, look_up: Callable[[str], tuple] = resolve) -> DataFrame:
    """EML8, EML12: each distinct domain (column domain) resolved once, by tasks; so no breaker is needed.

    look_up: domain -> (domain, exchanger, public address, tag).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([look_up(d) for d in b["domain"]], columns=["domain", "mx_host", "validated_ip", "tag"])

    return domains.where("domain IS NOT NULL").select("domain").distinct().mapInPandas(run, MX_SCHEMA)


def catch_all_table(mx: DataFrame, sender: str, ask: Callable[[str, str, str, str], tuple] = probe, gap: tuple[float, float] = GAP) -> DataFrame:
    """EML10, EML11: whether each exchanger takes a random local part, asked once a domain.

    All domains of an exchanger are one task's, in a row, with a pause between them; exchangers don't wait for each
    other. ask: (address, exchanger, sender, recipient) -> (tag, code).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for b in batches:
            out = []
            for r in b.itertuples():
                if r.mx_host == last:
                    time.sleep(random.uniform(*gap))
                last = r.mx_host
                local = "".join(random.choices(string.ascii_lowercase, k=16))
                tag, code = ask(r.validated_ip, r.mx_host, sender, f"{local}@{r.domain}")
                out.append((r.domain, tag == "MAILBOX_LIKELY_VALID", tag, code))
            yield pd.DataFrame(out, columns=["domain", "catch_all", "smtp_tag", "smtp_code"])

    return mx.where("validated_ip IS NOT NULL").repartition("mx_host").sortWithinPartitions("mx_host", "domain").mapInPandas(run, PROBE_SCHEMA)


def verification_tags(ok: Column, disposable: Column, role: Column, mx_tag: Column, mx_ip: Column, catch_all: Column, smtp_tag: Column) -> Column:
    """EML13: tags in their order; a disposable domain is not looked up."""
    bad = ~disposable & ((mx_tag != "VALID_SYNTAX") | mx_ip.isNull())
    more = F.array_compact(F.array(F.lit("VALID_SYNTAX"), F.when(disposable, "DISPOSABLE_EMAIL"), F.when(role, "ROLE_BASED"), F.when(bad, mx_tag), F.when(~disposable & ~bad & catch_all, "CATCH_ALL_DOMAIN"), F.when(~disposable & ~bad & ~F.coalesce(catch_all, F.lit(False)), smtp_tag)))
    return F.when(ok, more).otherwise(F.array(F.lit("INVALID_SYNTAX")))


def verify(df: DataFrame, tenant_id: str, mx: DataFrame, probes: DataFrame | None = None, email: str = "email") -> DataFrame:
    """EML14: is_disposable, is_role_based, is_catch_all (null without probes), verification_tags, has_mx_records, _meta_verified.

    mx: (domain, mx_host, validated_ip, tag), a row a domain; a domain that it lacks counts as DNS_ERROR.
    probes: (domain, catch_all, smtp_tag, smtp_code).
    """
    Tenant(tenant_id)
    table = mx.select(F.col("domain").alias("_d"), F.col("tag").alias("_tag"), F.col("validated_ip").alias("_ip"))
    none = F.lit(None)
    table = table.join(probes.select(F.col("domain").alias("_d"), F.col("catch_all").alias("_all"), F.col("smtp_tag").alias("_smtp")), "_d", "left") if probes is not None else table.withColumns({"_all": none.cast("boolean"), "_smtp": none.cast("string")})
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # rows without a domain match nothing; in a shuffled join they are dealt out by their contents
    spread = F.coalesce("_s.domain", F.concat(F.lit("\u0000"), F.xxhash64(*(F.col(f"`{c}`") for c in df.columns if not dict(df.dtypes)[c].startswith("map"))).cast("string")))
    df = df.withColumn("_s", E.syntax(F.col(email)))
    out = df.join(F.broadcast(table), F.col("_s.domain") == F.col("_d"), "left") if small else df.withColumn("_k", spread).join(table, F.col("_k") == F.col("_d"), "left").drop("_k")
    ok, dis, role = F.col("_s.ok"), E.disposable(F.col("_s.domain")), E.role_based(F.col("_s.local"))
    tags = verification_tags(ok, dis, role, F.coalesce("_tag", F.lit("DNS_ERROR")), F.col("_ip"), F.col("_all"), F.col("_smtp"))
    out = out.withColumns({"is_disposable": dis, "is_role_based": role & ok, "is_catch_all": F.when(ok & ~dis, F.col("_all")), "verification_tags": tags})
    has = ~F.array_contains("verification_tags", "NO_MX_RECORD") & ~F.array_contains("verification_tags", "DNS_ERROR")
    return out.withColumns({"has_mx_records": has, "_meta_verified": F.lit(True)}).drop("_s", "_d", "_tag", "_ip", "_all", "_smtp")
