"""PII redaction, safe projections, and the audit trail."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.hashing import canonical_json, fingerprint, genesis, merkle_root, tenant_key
from ..functions.vocab import ACTION_TYPES, METADATA_FIELDS, PII_FIELDS, TOMBSTONE
from ..sources.staging import numbered


def protected(df: DataFrame, key: bytes, redact: tuple[str, ...] = (), pseudonymize: tuple[str, ...] = ()) -> DataFrame:
    """CMP2: fields redacted or replaced by pseudonyms; redacted_fields, pseudonymized_fields, failed_fields (sorted)."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    new, done, named, failed = {}, [], [], []
    for f in sorted(set(redact) | set(pseudonymize)):
        if f not in PII_FIELDS or not isinstance(kinds.get(f), StringType):
            failed += [F.lit(f)] * ((f in redact) + (f in pseudonymize))
            continue
        full = F.coalesce(F.length(f) > 0, F.lit(False))
        bare = F.lower(F.trim(f))
        if f in redact:
            done.append(F.when(full, F.lit(f)))
            failed.append(F.when(~full, F.lit(f)))
            if f in pseudonymize:
                failed.append(F.lit(f))
            new[f] = F.when(full, F.lit(TOMBSTONE)).otherwise(F.col(f))
        else:
            named.append(F.when(full, F.lit(f)))
            failed.append(F.when(~full, F.lit(f)))
            new[f] = F.when(full, fingerprint(bare, key)).otherwise(F.col(f))
    lists = {"redacted_fields": done, "pseudonymized_fields": named, "failed_fields": failed}
    return df.withColumns({**new, **{n: F.array_compact(F.array(*x)).cast("array<string>") for n, x in lists.items()}})


def safe_projection(df: DataFrame, key: bytes) -> list[Column]:
    """CMP3: <field>_hash of PII and the metadata fields that the table has, by name."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = {f: F.col(f) for f in METADATA_FIELDS if f in kinds}
    for f in PII_FIELDS:
        if isinstance(kinds.get(f), StringType):
            c = F.col(f)
            out[f"{f}_hash"] = F.when(c == TOMBSTONE, F.lit("REDACTED")).when(F.length(c) > 0, fingerprint(F.lower(F.trim(c)), key))
    return [c.alias(n) for n, c in sorted(out.items())]


@dataclass(frozen=True)
class AuditEntry:
    schema_version: int
    timestamp: float
    tenant_id: str
    batch_id: str
    action_type: str
    record_count: int
    payload_merkle_root: str
    prev_chain_hash: str
    chain_hash: str


def _chain_hash(body: dict) -> str:
    return hashlib.sha256(canonical_json(body) + body["prev_chain_hash"].encode()).hexdigest()


def leaves(df: DataFrame, key: bytes, order: str = "_row_idx") -> DataFrame:
    """(idx, leaf): SHA-256 of each record's projection in canonical JSON, in order. Hashes of PII that is null are left out."""
    hashes = {f"{f}_hash" for f in PII_FIELDS}
    columns = safe_projection(df, key)
    names = df.select(*columns).columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [hashlib.sha256(canonical_json({k: v for k, v in r.items() if v is not None or k not in hashes})).hexdigest() for r in b.select(names).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("_at")), pa.array(out, pa.string())], ["at", "leaf"])

    made = df.select(F.col(order).cast("long").alias("_at"), *columns).mapInArrow(run, "at long, leaf string")
    return numbered(made, "at", name="idx").select("idx", "leaf")


def audit(df: DataFrame, tenant_id: str, pepper: bytes, action: str = "DATA_NORMALIZATION", batch_id: str | None = None, previous: str | None = None, redact: tuple = (), pseudonymize: tuple = (), timestamp: float | None = None, order: str = "_row_idx") -> tuple[DataFrame, AuditEntry]:
    """CMP5, CMP7: the protected records with _audit_batch_id and _audit_chain_hash, and the entry. Fails closed: any error is raised."""
    key, ts = tenant_key(tenant_id, pepper), time.time() if timestamp is None else timestamp
    action = action if action in ACTION_TYPES else "DATA_NORMALIZATION"
    batch_id = batch_id or hashlib.sha256(f"{tenant_id}:{time.time_ns()}".encode()).hexdigest()[:16]
    clean = protected(df, key, redact, pseudonymize)
    leaf = leaves(clean, key, order)
    body = {
        "schema_version": 1, "timestamp": ts, "tenant_id": tenant_id, "batch_id": batch_id, "action_type": action, "record_count": leaf.count(),
        "payload_merkle_root": merkle_root(leaf), "prev_chain_hash": previous or genesis(tenant_id, pepper),
    }
    entry = AuditEntry(**body, chain_hash=_chain_hash(body))
    out = clean.drop("redacted_fields", "pseudonymized_fields", "failed_fields")
    return out.withColumns({"_audit_batch_id": F.lit(batch_id), "_audit_chain_hash": F.lit(entry.chain_hash), "_meta_compliance_audited": F.lit(True)}), entry


def verify_chain(entries: list[AuditEntry], tenant_id: str, pepper: bytes) -> tuple[bool, int | None]:
    """CMP6: whether the entries are a chain from the tenant's genesis; the first that is not."""
    before = genesis(tenant_id, pepper)
    for i, e in enumerate(entries):
        body = asdict(e)
        if e.prev_chain_hash != before or body.pop("chain_hash") != _chain_hash({k: v for k, v in body.items() if k != "chain_hash"}):
            return False, i
        before = e.chain_hash
    return True, None
