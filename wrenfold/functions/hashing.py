"""Keyed hashes as Catalyst expressions, Merkle roots and the audit chain."""

from __future__ import annotations

import hashlib
import hmac
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocab import Tenant


def tenant_key(tenant_id: str, pepper: bytes) -> bytes:
    """DUP1: the tenant's key. The pepper has 32 bytes at least; there is no default."""
    if not pepper or len(pepper) < 32:
        raise ValueError("the pepper needs 32 bytes at least")
    return hmac.new(pepper, Tenant(tenant_id).tenant_id.encode(), hashlib.sha256).digest()


def pads(key: bytes) -> tuple[bytes, bytes]:
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def fingerprint(c: Column, key: bytes) -> Column:
    """DUP2, CMP1: HMAC-SHA256 in hex, computed by Catalyst. The key is a literal of the plan: redact plans that are shown."""
    inner, outer = pads(key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(c, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def optional_fingerprint(c: Column, key: bytes) -> Column:
    return F.when(c != "", fingerprint(c, key))


def fingerprints(email: Column, phone: Column, composite: Column, key: bytes) -> list[Column]:
    """DUP4: three columns; what is null or empty has none."""
    return [optional_fingerprint(c, key).alias(n) for c, n in ((email, "email_fp"), (phone, "phone_fp"), (composite, "composite_fp"))]


def genesis(tenant_id: str, pepper: bytes) -> str:
    """CMP1: where a tenant's chain begins."""
    return hmac.new(tenant_key(tenant_id, pepper), f"GENESIS:{tenant_id}".encode(), hashlib.sha256).hexdigest()


def canonical_json(value: object) -> bytes:
    """CMP4."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, default=str).encode()


def merkle_root_of(hashes: list[str]) -> str:
    """AGG7 of a short list."""
    if not hashes:
        return hashlib.sha256(b"EMPTY_BATCH").hexdigest()
    while len(hashes) > 1:
        hashes = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(hashes[::2], [*hashes[1::2], hashes[-1]], strict=False)]
    return hashes[0]


#: Leaves that are folded in one group; a power of 2, so that groups are whole subtrees.
FOLD = 1 << 12


def _folded(leaves: Column, rounds: Column | int) -> Column:
    """The root of an array, after at most `rounds` levels of pairs."""
    level = lambda lv: F.transform(F.sequence(F.lit(0), F.ceil(F.size(lv) / 2).cast("int") - 1), lambda k: F.sha2(F.concat(F.get(lv, 2 * k), F.coalesce(F.get(lv, 2 * k + 1), F.get(lv, 2 * k))).cast("binary"), 256))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), leaves, lambda lv, i: F.when(F.size(lv) > 1, level(lv)).otherwise(lv))


def merkle_root(leaves: DataFrame, index: str = "idx", leaf: str = "leaf") -> str:
    """AGG7 of any number of leaves (index from 0 without gaps): subtrees of FOLD leaves are folded by tasks, level by level."""
    n = leaves.count()
    now = leaves.select(F.col(index).cast("long").alias("i"), F.col(leaf).alias("h"))
    width = int(math.log2(FOLD))
    while n > FOLD:
        whole = now.groupBy(F.floor(F.col("i") / FOLD).alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]).alias("a"))
        # a short last group stands for a subtree that its last node fills up: its root is hashed with itself up to the level
        lift = F.aggregate(F.sequence(F.lit(1), F.lit(width)), F.col("a"), lambda lv, k: F.transform(F.sequence(F.lit(0), F.ceil(F.size(lv) / 2).cast("int") - 1), lambda j: F.sha2(F.concat(F.get(lv, 2 * j), F.coalesce(F.get(lv, 2 * j + 1), F.get(lv, 2 * j))).cast("binary"), 256)))
        now = whole.select(F.col("g").alias("i"), F.get(lift, F.lit(0)).alias("h"))
        n = math.ceil(n / FOLD)
    return merkle_root_of([r.h for r in now.orderBy("i").collect()])


def merkle_column(leaves: Column) -> Column:
    """AGG7 of an array of at most 2^20 leaves, as an expression."""
    return F.when(F.size(leaves) == 0, F.sha2(F.lit("EMPTY_BATCH"), 256)).otherwise(F.get(_folded(leaves, 20), F.lit(0)))
