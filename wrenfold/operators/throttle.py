"""Token buckets, circuit breakers, backoff and backpressure."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vocab import BACKOFF_BASE, BACKOFF_MAX, BACKOFF_TRIES, BREAKER_FAILURES, BREAKER_SECONDS, BREAKER_SERVICES, BUCKET_CAPACITY, BUCKET_IDLE, BUCKET_RATE, BUCKET_TENANTS, MEMORY_LIMIT_MB, QUEUE_LIMIT, Tenant


def refilled(tokens: Column, last: Column, now: Column, capacity: Column, rate: Column) -> Column:
    """STR1: tokens after the time that has passed; a clock that goes back adds none."""
    return F.least(capacity, tokens + F.greatest(F.lit(0.0), now - last) * rate)


def refill(tokens: float, last: float, now: float, capacity: float, rate: float) -> float:
    return min(capacity, tokens + max(0.0, now - last) * rate)


class Buckets:
    """STR2 on the driver: a bucket a tenant, at most BUCKET_TENANTS; those idle for an hour make room."""

    def __init__(self, capacity: float = BUCKET_CAPACITY, rate: float = BUCKET_RATE, tenants: int = BUCKET_TENANTS, clock: Callable[[], float] = time.monotonic):
        self.capacity, self.rate, self.tenants, self.clock, self.state = capacity, rate, tenants, clock, {}

    def try_consume(self, tenant: str, cost: float = 1.0) -> tuple[bool, str]:
        now = self.clock()
        if tenant not in self.state and len(self.state) >= self.tenants:
            self.state = {t: s for t, s in self.state.items() if now - s[1] <= BUCKET_IDLE}
            if len(self.state) >= self.tenants:
                return False, "REGISTRY_CAPACITY_EXCEEDED"
        tokens, last = self.state.get(tenant, (self.capacity, now))
        tokens = refill(tokens, last, now, self.capacity, self.rate)
        fine = tokens >= cost
        self.state[tenant] = (tokens - cost * fine, now)
        return fine, "ALLOWED" if fine else "RATE_LIMIT_EXCEEDED"

    def tenant_count(self) -> int:
        return len(self.state)


def throttle_burst(df: DataFrame, tenant: str, order: str, capacity: int = int(BUCKET_CAPACITY)) -> DataFrame:
    """WIN2, STR8: records of one instant: each tenant's first `capacity` are allowed. The limit works before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(tenant).orderBy(order))
    last = df.select(tenant, order).withColumn("_rn", rank).where(F.col("_rn") <= capacity).groupBy(tenant).agg(F.max(order).alias("_last"))
    over = F.col(order) > F.col("_last")
    out = df.join(last.withColumnRenamed(tenant, "_who"), df[tenant].eqNullSafe(F.col("_who"))).drop("_who")
    return out.withColumn("is_throttled", over).withColumn("throttle_tag", F.when(over, "RATE_LIMIT_EXCEEDED").otherwise("ALLOWED")).withColumn("_meta_throttled", F.lit(True)).drop("_last")


def throttle_timed(df: DataFrame, tenant: str, ts: str, order: str, capacity: float = BUCKET_CAPACITY, rate: float = BUCKET_RATE) -> DataFrame:
    """STR2 over timed records: is_throttled and throttle_tag.

    A tenant's records stream through one task in time order, with two numbers of state: memory is bounded, but a tenant
    is no faster than one core. Each decision hangs on all those before it, so a tenant's records can't be dealt out.
    """
    names = [c for c in df.columns if c not in ("is_throttled", "throttle_tag")]
    rows = df.select(*names, F.col(ts).cast("timestamp").cast("double").alias("_now"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema.fields) + ", is_throttled boolean, throttle_tag string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, tokens, last = object(), capacity, 0.0
        for b in batches:
            out = []
            for t, now in zip(b[tenant], b["_now"], strict=True):
                if t != who:
                    who, tokens, last = t, capacity, now
                tokens = refill(tokens, last, now, capacity, rate)
                last = now
                out.append(tokens < 1)
                tokens -= not out[-1]
            b = b.drop(columns="_now").assign(is_throttled=out)
            yield b.assign(throttle_tag=["RATE_LIMIT_EXCEEDED" if x else "ALLOWED" for x in out])

    return rows.repartition(tenant).sortWithinPartitions(tenant, "_now", order).mapInPandas(run, schema)


@dataclass
class Breaker:
    """STR3: opens after five failures in a row, lets one probe through after 30 s."""

    clock: Callable[[], float] = time.monotonic
    state: str = "CLOSED"
    failures: int = 0
    opened: float = 0.0
    probing: bool = False

    def allow(self) -> tuple[bool, str]:
        if self.state == "OPEN" and self.clock() - self.opened >= BREAKER_SECONDS:
            self.state, self.probing = "HALF_OPEN", False
        if self.state == "OPEN" or self.state == "HALF_OPEN" and self.probing:
            return False, "CIRCUIT_OPEN_BACKPRESSURE"
        self.probing = self.state == "HALF_OPEN"
        return True, "ALLOWED"

    def success(self) -> None:
        self.state, self.failures, self.probing = "CLOSED", 0, False

    def failure(self) -> None:
        self.failures += 1
        if self.state == "HALF_OPEN" or self.failures >= BREAKER_FAILURES:
            self.state, self.opened, self.probing = "OPEN", self.clock(), False


class Breakers:
    """STR4: a breaker a service, at most BREAKER_SERVICES; None beyond, which gates nothing."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock, self.known = clock, {}

    def get(self, service: str) -> Breaker | None:
        if service not in self.known and len(self.known) < BREAKER_SERVICES:
            self.known[service] = Breaker(self.clock)
        return self.known.get(service)


def backoff(attempt: int, base: float = BACKOFF_BASE, most: float = BACKOFF_MAX) -> float:
    """STR5."""
    return random.uniform(0, min(most, base * 2 ** max(0, attempt)))


def retry(operation: Callable[[], object], tries: int = BACKOFF_TRIES, sleep: Callable[[float], None] = time.sleep) -> tuple[bool, object, int]:
    """STR6: (whether it worked, its result, attempts)."""
    for k in range(tries):
        try:
            return True, operation(), k + 1
        except Exception:  # what the operation raises is what is retried
            if k < tries - 1:
                sleep(backoff(k))
    return False, None, tries


def backpressure(queue: Column, memory_mb: Column) -> Column:
    """STR7: the tag for a queue length and memory use."""
    fine = (queue >= 0) & (memory_mb >= 0) & (queue < QUEUE_LIMIT) & (memory_mb < MEMORY_LIMIT_MB)
    return F.when(fine, "ALLOWED").otherwise("RESOURCE_THROTTLED")


def gate(df: DataFrame, tenant_id: str, order: str, queue: int = 0, memory_mb: float = 0.0, breaker: Breaker | None = None, tokens: int = int(BUCKET_CAPACITY)) -> DataFrame:
    """STR8 for a batch of one tenant: backpressure, then tokens, then the breaker; only allowed rows stay."""
    Tenant(tenant_id)
    if not (0 <= queue < QUEUE_LIMIT and 0 <= memory_mb < MEMORY_LIMIT_MB):
        return df.where("false").withColumns({"is_throttled": F.lit(True), "throttle_tag": F.lit("RESOURCE_THROTTLED"), "_meta_throttled": F.lit(True)})
    out = throttle_burst(df.withColumn("_tenant", F.lit(tenant_id)), "_tenant", order, tokens).drop("_tenant").where(~F.col("is_throttled"))
    return out if breaker is None or breaker.allow()[0] else out.where("false")
