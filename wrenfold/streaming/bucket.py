"""Token buckets over a stream: a tenant's tokens and clock are its state, which goes after an idle hour."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.vocab import BUCKET_CAPACITY, BUCKET_IDLE, BUCKET_RATE
from ..operators.throttle import refill

OUTPUT = "tenant string, event_id long, now double, allowed boolean"
STATE = "tokens double, last double"


class BucketProcessor(StatefulProcessor):
    def __init__(self, capacity: float, rate: float, ttl_ms: int | None):
        self.capacity, self.rate, self.ttl_ms = capacity, rate, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tokens, last = self.bucket.get() if self.bucket.exists() else (self.capacity, None)
        batch = pd.concat(list(rows)).sort_values(["now", "event_id"])
        allowed = []
        for now in batch["now"]:
            tokens, last = refill(tokens, now if last is None else last, now, self.capacity, self.rate), now
            allowed.append(tokens >= 1)
            tokens -= allowed[-1]
        self.bucket.update((float(tokens), float(last)))
        yield pd.DataFrame({"tenant": key[0], "event_id": batch["event_id"], "now": batch["now"], "allowed": allowed})

    def close(self) -> None:
        pass


def throttled_stream(events: DataFrame, capacity: float = BUCKET_CAPACITY, rate: float = BUCKET_RATE, idle_seconds: float | None = BUCKET_IDLE) -> DataFrame:
    """STR2 over a stream of (tenant, event_id, ts): whether each event is allowed, in event-time order within a micro-batch.

    Needs the RocksDB state store. idle_seconds: processing time after which an unused bucket goes; None keeps all.
    """
    rows = events.select(F.col("tenant").cast("string"), F.col("event_id").cast("long"), F.col("ts").cast("timestamp").cast("double").alias("now"))
    ttl = None if idle_seconds is None else int(idle_seconds * 1000)
    return rows.groupBy("tenant").transformWithStateInPandas(BucketProcessor(capacity, rate, ttl), OUTPUT, "Append", "None" if ttl is None else "ProcessingTime")
