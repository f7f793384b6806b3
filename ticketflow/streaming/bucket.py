"""Token buckets: each client may make so many requests at once, refilled steadily."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

CAPACITY, REFILL, PERIOD_S = 60.0, 60.0, 60.0


def _folded(client: str, key: str, capacity: float, rate: float):
    """(client, key, allowed) of sorted requests; a bucket is full where first says so, and carried over batches."""

    def run(batches):
        tokens, last = capacity, None
        for batch in batches:
            allowed = []
            for first, t in zip(batch.column("first").to_pylist(), batch.column("t").to_pylist(), strict=True):
                if first:
                    tokens = capacity
                elif t is not None and last is not None:
                    tokens = min(capacity, tokens + max(t - last, 0.0) * rate)
                last = t
                allowed.append(tokens >= 1.0)
                tokens -= allowed[-1]
            yield pa.RecordBatch.from_arrays([batch.column("who"), batch.column("key"), pa.array(allowed, pa.bool_())], [client, key, "allowed"])

    return run


def admitted(requests: DataFrame, client: str, at: str, key: str, capacity: float = CAPACITY, refill: float = REFILL, period: float = PERIOD_S) -> DataFrame:
    """requests with allowed, in batch: a fold over each client's requests in time.

    The fold keeps the tokens left and the last time; requests of one time go in order of key.
    A pause that fills a bucket cuts a client's requests into pieces that are folded apart.
    """
    rate = refill / period
    rows = requests.select(F.col(client).alias("who"), F.col(at).cast("timestamp").cast("double").alias("t"), F.col(key).cast("long").alias("key"))
    own = Window.partitionBy("who").orderBy("t", "key")
    full = F.coalesce((F.col("t") - F.lag("t").over(own)) * rate >= capacity, F.lit(False))
    rows = rows.withColumn("first", full | (F.row_number().over(own) == 1))
    rows = rows.withColumn("piece", F.sum(F.col("first").cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = StructType([StructField(client, requests.schema[client].dataType), StructField(key, LongType()), StructField("allowed", BooleanType())])
    return rows.repartition("who", "piece").sortWithinPartitions("who", "piece", F.desc("first"), "t", "key").mapInArrow(_folded(client, key, capacity, rate), out)


def admitted_stream(requests: DataFrame, client: str, at: str, key: str, capacity: float = CAPACITY, refill: float = REFILL, period: float = PERIOD_S) -> DataFrame:
    """(client, key, allowed) of a stream of requests; a client's bucket is kept between micro-batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    rate = refill / period

    def step(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values(["t", "key"])
        allowed = []
        for t in rows["t"]:
            tokens = min(capacity, tokens + max(0.0, t - (t if last is None else last)) * rate)
            last = t
            allowed.append(tokens >= 1.0)
            tokens -= allowed[-1]
        state.update((tokens, last))
        yield pd.DataFrame({client: who[0], key: rows["key"].to_numpy(), "allowed": allowed})

    rows = requests.select(F.col(client).cast("string").alias(client), F.col(at).cast("timestamp").cast("double").alias("t"), F.col(key).cast("long").alias("key"))
    return rows.groupBy(client).applyInPandasWithState(step, f"{client} string, {key} long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)
