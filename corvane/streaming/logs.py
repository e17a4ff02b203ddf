"""Call logs and arriving files as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.session import ship


def read_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_totals(log: DataFrame, ts: str, key: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and key; state of a window goes once the watermark passes it."""
    return log.withWatermark(ts, late).groupBy(F.window(ts, window), F.col(key)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))


def _counted(most: int, width: int):
    """Counts a client's calls in one window; those beyond ``most`` are given out."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the watermark has passed the window: no call can come any more
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        for pdf in parts:
            place = n + np.arange(1, len(pdf) + 1)
            over = place > most
            yield pd.DataFrame({"client": pdf["client"][over], "window_start": pdf["window_start"][over], "n": place[over]})
            n += len(pdf)
        state.update((n,))
        state.setTimeoutTimestamp((int(key[1]) + width) * 1000)

    return step


def over_limit(log: DataFrame, client: str, ts: str, most: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """A stream of (client, window_start, n): each call beyond ``most`` of a client in a fixed window, with its number there.

    State is one count a client and window, so a busy client's windows are kept apart; it goes once the watermark has passed
    the window's end. Calls later than ``late`` are dropped; those without a client or a time are not counted.
    """
    ship(log.sparkSession)
    kind = log.schema[client].dataType.simpleString()
    start = (F.floor(F.unix_micros(ts) / (seconds * 1_000_000)) * seconds).cast("long")
    calls = log.withWatermark(ts, late).filter(F.col(client).isNotNull() & F.col(ts).isNotNull())
    keyed = calls.select(F.col(client).alias("client"), start.alias("window_start"), ts).groupBy("client", "window_start")
    out = keyed.applyInPandasWithState(_counted(most, seconds), f"client {kind}, window_start long, n long", "n long", "append", "EventTimeTimeout")
    return out.withColumn("window_start", F.timestamp_seconds("window_start"))


def each_batch(files: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run an incremental ingest on every batch of arriving files, once each."""
    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
