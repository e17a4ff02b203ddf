"""Logs of calls: cost, latency, rate limits; also as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Calls a client may make in a window, by tier.
TIERS = {"default": (60, "1 minute"), "search": (30, "1 minute"), "llm": (10, "1 minute"), "ingestion": (5, "1 hour")}
# End of fixed values.


def cost_report(calls: DataFrame, by: list[str], n: Column | None = None) -> DataFrame:
    """calls: prompt, completion, cost. Totals by the given columns and over all (null); a row is a call, unless ``n`` counts them."""
    return calls.rollup(*by).agg(
        (F.count(F.lit(1)) if n is None else n).alias("n_calls"), F.sum("prompt").alias("prompt_tokens"), F.sum("completion").alias("completion_tokens"), F.round(F.sum("cost"), 4).alias("cost_usd")
    )


def cost_by_model(calls: DataFrame, by: str, value: str = "cost") -> DataFrame:
    """calls: model, ``by`` and a value. A row a ``by``, with the value's sums by model as a map in order of models."""
    sums = calls.groupBy(by, "model").agg(F.sum(value).alias("v"))
    return sums.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "v")))).alias("by_model"))


def latency(log: DataFrame, operation: str, value: str) -> DataFrame:
    v = F.col(value)
    return log.groupBy(F.col(operation).alias("operation")).agg(
        F.count(v).alias("n"), F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 4).alias("mean"), F.round(F.min(v), 4).alias("low"), F.round(F.max(v), 4).alias("high")
    )


def over_limit(log: DataFrame, client: str, ts: str, most: int, window: str) -> DataFrame:
    """Fixed windows in which a client made more calls than allowed."""
    counted = log.groupBy(F.col(client).alias("client"), F.window(ts, window)["start"].alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") > most)


def over_tiers(log: DataFrame, client: str, ts: str, tiers: dict[str, tuple[int, str]] = TIERS) -> DataFrame:
    """(tier, client, window_start, n): what would be over each tier's limit."""
    out = None
    for tier, (most, window) in tiers.items():
        part = over_limit(log, client, ts, most, window).select(F.lit(tier).alias("tier"), "client", "window_start", "n")
        out = part if out is None else out.unionByName(part)
    return out
