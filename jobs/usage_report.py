"""Usage of a service by day, from its log of calls: time taken and cost of each operation, clients beyond the limits of each tier.

    python -m jobs.usage_report --calls s3a://logs/calls --out s3a://reports/usage [--config my.json]

The configuration says, as SQL expressions, how a row of the log is read: its time, client, operation, seconds, model and tokens;
``from`` and ``to`` (exclusive) bound the days. Output: Parquet by day. A run replaces the days that it finds in the log, and leaves the
others, so running again, over the same or a longer log, gives the same rows for the same calls; a day must be whole in the log.
Rows without a time are counted in the log of the job and left out; those without an operation are told as ``unknown``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import observe
from jobs import common

SCHEMA = "kind string, name string, n bigint, total double, mean double, low double, high double, cost_usd double, day date"


def calls(rows: DataFrame, config: dict) -> DataFrame:
    """The log in the job's own columns."""
    own = {"ts": config["time"], "client": config["client"], "operation": config["operation"], "seconds": config["seconds"]}
    tokens = [F.expr(config[k]).alias(k) for k in ("model", "prompt", "completion")]
    told = rows.select(*[F.expr(e).alias(k) for k, e in own.items()], *tokens)
    told = told.withColumn("operation", F.coalesce(F.col("operation").cast("string"), F.lit("unknown")))
    day = F.to_date("ts")
    for bound, inside in (("from", lambda b: day >= F.lit(b).cast("date")), ("to", lambda b: day < F.lit(b).cast("date"))):
        if config[bound]:
            told = told.filter(inside(config[bound]) | F.col("ts").isNull())
    return told.withColumns({"day": day, "cost": T.cost(F.col("model"), F.col("prompt"), F.col("completion"))})


def report(log: DataFrame) -> DataFrame:
    """A row a day and operation, and a row a day and tier: how many windows of how many calls were over its limit."""
    by_day = observe.latency(log.withColumn("each", F.struct("day", "operation")), "each", "seconds")
    spent = observe.cost_report(log, ["day", "operation"]).filter("day IS NOT NULL AND operation IS NOT NULL").select("day", F.col("operation").alias("name"), "cost_usd")
    took = by_day.select("operation.day", F.col("operation.operation").alias("name"), "n", "total", "mean", "low", "high")
    operations = took.join(spent, ["day", "name"]).withColumn("kind", F.lit("operation"))
    over = observe.over_tiers(log, "client", "ts").groupBy(F.to_date("window_start").alias("day"), F.col("tier").alias("name"))
    n = F.col("n").cast("double")
    tiers = over.agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("total"), F.round(F.avg(n), 4).alias("mean"), F.min(n).alias("low"), F.max(n).alias("high"))
    return operations.unionByName(tiers.withColumns({"kind": F.lit("tier"), "cost_usd": F.lit(None).cast("double")}))


def run(spark: SparkSession, calls_path: str, out: str, config: dict | None = None) -> DataFrame:
    """Reads the log, writes the report, and returns all of it as it then stands."""
    config = config or common.load(None, "usage_report.json")
    seen = Observation("calls")
    rows = calls(spark.read.parquet(calls_path), config).observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(F.col("ts").isNull()).alias("untimed"))
    # Written once, by day, as the report passes over it several times; a later run replaces the same days.
    timed = rows.filter("ts IS NOT NULL")
    timed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{out}/calls")
    common.log.info("read %d rows of %s, %d of them without a time", seen.get["read"], calls_path, seen.get["untimed"])
    days = calls(spark.read.parquet(calls_path), config).select("day").distinct()
    kept = spark.read.schema(timed.schema).parquet(f"{out}/calls").join(F.broadcast(days), "day", "left_semi")  # a row a day
    made = report(kept).selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in SCHEMA.split(", ")])
    wrote = Observation("report")
    made.observe(wrote, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{out}/report")
    common.log.info("wrote %d rows to %s/report", wrote.get["rows"], out)
    return spark.read.schema(SCHEMA).parquet(f"{out}/report")


def main() -> None:
    args = common.arguments(__doc__, "calls", "out")
    spark = common.session("usage_report")
    try:
        run(spark, args.calls, args.out, common.load(args.config, "usage_report.json"))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
