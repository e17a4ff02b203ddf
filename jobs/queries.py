"""The jobs as queries over the test tables, each run twice into one new folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.observe import TIERS
from corvane.plans.catalog import embedded_sql, half_up
from corvane.session import table_path
from jobs import index_documents, usage_report


def job1_usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls are events: seconds are values, a purchase is a call of the dearer model."""
    out = table_path(spark, "usage")
    usage_report.run(spark, f"{sf_dir}/events.parquet", out)
    return usage_report.run(spark, f"{sf_dir}/events.parquet", out)


def job2_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: its text's hash, tokens, numbers of the embedding other than zero, and of documents with that text."""
    out, state = table_path(spark, "index"), table_path(spark, "index-state")
    index_documents.run(spark, f"{sf_dir}/documents*.parquet", out, state)
    held = index_documents.run(spark, f"{sf_dir}/documents*.parquet", out, state)
    copies = held.groupBy(F.reverse("content_hash").alias("_turned")).agg(F.count(F.lit(1)).alias("copies"))
    told = held.select("doc_id", "source", "lang", "content_hash", F.reverse("content_hash").alias("_turned"), "token_count", F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("n_slots"), F.round(F.array_max(F.transform("embedding", F.abs)).cast("double"), 4).alias("largest"))
    return told.join(copies, "_turned").drop("_turned")


_TIERS = " UNION ALL ".join(f"SELECT '{t}' AS name, user_id, time_bucket(INTERVAL {w}, ts) AS w, count(*)::DOUBLE AS n FROM events GROUP BY ALL HAVING n > {most}" for t, (most, w) in TIERS.items())
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_usage_report": job1_usage_report, "job2_index_documents": job2_index_documents}
ORACLES: dict[str, str] = {
    "job1_usage_report": f"""WITH c AS (SELECT ts::DATE AS day, event_type AS name, value::DECIMAL(18, 4) AS v, json_extract(props, '$.k')::BIGINT AS p, floor(value * 10)::BIGINT AS q, event_type = 'purchase' AS pro FROM events),
t AS ({_TIERS})
SELECT day, 'operation' AS kind, name, count(*) AS n, sum(v)::DOUBLE AS total, ((2 * (sum(v) * 10000)::HUGEINT + count(*)) // (2 * count(*)))::DOUBLE / 10000 AS mean, min(v)::DOUBLE AS low, max(v)::DOUBLE AS high,
 {half_up('sum((p * CASE WHEN pro THEN 1.25::DOUBLE ELSE 0.075::DOUBLE END + q * CASE WHEN pro THEN 5.0::DOUBLE ELSE 0.3::DOUBLE END) / 1000000)', 4)} AS cost_usd FROM c GROUP BY day, name
UNION ALL SELECT w::DATE, 'tier', name, count(*), sum(n), {half_up('avg(n)', 4)}, min(n), max(n), NULL FROM t GROUP BY 1, 3""",
    "job2_index_documents": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {embedded_sql('de', 'd', 'doc_id')},
s AS (SELECT key AS doc_id, count(*) AS n, max(abs(val::FLOAT::DOUBLE)) AS m FROM de GROUP BY 1)
SELECT doc_id, source, lang, sha256(coalesce(text, '')) AS content_hash, greatest(1, length(coalesce(text, '')) // 4)::BIGINT AS token_count, coalesce(n, 0) AS n_slots, round(coalesce(m, 0), 4) AS largest,
 count(*) OVER (PARTITION BY coalesce(text, '')) AS copies FROM documents LEFT JOIN s USING (doc_id)""",
}
