"""An index of arriving documents: what search needs of each, with an embedding a text and not a document.

    python -m jobs.index_documents --documents s3a://docs/incoming --out s3a://index --checkpoint s3a://index-state [--config my.json]

A file stream over a folder, or a pattern, of Parquet files (doc_id, text, lang, source). The checkpoint holds what was read, so a run takes only
files that no earlier run took, and ends when there are none left. A text is known by its hash: only texts that no earlier batch has
are embedded. Output: ``texts`` (a row a hash: embedding, length in tokens) by batch and ``documents`` (a row a document, with its
text's hash) by batch and language. A batch that is run again, after a failure, replaces its own rows, so the result is the same.

Null texts are empty, repeated rows and copies are documents of their own, a null language is stored as ``none``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import vectors as V
from jobs import common

INCOMING = "doc_id bigint, text string, lang string, source string"
TEXTS = "content_hash string, token_count bigint, embedding array<float>, batch bigint"
DOCUMENTS = "doc_id bigint, source string, lang string, content_hash string, batch bigint, language string"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _replace(df: DataFrame, batch: int, path: str, *by: str) -> None:
    """The rows of a batch in the place of any that an earlier try of it left."""
    numbered = df.withColumn("batch", F.lit(batch).cast("bigint"))
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(path)


def _index(rows: DataFrame, batch: int, out: str, dimensions: int) -> None:
    spark = rows.sparkSession
    told = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("content_hash", F.sha2("text", 256))
    known = _stored(spark, f"{out}/texts", TEXTS).filter(F.col("batch") < batch).select("content_hash")
    # Copies go before anything is exchanged; the rest is compared by the hash reversed, which both sides are exchanged for.
    once = told.select("content_hash", "text").dropDuplicates(["content_hash"]).withColumn("_turned", F.reverse("content_hash"))
    fresh = once.join(known.select(F.reverse("content_hash").alias("_turned")), "_turned", "left_anti").drop("_turned")
    sized = fresh.select("content_hash", T.token_estimate(F.col("text")).alias("token_count"), "text")
    embedded = V.with_embedding(sized, F.col("text"), lambda texts: V.embed_texts(texts, dimensions)).drop("text")
    _replace(embedded, batch, f"{out}/texts")
    language = F.when(F.coalesce("lang", F.lit("")) == "", "none").otherwise(F.col("lang"))
    _replace(told.select("doc_id", "source", "lang", "content_hash", language.alias("language")), batch, f"{out}/documents", "language")
    read, new = (_stored(spark, f"{out}/{name}", schema).filter(F.col("batch") == batch).count() for name, schema in (("documents", DOCUMENTS), ("texts", TEXTS)))
    common.log.info("batch %d: read %d documents, embedded %d new texts, wrote both to %s", batch, read, new, out)


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Takes in what is new, waits for the stream's end, and returns the index: documents with their texts' embeddings."""
    config = config or common.load(None, "index_documents.json")
    for name, schema in (("texts", TEXTS), ("documents", DOCUMENTS)):  # so that the first batch finds tables, without rows
        spark.createDataFrame([], schema).drop("batch", "language").write.mode("append").parquet(f"{out}/{name}")
    arriving = spark.readStream.schema(INCOMING).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(documents)
    each = lambda rows, batch: _index(rows, batch, out, config["dimensions"])
    stream = arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    common.log.info("%s: %d batches in this run", documents, len([p for p in stream.recentProgress if p["numInputRows"]]))
    texts = _stored(spark, f"{out}/texts", TEXTS).select(F.reverse("content_hash").alias("_turned"), "token_count", "embedding")
    held = _stored(spark, f"{out}/documents", DOCUMENTS).withColumn("_turned", F.reverse("content_hash"))
    return held.join(texts, "_turned").drop("_turned", "language")


def main() -> None:
    args = common.arguments(__doc__, "documents", "out", "checkpoint")
    spark = common.session("index_documents")
    try:
        run(spark, args.documents, args.out, args.checkpoint, common.load(args.config, "index_documents.json"))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
