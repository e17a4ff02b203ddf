"""Incremental runs: file differences by content hash, one-hop impact, partition rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import discard_path


def classify(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """Both: path, hash. (path, status): new, changed, same or deleted."""
    a, b = stored.select("path", F.col("hash").alias("old")), scanned.select("path", F.col("hash").alias("new"))
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return a.join(b, "path", "full").select("path", status.alias("status"))


def impacted(status: DataFrame, edges: DataFrame) -> DataFrame:
    """edges: source_file, target_file, of every type. Paths to process: new, changed, and sources of edges into
    changed or deleted files that still exist (one hop)."""
    moved = status.filter("status IN ('new', 'changed', 'deleted')").select(F.col("path").alias("target_file"))
    alive = status.filter("status <> 'deleted'").select(F.col("path").alias("source_file"))
    dependents = edges.join(moved, "target_file", "left_semi").join(alive, "source_file", "left_semi").select(F.col("source_file").alias("path"))
    return status.filter("status IN ('new', 'changed')").select("path").union(dependents).distinct()


def apply_changes(table: DataFrame, fresh: DataFrame, drop: DataFrame, key: str = "path") -> DataFrame:
    """The table without rows of dropped or fresh keys, and the fresh rows."""
    gone = drop.select(key).union(fresh.select(key)).distinct()
    return table.join(gone, key, "left_anti").unionByName(fresh)


def write_partition(df: DataFrame, path: str, partition: str = "repo_id") -> None:
    """Overwrite just the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def replace_partition(df: DataFrame, path: str, value: object, partition: str = "repo_id") -> None:
    """df: a partition's new rows, without its column. They take the old ones' place; no rows leave an empty partition.

    The value is one that a folder's name may hold as it is. Rows are looked for first, as a dynamic overwrite replaces only
    what it is given.
    """
    if df.isEmpty():
        discard_path(df.sparkSession, f"{path}/{partition}={value}")
    else:
        write_partition(df.withColumn(partition, F.lit(value)), path, partition)


def drop_partition(df: DataFrame, value: object, partition: str = "repo_id") -> DataFrame:
    return df.filter(~F.col(partition).eqNullSafe(F.lit(value)))


def refresh_importance(table: DataFrame, scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """scores: the keys (path by default), each once, and importance. Rows without a new score keep theirs."""
    keys = keys or ["path"]
    new = scores.select(*keys, F.col("importance").alias("_new"))
    return table.join(new, keys, "left").withColumn("importance", F.coalesce("_new", "importance")).select(table.columns)
