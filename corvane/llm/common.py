"""What the operators share: word splitting, barriers, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; an empty array for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def barrier(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are evaluated once a row.

    Catalyst merges projections and would copy an expensive expression into each lambda that reads it; a generator of
    one row is not merged.
    """
    kept = [c for c in df.columns if c not in cols]
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("_b")
    return df.select(*kept, one).select(*kept, *[F.col(f"_b.{n}").alias(n) for n in cols])


def join_anew(rows: DataFrame, groups: DataFrame, key: str, *others: str, how: str = "inner") -> DataFrame:
    """rows with the columns of groups, which has each key once; ``key`` is a long.

    The join is on the key's complement, so both sides are exchanged for it and adaptive execution splits the rows of a
    very common key. On the key itself an aggregate's own partitioning would be reused, below which nothing is split.
    """
    turned = groups.select(F.bitwise_not(key).alias("_key"), *others, *[c for c in groups.columns if c not in (key, *others)])
    return rows.withColumn("_key", F.bitwise_not(key)).join(turned, ["_key", *others], how).drop("_key")
