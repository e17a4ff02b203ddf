"""A training corpus from ``documents``: quality, near-duplicates, decontamination, personal data, packing.

Each stage takes all that its predecessor kept, returns a DataFrame that ``run`` writes and reads again, and, but for the
last, returns the columns of ``documents``. An empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate, packing, pii, quality, simhash
from corvane.session import discard, materialise


def _whole(docs: DataFrame, *columns: str, without: str | None = None) -> DataFrame:
    """Each row as one column ``_row``, and the named columns: no other column's name can clash with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != without]).alias("_row"), *columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the default policy rejects: null, empty and blank texts among them, as they have too few words.

    Repeated rows and null ids are judged row by row; columns of any name and kind are kept as they are.
    """
    led = quality.ledger(_whole(docs, "text"), keep=["_row"])
    return led.filter(quality.verdict(F.col("failed_bits"), quality.POLICIES["default"])).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays (a null id comes last, ties go by fingerprint).

    Null, empty and blank texts link to each other. Of repeated rows one stays, as copies are what the stage removes; rows that
    share an id but not a group do not remove each other. Columns of any name and kind are kept as they are.
    """
    held = _whole(docs, "doc_id", "text")
    return simhash.keep_first(held, simhash.cluster(held)).select("_row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents. Null and wordless texts are clean; repeated rows stay or go together; null and repeated
    ids do not matter. Columns of any name and kind are kept as they are.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces spans by the names of their kinds; n_chars, where there is one, follows the text. Null text stays null, empty
    text empty; every row stays a row, and all other columns are kept as they are, whatever their names.
    """
    found = pii.scan(_whole(docs, "text", without="text"), keep=["_row"])  # a text goes to Python once
    new = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids. Null text is empty and gives the end id alone; repeated rows are packed each; other columns go."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("packing", pack_sequences),
]

#: Fingerprints need XXH64 and packing a tokenizer, which DuckDB's SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs
