"""Sessions, the shared folder of a job, and shipping this package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def build_session(app: str = "corvane", master: str = "local[*]", **conf: str) -> SparkSession:
    """A local session with the settings that the queries assume (UTC, adaptive execution)."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset a local session gets a new
    local folder; on a cluster, whose executors would not see it, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """Exchanges planned meanwhile have ``n`` partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """As ``materialise``, in buckets of a key: joins and sums by it take the rows where they are. Rows lie by the key in
    ``parts`` partitions already, or are taken there. The table's name is its own; ``discard`` drops it.
    """
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    own = f"corvane_{uuid.uuid4().hex}"
    df.repartition(parts, key).write.bucketBy(parts, key).format("parquet").option("path", path).saveAsTable(own)
    out = spark.table(own)
    out._corvane_path, out._corvane_table = path, own
    return out


def discard_path(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` or ``bucketed`` wrote and nothing reads any more."""
    own = getattr(df, "_corvane_table", None)
    if own:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {own}")
    path = getattr(df, "_corvane_path", None)
    if path:
        discard_path(df.sparkSession, path)


#: Bytes of an Arrow batch, in place of the engine's default of 64 MB: a worker holds several copies of one, so does its executor.
ARROW_BYTES, ARROW_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to tasks by a key, before work that takes far longer than reading them: few bytes, as of one file or of a
    small exchange, would otherwise be one task's. The number is given, so that adaptive execution does not join tasks again.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: nothing to do where PYTHONPATH has it, else add it to the job's files.

    Batches that go to them are bounded by ``ARROW_BYTES``, unless the session has a bound of its own.
    """
    if spark.conf.get(ARROW_SETTING).rstrip("b") == str(64 << 20):
        spark.conf.set(ARROW_SETTING, str(ARROW_BYTES))
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_corvane_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="corvane-ship-")) / "corvane_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "corvane").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._corvane_shipped = True
