"""Stored repositories: tables by repository and version, a log of runs that says which version is read, stores by content.

A run writes all its rows under a version of its own and logs ``ready`` last; readers follow the log, so what a run that stopped half
way has written is never read, and an empty table is empty. What depends on a text alone, its parse and its embeddings, is kept by the
text's hash and outlives versions. Everything is Parquet in folders by repo_id and version, written and read by Spark.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.operators import code, observe
from corvane.session import discard_path

#: A repository's tables, each with what a version of it holds.
TABLES = {
    "files": "path string, language string, size_bytes bigint, content_hash string, line_count bigint, importance double, is_entrypoint boolean, summary string",
    "symbols": "path string, ordinal int, name string, kind string, parent string, signature string, docstring string, start_line int, end_line int, content string, importance double, summary string",
    "edges": "source_file string, source_symbol string, target_file string, target_symbol string, edge_type string",
    "chunks": "path string, ordinal int, name string, chunk_type string, kind string, header string, parent string, docstring string, start_line int, end_line int, content string, importance double, "
    "token_count bigint, content_hash string, chunk_id string, embedding array<float>",
    "folders": "folder_path string, summary_text string",
    "repositories": "repo_summary string, stack array<string>, entrypoints array<string>, total_files bigint, total_symbols bigint, total_lines bigint, processed_files bigint, unchanged_files bigint, "
    "deleted_files bigint, parsed_texts bigint, embedded_texts bigint, name string, status string, commit_id string, updated_at timestamp",
    "usage": "operation string, model string, n bigint, prompt bigint, completion bigint, cost double",
}
#: Stores by content: what a version holds is what its run added.
STORES = {
    "parsed": "content_hash string, language string, " + code.PARSED.removeprefix("path string, "),
    "embeddings": "content_hash string, model string, tokens bigint, embedding array<float>",
}
RUNS = "repo_id bigint, version bigint, step int, status string, name string, at timestamp"
# The states of a run, in order; a run that fails ends in ``failed``, a repository that goes in ``deleted``.
STATES = ["pending", "scanning", "parsing", "summarizing", "indexing", "ready"]
# End of fixed values.


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read(spark: SparkSession, out: str, name: str) -> DataFrame:
    """All versions of a table or store, with repo_id and version; one that was never written has no rows."""
    schema = f"{(TABLES | STORES)[name]}, repo_id bigint, version bigint"
    return spark.read.schema(schema).parquet(f"{out}/{name}") if exists(spark, f"{out}/{name}") else spark.createDataFrame([], schema)


def write(df: DataFrame, out: str, name: str, repo_id: int, version: int) -> None:
    """A version's rows, in the place of any that it has."""
    fields = StructType.fromDDL((TABLES | STORES)[name]).fields
    rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields], F.lit(repo_id).cast("bigint").alias("repo_id"), F.lit(version).cast("bigint").alias("version"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id", "version").parquet(f"{out}/{name}")


def write_all(tables: dict[str, DataFrame], out: str, repo_id: int, version: int, at_once: int = 4) -> None:
    """Several tables, whose jobs need not wait for each other."""
    with ThreadPoolExecutor(at_once) as pool:
        for done in [pool.submit(write, df, out, name, repo_id, version) for name, df in tables.items()]:
            done.result()


# --- the log of runs --------------------------------------------------------------------------------------------------


def runs(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(f"{out}/runs") if exists(spark, f"{out}/runs") else spark.createDataFrame([], RUNS)


def log(spark: SparkSession, out: str, repo_id: int, version: int, status: str, name: str) -> None:
    step = STATES.index(status) if status in STATES else len(STATES)
    values = {"repo_id": repo_id, "version": version, "step": step, "status": status, "name": name}
    row = spark.range(1, numPartitions=1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.current_timestamp().alias("at"))
    row.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(RUNS)]).write.mode("append").parquet(f"{out}/runs")


def versions(spark: SparkSession, out: str) -> DataFrame:
    """(repo_id, version): the last complete version of every repository that is not deleted since."""
    when = lambda status: F.max(F.when(F.col("status") == status, F.col("version")))
    last = runs(spark, out).groupBy("repo_id").agg(when("ready").alias("version"), when("deleted").alias("gone"))
    return last.filter("version IS NOT NULL AND (gone IS NULL OR version > gone)").select("repo_id", "version")


def current(spark: SparkSession, out: str, repo_id: int) -> int | None:
    found = versions(spark, out).filter(F.col("repo_id") == repo_id).first()
    return found and found.version


def begin(spark: SparkSession, out: str, repo_id: int, name: str) -> int:
    """A new version: one run of a repository at a time."""
    last = runs(spark, out).filter(F.col("repo_id") == repo_id).agg(F.max("version")).first()[0]
    version = (last or 0) + 1
    log(spark, out, repo_id, version, "pending", name)
    return version


def repositories(spark: SparkSession, out: str) -> DataFrame:
    """A row a repository, deleted ones left out: the state of its last run, and the counts of its last complete one."""
    last = runs(spark, out).groupBy("repo_id").agg(F.max(F.struct("version", "step", "status", "name", "at")).alias("r")).select("repo_id", "r.status", "r.name", "r.at")
    counts = table(spark, out, "repositories").select("repo_id", "commit_id", "total_files", "total_symbols", "total_lines")
    return last.filter("status <> 'deleted'").join(counts, "repo_id", "left")


def cost(spark: SparkSession, out: str, repo_id: int) -> DataFrame:
    """Calls, tokens and cost of all complete runs of a repository, by model and in all."""
    done = runs(spark, out).filter((F.col("repo_id") == repo_id) & (F.col("status") == "ready")).select("version")
    return observe.cost_report(read(spark, out, "usage").filter(F.col("repo_id") == repo_id).join(done, "version", "left_semi"), ["model"], F.sum("n"))


# --- reading and removing ---------------------------------------------------------------------------------------------


def table(spark: SparkSession, out: str, name: str, repo_id: int | None = None) -> DataFrame:
    """The complete version of a stored table, of one repository (whose folder alone is listed) or of all."""
    held = read(spark, out, name)
    if repo_id is None:
        return held.join(versions(spark, out), ["repo_id", "version"], "left_semi").drop("version")
    version = current(spark, out, repo_id)
    return held.filter((F.col("repo_id") == repo_id) & (F.col("version") == (-1 if version is None else version))).drop("version")


def file_text(spark: SparkSession, out: str, repo_id: int, path: str) -> DataFrame:
    """(path, language, ordinal, start_line, end_line, content): a stored file by its symbols, in order; no row if there is none."""
    files = table(spark, out, "files", repo_id).filter(F.col("path") == path).select("path", "language")
    held = table(spark, out, "symbols", repo_id).filter(F.col("path") == path).select("path", "ordinal", "start_line", "end_line", "content")
    return files.join(held, "path", "left").orderBy("ordinal")


# --- tours ------------------------------------------------------------------------------------------------------------

TOURS = "kind string, title string, step_order int, path string, name string, start_line int, end_line int, body string, repo_id bigint, tour_id bigint"


def _tours(spark: SparkSession, out: str, repo_id: int) -> DataFrame:
    held = spark.read.schema(TOURS).parquet(f"{out}/tours") if exists(spark, f"{out}/tours") else spark.createDataFrame([], TOURS)
    return held.filter(F.col("repo_id") == repo_id)


def save_tour(steps: DataFrame, out: str, repo_id: int, kind: str, title: str) -> int:
    """steps: step_order, path, name, start_line, end_line, body. The new tour's number; one without steps is not kept (0)."""
    spark = steps.sparkSession
    tour_id = 1 + (_tours(spark, out, repo_id).agg(F.max("tour_id")).first()[0] or 0)
    values = {"kind": F.lit(kind), "title": F.lit(title), "repo_id": F.lit(repo_id).cast("bigint"), "tour_id": F.lit(tour_id).cast("bigint")}
    fields = StructType.fromDDL(TOURS).fields
    rows = steps.withColumns(values).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id", "tour_id").parquet(f"{out}/tours")
    return tour_id if exists(spark, f"{out}/tours/repo_id={repo_id}/tour_id={tour_id}") else 0


def tours_of(spark: SparkSession, out: str, repo_id: int) -> DataFrame:
    """A row a tour, the newest first: tour_id, kind, title, steps (a list in order)."""
    step = F.struct("step_order", "path", "name", "start_line", "end_line", "body")
    return _tours(spark, out, repo_id).groupBy("tour_id", "kind", "title").agg(F.array_sort(F.collect_list(step)).alias("steps")).orderBy(F.desc("tour_id"))


def delete_tour(spark: SparkSession, out: str, repo_id: int, tour_id: int) -> None:
    discard_path(spark, f"{out}/tours/repo_id={repo_id}/tour_id={tour_id}")


# --- removing ---------------------------------------------------------------------------------------------------------


def sweep(spark: SparkSession, out: str, repo_id: int, keep: set[int]) -> None:
    """Removes the tables' other versions; stores stay."""
    for name in TABLES.keys() - {"usage"}:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}/repo_id={repo_id}")
        fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(place) if fs.exists(place) else []:
            version = status.getPath().getName().partition("version=")[2]
            if version and int(version) not in keep:
                discard_path(spark, status.getPath().toString())


def drop_repository(spark: SparkSession, out: str, repo_id: int) -> None:
    """Logged first, so that no reader finds a repository of which a part is gone."""
    log(spark, out, repo_id, begin(spark, out, repo_id, ""), "deleted", "")
    for name in [*TABLES, *STORES, "tours"]:
        discard_path(spark, f"{out}/{name}/repo_id={repo_id}")
