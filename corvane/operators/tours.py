"""Guided tours, roll-ups and listings: selections over files and symbols with their orders made total."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import dirname

# Patterns of entry files, in order.
ENTRY_PATTERNS = ["main.py", "app.py", "index.", "server.", "cli.", "__main__"]
# End of fixed values.


def entry_points(files: DataFrame, patterns: list[str] = ENTRY_PATTERNS, per_pattern: int = 2, most: int = 5) -> DataFrame:
    """files: path, importance. The most important ``most`` of each pattern's best (of equal ones the first pattern's);
    without any, the three best files."""
    hits = files.select("path", "importance", F.posexplode(F.array(*[F.col("path").contains(p) for p in patterns])).alias("pattern", "hit")).filter("hit")
    w = Window.partitionBy("pattern").orderBy(F.desc("importance"), "path")
    best = hits.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_pattern)
    found = best.groupBy("path").agg(F.min(F.struct("pattern", "r")).alias("o"), F.max("importance").alias("importance")).orderBy(F.desc("importance"), "o", "path").limit(most).select("path", "importance")
    if found.isEmpty():
        return files.orderBy(F.desc("importance"), "path").limit(3).select("path", "importance")
    return found


def round_robin(steps: DataFrame, most: int = 12) -> DataFrame:
    """steps: group, path, importance. Folders in order of first sight take turns; an emptied folder leaves the ring
    and the turn moves on past its successor. A step moves on by two folders at most, so the best ``most`` paths of each
    of the first ``2 * most`` folders decide."""

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        ranked = pdf.sort_values(["importance", "path"], ascending=[False, True], kind="stable")
        ring: list[list[tuple]] = []
        seen: dict[str, list] = {}
        for row in ranked.itertuples(index=False):
            folder = row.path.rsplit("/", 1)[0] if "/" in row.path else "root"
            if folder not in seen:
                seen[folder] = []
                ring.append(seen[folder])
            seen[folder].append((row.path, row.importance))
        out, at = [], 0
        while ring and len(out) < most:
            at = 0 if at >= len(ring) else at
            out.append(ring[at].pop(0))
            if not ring[at]:
                ring.pop(at)
            at += 1
        return pd.DataFrame({"group": pdf["group"].iloc[0], "step_order": range(1, len(out) + 1), "path": [p for p, _ in out], "importance": [i for _, i in out]})

    kind = steps.schema["group"].dataType.simpleString()
    folder = F.when(F.contains("path", F.lit("/")), F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)")).otherwise("root")
    best = Window.partitionBy("group", "_folder").orderBy(F.desc("importance"), "path")
    held = steps.select("group", "path", "importance", folder.alias("_folder")).withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= most)
    folders = held.groupBy("group", "_folder").agg(F.array_sort(F.collect_list(F.struct("_r", "path", "importance"))).alias("_held"))
    first = Window.partitionBy("group").orderBy(F.desc(F.col("_held")[0]["importance"]), F.col("_held")[0]["path"])
    near = folders.withColumn("_f", F.row_number().over(first)).filter(F.col("_f") <= 2 * most).select("group", F.explode("_held").alias("_s"))
    return near.select("group", "_s.path", "_s.importance").groupBy("group").applyInPandas(order, f"group {kind}, step_order int, path string, importance double")


def validate_steps(steps: DataFrame, files: DataFrame, slack: int = 10) -> DataFrame:
    """steps: path, start_line, end_line; files: path, line_count."""
    ok = "start_line >= 1 AND end_line >= start_line AND end_line <= line_count + " + str(slack)
    return steps.join(files.select("path", "line_count"), "path").filter(ok).drop("line_count")


def trace(hits: DataFrame, full: int = 4) -> DataFrame:
    """hits: query_id, rank, file. A hit of a file seen before goes once ``full`` files were seen; the rest is renumbered."""
    by_file = Window.partitionBy("query_id", "file").orderBy("rank")
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    marked = hits.withColumn("first", F.row_number().over(by_file) == 1)
    marked = marked.withColumn("seen", F.coalesce(F.sum(F.col("first").cast("int")).over(before), F.lit(0)))
    kept = marked.filter(F.col("first") | (F.col("seen") < full))
    return kept.withColumn("step_order", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).drop("first", "seen")


def first_of(df: DataFrame, group: str, item: str, order: str, most: int, sep: str) -> DataFrame:
    """(group, text): the first ``most`` items of each group in order, joined."""
    w = Window.partitionBy(group).orderBy(order)
    kept = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    items = F.transform(F.array_sort(F.collect_list(F.struct("_r", item))), lambda x: x[item])
    return kept.groupBy(group).agg(F.array_join(items, sep).alias("text"))


def folder_rollup(files: DataFrame) -> DataFrame:
    """files: path, summary. A folder's own files only, fifteen at most, in order of path."""
    named = files.select(dirname(F.col("path")).alias("folder"), "path", F.concat(F.lit("- "), F.element_at(F.split("path", "/"), -1), F.lit(": "), F.col("summary")).alias("line"))
    return first_of(named, "folder", "line", "path", 15, "\n")


def nest(children: DataFrame, group: str, order: str, fields: list[str]) -> DataFrame:
    """(group, items): a JSON list of the children in order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order]))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return children.groupBy(group).agg(F.to_json(rows).alias("items"))
