"""A run over a repository: scan, difference, parse, graph, rank, summaries, chunks, embeddings, a new version of its tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.model import OFFLINE, TextModel
from corvane.functions.vectors import with_embedding
from corvane.operators import code, graph, incremental, store, tours
from corvane.operators.store import drop_repository, table  # noqa: F401  (readers take them from here)
from corvane.session import discard, materialise, spread
from corvane.sources import code as sources

#: Rows whose keys are broadcast, so that the texts of what is new stay where they are.
BROADCAST_KEYS = 500_000
# How a summary's lines begin.
SYMBOL_LINE, FILE_LINE, FOLDER_LINE, FILE_HEAD, NO_SYMBOLS = "- {} ({}): {}", "- {}: {}", "- Directory `{}`: {}", "File Header: {}\n", "No discrete exported functions."
# Models by which calls are priced.
SUMMARY_MODEL, EMBEDDING_MODEL = "2.0-flash", "embedding"
# End of fixed values.


def _line(form: str, *parts: Column) -> Column:
    pieces = form.split("{}")
    return F.concat(*[x for piece, part in zip(pieces, [*parts, None], strict=True) for x in (F.lit(piece), part) if x is not None])


def summary_line(name: Column, kind: Column, summary: Column) -> Column:
    return _line(SYMBOL_LINE, name, kind, summary)


@dataclass
class Parts:
    """What a run makes of a tree before anything is stored."""

    files: DataFrame
    symbols: DataFrame
    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    folders: DataFrame


def analyse(files: DataFrame, parsed: DataFrame, model: TextModel = OFFLINE, most_steps: int = 100) -> Parts:
    """files: path, language, size_bytes, content_hash, line_count, text; parsed: as ``code.parse`` gives. Tables without
    repo_id; files with prompt_tokens, of what their summaries were asked with; chunks without embeddings.

    The graph and its scores are written to the shared folder; all else stays a plan.
    """
    nodes, edges = (materialise(df, name) for df, name in zip(graph.build(parsed), ("nodes", "edges"), strict=True))
    scores = materialise(graph.pagerank(nodes.select("node"), edges, most=most_steps), "scores")
    sym = code.symbols_of(parsed)
    scored = sym.withColumn("node", F.concat(F.lit("sym:"), "path", F.lit(":"), "name")).join(scores, "node", "left").drop("node")
    summary = T.symbol_summary(F.col("kind"), F.col("name"), F.col("signature"), F.coalesce("docstring", F.lit("")), F.col("content"))
    symbols = scored.withColumns({"importance": F.coalesce("score", F.lit(1.0)), "summary": summary}).drop("score", "calls")
    lines = tours.first_of(symbols.withColumn("line", summary_line(F.col("name"), F.col("kind"), F.col("summary"))), "path", "line", "ordinal", 20, "\n")
    heads = parsed.select("path", F.coalesce(_line(FILE_HEAD, F.col("file_docstring")), F.lit("")).alias("head"))
    own = scores.filter("node LIKE 'file:%'").select(F.substr("node", F.lit(6)).alias("path"), "score")
    importance = graph.file_importance(files.select("path").join(own, "path", "left"), symbols.select("path", F.col("importance").alias("score")))
    told = files.join(heads, "path", "left").join(lines.withColumnRenamed("text", "lines"), "path", "left").join(importance, "path")
    prompt = F.concat(F.coalesce("head", F.lit("")), F.coalesce("lines", F.lit(NO_SYMBOLS)))
    out = told.select("path", "language", "size_bytes", "content_hash", "line_count", "importance", F.col("path").isin(sources.ENTRY_FILES).alias("is_entrypoint"), model.summary(prompt).alias("summary"), T.token_estimate(prompt).alias("prompt_tokens"))
    out = materialise(out, "files")
    chunks = code.chunk(files, parsed).join(scores, "node", "left").withColumn("importance", F.coalesce("score", F.lit(1.0))).drop("score", "node")
    c = F.col
    text = T.embedding_text(c("path"), c("name"), c("kind"), c("header"), c("parent"), c("docstring"), c("content"))
    chunks = chunks.withColumns({"token_count": T.token_estimate(c("content")), "content_hash": F.sha2(text, 256), "embedding_text": text})
    folders = tours.folder_rollup(out).select(c("folder").alias("folder_path"), model.summary(c("text")).alias("summary_text"))
    return Parts(out, symbols, nodes, edges, chunks, folders)


def repo_summary(folders: DataFrame, model: TextModel = OFFLINE) -> DataFrame:
    """One row: the summary of all folders' summaries, in order of their paths. Folders are a repository's, not a corpus's."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("folder_path", "summary_text"))), lambda x: _line(FOLDER_LINE, x["folder_path"], x["summary_text"])), "\n")
    return folders.agg(lines.alias("lines")).select(model.summary(F.col("lines")).alias("repo_summary"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def parse(spark: SparkSession, files: DataFrame, out: str, repo_id: int, version: int) -> tuple[DataFrame, int]:
    """(as ``code.parse`` gives, number of texts parsed): only texts that no run has parsed in that language are."""
    mine = lambda: store.read(spark, out, "parsed").filter(F.col("repo_id") == repo_id)
    key = ["content_hash", "language"]
    once = files.groupBy(*key).agg(F.min("path").alias("path"))
    fresh = materialise(once.join(mine().select(*key), key, "left_anti"), "to-parse")
    parsed = code.parse(files.join(_few(fresh.select("path")), "path", "left_semi"))
    store.write(parsed.join(fresh, "path"), out, "parsed", repo_id, version)
    number = fresh.count()
    discard(fresh)
    return files.select("path", *key).join(mine(), key).select("path", "file_docstring", "symbols", "imports"), number


def embed(spark: SparkSession, chunks: DataFrame, out: str, repo_id: int, version: int, model: TextModel) -> tuple[DataFrame, DataFrame]:
    """(chunks with embeddings, what this run embedded: content_hash, tokens): a text that any run embedded is not again.

    chunks: chunk_id, content_hash of embedding_text, and others.
    """
    name = getattr(model, "name", type(model).__name__)
    mine = lambda: store.read(spark, out, "embeddings").filter((F.col("repo_id") == repo_id) & (F.col("model") == name))
    once = chunks.groupBy("content_hash").agg(F.min("chunk_id").alias("chunk_id"))
    fresh = materialise(once.join(mine().select("content_hash"), "content_hash", "left_anti"), "to-embed")
    texts = chunks.join(_few(fresh.select("chunk_id")), "chunk_id", "left_semi").select("content_hash", T.token_estimate(F.col("embedding_text")).alias("tokens"), "embedding_text")
    done = with_embedding(spread(texts, "content_hash"), F.col("embedding_text"), model.embed).withColumn("model", F.lit(name))
    store.write(done, out, "embeddings", repo_id, version)
    discard(fresh)
    added = mine().filter(F.col("version") == version).select("content_hash", "tokens")
    return chunks.drop("embedding_text").join(mine().select("content_hash", "embedding"), "content_hash"), added


def ready(repositories: DataFrame, repo_id: int) -> DataFrame:
    """The repository's row; ValueError unless its last run is complete."""
    found = repositories.filter((F.col("repo_id") == repo_id) & (F.col("status") == "ready"))
    if found.isEmpty():
        raise ValueError(f"repository {repo_id} is not ready")
    return found


def ingest(spark: SparkSession, scanned: DataFrame, out: str, repo_id: int, name: str, incremental_run: bool = False, model: TextModel = OFFLINE) -> dict[str, int]:
    """scanned: as ``sources.scan`` gives. Writes a new version of the repository's tables and returns the run's counts.

    A full run makes all rows anew. An incremental one keeps the rows of files that neither changed nor depend on one that did
    or went (one hop), and gives every row its new importance; links are those of the whole graph. Either parses and embeds only texts that no earlier run has.
    The states of the run are logged; readers see the new version once ``ready`` is, a run that fails changes nothing for
    them. The version before the last is then removed.
    """
    version, before = store.begin(spark, out, repo_id, name), store.current(spark, out, repo_id)
    try:
        stats = _run(spark, scanned, out, repo_id, version, name, before if incremental_run else None, model)
    except Exception:
        store.log(spark, out, repo_id, version, "failed", name)
        raise
    store.log(spark, out, repo_id, version, "ready", name)
    store.sweep(spark, out, repo_id, {version, before})
    return stats


def _run(spark: SparkSession, scanned: DataFrame, out: str, repo_id: int, version: int, name: str, before: int | None, model: TextModel) -> dict[str, int]:
    state = lambda status: store.log(spark, out, repo_id, version, status, name)
    old = lambda what: store.read(spark, out, what).filter((F.col("repo_id") == repo_id) & (F.col("version") == before)).drop("repo_id", "version")
    state("scanning")
    files = materialise(scanned, "scanned")
    state("parsing")
    parsed, n_parsed = parse(spark, files, out, repo_id, version)
    parts = analyse(files, parsed, model)
    now = files.select("path", F.col("content_hash").alias("hash"))
    if before is None:
        status = now.select("path", F.lit("new").alias("status"))
        process = now.select("path")
    else:
        status = materialise(incremental.classify(old("files").select("path", F.col("content_hash").alias("hash")), now), "status")
        process = incremental.impacted(status, old("edges").select("source_file", "target_file"))
    process = materialise(process, "process")
    labelled = graph.labelled_edges(parts.edges, parts.nodes)
    only = lambda df: df.join(process, "path", "left_semi")
    state("summarizing")
    told = only(parts.files)
    chunk_id = F.format_string("%s#%06d", "path", "ordinal")  # in order of path and ordinal, by which ties are broken
    chunks = materialise(only(parts.chunks).withColumn("chunk_id", chunk_id), "chunks")
    state("indexing")
    embedded, added = embed(spark, chunks, out, repo_id, version, model)
    fresh = {"files": told.drop("prompt_tokens"), "symbols": only(parts.symbols), "edges": labelled, "chunks": embedded}  # links may lead from files that did not change to new ones
    if before is not None:
        gone = status.filter("status = 'deleted'").select("path").union(process.select("path")).distinct()
        for what in ("files", "symbols", "chunks"):
            fresh[what] = old(what).join(gone, "path", "left_anti").unionByName(fresh[what])
        fresh["files"] = incremental.refresh_importance(fresh["files"], parts.files)
        keys = ["path", "name"]
        scores = parts.symbols.groupBy(*keys).agg(F.first("importance").alias("importance"))
        fresh["symbols"] = incremental.refresh_importance(fresh["symbols"], scores, keys)
        fresh["chunks"] = incremental.refresh_importance(fresh["chunks"], parts.chunks.select("path", "ordinal", "importance"), ["path", "ordinal"])
    fresh["folders"] = parts.folders
    fresh["usage"] = usage(told, added)
    store.write_all(fresh, out, repo_id, version)
    new = lambda what: store.read(spark, out, what).filter((F.col("repo_id") == repo_id) & (F.col("version") == version))
    count = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    total = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines")).first()
    stats = {
        "total_files": total.n, "total_symbols": new("symbols").count(), "total_lines": total.lines, "processed_files": process.count(), "unchanged_files": count.get("same", 0),
        "deleted_files": count.get("deleted", 0), "parsed_texts": n_parsed, "embedded_texts": added.count(),
    }
    stack = sources.tech_stack(files.select("path", "text"))
    row = repo_summary(new("folders"), model).crossJoin(F.broadcast(stack))  # two tables of one row
    commit = F.concat(F.lit("local_"), F.substring(F.sha2(F.lit(str(total.n)), 256), 1, 12))
    values = {k: F.lit(v).cast("long") for k, v in stats.items()} | {"name": F.lit(name), "status": F.lit("ready"), "commit_id": commit, "updated_at": F.current_timestamp()}
    store.write(row.withColumns(values), out, "repositories", repo_id, version)
    for df in (files, chunks, process, parts.files, parts.nodes, parts.edges):
        discard(df)
    return stats


def usage(told: DataFrame, added: DataFrame) -> DataFrame:
    """The run's calls of models: summaries of the files that were processed, texts embedded."""
    summaries = told.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt"), F.coalesce(F.sum(T.token_estimate(F.col("summary"))), F.lit(0)).alias("completion"))
    vectors = added.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("prompt"), F.lit(0).cast("bigint").alias("completion"))
    rows = summaries.select(F.lit("summary").alias("operation"), F.lit(SUMMARY_MODEL).alias("model"), "*").unionByName(vectors.select(F.lit("embedding").alias("operation"), F.lit(EMBEDDING_MODEL).alias("model"), "*"))
    return rows.withColumn("cost", T.cost(F.col("model"), F.col("prompt"), F.col("completion")))
