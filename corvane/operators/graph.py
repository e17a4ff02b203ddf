"""Graphs as node and edge tables: building, PageRank, bounded search, induced parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import circle, or_default
from corvane.operators import code
from corvane.session import bucketed, discard, materialise, partitions, ship

# The order in which kinds of edges are made, endings of module files, strokes of drawn edges.
PHASES = {"defines": 0, "imports": 1, "imports_symbol": 2, "calls": 3}
SUFFIXES = [".py", ".ts", ".js", "/index.ts", "/index.js", "/__init__.py"]
STROKES = {"calls": "#3b82f6", "other": "#10b981"}
# End of fixed values.
#: Nodes whose shares of rank are broadcast, of 16 bytes each, and bytes of their names.
BROADCAST_NODES, BROADCAST_NAMES = 1_000_000, 16 << 20
#: Links, and nodes, that one task ranks.
LOCAL_LINKS = 500_000
#: Nodes of a bucket of ranks, where they are too many to be broadcast: about 50 bytes each in a task's memory.
BUCKET_NODES = 500_000


def distinct_edges(edges: DataFrame) -> DataFrame:
    """edges: src, dst, edge_type. One a pair; the type of the latest phase stays."""
    phase = F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv])[F.col("edge_type")]
    return edges.groupBy("src", "dst").agg(F.max_by("edge_type", phase).alias("edge_type"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports: path, module; files: path. The first candidate that exists: each suffix as it is, then below the importer."""
    module = F.regexp_replace(F.replace("module", F.lit("."), F.lit("/")), "^/+|/+$", "")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    below = F.when(folder == "", F.lit("")).otherwise(F.concat(folder, F.lit("/")))
    tries = F.array(*[F.concat(head, module, F.lit(s)) for s in SUFFIXES for head in (F.lit(""), below)])
    each = imports.select("path", "module", F.posexplode(tries).alias("ord", "target"))
    found = each.join(files.select(F.col("path").alias("target")).distinct(), "target")
    return found.groupBy("path", "module").agg(F.min_by("target", "ord").alias("target"))


def resolve_calls(calls: DataFrame, defs: DataFrame, imported: DataFrame) -> DataFrame:
    """calls: path, caller, called; defs: path, name, ordinal; imported: path, name.

    Preference: the same file (not the caller's own name), a name that the file imports, the first definition. A
    definition ``A.b`` is found as ``b`` too, but an import asks for the whole name. Each level is settled once a name
    (and file), so a call meets a row a level at most, however many definitions a common name has. The joins are on names
    reversed: both sides are exchanged for them, and adaptive execution splits the calls of a very common name.
    """
    place = F.struct(F.col("path").alias("def_path"), "ordinal", F.col("name").alias("def_name"))
    index = defs.select("path", "name", "ordinal", F.explode(F.array_distinct(F.array("name", F.element_at(F.split("name", r"\."), -1)))).alias("called"))
    turned = F.reverse("called").alias("_turned")
    own = index.groupBy("path", "called").agg(F.array_sort(F.collect_list(place)).alias("_own")).select("path", turned, "_own")
    first = index.groupBy("called").agg(F.min(place).alias("_first")).select(turned, "_first")
    whole = defs.groupBy(F.col("name").alias("called")).agg(F.min(place).alias("_whole"))
    named = imported.select("path", F.col("name").alias("called")).distinct().join(whole, "called").select("path", turned, "_whole")
    met = calls.withColumn("_turned", F.reverse("called")).join(first, "_turned").join(own, ["path", "_turned"], "left").join(named, ["path", "_turned"], "left")
    other = F.get(F.filter("_own", lambda d: d["def_name"] != F.col("caller")), F.lit(0))
    level = F.when(other.isNotNull(), 0).when(F.col("_whole").isNotNull(), 1).otherwise(2)
    best = F.coalesce(other, F.col("_whole"), F.col("_first")).alias("_d")
    return met.select("path", "caller", "called", best, level.alias("level")).select("path", "caller", "called", "_d.def_path", "_d.def_name", "level")


def imported_symbols(names: DataFrame, defs: DataFrame) -> DataFrame:
    """names: path, name; defs: path, name. (path, name, def_path): every definition of just that name, each once."""
    a, b = names.select("path", "name").distinct(), defs.select(F.col("path").alias("def_path"), F.col("name").alias("_name")).distinct()
    return a.withColumn("_turned", F.reverse("name")).join(b.select("def_path", F.reverse("_name").alias("_turned")), "_turned").drop("_turned")


def build(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, type, label, path, kind; edges: src, dst, edge_type, with source and target file and symbol).

    Nodes are files and their symbols, a name once a file. Edges of all four kinds, one a pair: what a file defines, the
    file that an import means, the definitions of imported names, and what a symbol calls.
    """
    files = parsed.select("path").distinct()
    symbols, imports = code.symbols_of(parsed), code.imports_of(parsed)
    file_id, sym_id = (lambda p: F.concat(F.lit("file:"), p)), (lambda p, n: F.concat(F.lit("sym:"), p, F.lit(":"), n))
    base = F.element_at(F.split("path", "/"), -1)
    one = symbols.groupBy("path", "name").agg(F.max_by("kind", "ordinal").alias("kind"))
    nodes = files.select(file_id(F.col("path")).alias("node"), F.lit("file").alias("type"), base.alias("label"), "path", F.lit("").alias("kind"))
    nodes = nodes.unionByName(one.select(sym_id(F.col("path"), F.col("name")).alias("node"), F.lit("symbol").alias("type"), F.col("name").alias("label"), "path", "kind"))
    c = F.col
    edge = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"))
    names = imports.select("path", F.explode("names").alias("name")).distinct()
    given = imported_symbols(names, one)
    every = edge(one, file_id(c("path")), sym_id(c("path"), c("name")), "defines")
    every = every.unionByName(edge(resolve_imports(imports.select("path", "module").distinct(), files), file_id(c("path")), file_id(c("target")), "imports"))
    every = every.unionByName(edge(given, file_id(c("path")), sym_id(c("def_path"), c("name")), "imports_symbol"))
    resolved = resolve_calls(code.calls_of(parsed), symbols.select("path", "name", "ordinal"), names)
    every = every.unionByName(edge(resolved, sym_id(c("path"), c("caller")), sym_id(c("def_path"), c("def_name")), "calls"))
    return nodes, distinct_edges(every)


def labelled_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """source_file, source_symbol, target_file, target_symbol, edge_type: nodes by their paths and labels."""
    a = nodes.select(F.col("node").alias("src"), F.col("path").alias("source_file"), F.col("label").alias("source_symbol"))
    b = nodes.select(F.col("node").alias("dst"), F.col("path").alias("target_file"), F.col("label").alias("target_symbol"))
    return edges.join(a, "src").join(b, "dst").select("source_file", "source_symbol", "target_file", "target_symbol", "edge_type")


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    inn = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    return out.join(inn, "node", "full").select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, most: int = 100, tolerance: float | None = 1e-5, local: int | None = None, numbered: bool = False) -> DataFrame:
    """nodes: node; edges: src, dst, each pair once. (node, score): mean 1, to four decimals, 0.1 at least.

    Rank of nodes without out-edges goes to all. Stops after the step whose total change is under the tolerance. Nodes
    are numbered first, unless they are (``numbered``: all are bigints, and every end of an edge is one of them).
    Up to ``local`` links between as many nodes, of 16 bytes each, are counted and then ranked by one
    task, where a step takes milliseconds. Of a larger graph, in a step the links meet the shares of their sources, which are
    broadcast while there are at most ``BROADCAST_NODES`` of them; beyond, links and ranks lie in equal buckets, by source
    and by node. So links stay where they are, and one exchange takes partial sums to their nodes' ranks, which stay too.
    Each step is written to the shared folder: a lost executor repeats one step.
    """
    spark = nodes.sparkSession
    number = F.col("node").alias("id") if numbered else F.monotonically_increasing_id().alias("id")
    named = materialise(nodes.select("node").distinct().select("node", number), "rank-nodes")
    n, size = named.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col("node").cast("string")).cast("long")), F.lit(0))).first()
    if n < 2:
        return named.select("node", F.lit(1.0).alias("score"))
    small, before = n <= BROADCAST_NODES, int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = before if small else max(before, -(-n // BUCKET_NODES))
    keep = lambda df, name, key: materialise(df, name) if small else bucketed(df, name, key, parts)
    hint = F.broadcast if small else (lambda df: df.hint("shuffle_hash"))
    by = lambda name, to: (F.broadcast if size <= BROADCAST_NAMES else lambda df: df)(named.select(F.col("node").alias(name), F.col("id").alias(to)))
    score = F.greatest(F.round(F.col("rank") / F.col("mean"), 4), F.lit(0.1)).alias("score")
    local = LOCAL_LINKS if local is None else local
    with partitions(spark, parts):
        pairs = edges.select("src", "dst")
        pairs = pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")) if numbered else pairs.join(by("src", "a"), "src").join(by("dst", "b"), "dst").select("a", "b")
        links = keep(pairs, "rank-links", "a")
        if n <= local and links.count() <= local:
            ship(spark)
            both = links.unionByName(named.select(F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"))).coalesce(1)
            ranks = materialise(both.mapInArrow(lambda it: _rank_batches(it, damping, most, tolerance), "id bigint, rank double, mean double"), "ranks")
            discard(links)
            return named.join(ranks, "id").select("node", score)
        out = links.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
        start = F.lit(1.0 / n)
        rank = keep(named.select("id").join(out, "id", "left").select("id", "deg", start.alias("rank")), "rank", "id")
        loose = rank.filter("deg IS NULL").agg(F.sum("rank")).first()[0] or 0.0
        told = ["id", "deg", "rank", *([] if tolerance is None else ["old"])]
        for _ in range(most):
            share = rank.filter("deg IS NOT NULL").select(F.col("id").alias("a"), (F.col("rank") / F.col("deg")).alias("s"))
            into = links.join(hint(share), "a").groupBy(F.col("b").alias("id")).agg(F.sum("s").alias("s"))
            value = F.lit((1 - damping) / n) + damping * (F.coalesce("s", F.lit(0.0)) + F.lit(loose / n))
            met = rank.select("id", "deg", F.col("rank").alias("old")).join(hint(into), "id", "left")
            new = keep(met.select("id", "deg", value.alias("rank"), "old").select(*told), "rank", "id")
            change = F.lit(None) if tolerance is None else F.sum(F.abs(F.col("rank") - F.col("old")))
            change, loose = new.agg(change, F.coalesce(F.sum(F.when(F.col("deg").isNull(), F.col("rank"))), F.lit(0.0))).first()
            discard(rank)
            rank = new
            if tolerance is not None and change < tolerance:
                break
        discard(links)
        mean = rank.agg(F.avg("rank")).first()[0]
    ranked = rank.select("id", "rank").withColumn("mean", F.lit(mean))
    if numbered:
        discard(named)
        return ranked.select(F.col("id").alias("node"), score)
    return named.join(ranked, "id").select("node", score)


def _rank_batches(batches: Iterator[pa.RecordBatch], damping: float, most: int, tolerance: float | None) -> Iterator[pa.RecordBatch]:
    """All links (a, b) and nodes (a, null) of a small graph."""
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).is_valid().to_numpy(zero_copy_only=False), b.column(1).fill_null(0).to_numpy(zero_copy_only=False)) for b in batches]
    a, link, to = (np.concatenate(c) for c in zip(*held, strict=True))
    ids = np.sort(a[~link])
    r = _power_steps(len(ids), np.searchsorted(ids, a[link]), np.searchsorted(ids, to[link]), damping, most, tolerance)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(r), pa.array(np.full(len(ids), r.mean()))], names=["id", "rank", "mean"])


def _power_steps(n: int, a: np.ndarray, b: np.ndarray, damping: float, most: int, tolerance: float | None) -> np.ndarray:
    """The same steps over arrays: links from a to b, nodes from 0 to n - 1."""
    deg = np.bincount(a, minlength=n)
    loose, rank = deg == 0, np.full(n, 1 / n)
    for _ in range(most):
        into = np.bincount(b, (rank / np.maximum(deg, 1))[a], n)
        new = (1 - damping) / n + damping * (into + rank[loose].sum() / n)
        change, rank = np.abs(new - rank).sum(), new
        if tolerance is not None and change < tolerance:
            break
    return rank


def file_importance(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """files: path, score; symbols: path, score. Half of each; the file's alone without symbols; missing scores are 1.

    In decimals, so that no order of summation decides how a tie is rounded.
    """
    exact = F.coalesce("score", F.lit(1.0)).cast("decimal(28,12)")
    means = symbols.groupBy("path").agg(F.avg(exact).alias("s"))
    both = F.when(F.col("s").isNotNull(), (exact + F.col("s")) / 2).otherwise(exact)
    return files.join(means, "path", "left").select("path", F.round(both, 4).cast("double").alias("importance"))


def bounded_bfs(seeds: DataFrame, edges: DataFrame, depth: int = 3, fan_out: int | None = 5) -> DataFrame:
    """seeds: node; edges: src, dst, ordinal. (node, depth) of first sight, at most ``fan_out`` edges a node and level.

    A level takes only the edges of its frontier, which is broadcast while it has at most ``BROADCAST_NODES`` nodes, so that
    other edges stay where they are; what was seen is written once a level, so a level's plan does not hold those before it.
    From the first larger frontier on, all bounded edges are written once for the levels that are left.
    """
    seen = materialise(seeds.select("node", F.lit(0).alias("depth")).distinct(), "bfs")

    def bounded(df: DataFrame) -> DataFrame:
        if fan_out:
            w = Window.partitionBy("src").orderBy("ordinal", "dst")
            df = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= fan_out)
        return df.select("src", F.col("dst").alias("node")).distinct()

    links = None
    for d in range(1, depth + 1):
        frontier = seen.filter(F.col("depth") == d - 1).select(F.col("node").alias("src"))
        if frontier.count() <= BROADCAST_NODES:
            few = F.broadcast(frontier)
            out = bounded(edges.join(few, "src", "left_semi")) if links is None else links.join(few, "src", "left_semi")
        else:
            links = materialise(bounded(edges), "bfs-links") if links is None else links
            out = links.join(frontier, "src", "left_semi")
        new = out.select("node").distinct().join(seen, "node", "left_anti")
        before, seen = seen, materialise(seen.unionByName(new.withColumn("depth", F.lit(d))), "bfs")
        discard(before)
    if links is not None:
        discard(links)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def styled(edges: DataFrame) -> DataFrame:
    """Edges with what a drawing needs: label, animated, stroke."""
    call = F.col("edge_type") == "calls"
    return edges.withColumns({"label": F.col("edge_type"), "animated": call, "stroke": F.when(call, STROKES["calls"]).otherwise(STROKES["other"])})


def drawn(symbols: DataFrame, edges: DataFrame, most: int = 120) -> tuple[DataFrame, DataFrame]:
    """symbols: symbol_id, name, importance; edges: source_symbol, target_symbol, edge_type. (nodes with places on a
    circle, edges between shown names). Where shown symbols share a name, the last one has the edges; ``most`` bounds
    what the circle is made of, so its rows are numbered in one place.
    """
    top = symbols.withColumn("importance", or_default(F.col("importance"), 1.0)).orderBy(F.desc("importance"), "symbol_id").limit(most)
    ranked = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "symbol_id")) - 1)
    total = F.count(F.lit(1)).over(Window.partitionBy())
    x, y = circle(F.col("place"), F.col("total"), 350.0, 9.0)
    nodes = ranked.withColumn("total", total).select("symbol_id", "name", F.round("importance", 3).alias("importance"), "place", F.round(x + 500, 1).alias("x"), F.round(y + 500, 1).alias("y"))
    of_name = nodes.groupBy("name").agg(F.max_by("symbol_id", "place").alias("id"))
    a = of_name.select(F.col("name").alias("source_symbol"), F.col("id").alias("source"))
    b = of_name.select(F.col("name").alias("target_symbol"), F.col("id").alias("target"))
    shown = edges.join(F.broadcast(a), "source_symbol").join(F.broadcast(b), "target_symbol")  # at most ``most`` names
    return nodes, styled(shown).select("source", "target", "label", "animated", "stroke")
