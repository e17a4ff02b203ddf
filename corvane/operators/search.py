"""Retrieval over a table of chunks for a table of queries: keyword, vector and hybrid ranking, packing, expansion."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import exploded_tokens, identifier_tokens, or_default, parted, token_estimate
from corvane.operators.best import Best, ids_of
from corvane.session import ship, spread

POOL, K, W_VECTOR, W_KEYWORD, BOOST, MOST = 50, 60, 0.6, 0.4, 0.35, 20
SYMBOL_BONUS = 15.0
#: Words that are broadcast; what one pass over the chunks takes: numbers of query vectors, queries and their words, short items.
BROADCAST_WORDS, BLOCK_NUMBERS, BLOCK_QUERIES, BLOCK_TERMS, SHORT_ITEMS = 500_000, 4 << 20, 4096, 500_000, 500


def term_frequency(chunks: DataFrame, text: Column) -> DataFrame:
    """(chunk_id, token, tf): the inverted index; written once, it serves every batch of queries.

    Texts are dealt to tasks by chunk_id, so their words are taken and counted there: words are not exchanged.
    """
    return exploded_tokens(spread(chunks.select("chunk_id", text.alias("text")), "chunk_id"), F.col("text"), "chunk_id").groupBy("chunk_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def top(df: DataFrame, group: str, order: list, k: int, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


@dataclass
class _Asked:
    """A block of queries: ids, lower-cased texts, and for each word the queries that have it and how often."""

    ids: pa.Array
    texts: list[str]
    words: dict[str, int]
    first: np.ndarray
    query: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(rows: list, kind: pa.DataType) -> _Asked:
        words, query, times = [], [], []
        for q, r in enumerate(rows):
            for token, k in Counter(r.tokens).items():
                words.append(token)
                query.append(q)
                times.append(k)
        names, at = np.unique(np.array(words, dtype=object), return_inverse=True) if words else (np.array([], object), np.array([], int))
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(len(names) + 1))
        return _Asked(pa.array([r.query_id for r in rows], kind), [r.text for r in rows], {w: i for i, w in enumerate(names)}, first, np.array(query, int)[order], np.array(times, float)[order])

    def scores(self, text: str, symbol: str, everywhere: str) -> np.ndarray | None:
        """A score a query, -inf where there is none; None where no query has one."""
        tf: Counter = Counter()
        for part, n in Counter(parted(text)).items():
            if len(part) > 1 and (w := self.words.get(part.lower())) is not None:
                tf[w] += n
        named = [q for q, t in enumerate(self.texts) if symbol in t] if symbol and symbol in everywhere else []
        if not tf and not named:
            return None
        words = np.fromiter(tf.keys(), int, len(tf))
        count = self.first[words + 1] - self.first[words]
        at = np.arange(count.sum()) + np.repeat(self.first[words] - (np.cumsum(count) - count), count)
        weight = np.repeat(1 + np.log1p(np.fromiter(tf.values(), float, len(tf))), count)
        base, m = (np.bincount(self.query[at], w, len(self.texts)).astype(float) for w in (self.times[at] * weight, self.times[at]))
        base[named] += SYMBOL_BONUS
        score = np.round(np.where(m > 1, base * (1 + 0.25 * m), base), 6)
        return np.where(score > 0, score, -np.inf)


def _keyword_batches(batches: Iterator[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:
    asked: _Asked = shared.value
    best, everywhere = Best(k, len(asked.texts)), "\0".join(asked.texts)
    for b in batches:
        texts, symbols, ids = b.column(1).to_pylist(), b.column(2).to_pylist(), ids_of(b.column(0))
        for at in range(0, b.num_rows, best.rows_at_once()):
            rows = range(at, min(b.num_rows, at + best.rows_at_once()))
            found = [(r, s) for r in rows if (s := asked.scores(texts[r] or "", symbols[r] or "", everywhere)) is not None]
            if found:
                best.add(np.array([s for _, s in found]), ids[[r for r, _ in found]])
        kind = b.schema.field(0).type
    if best.parts:
        yield from best.batches(asked.ids, kind)


def keyword_topk(chunks: DataFrame, text: Column, queries: DataFrame, k: int = POOL, symbol: Column | None = None) -> DataFrame:
    """chunks: chunk_id, and a text to be searched; queries: query_id, text: a stated set. (query_id, chunk_id, score, rank).

    Chunks are dealt to tasks by id. A chunk is scored in its task, for all queries of a block (``BLOCK_QUERIES``, of ``BLOCK_TERMS`` words): their words are
    broadcast, other words of the chunk count for nothing. A task gives out its best ``k`` of each query, so what is exchanged
    does not grow with the words. ``symbol``: a chunk's name; where it occurs in a query, letters in either case, that adds.
    """
    spark = chunks.sparkSession
    ship(spark)
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((chunks, "chunk_id"), (queries, "query_id"))}
    held = chunks.select("chunk_id", text.alias("text"), F.lower(F.coalesce(F.lit("") if symbol is None else symbol, F.lit(""))).alias("symbol"))
    held = spread(held, "chunk_id")
    schema, parts = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double", []
    rows = queries.select("query_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"), identifier_tokens(F.coalesce("text", F.lit(""))).alias("tokens")).orderBy("query_id").toLocalIterator()
    kind = pa.int32() if kinds["query_id"] == "int" else None
    for block in _blocks(rows):
        shared = spark.sparkContext.broadcast(_Asked.of(block, kind))
        parts.append(held.mapInArrow(lambda it, s=shared: _keyword_batches(it, s, k), schema))
    out = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return top(out, "query_id", [F.desc("score"), "chunk_id"], k)


def _blocks(rows: Iterator) -> Iterator[list]:
    block, terms = [], 0
    for r in rows:
        block.append(r)
        terms += len(r.tokens)
        if terms >= BLOCK_TERMS or len(block) >= BLOCK_QUERIES:
            yield block
            block, terms = [], 0
    if block:
        yield block


def _near_batches(batches: Iterator[pa.RecordBatch], asked, k: int) -> Iterator[pa.RecordBatch]:
    """A task's k best chunks of each query, ties to the smaller chunk_id."""
    ids, q = asked.value
    best = Best(k, len(q))
    for b in batches:
        for at in range(0, b.num_rows, best.rows_at_once()):
            part = b.slice(at, best.rows_at_once())
            v = np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(part.num_rows, -1)
            norm = np.sqrt((v * v).sum(axis=1))[:, None] * np.sqrt((q * q).sum(axis=1))[None, :]
            best.add(np.round(np.where(norm < 1e-9, 0.0, (v @ q.T) / np.where(norm < 1e-9, 1.0, norm)), 6), ids_of(part.column(0)))
        kind = b.schema.field(0).type
    if best.parts:
        yield from best.batches(ids, kind)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = POOL) -> DataFrame:
    """vectors: chunk_id, embedding; queries: query_id, embedding: a stated set, which meets every row in blocks of
    ``BLOCK_NUMBERS`` numbers. Chunks without an embedding, or of another length than the queries', have no rank.
    """
    spark = vectors.sparkSession
    ship(spark)
    asked = queries.filter(F.size("embedding") > 0).orderBy("query_id")
    size = asked.select(F.size("embedding")).first()
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, score double"
    if size is None:
        return spark.createDataFrame([], schema + ", rank int")
    held = vectors.filter(F.size("embedding") == size[0]).select("chunk_id", "embedding")
    every, block, parts = asked.filter(F.size("embedding") == size[0]).select("query_id", "embedding"), max(1, BLOCK_NUMBERS // size[0]), []
    rows = every.toLocalIterator(prefetchPartitions=False)
    while part := list(islice(rows, block)):
        kind = pa.int32() if queries.schema["query_id"].dataType.simpleString() == "int" else None
        shared = spark.sparkContext.broadcast((pa.array([r[0] for r in part], kind), np.array([r[1] for r in part], np.float64)))
        parts.append(held.mapInArrow(lambda it, s=shared: _near_batches(it, s, k), schema))
    return top(reduce(DataFrame.unionByName, parts), "query_id", [F.desc("score"), "chunk_id"], k)


def containing(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """chunks: chunk_id, text; items: query_id, text. (query_id, chunk_id) where the item's text stands in the chunk's.

    Between its first and its last space an item's longest word is whole in any text that holds the item, so ids of chunks and
    items meet on that word, and only the texts of those pairs are compared. Items of under three words are a stated set that
    is looked for in each text, in blocks.
    """
    inner = F.filter(F.slice(F.split("text", " "), 2, F.greatest(F.size(F.split("text", " ")) - 2, F.lit(0))), lambda w: w != "")
    keyed = items.select("query_id", F.col("text").alias("item"), F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("word"))
    words = keyed.filter("word IS NOT NULL")
    hint = F.broadcast if words.count() <= BROADCAST_WORDS else (lambda df: df)
    each = chunks.select("chunk_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    pairs = each.join(hint(words.select("query_id", "word")), "word").select("query_id", "chunk_id")
    found = chunks.select("chunk_id", "text").join(pairs, "chunk_id").join(keyed.select("query_id", "item"), "query_id").filter(F.contains("text", F.col("item"))).select("query_id", "chunk_id")
    short = keyed.filter("word IS NULL AND item <> ''").select("query_id", "item").toLocalIterator()
    while block := list(islice(short, SHORT_ITEMS)):
        hits = F.array(*[F.when(F.contains("text", F.lit(r.item)), F.lit(r.query_id)) for r in block])
        few = chunks.select(F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("query_id"), "chunk_id")
        found = found.unionByName(few.withColumn("query_id", F.col("query_id").cast(items.schema["query_id"].dataType)))
    return found.distinct()


def fuse(vector: DataFrame, keyword: DataFrame, importance: DataFrame | None = None, k: int = 8) -> DataFrame:
    """Weighted reciprocal ranks of both lists; importance (chunk_id, importance) boosts, missing or 0 counting as 1."""
    v = vector.select("query_id", "chunk_id", F.col("rank").alias("vrank"))
    w = keyword.select("query_id", "chunk_id", F.col("rank").alias("krank"))
    both = v.join(w, ["query_id", "chunk_id"], "full")
    part = lambda weight, r: F.coalesce(F.lit(weight) / (K + F.col(r)), F.lit(0.0))
    both = both.withColumn("rrf", part(W_VECTOR, "vrank") + part(W_KEYWORD, "krank"))
    imp: Column = F.lit(1.0)
    if importance is not None:
        both = both.join(importance, "chunk_id", "left")
        imp = or_default(F.col("importance"), 1.0)
    scored = both.select("query_id", "chunk_id", "vrank", "krank", F.round(F.col("rrf") * (1 + BOOST * (imp - 1)), 9).alias("score"))
    best = top(scored, "query_id", [F.desc("score"), "chunk_id"], min(MOST, k))
    # A rank of 0: not in that list.
    return best.withColumns({"score": F.round("score", 5), "vrank": F.coalesce("vrank", F.lit(0)), "krank": F.coalesce("krank", F.lit(0))})


def pack_context(blocks: DataFrame, budget: int) -> DataFrame:
    """blocks: query_id, rank, key, block. First of equal keys, then blocks in rank order before the first that overflows.

    Lengths decide first, so texts that do not fit are not moved.
    """
    sized = blocks.select("query_id", "rank", "key", token_estimate(F.col("block")).alias("tokens"), "block")
    first = Window.partitionBy("query_id", "key").orderBy("rank")
    once = sized.drop("block").withColumn("_k", F.row_number().over(first)).filter("_k = 1")
    run = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = once.withColumn("running", F.sum("tokens").over(run)).filter(F.col("running") <= budget).select("query_id", "rank", "tokens")
    held = kept.join(blocks.select("query_id", "rank", "block"), ["query_id", "rank"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"])
    return held.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("tokens").alias("token_count"), F.array_join(parts, "\n").alias("context"))


def expand(hits: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """hits: symbol; edges: src, dst, ordinal of ``calls``. Up to ``most`` callers and callees each, by ordinal."""
    ordered = lambda who: F.transform(F.array_sort(F.collect_list(F.struct("ordinal", who))), lambda x: x[who])
    names = hits.select("symbol").distinct()
    callers = top(names.join(edges, F.col("symbol") == F.col("dst")), "symbol", ["ordinal", "src"], most).groupBy("symbol").agg(ordered("src").alias("callers"))
    callees = top(names.join(edges, F.col("symbol") == F.col("src")), "symbol", ["ordinal", "dst"], most).groupBy("symbol").agg(ordered("dst").alias("callees"))
    empty = F.array().cast("array<string>")
    out = hits.join(callers, "symbol", "left").join(callees, "symbol", "left")
    return out.withColumns({"callers": F.coalesce("callers", empty), "callees": F.coalesce("callees", empty)})


def _sides(names: DataFrame, edges: DataFrame, symbols: DataFrame, own: str, other: str, by_file: bool, most: int | None) -> DataFrame:
    """(symbol, list): the other ends of the calls of each name, with their symbols' rows: of that file, or the first of that name."""
    keys = ["path", "name"] if by_file else ["name"]
    place = F.min(F.struct("path", "ordinal", "signature", "start_line", "end_line"))
    held = symbols.groupBy(*keys).agg(place.alias("_s")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_s")
    order = ["source_file", "source_symbol", "target_file", "target_symbol"]
    met = names.join(edges.filter("edge_type = 'calls'"), F.col("symbol") == F.col(f"{own}_symbol")).withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(*order)))
    met = met if most is None else met.filter(F.col("_r") <= most)
    on = F.col(f"{other}_symbol") == F.col("_name")
    met = met.join(held, on & (F.col(f"{other}_file") == F.col("_path")) if by_file else on, "left")
    item = F.struct(
        "_r", F.col(f"{other}_file").alias("file_path"), F.col(f"{other}_symbol").alias("symbol_name"), F.coalesce("_s.signature", F.lit("")).alias("signature"), "_s.start_line", "_s.end_line"
    )
    return met.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("_r")).alias(f"{other}s"))


def expand_symbols(hits: DataFrame, edges: DataFrame, symbols: DataFrame, most: int | None = 5) -> DataFrame:
    """hits: path, symbol; edges: source and target file and symbol, edge_type; symbols: path, name, ordinal, parent,
    signature, docstring, start_line, end_line. With ``callers`` and ``callees`` (lists of symbols, ``most`` at most, in
    order of file and name) and ``parent_class`` (the symbol that the hit's own one lies in, of the same file).
    """
    names = hits.filter("symbol <> ''").select("symbol").distinct()
    callers = _sides(names, edges, symbols, "target", "source", True, most).withColumnRenamed("sources", "callers")
    callees = _sides(names, edges, symbols, "source", "target", False, most).withColumnRenamed("targets", "callees")
    own = symbols.groupBy("path", F.col("name").alias("symbol")).agg(F.min_by("parent", "ordinal").alias("_parent"))
    up = symbols.groupBy("path", F.col("name").alias("_parent")).agg(F.min(F.struct("ordinal", "name", "signature", "docstring", "start_line", "end_line")).alias("parent_class"))
    up = up.withColumn("parent_class", F.col("parent_class").dropFields("ordinal"))
    out = hits.join(callers, "symbol", "left").join(callees, "symbol", "left").join(own, ["path", "symbol"], "left").join(up, ["path", "_parent"], "left").drop("_parent")
    kind = "array<struct<file_path:string,symbol_name:string,signature:string,start_line:int,end_line:int>>"
    return out.withColumns({c: F.coalesce(F.col(c).cast(kind), F.array().cast(kind)) for c in ("callers", "callees")})


def recall(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """ranked: query_id, chunk_id, rank; relevant: query_id, chunk_id. Recall at 1 and k (per cent) and MRR over all queries with relevant chunks."""
    first = ranked.join(relevant, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("r"))
    every = relevant.select("query_id").distinct().join(first, "query_id", "left")
    share = lambda cond: F.round(100 * F.avg(F.when(cond, 1.0).otherwise(0.0)), 4)
    return every.agg(
        F.count(F.lit(1)).alias("n"), share(F.col("r") <= 1).alias("recall_at_1"), share(F.col("r") <= k).alias(f"recall_at_{k}"),
        F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"),
    )
