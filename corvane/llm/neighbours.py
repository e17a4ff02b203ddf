"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing, exact reranking of the merged candidates.

Vectors are hashed as points of one dimension more, where the largest inner product is the smallest Euclidean distance: a row x
becomes (x / M, sqrt(1 - |x|^2 / M^2)) with M the greatest length of all rows, a query q becomes (q / |q|, 0). A table's bucket is
the floors of several Gaussian projections divided by a width. A query visits, table by table, its own bucket and perturbed ones in
the order in which they are expected to hold neighbours; what any table gives is compared exactly.

Width and number of buckets are fitted: for a bounded sample of queries the true neighbours among all rows are found by brute force,
and the cheapest setting is taken that finds ``TARGET`` of them. A wider bucket is tried until one does, so no cap can stop short.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.session import discard, materialise, ship, table_path

TABLES, FUNCTIONS, SEED = 8, 8, 11
#: Share of the sample's true neighbours that the fitted setting finds, and most buckets that a table is asked for.
TARGET, MOST_PROBES = 0.96, 1024
#: The bounded sample: queries whose neighbours are found by brute force, and rows by which the share of candidates is estimated.
SAMPLE_QUERIES, SAMPLE_ROWS = 256, 4096
#: Queries that one pass over the index takes; keys of their buckets and numbers of a matrix in a worker are bounded too.
BLOCK, BLOCK_KEYS, CELLS = 4096, 4 << 20, 2 << 20


def usable(df: DataFrame, name: str, id_col: str, vector: str) -> DataFrame:
    """(name, v, h1, h2): vectors with finite entries and a length other than zero, of rows with an id; h1 and h2 hash v.

    An id is there once, with its first vector in order. Vectors that agree in 128 bits of hash count as equal.
    """
    v = F.transform(F.col(f"`{vector}`"), lambda x: x + F.lit(0).cast("float"))  # no negative zero
    held = df.select(F.col(f"`{id_col}`").alias(name), v.alias("v")).filter(f"{name} IS NOT NULL AND size(v) > 0")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    held = held.filter(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    return held.groupBy(name).agg(F.min("v").alias("v")).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(SEED), "v")})


def classes(rows: DataFrame, k: int) -> DataFrame:
    """Rows of equal vectors as one: (h1, h2, v, members), members being the k + 1 smallest ids in order.

    More can never be among the k nearest of a query, itself left out; the rest of a large group goes before the exchange.
    """
    first = Window.partitionBy("h1", "h2").orderBy("id")
    once = rows.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k + 1)
    return once.groupBy("h1", "h2").agg(F.any_value("v").alias("v"), F.sort_array(F.collect_list("id")).alias("members"))


def probing_order(functions: int, most: int) -> list[tuple[int, ...]]:
    """Sets of perturbations in order of expected squared distance to the buckets that they lead to.

    A perturbation is its place among a query's 2 * functions distances to the borders of its slots, nearest first; the
    expected squares of these order statistics rank all queries' sets alike. A set has one side of a function at most.
    """
    m, n = functions, 2 * functions
    cost = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (n + 1 - j) / (m + 1) + (n + 1 - j) * (n + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, n + 1)]
    out: list[tuple[int, ...]] = [()]
    queue = [(cost[0], (0,))]
    while queue and len(out) < most:
        c, places = heapq.heappop(queue)
        if len({min(p, n - 1 - p) for p in places}) == len(places):
            out.append(places)
        last = places[-1]
        if last + 1 < n:
            heapq.heappush(queue, (c - cost[last] + cost[last + 1], (*places[:-1], last + 1)))
            heapq.heappush(queue, (c + cost[last + 1], (*places, last + 1)))
    return out


@dataclass(frozen=True)
class Hashing:
    """Projections (a function a column), offsets in widths, multipliers that make a bucket's key of its floors, width, M, probes."""

    projections: np.ndarray
    offsets: np.ndarray
    multipliers: np.ndarray
    width: float
    longest: float
    probes: int = 1
    recall: float = 1.0

    @staticmethod
    def drawn(dimensions: int, longest: float, width: float) -> Hashing:
        rng = np.random.default_rng(SEED)
        a, b = rng.standard_normal((dimensions + 1, TABLES * FUNCTIONS)), rng.uniform(0, 1, TABLES * FUNCTIONS)
        return Hashing(a, b, rng.integers(-(2**62), 2**62, (TABLES, FUNCTIONS)) | 1, width, longest)

    def _slots(self, points: np.ndarray) -> np.ndarray:
        return (points @ self.projections / self.width + self.offsets).reshape(-1, TABLES, FUNCTIONS)

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """A row's bucket in every table."""
        x = rows / self.longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1, keepdims=True)))
        return (np.floor(self._slots(np.hstack([x, rest]))).astype(np.int64) * self.multipliers).sum(axis=2)

    def probe_keys(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """(query, table, bucket): the buckets that a query visits, in order."""
        scale = np.abs(queries).max(axis=1, keepdims=True)
        unit = queries / scale
        unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        slots = self._slots(np.hstack([unit, np.zeros((len(unit), 1))]))
        own = np.floor(slots)
        distance = np.concatenate([slots - own, 1 - (slots - own)], axis=2)
        step = np.concatenate([-self.multipliers, self.multipliers], axis=1)
        nearest = np.take_along_axis(np.broadcast_to(step, distance.shape), np.argsort(distance, axis=2, kind="stable"), axis=2)
        sets = probing_order(FUNCTIONS, probes)
        chosen = np.zeros((len(sets), 2 * FUNCTIONS), np.int64)
        for i, places in enumerate(sets):
            chosen[i, list(places)] = 1
        home = (own.astype(np.int64) * self.multipliers).sum(axis=2)
        return home[:, :, None] + np.einsum("qtj,sj->qts", nearest, chosen)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _visits(hashing: Hashing, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each table the visited buckets' keys in order, and the query of each."""
    keys, out = hashing.probe_keys(queries, hashing.probes), []
    for t in range(TABLES):
        flat = keys[:, t].ravel()
        order = np.argsort(flat, kind="stable")
        out.append((flat[order], (order // keys.shape[2]).astype(np.int32)))
    return out


def _marked(keys: np.ndarray, visits: list[tuple[np.ndarray, np.ndarray]], n_queries: int) -> np.ndarray:
    """(row, query): whether any table has the row in a bucket that the query visits."""
    mark = np.zeros((len(keys), n_queries), bool)
    for t, (visited, query) in enumerate(visits):
        low, high = (np.searchsorted(visited, keys[:, t], side) for side in ("left", "right"))
        count = high - low
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low, count)
        mark[np.repeat(np.arange(len(keys)), count), query[at]] = True
    return mark


def _best_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """Marks the k best of every column; of equal ones at the border the first."""
    if len(scores) <= k:
        return scores > -np.inf
    least = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
    above, equal = scores > least, (scores == least) & (least > -np.inf)
    return above | (equal & (np.cumsum(equal, axis=0, dtype=np.int32) <= k - above.sum(axis=0)))


def _reduce(parts: list[tuple], k: int) -> tuple:
    """The k best of every query over several batches, ties to the smaller id."""
    query, score, first, held = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((first, -score, query))
    query = query[order]
    starts = np.searchsorted(query, query)
    keep = np.arange(len(query)) - starts < k
    return query[keep], score[order][keep], first[order][keep], held[order][keep]


_VISITS: dict[str, list] = {}


def _search(batches: Iterator[pa.RecordBatch], shared, hashing: Hashing | None, k: int, carry: str) -> Iterator[pa.RecordBatch]:
    """A task's k best classes of each query of the block; without a hashing every row is a candidate."""
    name, queries = shared.value
    if hashing and name not in _VISITS:  # once a worker and block
        _VISITS.clear()
        _VISITS[name] = _visits(hashing, queries)
    parts, n = [], len(queries)
    for b in batches:
        if not b.num_rows:
            continue
        firsts = np.asarray(pa.compute.list_element(b.column("members"), 0))
        for rows in np.array_split(np.argsort(firsts, kind="stable"), -(-b.num_rows * n // CELLS)):
            some = b.take(pa.array(rows))
            vectors, scores = _matrix(some.column("v")), np.full((len(rows), n), -np.inf)
            if hashing:
                mark = _marked(np.asarray(some.column("keys").flatten()).reshape(len(rows), TABLES), _VISITS[name], n)
                for r in range(len(rows)):
                    asked = np.flatnonzero(mark[r])
                    scores[r, asked] = queries[asked] @ vectors[r]
            else:
                scores[:] = vectors @ queries.T
            row, query = np.nonzero(_best_rows(scores, k))
            used = np.unique(row)
            held = np.empty(len(rows), object)
            held[used] = [(m, w) for m, w in zip(some.column("members").take(pa.array(used)).to_pylist(), some.column(carry).take(pa.array(used)).to_pylist(), strict=True)]
            parts.append((query, scores[row, query], firsts[rows][row], held[row]))
            if sum(len(p[0]) for p in parts) > 8 * k * n:
                parts = [_reduce(parts, k)]
    if parts:
        query, score, _, held = _reduce(parts, k)
        for at in range(0, len(query), 10_000):
            part = slice(at, at + 10_000)
            columns = [query[part].astype(np.int32), score[part] + 0.0, [h[0] for h in held[part]], [h[1] for h in held[part]]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], b.schema.field(carry).type)], names=["q", "score", "members", carry])


def _found(index: DataFrame, queries: np.ndarray, hashing: Hashing | None, k: int, carry: str) -> DataFrame:
    """(q, score, members, carry, r): the k best classes of each query of a block, by number."""
    shared = index.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, queries))
    read = index.select("members", *{"v", carry, *(["keys"] if hashing else [])})
    schema = f"q int, score double, members array<bigint>, {carry} {index.schema[carry].dataType.simpleString()}"
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("members")[0])
    out = read.mapInArrow(lambda it: _search(it, shared, hashing, k, carry), schema)
    return out.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)


def _first_visit(hashing: Hashing, queries: np.ndarray, of: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
    """For each neighbour the number of buckets that its query must visit in a table to meet it; over the most, if never."""
    visited, own = hashing.probe_keys(queries, MOST_PROBES), hashing.keys(neighbours)
    out = np.full(len(own), MOST_PROBES + 1)
    for i, q in enumerate(of):
        met = visited[q] == own[i][:, None]
        out[i] = np.where(met.any(axis=1), met.argmax(axis=1) + 1, MOST_PROBES + 1).min()
    return out


def fit(held: DataFrame, queries: DataFrame, k: int) -> Hashing:
    """held: classes; queries: (h1, h2, v) of the same length. What reaches the driver is the bounded sample and its neighbours."""
    long = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    dimensions, longest = held.agg(F.max(F.size("v")), F.max(long)).first()
    longest *= 1 + 1e-12
    asked = queries.orderBy("h1", "h2").limit(SAMPLE_QUERIES).collect()
    some = np.array([r.v for r in held.orderBy("h1", "h2").limit(SAMPLE_ROWS).select("v").collect()], np.float64).reshape(-1, dimensions)
    sample = np.array([r.v for r in asked], np.float64).reshape(-1, dimensions)
    true = [r for r in _found(held, sample, None, k + 1, "v").collect() if len(r.members) > 1 or list(r.v) != list(asked[r.q].v)]  # not the query itself
    if not true:
        return Hashing.drawn(dimensions, longest, 1.0)
    of, near = np.array([r.q for r in true]), np.array([r.v for r in true], np.float64)
    x = near / longest
    unit = sample[of] / np.linalg.norm(sample[of], axis=1, keepdims=True)
    scale = float(np.median(np.sqrt(np.maximum(0.0, 2 - 2 * (x * unit).sum(axis=1))))) or 1.0
    best, width = None, scale
    while best is None or width <= 4 * scale:
        hashing = Hashing.drawn(dimensions, longest, width)
        visits = np.sort(_first_visit(hashing, sample, of, near))
        need = int(visits[int(np.ceil(TARGET * len(visits))) - 1])
        if need <= MOST_PROBES:
            tried = replace(hashing, probes=need, recall=float((visits <= need).mean()))
            share = float(_marked(tried.keys(some), _visits(tried, sample[:64]), min(64, len(sample))).mean())
            if best is None or share < best[0]:
                best = share, tried
        width *= 2
    return best[1]


def _key_batches(batches: Iterator[pa.RecordBatch], hashing: Hashing) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = hashing.keys(_matrix(b.column("v"))) if b.num_rows else np.zeros((0, TABLES), np.int64)
        yield b.append_column("keys", pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, TABLES), pa.int32()), pa.array(keys.ravel())))


def build(held: DataFrame, hashing: Hashing) -> DataFrame:
    """Every class with its bucket in every table."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields) + ", keys array<bigint>"
    return held.mapInArrow(lambda it: _key_batches(it, hashing), schema)


#: What a block of queries gives.
LISTS = "q int, h1 long, h2 long, list array<struct<score:double,vec_id:bigint>>"


def _lists(found: DataFrame, k: int) -> DataFrame:
    """(q, list): a query's k + 1 nearest, its own row among them, out of the members of its best classes."""
    item = F.struct((-F.col("score")).alias("s"), "vec_id", "score")
    order = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["score"].alias("score"), x["vec_id"].alias("vec_id")))
    return found.select("q", "score", F.explode("members").alias("vec_id")).groupBy("q").agg(F.slice(order, 1, k + 1).alias("list"))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", query_id: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, its own id left out, ties to the smaller id.

    rows and queries: an id (long) and a vector each; other columns are not read. Rows without an id, and vectors that are null,
    empty, zero, or hold null or non-finite entries take no part, nor do those of another length than most rows' (of lengths
    equally common the smallest). Of rows of one id the
    first vector in order takes part. Without rows or queries the result is empty. Lengths under 1e150 are assumed.

    Queries are a stated set: blocks of a bounded number are broadcast, one after another, and the written index is read once
    for each; a task sends on the best of a query that it holds, so candidates are never exchanged. A query whose buckets hold
    fewer than k others takes every row as a candidate.
    """
    spark = rows.sparkSession
    ship(spark)
    base, asked = usable(rows, "id", id_col, vector), usable(queries, "query_id", query_id, vector)
    sizes = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    same = F.size("v") == sizes.n
    held = materialise(classes(base.filter(same), k), "classes")
    distinct = materialise(asked.filter(same).groupBy("h1", "h2").agg(F.any_value("v").alias("v")), "queries")
    if distinct.isEmpty():
        return empty
    hashing = fit(held, distinct, k)
    index = materialise(build(held, hashing), "index")
    discard(held)
    block = max(1, min(BLOCK, BLOCK_KEYS // (TABLES * hashing.probes)))
    hashed, exact, stream, number = table_path(spark, "hashed"), [], distinct.toLocalIterator(), 0
    while part := list(islice(stream, block)):
        vectors = np.array([r.v for r in part], np.float64)
        names = spark.createDataFrame([(i, r.h1, r.h2) for i, r in enumerate(part)], "q int, h1 long, h2 long")  # a row a query of the block
        _lists(_found(index, vectors, hashing, k + 1, "keys"), k).join(F.broadcast(names), "q").write.parquet(f"{hashed}/block={number}")
        full = {r.q for r in spark.read.schema(LISTS).parquet(f"{hashed}/block={number}").filter(F.size("list") > k).select("q").collect()}
        if rest := [i for i in range(len(part)) if i not in full]:  # whose buckets hold too few: all rows are their candidates
            lists = _lists(_found(index, vectors[rest], None, k + 1, "keys"), k).withColumn("q", F.lit(rest)[F.col("q")])
            exact.append(materialise(lists.join(F.broadcast(names), "q").select("h1", "h2", "list"), "exact"))
        number += 1
    told = spark.read.schema(LISTS).parquet(*[f"{hashed}/block={i}" for i in range(number)]).filter(F.size("list") > k).select("h1", "h2", "list")
    for more in exact:
        told = told.unionByName(more)
    # On the complement of the hash both sides are exchanged, so that the copies of a common vector can be split.
    turned = told.select(F.bitwise_not("h1").alias("_h1"), F.bitwise_not("h2").alias("_h2"), "list")
    each = asked.filter(same).select("query_id", "h1", "h2").withColumns({"_h1": F.bitwise_not("h1"), "_h2": F.bitwise_not("h2")})
    kept = each.join(turned, ["_h1", "_h2"]).select("query_id", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("list"))
    return kept.select("query_id", F.posexplode("list").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def every(df: DataFrame, step: int, id_col: str = "vec_id") -> DataFrame:
    """The stated set of queries: rows whose id is divisible by ``step``."""
    return df.filter(F.col(id_col) % step == 0)


def search_embeddings(spark: SparkSession, sf_dir: str, k: int = 20, step: int = 20) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, every(rows, step), k)

