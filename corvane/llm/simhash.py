"""SimHash near-duplicates: BK-trees over shards of fingerprints, then connected components.

All trees of a corpus grow with it, so they can be neither on one machine nor broadcast. Fingerprints are dealt to
shards instead: of ``radius + 1`` blocks of bits, two fingerprints within the radius agree in one at least, so a shard
holds the fingerprints with one value of one block and each link shows in some shard. Shards of more than
``SHARD_LIMIT`` fingerprints are dealt again by blocks of their other bits, which loses no link either, until none is
larger; so few bits are then left that a shard cannot be. In a shard, a BK-tree (children keyed by their integer Hamming
distance to the parent) is searched along edges within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corvane.llm.common import join_anew
from corvane.session import discard, materialise, ship

RADIUS = 2
SHINGLE = 3
SEED = 42
BITS = 64
SHARD_LIMIT = 4096
#: Ids of removed documents, of 8 bytes each, that are broadcast.
BROADCAST_IDS = 1_000_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 18


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, with repeats; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, _CHUNK):
        m = min(_CHUNK, n - k)
        pairs = zip(starts[k : k + m].tolist(), ends[k + size - 1 : k + size - 1 + m].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, m)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = [_signed(fingerprint(t)) for t in b.column(1).to_pylist()]
        rest = range(2, b.num_columns)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *map(b.column, rest)], names=["doc_id", "fp", *(b.schema.names[k] for k in rest)])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), ``keep``; a row per row."""
    ship(docs.sparkSession)
    src = docs.select("doc_id", "text", *keep)
    schema = StructType([src.schema["doc_id"], StructField("fp", LongType()), *(src.schema[c] for c in keep)])
    return src.mapInArrow(_fingerprint_batches, schema)


class BKTree:
    """Nodes by integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int, radius: int) -> list[int]:
        """Insert a value not yet held; the held values within the radius of it."""
        if self.root is None:
            self.root = (value, {})
            return []
        near, stack = [], [self.root]
        while stack:
            held, children = stack.pop()
            d = (held ^ value).bit_count()
            if d <= radius:
                near.append(held)
            for e in range(d - radius, d + radius + 1):
                if e in children:
                    stack.append(children[e])
        held, children = self.root
        while True:
            d = (held ^ value).bit_count()
            if d not in children:
                children[d] = (value, {})
                return near
            held, children = children[d]


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """For each value linked inside the shard, but the smallest of its component: (value, that smallest)."""
    parent = {v: v for v in values}

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    tree = BKTree()
    for v in parent:
        for w in tree.add(v & (1 << 64) - 1, radius):
            a, b = find(v), find(_signed(w))
            parent[max(a, b)] = min(a, b)
    return [(v, root) for v in parent if (root := find(v)) != v]


def _link_shards(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; one shard is held at a time."""
    key, held, u, v = None, [], [], []

    def close() -> None:
        if len(held) > 1:
            for a, b in shard_links(held, radius):
                u.append(a)
                v.append(b)

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        u.clear()
        v.clear()
        return out

    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for *k, fp in zip(*columns, strict=True):
            if k != key:
                close()
                key, held = k, []
            held.append(fp)
        if len(u) > 10_000:
            yield batch()
    close()
    yield batch()


def _masks(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` runs of about equal length over bit positions."""
    cut = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [_signed(sum(1 << b for b in bits[cut[i] : cut[i + 1]])) for i in range(parts)]


def links(distinct: DataFrame, radius: int = RADIUS, limit: int = SHARD_LIMIT) -> DataFrame:
    """Star edges (u, v), v < u, that connect what lies within the radius; ``distinct``: fp, each once.

    A shard is a mask of bits and their value. Its fingerprints differ in the other bits alone, so dealing ends where
    those are too few for more than ``limit`` (or ``SHARD_LIMIT``) of them.
    """
    spark, parts = distinct.sparkSession, radius + 1
    rows, masks, settled = distinct.select("fp"), [0], []
    value = F.col("fp").bitwiseAND(F.col("mask"))
    while True:
        deals = [(_signed(m), _signed(m | x & (1 << BITS) - 1)) for m in masks for x in _masks([b for b in range(BITS) if not m >> b & 1], parts)]
        masks = [m & (1 << BITS) - 1 for _, m in deals]
        if len(deals) == parts:
            rows = rows.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for _, m in deals])).alias("mask"))
        else:  # the table has parts ** level rows: some hundreds at most
            table = spark.createDataFrame(deals, "mask bigint, next bigint")
            rows = rows.join(F.broadcast(table), "mask").select("fp", F.col("next").alias("mask"))
        if BITS - min(m.bit_count() for m in masks) <= max(limit, SHARD_LIMIT).bit_length() - 1:
            break
        sizes = rows.groupBy(value.alias("value"), "mask").agg(F.count(F.lit(1)).alias("n"))
        large = materialise(sizes.filter(F.col("n") > limit).select("value", "mask", F.lit(True).alias("large")), "large-shards")
        if large.isEmpty():
            break
        marked = join_anew(rows.withColumn("value", value), large, "value", "mask", how="left")
        settled.append(marked.filter("large IS NULL").select("fp", "mask"))
        rows = marked.filter("large").select("fp", "mask")
    for df in settled:
        rows = rows.unionByName(df)
    ship(spark)
    sorted_ = rows.select("mask", value.alias("value"), "fp").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
    return sorted_.mapInArrow(lambda it: _link_shards(it, radius), "u bigint, v bigint").distinct()


def components(edges: DataFrame, low: str = "u", high: str = "v") -> DataFrame:
    """(node, root): every node of an edge with the smallest node that it reaches, by alternating large and small stars.

    Each step aggregates on the node (partial sums first) and is written to the shared folder; the number of steps is
    logarithmic in a component's size in practice.
    """
    e = materialise(edges.select(F.greatest(low, high).alias("u"), F.least(low, high).alias("v")).filter("u <> v").distinct(), "cc")
    mark = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = join_anew(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # A row (u, v) of ``large`` has v < u, so its groups by u are the neighbours below u.
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_anew(large, below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(below.select("u", F.col("m").alias("v")))
        new = materialise(small.filter("u <> v").distinct(), "cc")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e)
        e = new
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def cluster(docs: DataFrame, radius: int = RADIUS, limit: int = SHARD_LIMIT) -> DataFrame:
    """Per row of docs: doc_id, fp, component_id (the smallest doc_id whose fingerprint its own reaches by links), root
    (the smallest fingerprint that its own reaches).

    Null, blank and empty texts have fingerprint 0, linked like any other. Copies share a fingerprint and meet only in
    partial minima: no pair of them is made. Repeated rows stay rows; a null doc_id is never a component's id unless
    the component has no other. An empty table gives no rows; other columns are ignored.
    """
    fps = materialise(fingerprints(docs), "fingerprints")
    groups = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-groups")
    roots = materialise(components(links(groups.select("fp"), radius, limit)), "fingerprint-roots")
    linked = roots.select(F.col("node").alias("fp"), "root")
    lowest = groups.join(linked, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    linked = join_anew(linked, lowest, "root").select("fp", "component_id", "root")
    ids = groups.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    ids = materialise(ids, "fingerprint-ids")
    for table in (groups, roots):
        discard(table)
    return join_anew(fps, ids, "fp").select("doc_id", "fp", "component_id", "root")


def keep_first(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Of each component the row with the smallest doc_id, then fingerprint; a null doc_id comes last. Of rows with one
    id and one fingerprint, one stays. Only linked rows remove each other, whatever ids are repeated or null.

    Rows leave by an anti join on the ids that go, broadcast if there are at most ``BROADCAST_IDS``: no text moves then.
    """
    leads = F.col("doc_id").eqNullSafe(F.col("component_id"))
    counted = materialise(clusters.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.max(leads).alias("_leads")), "lead-counts")
    alone = (F.col("_n") == 1) & F.col("doc_id").isNotNull()
    gone = materialise(counted.filter(~(F.col("_leads") & alone)).select("doc_id"), "ids-gone")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    single = docs.filter(F.col("doc_id").isNotNull()).join(few, "doc_id", "left_anti")
    shared = materialise(counted.filter(F.col("_leads") & ~alone).select(F.col("doc_id").alias("_id")), "ids-shared")
    discard(counted)
    if shared.isEmpty():
        return single
    among = lambda df: df.join(shared, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    chosen = among(clusters.filter(leads)).groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("_c")).select("_c.*").toDF("_id", "_fp")
    # A document's own columns travel as one, so that none is taken for the fingerprint.
    rows = fingerprints(among(docs).select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")), "_row").withColumnRenamed("fp", "_own")
    kept = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_fp"))).dropDuplicates(["doc_id", "_own"])
    return single.unionByName(kept.select("_row.*"))


def digest(clusters: DataFrame) -> DataFrame:
    return clusters.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
