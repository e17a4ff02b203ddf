"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A key descends region, rack and shard. At each level every child draws ``-ln(u) / weight`` from a hash of key and child
name; the smallest draw wins. A child's draw depends on nothing but the key, the child's name and its weight, so a
change of weights moves keys only between subtrees whose weight changed: with a shard in a region of its own, keys move
into it alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARDS_PER_RACK = 2
RACKS_PER_REGION = 2
SLOT_BUCKETS = 4096


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(n: int) -> list[Leaf]:
    """n shards of weight 1 to begin with, two to a rack, two racks to a region."""
    per_region = SHARDS_PER_RACK * RACKS_PER_REGION
    return [Leaf(s // per_region, (s % per_region) // SHARDS_PER_RACK, s) for s in range(n)]


def grow(leaves: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own: no other subtree's weight changes, so rows move into the new shard alone."""
    return [*leaves, Leaf(1 + max((x.region for x in leaves), default=-1), 0, 1 + max((x.shard for x in leaves), default=-1), weight)]


def _draw(key: Column, node: str, weight: float) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", key, F.lit(node))), 1, 12), 16, 10).cast("long")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**48))) / F.lit(float(weight))


def _pick(key: Column, nodes: Sequence[tuple[str, int, float]]) -> Column:
    """The id of the child with the smallest draw; equal draws go to the smaller id."""
    if len(nodes) == 1:
        return F.lit(nodes[0][1])
    return F.least(*[F.struct(_draw(key, name, w).alias("d"), F.lit(i).alias("i")) for name, i, w in nodes])["i"]


def assign(key: Column, leaves: Sequence[Leaf]) -> Column:
    """The shard of a key (a string column)."""
    tree: dict[int, dict[int, list[Leaf]]] = {}
    for leaf in leaves:
        tree.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    weight = lambda ls: sum(x.weight for x in ls)

    def case(chosen: Column, branches: list[tuple[int, Column]]) -> Column:
        out = branches[-1][1]
        for i, expr in reversed(branches[:-1]):
            out = F.when(chosen == i, expr).otherwise(out)
        return out

    def rack(r: int, k: int) -> Column:
        return _pick(key, [(f"shard{x.shard}", x.shard, x.weight) for x in tree[r][k]])

    def region(r: int) -> Column:
        chosen = _pick(key, [(f"rack{r}.{k}", k, weight(ls)) for k, ls in tree[r].items()])
        return case(chosen, [(k, rack(r, k)) for k in tree[r]])

    chosen = _pick(key, [(f"region{r}", r, sum(weight(ls) for ls in racks.values())) for r, racks in tree.items()])
    return case(chosen, [(r, region(r)) for r in tree]).cast("int")


def shard_documents(
    docs: DataFrame, leaves: Sequence[Leaf], grown: Sequence[Leaf] | None = None, buckets: int = SLOT_BUCKETS
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots count from 0 within a shard without gaps, in the order of a hash bucket of the id, then the id: rows are
    numbered inside a bucket and moved by the rows of the buckets before it, so no task sees a whole shard. The
    offsets are ``len(leaves) * buckets`` rows at most, whatever the input, and are broadcast under that bound.

    Null text counts as empty (size 1, crc 0). A null id is a key of its own. Repeated rows keep a slot each. An empty
    table gives no rows. Other columns are ignored.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        assign(key, leaves).alias("shard"),
        (assign(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % buckets).cast("int").alias("_bucket"),
    )
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["shard", "_bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("_before") + F.col("_row") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )


def oracle_sql(n: int = 8, buckets: int = SLOT_BUCKETS) -> str:
    """The same result in DuckDB's SQL, which has no crc32: its table is built by the rule and folded over the bytes."""
    step = "(CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END)"
    ctes = ["x0 AS (SELECT i, i AS c FROM range(256) t(i))"]
    ctes += [f"x{k} AS (SELECT i, {step.format(c='c')} AS c FROM x{k - 1})" for k in range(1, 9)]
    ctes.append("tab AS (SELECT list(c::BIGINT ORDER BY i) AS tab FROM x8)")

    def draw(node: str, weight: float) -> str:
        return f"(-ln((('0x' || substr(md5(k || '|{node}'), 1, 12))::BIGINT + 0.5) / {2**48}.0) / {weight:.1f})"

    def pick(nodes: list[tuple[str, str, float]]) -> str:
        if len(nodes) == 1:
            return nodes[0][1]
        arms = []
        for i, (name, value, w) in enumerate(nodes[:-1]):
            rest = " AND ".join(f"{draw(name, w)} <= {draw(m, v)}" for m, _, v in nodes[i + 1 :])
            arms.append(f"WHEN {rest} THEN {value}")
        return f"(CASE {' '.join(arms)} ELSE {nodes[-1][1]} END)"

    def expr(leaves: list[Leaf]) -> str:
        regions = sorted({x.region for x in leaves})
        out = []
        for r in regions:
            racks = sorted({x.rack for x in leaves if x.region == r})
            inner = []
            for k in racks:
                own = [x for x in leaves if (x.region, x.rack) == (r, k)]
                inner.append((f"rack{r}.{k}", pick([(f"shard{x.shard}", str(x.shard), x.weight) for x in own]), sum(x.weight for x in own)))
            out.append((f"region{r}", pick(inner), sum(w for *_, w in inner)))
        return pick(out)

    return f"""
WITH {", ".join(ctes)},
k AS (SELECT *, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, strlen(t)::BIGINT + 1 AS size, t, {expr(topology(n))}::INT AS shard,
      {expr(grow(topology(n)))}::INT AS grown_shard,
      ('0x' || substr(md5(k), 1, 8))::BIGINT % {buckets} AS b FROM k)
SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
         list_transform(range(1, size), lambda j: ('0x' || substr(hex(encode(t)), 2 * j::INT - 1, 2))::BIGINT)),
         lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))::BIGINT AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY b, doc_id, size) - 1 AS slot, grown_shard FROM p, tab"""
