"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

A window is ``size`` consecutive words of a benchmark item, or a whole shorter item. Its prefix is its rarest word, by
counts over all documents: a document holds the window only if it holds that word, at the word's own offset in the
window (positional bound) with enough words on either side (length bound). Document positions that hold a prefix word
join the windows on it and bring along the words around them; a candidate counts if those words equal the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import UPPER, barrier
from corvane.session import discard, materialise

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
WINDOW = 13
#: Windows up to this many, of at most this many bytes, are broadcast, and their prefix words made a literal set; more are shuffled.
BROADCAST_WINDOWS = 50_000
BROADCAST_BYTES = 64 << 20


def item_words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters and characters beyond ASCII.

    lower() also maps letters beyond ASCII, so texts that hold any are lowered by the table, which is slower.
    """
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))
    trimmed = F.btrim(lowered, F.lit(SEPARATORS))  # a pattern for either end would be tried from every place of a long run
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, the window's words; an item without words has none."""
    items = barrier(benchmark.select("item_id", "text"), _w=item_words(F.col("text"))).drop("text")
    n = F.size("_w")
    starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).when(n > 0, F.array(F.lit(1)))
    return items.select("item_id", "_w", F.explode(starts).alias("_s")).select("item_id", F.slice("_w", F.col("_s"), size).alias("window"))


def _prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """window, its rarest word and that word's first offset; words that no document has come first and drop the window."""
    each = windows.select("window").distinct()
    at = each.select("window", F.posexplode("window").alias("offset", "word"))
    by = Window.partitionBy("window").orderBy("n", "word", "offset")
    # Joined on the word reversed: both sides are exchanged for that, and adaptive execution splits a common word.
    turned = counts.select(F.reverse("word").alias("_turned"), "n")
    return (
        at.withColumn("_turned", F.reverse("word"))
        .join(turned, "_turned", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("_r", F.row_number().over(by))
        .filter("_r = 1 AND n > 0")
        .select("window", "word", "offset")
    )


def _bounded(df: DataFrame, most_rows: int = BROADCAST_WINDOWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if its rows and their bytes are within the bounds."""
    rows, size = df.select(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.to_json(F.struct("*"))).cast("long")), F.lit(0))).first()
    return F.broadcast(df) if rows <= most_rows and size <= most_bytes else df


def _measure(src: DataFrame, kept: list[str], benchmark: DataFrame, size: int, only_near: bool) -> tuple[DataFrame, DataFrame]:
    """src: ``kept`` columns and _text. Written tables of rows (kept, _row, n_words; with ``only_near`` just those that hold
    a prefix word) and of hits by row (_row, n_hit, items).

    A row is known by the number that it was written with, so equal rows stay rows and no key of the input is hot.
    """
    windows = materialise(benchmark_windows(benchmark, size), "bench-windows")
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    n_windows, n_bytes = windows.select(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.to_json("window"))), F.lit(0))).first()
    small = n_windows <= BROADCAST_WINDOWS and n_bytes <= BROADCAST_BYTES
    hint = F.broadcast if small else (lambda df: df)
    every = src.select(F.explode(item_words(F.col("_text"))).alias("word"))
    every = every.join(F.broadcast(vocabulary), "word", "left_semi") if small else every
    counts = every.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = counts if small else counts.join(vocabulary, "word", "left_semi")  # a common word is counted before it is dealt
    prefixes = materialise(_prefixes(windows, counts), "bench-prefixes")
    spent = [windows, prefixes]
    number = F.monotonically_increasing_id().alias("_row")
    if small:
        words = [r[0] for r in prefixes.select("word").distinct().collect()]
        split = barrier(src.withColumn("_row", number), _w=item_words(F.col("_text"))).drop("_text")
        places = F.filter(F.transform("_w", lambda w, i: F.when(w.isin(words), i)), lambda i: i.isNotNull())
    else:
        # Places of prefix words by a join on the word reversed, which both sides are exchanged for; texts come back by row.
        whole = materialise(src.select(*kept, "_text", number), "bench-texts")
        spent.append(whole)
        each = whole.select("_row", F.posexplode(item_words(F.col("_text"))).alias("_at", "word")).select("_row", "_at", F.reverse("word").alias("_turned"))
        near = each.join(prefixes.select(F.reverse("word").alias("_turned")).distinct(), "_turned", "left_semi")
        at = near.groupBy("_row").agg(F.sort_array(F.collect_list("_at")).alias("_at"))
        split = barrier(whole.join(at, "_row", "left"), _w=item_words(F.col("_text"))).drop("_text")
        places = F.coalesce("_at", F.array().cast("array<int>"))
    around = lambda i: F.struct(
        F.get("_w", i).alias("word"), i.alias("p"), F.slice("_w", F.greatest(i - (size - 2), F.lit(1)), F.least(i, F.lit(size - 1)) + size).alias("near")
    )
    placed = barrier(split, n_words=F.size("_w").cast("long"), _places=places)
    placed = placed.filter(F.size("_places") > 0) if only_near else placed
    rows = materialise(placed.select(*kept, "_row", "n_words", F.transform("_places", around).alias("_c")), "bench-rows")
    found = rows.select("_row", "n_words", F.explode("_c").alias("c")).select("_row", "n_words", "c.*")
    before = F.least(F.col("p"), F.lit(size - 1))  # words of ``near`` before the prefix word
    same = F.slice("near", F.greatest(before - F.col("offset") + 1, F.lit(1)), F.size("window")) == F.col("window")
    inside = (F.col("p") >= F.col("offset")) & (F.col("p") - F.col("offset") + F.size("window") <= F.col("n_words"))
    occurring = found.join(hint(prefixes), (found["word"] == prefixes["word"]) & inside & same).drop(prefixes["word"])
    owners = windows.select("window", F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item")).distinct()
    owners = materialise(owners.groupBy("window").agg(F.collect_set("item").alias("items")), "bench-owners")
    spent.append(owners)
    start = F.col("p") - F.col("offset")
    span = F.struct(start.alias("a"), (start + F.size("window")).alias("b"))
    of_row = occurring.join(hint(owners), "window").groupBy("_row").agg(F.collect_set(span).alias("_spans"), F.collect_set("items").alias("_items"))
    fold = F.aggregate(
        F.array_sort("_spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["b"]).alias("end"),
            (acc["n"] + F.greatest(x["b"] - F.greatest(acc["end"], x["a"]), F.lit(0))).alias("n"),
        ),
    )
    hits = materialise(of_row.select("_row", fold["n"].cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("_items"))).alias("items")), "bench-hits")
    for table in spent:
        discard(table)
    return rows.drop("_c"), hits


_CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def mark(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Per row of docs: ``keep`` (default doc_id), n_words, n_hit, n_items, items (sorted ids), contaminated.

    A document word inside any occurrence of a window is hit; a document is contaminated if some word is hit and at
    least one word in twenty is. Null or wordless text has no words and is clean. Repeated rows, and rows with equal or
    null ids, are a row each. An empty benchmark leaves every document clean; an empty table gives no rows. Items with
    a null id count as the item ``null``; repeated items count once. Columns other than ``keep`` are ignored, whatever
    their names; those kept must not be named like the new ones.
    """
    keep = ["doc_id"] if keep is None else keep
    names = [f"_k{i}" for i in range(len(keep))]
    src = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=True)], F.col("text").alias("_text"))
    rows, hits = _measure(src, names, benchmark, size, False)
    out = rows.join(_bounded(hits), "_row", "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select(
        *[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        F.expr(_CONTAMINATED).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs that ``mark`` calls clean, with all their columns, whatever their names.

    Only digests of contaminated texts are gathered, and rows leave by an anti join on them, broadcast if they are few:
    no clean text moves.
    """
    digest_of = lambda text: F.sha2(F.coalesce(text, F.lit("")), 256)
    src = docs.select(digest_of(F.col("text")).alias("_k0"), F.col("text").alias("_text"))
    rows, hits = _measure(src, ["_k0"], benchmark, size, True)
    found = rows.join(_bounded(hits), "_row").filter(_CONTAMINATED).select(F.col("_k0").alias("_digest")).distinct()
    gone = materialise(found, "bench-contaminated")
    for table in (rows, hits):
        discard(table)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), digest_of(F.col("text")).alias("_digest"))
    return held.join(_bounded(gone), "_digest", "left_anti").select("_row.*")


def digest(marked: DataFrame) -> DataFrame:
    return marked.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[s:s + least(13, len(w)) - 1] AS win, least(13, len(w)) AS m
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, s, w[s:s + m - 1] AS win FROM
       (SELECT doc_id, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) AS s FROM d, sizes)),
h AS (SELECT DISTINCT doc_id, s, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
pos AS (SELECT DISTINCT doc_id, unnest(range(s, s + m)) AS p FROM h),
n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)"""
