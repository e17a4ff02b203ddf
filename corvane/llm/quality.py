"""Quality rules as a bitmask ledger (DataFrame functions only).

Each rule is evaluated once a document. The ledger keeps the measurements and one long whose bit i is set where rule i
fails. A policy is a version and a mask over those bits, so verdicts of other policies, and what each rule alone costs,
come from bitwise operations on the ledger without reading a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import barrier, words

SYMBOLS = "[#*$%&|<>]"
#: Name and condition of failure, over the measurements, in the order of their bits. Integers only.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 6 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("capitals", "10 * n_capitals > 4 * word_chars"),
    ("shouting", "10 * n_bangs > 3 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE_MASK = BIT["few_words"] | BIT["repeated_words"]


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


POLICIES = {
    "base": Policy("base", 1, ("few_words", "repeated_words")),
    "default": Policy("default", 1, tuple(BIT)),
    "no_capitals": Policy("no_capitals", 2, tuple(r for r in BIT if r not in ("capitals", "shouting"))),
}


def _measure(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    d = barrier(docs, _w=words(F.col("text")), _lines=F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_w")
    triple = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    d = barrier(
        d,
        _h=F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), triple)).otherwise(F.array().cast("array<bigint>")),
        n_words=n.cast("long"),
        word_chars=F.length(F.concat_ws("", "_w")).cast("long"),
        n_symbols=F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        n_lines=F.size("_lines").cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        n_capitals=F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long"),
        n_bangs=F.regexp_count(text, F.lit("!")).cast("long"),
    ).drop("_w", "_lines")
    # Only a text with a repeated window has its windows sorted.
    paired = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = barrier(d, _s=F.when(F.size(F.array_distinct("_h")) == F.size("_h"), none).otherwise(paired)).drop("_h")

    def again(x: Column, k: Column) -> Column:
        twin = (F.get("_s", k - 1)["h"] == x["h"]) | (F.get("_s", k + 1)["h"] == x["h"])
        return F.when(twin, x["i"])

    found = F.sort_array(F.filter(F.transform("_s", again), lambda i: i.isNotNull()))
    d = barrier(d, _p=found).drop("_s")
    # A window covers three words, less those that the next one covers too.
    gaps = F.zip_with(F.slice("_p", 2, F.size("_p")), F.col("_p"), lambda b, a: F.least(F.coalesce(b - a, F.lit(0)), F.lit(3)))
    covered = F.when(F.size("_p") > 0, F.aggregate(gaps, F.lit(3), lambda acc, g: acc + g)).otherwise(F.lit(0))
    return d.withColumn("n_repeat_words", covered.cast("long")).drop("_p")


def ledger(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Per row of docs: the columns ``keep`` (default doc_id), the measurements and ``failed_bits``.

    Words are maximal runs of characters other than ASCII white space. Null or blank text has no words and fails
    few_words. Repeated rows get a row each; an empty table gives none; other columns are ignored. Three-word windows
    are compared by 64-bit hashes within a document (a false repeat at about 3e-14 in a document of 1,000 words).
    """
    keep = ["doc_id"] if keep is None else keep
    src = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], "text")
    measured = _measure(src).drop("text") if "text" not in keep else _measure(src)
    bits: Column = F.lit(0).cast("long")
    for i, (_, failed) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_capitals", "n_bangs", "n_repeat_words"]
    return measured.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *names, bits.alias("failed_bits"))


def verdict(bits: Column, policy: Policy) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablation(led: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects."""
    cut = F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    rules = [(name, BIT[name]) for name in policy.rules]
    sums = []
    for name, bit in rules:
        sums.append(F.coalesce(F.sum((cut.bitwiseAND(F.lit(bit).cast("long")) != 0).cast("long")), F.lit(0)).alias(f"f_{name}"))
        sums.append(F.coalesce(F.sum((cut == bit).cast("long")), F.lit(0)).alias(f"o_{name}"))
    rows = [F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_only")) for n, _ in rules]
    return (
        led.agg(*sums)
        .select(F.explode(F.array(*rows)).alias("r"))
        .select(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "r.*")
    )


def by_group(led: DataFrame, group: str) -> DataFrame:
    """Per group: the bits that any and that every document fails."""
    return led.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.bit_or("failed_bits").alias("any_bits"), F.bit_and("failed_bits").alias("all_bits")
    )


def score_documents(docs: DataFrame, policy: Policy = POLICIES["default"]) -> DataFrame:
    led = ledger(docs)
    base = F.col("failed_bits").bitwiseAND(F.lit(BASE_MASK).cast("long")) != 0
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & verdict(F.col("failed_bits"), policy)).alias("kept"), "failed_bits",
    )


_BITS = " + ".join(f"(CASE WHEN {cond} THEN {1 << i} ELSE 0 END)" for i, (_, cond) in enumerate(RULES))
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w0 AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w,
              generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
w1 AS (SELECT r, i, w, lead(w) OVER (PARTITION BY r ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY r ORDER BY i) AS w3 FROM w0),
w2 AS (SELECT r, i, w, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS dup FROM w1),
w3 AS (SELECT r, w, bool_or(dup) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM w2),
ws AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, sum(CASE WHEN c THEN 1 ELSE 0 END) AS n_repeat_words FROM w3 GROUP BY r),
l0 AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
ls AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM l0
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals, len(regexp_extract_all(t, '!'))::BIGINT AS n_bangs
      FROM d LEFT JOIN ws USING (r) LEFT JOIN ls USING (r)),
b AS (SELECT *, ({_BITS})::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & {BASE_MASK}) <> 0 AS base_failed,
       (failed_bits & {POLICIES["default"].mask}) = 0 AS kept, failed_bits FROM b"""
