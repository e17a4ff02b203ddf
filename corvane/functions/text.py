"""Column functions over text: identifiers, estimates, predicates, parsing of small formats."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, price table, limits and texts that results depend on.
INJECTION_PATTERNS = [
    r"ignore\s+(previous|above|prior)\s+(instructions|prompt|rules)",
    r"you\s+are\s+now\s+a\s+(different|new)",
    r"disregard\s+(previous|above|all)",
    r"system\s*:\s*you\s+are",
    r"forget\s+(everything|all\s+previous)",
    r"\[system\]",
    r"<\|im_start\|>",
    r"###\s*instruction",
]
FAKE_KEY_PATTERNS = [r"^(test|demo|fake|invalid|placeholder)", r"(your[-_]?key|api[-_]?key[-_]?here)"]
ALLOWED_HOSTS = ["github.com", "gitlab.com", "bitbucket.org", "localhost", "127.0.0.1"]
COMMAND_PATTERNS = [
    r"`([^`]*(?:test|pytest|npm test|yarn test|make test)[^`]*)`",
    r"\$\s+([^\n]*(?:test|pytest)[^\n]*)",
    r"```[^\n]*\n([^\n]*(?:test|pytest)[^\n]*)",
]
README_SECTION = r"(?is)#+\s*(?:Quick\s*Start|Running|Getting\s*Started|Installation).*?(?=\n#+ |\z)"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
# US dollars for a million tokens, in the order of lookup: (name contained in the model, prompt, completion).
PRICES = [("2.0-flash", 0.075, 0.30), ("2.0-pro", 1.25, 5.00), ("1.5-flash", 0.075, 0.30), ("1.5-pro", 1.25, 5.00), ("embedding", 0.0, 0.0)]
TIER_TEXTS = {
    "core": ("Core Foundation & Backbone", "Highest structural centrality; imported and called extensively across the system."),
    "business logic": ("Business Logic & Orchestration", "Implements core domain operations and workflows."),
    "supporting": ("Supporting Module & Utilities", "Provides targeted utility, integration, or peripheral functionality."),
}
DIFFICULTY_TEXTS = {
    "beginner": ("Good First Issue (Beginner Friendly)", "emerald"),
    "intermediate": ("Intermediate (Moderate Fan-out)", "amber"),
    "advanced": ("Advanced (Broad Architectural Impact)", "red"),
}
SUMMARY_PREFIX, NO_SUMMARY = "Component summary: ", "Module component definition."
# End of fixed values.


# White space in the sense of Unicode, by which identifiers are parted besides ``_ . - /``.
_PARTS = r"[_.\-/\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def _parted(text: Column) -> Column:
    cased = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.split(cased, _PARTS)


_LOWER_UPPER, _UPPER_WORD, _PARTED = re.compile("([a-z0-9])([A-Z])"), re.compile("([A-Z]+)([A-Z][a-z])"), re.compile(_PARTS)


def parted(text: str) -> list[str]:
    """What ``identifier_tokens`` lower-cases, with single characters, of one text."""
    return _PARTED.split(_UPPER_WORD.sub(r"\1 \2", _LOWER_UPPER.sub(r"\1 \2", text)))


def identifier_tokens(text: Column) -> Column:
    """Words of identifiers: parts at case changes, ``_ . - /`` and white space; single characters go; lower case."""
    return F.transform(F.filter(_parted(text), lambda t: F.length(t) > 1), F.lower)


def exploded_tokens(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """``keep`` and token, a row a token: as ``identifier_tokens``, without the array."""
    each = df.select(*keep, F.explode(_parted(text)).alias("token"))
    return each.filter(F.length("token") > 1).withColumn("token", F.lower("token"))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def line_count(text: Column) -> Column:
    """Lines ended by CRLF, CR or LF, and one more for text after the last end."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), "\r", "\n")
    ends = F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit("")))
    return (ends + F.when((plain != "") & ~plain.endswith("\n"), 1).otherwise(0)).cast("long")


def heuristic_summary(text: Column) -> Column:
    """The first four trimmed lines of over five characters that open no code fence."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: (F.length(s) > 5) & ~s.startswith("```"))
    return F.when(F.size(lines) > 0, F.concat(F.lit(SUMMARY_PREFIX), F.array_join(F.slice(lines, 1, 4), " | "))).otherwise(F.lit(NO_SUMMARY))


def symbol_summary(kind: Column, name: Column, signature: Column, docstring: Column, content: Column) -> Column:
    """From the docstring if it has over ten characters, else the summary of signature and content."""
    told = F.concat(F.initcap(kind), F.lit(" `"), name, F.lit("` ("), signature, F.lit("): "), F.trim(docstring))
    return F.when(F.length(docstring) > 10, told).otherwise(heuristic_summary(F.concat_ws("\n", signature, F.substring(content, 1, 2000))))


def fallback_answer(prompt: Column) -> Column:
    return F.concat(F.lit("### Retrieval synthesis\n\n"), F.substring(prompt, 1, 1200), F.lit("\n\n*(offline)*"))


def embedding_text(path: Column, name: Column, kind: Column, signature: Column, parent: Column, doc: Column, content: Column) -> Column:
    line = lambda k, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{k}: "), c, F.lit("\n"))).otherwise(F.lit(""))
    head = F.concat(F.lit("File: "), path, F.lit("\nSymbol: "), name, F.lit(" ("), kind, F.lit(")\nSignature: "), signature, F.lit("\n"))
    return F.concat(head, line("Parent Class", parent), line("Docstring", doc), F.lit("\nCode:\n"), content)


def sanitize(text: Column, most: int = 10_000) -> Column:
    """Truncated, then without control characters other than tab, LF and CR."""
    return F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, most), CONTROL, "")


def sanitize_path(path: Column) -> tuple[Column, Column]:
    """(clean path or null, reason or null)."""
    clean = F.regexp_replace(F.replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"\x00", ""), F.lit("\\"), F.lit("/")), "^/+", "")
    reason = F.when(F.coalesce(path, F.lit("")) == "", None).when(clean.contains(".."), F.lit("parent")).when(~clean.rlike(r"^[a-zA-Z0-9/_.\-]+$"), F.lit("characters"))
    return F.when(reason.isNull(), clean), reason


def valid_url(url: Column) -> Column:
    """Local paths pass; others need https (or localhost) and an allowed host."""
    host = F.lit(False)
    for h in ALLOWED_HOSTS:
        host = host | url.contains(h)
    remote = (url.startswith("https://") | url.contains("localhost")) & host
    return F.when(F.coalesce(url, F.lit("")) == "", False).when(~url.startswith("http"), True).otherwise(remote)


def repo_of_url(url: Column) -> Column:
    """owner/name of a GitHub address, else null."""
    pattern = r"github\.com[:/]([^/]+)/([^/.]+)"
    return F.when(url.rlike(pattern), F.concat_ws("/", F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)))


def injection(text: Column) -> Column:
    return F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 2000)).rlike("|".join(f"({p})" for p in INJECTION_PATTERNS))


def valid_key(key: Column) -> Column:
    fake = F.lower(key).rlike("|".join(f"({p})" for p in FAKE_KEY_PATTERNS))
    return F.coalesce((F.length(key) >= 20) & ~fake, F.lit(False))


def client_key(address: Column, key: Column) -> Column:
    return F.concat_ws(":", address, F.substring(F.sha2(key, 256), 1, 16))


def traversal(path: Column) -> Column:
    return path.rlike(r"(^|/)\.\.(/|$)") | path.startswith("/")


def commands(text: Column) -> Column:
    """Test commands of a text: trimmed, distinct, in order of their characters, five at most."""
    found = F.array().cast("array<string>")
    for p in COMMAND_PATTERNS:
        found = F.array_union(found, F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(1)))
    return F.slice(F.array_sort(F.filter(F.array_distinct(F.transform(found, lambda c: F.trim(c))), lambda c: c != "")), 1, 5)


def labelled_field(text: Column, name: str, pattern: str, default: Column) -> Column:
    got = F.trim(F.regexp_extract(text, f"(?is){name}:\\s*{pattern}", 1))
    return F.when(got != "", got).otherwise(default)


def run_section(text: Column) -> Column:
    """The how-to-run section (1,000 characters at most), else the first 600 characters; trimmed."""
    section = F.regexp_extract(text, README_SECTION, 0)
    return F.trim(F.when(section != "", F.substring(section, 1, 1000)).otherwise(F.substring(text, 1, 600)))


def cost(model: Column, prompt: Column, completion: Column) -> Column:
    price = lambda k: F.coalesce(*[F.when(F.lower(model).contains(p[0]), F.lit(p[k])) for p in PRICES], F.lit(PRICES[0][k]))
    return (prompt * price(1) + completion * price(2)) / 1_000_000


def dirname(path: Column) -> Column:
    d = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(d == "", F.lit("root")).otherwise(d)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def event_line(event: Column, fields: Sequence[tuple[str, Column]]) -> Column:
    return F.concat_ws(" | ", event, *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in fields])


def word_slices(text: Column, size: int = 4) -> Column:
    words = F.split(text, " ")
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / size).cast("int")), lambda i: F.array_join(F.slice(words, i * size + 1, size), " "))


def circle(index: Column, n: Column, least: float, step: float) -> tuple[Column, Column]:
    """Places on a circle of radius max(least, step * n), to one decimal."""
    radius, angle = F.greatest(F.lit(least), n * F.lit(step)), index * 2 * F.pi() / F.greatest(n, F.lit(1))
    return F.round(radius * F.cos(angle), 1), F.round(radius * F.sin(angle), 1)


def tier(importance: Column) -> Column:
    return F.when(importance >= 2.0, "core").when(importance >= 1.2, "business logic").otherwise("supporting")


def _told(level: Column, texts: dict[str, tuple[str, ...]], k: int) -> Column:
    """The k-th text of a level."""
    return F.coalesce(*[F.when(level == name, F.lit(t[k])) for name, t in texts.items()])


def tier_told(tier: Column) -> tuple[Column, Column]:
    """(label, why to read it)."""
    return _told(tier, TIER_TEXTS, 0), _told(tier, TIER_TEXTS, 1)


def difficulty(files: Column, callers: Column) -> Column:
    return F.when((files <= 2) & (callers <= 3), "beginner").when(files <= 4, "intermediate").otherwise("advanced")


def difficulty_told(level: Column) -> tuple[Column, Column]:
    """(label, colour)."""
    return _told(level, DIFFICULTY_TEXTS, 0), _told(level, DIFFICULTY_TEXTS, 1)


def or_default(value: Column, default: object) -> Column:
    """A missing or zero value counts as missing."""
    return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value)
