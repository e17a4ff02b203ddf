"""Personal data by fixed patterns and a semi-Markov conditional random field.

The field labels whole spans: a segment of up to ``MAX_ATOMS`` atoms gets a kind and a score from features of the whole
span (its shape, digit count, groups, checksum, cue words and neighbours), and dynamic programming over segment ends
chooses boundaries and kinds together. Atoms are runs of letters or digits and single other characters. Weights come from
maximum likelihood (forward and backward sums over segments) on generated labelled sentences. Spans of the fixed
patterns always stay; the field adds those that overlap none of them.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.session import ship

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS = 24
MAX_CHARS = 120
#: Atoms before a span in which cue words count.
CUE_ATOMS = 7
#: Atoms whose segments are scored at once.
BLOCK_ATOMS = 512
L2 = 0.02
EPOCHS = 30
N_TRAIN = 720
MIN_MARGIN = 1.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[^\W\d_]")
_DIGITS = frozenset("0123456789")
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
_TRIGGER = re.compile(r"@|[0-9]+|[\[({<] ?at ?[\])}>]", re.I)
#: What a trigger begins with.
_TRIGGER_CHARS = frozenset("0123456789@[({<")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """At most 255, with any number of zeros before it."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping for each kind, in one pass a kind."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_octet, m[0].split("."))):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- features of whole spans ------------------------------------------------------------------------------------

_CUES = {
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telephone", "dial"),
    "email": ("email", "mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "cc"),
}
_CUE = {w: k for k, ws in _CUES.items() for w in ws}
_SHAPES: list[tuple[str, re.Pattern]] = [
    ("mail", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("mail_spelled", re.compile(r"[A-Za-z0-9._%+-]+ ?[\[({<] ?at ?[\])}>] ?[A-Za-z0-9-]+( ?[\[({<] ?dot ?[\])}>] ?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+", re.I)),
    ("mail_spaced", re.compile(r"[A-Za-z0-9._%+-]+ @ [A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("octets", re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}")),
    ("octets_spelled", re.compile(r"[0-9]{1,3}( ?[\[(]\.[\])] ?[0-9]{1,3}| ?\. ?[0-9]{1,3}){3}")),
    ("plus", re.compile(r"\+[0-9][ ().0-9-]+[0-9]")),
    ("area", re.compile(r"\([0-9]{3}\)[ -]?[0-9]{3}[ .-][0-9]{4}")),
    ("groups334", re.compile(r"([0-9]{1,2}[ .-])?[0-9]{3}([ .-])[0-9]{3}\2[0-9]{4}")),
    ("groups4444", re.compile(r"[0-9]{4}([ ./-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}")),
    ("double_zero", re.compile(r"00[ -]?[1-9][0-9]{0,2}[ .-][0-9 ().-]+[0-9]")),
    ("plain16", re.compile(r"[0-9]{14,19}")),
    ("trunk", re.compile(r"0[1-9][0-9]{1,3}[ /-][0-9]{3,4}[ -]?[0-9]{3,5}")),
    ("pairs", re.compile(r"0[1-9]([ .-])[0-9]{2}(\1[0-9]{2}){3}")),
    ("country", re.compile(r"[1-9][0-9]{0,2}( [0-9]{2,4}){3}")),
    ("dotted_four", re.compile(r"[0-9]+(\.[0-9]+){3}")),
]
_PER_SPAN = ["bias", *[s for s, _ in _SHAPES], "luhn", "octet_range", "digits_le9", "digits_10_13", "digits_14_19", "digits_gt19",
             "glued_left", "glued_right", "row_left", "row_right", "after_plus", "cue_same", "cue_other", "space_edge", "long_span", "has_letters", "no_shape"]
_N = len(_PER_SPAN)
_AT = {n: i for i, n in enumerate(_PER_SPAN)}
_LONG_SPAN = 60


class Region:
    """A stretch of text as atoms, and its candidate segments with their features."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.atoms = [(m.start(), m.end()) for m in _ATOM.finditer(text, start, end)]
        self.text = text
        self._cues = [_CUE.get(text[a:b].lower()) for a, b in self.atoms]

    @cached_property
    def segments(self) -> list[tuple[int, int, np.ndarray]]:
        return self._segments(0, len(self.atoms))

    def _segments(self, first: int, last: int) -> list[tuple[int, int, np.ndarray]]:
        """The candidates that start at the atoms from ``first`` to before ``last``, in order; each holds a trigger."""
        text, out, trigger = self.text, [], first
        for i in range(first, last):
            a = self.atoms[i][0]
            if not (text[a].isalnum() or text[a] in "(+"):
                continue
            trigger = max(trigger, i)
            while trigger < len(self.atoms) and text[self.atoms[trigger][0]] not in _TRIGGER_CHARS:
                trigger += 1
            for j in range(trigger + 1, min(i + MAX_ATOMS, len(self.atoms)) + 1):
                b = self.atoms[j - 1][1]
                if b - a > MAX_CHARS:
                    break
                if not text[b - 1].isalnum():
                    continue
                if (x := self._features(i, j, a, b)) is not None:
                    out.append((i, j, x))
        return out

    def _features(self, i: int, j: int, a: int, b: int) -> np.ndarray | None:
        text, span = self.text, self.text[a:b]
        digits = re.sub(r"[^0-9]", "", span)
        shapes = [s for s, p in _SHAPES if p.fullmatch(span)]
        if not shapes and (len(digits) < 7 or re.search(r"[^\W\d_]", span)):
            return None
        x = np.zeros(_N)
        x[_AT["bias"]] = 1
        for s in shapes:
            x[_AT[s]] = 1
        x[_AT["no_shape"]] = not shapes
        x[_AT["luhn"]] = 14 <= len(digits) <= 19 and luhn(digits)
        x[_AT["octet_range"]] = len(p := re.findall("[0-9]+", span)) == 4 and all(len(q) <= 3 and _octet(q) for q in p)
        n = len(digits)
        x[_AT["digits_le9" if n <= 9 else "digits_10_13" if n <= 13 else "digits_14_19" if n <= 19 else "digits_gt19"]] = 1
        x[_AT["glued_left"]] = a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_.-/+%" and a > 1 and text[a - 2].isalnum())
        x[_AT["glued_right"]] = b < len(text) and (text[b].isalnum() or text[b] in "_-/@%" or text[b] == "." and b + 1 < len(text) and text[b + 1].isalnum())
        x[_AT["row_left"]] = a > 1 and text[a - 1] in " .-\t|" and text[a - 2] in _DIGITS
        x[_AT["row_right"]] = b + 1 < len(text) and text[b] in " .-\t|" and text[b + 1] in _DIGITS
        x[_AT["after_plus"]] = re.search(r"\+[0-9]{1,3}[ -]?$", text[max(0, a - 6) : a]) is not None
        x[_AT["long_span"]] = b - a > _LONG_SPAN
        x[_AT["has_letters"]] = any(c.isalpha() for c in span)
        x[_AT["space_edge"]] = a == 0 or text[a - 1].isspace()
        near = [c for c in self._cues[max(0, i - CUE_ATOMS) : i] if c]
        return np.concatenate([np.where(np.arange(_N) == _AT["cue_same"], k in near, np.where(np.arange(_N) == _AT["cue_other"], bool(near) and k not in near, x)) for k in KINDS])

    @staticmethod
    def scores(segments: list[tuple[int, int, np.ndarray]], w: np.ndarray) -> np.ndarray:
        """A row a segment, a column a kind; an atom outside scores 0."""
        if not segments:
            return np.zeros((0, len(KINDS)))
        x = np.stack([s[2] for s in segments]).reshape(-1, len(KINDS), _N)
        return np.einsum("skn,kn->sk", x, w)

    def decode(self, w: np.ndarray) -> list[tuple[int, int, str]]:
        """The best segmentation, kinds included: V(j) = max(V(j-1), V(i) + score(i, j, kind)).

        One program over all atoms; features are made for a block of starts at a time, so memory is a few numbers an atom.
        """
        n = len(self.atoms)
        best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        for first in range(0, n, BLOCK_ATOMS):
            last = min(first + BLOCK_ATOMS, n)
            segments = self._segments(first, last)
            sc, s = self.scores(segments, w), 0
            for i in range(first, last):
                if i and best[i] <= best[i - 1]:
                    best[i], back[i] = best[i - 1], None
                while s < len(segments) and segments[s][0] == i:
                    j, k = segments[s][1], int(sc[s].argmax())
                    if (v := best[i] + sc[s, k] - MIN_MARGIN) > best[j]:
                        best[j], back[j] = v, (i, k)
                    s += 1
        if n and best[n] <= best[n - 1]:
            back[n] = None
        out, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((self.atoms[i][0], self.atoms[j - 1][1], KINDS[k]))
                j = i
        return out[::-1]

    def gradient(self, w: np.ndarray, gold: set[tuple[int, int, str]]) -> np.ndarray:
        """Of the log-likelihood: features of the gold spans less those expected over all segmentations."""
        n, sc = len(self.atoms), self.scores(self.segments, w)
        fwd, bwd = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        fwd[0] = bwd[n] = 0.0
        total = np.logaddexp.reduce(sc, axis=1) if len(sc) else np.zeros(0)
        ends: dict[int, list[int]] = {}
        starts: dict[int, list[int]] = {}
        for s, (i, j, _) in enumerate(self.segments):
            ends.setdefault(j, []).append(s)
            starts.setdefault(i, []).append(s)
        for j in range(1, n + 1):
            fwd[j] = np.logaddexp.reduce([fwd[j - 1], *[fwd[self.segments[s][0]] + total[s] for s in ends.get(j, ())]])
        for i in range(n - 1, -1, -1):
            bwd[i] = np.logaddexp.reduce([bwd[i + 1], *[bwd[self.segments[s][1]] + total[s] for s in starts.get(i, ())]])
        grad = np.zeros_like(w)
        for s, (i, j, x) in enumerate(self.segments):
            p = np.exp(fwd[i] + sc[s] + bwd[j] - fwd[n])
            a, b = self.atoms[i][0], self.atoms[j - 1][1]
            y = np.array([(a, b, k) in gold for k in KINDS], float)
            grad += (y - p)[:, None] * x.reshape(len(KINDS), _N)
        return grad


def _before(text: str, at: int, n: int, least: int) -> int:
    """Where the n-th atom before that of ``at`` starts, or ``least`` where that comes first."""
    for _ in range(n + 1):
        if at <= least:
            return least
        kind = next((p for p in (_DIGIT, _LETTER) if p.match(text, at - 1)), None)
        at -= 1
        while kind and at > least and kind.match(text, at - 1):
            at -= 1
    return at


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around triggers, in order and disjoint, of any length.

    A candidate holds a trigger and has at most MAX_CHARS characters, so each lies within one stretch, cue atoms included.
    """
    last = None
    for m in _TRIGGER.finditer(text):
        b = min(len(text), m.end() + MAX_CHARS)
        end = last[1] if last else 0
        a = m.start() - MAX_CHARS
        if a > end:
            a = _before(text, a + 1, CUE_ATOMS, end)
        if last and a <= end:
            last = (last[0], b)
            continue
        if last:
            yield last
        last = (max(0, a), b)
    if last:
        yield last


# --- labelled sentences -----------------------------------------------------------------------------------------


def labelled(seed: int, n: int) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """Generated sentences: personal data in plain and disguised forms, and numbers that are none."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvw") for _ in range(rng.randint(2, 9)))

    def card(k: int = 16) -> str:
        body = "4" + num(k - 2)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def not_card() -> str:
        body = card()
        return body[:-1] + str((int(body[-1]) + rng.randint(1, 9)) % 10)

    octets = lambda: [str(rng.randint(0, 255)) for _ in range(4)]
    group = lambda s: [s[i : i + 4] for i in range(0, len(s), 4)]
    positive = [
        lambda: (f"{word()}{num(2)}@{word()}.{rng.choice(['com', 'org', 'net', 'de'])}", "email"),
        lambda: (f"{word()}.{word()}@{word()}.example.com", "email"),
        lambda: (f"{word()} [at] {word()} [dot] com", "email"),
        lambda: (f"{word()}(at){word()}.org", "email"),
        lambda: (f"{word()} @ {word()}.com", "email"),
        lambda: (".".join(octets()), "ip"),
        lambda: ("[.]".join(octets()), "ip"),
        lambda: (card(), "card"),
        lambda: (rng.choice(" -").join(group(card())), "card"),
        lambda: ("/".join(group(card())), "card"),
        lambda: (f"+{rng.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", "phone"),
        lambda: (f"({num(3)}) {num(3)}-{num(4)}", "phone"),
        lambda: ("{0}{3}{1}{3}{2}".format(num(3), num(3), num(4), rng.choice("-.")), "phone"),
        lambda: (f"00{rng.randint(1, 99)} {num(3)} {num(3)} {num(4)}", "phone"),
    ]
    negative = [
        lambda: not_card(), lambda: not_card(), lambda: not_card(), lambda: not_card(), lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(1)}.{num(2)}.{num(1)}", lambda: num(rng.randint(3, 13)),
        lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"{rng.randint(256, 999)}.{num(2)}.{num(2)}.{num(2)}", lambda: f"{num(3)},{num(3)},{num(3)}",
        lambda: f"v{num(1)}.{num(1)}.{num(1)}.{num(1)}.{num(2)}", lambda: num(rng.randint(20, 30)), lambda: f"{num(3)} {num(3)} {num(3)}", lambda: f"{num(4)} {num(4)}", lambda: f"@{word()}", lambda: f"{num(3)}-{num(2)}", lambda: f"{num(5)} {num(5)} {num(6)}",
        lambda: " ".join(num(rng.randint(1, 4)) for _ in range(6)), lambda: f"{num(1)}.{num(4)}", lambda: rng.choice("-./").join(group(not_card())), lambda: f"{num(8)}.{num(6)}", lambda: f"{word()}{num(12)}",
    ]
    called = [  # telephones only after a word that says so
        lambda: f"0{rng.randint(20, 29)} {num(4)} {num(4)}", lambda: f"0{rng.randint(1, 7)}" + "".join(f" {num(2)}" for _ in range(4)),
        lambda: f"0{rng.randint(30, 999)}{rng.choice(' /-')}{num(rng.randint(6, 8))}", lambda: f"{rng.randint(30, 99)} {num(2)} {num(4)} {num(4)}",
        lambda: f"0{rng.randint(100, 199)} {num(3)} {num(4)}",
    ]
    cut = lambda s: " ".join(s[a:b] for a, b in zip((0, 3, 7, 10, 13), (3, 7, 10, 13, 16), strict=True))
    rows = [  # of tables; the last two hold a checksum by chance
        lambda: f"{num(3)} {num(3)} {num(4)} {num(rng.randint(1, 4))}", lambda: f"{num(rng.randint(1, 4))} {num(3)} {num(3)} {num(4)}", lambda: "\t".join(num(rng.randint(2, 5)) for _ in range(5)),
        lambda: " ".join(num(rng.choice([3, 3, 4])) for _ in range(rng.randint(4, 9))), lambda: f"{rng.randint(30, 99)} {num(2)} {num(4)} {num(4)}", lambda: " ".join(num(2) for _ in range(5)),
        lambda: "-".join(num(rng.choice([3, 3, 4])) for _ in range(rng.randint(4, 6))), lambda: f"{cut(card())} {num(4)} {num(3)}", lambda: f"{num(4)} {num(3)} {cut(card())}",
    ]
    out = []
    for _ in range(n):
        text, gold = "", set()
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(2, 5))) + " "
            form = rng.random()
            if form < 0.12:
                s = rng.choice(called)()
                text += rng.choice(_CUES["phone"]) + rng.choice([": ", " ", " us on ", " at "])
                gold.add((len(text), len(text) + len(s), "phone"))
            elif form < 0.24:
                s = rng.choice(rows)()
            elif form < 0.62:
                s, kind = rng.choice(positive)()
                if rng.random() < 0.2:
                    text += rng.choice(_CUES[kind]) + rng.choice([": ", " "])
                gold.add((len(text), len(text) + len(s), kind))
            else:
                s = rng.choice(negative)()
            text += s + rng.choice([" ", ". ", ", ", ") "])
        out.append((text + word(), gold))
    return out


@lru_cache(maxsize=1)
def trained() -> np.ndarray:
    """Weights by Adagrad on the log-likelihood of generated sentences; the same on every machine up to rounding."""
    data = [(Region(t, 0, len(t)), gold) for t, gold in labelled(7, N_TRAIN)]
    w, seen = np.zeros((len(KINDS), _N)), np.full((len(KINDS), _N), 1e-6)
    for _ in range(EPOCHS):
        for k in range(0, len(data), 30):
            g = sum(r.gradient(w, gold) for r, gold in data[k : k + 30]) / 30 - L2 * w / 10
            seen += g * g
            w += 0.5 * g / np.sqrt(seen)
    return np.round(w, 6)


def find_spans(text: str | None, w: np.ndarray) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans, and all spans: base ones and those that the field adds."""
    text = text or ""
    base = base_spans(text)
    if "@" not in text and not _DIGIT.search(text) and not _TRIGGER.search(text):
        return base, base
    added, k = [], 0
    taken = sorted((a, b) for a, b, _ in base)
    for a, b in regions(text):
        for s, e, kind in Region(text, a, b).decode(w):
            while k < len(taken) and taken[k][1] <= s:
                k += 1
            if not any(x < e and y > s for x, y in taken[max(0, k - 8) : k + 8]):
                added.append((s, e, kind))
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each stretch of overlapping spans becomes the name of its first span's kind."""
    out, last = [], 0
    merged: list[list] = []
    for a, b, kind in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _batches(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[list] = [[] for _ in range(8)]
        for text in b.column(b.num_columns - 1).to_pylist():
            base, spans = find_spans(text, w)
            for k, kind in enumerate(KINDS):
                rows[k].append(sum(s[2] == kind for s in base))
            rows[4].append(joined(base))
            rows[5].append(joined(spans))
            rows[6].append(len(spans) - len(base))
            rows[7].append(text if not spans else redact(text, spans))
        arrays = [pa.array(r, pa.string() if k in (4, 5, 7) else pa.int64()) for k, r in enumerate(rows)]
        names = [*b.schema.names[:-1], *[f"n_{k}" for k in KINDS], "base_spans", "spans", "n_added", "redacted"]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], names=names)


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Per row of docs: ``keep`` (default doc_id), n_email, n_ip, n_card, n_phone (base), base_spans, spans, n_added, redacted.

    Offsets are code points, ends exclusive. Null text has no spans and stays null; empty text has none. Repeated rows
    get a row each, an empty table gives none. Texts are taken whole, one at a time. Other columns are ignored, whatever
    their names; those kept may have any kind, but must not be named like the new ones.
    """
    keep = ["doc_id"] if keep is None else keep
    ship(docs.sparkSession)
    w = trained()
    # Arrow batches go by names without dots.
    src = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    new = StructType.fromDDL(", ".join(f"n_{k} bigint" for k in KINDS) + ", base_spans string, spans string, n_added bigint, redacted string")
    found = src.mapInArrow(lambda it: _batches(it, w), StructType(src.schema.fields[:-1] + new.fields))
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *new.names)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans")
