"""Secrets by fixed patterns and a character convolutional network over every candidate.

Candidates are the fixed patterns' matches and every maximal run of at least 16 key characters that has a letter and a
digit; shorter runs and those of letters or digits alone are left to the patterns. The network (numpy) reads a
candidate's characters and those around it, a long candidate in overlapping parts: embedding, one convolution, maxima
over the candidate and over its surroundings, a hidden layer. It is trained on generated labelled findings. Findings
held out from training give the calibration (a slope and an offset of the scores) and the threshold, the largest that
keeps the asked recall with 95 per cent confidence; others, held out from both, measure them. Spans of the fixed
patterns always stay; the network adds those that overlap none of them.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.session import ship

KINDS = ("assign", "access", "hex")
#: Labelled findings that are generated: for training, for calibration and threshold, for measuring.
N_TRAIN, N_FIT, N_TEST = 3200, 2000, 2000
MIN_RECALL = 0.98
BEFORE, INSIDE, AFTER = 32, 64, 16
DECAY = 0.02
WIDTH, EMBED, FILTERS, HIDDEN, KERNEL = BEFORE + INSIDE + AFTER, 12, 32, 16, 5
EPOCHS = 14

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_NAMES = re.compile("password|passwd|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns.

    ``[0-9a-f]{32,}`` matches the same spans as all maximal runs less those under 32 characters.
    """
    out = []
    if _NAMES.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of 16 and more key characters with a letter and a digit."""
    return [m.span() for m in _RUN.finditer(text) if _DIGIT.search(m[0]) and _LETTER.search(m[0])]


# --- network ------------------------------------------------------------------------------------------------------


def _code(c: str) -> int:
    o = ord(c)
    return o - 30 if 32 <= o < 127 else 1


def window(text: str, start: int, end: int) -> np.ndarray:
    """Codes of the characters before, in and after a candidate; 0 where there are none. Long candidates keep both ends."""
    inside = text[start:end]
    if len(inside) > INSIDE:
        inside = inside[: INSIDE // 2] + inside[-INSIDE // 2 :]
    x = np.zeros(WIDTH, np.uint8)
    left = text[max(0, start - BEFORE) : start]
    x[BEFORE - len(left) : BEFORE] = [_code(c) for c in left]
    x[BEFORE : BEFORE + len(inside)] = [_code(c) for c in inside]
    right = text[end : end + AFTER]
    x[BEFORE + INSIDE : BEFORE + INSIDE + len(right)] = [_code(c) for c in right]
    return x


def windows(text: str, start: int, end: int) -> Iterator[np.ndarray]:
    """A candidate's window and, if it is long, those of its overlapping parts, so that each of its characters is seen."""
    yield window(text, start, end)
    if end - start > INSIDE:
        for a in [*range(start, end - INSIDE, INSIDE // 2), end - INSIDE]:
            yield window(text, a, a + INSIDE)


def _forward(p: dict, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    e = p["embed"][x]
    n = WIDTH - KERNEL + 1
    cols = np.lib.stride_tricks.sliding_window_view(e, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(x), n, KERNEL * EMBED)
    conv = np.maximum(cols @ p["conv"] + p["conv_b"], 0)
    inner = slice(BEFORE, BEFORE + INSIDE)
    outer = np.concatenate([conv[:, :BEFORE], conv[:, BEFORE + INSIDE :]], axis=1)
    ai, ao = conv[:, inner].argmax(axis=1), outer.argmax(axis=1)
    mi, mo = np.take_along_axis(conv[:, inner], ai[:, None], 1)[:, 0], np.take_along_axis(outer, ao[:, None], 1)[:, 0]
    pooled = np.concatenate([mi, conv[:, inner].mean(axis=1), mo], axis=1)
    hidden = np.maximum(pooled @ p["hid"] + p["hid_b"], 0)
    return hidden @ p["out"] + p["out_b"], (cols, conv, ai, ao, pooled, hidden, x)


def _backward(p: dict, cache: tuple, d: np.ndarray) -> dict:
    cols, conv, ai, ao, pooled, hidden, x = cache
    g = {"out": hidden.T @ d, "out_b": d.sum()}
    dh = np.outer(d, p["out"]) * (hidden > 0)
    g["hid"], g["hid_b"] = pooled.T @ dh, dh.sum(axis=0)
    dp = dh @ p["hid"].T
    dc = np.zeros_like(conv)
    rows, f = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
    dc[:, BEFORE : BEFORE + INSIDE] += dp[:, None, FILTERS : 2 * FILTERS] / INSIDE
    dc[rows, ai + BEFORE, f] += dp[:, :FILTERS]
    dc[rows, np.where(ao < BEFORE, ao, ao + INSIDE), f] += dp[:, 2 * FILTERS :]
    dc *= conv > 0
    g["conv"] = np.tensordot(cols, dc, ([0, 1], [0, 1]))
    g["conv_b"] = dc.sum(axis=(0, 1))
    de = (dc @ p["conv"].T).reshape(len(x), -1, KERNEL, EMBED)
    g["embed"] = np.zeros_like(p["embed"])
    for k in range(KERNEL):
        np.add.at(g["embed"], x[:, k : k + de.shape[1]], de[:, :, k])
    return g


def generators(rng: random.Random) -> tuple[dict, dict]:
    """(keys, runs that are none): what makes one of each kind."""
    pick = lambda s, k: "".join(rng.choice(s) for _ in range(k))
    lower, digits, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    alnum = lower + lower.upper() + digits
    word = lambda a=2, b=9: pick("etaoinshrdlucmfwgypbvk", rng.randint(a, b))
    some = lambda sep, a, b: sep.join(word(2, 9) for _ in range(rng.randint(a, b)))
    date = lambda sep: sep.join([str(rng.randint(1995, 2029)), f"{rng.randint(1, 12):02}", f"{rng.randint(1, 28):02}"])
    keys = {
        "letters and digits, 16 to 19": lambda: pick(alnum, rng.randint(16, 19)), "letters and digits, 20 to 31": lambda: pick(alnum, rng.randint(20, 31)),
        "letters and digits, 32 to 64": lambda: pick(alnum, rng.randint(32, 64)), "letters and digits, 65 to 120": lambda: pick(alnum, rng.randint(65, 120)),
        "small letters and digits": lambda: pick(lower + digits, rng.randint(20, 40)), "capitals and digits": lambda: pick(lower.upper() + digits, rng.randint(20, 40)),
        "prefix": lambda: rng.choice([lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: "xoxb-" + pick(digits, 11) + "-" + pick(alnum, 24), lambda: "AIza" + pick(alnum + "_-", 35)])(),
        "base64": lambda: pick(alnum + "+/", rng.randint(38, 60)) + "==", "hexadecimal": lambda: pick(hexa, rng.choice([24, 28])),
    }
    others = {
        "uuid": lambda: rng.choice([str, str.upper])("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))),
        "constant": lambda: some("_", 2, 4).upper() + "_" + pick(digits, rng.randint(1, 4)),
        "path": lambda: rng.choice(["", "/"]) + "/".join(rng.choice([word(2, 9), word(2, 6) + pick(digits, rng.randint(1, 4)), pick(digits, 4)]) for _ in range(rng.randint(3, 9))),
        "dated slug": lambda: rng.choice([lambda: date("/") + "/" + some("-", 2, 8), lambda: some("-", 2, 7) + "-" + date(""), lambda: some("-", 2, 6) + "-" + date("-")])(),
        "numbered name": lambda: rng.choice([lambda: some("_", 2, 5) + pick(digits, rng.randint(1, 3)), lambda: some("-", 2, 5) + "-v" + pick(digits, 2), lambda: some("", 2, 4) + pick(digits, rng.randint(1, 3))])(),
        "camel case": lambda: "".join(word(3, 8).title() for _ in range(rng.randint(2, 5))) + pick(digits, rng.randint(1, 3)),
        "time": lambda: date("-") + "T" + pick(digits, 6) + rng.choice(["Z", "UTC", ""]), "long word": lambda: word(14, 20) + pick(digits, 1),
        "order number": lambda: word(2, 4).upper() + "-" + date("") + "-" + pick(digits, rng.randint(4, 8)) + rng.choice(["", "-" + word(2, 4).upper()]),
        "ruler": lambda: rng.choice("=-_+") * rng.randint(12, 70) + word(2, 6) + pick(digits, 1),
        "numbers with a word": lambda: "-".join(pick(digits, 4) for _ in range(rng.randint(3, 6))) + "-" + word(2, 5) + pick(digits, 1),
    }
    return keys, others


def labelled(seed: int, n: int, only: str | None = None) -> list[tuple[str, int, int, int]]:
    """(text, start, end, is a secret): generated findings, half of them keys, half long runs that are none; or of one kind."""
    rng = random.Random(seed)
    word = lambda a=2, b=9: "".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(a, b)))
    keys, others = generators(rng)
    cues = ["key", "auth", "bearer ", "secret_id = ", "Authorization: ", "credential: ", "access = ", "pass: ", "private "]
    out = []
    while len(out) < n:
        good = rng.random() < 0.5 if only is None else only in keys
        run = (keys | others)[only]() if only else rng.choice(list((keys if good else others).values()))()
        if len(run) < 16 or not _DIGIT.search(run) or not _LETTER.search(run):
            continue
        left = " ".join(word() for _ in range(rng.randint(1, 6))) + " "
        if rng.random() < (0.5 if good else 0.08):
            left += rng.choice(cues) + rng.choice(["", '"', "'"])
        text = left + run + rng.choice([" ", ". ", '" ', ", "]) + " ".join(word() for _ in range(3))
        out.append((text, len(left), len(left) + len(run), int(good)))
    return out


def _views(data: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the findings, and where each finding's begin."""
    each = [list(windows(t, a, b)) for t, a, b, _ in data]
    return np.stack([w for ws in each for w in ws]), np.cumsum([0, *map(len, each[:-1])])


def _calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic fit of labels to scores, by Newton's steps towards targets short of 0 and 1."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x, c = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        c = c - np.clip(np.linalg.solve(h, x.T @ (p - target)), -1, 1)
    return float(c[0]), float(c[1])


def _threshold(prob: np.ndarray, y: np.ndarray, recall: float) -> float:
    """The largest threshold whose recall on these findings shows, at 95 per cent confidence, that of all to be at least ``recall``."""
    ranked = np.sort(prob[y > 0])
    lost = max(0, int(len(ranked) * (1 - recall) - 1.645 * math.sqrt(len(ranked) * recall * (1 - recall))))
    return float(ranked[lost])


@lru_cache(maxsize=1)
def trained() -> dict:
    """Parameters, calibration and threshold, and (probabilities, labels) of the findings that neither saw; Adam on the logistic loss."""
    rng = np.random.default_rng(11)
    data = labelled(3, N_TRAIN + N_FIT + N_TEST)
    x, _ = _views(data[:N_TRAIN])  # a long run's parts are findings of their own to learn from
    y = np.concatenate([[d[3]] * len(list(windows(*d[:3]))) for d in data[:N_TRAIN]]).astype(float)
    cut = len(x)
    p = {
        "embed": rng.normal(0, 0.3, (97, EMBED)), "conv": rng.normal(0, 1 / math.sqrt(KERNEL * EMBED), (KERNEL * EMBED, FILTERS)), "conv_b": np.zeros(FILTERS),
        "hid": rng.normal(0, 1 / math.sqrt(3 * FILTERS), (3 * FILTERS, HIDDEN)), "hid_b": np.zeros(HIDDEN), "out": rng.normal(0, 0.3, HIDDEN), "out_b": np.zeros(()),
    }
    m, v, step = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(cut)
        for k in range(0, cut, 64):
            who = order[k : k + 64]
            z, cache = _forward(p, x[who])
            g = _backward(p, cache, (1 / (1 + np.exp(-z)) - y[who]) / len(who))
            step += 1
            for n in p:
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                v[n] = 0.999 * v[n] + 0.001 * g[n] ** 2
                p[n] = p[n] - 0.003 * ((m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8) + DECAY * p[n])
    net = {k: np.asarray(w, np.float32) for k, w in p.items()} | {"calibration": (1.0, 0.0)}
    # Of a long run the highest score of its parts decides, so that is what is calibrated.
    (fit, fit_y), (test, test_y) = (([*_views(part)], np.array([d[3] for d in part], float)) for part in (data[N_TRAIN : N_TRAIN + N_FIT], data[N_TRAIN + N_FIT :]))
    net["calibration"] = _calibration(np.maximum.reduceat(_scores(net, fit[0]), fit[1]), fit_y)
    highest = lambda views: np.maximum.reduceat(score(net, views[0]), views[1])
    net["threshold"] = _threshold(highest(fit), fit_y, MIN_RECALL)
    return net | {"held": (highest(test), test_y)}


def rates(net: dict, seed: int = 77, n: int = 500) -> dict[str, float]:
    """The share of findings of each kind that are called secret, of fresh ones."""
    out = {}
    for kind in [k for part in generators(random.Random(0)) for k in part]:
        views, first = _views(labelled(seed, n, kind))
        out[kind] = float((np.maximum.reduceat(score(net, views), first) >= net["threshold"]).mean())
    return out


def _scores(net: dict, windows: np.ndarray) -> np.ndarray:
    """Of 256 candidates at a time."""
    return np.concatenate([_forward(net, windows[k : k + 256])[0] for k in range(0, len(windows), 256)]) if len(windows) else np.zeros(0)


def score(net: dict, windows: np.ndarray) -> np.ndarray:
    """Calibrated probabilities."""
    slope, offset = net["calibration"]
    return 1 / (1 + np.exp(-np.clip(slope * _scores(net, windows) + offset, -30, 30)))


_ASSIGNED = re.compile(r"""[:=]\x20*["']?$""")


def _kind(text: str, start: int, end: int) -> str:
    """A value is ``assign``, other hexadecimal digits are ``hex``, all else is ``access``."""
    if _ASSIGNED.search(text[max(0, start - 8) : start]):
        return "assign"
    return "hex" if re.fullmatch("[0-9a-fA-F]+", text[start:end]) else "access"


def find_batch(texts: list[str | None], net: dict) -> list[tuple[list, list, float]]:
    """Per text: base spans, all spans, and the highest probability of a candidate (0 without one)."""
    base = [base_spans(t or "") for t in texts]
    asked: list[tuple[int, int, int]] = []
    for i, t in enumerate(texts):
        own = set(candidates(t or "")) | {(a, b) for a, b, _ in base[i]}
        asked += [(i, a, b) for a, b in sorted(own)]
    out = [(b, list(b), 0.0) for b in base]
    prob = np.zeros(len(asked))
    views = ((k, x) for k, (i, a, b) in enumerate(asked) for x in windows(texts[i], a, b))
    while part := list(islice(views, 4096)):
        np.maximum.at(prob, [k for k, _ in part], score(net, np.stack([x for _, x in part])))
    # Base spans in order of their ends, each with the least start of those that end no earlier.
    ends = [sorted((b, a) for a, b, _ in own) for own in base]
    least = [list(accumulate((a for _, a in reversed(e)), min))[::-1] for e in ends]
    for (i, a, b), p in zip(asked, prob.tolist(), strict=True):
        have, spans, most = out[i]
        k = bisect.bisect_right(ends[i], (a, math.inf))  # spans that end after the candidate's start
        if p >= net["threshold"] and (k == len(least[i]) or least[i][k] >= b):
            spans.append((a, b, _kind(texts[i], a, b)))
        out[i] = (have, spans, max(most, p))
    return [(have, sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))), most) for have, spans, most in out]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _batches(batches: Iterator[pa.RecordBatch], net: dict) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = find_batch(b.column(b.num_columns - 1).to_pylist(), net)
        arrays = [pa.array([sum(s[2] == k for s in base) for base, _, _ in found], pa.int64()) for k in KINDS]
        arrays += [pa.array([joined(base) for base, _, _ in found], pa.string()), pa.array([joined(s) for _, s, _ in found], pa.string())]
        arrays += [pa.array([len(s) - len(base) for base, s, _ in found], pa.int64()), pa.array([round(m, 4) for *_, m in found], pa.float64())]
        names = [*b.schema.names[:-1], *[f"n_{k}" for k in KINDS], "base_spans", "spans", "n_added", "top_score"]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], names=names)


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Per row of docs: ``keep`` (default doc_id), n_assign, n_access, n_hex (base), base_spans, spans, n_added, top_score.

    Offsets are code points, ends exclusive. Null and empty texts have no spans. Repeated rows get a row each, an empty
    table gives none; other columns are ignored, whatever their names. Texts are taken whole. Columns to keep must not
    be named like the new ones.
    """
    keep = ["doc_id"] if keep is None else keep
    ship(docs.sparkSession)
    net = {k: v for k, v in trained().items() if k != "held"}
    # Arrow batches go by names without dots.
    src = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    new = StructType.fromDDL(", ".join(f"n_{k} bigint" for k in KINDS) + ", base_spans string, spans string, n_added bigint, top_score double")
    found = src.mapInArrow(lambda it: _batches(it, net), StructType(src.schema.fields[:-1] + new.fields))
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *new.names)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans")
