"""A context-mixing range coder for token ids, many independent blocks at a time.

A block of up to ``BLOCK`` ids starts from the model that its segment's header holds, so blocks decode alone; numpy codes
all blocks of a segment in step, one id of each at a time. The model mixes three orders. Order 2 and order 1 each predict
one id, the last that followed the same two (one) ids in the block; cells carry a tag of their context, so that no other
context's id is taken. What remains of the interval goes to counts: those of the id under the class of the id before
(``Prior``; ids with like followers share a class), which with one class are plain order 0. The shares of orders 1 and 2
adapt to how often each one's prediction came true in the block, renewed every ``_SPAN`` ids.

Intervals are whole numbers below 2**53 in float64, whose sums, products and rounded-down quotients of these sizes are
exact: a share is in units of 2**-24, the range stays between 2**28 and 2**52 and moves 24 bits at a time, at most once
an id. The encoder leaves carries in its output cells and resolves them at the end; the decoder needs none.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 2048
MAGIC = b"CVRC"
VERSION = 3
_SPAN = 32
#: Shares of a class's ids add up to so many slots.
_SLOTS = 1 << 16
#: A segment has a class for so many ids, 64 at most; classes are found on so many neighbours at most, by so many hashed features.
_CLASS_IDS, _MOST_CLASSES, _SAMPLE, _FEATURES, _ROUNDS = 1 << 14, 64, 1 << 18, 64, 4
#: Counts are kept as steps of a quarter of a binary digit.
_LEVELS = np.array([0] + [round(2 ** (k / 4)) for k in range(130)], np.int64)
#: Cells of a block's table: 64 lines of 16 cells for order 1 and 16 for order 2.
_TABLE = 64 * 32
_NONE = 0xFFFF
#: Most of 65536 that one order may take: two leave the counts at least 4096.
_MOST = 30720
_TOP, _WORD, _UNIT = float(1 << 28), float(1 << 24), float(1 << 24)


class Prior:
    """What a segment's blocks start from: its distinct ids, their classes, and each class's shares of the ids that follow.

    Inside, an id is its rank among the segment's distinct ids; the first id of a block follows the class of rank 0.
    """

    def __init__(self, ids: np.ndarray, classes: np.ndarray, levels: np.ndarray) -> None:
        self.ids, self.classes, self.levels = ids, classes, levels
        weight = _LEVELS[levels]
        seen = weight > 0
        room = _SLOTS - seen.sum(axis=1, keepdims=True)
        freq = np.where(seen, weight * room // np.maximum(weight.sum(axis=1, keepdims=True), 1) + 1, 0)
        rows = np.flatnonzero(seen.any(axis=1))
        if len(rows):  # rounding's rest goes to the commonest
            freq[rows, freq[rows].argmax(axis=1)] += _SLOTS - freq[rows].sum(axis=1)
        self.freq = freq
        start = np.cumsum(freq, axis=1) - freq
        #: By class and rank: start << 16 | frequency - 1.
        self.packed = np.where(freq > 0, start << 16 | (freq - 1) & 0xFFFF, 0).astype(np.uint32).ravel()

    @classmethod
    def fit(cls, ids: np.ndarray) -> tuple[Prior, np.ndarray]:
        """The prior of a segment, and its ids as ranks."""
        counts = np.bincount(ids, minlength=1)
        distinct = np.flatnonzero(counts)
        rank = np.zeros(len(counts), np.int64)
        rank[distinct] = np.arange(len(distinct))
        ranks = rank[ids]
        before = np.zeros_like(ranks)
        before[1:] = ranks[:-1]
        before[::BLOCK] = 0
        classes = _classes(before, ranks, len(distinct), min(_MOST_CLASSES, max(1, len(ids) // _CLASS_IDS)))
        n = int(classes.max(initial=0)) + 1
        pairs = np.bincount(classes[before] * len(distinct) + ranks, minlength=n * len(distinct)).reshape(n, len(distinct))
        levels = np.where(pairs > 0, np.rint(4 * np.log2(np.maximum(pairs, 1))) + 1, 0).astype(np.uint8)
        return cls(distinct, classes, levels), ranks

    def to_bytes(self) -> bytes:
        body = self.classes.astype("u1").tobytes() + np.diff(self.ids, prepend=0).astype("<u2").tobytes() + self.levels.tobytes()
        return np.array([len(self.ids), len(self.levels)], "<u4").tobytes() + zlib.compress(body)

    @classmethod
    def from_bytes(cls, blob: bytes) -> Prior:
        n, rows = np.frombuffer(blob, "<u4", 2).tolist()
        body = zlib.decompress(blob[8:])
        levels = np.frombuffer(body, "u1", n * rows, 3 * n).reshape(rows, n)
        return cls(np.cumsum(np.frombuffer(body, "<u2", n, n).astype(np.int64)), np.frombuffer(body, "u1", n).astype(np.int64), levels)


def _classes(before: np.ndarray, ranks: np.ndarray, n: int, k: int) -> np.ndarray:
    """A class for each rank, by some rounds of nearest centres over the square roots of what follows it, in hashed features."""
    if k < 2 or n < 2:
        return np.zeros(n, np.int64)
    step = -(-len(ranks) // _SAMPLE)
    feature = (ranks[::step] * 2654435761 >> 7) % _FEATURES
    counts = np.bincount(before[::step] * _FEATURES + feature, minlength=n * _FEATURES).reshape(n, _FEATURES).astype(float)
    every = (counts.sum(axis=0) + 1) / (counts.sum() + _FEATURES) / 2
    near = lambda c: np.sqrt((c + every) / (c.sum(axis=1, keepdims=True) + 0.5))
    points = near(counts)
    centres = points[np.argsort(-counts.sum(axis=1), kind="stable")[:k]]
    for _ in range(_ROUNDS):
        classes = (points @ centres.T).argmax(axis=1)
        centres = near(np.stack([np.bincount(classes, c, minlength=len(centres)) for c in counts.T], axis=1))
    return np.unique(classes, return_inverse=True)[1]


class _Weights:
    """Shares of orders 1 and 2, which both sides renew in step."""

    def __init__(self, lanes: int) -> None:
        self.hits, self.tries = np.full((2, lanes), 0.5), np.full((2, lanes), 4.0)
        self.weigh()

    def weigh(self) -> None:
        self.w1, self.w2 = np.floor(self.hits / self.tries * _MOST)

    def renew(self, ids: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> None:
        """After a span, with its ids and predictions, each (steps, lanes)."""
        for k, p in enumerate((p1, p2)):
            self.hits[k] = self.hits[k] * 0.75 + (p == ids).sum(axis=0, dtype=np.uint8) + 0.02
            self.tries[k] = self.tries[k] * 0.75 + (p != _NONE).sum(axis=0, dtype=np.uint8) + 0.2
        self.weigh()


def _layout(n: int) -> tuple[int, np.ndarray]:
    lanes = -(-n // BLOCK)
    return lanes, np.minimum(BLOCK, n - np.arange(lanes) * BLOCK)


def _contexts(a: np.ndarray, b: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the ids a, b before: cells of orders 1 and 2, near each other, and the tags of both contexts, moved up 16 bits."""
    line, rest = row + ((b & 63) << 5), b >> 6
    both = a * 40503 + rest * 34283 & 0xFFFF
    return line + (rest & 15), line + ((both >> 12) + 16), (rest << 16).astype(np.uint32), (both << 16).astype(np.uint32)


def _held(cell: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """The id of a cell that is of this context, else ``_NONE``."""
    x = cell ^ tag
    return np.where(x < 65536, x, _NONE).astype(np.uint16)


def _parts(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and frequency."""
    return (packed >> 16).astype(np.float64), (packed & 0xFFFF) + 1.0


def encode(ranks: np.ndarray, prior: Prior) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all blocks, number of 3-byte words of each block)."""
    lanes, lengths = _layout(len(ranks))
    padded = np.zeros(lanes * BLOCK, np.uint16)
    padded[: len(ranks)] = ranks
    steps = int(lengths.max(initial=0))
    grid = np.ascontiguousarray(padded.reshape(lanes, BLOCK).T[:steps])
    weights, row_of = _Weights(lanes), prior.classes * len(prior.ids)
    table = np.full(lanes * _TABLE, 0xFFFFFFFF, np.uint32)
    row = np.arange(lanes, dtype=np.int64) * _TABLE
    low, rng = np.zeros(lanes), np.full(lanes, float(1 << 52))
    cells = np.zeros((steps + 4, lanes), np.uint32)  # a row holds the same word of each block
    flat, at = cells.ravel(), np.arange(lanes, dtype=np.int64)
    took1, took2 = np.empty((2, _SPAN, lanes), np.uint32)
    unit, top, moved = np.empty((3, lanes))
    short = lengths.min(initial=BLOCK) < steps
    for t0 in range(0, steps, _SPAN):
        n = min(_SPAN, steps - t0)
        wide = np.zeros((n + 2, lanes), np.int64)
        first = max(t0 - 2, 0)
        wide[n + 2 - (t0 + n - first) :] = grid[first : t0 + n]
        x, span = wide[2:], grid[t0 : t0 + n]
        c1, c2, tag1, tag2 = _contexts(wide[:-2], wide[1:-1], row)
        new1, new2 = tag1 | span, tag2 | span
        for k in range(n):
            i1, i2 = c1[k], c2[k]
            table.take(i1, out=took1[k], mode="clip")
            table.take(i2, out=took2[k], mode="clip")
            table[i1] = new1[k]
            table[i2] = new2[k]
        p1, p2 = _held(took1[:n], tag1), _held(took2[:n], tag2)
        f2 = weights.w2 * (p2 != _NONE)
        f12 = f2 + weights.w1 * ((p1 != _NONE) & (p1 != p2))
        hit2 = p2 == span
        rest = 256 - f12 * 2.0**-8
        cum, width = _parts(prior.packed.take(row_of.take(wide[1:-1]) + x))
        begin, end = np.floor(cum * rest), np.floor((cum + width) * rest)
        missed = ~(hit2 | (p1 == span))
        start = np.where(missed, f12 * 256 + begin, np.where(hit2, 0, f2 * 256))
        freq = np.where(missed, end - begin, np.where(hit2, f2, f12 - f2) * 256)
        if short:
            live = np.arange(t0, t0 + n)[:, None] < lengths
            start, freq = np.where(live, start, 0), np.where(live, freq, _UNIT)
        for k in range(n):
            np.floor(np.multiply(rng, 1 / _UNIT, out=unit), out=unit)
            low += np.multiply(start[k], unit, out=top)
            np.multiply(freq[k], unit, out=rng)
            np.floor(np.multiply(low, 1 / _TOP, out=top), out=top)
            shift = rng < _TOP
            flat[at] = top
            scale = np.where(shift, _WORD, 1.0)
            low -= np.multiply(top, np.where(shift, _TOP, 0.0), out=moved)
            low *= scale
            rng *= scale
            at += np.where(shift, lanes, 0)
        weights.renew(span, p1, p2)
    for _ in range(3):
        top = np.floor(low / _TOP)
        flat[at] = top
        low = (low - top * _TOP) * _WORD
        at += lanes
    used = at // max(lanes, 1)
    rows = int(used.max(initial=0))
    carry = np.zeros(lanes, np.uint32)
    for c in range(rows - 1, -1, -1):
        cell = cells[c] + np.where(c < used, carry, 0).astype(np.uint32)
        carry = cell >> np.uint32(24)
        cells[c] = cell & np.uint32(0xFFFFFF)
    words = cells[:rows].T[np.arange(rows)[None, :] < used[:, None]].astype("<u4")
    return np.ascontiguousarray(words.view(np.uint8).reshape(-1, 4)[:, :3]).ravel(), used


def decode(coded: np.ndarray, used: np.ndarray, n: int, prior: Prior) -> np.ndarray:
    """The n ranks of a segment from its bytes."""
    lanes, lengths = _layout(n)
    steps, rows = int(lengths.max(initial=0)), int(used.max(initial=0))
    words = np.zeros((len(coded) // 3, 4), np.uint8)
    words[:, :3] = coded.reshape(-1, 3)
    read = np.zeros((lanes, rows + 4))
    read[np.arange(rows + 4)[None, :] < used[:, None]] = words.view("<u4").ravel()
    read = np.ascontiguousarray(read.T)
    # The window of 52 bits ends four bits into a word, so what it takes in next begins there.
    four = np.floor(read * 2.0**-20)
    code = read[0] * _TOP + read[1] * 16 + four[2]
    stream = ((read[:-1] - four[:-1] * (1 << 20)) * 16 + four[1:]).ravel()
    at = np.arange(lanes, dtype=np.int64) + 2 * lanes
    rng = np.full(lanes, float(1 << 52))
    weights, row_of = _Weights(lanes), prior.classes * len(prior.ids)
    by_slot = np.zeros(len(prior.freq) * _SLOTS, np.uint16)
    for k, freq in enumerate(prior.freq):
        by_slot[k * _SLOTS : k * _SLOTS + int(freq.sum())] = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)
    slots_of = prior.classes * _SLOTS
    table = np.full(lanes * _TABLE, 0xFFFFFFFF, np.uint32)
    row = np.arange(lanes, dtype=np.int64) * _TABLE
    grid, (p1s, p2s) = np.zeros((steps, lanes), np.uint16), np.empty((2, _SPAN, lanes), np.uint16)
    a, b = np.zeros((2, lanes), np.int64)
    short = lengths.min(initial=BLOCK) < steps
    for t in range(steps):
        k = t % _SPAN
        if k == 0:
            w1, w2 = weights.w1 * 256, weights.w2 * 256
        i1, i2, tag1, tag2 = _contexts(a, b, row)
        p1, p2 = _held(table.take(i1, mode="clip"), tag1), _held(table.take(i2, mode="clip"), tag2)
        p1s[k], p2s[k] = p1, p2
        f2 = np.where(p2 != _NONE, w2, 0)
        f12 = f2 + np.where((p1 != _NONE) & (p1 != p2), w1, 0)
        unit = np.floor(rng * (1 / _UNIT))
        v = np.minimum(np.floor(code / unit), _UNIT - 1)
        rest = 256 - f12 * 2.0**-16
        slot = np.maximum((v + (1 - 1 / 256) - f12) / rest, 0).astype(np.int64)  # 0 where another order is meant
        guess = by_slot.take(slots_of.take(b) + slot, mode="clip")
        cum, width = _parts(prior.packed.take(row_of.take(b) + guess))
        begin, end = np.floor(cum * rest), np.floor((cum + width) * rest)
        miss, hit2 = v >= f12, v < f2
        start = np.where(miss, f12 + begin, np.where(hit2, 0, f2))
        freq = np.where(miss, end - begin, np.where(hit2, f2, f12 - f2))
        x = np.where(miss, guess, np.where(hit2, p2, p1))
        if short:
            live = t < lengths
            start, freq, x = np.where(live, start, 0), np.where(live, freq, _UNIT), x * live
        code -= start * unit
        rng = freq * unit
        shift = rng < _TOP
        scale = np.where(shift, _WORD, 1.0)
        code *= scale
        code += np.where(shift, stream.take(at, mode="clip"), 0)
        rng *= scale
        at += np.where(shift, lanes, 0)
        grid[t] = x
        table[i1] = tag1 | x
        table[i2] = tag2 | x
        a, b = b, x.astype(np.int64)
        if k == _SPAN - 1:
            weights.renew(grid[t + 1 - _SPAN : t + 1], p1s, p2s)
    out = np.ascontiguousarray(grid.T)
    return out[np.arange(steps)[None, :] < lengths[:, None]]


def pack_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of the file: header, documents, block directory (3-byte words, crc32 of ids), prior, words; little-endian."""
    if len(ids) and int(ids.max()) >= _NONE:
        raise ValueError(f"ids of {_NONE} and more are not of this format")
    prior, ranks = Prior.fit(ids)
    words, used = encode(ranks, prior)
    crcs = [zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) for k in range(len(used))]
    start = prior.to_bytes()
    body = b"".join([
        np.array([d is not None for d in doc_ids], "u1").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), lengths.astype("<u4").tobytes(),
        used.astype("<u4").tobytes(), np.array(crcs, "<u4").tobytes(), np.array([len(start)], "<u4").tobytes(), start, words.tobytes(),
    ])
    return MAGIC + np.array([VERSION, len(doc_ids), len(ids), zlib.crc32(body)], "<u4").tobytes() + body


def unpack_segment(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, ids of each, all ids); raises ValueError where a checksum differs."""
    version, docs, n, crc = np.frombuffer(blob, "<u4", 4, 4).tolist()
    if blob[:4] != MAGIC or version != VERSION or zlib.crc32(memoryview(blob)[20:]) != crc:
        raise ValueError("not a whole segment")
    at, blocks = 20, -(-n // BLOCK)

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, k, at)
        at += out.nbytes
        return out

    known, doc_ids, lengths, used, crcs = take("u1", docs), take("<i8", docs), take("<u4", docs), take("<u4", blocks), take("<u4", blocks)
    prior = Prior.from_bytes(take("u1", int(take("<u4", 1)[0])).tobytes())
    ranks = decode(take("u1", 3 * int(used.sum())), used.astype(np.int64), n, prior)
    ids = prior.ids[ranks].astype(np.uint32)
    for k in range(blocks):
        if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) != crcs[k]:
            raise ValueError(f"block {k} differs from its checksum")
    return [d if x else None for d, x in zip(doc_ids.tolist(), known, strict=True)], lengths.astype(np.int64), ids
