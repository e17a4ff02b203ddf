"""Removal of repeated passages by suffix automata of reference shards.

Documents are streamed through an automaton of a shard's words for matching statistics (the longest suffix of the words
read so far that occurs in the shard), and spans of matches at or above the threshold go.

``strip_reference`` is for a reference of bounded size: all its shards are broadcast, and every document passes each.

``strip_repeats`` takes every document as reference for those after it. Its shards have no size bound together, so they
are not broadcast but dealt, and only stretches that may repeat are dealt to them: of each window's five-word runs the one
with the smallest hash is its anchor, equal windows have equal anchors, and neighbouring windows of one anchor are a
stretch, cut at ``STRETCH`` windows, so that every window is in one piece. A shard holds the stretches of an anchor that
occurs in two documents, words by 48 bits of hash each (624 a window). In a shard, documents come in order of their ids:
each is matched against those before it and then added, but for stretches that are there already. An anchor of very many
words has several shards, so what a shard holds is bounded in words, however long the texts; windows that are new to
their shard are then compared among those shards by 96 bits of hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import words as split_words
from corvane.session import ship

WINDOW = 13
ANCHOR = 5
#: Words of reference text in one automaton, shards that are broadcast at most, and bytes of a word on average: beyond, strip_reference refuses.
SHARD_WORDS = 200_000
MAX_SHARDS = 8
WORD_BYTES = 32
_P, _Q, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
LAST = (1 << 63) - 1
#: Bits of an anchor: enough to tell apart the anchors of 100 TB but for some hundredths, which the windows' own hashes then part.
_ANCHOR_BITS = 48
#: Units of an anchor that meet in one shard; beyond it they are dealt into powers of two of shards, 2**16 at most. A document is a
#: unit for every UNIT words, or part of them, of its stretches of the anchor.
SHARE_DOCS = 512
UNIT = 1024
#: Windows of a stretch at most. The stretches that begin in one block of BLOCK words of a text go to one of the anchor's shards.
STRETCH = 4096
_BLOCK_BITS = 14
#: Bytes of a word's hash.
_WORD_BYTES = 6
#: Bit of a place: its window occurs in the text again.
_AGAIN = 1 << 30


# --- suffix automata ----------------------------------------------------------------------------------------------


class SuffixAutomaton:
    """Of word sequences; sequences are parted so that no match crosses two of them."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.last, self.parts = 0, 0

    def add(self, words: list) -> None:
        self.parts += 1
        for w in [*words, -self.parts]:  # a negative number never equals a word or a hash
            self._extend(w)

    def _extend(self, w) -> None:
        cur = len(self.next)
        self.next.append({})
        self.length.append(self.length[self.last] + 1)
        self.link.append(0)
        p = self.last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            if self.length[p] + 1 == self.length[q]:
                self.link[cur] = q
            else:
                clone = len(self.next)
                self.next.append(dict(self.next[q]))
                self.length.append(self.length[p] + 1)
                self.link.append(self.link[q])
                while p >= 0 and self.next[p].get(w) == q:
                    self.next[p][w] = clone
                    p = self.link[p]
                self.link[q] = self.link[cur] = clone
        self.last = cur

    def statistics(self, words: list) -> list[int]:
        """For each word, the length of the longest match that ends with it."""
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            out.append(n)
        return out


def covered(statistics: list[int], threshold: int) -> np.ndarray:
    """Words inside a match of at least ``threshold`` words."""
    mark = np.zeros(len(statistics) + 1, np.int64)
    for i, n in enumerate(statistics):
        if n >= threshold:
            mark[i - n + 1] += 1
            mark[i + 1] -= 1
    return np.cumsum(mark[:-1]) > 0


def build_shards(reference: list[str | None], shard_words: int = SHARD_WORDS) -> list[SuffixAutomaton]:
    shards, room = [], 0
    for text in reference:
        words = [w.decode("utf-8", "surrogatepass") for w in _ascii_words(text)]
        if not words:
            continue
        if room < len(words):
            shards.append(SuffixAutomaton())
            room = max(shard_words, len(words))
        shards[-1].add(words)
        room -= len(words)
    return shards


def _ascii_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _strip_batches(batches: Iterator[pa.RecordBatch], shards, threshold: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = [w.decode("utf-8", "surrogatepass") for w in _ascii_words(text)]
            gone = np.zeros(len(words), bool)
            for shard in shards.value:
                gone |= covered(shard.statistics(words), threshold)
            rows.append((doc, len(words), int(gone.sum()), " ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)))
        names = ["doc_id", "n_words", "n_removed", "kept"]
        kinds = (b.schema.field(0).type, pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def strip_reference(docs: DataFrame, reference: DataFrame, threshold: int = WINDOW, shard_words: int = SHARD_WORDS, max_shards: int = MAX_SHARDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept (words joined by a space).

    The reference's words and bytes are counted first and refused (ValueError) beyond ``shard_words * max_shards`` words
    or ``WORD_BYTES`` times as many bytes. Null and blank texts have no words. An empty reference removes nothing; an
    empty table gives no rows; repeated rows are a row each; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    most = shard_words * max_shards
    total, size = reference.select(F.coalesce(F.sum(F.size(split_words(F.col("text")))), F.lit(0)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    if total > most or size > most * WORD_BYTES:
        raise ValueError(f"a reference of {total} words and {size} bytes is beyond {most} words or {most * WORD_BYTES} bytes")
    shards = spark.sparkContext.broadcast(build_shards([r[0] for r in reference.select("text").collect()], shard_words))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _strip_batches(it, shards, threshold), f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


# --- anchors and windows ------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _rolled(h: np.ndarray, k: int, p: np.uint64) -> np.ndarray:
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        out = out * p + h[j : j + len(out)]
    return _mix(out)


def _slices(batch: pa.RecordBatch, column: int, most: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about so many bytes of text."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, side="right")))
        yield batch.slice(a, b - a)
        a = b


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's begin (one more offset at the end).

    ascii_split_whitespace leaves an empty word before leading and after trailing white space; those go.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    at = np.asarray(split.offsets, dtype=np.int64)
    words = split.values.slice(at[0], at[-1] - at[0])
    at = at - at[0]
    coded = words.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    values = coded.dictionary.to_pylist()
    h = np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for w in values), np.uint64, len(values))
    idx = np.asarray(coded.indices)
    full = np.asarray(pc.not_equal(words, "")) if len(words) else np.zeros(0, bool)
    ends = np.concatenate(([0], np.cumsum(full)))
    return h[idx][full] if len(values) else np.zeros(0, np.uint64), ends[at]


def _windows(h: np.ndarray, at: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows inside a text: first word's place in h, text, anchor."""
    n = max(0, len(h) - size + 1)
    runs = _rolled(h, k, _P)
    least = runs[:n].copy()
    for j in range(1, size - k + 1):
        np.minimum(least, runs[j : j + n], out=least)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first = np.flatnonzero(text[:n] == text[size - 1 : size - 1 + n]) if n else np.zeros(0, np.int64)
    return first, text[first], least[first] >> np.uint64(64 - _ANCHOR_BITS)


def _changes(text: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Places of the entries that differ from the one before."""
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
    return np.flatnonzero(new)


def _anchor_batches(batches: Iterator[pa.RecordBatch], size: int, k: int, unit: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, doc), one for every ``unit`` words, or part of them, of the stretches that a text has of an anchor."""
    for whole in batches:
        for b in _slices(whole, 1):
            h, at = _hashed(b.column(1))
            _, text, anchor = _windows(h, at, size, k)
            begin = _changes(text, anchor)  # neighbouring windows mostly share theirs; the sort then has far less
            words, text, anchor = np.diff(begin, append=len(text)) + size - 1, text[begin], anchor[begin]
            order = np.lexsort((anchor, text))
            words, text, anchor = words[order], text[order], anchor[order]
            begin = _changes(text, anchor)
            units = -(-np.add.reduceat(words, begin) // unit) if len(begin) else begin
            text, anchor = np.repeat(text[begin], units), np.repeat(anchor[begin], units)
            doc = np.asarray(b.column(0))[text]
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(doc, pa.int64())], names=["anchor", "doc"])


def _stretch_batches(batches: Iterator[pa.RecordBatch], size: int, k: int, stretch: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc, text, anchors, repeated): the stretches of windows whose anchor is among the row's.

    Above an anchor's bits is the binary logarithm of its shards. A key is an anchor and above it the number of the shard;
    the place of a stretch of an anchor with several shards is negative. A text gives a stretch once, at its first place.
    ``repeated``: other rows have this doc.
    """
    for whole in batches:
        for b in _slices(whole, 1):
            h, at = _hashed(b.column(1))
            first, text, anchor = _windows(h, at, size, k)
            lists = b.column(2)
            given = np.asarray(lists.flatten(), dtype=np.int64)
            own, shards = (given & (1 << _ANCHOR_BITS) - 1).view(np.uint64), given >> _ANCHOR_BITS
            owner = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(lists), dtype=np.int64))
            # One key of text and anchor: the anchor mixed with the text's number; membership by sorted search.
            key = lambda t, a: _mix(a + (t.astype(np.uint64) + np.uint64(1)) * _Q)
            have = key(owner, own)
            order = np.argsort(have)
            have, shards = have[order], shards[order]
            asked = key(text, anchor)
            found = np.minimum(np.searchsorted(have, asked), max(0, len(have) - 1))
            ok = np.flatnonzero(have[found] == asked) if len(have) else np.zeros(0, np.int64)
            if not len(ok):
                continue
            first, text, anchor, bits = first[ok], text[ok], anchor[ok], shards[found[ok]]
            new = np.ones(len(ok), bool)
            new[1:] = (np.diff(first) != 1) | (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
            begin = np.flatnonzero(new)
            inside = np.arange(len(ok)) - np.repeat(begin, np.diff(begin, append=len(ok)))
            begin = np.flatnonzero(inside % stretch == 0)  # a long one in pieces: each of its windows is whole in one of them
            windows, inside = np.diff(begin, append=len(ok)), inside % stretch
            digest = np.add.reduceat(_mix(_rolled(h, size, _Q)[first] + inside.astype(np.uint64) * _R), begin)
            first, text, anchor, bits = first[begin], text[begin], anchor[begin], bits[begin]
            order = np.lexsort((digest, windows, anchor, text))
            same = lambda x: x[order][1:] == x[order][:-1]
            new = np.ones(len(order), bool)
            new[1:] = ~(same(digest) & same(windows) & same(anchor) & same(text))
            one = np.flatnonzero(new)
            again = np.diff(one, append=len(order)) > 1
            one = order[one]
            first, text, anchor, bits, words = first[one], text[one], anchor[one], bits[one], windows[one] + size - 1
            doc = np.asarray(b.column(0), dtype=np.int64)[text]
            block = _mix((first - at[text] >> _BLOCK_BITS).view(np.uint64))  # 0 for the first
            shard = _mix(doc.view(np.uint64) * _P + block) & ((1 << bits) - 1).view(np.uint64)
            tag = np.array([_tag(t, r) for t, r in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)], np.int64)
            place = tag[text] << 31 | first - at[text] | again * _AGAIN
            ends = np.cumsum(words)
            rows = np.arange(ends[-1]) + np.repeat(first - (ends - words), words)
            data = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[rows, :_WORD_BYTES])
            offsets = np.concatenate(([0], ends * _WORD_BYTES)).astype(np.int32)
            held = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            columns = [pa.array((anchor | shard << np.uint64(_ANCHOR_BITS)).view(np.int64)), pa.array(doc), pa.array(np.where(bits > 0, ~place, place)), held]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc", "place", "words"])


class _Shard:
    """The stretches of documents before the one at hand; an automaton is made only once a stretch is not there as a whole."""

    def __init__(self) -> None:
        self.seen: set[bytes] = set()
        self.waiting: list[bytes] = []
        self.automaton: SuffixAutomaton | None = None

    def add(self, stretches: list[bytes]) -> None:
        new = [s for s in dict.fromkeys(stretches) if s not in self.seen]
        self.seen.update(new)
        self.waiting += new

    def statistics(self, words: list[int]) -> list[int]:
        if self.automaton is None:
            self.automaton = SuffixAutomaton()
        for s in self.waiting:
            self.automaton.add(_word_hashes(s).tolist())
        self.waiting.clear()
        return self.automaton.statistics(words)


def _word_hashes(stretch: bytes) -> np.ndarray:
    out = np.zeros((len(stretch) // _WORD_BYTES, 8), np.uint8)
    out[:, :_WORD_BYTES] = np.frombuffer(stretch, np.uint8).reshape(-1, _WORD_BYTES)
    return out.view(np.uint64).ravel()


def _match_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and doc; one shard is held at a time. Spans (place, length) that repeat words of a smaller
    doc, with check -1 and a window of their own; and, of anchors with several shards, the windows that are new to theirs."""
    key = doc = None
    shard, held = _Shard(), []
    out: list[list] = [[] for _ in range(5)]

    def emit(*row) -> None:
        for column, value in zip(out, row, strict=True):
            column.append(value)

    for b in batches:
        for k, d, place, words in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if k != key:
                shard, held, key, doc = _Shard(), [], k, d
            elif d != doc:
                shard.add(held)
                held, doc = [], d
            held.append(words)
            several, place = place < 0, ~place if place < 0 else place
            n = len(words) // _WORD_BYTES
            if words in shard.seen:
                emit(d, place, n, _own(d, place), -1)
                continue
            if not several and not shard.seen:
                continue
            hashes = _word_hashes(words)
            found = np.array(shard.statistics(hashes.tolist()) if shard.seen else [0] * n)
            hit = np.flatnonzero(found >= size)
            if len(hit):
                edges = np.diff(np.concatenate(([0], covered(found.tolist(), size).astype(np.int8), [0])))
                for start, end in zip(np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist(), strict=True):
                    emit(d, place + start, end - start, _own(d, place + start), -1)
            if several:
                new = np.flatnonzero(found[size - 1 :] < size)
                window, check = _rolled(hashes, size, _Q)[new].view(np.int64), (_rolled(hashes, size, _R)[new] >> np.uint64(32)).view(np.int64)
                for start, w, c in zip(new.tolist(), window.tolist(), check.tolist(), strict=True):
                    emit(d, place + start, size, w, c)
            if len(out[0]) > 50_000:
                yield _matches(out)
    yield _matches(out)


def _own(doc: int, place: int) -> int:
    """A number that spreads spans evenly."""
    return ((doc * int(_P) ^ place * int(_R)) & LAST) >> 1


def _matches(out: list[list]) -> pa.RecordBatch:
    done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc", "place", "length", "window", "check"])
    for c in out:
        c.clear()
    return done


def _tag(text: str | None, repeated: bool) -> int:
    return zlib.crc32((text or "").encode("utf-8", "surrogatepass")) if repeated else 0


def _spans(words: list[bytes], places: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends), with the other places of windows that occur again."""
    again, starts = places & _AGAIN > 0, places & ~_AGAIN
    ends = starts + lengths
    if not again.any():
        return starts, ends
    codes: dict[bytes, int] = {}
    h = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.uint64, len(words))
    window = _rolled(_mix(h + np.uint64(1)), size, _Q)
    asked = np.concatenate([window[a : b - size + 1] for a, b in zip(starts[again].tolist(), ends[again].tolist(), strict=True)])
    more = np.flatnonzero(np.isin(window, asked))
    return np.concatenate([starts, more]), np.concatenate([ends, more + size])


def _kept_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc, text, is a copy, places, lengths, repeated): what stays. A place is a span's first word under the text's tag."""
    for b in batches:
        rows: list[tuple] = []
        for doc, text, copy, places, lengths, repeated in zip(*[c.to_pylist() for c in b.columns], strict=True):
            words = _ascii_words(text)
            n = len(words)
            if copy and n >= size:
                gone, words = n, []
            elif places:
                mark = np.zeros(n + 1, np.int64)
                p, m = np.array(places, np.int64), np.array(lengths, np.int64)
                mine = p >> 31 == _tag(text, repeated)
                starts, ends = _spans(words, p[mine] & 0x7FFFFFFF, m[mine], size)
                np.add.at(mark, starts, 1)
                np.add.at(mark, ends, -1)
                stay = np.cumsum(mark[:-1]) == 0
                words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                gone = n - len(words)
            else:
                gone = 0
            rows.append((doc, n, gone, b" ".join(words).decode("utf-8", "surrogatepass")))
        kinds = (b.schema.field(0).type, pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc", "n_words", "n_removed", "kept"])


def strip_repeats(
    docs: DataFrame, size: int = WINDOW, anchor: int = ANCHOR, share_docs: int = SHARE_DOCS, unit: int = UNIT, stretch: int = STRETCH
) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept: without the words of windows that also start in a document
    with a smaller doc_id.

    doc_id is a whole number. Null and blank texts have no words and are kept empty; texts under ``size`` words are kept
    whole. A null doc_id is larger than any other. Rows with one doc_id, or with none, are one document: they do not
    remove from each other. An empty table gives no rows; other columns are ignored, whatever their names. Exact copies are settled by a digest of the text and take no part in the comparison, and
    anchors meet only in counts and in a join with those, so groups of copies cost in proportion to their rows. That
    join is on a key derived from the counts' own: both its sides are then exchanges, of which adaptive execution splits
    one with a very common key (below an aggregate it could not).
    """
    ship(docs.sparkSession)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    texts = docs.select(doc.alias("doc"), "text")  # dealt by doc once, for both joins below
    md5 = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    known = texts.select("doc", md5.alias("md5"))
    first = known.groupBy("md5").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("md5", "first")
    of_md5 = F.concat("md5", F.lit(b"\0")).alias("key")
    copies = known.select("doc", "md5", of_md5).join(first.select(of_md5, "first"), "key").filter("first < doc").groupBy("doc").agg(F.collect_set("md5").alias("copies"))
    repeats = known.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc", F.lit(True).alias("repeated"))
    anchors = texts.mapInArrow(lambda it: _anchor_batches(it, size, anchor, unit), "anchor bigint, doc bigint")
    shared = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shares = F.when(F.col("n") > share_docs, F.least(F.ceil(F.log2(F.col("n") / share_docs)), F.lit(16))).otherwise(0).cast("long")
    of_anchor = (F.col("anchor") + 1).alias("key")
    held = anchors.select("doc", of_anchor).join(shared.select(of_anchor, shares.alias("shares")), "key")
    wanted = held.groupBy("doc").agg(F.collect_list(F.col("key") - 1 + F.shiftleft("shares", _ANCHOR_BITS)).alias("anchors"))
    copy, repeated = F.coalesce(F.array_contains("copies", md5), F.lit(False)), F.coalesce("repeated", F.lit(False))
    stretches = (
        texts.join(wanted, "doc")
        .join(copies, "doc", "left")
        .join(repeats, "doc", "left")
        .filter(~copy)
        .select("doc", "text", "anchors", repeated.alias("repeated"))
        .mapInArrow(lambda it: _stretch_batches(it, size, anchor, stretch), "key bigint, doc bigint, place bigint, words binary")
    )
    dealt = stretches.repartition("key").sortWithinPartitions("key", "doc")
    # One plan to the end, so that the texts' exchange by doc is made once; spans that are settled pass the comparison alone.
    matches = dealt.mapInArrow(lambda it: _match_batches(it, size), "doc bigint, place bigint, length bigint, window bigint, check bigint")
    met = matches.withColumn("low", F.min("doc").over(Window.partitionBy("window", "check")))
    hits = met.filter("check < 0 OR low < doc").select("doc", "place", "length")
    hit = hits.groupBy("doc").agg(F.collect_list("place").alias("places"), F.collect_list("length").alias("lengths"))
    out = texts.join(hit, "doc", "left").join(copies, "doc", "left").join(repeats, "doc", "left")
    kept = out.select("doc", "text", copy.alias("copy"), "places", "lengths", repeated.alias("repeated")).mapInArrow(
        lambda it: _kept_batches(it, size), "doc bigint, n_words bigint, n_removed bigint, kept string"
    )
    kind = docs.schema["doc_id"].dataType
    return kept.select(F.nullif("doc", F.lit(LAST)).cast(kind).alias("doc_id"), "n_words", "n_removed", "kept")


def digest(stripped: DataFrame) -> DataFrame:
    return stripped.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS g FROM s),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM m WHERE low < doc_id),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT u.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM u ANTI JOIN gone USING (doc_id, i) GROUP BY u.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
