"""Token ids of whole Arrow batches by the tokenizers library.

The library encodes each distinct word once a worker: texts are split at ASCII white space (which this vocabulary
drops), distinct pieces are looked up, and a text's ids are gathered from the pieces' ids. A piece of plain Latin
letters with ASCII punctuation behind it is two pre-tokens, encoded apart; all other pieces go to the library as they
are. New words are encoded many to a call; each ends at the id whose token closes a word.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
#: Words kept by a worker, unless more are asked for; beyond it the cache starts anew.
CACHE_WORDS = 400_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-į"
_MARKS = r"!-/:-@\[-`{-~"
_TAIL = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = f"^[{_LETTERS}]+[{_MARKS}]*$"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.cache_words = Tokenizer.from_file(path), cache_words
        size = self.tokenizer.get_vocab_size()
        self.closes = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _store(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.known)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        while n + len(words) > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.starts))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.lengths[n : n + len(words)] = lengths
        self.starts[n : n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self, plain: list[str], odd: list[str]) -> None:
        """plain: words that are one pre-token each, so that the ids that close a word part a joined text."""
        for k in range(0, len(plain), 512):
            part = plain[k : k + 512]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            self._store(part, ids, np.diff(ends, prepend=0))
        for k in range(0, len(odd), 512):
            part = odd[k : k + 512]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self._store(part, np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64))

    def _look_up(self, words: pa.Array, plain: bool) -> np.ndarray:
        """The number of each word, after learning those that are new."""
        coded = words.dictionary_encode()
        values = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = np.fromiter(map(self.known.get, values, repeat(-1)), np.int64, len(values))
        if len(missing := np.flatnonzero(own < 0)):
            n, new = len(self.known), [values[i] for i in missing.tolist()]
            self._learn(new, []) if plain else self._learn([], new)
            own[missing] = np.arange(n, n + len(new))  # words are numbered as they are learnt
        return own[np.asarray(coded.indices)] if len(values) else np.zeros(len(words), np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (uint32), and where each text's begin (one more offset at the end). Null texts are empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        at = np.asarray(split.offsets, dtype=np.int64)
        pieces = split.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at = at - at[0]
        if len(self.known) > self.cache_words:
            self.reset()  # a batch's own words are all held, however many
        distinct = pieces.dictionary
        plain = pc.match_substring_regex(distinct, _PLAIN)
        letters, others = distinct.filter(plain), distinct.filter(pc.invert(plain))
        base = self._look_up(pc.utf8_lower(pc.utf8_rtrim(letters, _TAIL)), True)
        tail = self._look_up(pc.replace_substring_regex(letters, f"^[{_LETTERS}]+", ""), False)
        whole = self._look_up(others, False)
        first, second = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        mask = np.asarray(plain)
        first[mask], second[mask], first[~mask] = base, tail, whole
        both = np.stack([first, second], axis=1).ravel()
        ids = _gather(self.ids, self.starts[both], self.lengths[both])
        lengths = self.lengths[first] + self.lengths[second]
        starts = np.cumsum(lengths) - lengths
        idx = np.asarray(pieces.indices)
        ends = np.concatenate(([0], np.cumsum(lengths[idx])))
        return _gather(ids, starts[idx], lengths[idx]), ends[at]


def _gather(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated slices source[s : s + n]."""
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    if not len(lengths):
        return np.zeros(0, source.dtype)
    steps = np.ones(int(lengths.sum()), np.int64)
    steps[0] = starts[0]
    first = np.cumsum(lengths)[:-1]
    steps[first] = starts[1:] - (starts[:-1] + lengths[:-1]) + 1
    return source[np.cumsum(steps)]


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, cache_words: int = CACHE_WORDS) -> WordEncoder:
    key = (path, cache_words)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, cache_words)
    return _ENCODERS[key]


def slices(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterable[pa.RecordBatch]:
    """The batch in runs of rows of about so many bytes, at least a row each."""
    if batch.num_rows == 0:
        return
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0), dtype=np.int64))
    a = 0
    while a < batch.num_rows:
        base = size[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(size, base + most_bytes, side="right")))
        yield batch.slice(a, b - a)
        a = b
