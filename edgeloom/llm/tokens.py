"""Token ids of whole texts by a public tokenizer, each distinct piece of text tokenised once.

A tokenizer of this family never joins what white space divides, and inside a
chunk without white space it takes runs of letters, single digits and runs of
other signs apart before it looks at its vocabulary. So the ids of a text are
those of its parts in order, and a part that was seen before need not be
tokenised again. Parts are found and named by 64-bit hashes in numpy. Chunks
where this cut could differ from the tokenizer's own (anything but ASCII and
Latin-1 letters, apostrophes, special tokens) are parts as a whole.
"""

from __future__ import annotations

import os

import numpy as np
from tokenizers import Tokenizer

from edgeloom.llm import text as tx

MAX_KNOWN = 3_000_000  # parts remembered by a worker; beyond it the memory starts anew
RUN = 256  # words tokenised in one string

SPACE, LETTER, SIGN, DIGIT, OTHER = range(5)
_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[33:127] = SIGN
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[[32, 9, 10, 11, 12, 13]] = SPACE
_WHOLE = np.zeros(256, dtype=bool)  # signs that make a chunk one part
_WHOLE[[ord("'"), ord("<")]] = True
LATIN = 0xC3  # first byte of U+00C0 to U+00FF


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``bytes, start, end, whole, first``: the parts of the texts that lie one behind the other in ``data``.

    ``bytes`` is ``data``, in lower case but for whole chunks; ``whole`` marks
    these; ``first`` has the index of each text's first part (n + 1 values).
    """
    n = len(data)
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == LATIN) if n else np.zeros(0, np.int64)
    tail = data[lead + 1]
    good = lead[(tail >= 0x80) & (tail < 0xC0) & (tail != 0x97) & (tail != 0xB7)]
    kind[good] = kind[good + 1] = LETTER
    begin = np.zeros(n + 1, dtype=bool)  # a text begins here
    begin[offsets] = True
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (kind[1:] == SPACE) != (kind[:-1] == SPACE)
    chunk_starts = (fresh | begin[:n]) & (kind != SPACE)
    chunk = np.cumsum(chunk_starts, dtype=np.int64)
    odd = np.zeros(int(chunk[-1]) + 1 if n else 1, dtype=bool)
    odd[chunk[(kind == OTHER) | _WHOLE[data]]] = True
    odd[0] = False
    inside = odd[chunk] & (kind != SPACE)
    low = data.copy()
    plain = ~inside
    low[plain & (data >= 65) & (data <= 90)] += 32
    capital = good[(data[good + 1] <= 0x9E) & plain[good]]
    low[capital + 1] += 32
    edge = np.ones(n, dtype=bool)
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    start = np.flatnonzero(((edge & plain) | chunk_starts | begin[:n]) & (kind != SPACE))
    stop = np.append(start[1:], n)
    space = np.append(np.flatnonzero((kind == SPACE) & (fresh | begin[:n])), n)  # where white space begins
    following = space[np.searchsorted(space, start)] if len(start) else start
    return low, start, np.minimum(stop, following), inside[start], np.searchsorted(start, offsets)


class Encoder:
    """Ids of texts by ``tokenizer``, with the parts seen so far."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``texts``, each of which is one word to the tokenizer, and the number of each."""
        runs = self.tokenizer.encode_batch(
            [" ".join(texts[k:k + RUN]) for k in range(0, len(texts), RUN)], add_special_tokens=False)
        ids = np.concatenate([np.array(r.ids, np.uint32) for r in runs])
        word = np.concatenate([np.array(r.word_ids, np.int64) + k * RUN for k, r in enumerate(runs)])
        return ids, np.bincount(word, minlength=len(texts))

    def _chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.concatenate([np.array(r.ids, np.uint32) for r in runs]), np.array([len(r.ids) for r in runs])

    def _learn(self, raw: bytes, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, whole: np.ndarray) -> None:
        for pick, encode in ((np.flatnonzero(~whole), self._words), (np.flatnonzero(whole), self._chunks)):
            if len(pick):
                ids, size = encode([raw[start[k]:end[k]].decode() for k in pick])
                at = len(self.ids) + np.cumsum(size) - size
                self.ids = np.concatenate([self.ids, ids])
                where = np.searchsorted(self.known, hashes[pick])
                self.known = np.insert(self.known, where, hashes[pick])
                self.at, self.size = np.insert(self.at, where, at), np.insert(self.size, where, size)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin (n + 1 values)."""
        if len(self.known) > MAX_KNOWN:
            self._forget()
        low, start, end, whole, first = parts(data, offsets)
        hashes = tx.Prefix(low).of(start, end)
        distinct, example, place = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        have = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.known)
        have[inside] = self.known[at[inside]] == distinct[inside]
        if not have.all():
            new = example[~have]
            self._learn(low.tobytes(), distinct[~have], start[new], end[new], whole[new])
            at = np.searchsorted(self.known, distinct)
        if not len(distinct):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        size = self.size[at][place]
        ends = np.cumsum(size)
        source = np.repeat(self.at[at][place] - (ends - size), size) + np.arange(ends[-1])
        return self.ids[source], np.concatenate([[0], ends])[first]


_ENCODERS: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """The worker's encoder for a tokenizer's JSON definition; it stays from task to task."""
    key = hash(definition)
    if key not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _ENCODERS[key] = Encoder(Tokenizer.from_str(definition))
    return _ENCODERS[key]
