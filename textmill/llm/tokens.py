"""Byte-level BPE ids of whole texts, by words: each different word of a block is encoded once.

The words are those of the vocabulary's own pattern. For texts of ASCII and Latin-1 letters, without an apostrophe before
a letter, they are found in numpy; for any other text the library does all of the work. Ids are the same either way."""

from __future__ import annotations

import base64
import functools
import itertools

import numpy as np

from .arrays import hash_spans, prefix_hash

#: A worker's table of known words has 2**SLOT_BITS slots of 16 bytes; a word whose slot is taken is encoded in each block.
SLOT_BITS = 20
#: No more words are kept once the known ones have so many ids.
POOL_IDS = 4_000_000

#: The pattern under which a text is a single word.
WHOLE = r"(?s).+"

_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
for _first, _end in (("A", "Z"), ("a", "z")):
    _CLASS[ord(_first) : ord(_end) + 1] = _LETTER
_CLASS[0x80:] = _LETTER  # only those of simple texts, which are letters from C3 80 to C3 BF


@functools.cache
def encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def simple_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, whether the numpy path knows all of its characters."""
    high = data >= 0x80
    lead = data == 0xC3
    good = np.zeros(len(data), dtype=bool)
    good[1:] = lead[:-1] & high[1:] & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    tail = np.zeros(len(data), dtype=bool)
    tail[:-1] = good[1:]
    bad = (high & ~good & ~(lead & tail)) | ((data >= 0x1C) & (data <= 0x1F))
    quote = data == 0x27
    bad[:-1] |= quote[:-1] & (_CLASS[data[1:]] == _LETTER)
    return np.diff(np.concatenate([[0], np.cumsum(bad)])[offsets]) == 0


def split_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words of simple texts start; every byte belongs to a word."""
    kind = _CLASS[data]
    n = len(data)
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[offsets] = True
    turn = np.ones(n, dtype=bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn |= fresh[:-1]
    # the last space character of a run, before something else in the same text, leaves the run
    blank = kind == _SPACE
    before = np.zeros(n, dtype=bool)
    before[:-1] = blank[:-1] & ~blank[1:] & ~fresh[1:-1]
    start = turn | before
    # and if it is U+0020 it opens the next word, which then doesn't start by itself
    joins = before & (data == 0x20)
    start[1:] &= ~joins[:-1]
    return np.flatnonzero(start)


class WordEncoder:
    """Encodes blocks of texts. Words seen before are found in a table with one slot a word, 2**SLOT_BITS in all."""

    def __init__(self, ranks_path: str, pattern: str):
        self.library, self.pieces = encoding(ranks_path, pattern), encoding(ranks_path, WHOLE)
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)
        self.begin = np.zeros(1 << SLOT_BITS, np.int32)
        self.count = np.zeros(1 << SLOT_BITS, np.int32)  # no word has 0 ids: such a slot is free
        self.ids = np.zeros(0, np.uint32)

    def _words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word: where its ids begin in the returned pool, how many they are; and the pool."""
        keys = hash_spans(prefix_hash(data), starts, ends)
        slots = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        begin, count = self.begin[slots], self.count[slots]
        missed = np.flatnonzero((count == 0) | (self.keys[slots] != keys))
        new, first, which = np.unique(keys[missed], return_index=True, return_inverse=True)
        raw, encode = data.tobytes(), self.pieces.encode_ordinary
        lists = [encode(raw[a:b].decode()) for a, b in zip(starts[missed[first]].tolist(), ends[missed[first]].tolist(), strict=True)]
        sizes = np.fromiter(map(len, lists), np.int32, len(lists))
        pool = np.concatenate([self.ids, np.array(list(itertools.chain.from_iterable(lists)), np.uint32)])
        places = (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int32)
        begin[missed], count[missed] = places[which], sizes[which]
        slots = (new >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        free = self.count[slots] == 0
        if free.any() and len(self.ids) < POOL_IDS:
            last = int(np.flatnonzero(free)[-1])
            self.keys[slots[free]], self.begin[slots[free]], self.count[slots[free]] = new[free], places[free], sizes[free]
            self.ids = pool[: places[last] + sizes[last]]
            # two new words of one slot: the later one has it, and its three values agree
        return begin, count, pool

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text, as uint32."""
        simple = simple_texts(data, offsets)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * (len(offsets) - 1)
        for i in np.flatnonzero(~simple):
            out[i] = np.array(self.library.encode_ordinary(data[offsets[i] : offsets[i + 1]].tobytes().decode()), dtype=np.uint32)
        if len(data) and simple.any():
            starts = split_words(data, offsets)
            ends = np.append(starts[1:], len(data))
            doc = np.searchsorted(offsets, starts, "right") - 1
            use = simple[doc]
            starts, ends, doc = starts[use], ends[use], doc[use]
            begin, count, pool = self._words(data, starts, ends)
            total = np.concatenate([[0], np.cumsum(count)])
            flat = pool[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
            cuts = total[np.searchsorted(doc, np.arange(len(offsets)))]
            for i in np.flatnonzero(simple):
                out[i] = flat[cuts[i] : cuts[i + 1]]
        return out
