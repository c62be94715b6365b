"""Token ids of many texts through a byte-level BPE, each distinct unit encoded once.

A *unit* starts at the beginning of a text or at a safe cut: an ASCII white
space byte that follows a character which is not white space.  The
pre-tokenizer's pattern has no match that runs from such a character into
white space, and none of its look-aheads crosses the cut, so the ids of a text
are the ids of its units one after another.  Units repeat far more often than
texts do, hence a worker keeps the ids of the units it has met (bounded, see
``MAX_UNITS``); bytes are compared, so equal hashes of different units do no harm.
"""

from __future__ import annotations

import os

import numpy as np

from txrisk.llm.words import SPACE, hash_ranges

MAX_UNITS = 1_500_000        # the memo of a worker is emptied beyond either bound
MAX_UNIT_BYTES = 48 << 20
BLOB_BYTES = 64 << 10        # bytes of units given to the encoder as one text
BLOBS = 4                    # texts given to it at a time


def ends_safely(buf: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the character before each position is surely no white space."""
    b1 = buf[np.maximum(end - 1, 0)]
    safe = (b1 > 0x20) & (b1 != 0x7F)
    many = np.flatnonzero(b1 >= 0x80)  # only characters of several bytes need a closer look
    if len(many):
        b1, b2, b3 = (buf[np.maximum(end[many] - k, 0)] for k in (1, 2, 3))
        wide = ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
                | (b3 == 0xE1) & ((b2 == 0x9A) & (b1 == 0x80) | (b2 == 0xA0) & (b1 == 0x8E))
                | (b3 == 0xE2) & (b2 == 0x80) & ((b1 <= 0x8F) | (b1 >= 0xA8) & (b1 <= 0xAF))
                | (b3 == 0xE2) & (b2 == 0x81) & (b1 == 0x9F)
                | (b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80))
        safe[many] = ~wide
    return safe


def find_units(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all units, and the range of units of each text."""
    if len(buf) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = SPACE[buf]
    cand = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    begins = np.zeros(len(buf), bool)
    begins[cand[ends_safely(buf, cand)]] = True
    begins[off[:-1][np.diff(off) > 0]] = True
    start = np.flatnonzero(begins)
    return start, np.append(start[1:], len(buf)), np.searchsorted(start, off)


def _take(src: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """src[start:start+size] of each range, one after another."""
    first = np.cumsum(size) - size
    return src[np.arange(int(size.sum()), dtype=np.int64) + np.repeat(start - first, size)]


class SlotTable:
    """Numbers distinct 64-bit hashes 0, 1, ... in the order they are added.

    A place of ``table`` holds a number or -1; a hash goes to the first free
    place from its top bits on, so finding it takes a step or two however many
    there are.  At most half of the places are taken.
    """

    def __init__(self, bits: int = 16):
        self.bits, self.keys = bits, np.zeros(0, np.uint64)
        self.table = np.full(1 << bits, -1, np.int32)

    def __len__(self) -> int:
        return len(self.keys)

    def _places(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it was not added."""
        if len(self.keys) == 0:
            return np.full(len(h), -1, np.int64)
        at = self._places(h)
        found = self.table[at].astype(np.int64)
        other = np.flatnonzero((found >= 0) & (self.keys[found] != h))
        at, h = at[other], h[other]
        while len(other):  # places that another hash took: look at the next one
            at = (at + 1) & (len(self.table) - 1)
            slot = self.table[at]
            found[other] = slot
            go = (slot >= 0) & (self.keys[slot] != h)
            other, at, h = other[go], at[go], h[go]
        return found

    def add(self, h: np.ndarray) -> None:
        """Number hashes that differ from each other and from all added before."""
        first = len(self.keys)
        self.keys = np.concatenate([self.keys, h])
        if 2 * len(self.keys) > len(self.table):
            while 2 * len(self.keys) > 1 << self.bits:
                self.bits += 1
            self.table = np.full(1 << self.bits, -1, np.int32)
            first = 0
        slot = np.arange(first, len(self.keys), dtype=np.int32)
        at = self._places(self.keys[first:])
        while len(slot):
            free = self.table[at] < 0
            self.table[at[free]] = slot[free]  # of several for one place, one gets it
            left = self.table[at] != slot
            slot, at = slot[left], (at[left] + 1) & (len(self.table) - 1)


class UnitEncoder:
    """Encodes texts given as bytes and offsets with a tokenizers library file."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(tokenizer_path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.token_bytes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for s, i in vocab.items():  # byte-level: a character of a token stands for a byte
            self.token_bytes[i] = len(s)
        self._clear()

    def _clear(self) -> None:
        self.slots = SlotTable()
        self.ids, self.iptr = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.raw, self.rptr = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _ids_of(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units and their counts.  Units that start with white space and
        end safely are joined to blobs; the cuts between them are safe cuts."""
        size = end - start
        joins = SPACE[buf[start]] & ends_safely(buf, end)
        counts = np.zeros(len(start), np.int64)
        parts: list[np.ndarray] = []
        order: list[np.ndarray] = []
        which = np.flatnonzero(joins)
        if len(which):
            text = _take(buf, start[which], size[which])
            stop = np.cumsum(size[which])
            blob = (stop - size[which]) // BLOB_BYTES
            last = np.append(np.flatnonzero(np.diff(blob)), len(which) - 1)
            cuts = np.concatenate([[0], stop[last]])
            texts = [text[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]
            # a few blobs at a time: an encoding holds some hundred bytes for each token
            ids = np.concatenate([np.array(e.ids, np.uint32) for i in range(0, len(texts), BLOBS)
                                  for e in self.tok.encode_batch_fast(texts[i:i + BLOBS], add_special_tokens=False)])
            at = np.searchsorted(np.cumsum(self.token_bytes[ids]), stop, side="right")
            counts[which] = np.diff(np.concatenate([[0], at]))
            parts.append(ids)
            order.append(which)
        which = np.flatnonzero(~joins)
        if len(which):
            texts = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[which], end[which])]
            enc = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            counts[which] = [len(x) for x in enc]
            parts.append(np.concatenate(enc))
            order.append(which)
        flat, order = np.concatenate(parts), np.concatenate(order)
        first = np.cumsum(counts[order]) - counts[order]  # where each unit's ids begin in flat
        begin = np.empty(len(start), np.int64)
        begin[order] = first
        return _take(flat, begin, counts), counts

    def _slots(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray | None:
        """Memo slot of each unit; None if two different units share a hash."""
        h = hash_ranges(buf, start, end)
        slot = self.slots.find(h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            fresh, where, which = np.unique(h[new], return_index=True, return_inverse=True)
            where = new[where]
            ids, counts = self._ids_of(buf, start[where], end[where])
            slot[new] = len(self.slots) + which
            self.slots.add(fresh)
            self.ids = np.concatenate([self.ids, ids])
            self.iptr = np.concatenate([self.iptr, self.iptr[-1] + np.cumsum(counts)])
            size = end[where] - start[where]
            self.raw = np.concatenate([self.raw, _take(buf, start[where], size)])
            self.rptr = np.concatenate([self.rptr, self.rptr[-1] + np.cumsum(size)])
        size = end - start
        if (self.rptr[slot + 1] - self.rptr[slot] != size).any():
            return None
        return slot if np.array_equal(_take(self.raw, self.rptr[slot], size), buf) else None

    def _encode(self, buf: np.ndarray, off: np.ndarray, want_ids: bool) -> tuple[np.ndarray | None, np.ndarray]:
        if len(self.slots) > MAX_UNITS or len(self.raw) > MAX_UNIT_BYTES:
            self._clear()
        start, end, ptr = find_units(buf, off)
        if len(start) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        slot = self._slots(buf, start, end)
        if slot is None:  # equal hashes: encode the texts themselves
            self._clear()
            texts = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])]
            enc = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate(enc), np.array([len(x) for x in enc], np.int64)
        counts = self.iptr[slot + 1] - self.iptr[slot]
        upto = np.concatenate([[0], np.cumsum(counts)])
        per_text = np.diff(upto[ptr])
        return (_take(self.ids, self.iptr[slot], counts) if want_ids else None), per_text

    def lengths(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Number of ids of each text."""
        return self._encode(buf, off, False)[1]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each text."""
        return self._encode(buf, off, True)


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder of a tokenizer file (kept between tasks)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]
