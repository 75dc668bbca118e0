"""Words of many texts at once as shapes and their XXH64, by numpy over the bytes of a whole Arrow batch.

What shape_of says of one word is worked out here for all of a batch without an object a word. Words are told apart by
the 64 bits of their shape's hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SEED = 7
_LETTERS = re.compile(rb"[A-Za-z\x80-\xff]+")
_REPEAT = re.compile(rb"(.)\1+")
_CAPITALS = b"\0AA"
#: Classes of bytes, for bytes.translate: space, a to z, A to Z, other letters, digits, other marks.
_SPACE, _LOWER, _UPPER, _LETTER, _DIGIT, _MARK = range(6)
_CLASS = bytes(_SPACE if b == 32 or 9 <= b <= 13 else _LOWER if 97 <= b <= 122 else _UPPER if 65 <= b <= 90 else _LETTER if b >= 128 else _DIGIT if 48 <= b <= 57 else _MARK for b in range(256))
_P1, _P2, _P3, _P4, _P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Bytes of text that are worked on at once.
PIECE = 1 << 20
#: Shapes of fewer bytes are hashed by numpy; longer ones are few.
_SHORT = 32


def shape_of(word: bytes) -> bytes:
    """Plain words stand for themselves; capitals and words with marks for their form, so that unseen ones are known."""
    low = word.lower()
    if word.isalpha() or _LETTERS.fullmatch(word):
        return _CAPITALS if len(word) > 1 and word.isupper() else low
    form = _LETTERS.sub(lambda m: b"A" if len(m[0]) > 1 and m[0].isupper() else b"a", word)
    return b"\0" + _REPEAT.sub(rb"\1", re.sub(rb"[0-9]", b"0", form))


def hash_of(shape: bytes) -> int:
    return xxhash.xxh64_intdigest(shape, SEED)


def _rotl(h: np.ndarray, r: int) -> np.ndarray:
    return h << np.uint64(r) | h >> np.uint64(64 - r)


def _xxh64(buf: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """XXH64 of the ``size`` < 32 bytes at each place; 7 bytes follow the last one."""
    long = np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))
    h = np.full(len(at), (SEED + int(_P5) + size) % 2**64, np.uint64)
    for i in range(0, size - 7, 8):
        h = _rotl(h ^ _rotl(long[at + i] * _P2, 31) * _P1, 27) * _P1 + _P4
    i = size & ~7
    if i < size:
        rest = long[at + i]
        if size & 4:
            h = _rotl(h ^ (rest & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
            rest = rest >> np.uint64(32)
        for _ in range(size & 3):
            h = _rotl(h ^ (rest & np.uint64(255)) * _P5, 11) * _P1
            rest = rest >> np.uint64(8)
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def _flags(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[at] = True
    return out


def _spans(at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of those spans, one span after the other, and where each begins among them."""
    ends = np.cumsum(size)
    return np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0), ends - size


def _end(data: np.ndarray, bounds: np.ndarray, at: int) -> int:
    """Where the piece that begins at ``at`` ends: with a text, else after a space, else after its first word."""
    end = at + PIECE
    if end >= len(data):
        return len(data)
    last = int(bounds[np.searchsorted(bounds, end, "right") - 1])
    if last > at:
        return last
    stop = int(bounds[np.searchsorted(bounds, at, "right")])
    spaces = _spaces(data[at:end])
    if len(spaces):
        return at + int(spaces[-1]) + 1
    for i in range(end, stop, PIECE):
        spaces = _spaces(data[i : min(i + PIECE, stop)])
        if len(spaces):
            return i + int(spaces[0]) + 1
    return stop


def _spaces(data: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(data.tobytes().translate(_CLASS), np.uint8) == _SPACE)


class Shapes:
    """The shapes of all words of texts, in order: places in a buffer, hashes; and each text's number of words.

    bounds: where each text begins in data, and where the last one ends; no text goes beyond data.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self._cut(data, bounds)
        self.hash = self._hashes()

    @staticmethod
    def of(column: pa.Array) -> Iterator[Shapes]:
        """Those of a column of texts by pieces that end with a text or at a space, so that memory is bounded but for words
        longer than a piece. Each piece has a number for every text. Null texts count as empty.
        """
        column = column.cast(pa.large_binary())
        column = column.fill_null(b"") if column.null_count else column
        if not len(column):
            return
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        at = 0
        while at < len(data) or not at:
            end = _end(data, bounds, at)
            yield Shapes(data[at:end], np.clip(bounds - at, 0, end - at))
            if end == len(data):
                return
            at = end

    def _cut(self, data: np.ndarray, bounds: np.ndarray) -> None:
        n, raw = len(data), data.tobytes()
        kind = np.frombuffer(raw.translate(_CLASS), np.uint8)
        inside = kind != _SPACE
        heads = _flags(n + 1, bounds)  # where a text begins, and the end
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | heads[1:n]
        at = np.flatnonzero(begins)
        ends = inside & heads[1:]
        ends[:-1] |= inside[:-1] & ~inside[1:]
        size = 1 + np.flatnonzero(ends) - at
        self.words = np.diff(np.searchsorted(at, bounds))
        number = np.cumsum(begins, dtype=np.int32)  # of the word that a byte is in, from 1
        marked = _flags(len(at) + 1, number[kind >= _DIGIT])[1:]
        # capitals: letters only, some A to Z, no a to z
        some = np.flatnonzero(_flags(len(at) + 1, number[kind == _UPPER])[1:] & ~marked & (size > 1))
        some = some[(kind[at[some]] != _LOWER) & (kind[at[some] + 1] != _LOWER)]
        if len(some):
            own, first = _spans(at[some], size[some])
            some = some[~np.logical_or.reduceat(kind[own] == _LOWER, first)]
        forms, form_at, form_size = self._forms(data, kind, at[marked], size[marked])
        self.buffer = np.frombuffer(b"".join([raw.lower(), forms.tobytes(), _CAPITALS, bytes(8)]), np.uint8)
        at[marked], size[marked] = n + form_at, form_size
        at[some], size[some] = n + len(forms), len(_CAPITALS)
        self.at, self.size = at, size

    @staticmethod
    def _forms(data: np.ndarray, kind: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The forms of the marked words at those places, on end, and their places and sizes."""
        if not len(at):
            return np.zeros(0, np.uint8), at, size
        own, word_at = _spans(at, size)
        kind, heads = kind[own], _flags(len(own), word_at)
        number = np.repeat(np.arange(len(at)), size)
        letter = kind < _DIGIT
        begins = letter & (heads | ~np.r_[False, letter[:-1]])
        ends = letter & np.r_[heads[1:] | ~letter[1:], True]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        upper, lower = np.r_[0, np.cumsum(kind == _UPPER)], np.r_[0, np.cumsum(kind == _LOWER)]
        capital = (last > first) & (upper[last + 1] > upper[first]) & (lower[last + 1] == lower[first])
        form = np.where(kind == _DIGIT, np.uint8(48), data[own])
        form[first] = np.where(capital, 65, 97)
        keep = np.flatnonzero(begins | ~letter)
        form, number = form[keep], number[keep]
        heads = np.r_[True, number[1:] != number[:-1]]
        keep = heads | np.r_[True, form[1:] != form[:-1]]
        form, heads = form[keep], heads[keep]
        at = np.flatnonzero(heads)
        size = np.diff(np.r_[at, len(form)]) + 1
        at = at + np.arange(len(at))  # a zero byte before each
        out = np.zeros(len(form) + len(at), np.uint8)
        out[np.flatnonzero(~_flags(len(out), at))] = form
        return out, at, size

    def _hashes(self) -> np.ndarray:
        out = np.zeros(len(self.at), np.uint64)
        size = np.minimum(self.size, _SHORT).astype(np.uint8)
        order = np.argsort(size, kind="stable")
        ends = np.cumsum(np.bincount(size, minlength=_SHORT + 1))
        for n in range(1, _SHORT):
            if ends[n] > ends[n - 1]:
                own = order[ends[n - 1] : ends[n]]
                out[own] = _xxh64(self.buffer, self.at[own], n)
        own = order[ends[_SHORT - 1] :]
        out[own] = [hash_of(self.buffer[a : a + n].tobytes()) for a, n in zip(self.at[own].tolist(), self.size[own].tolist())]
        return out

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes in order, each once, how often they occur, and the number of a word that has it."""
        order = np.argsort(self.hash)
        h = self.hash[order]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        return h[at], np.diff(np.r_[at, len(h)]), order[at]

    def bytes_of(self, words: np.ndarray) -> pa.Array:
        """The shapes of those words."""
        own, first = _spans(self.at[words], self.size[words])
        offsets = np.r_[first, len(own)].astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(self.buffer[own])])


class Rows:
    """Hash -> row of a table of words, by open addressing; -1 for none."""

    def __init__(self, hashes: np.ndarray):
        bits = max(10, int(len(hashes)).bit_length() + 3)
        self.mask = np.uint64((1 << bits) - 1)
        self.hash, self.row = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(hashes))
        at = hashes & self.mask
        while len(left):  # whoever is written last has a free place
            free = self.row[at] < 0
            self.row[at[free]] = left[free]
            lost = self.row[at] != left
            self.hash[at[~lost]] = hashes[left[~lost]]
            left, at = left[lost], at[lost] + np.uint64(1) & self.mask

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        out = np.where(self.hash[at] == hashes, self.row[at], np.int32(-1))
        left = np.flatnonzero((out < 0) & (self.row[at] >= 0))
        at = at[left]
        while len(left):
            at = at + np.uint64(1) & self.mask
            row = np.where(self.hash[at] == hashes[left], self.row[at], np.int32(-1))
            out[left] = row
            more = (row < 0) & (self.row[at] >= 0)
            left, at = left[more], at[more]
        return out
