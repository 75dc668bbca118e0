"""SentencePiece encoding and decoding by suffix-array matching, for BPE models with byte fallback.

The distinct segments of a batch of texts are laid end to end and their suffixes sorted by the longest piece's length.
Each piece of the vocabulary is binary-searched there; the range found is all its occurrences. The occurrences, sorted
by where they end, are the edges of a lattice, which is relaxed from left to right. What is relaxed is not a sum of
scores: a BPE encoding is the path on which every two neighbours are themselves the encoding of their concatenation, and
each prefix of a segment has exactly one such path. So the last piece of a prefix is the one edge whose piece
follows the last piece of the prefix before it.

A segment is a run of spaces and what follows up to the next space. No piece goes on after a space, so segments are
encoded on their own and remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, texts_of

#: The default vocabulary file; a parameter everywhere.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters matched at once, and segments and pairs of pieces remembered by a worker: some 300 MB.
CHUNK, REMEMBER, PAIRS = 250_000, 400_000, 1_000_000
_START, _UNKNOWN = -1, -2


class Vocabulary:
    """What a model file says: pieces with scores, byte pieces, and the rest (control, unknown), which match nothing."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bytes_: list[int], texts: list[bytes]):
        self.pieces, self.bytes, self.texts = pieces, bytes_, texts
        self.key = hashlib.sha256(repr((sorted(pieces.items()), bytes_)).encode()).hexdigest()

    @staticmethod
    def read(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, bytes_, texts = {}, [-1] * 256, []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                bytes_[int(p[1:-1], 16)] = i
                texts.append(bytes([int(p[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                texts.append(b"")
            else:
                pieces[p] = (i, sp.get_score(i))
                texts.append(p.replace(SPACE, " ").encode())
        if any(SPACE in p.lstrip(SPACE) for p in pieces) or any("\n" in p for p in pieces) or -1 in bytes_:
            raise ValueError("the vocabulary needs all byte pieces, and no piece that goes on after a space or has a line end")
        return Vocabulary(pieces, bytes_, texts)


_SEGMENT = re.compile(rb"\n| *[^ \n]+| +")
_encoders: dict[tuple[str, int, int], Encoder] = {}


class Encoder:
    """Segments to ids; one for each vocabulary and process, so that tasks share what it remembers."""

    def __init__(self, v: Vocabulary, remember: int = REMEMBER, pairs: int = PAIRS):
        self.v, self.remember, self.pairs = v, remember, pairs
        self.strings = sorted(v.pieces)
        self.ids = [v.pieces[p][0] for p in self.strings]
        self.string = {v.pieces[p][0]: p for p in self.strings}
        self.size = {i: len(p) for i, p in self.string.items()}
        letters = sorted({c for p in self.strings for c in p})
        if len(letters) > 0xFFF0 or max(map(len, self.strings)) > 16:
            raise ValueError("pieces of more than 16 characters or 65,520 letters aren't supported")
        self.code = np.ones(0x110000, np.uint16)  # 0 ends a segment, 1 is a letter no piece has
        self.code[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
        grid = np.zeros((len(self.strings), 16), np.uint16)
        for r, p in enumerate(self.strings):
            grid[r, : len(p)] = self.code[[ord(c) for c in p]]
        size = np.array([len(p) for p in self.strings])
        full = np.where(np.arange(16) < size[:, None], grid, 0xFFFF)
        self.low, self.high, self.lengths = self._keys(grid), self._keys(full), size
        self.id_of = np.array(self.ids, np.int32)
        self.seen: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.follows: dict[int, bool] = {}

    @staticmethod
    def _keys(grid: np.ndarray) -> np.ndarray:
        """4 x rows: each four letters as one number."""
        g = grid.astype(np.uint64).reshape(len(grid), 4, 4)
        return np.ascontiguousarray(((g[:, :, 0] << 48) | (g[:, :, 1] << 32) | (g[:, :, 2] << 16) | g[:, :, 3]).T)

    def merged(self, text: str) -> list[str]:
        """BPE as defined: again and again join the neighbours whose piece scores best, the leftmost on ties.

        What may be joined waits in a heap, so n letters take n log n steps however they tie; a few are looked through.
        """
        pieces, n = self.v.pieces, len(text)
        if n <= 24:
            parts = list(text)
            while len(parts) > 1:
                fits = [(hit[1], -i) for i in range(len(parts) - 1) if (hit := pieces.get(parts[i] + parts[i + 1])) is not None]
                if not fits:
                    break
                at = -max(fits)[1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return parts
        size, before, after = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (hit := pieces.get(text[i : j + size[j]])) is not None:
                heapq.heappush(heap, (-hit[1], i, size[i] + size[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, long = heapq.heappop(heap)
            if not size[i] or after[i] >= n or size[i] + size[after[i]] != long:
                continue  # one of the two has been joined to another meanwhile
            j = after[i]
            size[i], size[j], after[i] = long, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [text[i : i + size[i]] for i in range(n) if size[i]]

    def _packed(self, parts: Sequence[str]) -> bytes:
        ids: list[int] = []
        for p in parts:
            hit = self.v.pieces.get(p)
            if hit is not None:
                ids.append(hit[0])
            else:
                ids += [self.v.bytes[b] for b in p.encode()]
        return np.array(ids, np.int32).tobytes()

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End and piece number of all occurrences, by end and then the longest first."""
        padded = np.concatenate([codes, np.zeros(20, np.uint16)]).astype(np.uint64)
        n = len(codes)
        four = (padded[:-3] << 48) | (padded[1:-2] << 32) | (padded[2:-1] << 16) | padded[3:]
        keys = [four[k : k + n] for k in (0, 4, 8, 12)]
        suffixes = np.lexsort(keys[::-1])
        first = keys[0][suffixes]
        bounds = []
        for wanted, side in ((self.low, "left"), (self.high, "right")):
            # the first four letters bound the range, the others are searched within it
            lo, hi = np.searchsorted(first, wanted[0], "left"), np.searchsorted(first, wanted[0], "right")
            short = self.lengths <= 4
            found = np.where(short, lo if side == "left" else np.searchsorted(first, wanted[0], "right"), lo)
            todo = np.flatnonzero(~short & (lo < hi))
            lo, hi = lo[todo], hi[todo]
            want = wanted[:, todo]
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                at = suffixes[np.minimum(mid, n - 1)]
                less = np.zeros(len(todo), bool)
                equal = np.ones(len(todo), bool)
                for k in (1, 2, 3):
                    less |= equal & (keys[k][at] < want[k])
                    equal &= keys[k][at] == want[k]
                go = less | equal if side == "right" else less
                lo, hi = np.where(open_ & go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
            found[todo] = lo
            bounds.append(found)
        low, high = bounds
        count = np.maximum(high - low, 0)
        piece = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        end = suffixes[low[piece] + nth] + self.lengths[piece]
        order = np.lexsort((-self.lengths[piece], end))
        return end[order], piece[order]

    def _follows(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of their concatenation; b alone, if a is the start."""
        key = a << 32 | b
        ok = self.follows.get(key)
        if ok is None:
            if len(self.follows) > self.pairs:
                self.follows.clear()
            parts = [self.string[b]] if a == _START else [self.string[a], self.string[b]]
            ok = self.follows[key] = self.merged("".join(parts)) == parts
        return ok

    def _relax(self, segments: list[str], raw: list[bytes]) -> None:
        text = "\0".join(segments) + "\0"
        codes = self.code[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        codes[np.cumsum([len(s) + 1 for s in segments]) - 1] = 0
        ends, pieces = self._edges(codes)
        tokens = self.id_of[pieces].tolist()
        sizes = self.lengths[pieces].tolist()
        ends = ends.tolist()
        ends.append(-1)
        p, start, follows, known, size, bytes_ = 0, 0, self._follows, self.follows.get, self.size, self.v.bytes
        for segment, key in zip(segments, raw):
            n = len(segment)
            last = [_START]
            for at in range(start + 1, start + n + 1):
                best = _UNKNOWN
                while ends[p] == at:
                    if best == _UNKNOWN:
                        token = tokens[p]
                        before = last[at - start - sizes[p]]
                        if before == _UNKNOWN:
                            best = token
                        else:
                            ok = known(before << 32 | token)
                            if ok or ok is None and follows(before, token):
                                best = token
                    p += 1
                last.append(best)
            out, j = [], n
            while j:
                token = last[j]
                if token == _UNKNOWN:
                    out += [bytes_[b] for b in reversed(segment[j - 1].encode())]
                    j -= 1
                else:
                    out.append(token)
                    j -= size[token]
            out.reverse()
            self.seen[key] = array("i", out).tobytes()
            start += n + 1

    def learn(self, segments: set[bytes]) -> None:
        """Encode segments that aren't remembered yet."""
        chunk, keys, size = [], [], 0
        for key in segments:
            text = key.decode().replace(" ", SPACE)
            if text.startswith(SPACE * 2) or "\0" in text:  # pieces of several spaces tie in score
                self.seen[key] = self._packed(self.merged(text))
                continue
            chunk.append(text)
            keys.append(key)
            size += len(text) + 1
            if size > CHUNK:
                self._relax(chunk, keys)
                chunk, keys, size = [], [], 0
        if chunk:
            self._relax(chunk, keys)

    def encode(self, texts: Sequence[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; an empty text has none."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            cut, new, chars = [], set(), 0
            if len(self.seen) > self.remember:
                self.seen, self.old = {}, self.seen
            while at < len(texts) and (not cut or chars < 1_000_000):
                text = texts[at].replace(SPACE.encode(), b" ")
                cut.append(_SEGMENT.findall(b" " + text) if text else [])
                new.update(cut[-1])
                chars += len(text)
                at += 1
            new -= self.seen.keys()
            again = new & self.old.keys()
            self.seen.update((k, self.old[k]) for k in again)
            self.learn(new - again)
            out += [b"".join(map(self.seen.__getitem__, c)) for c in cut]
        return out


def encoder(v: Vocabulary, remember: int = REMEMBER, pairs: int = PAIRS) -> Encoder:
    key = v.key, remember, pairs
    if key not in _encoders:
        _encoders[key] = Encoder(v, remember, pairs)
    return _encoders[key]


def decode(v: Vocabulary, ids: Sequence[int]) -> bytes:
    """The text of ids: pieces put together, without the space that encoding puts in front."""
    raw = b"".join(map(v.texts.__getitem__, ids))
    return raw[1:] if raw[:1] == b" " else raw


def encoded(docs: DataFrame, vocabulary: Vocabulary | None = None, keep: Sequence[str] = (), remember: int = REMEMBER, pairs: int = PAIRS) -> DataFrame:
    """doc_id, the columns of keep, ids, n_tokens, ids_sha256 and round_trip for every row of docs(doc_id, text, ...).

    ids_sha256 is of the ids as little-endian 32-bit numbers. round_trip says that decoding gives the text again; it
    fails only for texts with U+2581, which the model takes for a space. Null and empty texts have no ids. remember and
    pairs bound a worker's memories; less of them costs time only.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary or Vocabulary.read())  # the vocabulary's size, not the data's

    def make():
        v = shared.value
        enc = encoder(v, remember, pairs)

        def step(batch: pa.RecordBatch):
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = list(texts_of(part.column(1)))
                packed = enc.encode(texts)
                ids = [np.frombuffer(p, np.int32) for p in packed]
                yield {
                    "doc_id": part.column(0),
                    "ids": pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)], dtype=np.int32), np.concatenate(ids)),
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    "round_trip": pa.array([decode(v, x.tolist()) == t for x, t in zip(ids, texts)], pa.bool_()),
                } | {c: part.column(k + 2) for k, c in enumerate(keep)}

        return step

    kinds = dict(docs.dtypes)
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    return per_batch(cols, ", ".join(["doc_id long, ids array<int>, n_tokens long, ids_sha256 string, round_trip boolean", *(f"`{c}` {kinds[c]}" for c in keep)]), make)
