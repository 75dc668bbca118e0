"""Quality rules: counts of each text, and a linear-chain CRF that marks its lines content or boilerplate."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, texts_of
from .learning import labelled, logistic

#: The symbols that count.
SYMBOLS = "#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
#: The CRF is fitted on at most so many labelled documents.
TRAIN_DOCS = 4000
CONTENT_SHARE = 0.5

FEATURES = ("bias", "words_1_2", "words_3_5", "words_6_on", "symbols_some", "symbols_many", "bars", "capitals", "shouts", "digits", "ends_sentence", "starts_capital", "seen_before", "long_words", "few_vowels", "link", "repeats")
_CAPITALS = bytes(range(0x41, 0x5B))
_SMALL = bytes(range(0x61, 0x7B))
_VOWELS = b"aeiouyAEIOUY"
_DIGITS = b"0123456789"
_MARKS = SYMBOLS.encode()
_URL = re.compile(rb"https?://|www\.")


def repeat_words(words: list[bytes]) -> int:
    """How many words lie in 3-word windows that occur twice or more, all occurrences counted."""
    n = len(words)
    if n < 4:
        return 0
    known = dict.fromkeys(words)
    known = dict(zip(known, range(len(known))))
    ids = np.fromiter(map(known.__getitem__, words), np.int64, n)
    pair = ids[:-1] * len(known) + ids[1:]
    if len(known) > 1 << 20:  # so that the product below stays within 63 bits
        _, pair = np.unique(pair, return_inverse=True)
    windows = pair[:-1] * len(known) + ids[2:]
    order = np.argsort(windows)
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def _without(raw: bytes, some: bytes) -> int:
    return len(raw) - len(raw.translate(None, some))


def analyse(raw: bytes) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); features and word counts of the lines with a word."""
    every, out, sizes, seen, dup = [], [], [], set(), 0
    for line in raw.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, again = len(words), line in seen
        every += words
        sizes.append(n)
        dup += again
        seen.add(line)
        chars = len(line) - n + 1
        capitals, small, marks = _without(line, _CAPITALS), _without(line, _SMALL), _without(line, _MARKS)
        out.append((
            1.0, n <= 2, 3 <= n <= 5, n >= 6, marks > 0, marks * 20 > chars, line.count(b"|") * 4 >= n, capitals > small, line.count(b"!!") * 3 >= n,
            _without(line, _DIGITS) * 5 > chars, words[-1][-1:] in (b".", b"!", b"?"), words[0][:1].isupper(), again, chars > 14 * n, _without(line, _VOWELS) * 5 < capitals + small,
            bool(_URL.search(line)), n >= 6 and len(set(words)) * 2 < n,
        ))
    counts = len(every), len(raw.translate(None, _SPACE).decode()), _without(raw, _MARKS), dup, repeat_words(every)
    return counts, np.array(out, np.float64).reshape(-1, len(FEATURES)), np.array(sizes, np.int64)


class Crf:
    """Two labels: 0 boilerplate, 1 content. emit: labels x features; move: from x to."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def mark(self, x: np.ndarray) -> np.ndarray:
        """Viterbi's labels; on ties content."""
        s = x @ self.emit.T
        n = len(s)
        if not n:
            return np.zeros(0, int)
        m00, m01, m10, m11 = self.move.ravel().tolist()
        a, b = s[0].tolist()
        back = []
        for e0, e1 in s[1:].tolist():
            from0 = b + m10 >= a + m00
            from1 = b + m11 >= a + m01
            back.append((from0, from1))
            a, b = (b + m10 if from0 else a + m00) + e0, (b + m11 if from1 else a + m01) + e1
        label = int(b >= a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return np.array(out[::-1])

    @staticmethod
    def gradient(texts: list[np.ndarray], labels: list[np.ndarray]) -> Callable:
        """Of the mean log likelihood of the lines' labels, as a function of emit and move.

        Forward and backward sums run over all documents side by side, longest first.
        """
        pairs = sorted(((x, y) for x, y in zip(texts, labels) if len(x)), key=lambda p: -len(p[0]))
        size = np.array([len(x) for x, _ in pairs])
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        x, y = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
        total = len(x)
        inner = np.setdiff1d(np.arange(total), start + size - 1)
        gold_emit = np.stack([x[y == c].sum(axis=0) for c in (0, 1)])
        gold_move = np.array([[np.sum((y[inner] == a) & (y[inner + 1] == b)) for b in (0, 1)] for a in (0, 1)], float)
        live = [int((size > t).sum()) for t in range(size[0])]

        def at(emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            s = x @ emit.T
            fwd, bwd = np.zeros_like(s), np.zeros_like(s)
            fwd[start] = s[start]
            for t in range(1, size[0]):
                i = start[: live[t]] + t
                fwd[i] = np.logaddexp(fwd[i - 1, :1] + move[0], fwd[i - 1, 1:] + move[1]) + s[i]
            for t in range(size[0] - 2, -1, -1):
                i = start[: live[t + 1]] + t
                nxt = s[i + 1] + bwd[i + 1]
                bwd[i] = np.logaddexp(nxt[:, :1] + move[:, 0], nxt[:, 1:] + move[:, 1])
            z = np.repeat(np.logaddexp(*(fwd[start] + bwd[start]).T), size)
            p = np.exp(fwd + bwd - z[:, None])
            pair = np.exp(fwd[inner][:, :, None] + move + (s[inner + 1] + bwd[inner + 1])[:, None, :] - z[inner][:, None, None]).sum(axis=0)
            return (gold_emit - p.T @ x) / total, (gold_move - pair) / total

        return at

    @staticmethod
    def fit(texts: list[np.ndarray], labels: list[np.ndarray], l2: float = 1e-3, rounds: int = 150) -> Crf:
        """Maximum likelihood of each document's line labels by Adam."""
        w = [np.zeros((2, len(FEATURES))), np.zeros((2, 2))]
        if not any(map(len, texts)):
            return Crf(*w)
        at = Crf.gradient(texts, labels)
        first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
        for turn in range(1, rounds + 1):
            for i, g in enumerate(at(*w)):
                g = g - l2 * w[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                w[i] = w[i] + 0.1 * (first[i] / (1 - 0.9**turn)) / (np.sqrt(second[i] / (1 - 0.99**turn)) + 1e-8)
        return Crf(*w)

    @staticmethod
    def of_documents(texts: list[np.ndarray], labels: list[int], turns: int = 2) -> Crf:
        """From labels of whole documents, by hard EM over the lines' labels.

        At first a line is content as far as its features are likelier among lines of good documents than of bad ones,
        so that a bad document's prose is content and a good one's junk isn't. Then the chain is fitted to these and
        marks the lines anew, with their neighbours. In each turn a good document keeps content as half of its lines at
        least, and a bad one boilerplate in one at least, those that come nearest to it.
        """
        pairs = [(x, y) for x, y in zip(texts, labels) if len(x)]
        if len({y for _, y in pairs}) < 2:  # nothing tells lines apart
            return Crf.fit([x for x, _ in pairs], [np.full(len(x), y) for x, y in pairs])
        x = np.concatenate([x for x, _ in pairs])
        y = np.repeat([float(y) for _, y in pairs], [len(x) for x, _ in pairs])
        w = logistic(x, y)
        prior = np.log(y.mean() / (1 - y.mean()))
        own = [x @ w[:-1] + w[-1] - prior for x, _ in pairs]
        marks = [Crf.allowed(o >= 0, o, y) for o, (_, y) in zip(own, pairs)]
        crf = Crf.fit([x for x, _ in pairs], marks)
        for _ in range(turns):
            marks = [Crf.allowed(crf.mark(x), o, y) for o, (x, y) in zip(own, pairs)]
            crf = Crf.fit([x for x, _ in pairs], marks)
        return crf

    @staticmethod
    def allowed(marks: np.ndarray, odds: np.ndarray, good: int) -> np.ndarray:
        """The marks with as few changed as the document's label demands, by the lines' odds to be content."""
        marks = np.asarray(marks).astype(int)
        order = np.argsort(odds, kind="stable")
        if good:
            least = order[::-1][: (len(marks) + 1) // 2]
            return marks if 2 * marks.sum() >= len(marks) else np.where(np.isin(np.arange(len(marks)), least), 1, marks)
        return marks if not marks.all() else np.where(np.arange(len(marks)) == order[0], 0, marks)


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Crf:
    """The CRF of at most ``most`` labelled documents (labels.quality), of which only line features reach the driver."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            found = [analyse(t)[1] for t in texts_of(batch.column(0))]
            return {"y": batch.column(1), "x": pa.array([np.packbits(f.astype(bool)).tobytes() for f in found], pa.binary()), "n": pa.array([len(f) for f in found], pa.int32())}

        return step

    rows = per_batch(labelled(docs, labels, "quality", most).select("text", "y"), "y int, x binary, n int", make).collect()
    rows.sort(key=lambda r: (r.n, r.y, bytes(r.x)))
    k = len(FEATURES)
    return Crf.of_documents([np.unpackbits(np.frombuffer(bytes(r.x), np.uint8), count=r.n * k).reshape(r.n, k).astype(float) for r in rows], [int(r.y > 0) for r in rows])


def judge(docs: DataFrame, crf: Crf, share: float = CONTENT_SHARE) -> DataFrame:
    """One row for every row of docs(doc_id, text, ...): the counts, base_failed, content_share and kept.

    content_share is the part of the words that stands in lines marked content (0 for a text without words). A null
    or empty text has all counts 0, fails the base rule and isn't kept. Other columns are not read.
    """

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            counts, shares = [], []
            for raw in texts_of(batch.column(1)):
                count, x, sizes = analyse(raw)
                counts.append(count)
                shares.append(float(crf.mark(x) @ sizes / sizes.sum()) if len(sizes) else 0.0)
            n, chars, symbols, dup, rep = (np.array(c, np.int64) for c in zip(*counts))
            failed = (n < 50) | (100 * rep > 50 * n)
            shares = np.array(shares)
            return {"doc_id": batch.column(0), "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": rep, "base_failed": failed, "kept": ~failed & (shares >= share), "content_share": shares}

        return step

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_batch(cols, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double", make)
