"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Plain words are words, others count by their form. Each of the corpus's frequent words has a vector of its own, the rarer
ones share those of buckets. A word's index vector is sparse and random, made from the word alone; its context vector is
the sum of the index vectors of the words next to it, over the whole corpus, so it costs one pass and a sum per word. A
document is the mean of its words' vectors and of their squares, and how alike neighbouring vectors are. The network's
logits are divided by a temperature fitted on rows kept apart from its training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, frequent, per_batch, per_partition, scratch
from .learning import labelled, remainder, sigmoid
from .word_shapes import Rows, Shapes, hash_of, shape_of

#: Words with a vector of their own, their bytes at most, and buckets of all other words.
WORDS, LONGEST, BUCKETS = 32_768, 64, 8192
DIMS, NONZERO, WINDOW = 32, 2, 2
#: Words of a batch or text whose neighbours are looked at together.
BLOCK = 1 << 17
#: The network is fitted on at most so many labelled documents.
TRAIN_DOCS = 8000
HIDDEN = 16


class Slots(dict):
    """word -> row of the vectors, remembered within bounds: its own one, or that of its bucket."""

    def __init__(self, words: dict[bytes, int]):
        self.words = words
        own = np.zeros(len(words), np.uint64)
        own[list(words.values())] = [hash_of(w) for w in words]
        self.own = Rows(own)

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        form = shape_of(word)
        at = self.words.get(form)
        if at is None:
            at = len(self.words) + hash_of(form) % BUCKETS
        self[word] = at
        return at

    def of(self, text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def of_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all words of the texts, one text after the other, and each text's number of words."""
        found, number = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        for shapes in Shapes.of(texts):
            rows = self.own.of(shapes.hash)
            rare = np.flatnonzero(rows < 0)
            rows[rare] = len(self.words) + (shapes.hash[rare] % np.uint64(BUCKETS)).astype(np.int32)
            found.append(rows)
            number += shapes.words
        return np.concatenate(found), number


class Met:
    """Shapes met in a task and how often, by hash; their bytes are kept once."""

    def __init__(self):
        self.hash, self.place, self.n, self.words = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def __len__(self) -> int:
        return len(self.hash)

    def full(self) -> bool:
        return len(self) > 300_000 or sum(w.nbytes for w in self.words) > 64 << 20

    def add(self, shapes: Shapes) -> None:
        h, n, word = shapes.distinct()
        at = np.searchsorted(self.hash, h)
        known = np.zeros(len(h), bool)
        inner = np.flatnonzero(at < len(self))
        known[inner] = self.hash[at[inner]] == h[inner]
        self.n[self.place[at[known]]] += n[known]
        new = ~known
        places = np.arange(int(new.sum())) + len(self)
        self.hash, self.place = np.insert(self.hash, at[new], h[new]), np.insert(self.place, at[new], places)
        self.n = np.r_[self.n, n[new]]
        self.words.append(shapes.bytes_of(word[new]))

    def found(self) -> dict:
        return {"word": pa.concat_arrays(self.words).cast(pa.binary()) if self.words else pa.array([], pa.binary()), "n": pa.array(self.n, pa.int64())}


def vocabulary(docs: DataFrame, most: int = WORDS) -> dict[bytes, int]:
    """The frequent words of all documents, ``most`` of them at most, and their rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        met = Met()
        for batch in batches:
            for shapes in Shapes.of(batch.column(0)):
                met.add(shapes)
                if met.full():
                    yield met.found()
                    met = Met()
        yield met.found()

    counts = per_partition(docs.select(F.col("text").cast("string").alias("text")), "word binary, n long", count).groupBy("word").agg(F.sum("n").alias("n"))
    with scratch():
        often = frequent(Saved(counts, "words").df, "word", "n", most, LONGEST).select("word").collect()
    return {w: i for i, w in enumerate(sorted(bytes(r.word) for r in often))}


def index_vectors(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each row, from its word or bucket alone."""
    names = [b"w" + w for w in words] + [b"b%d" % b for b in range(BUCKETS)]
    h = np.array([[xxhash.xxh64_intdigest(name, 11 + k) for k in range(NONZERO)] for name in names], np.uint64)
    return (h % np.uint64(DIMS)).astype(np.int32), np.where(h >> np.uint64(40) & np.uint64(1), 1, -1).astype(np.int8)


def word_vectors(docs: DataFrame, words: dict[bytes, int]) -> np.ndarray:
    """Rows of words and buckets x DIMS, of unit length (zero for what isn't met), from all documents. Sums are of whole
    numbers; each task gives one for each of its rows.
    """
    shared, rows = docs.sparkSession.sparkContext.broadcast(words), len(words) + BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        slots, (place, sign) = Slots(shared.value), index_vectors(shared.value)
        places, signs = place.T.astype(np.int64), sign.T.astype(float)
        total = np.zeros(rows * DIMS)
        for batch in batches:
            flat, words_in = slots.of_all(batch.column(0))
            texts = np.repeat(np.arange(len(words_in)), words_in)
            for i in range(0, len(flat), BLOCK):
                own, doc = flat[i : i + BLOCK + WINDOW], texts[i : i + BLOCK + WINDOW]
                at = own.astype(np.int64) * DIMS
                for p, s in zip([p[own] for p in places], [s[own] for s in signs]):
                    for far in range(1, WINDOW + 1):
                        left, right = slice(0, max(0, min(BLOCK, len(own) - far))), slice(far, far + BLOCK)
                        same = doc[left] == doc[right]
                        np.add.at(total, at[left] + p[right], s[right] * same)
                        np.add.at(total, at[right] + p[left], s[left] * same)
        whole = total.astype(np.int64).reshape(rows, DIMS)
        met = np.flatnonzero(whole.any(axis=1))
        yield {"row": pa.array(met, pa.int32())} | {f"c{d}": pa.array(whole[met, d], pa.int64()) for d in range(DIMS)}

    parts = per_partition(docs.select(F.col("text").cast("string").alias("text")), ", ".join(["row int", *(f"c{d} long" for d in range(DIMS))]), run)
    sums = parts.groupBy("row").agg(*(F.sum(f"c{d}").alias(f"c{d}") for d in range(DIMS))).toArrow()  # at most ``rows`` rows
    out = np.zeros((rows, DIMS))
    out[sums.column("row").to_numpy()] = np.stack([sums.column(f"c{d}").to_numpy() for d in range(DIMS)], axis=1) if sums.num_rows else 0
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=out, where=size > 0).astype(np.float32)


#: Means, mean squares, likeness of neighbours, share of different buckets, logarithm of the length.
POOLED = 2 * DIMS + 3


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    if not len(ids):
        return np.zeros(POOLED)
    kinds, count = np.unique(ids, return_counts=True)
    v, near = vectors[kinds], 0.0
    for i in range(0, len(ids), BLOCK):
        each = vectors[ids[i : i + BLOCK + 1]]
        near += np.einsum("ij,ij->", each[1:], each[:-1])
    near /= len(ids)
    return np.r_[count @ v / len(ids), count @ (v * v) / len(ids) * 4, near, len(kinds) / len(ids), np.log1p(len(ids)) / 4]


class Network:
    """x -> tanh -> logit / temperature."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature):
        self.parts = mean, scale, w1, b1, w2, b2, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2, _ = self.parts
        return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.parts[-1])

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, rounds: int = 400, l2: float = 1e-4, seed: int = 5) -> Network:
        """Adam on four fifths of the rows; the temperature minimises the loss of the rest. No rows: score 0.5."""
        n = len(x)
        k = POOLED
        rng = np.random.default_rng(seed)
        if not n or y.min() == y.max():
            return Network(np.zeros(k), np.ones(k), np.zeros((k, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0 if not n else 6.0 * (2 * y[0] - 1), 1.0)
        apart = np.arange(n) % 5 == 4
        if len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
            apart[:] = False
        a, ya = x[~apart], y[~apart]
        mean, scale = a.mean(axis=0), a.std(axis=0) + 1e-3
        z = (a - mean) / scale
        p = [rng.normal(0, 1 / np.sqrt(k), (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
        for t in range(1, rounds + 1):
            h = np.tanh(z @ p[0] + p[1])
            e = (sigmoid(h @ p[2] + p[3]) - ya) / len(ya)
            dh = np.outer(e, p[2]) * (1 - h * h)
            for i, g in enumerate((z.T @ dh + l2 * p[0], dh.sum(axis=0), h.T @ e + l2 * p[2], e.sum(keepdims=True))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                p[i] = p[i] - 0.02 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
        net = Network(mean, scale, *p[:3], float(p[3][0]), 1.0)
        if apart.any():
            logits, truth = net.logits(x[apart]), y[apart]
            loss = lambda t: np.mean(np.logaddexp(0, logits / t) - truth * logits / t)
            net = Network(*net.parts[:-1], float(min(np.geomspace(0.25, 8, 121), key=loss)))
        return net


class Vectors:
    """Words and the vectors of their rows."""

    def __init__(self, words: dict[bytes, int], rows: np.ndarray):
        self.words, self.rows = words, rows


def _pool(rows: DataFrame, vectors: Vectors, last) -> DataFrame:
    """doc_id and another column, and what last makes of the pooled vectors."""
    other = rows.columns[2]
    shared = rows.sparkSession.sparkContext.broadcast(vectors)  # (WORDS + BUCKETS) x DIMS floats at most: 5 MB, and the words: 3 MB

    def make():
        slots, table = Slots(shared.value.words), shared.value.rows

        def step(batch: pa.RecordBatch) -> dict:
            flat, words_in = slots.of_all(batch.column(1))
            x = np.array([pooled(ids, table) for ids in np.split(flat, np.cumsum(words_in)[:-1])]).reshape(-1, POOLED)
            return {"doc_id": batch.column(0), other: batch.column(2), "out": last(x)}

        return step

    kind = "double" if last is not _listed else "array<double>"
    return per_batch(rows, f"doc_id long, {other} {dict(rows.dtypes)[other]}, out {kind}", make)


def _listed(x: np.ndarray) -> pa.Array:
    return pa.array(list(x), pa.list_(pa.float64()))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> tuple[Vectors, Network]:
    """Word vectors of all documents; the network of at most ``most`` labelled ones outside the held-out third."""
    words = vocabulary(docs)
    vectors = Vectors(words, word_vectors(docs, words))
    rows = _pool(labelled(docs, labels, "quality", most).select("doc_id", "text", "y"), vectors, _listed).collect()
    rows.sort()
    x = np.array([r.out for r in rows], float).reshape(-1, POOLED)
    return vectors, Network.fit(x, np.array([float(r.y > 0) for r in rows]))


def score(docs: DataFrame, vectors: Vectors, net: Network, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text, ...); other columns are not read.

    Null texts count as empty; an empty text's vector is zero. A null doc_id stays null and isn't held out.
    """
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cols = cols.withColumn("held_out", F.coalesce(remainder() == 1, F.lit(False)))
    out = _pool(cols, vectors, net.scores).withColumnRenamed("out", "score")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
