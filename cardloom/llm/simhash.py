"""SimHash near-dedup with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded to a 23-bit word. Two fingerprints
that differ in at most 3 bits fall under one of two cases:

* some segment is equal and another differs in at most one bit, or
* each of the three segments differs in exactly one bit.

If words x and y differ in at most one bit, the codeword nearest to y is within distance 4 of x. So the index side
stores each segment under its nearest codeword, the query side asks for all codewords within distance 4 (one or six),
and no pair is lost. The first case joins on the equal segment's 21 or 22 bits and the other's codeword. The second
joins on the codewords of two segments and the flipped parities of all three, and needs only fingerprints of
even weight to ask those of odd weight. Every hit is verified by its Hamming distance.
"""

from __future__ import annotations

from itertools import permutations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, per_batch, scratch, texts_of, words_of
from .components import components
from .golay import nearby, nearest

SEED, DISTANCE, WORDS = 42, 3, 3
_CUTS = ((0, 22), (22, 21), (43, 21))
_CHUNK = 1 << 15


def fingerprint(text: bytes) -> int:
    """64 bits; bit i is set if more than half of the shingles' XXH64 have it. No words: 0."""
    words = words_of(text.lower())
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(words, words[1:], words[2:]))) if len(words) >= WORDS else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles)).view(np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(h[i : i + _CHUNK], axis=1, bitorder="little").sum(axis=0, dtype=np.uint32).astype(np.int64) for i in range(0, len(h), _CHUNK))
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for every row; a null text counts as empty, a null doc_id stays."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            fps = np.fromiter(map(fingerprint, texts_of(batch.column(1))), np.uint64, batch.num_rows)
            return {"doc_id": batch.column(0), "fp": fps.view(np.int64)}

        return step

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id long, fp long", make)


def _pack(kind: int, *parts: tuple[np.ndarray, int]) -> np.ndarray:
    key = np.int64(kind)
    for value, bits in parts:
        key = (key << bits) | value.astype(np.int64)
    return key


def keys(fps: np.ndarray, ask: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of the query side (ask) or the index side."""
    seg = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.uint32) for at, n in _CUTS]
    rows, out = [], []
    every = np.arange(len(fps))
    near = [nearby(s) if ask else (every, nearest(s)) for s in seg]
    for kind, (a, b) in enumerate(permutations(range(3), 2)):
        row, code = near[b]
        rows.append(row)
        out.append(_pack(kind + 1, (seg[a][row], 22), (code, 12)))
    odd = np.bitwise_count(fps) & 1
    some = np.flatnonzero(odd == (0 if ask else 1))
    flips = [(np.bitwise_count(s[some]) & 1) ^ (1 if ask else 0) for s in seg]
    if ask:
        r0, c0 = nearby(seg[0][some])
        n1 = np.bincount(nearby(seg[1][some])[0], minlength=len(some))
        c1_all = nearby(seg[1][some])[1]
        start = np.cumsum(n1) - n1
        times = n1[r0]
        row = np.repeat(r0, times)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        c0, c1 = np.repeat(c0, times), c1_all[start[row] + nth]
    else:
        row = np.arange(len(some))
        c0, c1 = nearest(seg[0][some]), nearest(seg[1][some])
    rows.append(some[row])
    out.append(_pack(7, (c0, 12), (c1, 12), *((f[row], 1) for f in flips)))
    return np.concatenate(rows), np.concatenate(out)


def _keyed(nodes: DataFrame, ask: bool) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch):
            every, node = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for i in range(0, len(every), 4096):
                part, own = every[i : i + 4096], node[i : i + 4096]
                row, key = keys(part, ask)
                yield {"key": key, "fp": part[row].view(np.int64), "node": own[row]}

        return step

    return per_batch(nodes.select("fp", "node"), "key long, fp long, node long", make)


def links(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes(fp, node) whose fingerprints differ in 1 to DISTANCE bits; each pair at least once."""
    ask, has = _keyed(nodes, True), _keyed(nodes, False).toDF("k", "other", "v")
    near = (F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= DISTANCE)
    return ask.join(has, (F.col("key") == F.col("k")) & near).select(F.col("node").alias("u"), "v")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of docs(doc_id, text, ...); other columns are not read.

    Equal texts meet in one fingerprint before any pair is formed, so a group of copies of any size costs one node.
    component_id is the least doc_id reachable over links. Null or empty texts have fingerprint 0 and link like any
    other. A row whose doc_id is null gets its component's least doc_id, or null if there is none. Any long is a
    doc_id. An empty table gives no rows.
    """
    with scratch() as kept:
        found = Saved(fingerprints(docs), "fingerprints")
        nodes = Saved(found.df.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least")), "nodes").df
        roots = components(links(nodes.select(F.col("node").alias("fp"), "node"))).withColumnRenamed("node", "child")
        named = Saved(nodes.join(roots, F.col("node") == F.col("child"), "left").select("node", "least", F.coalesce("root", "node").alias("root")), "named")
        least = named.df.groupBy("root").agg(F.min("least").alias("component_id"))
        kept += [found, of := Saved(named.df.select("node", "root").join(least, "root").select(F.col("node").alias("own"), "component_id"), "components")]
    return found.df.join(of.df, F.col("fp") == F.col("own")).select("doc_id", "fp", "component_id")


def hex_of(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
