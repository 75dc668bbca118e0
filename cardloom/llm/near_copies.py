"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts with one shingle set are one node. As op1, it proposes pairs by SimHash and Golay-code fuzzy keys: a fingerprint of
1,012 bits, over the same shingles, is cut into 44 words of 23 bits. One word alone says too little, and at 0.8 some 15 %
of the bits differ; so each goes with three MinHashes, its anchor, and stands under all codewords within distance 4 of
it. Two nodes meet where an anchor is equal and a codeword is near to both words. The whole sets then verify. Nodes are
brought together before pairs are formed. At first each node is compared with one other only: of all that share a bucket
with it, the one whose buckets are fullest. Copies that were changed each in its own way are near to what they were
copied from, though not to each other, and that original stands in the fullest buckets. So a large group of near copies
costs a pair a node. What is left in different components is compared block by block, and only similar pairs come out: the
largest component's nodes with all others, and the others with each other. Near copies meet in dozens of buckets; so all
nodes that were laid beside the same one, their home, are compared at first, once, and then only buckets that hold several
homes and components. So no proposed pair goes unverified unless its nodes are already together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, per_batch, per_partition, scratch, settings, texts_of, words_of
from .components import components
from .golay import nearby

SEED, WORDS, SIMILARITY = 42, 5, 0.8
#: Words of a fingerprint, bits of each, and MinHashes of its anchor. At 0.8 a word's codewords meet with probability 0.6
#: (0.46 in sets of four and five shingles, the worst), its anchor with 0.8^3: no word does in 1e-7 (7e-6) of the pairs.
FUZZY, BITS, ANCHORS = 44, 23, 3
#: Nodes of a block, and shingles that a block's matrix has at once.
BLOCK, WIDTH = 256, 1 << 14
#: Rows in an Arrow batch: pairs carry two sets.
BATCH = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CHUNK = 1 << 11
_rng = np.random.default_rng(SEED)
_odd = lambda n: _rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _odd(FUZZY * ANCHORS)
_ADD = _rng.integers(0, 1 << 63, FUZZY * ANCHORS, np.uint64)
_VOTES = _odd(-(-FUZZY * BITS // 64))
_MIX = _odd(3)
_LANE = 240  # votes that a byte can count


def _mixed(x: np.ndarray) -> np.ndarray:
    for by in _MIX[:2]:
        x = (x ^ (x >> np.uint64(32))) * by
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of the runs of n words; a shorter text is one run, one without words has none."""
    words = words_of(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    runs = list(map(b" ".join, zip(*(words[i:] for i in range(n))))) if len(words) >= n else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(runs)))


def anchors(own: np.ndarray) -> list[int]:
    """A 63-bit key of the MinHashes that go with each word of the fingerprint."""
    least = np.full(FUZZY * ANCHORS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), _CHUNK):
        np.minimum(least, (own[i : i + _CHUNK, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(b, k) >> 1 for k, b in enumerate(map(bytes, least.reshape(FUZZY, ANCHORS)))]


def fingerprint(own: np.ndarray) -> np.ndarray:
    """FUZZY words of BITS bits; a bit is set if more than half of the shingles' hashes have it."""
    ones = np.zeros(64 * len(_VOTES), np.int64)
    for i in range(0, len(own), _CHUNK):
        h = _mixed(own[i : i + _CHUNK, None] * _VOTES)
        bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
        for j in range(0, len(bits), _LANE):
            ones += bits[j : j + _LANE].sum(axis=0, dtype=np.uint8)
    voted = 2 * ones[: FUZZY * BITS].reshape(FUZZY, BITS) > len(own)
    return (voted @ (1 << np.arange(BITS))).astype(np.uint32)


def keys(anchor: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and 63-bit keys of words: one for each codeword within distance 4, under the word's anchor."""
    row, code = nearby(words)
    return row, (_mixed(anchor.astype(np.uint64)[row] + code.astype(np.uint64) * _MIX[2]) >> np.uint64(1)).astype(np.int64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _marked(docs: DataFrame) -> DataFrame:
    """docs' columns doc_id and row_id, and the node of each row's shingle set with its fingerprint and anchors."""

    def make():
        def step(batch: pa.RecordBatch):
            for i in range(0, batch.num_rows, 250):
                part = batch.slice(i, 250)
                sets = [shingles(t) for t in texts_of(part.column(2))]
                nodes = pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 for s in sets], pa.int64())
                yield {"doc_id": part.column(0), "row_id": part.column(1), "node": nodes, "anchors": pa.array([anchors(s) if len(s) else [] for s in sets], pa.list_(pa.int64())), "words": pa.array([fingerprint(s) if len(s) else [] for s in sets], pa.list_(pa.int32()))}

        return step

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "row_id", F.col("text").cast("string").alias("text")), "doc_id long, row_id long, node long, anchors array<long>, words array<int>", make)


def _keyed(anchored: DataFrame) -> DataFrame:
    """node, key for all codewords near the words of anchored(node, anchor, word)."""

    def make():
        def step(batch: pa.RecordBatch):
            node, anchor, word = (c.to_numpy() for c in batch.columns)
            row, key = keys(anchor, word.astype(np.uint32))
            yield {"node": node[row], "key": key}

        return step

    return per_batch(anchored.select("node", "anchor", "word"), "node long, key long", make)


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, set (sorted hashes, 8 bytes each) of those nodes(row_id, doc_id, node); each node has one row there."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            return {"node": batch.column(0), "set": pa.array([shingles(t).tobytes() for t in texts_of(batch.column(1))], pa.binary())}

        return step

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.col("row_id").alias("r"), F.col("text").cast("string").alias("text"))
    own = nodes.select("node", F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("row_id").alias("r"))
    return per_batch(texts.join(own, ["d", "r"]).dropDuplicates(["node"]).select("node", "text"), "node long, set binary", make)


def _set(raw: pa.Scalar) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), np.uint64)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) that are similar."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            good = np.array([similar(_set(a), _set(b), similarity) for a, b in zip(batch.column(2), batch.column(3))], bool)
            return {"u": batch.column(0).to_numpy()[good], "v": batch.column(1).to_numpy()[good]}

        return step

    of = lambda name: sets.select(F.col("node").alias(name), F.col("set").alias(f"set_{name}"))
    return per_batch(pairs.join(of("v"), "v").join(of("u"), "u").select("u", "v", "set_u", "set_v"), "u long, v long", make)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets have in common."""
    size = list(map(len, sets))
    kinds, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, common = np.repeat(np.arange(len(sets)), size), n[at] > 1  # what one set has alone is in no overlap
    number = np.cumsum(n > 1) - 1
    row, column = row[common], number[at[common]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int((n > 1).sum()), WIDTH):
        here = (column >= low) & (column < low + WIDTH)
        x = np.zeros((len(sets), int(column[here].max()) - low + 1 if here.any() else 0), np.float32)
        x[row[here], column[here] - low] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _within(blocks: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of different components that are similar, of each of blocks' groups (group long, node, root, set)."""

    def pairs(held: list[tuple[int, int, np.ndarray]]) -> dict:
        node, root = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
        both, size = overlaps([h[2] for h in held]), np.array([len(h[2]) for h in held])
        good = (both >= similarity * (size[:, None] + size - both) - 1e-9) & (root[:, None] < root)
        u, v = np.nonzero(good)
        return {"u": node[u], "v": node[v]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, held = None, []
        for batch in batches:
            for group, node, root, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if group != now and held:
                    yield pairs(held)
                    held = []
                now = group
                held.append((node, root, _set(raw).copy()))
        if held:
            yield pairs(held)

    dealt = blocks.repartition("group").sortWithinPartitions("group").select("group", "node", "root", "set")
    return per_partition(dealt, "u long, v long", run)


def _blocks(every: DataFrame) -> DataFrame:
    """group, node, root for every(key, node, root): the groups are pairs of blocks of a bucket, of BLOCK nodes or so each.

    Blocks of the bucket's largest component are paired with those of the others only. A bucket of BLOCK nodes at most is a
    group as it is.
    """
    sizes = Saved(every.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")), "sizes").df
    most = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"))
    parts = lambda n: F.ceil(n / BLOCK).cast("int")
    shape = most.select("key", F.col("most.root").alias("main"), parts(F.col("most.n")).alias("mains"), parts(F.col("all") - F.col("most.n")).alias("rests"), (F.col("all") <= BLOCK).alias("is_one"))
    own = every.join(shape, "key").withColumn("is_main", F.col("root") == F.col("main"))
    own = own.withColumn("b", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    rests = F.sequence(F.lit(0), F.col("rests") - 1)
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: F.struct(F.col("b").alias("i"), (-1 - j).alias("j")))
    among = F.transform(rests, lambda j: F.struct(F.least("b", j).alias("i"), F.greatest("b", j).alias("j")))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    met = F.when(F.col("is_one"), one).when(F.col("is_main"), F.transform(rests, lambda i: F.struct(i.alias("i"), (-1 - F.col("b")).alias("j")))).otherwise(F.concat(among, with_main))
    return own.select("key", "node", "root", F.explode(met).alias("at")).select(F.xxhash64("key", "at.i", "at.j").alias("group"), "node", "root")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, row_id, root for every row of docs(doc_id, text, ...): rows of one root are linked by near copies.

    It is run at once, in small batches. row_id is docs' own, or else a hash of the text; it tells apart rows that share a
    doc_id. Null texts and those without words are one node. An empty table gives no rows.
    """
    with settings(docs.sparkSession, {_ROWS: str(BATCH)}), scratch() as kept:
        kept.append(out := Saved(_near_copies(docs, similarity), "near-copies"))
    return out.df


def _near_copies(docs: DataFrame, similarity: float) -> DataFrame:
    docs = docs if "row_id" in docs.columns else docs.withColumn("row_id", F.xxhash64("text"))
    rows = Saved(_marked(docs), "marked").df
    nodes = Saved(rows.groupBy("node").agg(F.first("anchors").alias("anchors"), F.first("words").alias("words"), F.min(F.struct("doc_id", "row_id")).alias("at")), "nodes").df
    links = docs.sparkSession.createDataFrame([], "u long, v long")
    roots = docs.sparkSession.createDataFrame([], "node long, root long")

    def link(found: DataFrame) -> None:
        """Bring together what the pairs (u, v) link."""
        nonlocal links, roots
        found = Saved(found, "similar").df
        if not found.isEmpty():
            links = links.unionAll(found)
            roots = Saved(components(links), "roots").df

    own = nodes.select("node", F.explode(F.arrays_zip("anchors", "words")).alias("w")).select("node", F.col("w.anchors").alias("anchor"), F.col("w.words").alias("word"))
    common = own.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")  # the others meet nobody
    keyed = Saved(_keyed(own.join(common, "anchor")), "keyed").df
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = Saved(keyed.join(sizes, "key"), "shared").df
    popular = Saved(shared.groupBy("node").agg(F.sum(F.log2("n")).alias("p")), "popular").df
    shared = Saved(shared.drop("n").join(popular, "node").select("key", "node", F.struct("p", "node").alias("rank")), "ranked").df
    meeting = popular.select("node").join(nodes, "node").select("node", "at.*")
    sets = Saved(_sets(docs, meeting), "sets").df  # of nodes that share a bucket with another

    def rooted(of: DataFrame) -> DataFrame:
        """of(node, ...) with each node's root."""
        own = roots.withColumnRenamed("node", "child")
        return of.join(own, F.col("node") == F.col("child"), "left").withColumn("root", F.coalesce("root", "node")).drop("child")

    def compare(groups: DataFrame, *differ: str) -> None:
        """Bring together what is similar within each of groups(key, node, root, ...) that has several of each of these columns."""
        ends = [f(c).alias(f"{f.__name__}_{c}") for c in differ for f in (F.min, F.max)]
        open_ = groups.groupBy("key").agg(*ends).filter(" and ".join(f"min_{c} <> max_{c}" for c in differ)).select("key")
        every = Saved(groups.join(open_, "key", "left_semi").select("key", "node", "root"), "unsettled").df
        link(_within(_blocks(every).join(sets, "node"), similarity).distinct())

    centres = shared.groupBy("key").agg(F.max("rank").alias("best"))
    beside = shared.join(centres, "key").filter("best.node <> node").groupBy("node").agg(F.max("best").alias("best"))
    beside = Saved(beside.select(F.col("node").alias("u"), F.col("best.node").alias("v")), "beside").df
    link(_verified(beside, sets, similarity))
    homes = Saved(popular.join(beside, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("home")), "homes").df
    compare(Saved(rooted(homes.select(F.col("home").alias("key"), "node")), "at-home").df, "root")
    compare(Saved(shared.select("key", "node").join(rooted(homes), "node"), "in-buckets").df, "root", "home")
    return rooted(rows).select("doc_id", "row_id", "root")
