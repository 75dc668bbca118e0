"""Vector index: exact top-k cosine over unit vectors, margins, near-duplicates and ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Vectors of a block, and blocks of the index that a task multiplies with one block of many.
BLOCK, PIECES = 4096, 64


def unit(v: Column) -> Column:
    """v by its length; a zero vector stays."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def merge(*indexes: DataFrame) -> DataFrame:
    """Indexes(id, embedding, embedder) as one; refuses different embedders."""
    out = indexes[0]
    for i in indexes[1:]:
        out = out.unionByName(i)
    kinds = [r[0] for r in out.select("embedder").distinct().limit(2).collect()]
    if len(kinds) > 1:
        raise ValueError(f"the indexes are of different embedders: {kinds}")
    return out


def require_embedder(index: DataFrame, embedder: str) -> DataFrame:
    if not index.filter(F.col("embedder") != embedder).isEmpty():
        raise ValueError(f"the index isn't of embedder {embedder}")
    return index


def path_of(index: DataFrame, card_id: str) -> str | None:
    row = index.filter(F.col("id") == card_id).select("path").first()
    return row and row[0]


def build(images: DataFrame, embed: Column, out: str, embedder: str, langs: tuple[str, ...], quality: str) -> None:
    """An index for each language below out, of images(card_id, quality, status, path, ...) that are ok and of a quality.

    embed is the embedding of the image's row, null where it can't be read; such rows are skipped. The language is the
    id's first part.
    """
    own = images.filter((F.col("status") == "ok") & (F.col("quality") == quality)).select(F.col("card_id").alias("id"), "path", half(embed).alias("embedding"), F.substring_index("card_id", "/", 1).alias("lang"))
    own = own.filter(F.col("lang").isin(*langs) & F.col("embedding").isNotNull()).withColumn("embedder", F.lit(embedder))
    own.repartition("lang", "id").sortWithinPartitions("lang", "id").write.mode("overwrite").partitionBy("lang").parquet(out)


def save(index: DataFrame, embedder: str, path: str) -> None:
    """index(id, embedding) with 16-bit precision and the embedder's name, as Parquet."""
    index.select("id", half(F.col("embedding")).alias("embedding"), F.lit(embedder).alias("embedder")).write.mode("overwrite").parquet(path)


Fold = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, ...]]


def _packed(rows: DataFrame, tags: str) -> DataFrame:
    """ids, tags and matrix (bytes) of up to BLOCK of rows(id, tag, embedding) each, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                matrix = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                whole = lambda c: pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([whole(0), whole(1), pa.array([matrix.tobytes()], pa.binary())], names=["ids", "tags", "matrix"])

    return rows.select("id", "tag", "embedding").mapInArrow(run, f"ids array<bigint>, tags array<{tags}>, matrix binary")


def _against(index: DataFrame, queries: DataFrame, schema: str, fold: Fold) -> DataFrame:
    """What fold(query ids, query tags, ids, tags, scores) gives for each block of queries and block of the index, both
    (id, tag, embedding).

    Query blocks go to each share of the index's blocks, by an equi-join on the share's number. There is one share, and
    the queries are broadcast if they are small, unless they fill more than a block; nothing passes through the driver.
    """
    kinds = dict(queries.dtypes)["tag"]
    whole = lambda df: df.select(F.col("id").cast("long").alias("id"), "tag", "embedding").filter("embedding is not null")
    asked, rows = whole(queries), whole(index)
    n = asked.count()
    blocks, shares = -(-n // BLOCK) or 1, -(-rows.count() // (BLOCK * PIECES)) if n > BLOCK else 1
    q = _packed(asked.repartition(blocks), kinds).withColumnsRenamed({"ids": "q_ids", "tags": "q_tags", "matrix": "q_matrix"})
    q = q.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(max(shares, 1) - 1))))
    x = _packed(rows, dict(index.dtypes)["tag"]).withColumn("share", F.pmod(F.monotonically_increasing_id(), F.lit(max(shares, 1))).cast("int"))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_tags, q_matrix, ids, tags, matrix in zip(*(batch.column(c) for c in ("q_ids", "q_tags", "q_matrix", "ids", "tags", "matrix"))):
                own, other = np.array(q_ids.as_py()), np.array(ids.as_py())
                left, right = (np.frombuffer(m.as_py(), np.float32).reshape(k, -1).astype(np.float64) for m, k in ((q_matrix, len(own)), (matrix, len(other))))
                s = np.zeros((len(own), len(other)))
                for d in range(right.shape[1]):  # one product at a time, so that a score doesn't depend on how rows are batched
                    s += left[:, d, None] * right[:, d]
                s[~np.isfinite(s)] = -np.inf
                found = fold(own, np.array(q_tags.as_py()), other, np.array(tags.as_py()), s)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=names)

    return q.join(x, "share").select("q_ids", "q_tags", "q_matrix", "ids", "tags", "matrix").mapInArrow(run, schema)


def search(index: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False, mask: Column | None = None) -> DataFrame:
    """query_id, id, score, rank: the k best of index(id long, embedding) for each of queries(id long, embedding).

    Ties go to the smaller id. The mask keeps candidates. Each block of the index is multiplied with a block of queries
    and gives its own k best; only these are shuffled. Rows with null or non-finite scores don't count.
    """

    def best(own, _, other, __, s):
        if exclude_self:
            s[own[:, None] == other] = -np.inf
        order = np.lexsort((np.broadcast_to(other, s.shape), -s), axis=1)[:, :k]
        top = np.take_along_axis(s, order, axis=1).ravel()
        keep = np.isfinite(top)
        return np.repeat(own, order.shape[1])[keep], other[order].ravel()[keep], top[keep]

    none = F.lit(0).alias("tag")
    rows = index if mask is None else index.filter(mask)
    every = _against(rows.select("id", none, "embedding"), queries.select("id", none, "embedding"), "query_id long, id long, score double", best)
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def ranks(index: DataFrame, queries: DataFrame, exclude_self: bool = False) -> DataFrame:
    """query_id, best, better of queries(id, tag, embedding) with a row of their tag in index(id, tag, embedding): the best
    score among these, and how many rows score above it. With ids as tags, the rank of each query's own row.

    Two passes over the products; of each block only a number for each query is kept.
    """

    def own_best(own, tag, other, tags, s):
        s = np.where((tag[:, None] == tags) & ~(exclude_self & (own[:, None] == other)), s, -np.inf)
        top = s.max(axis=1)
        keep = np.isfinite(top)
        return own[keep], top[keep]

    def above(own, best, other, _, s):
        if exclude_self:
            s = np.where(own[:, None] == other, -np.inf, s)
        return own, (s > best[:, None]).sum(axis=1)

    best = _against(index, queries, "query_id long, best double", own_best).groupBy("query_id").agg(F.max("best").alias("best"))
    asked = queries.select("id", "embedding").join(best, F.col("id") == F.col("query_id")).select("id", F.col("best").alias("tag"), "embedding")
    counted = _against(index, asked, "query_id long, better long", above).groupBy("query_id").agg(F.sum("better").alias("better"))
    return best.join(counted, "query_id")


def margins(index: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, nearest, best, margin (1 - best) to the nearest other vector."""
    return search(index, queries, 1, exclude_self=True).select("query_id", F.col("id").alias("nearest"), F.col("score").alias("best"), (1 - F.col("score")).alias("margin"))


def margin_summary(m: DataFrame, near: float = 0.01) -> DataFrame:
    """One row: percentiles of the margin and the two shares of near-duplicates (margin below, or at most, near)."""
    p = F.percentile("margin", F.array(*map(F.lit, (0.01, 0.05, 0.25, 0.5))))
    out = m.agg(p.alias("p"), F.avg((F.col("margin") < near).cast("double")).alias("near_below"), F.avg((F.col("margin") <= near).cast("double")).alias("near_at_most"), F.max("margin").alias("max_margin"))
    return out.select(*(F.col("p")[i].alias(n) for i, n in enumerate(("p1", "p5", "p25", "p50"))), "near_below", "near_at_most", "max_margin")


def rank_metrics(ranks: DataFrame) -> DataFrame:
    """One row of shares and the median, of ranks(better): how many candidates score strictly above the truth."""
    share = lambda k: F.avg((F.col("better") < k).cast("double")).alias(f"top{k}")
    return ranks.agg(*map(share, (1, 4, 5, 20)), F.percentile("better", F.lit(0.5)).alias("median_rank"), F.max("better").alias("max_rank"))


def fuse(scored: DataFrame, weights: tuple[float, ...] = (0.0, 0.25, 0.5, 1.0, 2.0)) -> DataFrame:
    """weight, accuracy of the best candidate by sim + weight * band, over scored(query_id, id, sim, band, truth)."""
    grid = scored.withColumn("weight", F.explode(F.array(*map(F.lit, weights))))
    best = grid.groupBy("weight", "query_id").agg(F.max_by(F.col("id") == F.col("truth"), F.struct(F.col("sim") + F.col("weight") * F.col("band"), -F.col("id"))).alias("hit"))
    return best.groupBy("weight").agg(F.avg(F.col("hit").cast("double")).alias("accuracy"))


def half(v: Column) -> Column:
    """Vectors after storage in 16-bit floats."""
    @F.pandas_udf(ArrayType(FloatType()))
    def stored(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else np.asarray(r, np.float16).astype(np.float32))

    return stored(v)
