"""Connected components: union-find within partitions, then alternating large and small stars across them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, per_batch

_ROWS = 1 << 17


def contracted(links: DataFrame) -> DataFrame:
    """Fewer links (u, v), u > v, with the same components: a star for each component of some rows of a partition."""

    def make():
        def step(batch: pa.RecordBatch):
            us, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(us), _ROWS):
                parent: dict[int, int] = {}

                def top(x: int, parent=parent) -> int:
                    while (up := parent.setdefault(x, x)) != x:
                        parent[x] = x = parent[up]
                    return x

                for u, v in zip(us[i : i + _ROWS], vs[i : i + _ROWS]):
                    a, b = top(u), top(v)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                pairs = [(x, top(x)) for x in list(parent)]
                pairs = [p for p in pairs if p[0] != p[1]]
                yield {"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())}

        return step

    return per_batch(links.select("u", "v"), "u long, v long", make)


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def _is_stars(e: DataFrame) -> bool:
    """No node is both a child and a root, and each child has one root."""
    roles = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("root")))
    by_node = roles.groupBy("node").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max(F.col("root").isNull()).alias("is_root"))
    return by_node.filter("a <> b or (a is not null and is_root)").isEmpty()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links(u, v) that isn't its component's least node; root is that least node.

    Each round is two aggregations and two joins on the node; a node with very many neighbours is pre-aggregated
    before the shuffle and split by the skew join after it. Rounds halve paths at least, and the links between rounds
    are contracted within partitions and written to the shared folder. Links of a node with itself don't count, and
    no links give no rows.
    """
    now = Saved(contracted(links.filter("u <> v")), "links")
    for _ in range(max_rounds):
        nxt = Saved(contracted(now.df), "links")
        now.drop()
        now = nxt
        if _is_stars(now.df):
            return now.df.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        nxt = Saved(_small_star(_large_star(now.df)), "links")
        now.drop()
        now = nxt
    raise RuntimeError(f"components: no fixed point within {max_rounds} rounds")
