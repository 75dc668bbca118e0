"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed is a fixed mask over a window of words: the words under its ones are hashed, those beside may be anything. The
hashes of all windows of the benchmark meet those of all windows of the documents. A hit fixes an item, a document and
an offset between them; there the two are laid side by side, and some run of words around must agree in enough places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed masks: 1 is compared, 0 ignored. They leave no allowed substitution uncovered in runs of 11 to 13 words.
MASKS = ("11111", "110101001", "1010010011", "11001000101")
#: Items of fewer words have seeds of their own: with k substitutions allowed, one of k + 1 parts of the run is intact.
SHORT = 11
#: An overlap is a run of so many aligned words (the whole item if it is shorter) of which this share agrees.
OVERLAP, SHARE = 13, 0.8
#: Seeds that may be broadcast, and the bytes of the items' words that go with them; more go through a shuffle.
MOST_BROADCAST, MOST_BYTES = 50_000, 32 << 20
_WORD = r"[\p{L}\p{N}]+"


def words(text: str = "text") -> Column:
    """Lower-cased runs of letters and digits; null counts as empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(_WORD), F.lit(0))


def _seeded(df: DataFrame, masks: Sequence[str], parts: Sequence[int] = ()) -> DataFrame:
    """df's columns, and a row for each position of w and each mask or part's length that fits there: pos and hash."""

    def seed(k: int, mask: str) -> Column:
        picked = [F.get("w", F.col("pos") + i) for i, c in enumerate(mask) if c == "1"]
        return F.when(F.size("w") >= F.col("pos") + len(mask), F.xxhash64(F.lit(k), *picked))

    at = df.select("*", F.posexplode("w").alias("pos", "word")).drop("word")
    every = [*enumerate(masks), *((-n, "1" * n) for n in parts)]
    return at.select("*", F.explode(F.array(*(seed(k, m) for k, m in every))).alias("hash")).filter("hash is not null")


def parts_of(n: int, overlap: int, share: float) -> list[tuple[int, int]]:
    """Start and length of the parts of an item of n words, for each of its runs."""
    run = min(overlap, n)
    spare = max((k for k in range(run) if run - k >= share * run), default=0)
    cuts = [run * i // (spare + 1) for i in range(spare + 2)]
    return sorted({(at + a, b - a) for at in range(n - run + 1) for a, b in zip(cuts, cuts[1:])})


def _short_seeds(items: DataFrame, sizes: Sequence[int], overlap: int, share: float) -> DataFrame:
    """item_id, w, pos and hash of the parts of items of so many words."""
    part = lambda n, pos, k: F.when(F.size("w") == n, F.struct(F.lit(pos).alias("pos"), F.xxhash64(F.lit(-k), *(F.get("w", F.lit(pos + i)) for i in range(k))).alias("hash")))
    every = [part(n, pos, k) for n in sizes for pos, k in parts_of(n, overlap, share)]
    return items.select("item_id", "w", F.explode(F.array(*every)).alias("s")).filter("s is not null").select("item_id", "w", "s.pos", "s.hash")


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: Sequence[str] = MASKS, overlap: int = OVERLAP, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_equal, n_run for each document and benchmark item that overlap; other columns are not read.

    Of all runs of ``overlap`` aligned words (the whole item if it is shorter) at offsets that a seed has hit, n_equal
    is the most that agree, n_run the run's length; pairs with n_equal >= share * n_run are given, once each. Null or
    empty texts, null ids and empty tables give no rows; repeated rows of a document or item are one.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words().alias("w")).filter("item_id is not null").distinct()
    sizes = sorted(r.n for r in items.select(F.size("w").alias("n")).filter(F.col("n").between(1, SHORT - 1)).distinct().collect())
    parts = sorted({k for n in sizes for _, k in parts_of(n, overlap, share)})
    seeds = _seeded(items, masks).select("item_id", "w", "pos", "hash")
    if sizes:
        seeds = seeds.unionByName(_short_seeds(items, sizes, overlap, share))
    seeds = seeds.select("hash", "item_id", F.col("pos").alias("item_pos"), F.col("w").alias("iw"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words().alias("w")).filter("doc_id is not null")
    shift = F.col("pos") - F.col("item_pos")
    number, size = seeds.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.array_join("iw", " "))), F.lit(0))).first()
    if number <= MOST_BROADCAST and size <= MOST_BYTES:
        hits = _seeded(texts, masks, parts).join(F.broadcast(seeds), "hash").withColumn("shift", shift)
    else:  # only numbers are shuffled by hash; the words come back for what was hit
        met = _seeded(texts, masks, parts).select("doc_id", "pos", "hash").join(seeds.select("hash", "item_id", "item_pos"), "hash")
        met = met.select("doc_id", "item_id", shift.alias("shift")).distinct()
        hits = met.join(items.withColumnRenamed("w", "iw"), "item_id").join(texts, "doc_id")
    start, end = F.greatest("shift", F.lit(0)), F.least(F.size("w"), F.col("shift") + F.size("iw"))
    hits = hits.withColumns({"start": start, "n": end - start})
    run = F.least(F.lit(overlap), F.size("iw"))
    laid = hits.select("doc_id", "item_id", "shift", F.xxhash64("w").alias("text_id"), run.alias("run"), F.slice("w", F.col("start") + 1, F.col("n")).alias("a"), F.slice("iw", F.col("start") - F.col("shift") + 1, F.col("n")).alias("b"))
    # As aggregates a and b stop the later filters from sinking into the join, where each window would evaluate them.
    laid = laid.groupBy("doc_id", "item_id", "shift", "text_id", "run").agg(F.min("a").alias("a"), F.min("b").alias("b"))
    laid = laid.filter(F.size("a") >= F.col("run")).withColumn("same", F.zip_with("a", "b", lambda x, y: F.when(x == y, 1).otherwise(0)))
    sums = F.transform(F.sequence(F.lit(1), F.size("same") - F.col("run") + 1), lambda i: F.aggregate(F.slice("same", i, F.col("run")), F.lit(0), lambda s, x: s + x))
    best = laid.select("doc_id", "item_id", "run", F.array_max(sums).alias("n_equal")).filter(F.col("n_equal") >= share * F.col("run"))
    return best.groupBy("doc_id", "item_id").agg(F.max("n_equal").alias("n_equal"), F.max("run").alias("n_run"))


def oracle_sql(masks: Sequence[str] = MASKS, overlap: int = OVERLAP, share: float = SHARE) -> str:
    """The same pairs in DuckDB SQL for items of SHORT words or more; seeds are compared as words."""
    seed = lambda k, m: f"CASE WHEN len(w) >= pos + {len(m) - 1} THEN '{k} ' || " + " || ' ' || ".join(f"w[pos + {i}]" for i, c in enumerate(m) if c == "1") + " END"
    seeds = ", ".join(seed(k, m) for k, m in enumerate(masks))
    return f"""
WITH items AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM benchmark),
texts AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM documents),
ip AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS pos FROM items),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM texts),
iseed AS (SELECT item_id, pos, unnest([{seeds}]) AS seed FROM ip),
dseed AS (SELECT doc_id, pos, unnest([{seeds}]) AS seed FROM dp),
hit AS (SELECT DISTINCT doc_id, item_id, d.pos - i.pos AS shift FROM dseed d JOIN iseed i USING (seed)),
laid AS (
  SELECT doc_id, item_id, least({overlap}, len(i.w)) AS run, greatest(shift, 0) AS s, least(len(t.w), shift + len(i.w)) AS e, shift, i.w AS iw, t.w AS tw
  FROM hit JOIN items i USING (item_id) JOIN texts t USING (doc_id)),
same AS (SELECT doc_id, item_id, run, [CASE WHEN tw[p] = iw[p - shift] THEN 1 ELSE 0 END FOR p IN range(s + 1, e + 1)] AS same FROM laid WHERE e - s >= run),
best AS (SELECT doc_id, item_id, run, list_max([list_sum(same[i:i + run - 1]) FOR i IN range(1, len(same) - run + 2)]) AS k FROM same)
SELECT doc_id, item_id, CAST(max(k) AS INTEGER) AS n_equal, CAST(max(run) AS INTEGER) AS n_run FROM best WHERE k >= {share} * run GROUP BY ALL"""
