"""Queries of vectors, evidence and its evaluation: each hundredth vector is a pocket, its neighbours are candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, fusion, ingest, vectors
from .base import query
from .roles import table

def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


_DOT = "list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(x.embedding[i] AS DOUBLE)))"


def _scored(k: int) -> str:
    return f"""s AS (SELECT q.vec_id AS query_id, x.vec_id AS id, {_DOT} AS score FROM embeddings q JOIN embeddings x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= {k})"""


def _asked(index: DataFrame) -> DataFrame:
    return index.filter("id % 100 = 0")


@query(f"WITH {_scored(10)} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r")
def q_topk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return vectors.search(index, _asked(index), 10, exclude_self=True).withColumn("score", F.round("score", 6))


@query(f"""WITH {_scored(1)}, m AS (SELECT 1 - score AS margin FROM r)
SELECT round(quantile_cont(margin, 0.01), 6) AS p1, round(quantile_cont(margin, 0.05), 6) AS p5, round(quantile_cont(margin, 0.25), 6) AS p25, round(quantile_cont(margin, 0.5), 6) AS p50,
  avg(CASE WHEN margin < 0.01 THEN 1.0 ELSE 0.0 END) AS near_below, avg(CASE WHEN margin <= 0.01 THEN 1.0 ELSE 0.0 END) AS near_at_most, round(max(margin), 6) AS max_margin FROM m""")
def q_nn_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    out = vectors.margin_summary(vectors.margins(index, _asked(index)))
    return out.select(*(F.round(c, 6).alias(c) if c[0] in "pm" else c for c in out.columns))


@query(f"""WITH x AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda v, i: CASE WHEN i % 2 = 0 THEN v ELSE CAST(v * 0.9995 AS FLOAT) END) FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id AS id, {_DOT} AS score FROM embeddings q JOIN x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, id AS nearest FROM s WHERE 1 - score <= 0.01 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1""")
def q_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector is there again, a little changed."""
    index = _index(spark, sf_dir).select("id", "embedding")
    again = index.filter("id % 50 = 0").select(F.col("id") + 1_000_000, F.transform("embedding", lambda v, i: F.when(i % 2 == 1, v).otherwise((v * 0.9995).cast("float"))))
    return vectors.margins(index.unionAll(again), _asked(index)).filter("margin <= 0.01").select("query_id", "nearest")


@query(f"""WITH {_scored(1000000)}, t AS (SELECT r.query_id, r.score, x.label = q.label AS same FROM r JOIN embeddings x ON r.id = x.vec_id JOIN embeddings q ON r.query_id = q.vec_id),
b AS (SELECT query_id, max(score) FILTER (WHERE same) AS best FROM t GROUP BY 1),
n AS (SELECT b.query_id, count(*) FILTER (WHERE t.score > b.best) AS better FROM t JOIN b USING (query_id) WHERE best IS NOT NULL GROUP BY 1)
SELECT avg(CASE WHEN better < 1 THEN 1.0 ELSE 0.0 END) AS top1, avg(CASE WHEN better < 4 THEN 1.0 ELSE 0.0 END) AS top4, avg(CASE WHEN better < 5 THEN 1.0 ELSE 0.0 END) AS top5,
  avg(CASE WHEN better < 20 THEN 1.0 ELSE 0.0 END) AS top20, median(better) AS median_rank, max(better) AS max_rank FROM n""")
def q_rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many neighbours score above the best one of the query's own label."""
    index = _index(spark, sf_dir).withColumnRenamed("label", "tag")
    return vectors.rank_metrics(vectors.ranks(index, _asked(index), exclude_self=True))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbours of each query vector as candidates of a pocket; the label names one of three sets, nine pockets make a page."""
    index = _index(spark, sf_dir)
    found = vectors.search(index, _asked(index), 10, exclude_self=True).join(index.select("id", "label"), "id")
    slot = F.floor(F.col("query_id") / 100)
    return found.select(
        F.floor(slot / 9).alias("page"), (slot % 9).alias("pocket"), F.col("id").alias("card_id"), (F.col("label") % 3).alias("set_id"), (F.col("id") % 60).alias("number"),
        F.round("score", 6).alias("visual"), (F.col("id") % 7 == 0).alias("number_hit"), (F.col("id") % 11 == 0).alias("total_hit"), (F.col("id") % 90).cast("int").alias("orb"),
    )


_FUSED = f"""{_scored(10)},
c AS (SELECT (query_id // 100) // 9 AS page, (query_id // 100) % 9 AS pocket, id AS card_id, label % 3 AS set_id, id % 60 AS number, round(score, 6) AS visual,
  14 * round(score, 6) + CASE WHEN id % 7 = 0 THEN 3 ELSE 0 END + CASE WHEN id % 11 = 0 THEN 1.5 ELSE 0 END + 0.08 * least(id % 90, 50) AS score FROM r JOIN embeddings ON id = vec_id),
e AS (SELECT *, exp(score - max(score) OVER w) AS x, row_number() OVER (PARTITION BY page, pocket ORDER BY round(score, 9) DESC, card_id) AS rank FROM c WINDOW w AS (PARTITION BY page, pocket)),
p AS (SELECT *, x / sum(x) OVER (PARTITION BY page, pocket) AS probability FROM e)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.with_probability(_candidates(spark, sf_dir).withColumn("score", F.round(fusion.raw_score(F.lit(0), F.lit(0)), 9)))


@query(f"WITH {_FUSED} SELECT CAST(page AS BIGINT) AS page, CAST(pocket AS BIGINT) AS pocket, card_id, round(probability, 6) AS probability, CAST(rank AS INTEGER) AS rank FROM p")
def q_softmax_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("page", "pocket", "card_id", F.round("probability", 6).alias("probability"), "rank")


@query(f"""WITH {_FUSED} SELECT CAST(page AS BIGINT) AS page, CAST(pocket AS BIGINT) AS pocket, card_id, CASE WHEN probability >= 0.9 AND visual >= 0.55 THEN 'confirmed' ELSE 'review' END AS status,
  CASE WHEN visual < 0.55 THEN 'low_visual_match' ELSE '' END AS flags FROM p WHERE rank = 1""")
def q_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.decide(_fused(spark, sf_dir)).select("page", "pocket", "card_id", "status", F.array_join("flags", ",").alias("flags"))


@query(f"""WITH {_FUSED}, v AS (SELECT page, set_id, count(*) AS n, min(pocket) AS seen FROM p WHERE rank = 1 AND probability >= 0.1 GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY page) AS every, row_number() OVER (PARTITION BY page ORDER BY n DESC, seen) AS nth FROM v)
SELECT CAST(page AS BIGINT) AS page, set_id AS dominant FROM w WHERE nth = 1 AND n >= 2 AND n * 2 >= every""")
def q_dominant_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.dominant_set(_fused(spark, sf_dir).filter("rank = 1"), 0.1)


@query(f"""WITH {_FUSED}, v AS (SELECT page, number - pocket AS base, count(*) AS n, min(pocket) AS seen FROM p WHERE rank = 1 AND probability >= 0.1 GROUP BY ALL)
SELECT CAST(page AS BIGINT) AS page, CAST(base AS BIGINT) AS base FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, seen) AS nth FROM v) WHERE nth = 1""")
def q_sequence_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.page_base(_fused(spark, sf_dir).filter("rank = 1"), F.col("pocket"), 0.1)


@query("""WITH o AS (SELECT quality = 1 AS correct, (doc_id % 100) / 100.0 AS probability FROM labels), t AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]) AS threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (WHERE probability >= threshold) AS auto, avg(CASE WHEN probability >= threshold THEN CASE WHEN correct THEN 1.0 ELSE 0.0 END END) AS precision,
  avg(CASE WHEN probability >= threshold THEN 1.0 ELSE 0.0 END) AS coverage FROM o CROSS JOIN t GROUP BY 1""")
def q_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.threshold_sweep(table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("correct"), (F.col("doc_id") % 100 / F.lit(100.0)).alias("probability")))


@query(f"""WITH {_scored(1000000)}, o AS (SELECT vec_id AS id, CASE WHEN vec_id % 200 = 0 THEN (vec_id + 1) % (SELECT count(*) FROM embeddings) ELSE vec_id END AS own FROM embeddings WHERE vec_id % 100 = 0),
s2 AS (SELECT o.id AS query_id, x.vec_id AS id, {_DOT.replace("q.embedding", "q.embedding")} AS score, x.vec_id = o.own AS mine FROM o JOIN embeddings q ON q.vec_id = o.id CROSS JOIN embeddings x),
b AS (SELECT query_id, max(score) FILTER (WHERE mine) AS best FROM s2 GROUP BY 1)
SELECT query_id, round(best, 6) AS best, count(*) FILTER (WHERE score > best) AS better FROM s2 JOIN b USING (query_id) GROUP BY ALL""")
def q_own_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors lie nearer to a query than the one it stands for: itself, or its successor for every other one."""
    index = _index(spark, sf_dir)
    n = index.count()
    own = F.when(F.col("id") % 200 == 0, (F.col("id") + 1) % n).otherwise(F.col("id"))
    found = vectors.ranks(index.select("id", F.col("id").alias("tag"), "embedding"), _asked(index).select("id", own.alias("tag"), "embedding"))
    return found.withColumn("best", F.round("best", 6))


_PASSES = f"""{_FUSED},
top AS (SELECT * FROM p WHERE rank = 1 AND probability >= 0.9),
dv AS (SELECT page, set_id, count(*) AS n, min(pocket) AS seen FROM top GROUP BY ALL),
dom AS (SELECT page, set_id AS dominant FROM (SELECT *, sum(n) OVER (PARTITION BY page) AS every, row_number() OVER (PARTITION BY page ORDER BY n DESC, seen) AS nth FROM dv) WHERE nth = 1 AND n >= 2 AND n * 2 >= every),
bv AS (SELECT page, number - pocket AS base, count(*) AS n, min(pocket) AS seen FROM top GROUP BY ALL),
base AS (SELECT page, base FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, seen) AS nth FROM bv) WHERE nth = 1),
c2 AS (SELECT c.* EXCLUDE (score), base, c.score + CASE WHEN set_id = dominant THEN 2.0 ELSE 0 END + CASE WHEN number = base + pocket THEN 3.5 ELSE 0 END AS score FROM c LEFT JOIN dom USING (page) LEFT JOIN base USING (page)),
e2 AS (SELECT *, exp(score - max(score) OVER w) AS x, row_number() OVER (PARTITION BY page, pocket ORDER BY round(score, 9) DESC, card_id) AS rank FROM c2 WINDOW w AS (PARTITION BY page, pocket)),
p2 AS (SELECT *, x / sum(x) OVER (PARTITION BY page, pocket) AS probability FROM e2)"""


@query(f"""WITH {_PASSES} SELECT CAST(page AS BIGINT) AS page, CAST(pocket AS BIGINT) AS pocket, card_id, round(probability, 6) AS probability, CASE WHEN probability >= 0.9 AND visual >= 0.55 THEN 'confirmed' ELSE 'review' END AS status,
  concat_ws(',', CASE WHEN visual < 0.55 THEN 'low_visual_match' END, CASE WHEN base IS NOT NULL AND number <> base + pocket THEN 'out_of_order' END) AS flags FROM p2 WHERE rank = 1""")
def q_recognise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passes: scores, the page's set and sequence, rescored and decided."""
    out = fusion.decide(fusion.passes(_candidates(spark, sf_dir), F.col("pocket")), F.col("pocket"))
    return out.select("page", "pocket", "card_id", F.round("probability", 6).alias("probability"), "status", F.array_join("flags", ",").alias("flags"))


_CARDS = "cards AS (SELECT vec_id AS card_id, label % 3 AS set_id, vec_id % 60 AS number, 40 + label AS printed_total FROM embeddings)"
_READ = "(vec_id // 100) // 9 AS page, (vec_id // 100) % 9 AS pocket"


@query(f"""WITH {_scored(4)}, {_CARDS}, q AS (SELECT *, {_READ} FROM embeddings WHERE vec_id % 100 = 0),
reads AS (SELECT page, pocket, vec_id % 60 AS number, 40 + label AS total FROM q WHERE vec_id % 300 <> 0),
near AS (SELECT page, pocket, id AS card_id, round(score, 6) AS visual FROM r JOIN q ON query_id = vec_id),
more AS (SELECT page, pocket, card_id FROM cards JOIN reads ON cards.number = reads.number AND printed_total = total EXCEPT SELECT page, pocket, card_id FROM near),
extra AS (SELECT m.page, m.pocket, m.card_id, round({_DOT}, 6) AS visual FROM more m JOIN q USING (page, pocket) JOIN embeddings x ON x.vec_id = m.card_id),
every AS (SELECT * FROM near UNION ALL SELECT * FROM extra)
SELECT CAST(page AS BIGINT) AS page, CAST(pocket AS BIGINT) AS pocket, card_id, visual, coalesce(c.number = reads.number, false) AS number_hit, coalesce(printed_total = total, false) AS total_hit FROM every JOIN cards c USING (card_id) LEFT JOIN reads USING (page, pocket)""")
def q_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours, and cards with the number and total that was read in the pocket; every third pocket has none."""
    index = _index(spark, sf_dir)
    slot = F.floor(F.col("id") / 100)
    queries = _asked(index).select(F.floor(slot / 9).alias("page"), (slot % 9).alias("pocket"), "id", "label", "embedding")
    near = vectors.search(index, _asked(index), 4, exclude_self=True).select(F.col("query_id").alias("q"), F.col("id").alias("card_id"), F.col("score").alias("visual")).join(queries, F.col("q") == F.col("id"))
    reads = queries.filter("id % 300 <> 0").select("page", "pocket", (F.col("id") % 60).alias("number"), (F.col("label") + 40).alias("total"))
    cards = index.select(F.col("id").alias("card_id"), (F.col("label") % 3).alias("set_id"), (F.col("id") % 60).alias("number"), (F.col("label") + 40).alias("printed_total"))
    found = fusion.candidates(near, reads, cards, index.withColumnRenamed("id", "card_id"), queries)
    return found.select("page", "pocket", "card_id", F.round("visual", 6).alias("visual"), "number_hit", "total_hit")


@query("""WITH li AS (SELECT l_orderkey AS page, l_linenumber AS pocket, l_partkey, l_quantity FROM lineitem),
cards AS (SELECT p_partkey AS card_id, p_brand AS set_id, p_size AS number, CASE WHEN p_partkey % 5 = 0 THEN 'TG' ELSE '' END AS prefix FROM part),
main AS (SELECT set_id, prefix FROM (SELECT set_id, prefix, row_number() OVER (PARTITION BY set_id ORDER BY count(*) DESC, min(card_id)) AS nth FROM cards GROUP BY set_id, prefix) WHERE nth = 1),
own AS (SELECT set_id, number, min(card_id) AS card_id FROM cards JOIN main USING (set_id, prefix) GROUP BY ALL)
SELECT page, pocket, card_id FROM (SELECT DISTINCT page, pocket, 'Brand#' || (page % 25 + 1) AS set_id, page % 30 + pocket AS number FROM li WHERE l_quantity < 10) JOIN own USING (set_id, number)""")
def q_wish_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are pages of a set, small line items empty pockets; the page begins at a number of its own."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("pocket"), "l_quantity")
    empty = li.filter("l_quantity < 10").select("page", "pocket", F.concat(F.lit("Brand#"), (F.col("page") % 25 + 1).cast("string")).alias("set_id")).distinct()
    base = li.select("page", (F.col("page") % 30).alias("base")).distinct()
    part = table(spark, sf_dir, "part")
    cards = part.select(F.col("p_partkey").alias("card_id"), F.col("p_brand").alias("set_id"), F.col("p_size").alias("number"), F.when(F.col("p_partkey") % 5 == 0, "TG").otherwise("").alias("number_prefix"))
    return fusion.wish_additions(empty, base, cards, F.col("pocket"))


@query("""SELECT o_orderkey AS page, CASE WHEN o_orderkey % 2 = 0 THEN 1 + o_orderkey % 7 * 9 ELSE o_orderkey % 11 END AS base FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def q_set_page_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even orders are pages whose place in the binder is known; some of the others have a base by vote."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"))
    pages = o.select("page", F.lit(1).cast("long").alias("start_number"), F.when(F.col("page") % 2 == 0, F.col("page") % 7).alias("page_index"), F.lit(9).cast("long").alias("pockets"))
    return fusion.set_page_base(pages, o.filter("page % 3 = 0").select("page", (F.col("page") % 11).alias("base")))


# Evaluation

_SEEN = """li AS (SELECT l_orderkey AS photo, l_linenumber AS pocket, min(l_partkey) AS k FROM lineitem GROUP BY ALL),
ranked AS (SELECT photo, pocket, n AS rank, CASE WHEN (k + n) % 3 = 0 THEN 'c' || k ELSE 'x' || (k + n) END AS card_id, (k % 100) / 100.0 / n AS probability, 'review' AS status FROM li CROSS JOIN (VALUES (1), (2), (5)) v(n) WHERE k % 13 <> 0),
labels AS (SELECT photo, pocket, CASE WHEN k % 10 = 0 THEN NULL WHEN k % 17 = 0 THEN '?' ELSE 'c' || k END AS truth FROM li),
found AS (SELECT l.photo, l.pocket, truth, b.card_id AS top, coalesce(b.probability, 0) AS probability, EXISTS (SELECT 1 FROM ranked r WHERE r.photo = l.photo AND r.pocket = l.pocket AND r.rank <= 4 AND r.card_id = truth) AS in_top_k,
  CASE WHEN k % 13 = 0 THEN 'empty' ELSE 'card' END AS state FROM labels l JOIN li USING (photo, pocket) LEFT JOIN ranked b ON b.photo = l.photo AND b.pocket = l.pocket AND b.rank = 1 WHERE k % 23 <> 0)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items are pockets: what is in them, what was found there, and what a third side has not."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("photo"), F.col("l_linenumber").alias("pocket")).agg(F.min("l_partkey").alias("k"))
    k, n = F.col("k"), F.col("rank")
    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    labels = li.select("photo", "pocket", F.when(k % 10 == 0, None).when(k % 17 == 0, "?").otherwise(name("c", k)).alias("truth"))
    ranked = li.filter(k % 13 != 0).withColumn("rank", F.explode(F.array(F.lit(1), F.lit(2), F.lit(5)))).select("photo", "pocket", "rank", F.when((k + n) % 3 == 0, name("c", k)).otherwise(name("x", k + n)).alias("card_id"), (k % 100 / 100.0 / n).alias("probability"), F.lit("review").alias("status"))
    results = li.filter(k % 23 != 0).select("photo", "pocket", F.when(k % 13 == 0, "empty").otherwise("card").alias("state"))
    return evaluate.outcomes(labels, results, ranked)


@query(f"WITH {_SEEN} SELECT photo, pocket, truth, top, round(probability, 6) AS probability, in_top_k, state FROM found")
def q_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select("photo", "pocket", "truth", "top", F.round("probability", 6).alias("probability"), "in_top_k", "state")


@query(f"""WITH {_SEEN} SELECT avg(CASE WHEN truth <> '?' THEN CASE WHEN top = truth THEN 1.0 ELSE 0.0 END END) AS top1, avg(CASE WHEN truth <> '?' THEN CASE WHEN in_top_k THEN 1.0 ELSE 0.0 END END) AS topk,
  avg(CASE WHEN truth IS NULL THEN CASE WHEN state = 'empty' THEN 1.0 ELSE 0.0 END END) AS empty_accuracy, count(*) FILTER (WHERE truth IS NOT NULL AND truth <> '?' AND state = 'empty') AS false_empty FROM found""")
def q_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(_outcomes(spark, sf_dir))


@query(f"""WITH {_SEEN}, s AS (SELECT t, avg(CASE WHEN probability >= t THEN CASE WHEN top = truth THEN 1.0 ELSE 0.0 END END) AS precision FROM found CROSS JOIN (VALUES (0.1), (0.3), (0.5), (0.9)) v(t) WHERE truth IS NOT NULL GROUP BY 1)
SELECT CAST(min(t) FILTER (WHERE precision >= 0.3) AS DOUBLE) AS threshold FROM s""")
def q_recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recommended(evaluate.threshold_sweep(evaluate.confirmable(_outcomes(spark, sf_dir)), (0.1, 0.3, 0.5, 0.9)), 0.3)


@query("""WITH p AS (SELECT l_orderkey, list(DISTINCT l_partkey) FILTER (WHERE l_quantity > 10) AS expected, list(DISTINCT l_partkey) FILTER (WHERE l_linenumber % 3 <> 0) AS found FROM lineitem GROUP BY 1)
SELECT sum(len(list_intersect(coalesce(expected, []), coalesce(found, [])))) / sum(len(coalesce(expected, []))) AS recall, CAST(sum(len(list_filter(coalesce(found, []), lambda x: NOT list_contains(coalesce(expected, []), x)))) AS BIGINT) AS spurious FROM p""")
def q_list_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda c: F.collect_set(F.when(c, F.col("l_partkey")))
    return evaluate.list_recall(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(some(F.col("l_quantity") > 10).alias("expected"), some(F.col("l_linenumber") % 3 != 0).alias("found")))


_TRIALS = "t AS (SELECT event_id % 3 = 0 AS a, event_id % 5 = 0 AS b, value > 20 AS c FROM events)"


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("event_id") % 3 == 0).alias("a"), (F.col("event_id") % 5 == 0).alias("b"), (F.col("value") > 20).alias("c"))


@query(f"""WITH {_TRIALS}, n AS (SELECT avg(a::INT) AS a, avg(b::INT) AS b, avg(c::INT) AS c, avg((a OR b OR c)::INT) AS abc, avg((a OR b)::INT) AS ab, avg((a OR c)::INT) AS ac, avg((b OR c)::INT) AS bc FROM t)
SELECT 'a' AS attempt, a AS alone, abc - bc AS lost FROM n UNION ALL SELECT 'b', b, abc - ac FROM n UNION ALL SELECT 'c', c, abc - ab FROM n""")
def q_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.leave_one_out(_trials(spark, sf_dir), ["a", "b", "c"])


@query(f"""WITH {_TRIALS}, n AS (SELECT avg(a::INT) AS a, avg(b::INT) AS b, avg(c::INT) AS c, avg((a OR b)::INT) AS ab, avg((a OR c)::INT) AS ac, avg((b OR c)::INT) AS bc FROM t)
SELECT unnest(['a', 'b', 'c', 'a+b', 'a+c', 'b+c']) AS subset, unnest([1, 1, 1, 2, 2, 2]) AS size, unnest([a, b, c, ab, ac, bc]) AS accuracy FROM n""")
def q_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.subsets(_trials(spark, sf_dir), ["a", "b", "c"], 2)


@query("""WITH r AS (SELECT l_orderkey AS key, l_linenumber AS attempt, CASE WHEN l_quantity > 5 THEN l_partkey % 3 END AS number, CASE WHEN l_tax > 0.02 THEN l_suppkey % 2 END AS total FROM lineitem),
one AS (SELECT key, attempt, min(number) AS number, min(total) AS total FROM r GROUP BY ALL),
twice AS (SELECT *, row_number() OVER (PARTITION BY key, number, total ORDER BY attempt) AS nth FROM one),
stop AS (SELECT key, min(attempt) AS stop FROM twice WHERE nth = 2 GROUP BY 1),
used AS (SELECT one.* FROM one LEFT JOIN stop USING (key) WHERE attempt <= coalesce(stop, attempt)),
num AS (SELECT key, number, n AS votes FROM (SELECT key, number, count(*) AS n, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, min(attempt)) AS nth FROM used WHERE number IS NOT NULL GROUP BY key, number) WHERE nth = 1),
tot AS (SELECT key, total FROM (SELECT key, total, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, min(attempt)) AS nth FROM used JOIN num USING (key, number) WHERE total IS NOT NULL GROUP BY key, total) WHERE nth = 1)
SELECT key, number, total, votes FROM num LEFT JOIN tot USING (key)""")
def q_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items are attempts at reading an order's number and total."""
    li = table(spark, sf_dir, "lineitem")
    reads = li.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("attempt"), F.when(F.col("l_quantity") > 5, F.col("l_partkey") % 3).alias("number"), F.when(F.col("l_tax") > 0.02, F.col("l_suppkey") % 2).alias("total"))
    return evaluate.vote(reads.groupBy("key", "attempt").agg(F.min("number").alias("number"), F.min("total").alias("total")))


@query("""SELECT p_partkey AS part_id, 1.96 * sqrt(p * (1 - p) / n) AS half_width FROM (SELECT p_partkey, (p_partkey % 100) / 100.0 AS p, p_size AS n FROM part)""")
def q_half_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), evaluate.half_width(F.col("p_partkey") % 100 / 100.0, F.col("p_size")).alias("half_width"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3 * x * 3))), 4) AS size, CAST(1 AS DOUBLE) AS unit_size FROM embeddings""")
def q_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors three times as long, brought back to unit length."""
    long = F.transform("embedding", lambda x: x.cast("double") * 3)
    u = vectors.unit(F.col("v"))
    out = table(spark, sf_dir, "embeddings").select("vec_id", long.alias("v"))
    return out.select("vec_id", F.round(F.sqrt(vectors.dot(F.col("v"), F.col("v"))), 4).alias("size"), F.round(F.sqrt(vectors.dot(u, u)), 6).alias("unit_size"))


@query("""WITH g AS (SELECT vec_id, label, w, (vec_id % 7) / 128.0 + CAST(w AS DOUBLE) * (vec_id % 11) / 256.0 AS s FROM embeddings CROSS JOIN (VALUES (0.0), (0.5), (2.0)) t(w)),
b AS (SELECT *, row_number() OVER (PARTITION BY w, label ORDER BY s DESC, vec_id) AS nth FROM g)
SELECT CAST(w AS DOUBLE) AS weight, avg(CASE WHEN vec_id % 4 = label % 4 THEN 1.0 ELSE 0.0 END) AS accuracy FROM b WHERE nth = 1 GROUP BY 1""")
def q_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are queries; a vector is right if its number leaves the label's remainder."""
    e = table(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    scored = e.select(F.col("label").alias("query_id"), k.alias("id"), (k % 7 / 128.0).alias("sim"), (k % 11 / 256.0).alias("band"), F.when(k % 4 == F.col("label") % 4, k).otherwise(-1).alias("truth"))
    return vectors.fuse(scored, (0.0, 0.5, 2.0))


@query("""WITH t AS (SELECT event_id, event_id % 4 AS m, event_id % 900 AS n, event_id % 150 + 50 AS total FROM events)
SELECT event_id, CASE m WHEN 3 THEN NULL WHEN 1 THEN 'TG' ELSE '' END AS prefix, CASE WHEN m <> 3 THEN CAST(n AS INTEGER) END AS number, CASE WHEN m <> 3 THEN CAST(total AS INTEGER) END AS total FROM t""")
def q_ocr_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as an OCR reads them: letters for zeros, bars for slashes, and nothing to be found in every fourth."""
    k = F.col("event_id")
    n, total = (k % 900).cast("string"), (k % 150 + 50).cast("string")
    text = F.when(k % 4 == 0, F.concat(F.translate(n, "0", "O"), F.lit("/"), total)).when(k % 4 == 1, F.concat(F.lit("tg "), n, F.lit(" | "), F.translate(total, "0", "o"))).when(k % 4 == 2, F.concat(n, F.lit(" / "), total, F.lit(" x"))).otherwise("nothing")
    return table(spark, sf_dir, "events").select("event_id", T.ocr_number(text).alias("r")).select("event_id", "r.*")


@query("""WITH c AS (SELECT p_partkey AS card_id, p_brand AS set_id, p_size AS n FROM part), i AS (SELECT card_id, set_id FROM c WHERE card_id % 3 = 0)
SELECT card_id, set_id FROM i WHERE set_id IN (SELECT set_id FROM i GROUP BY 1 HAVING count(*) >= 12)""")
def q_image_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with an image, of sets that have twelve such cards at least."""
    part = table(spark, sf_dir, "part")
    cards = part.select(F.col("p_partkey").alias("card_id"), F.col("p_brand").alias("set_id"))
    manifest = part.select(F.col("p_partkey").alias("card_id"), F.when(F.col("p_partkey") % 3 == 0, "ok").otherwise("error").alias("status"), F.lit("p").alias("path"))
    return ingest.large_sets(ingest.with_images(cards, manifest)).select("card_id", "set_id")
