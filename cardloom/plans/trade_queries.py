"""Queries of trades: what two sides offer and wish for, and what a trade leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import collection
from . import roles
from .base import query
from .roles import table, with_roles

_RANK = "list_position(['DMG', 'HP', 'MP', 'LP', 'NM'], {})"
#: First fit, copy by copy, of offered(pair, card_id, ordinal, variant, condition) and wants(pair, card_id, ordinal, variant,
#: min_condition, priority, quantity), as a recursion over each card's copies; it is the last of its WITH RECURSIVE.
_WALK = f"""
w AS (SELECT pair, card_id, list({{'v': variant, 'm': min_condition, 'p': priority}} ORDER BY coalesce(priority, 'want') <> 'need', ordinal) AS wl, list(CAST(coalesce(quantity, 1) AS BIGINT) ORDER BY coalesce(priority, 'want') <> 'need', ordinal) AS q FROM wants GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY pair, card_id ORDER BY ordinal) AS n FROM offered SEMI JOIN w USING (pair, card_id)),
walk AS (
  SELECT pair, card_id, CAST(0 AS BIGINT) AS n, q AS room, wl, CAST(NULL AS BIGINT) AS ordinal, CAST(NULL AS VARCHAR) AS variant, CAST(NULL AS VARCHAR) AS condition, CAST(0 AS BIGINT) AS hit, CAST(0 AS BIGINT) AS near FROM w
  UNION ALL
  SELECT pair, card_id, n, [room[i] - CASE WHEN i = hit THEN 1 ELSE 0 END FOR i IN range(1, len(room) + 1)], wl, ordinal, variant, condition, hit, near FROM (
    SELECT k.pair, k.card_id, o.n, k.room, k.wl, CAST(o.ordinal AS BIGINT) AS ordinal, o.variant, o.condition,
      CAST(coalesce(list_position([k.room[i] > 0 AND (k.wl[i].v IS NULL OR k.wl[i].v = o.variant) AND (k.wl[i].m IS NULL OR {_RANK.format("o.condition")} >= {_RANK.format("k.wl[i].m")}) FOR i IN range(1, len(k.room) + 1)], true), 0) AS BIGINT) AS hit,
      CAST(coalesce(list_position([k.room[i] > 0 FOR i IN range(1, len(k.room) + 1)], true), 0) AS BIGINT) AS near
    FROM walk k JOIN o ON k.pair = o.pair AND k.card_id = o.card_id AND o.n = k.n + 1)),
found AS (SELECT pair, card_id, ordinal, variant, condition, CASE WHEN hit > 0 THEN 'offer' ELSE 'near_miss' END AS outcome, CASE WHEN hit > 0 THEN coalesce(wl[hit].p, 'want') END AS priority,
  CASE WHEN hit = 0 THEN wl[near].v END AS wanted_variant, CASE WHEN hit = 0 THEN wl[near].m END AS wanted_min_condition FROM walk WHERE n > 0 AND (hit > 0 OR near > 0))"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations trade with each other: what their trade binders offer meets what their customers wish for."""
    nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("collector"), F.col("c_nationkey").alias("nation"))
    offered = roles.items(spark, sf_dir).filter("binder_type = 'trade' and not keep").join(nation, "collector")
    offered = offered.withColumn("ordinal", F.row_number().over(Window.partitionBy("nation", "card_id").orderBy("binder_id", "slot", "variant", "condition")).cast("long"))
    wants = roles.manual_wishes(spark, sf_dir).join(nation, "collector")
    wants = wants.withColumn("ordinal", F.col("collector")).withColumn("nation", (F.col("nation") + 1) % 25)
    pair = F.col("nation").cast("string").alias("pair")
    return offered.select(pair, "card_id", "ordinal", "variant", "condition"), wants.select(pair, "card_id", "ordinal", "variant", "min_condition", "priority", "quantity")


_NATIONS = """
offered AS (SELECT CAST(c_nationkey AS VARCHAR) AS pair, CAST(card_id AS VARCHAR) AS card_id, row_number() OVER (PARTITION BY c_nationkey, card_id ORDER BY binder_id, slot, variant, condition) AS ordinal, variant, condition
  FROM items JOIN customer ON collector = c_custkey WHERE binder_type = 'trade' AND NOT keep),
wants AS (SELECT CAST((c_nationkey + 1) % 25 AS VARCHAR) AS pair, CAST(card_id AS VARCHAR) AS card_id, collector AS ordinal, variant, min_condition, priority, quantity FROM wishes JOIN customer ON collector = c_custkey)"""


@query(f"{with_roles('items', 'wishes').replace('WITH', 'WITH RECURSIVE', 1)}, {_NATIONS}, {_WALK} SELECT * FROM found")
def q_match_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    offered, wants = sides(spark, sf_dir)
    return collection.offers(offered.withColumn("card_id", F.col("card_id").cast("string")), wants.withColumn("card_id", F.col("card_id").cast("string")))


def _match(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each even customer trades with the next one; a card's price is its own, and more in the variant R."""
    items, wishes = roles.items(spark, sf_dir), roles.manual_wishes(spark, sf_dir).withColumn("ordinal", F.lit(0))
    c = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("pair"), F.col("c_custkey").alias("mine"), (F.col("c_custkey") + 1).alias("theirs"))
    part = table(spark, sf_dir, "part").filter("p_partkey % 4 <> 0")
    key = F.col("p_partkey").cast("string")
    prices = part.select(key.alias("key"), F.col("p_retailprice").alias("price")).unionAll(part.filter("p_partkey % 3 = 0").select(F.concat(key, F.lit("|R")), F.col("p_retailprice") + 1000))
    return collection.match_collections(c, items, wishes, roles.set_binders(spark, sf_dir), roles.sets(spark, sf_dir), prices)


_PROFILE = """
places AS (SELECT *, row_number() OVER () AS any FROM items),
held AS (SELECT w.collector, w.card_id, w.priority, w.variant, w.min_condition, w.quantity, count(i.card_id) FILTER (WHERE (w.variant IS NULL OR w.variant = i.variant) AND (w.min_condition IS NULL
  OR list_position(['DMG', 'HP', 'MP', 'LP', 'NM'], i.condition) >= list_position(['DMG', 'HP', 'MP', 'LP', 'NM'], w.min_condition))) AS owned FROM wishes w LEFT JOIN items i ON w.collector = i.collector AND w.card_id = i.card_id GROUP BY ALL),
listed AS (SELECT collector, card_id, variant, min_condition, priority, quantity, 0 AS source, 0 AS binder, 0 AS number FROM held WHERE owned < quantity
  UNION ALL SELECT collector, card_id, NULL, NULL, 'need', 1, 1, binder_id, number FROM gaps),
wish AS (SELECT *, row_number() OVER (PARTITION BY collector ORDER BY source, binder, number) AS ordinal FROM listed),
free AS (SELECT i.*, row_number() OVER (PARTITION BY collector ORDER BY binder_id, page, slot) AS ordinal FROM items i WHERE binder_type = 'trade' AND NOT keep
  AND NOT EXISTS (SELECT 1 FROM wish n WHERE n.collector = i.collector AND n.card_id = i.card_id AND n.priority = 'need')),
ways AS (SELECT 'for_me|' || c_custkey AS pair, c_custkey + 1 AS giver, c_custkey AS taker FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'for_them|' || c_custkey, c_custkey, c_custkey + 1 FROM customer WHERE c_custkey % 2 = 0),
offered AS (SELECT pair, CAST(card_id AS VARCHAR) AS card_id, ordinal, variant, condition FROM free JOIN ways ON collector = giver),
wants AS (SELECT pair, CAST(card_id AS VARCHAR) AS card_id, ordinal, variant, min_condition, priority, quantity FROM wish JOIN ways ON collector = taker)"""
_MATCHED = f"{with_roles('items', 'sets', 'binders', 'gaps', 'wishes').replace('WITH', 'WITH RECURSIVE', 1)}, {_PROFILE}, {_WALK}"


@query(f"""{_MATCHED},
price AS (SELECT CAST(p_partkey AS VARCHAR) AS key, p_retailprice AS price FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT p_partkey || '|R', p_retailprice + 1000 FROM part WHERE p_partkey % 12 IN (3, 6, 9)),
valued AS (SELECT f.*, coalesce(e.price, p.price) AS value FROM found f LEFT JOIN price e ON e.key = card_id || '|' || variant LEFT JOIN price p ON p.key = card_id WHERE outcome = 'offer')
SELECT split_part(pair, '|', 2) AS pair, split_part(pair, '|', 1) AS side, CAST(row_number() OVER (PARTITION BY pair ORDER BY priority <> 'need', coalesce(value, 0) DESC, card_id, ordinal) AS INTEGER) AS rank, card_id, variant, condition, priority, value FROM valued""")
def q_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir)[0]


@query(f"""{_MATCHED}
SELECT split_part(pair, '|', 2) AS pair, CAST(row_number() OVER (PARTITION BY split_part(pair, '|', 2) ORDER BY split_part(pair, '|', 1), ordinal) AS INTEGER) AS nth, card_id, variant, condition, wanted_variant, wanted_min_condition FROM found WHERE outcome = 'near_miss'""")
def q_near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir)[1]


_VALUE = "coalesce(list_sum([x.v FOR x IN {}]), 0)"


@query(f"""WITH RECURSIVE sides AS (SELECT CAST(o_custkey // 2 AS VARCHAR) AS pair, CASE WHEN o_custkey % 2 = 0 THEN 'get' ELSE 'give' END AS side, CAST(o_orderkey AS VARCHAR) AS c,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n, o_orderstatus = 'F' AS need, o_totalprice AS v FROM orders),
walk AS (
  SELECT pair, 0 AS step, coalesce(list({{'need': need, 'c': c, 'v': v, 'n': n}} ORDER BY n) FILTER (WHERE side = 'get'), []) AS g, coalesce(list({{'need': need, 'c': c, 'v': v, 'n': n}} ORDER BY n) FILTER (WHERE side = 'give'), []) AS h FROM sides GROUP BY pair
  UNION ALL
  SELECT pair, step + 1, CASE WHEN heavy THEN [x FOR x IN g IF x.n <> pick.n] ELSE g END, CASE WHEN heavy THEN h ELSE [x FOR x IN h IF x.n <> pick.n] END FROM (
    SELECT *, list_sort([{{'need': x.need, 'd': abs(gap - x.v), 'c': x.c, 'n': x.n}} FOR x IN (CASE WHEN heavy THEN g ELSE h END) IF x.v <> 0 AND abs(gap - x.v) < gap])[1] AS pick FROM (
      SELECT *, abs(a - b) AS gap, a > b AS heavy FROM (SELECT *, {_VALUE.format("g")} AS a, {_VALUE.format("h")} AS b FROM walk))
    WHERE len(g) > 0 AND len(h) > 0 AND greatest(a, b) > 0 AND gap > 0.1 * greatest(a, b) AND len(CASE WHEN heavy THEN g ELSE h END) > 1)
  WHERE pick IS NOT NULL),
done AS (SELECT pair, g, h FROM walk QUALIFY row_number() OVER (PARTITION BY pair ORDER BY step DESC) = 1),
kept AS (SELECT pair, 'get' AS side, unnest(g) AS x FROM done UNION ALL SELECT pair, 'give', unnest(h) FROM done)
SELECT pair, side, x.c AS card_id, x.n AS ordinal, CASE WHEN x.need THEN 'need' ELSE 'want' END AS priority, x.v AS value FROM kept""")
def q_fair_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of customers against all of their neighbours by key, dearest first, valued at the order's price."""
    o = table(spark, sf_dir, "orders").withColumn("nth", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    sides = o.select(
        F.floor(F.col("o_custkey") / 2).cast("string").alias("pair"), F.when(F.col("o_custkey") % 2 == 0, "get").otherwise("give").alias("side"), F.col("o_orderkey").cast("string").alias("card_id"),
        F.col("nth").cast("long").alias("ordinal"), F.when(F.col("o_orderstatus") == "F", "need").otherwise("want").alias("priority"), F.col("o_totalprice").alias("value"),
    )
    return collection.fair_trade(sides)


_OWN = "o AS (SELECT o_custkey AS collector, o_orderkey AS ordinal, CASE WHEN o_custkey % 3 = 0 THEN 'premium' ELSE 'free' END AS plan, o_orderdate FROM orders)"


@query(f"""WITH {_OWN} SELECT collector, ordinal, plan, CAST(row_number() OVER (PARTITION BY collector ORDER BY o_orderdate DESC, ordinal) AS INTEGER) AS rank FROM o WHERE plan = 'premium'""")
def q_visible_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("collector"), F.col("o_orderkey").alias("ordinal"), F.when(F.col("o_custkey") % 3 == 0, "premium").otherwise("free").alias("plan"), F.col("o_orderdate").alias("completed_at"))
    return collection.visible_history(o).drop("completed_at")


@query("""WITH h AS (SELECT c_custkey AS collector, CASE WHEN c_custkey % 2 = 0 THEN 'free' ELSE 'premium' END AS plan, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS cards_held, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS binders_held FROM customer)
SELECT *, plan = 'premium' OR cards_held < 200 AS can_add_card, true AS can_add_binder, plan = 'premium' OR cards_held < 200 AS can_add_pages, plan = 'premium' AS shows_values, plan = 'premium' AS shows_gap_detail, plan = 'premium' AS allows_trading, plan = 'premium' AS allows_backup,
  plan = 'premium' AS allows_export, plan = 'premium' AS allows_catalog_updates, CAST(CASE WHEN plan = 'free' THEN 0 END AS INTEGER) AS trades_shown FROM h""")
def q_plan_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("collector"), F.when(F.col("c_custkey") % 2 == 0, "free").otherwise("premium").alias("plan"))
    binders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("collector")).agg(F.count(F.lit(1)).alias("binders_held"))
    held = c.join(collection.card_counts(roles.items(spark, sf_dir)), "collector", "left").join(binders, "collector", "left").fillna(0, ["cards_held", "binders_held"])
    return collection.plan_rules(held)


@query("""SELECT c_custkey AS collector, b AS binder_id, CASE b WHEN 'a' THEN 'set' WHEN 'b' THEN 'trade' END AS binder_type, CASE b WHEN 'loose' THEN 0 ELSE 1 END AS page, s AS slot, c_custkey * 10 + s AS card_id, CASE WHEN s = 2 THEN 'holo' ELSE 'normal' END AS variant,
  CASE WHEN c_custkey % 2 = 0 THEN 'LP' ELSE 'NM' END AS condition, s = 2 AND c_custkey % 3 = 0 AS keep FROM customer, (VALUES ('a'), ('b'), ('loose')) t(b), (VALUES (0), (2)) u(s)""".replace("b AS binder_id", "NULLIF(b, 'loose') AS binder_id"))
def q_pockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's binders hold an empty page and one with an empty pocket, and the same cards lie loose."""
    c = F.col("c_custkey")
    kind = "struct<card_id:bigint,variant:string,condition:string,keep:boolean>"
    item = lambda s: F.struct((c * 10 + s).alias("card_id"), F.lit("holo" if s == 2 else None).cast("string").alias("variant"), F.when(c % 2 == 0, "LP").alias("condition"), F.when(F.lit(s == 2) & (c % 3 == 0), True).alias("keep")).cast(kind)
    slots = F.array(item(0), F.lit(None).cast(kind), item(2))
    binder = lambda i, t: F.struct(F.lit(i).alias("id"), F.lit(t).alias("type"), F.array(F.array().cast(f"array<{kind}>"), slots).alias("pages"))
    return collection.pockets(table(spark, sf_dir, "customer").select(c.alias("collector"), F.array(binder("a", "set"), binder("b", "trade")).alias("binders"), slots.alias("loose")))
