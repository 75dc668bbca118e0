"""Roles of the driver's tables: customers collect, orders are binders, line items pockets, parts cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Part keys in a block; a brand's parts of a block are a set, so that sets keep their size however many parts there are.
BLOCK = 2500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _binder_type(key: str):
    return F.element_at(F.array(F.lit("set"), F.lit("trade"), F.lit("collect")), (F.col(key) % 3 + 1).cast("int"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("binder_id"), F.col("o_custkey").alias("collector"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("binder_id"), F.col("l_partkey").alias("card_id"), F.col("l_returnflag").alias("variant"), F.col("l_linenumber").alias("slot"), (F.col("l_linestatus") == "F").alias("keep"))
    condition = F.element_at(F.array(*map(F.lit, ("DMG", "HP", "MP", "LP", "NM"))), F.col("slot") % 5 + 1)
    rows = li.join(o, "binder_id")
    return rows.select("collector", "binder_id", _binder_type("binder_id").alias("binder_type"), "card_id", "variant", condition.alias("condition"), "keep", F.lit(0).alias("page"), "slot")


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set_id, card_id, number, printed_total: nine tenths of a set's cards are printed, the others are secrets."""
    part = table(spark, sf_dir, "part").select(F.concat_ws("-", "p_brand", F.floor(F.col("p_partkey") / BLOCK).cast("string")).alias("set_id"), F.col("p_partkey").alias("card_id"))
    own = Window.partitionBy("set_id")
    return part.withColumn("number", F.row_number().over(own.orderBy("card_id"))).withColumn("printed_total", F.floor(F.count(F.lit(1)).over(own) * 9 / 10).cast("int"))


def set_binders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third order is a binder for a set, half of them with its secrets. Sets are dealt out in turn, by brand and block."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0")
    blocks = (table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] or 0) // BLOCK + 1
    k = F.col("o_orderkey")
    set_id = F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string"), F.lit("-"), (F.floor(k / 25) % blocks).cast("string"))
    return o.select(F.col("o_custkey").alias("collector"), k.alias("binder_id"), set_id.alias("set_id"), (k % 2 == 0).alias("include_secrets"))


def manual_wishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each collector wishes for one card, by its key."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("collector"), (F.col("c_custkey") * 7 % 1000 + 1).alias("card_id"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("need")).otherwise("want").alias("priority"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("R")).alias("variant"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit("MP")).alias("min_condition"), (F.col("c_custkey") % 2 + 1).alias("quantity"),
    )


#: The same roles in SQL, for the oracles.
SQL = {
    "items": """items AS (
  SELECT o_custkey AS collector, o_orderkey AS binder_id, CASE o_orderkey % 3 WHEN 0 THEN 'set' WHEN 1 THEN 'trade' ELSE 'collect' END AS binder_type,
         l_partkey AS card_id, l_returnflag AS variant, ['DMG', 'HP', 'MP', 'LP', 'NM'][l_linenumber % 5 + 1] AS condition, l_linestatus = 'F' AS keep, 0 AS page, l_linenumber AS slot
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "sets": f"""sets AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY card_id) AS number, CAST(count(*) OVER (PARTITION BY set_id) * 9 // 10 AS INTEGER) AS printed_total
  FROM (SELECT p_brand || '-' || (p_partkey // {BLOCK}) AS set_id, p_partkey AS card_id FROM part))""",
    "binders": f"""binders AS (SELECT o_custkey AS collector, o_orderkey AS binder_id, o_orderkey % 2 = 0 AS include_secrets,
  'Brand#' || (o_orderkey % 25 + 1) || '-' || (o_orderkey // 25 % (SELECT max(p_partkey) // {BLOCK} + 1 FROM part)) AS set_id FROM orders WHERE o_orderkey % 3 = 0)""",
    "wishes": """wishes AS (
  SELECT c_custkey AS collector, c_custkey * 7 % 1000 + 1 AS card_id, CASE WHEN c_custkey % 3 = 0 THEN 'need' ELSE 'want' END AS priority,
         CASE WHEN c_custkey % 2 = 0 THEN 'R' END AS variant, CASE WHEN c_custkey % 5 = 0 THEN 'MP' END AS min_condition, c_custkey % 2 + 1 AS quantity FROM customer)""",
    "gaps": """gaps AS (
  SELECT collector, binder_id, card_id, CAST(number AS INTEGER) AS number FROM binders JOIN sets USING (set_id)
  WHERE (number <= printed_total OR include_secrets) AND NOT EXISTS (SELECT 1 FROM items i WHERE i.collector = binders.collector AND i.binder_id = binders.binder_id AND i.card_id = sets.card_id))""",
}


def with_roles(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
