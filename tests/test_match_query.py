import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cardloom.operators import collection as C
from cardloom.plans import registry, roles


def tables(spark, at):
    """Two pairs of collectors with some 120 binders each for sets of 100 cards, and some pockets."""
    put = lambda name, rows, kinds: spark.createDataFrame(rows, kinds).write.parquet(f"{at}/{name}.parquet")
    put("customer", [(c, c % 25) for c in (2, 3, 4, 5, 6, 8, 9)], "c_custkey long, c_nationkey int")
    put("part", [(p, f"Brand#{p % 25 + 1}", 900.0 + p % 7) for p in range(2500)], "p_partkey long, p_brand string, p_retailprice double")
    rng = random.Random(5)
    orders = [(k, rng.randrange(2, 6)) for k in range(1440)] + [(1441, 9)]  # 9 offers 8 another variant than that wished for
    put("orders", orders, "o_orderkey long, o_custkey long")
    items = [(k, rng.choice([15, 22, 29, 36, rng.randrange(2500)]), 1 + k % 5, rng.choice("RAN"), rng.choice("FO")) for k, _ in orders if k < 1440 and rng.random() < 0.5] + [(1441, 57, 1, "A", "O")]
    put("lineitem", items, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string")


def shuffled(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(sc._jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["q_match", "q_near_misses"])
def test_gaps_are_only_sought_among_what_is_offered(spark, tmp_path, name):
    tables(spark, tmp_path)
    sf = str(tmp_path)
    gaps = C.set_gaps(roles.set_binders(spark, sf), roles.sets(spark, sf), roles.items(spark, sf)).count()
    before = shuffled(spark)
    rows = registry.QUERIES[name](spark, sf).collect()
    assert shuffled(spark) - before < 0.75 * gaps
    con = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    rel = con.sql(registry.ORACLE[name])
    assert sorted(str([r[c] for c in rel.columns]) for r in rows) == sorted(str(list(r)) for r in rel.fetchall()) and rows


@pytest.mark.parametrize("name", ["q_match", "q_near_misses"])
def test_pockets_that_are_neither_offered_nor_wished_for_are_not_moved(spark, tmp_path, name):
    tables(spark, tmp_path)
    sf = str(tmp_path)
    collected = spark.range(20_000).selectExpr("3 * (id % 480) + 2 as l_orderkey", "100 + id % 2000 as l_partkey", "cast(id % 5 as int) as l_linenumber", "'R' as l_returnflag", "'O' as l_linestatus")
    collected.write.mode("append").parquet(f"{sf}/lineitem.parquet")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        rows = registry.QUERIES[name](spark, sf).collect()
        assert shuffled(spark) - before < 20_000 and rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_items_of_cards(spark, monkeypatch):
    items = spark.createDataFrame([(i, i % 7 if i % 8 else None) for i in range(50)], "binder_id long, card_id long")
    cards = spark.createDataFrame([(2,), (2,), (5,), (None,), (9,)], "card_id long")
    for few in (3, 2, 0):
        monkeypatch.setattr(C, "NAMED", few)
        assert sorted(r.binder_id for r in C._of_cards(items, cards).collect()) == [i for i in range(50) if i % 8 and i % 7 in (2, 5)]
    assert C._of_cards(items, cards.limit(0)).count() == 0


def test_gaps_among_cards(spark, tmp_path):
    tables(spark, tmp_path)
    binders, sets, items = roles.set_binders(spark, str(tmp_path)), roles.sets(spark, str(tmp_path)), roles.items(spark, str(tmp_path))
    every = C.set_gaps(binders, sets, items).drop("owned_elsewhere")
    cards = every.filter("card_id % 5 = 0").select("collector", "card_id").unionAll(binders.select("collector", (F.col("binder_id") % 400).alias("card_id")))
    want = every.join(cards, ["collector", "card_id"], "left_semi").select("collector", "binder_id", "card_id", "number")
    got = C.gaps_among(cards, binders, sets, items)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns and want.count()
