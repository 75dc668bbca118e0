import pytest
from pyspark.sql import functions as F

from cardloom.operators import collection as C

ITEM = "collector long, binder_id string, binder_type string, card_id string, variant string, condition string, keep boolean, page int, slot int"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def items(spark, *given):
    out = []
    for k, (binder, kind, card, *rest) in enumerate(given):
        variant, condition, keep = (*rest, *("normal", "NM", False)[len(rest) :])
        out.append((1, binder, kind, card, variant, condition, keep, 0, k))
    return spark.createDataFrame(out, ITEM)


def test_pockets_keep_order_and_fill_defaults(spark):
    schema = "collector long, binders array<struct<id:string,type:string,pages:array<array<struct<card_id:string,variant:string,condition:string,keep:boolean>>>>>, loose array<struct<card_id:string,variant:string,condition:string,keep:boolean>>"
    df = spark.createDataFrame([(1, [("b", "trade", [[None, ("x", None, None, None)], [("y", "holo", "LP", True)]])], [("z", None, "HP", None)])], schema)
    assert rows(C.pockets(df), "card_id", "binder_id", "page", "slot", "variant", "condition", "keep") == [("x", "b", 0, 1, "normal", "NM", False), ("y", "b", 1, 0, "holo", "LP", True), ("z", None, 0, 0, "normal", "HP", False)]


def test_gaps_with_secrets_and_copies_elsewhere(spark):
    sets = spark.createDataFrame([("s", n, f"c{n}", 3) for n in range(1, 6)], "set_id string, number int, card_id string, printed_total int")
    own = items(spark, ("a", "set", "c1"), ("t", "trade", "c2"), (None, None, "c2"))
    binders = spark.createDataFrame([(1, "a", "s", False), (1, "q", "s", True)], "collector long, binder_id string, set_id string, include_secrets boolean")
    got = rows(C.set_gaps(binders, sets, own).filter("binder_id = 'a'"), "card_id", "owned_elsewhere")
    assert got == [("c2", ["loose", "t"]), ("c3", [])]
    assert [r[0] for r in rows(C.set_gaps(binders, sets, own).filter("binder_id = 'q'"), "card_id")] == ["c1", "c2", "c3", "c4", "c5"]


def test_wishes_are_open_below_their_quantity(spark):
    own = items(spark, ("a", "set", "x", "holo", "LP"), ("a", "set", "x", "normal", "DMG"), ("a", "set", "y", "normal", "odd"))
    schema = "collector long, card_id string, priority string, variant string, min_condition string, quantity int"
    wishes = spark.createDataFrame([(1, "x", "need", None, None, 2), (1, "x", "want", None, None, 3), (1, "x", "want", "holo", "NM", 1), (1, "y", "want", None, "DMG", 1), (1, "y", "want", None, None, 1), (2, "x", "want", None, None, 1)], schema)
    got = rows(C.open_wishes(wishes, own), "collector", "card_id", "quantity", "owned")
    assert got == [(1, "x", 1, 0), (1, "x", 3, 2), (1, "y", 1, 0), (2, "x", 1, 0)]


def test_tradeables(spark):
    own = items(spark, ("t", "trade", "x"), ("t", "trade", "y", "normal", "NM", True), ("c", "collect", "z"), (None, None, "w"), ("t", "trade", "n"))
    needs = spark.createDataFrame([(1, "n"), (2, "x")], "collector long, card_id string")
    assert rows(C.tradeables(own, needs), "card_id") == [("x",)]


OFFERED = "pair string, card_id string, ordinal long, variant string, condition string"
WANTS = "pair string, card_id string, ordinal long, variant string, min_condition string, priority string, quantity int"


def test_offers_take_the_first_wish_with_room_and_note_one_near_miss(spark):
    offered = spark.createDataFrame([("p", "x", 1, "normal", "LP"), ("p", "x", 2, "holo", "NM"), ("p", "x", 3, "holo", "NM"), ("p", "q", 4, "normal", "NM"), ("p", "e", 5, "normal", "NM"), ("p", "e", 6, "normal", "NM")], OFFERED)
    wants = spark.createDataFrame([("p", "x", 1, None, "NM", "want", 1), ("p", "x", 2, "holo", None, "need", 1), ("p", "e", 3, None, None, "want", 1)], WANTS)
    got = rows(C.offers(offered, wants), "ordinal", "outcome", "priority", "wanted_variant", "wanted_min_condition")
    assert got == [(1, "near_miss", None, "holo", None), (2, "offer", "need", None, None), (3, "offer", "want", None, None), (5, "offer", "want", None, None)]


def test_offers_are_ranked_by_need_value_and_card(spark):
    found = spark.createDataFrame([("p", c, i, v, "NM", "offer", p, None, None) for i, (c, v, p) in enumerate([("a", "normal", "want"), ("b", "holo", "want"), ("c", "normal", "need"), ("d", "normal", "want")])], C._OFFERS)
    prices = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("b|holo", 9.0)], "key string, price double")
    got = C.ranked_offers(found, prices).orderBy("rank").collect()
    assert [(r.card_id, r.value) for r in got] == [("c", None), ("b", 9.0), ("a", 5.0), ("d", None)]


SIDES = "pair string, side string, card_id string, ordinal long, priority string, value double"


@pytest.mark.parametrize(
    ("get", "give", "want"),
    [
        ([("x", "want", 30.0), ("y", "need", 10.0)], [("a", "want", 12.0), ("b", "want", 8.0)], (["y"], ["b"])),
        ([("x", "want", 10.0)], [("a", "want", 10.5)], (["x"], ["a"])),
        ([("x", "want", None), ("y", "want", 0.0)], [("a", "want", 50.0)], (["x", "y"], ["a"])),
        ([], [("a", "want", 50.0)], ([], ["a"])),
        ([("x", "want", 5.0), ("y", "want", 5.0)], [("a", "want", 5.0), ("b", "need", 15.0)], (["x", "y"], ["b"])),
    ],
)
def test_fair_trade(spark, get, give, want):
    given = [("p", side, c, i, p, v) for side, xs in (("get", get), ("give", give)) for i, (c, p, v) in enumerate(xs)]
    got = rows(C.fair_trade(spark.createDataFrame(given, SIDES)), "side", "card_id")
    if want != (["x", "y"], ["b"]):
        assert ([c for s, c in got if s == "get"], [c for s, c in got if s == "give"]) == want
    else:  # 20 against 10: giving up a leaves 15, nearer than giving up b; then b stays as the last
        assert [c for s, c in got if s == "give"] == ["b"]


def test_trade_takes_the_first_equal_pocket(spark):
    own = items(spark, ("t2", "trade", "x"), ("t1", "trade", "x"), ("t1", "trade", "x", "normal", "NM", True), ("c", "collect", "x"), ("t1", "trade", "y"))
    line = "collector long, card_id string, variant string, condition string"
    gave = spark.createDataFrame([(1, "x", "normal", "NM")], line)
    got = spark.createDataFrame([(1, "g", "holo", "LP")], line)
    left = rows(C.apply_trade(own, gave, got).fillna("", ["binder_id"]), "card_id", "binder_id", "keep")
    assert left == [("g", "", False), ("x", "c", False), ("x", "t1", True), ("x", "t2", False), ("y", "t1", False)]
    with pytest.raises(Exception, match="not tradeable: x"):
        C.apply_trade(own, spark.createDataFrame([(1, "x", "normal", "NM")] * 3, line), got).collect()


def test_plans(spark):
    held = spark.createDataFrame([("free", 0), ("free", 199), ("free", 200), ("free", 5000), ("premium", 100000)], "plan string, cards_held long")
    assert rows(C.plan_gate(held), "plan", "cards_held", "can_add") == [("free", 0, True), ("free", 199, True), ("free", 200, False), ("free", 5000, False), ("premium", 100000, True)]
    log = spark.createDataFrame([(1, "2024-01-02", 0), (1, "2024-01-03", 1), (1, "2024-01-03", 2)], "collector long, completed_at string, ordinal int")
    assert rows(C.trade_history(log, None), "rank", "ordinal") == [(1, 1), (2, 2), (3, 0)] and C.trade_history(log, 0).count() == 0
    with pytest.raises(Exception, match="unknown plan: gold"):
        C.plan_gate(spark.createDataFrame([("gold", 1)], "plan string, cards_held long")).collect()
    rules = spark.createDataFrame([("free", 200, 3), ("premium", 200, 3)], "plan string, cards_held long, binders_held long")
    got = {r.plan: r for r in C.plan_rules(rules).collect()}
    assert [got["free"][c] for c in ("can_add_card", "can_add_pages", "can_add_binder", "shows_values", "shows_gap_detail", "allows_trading", "allows_backup", "allows_export", "allows_catalog_updates", "trades_shown")] == [False, False, True, False, False, False, False, False, False, 0]
    assert all(got["premium"][c] for c in got["premium"].asDict() if c[:3] in ("can", "sho", "all")) and got["premium"].trades_shown is None
    of = log.withColumn("plan", F.lit("free")).unionAll(log.withColumn("plan", F.lit("premium")).withColumn("collector", F.lit(2).cast("long")))
    assert [r[0] for r in rows(C.visible_history(of), "collector")] == [2, 2, 2]


def test_a_wish_without_a_quantity_is_for_one(spark):
    offered = spark.createDataFrame([("p", "x", 1, "normal", "LP"), ("p", "x", 2, "normal", "NM")], OFFERED)
    wants = spark.createDataFrame([("p", "x", 1, None, None, None, None)], WANTS)
    assert rows(C.offers(offered, wants), "ordinal", "outcome", "priority") == [(1, "offer", "want")]
    assert rows(C.simple_offers(offered, wants), "ordinal") == [(1,)]
    wish = spark.createDataFrame([(1, "q", "want", None, None, None)], "collector long, card_id string, priority string, variant string, min_condition string, quantity int")
    assert rows(C.open_wishes(wish, items(spark, ("a", "set", "x"))), "card_id", "quantity") == [("q", 1)]


def test_match_of_two_collectors(spark):
    own = spark.createDataFrame([(1, "t", "trade", "a", "normal", "NM", False, 0, 0), (1, "t", "trade", "b", "holo", "LP", False, 0, 1), (2, "u", "trade", "c", "normal", "NM", False, 0, 0), (2, "u", "trade", "d", "normal", "DMG", False, 0, 1), (2, "s", "set", "a", "normal", "NM", False, 0, 2), (2, "u", "trade", "e", "normal", "NM", False, 0, 3)], ITEM)
    wish = "collector long, ordinal int, card_id string, priority string, variant string, min_condition string, quantity int"
    wishes = spark.createDataFrame([(1, 0, "d", "want", None, "NM", 1), (1, 1, "e", "want", None, None, None), (2, 0, "b", "want", "normal", None, 1)], wish)
    sets = spark.createDataFrame([("s", 1, "a", 2), ("s", 2, "c", 2)], "set_id string, number int, card_id string, printed_total int")
    binders = spark.createDataFrame([(1, "z", "s", False), (2, "s", "s", False)], "collector long, binder_id string, set_id string, include_secrets boolean")
    free, wants = C.profile(own, wishes, C.set_gaps(binders, sets, own))
    assert rows(free, "collector", "card_id", "ordinal") == [(1, "b", 1), (2, "d", 1), (2, "e", 2)]  # a and c are needed
    assert rows(wants, "collector", "card_id", "priority", "ordinal") == [(1, "a", "need", 3), (1, "c", "need", 4), (1, "d", "want", 1), (1, "e", "want", 2), (2, "b", "want", 1), (2, "c", "need", 2)]
    pairs = spark.createDataFrame([("p|1", 1, 2), ("q", 2, 1)], "pair string, mine long, theirs long")
    prices = spark.createDataFrame([("e|normal", 4.0)], "key string, price double")
    good, near = C.match(pairs, free, wants, prices)
    assert rows(good, "pair", "side", "rank", "card_id", "value") == [("p|1", "for_me", 1, "e", 4.0), ("q", "for_them", 1, "e", 4.0)]
    assert rows(near, "pair", "nth", "card_id", "wanted_variant", "wanted_min_condition") == [("p|1", 1, "d", None, "NM"), ("p|1", 2, "b", "normal", None), ("q", 1, "b", "normal", None), ("q", 2, "d", None, "NM")]
