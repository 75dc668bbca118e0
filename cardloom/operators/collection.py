"""Rules over collections: gaps, wish lists, tradeables, trades and plans, for many collectors at once.

Items are rows (collector, binder_id, binder_type, card_id, variant, condition, keep, page, slot); loose items have a
null binder_id. Everything is derived from them; no result is stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: What each plan allows; a limit that is null is none.
PLAN_FIELDS = "plan string, cards int, binders int, values boolean, set_gap_detail boolean, trading boolean, backup boolean, export boolean, trade_history int, catalog_updates boolean"
PLANS = (("free", 200, None, False, False, False, False, False, 0, False), ("premium", None, None, True, True, True, True, True, None, True))


def pockets(collections: DataFrame) -> DataFrame:
    """Items of nested collections (collector, binders, loose); empty pockets go, order stays in page and slot."""
    binder = collections.select("collector", F.explode("binders").alias("b"))
    page = binder.select("collector", F.col("b.id").alias("binder_id"), F.col("b.type").alias("binder_type"), F.posexplode("b.pages").alias("page", "p"))
    slot = page.select("collector", "binder_id", "binder_type", "page", F.posexplode("p").alias("slot", "i"))
    loose = collections.select("collector", F.lit(None).cast("string").alias("binder_id"), F.lit(None).cast("string").alias("binder_type"), F.lit(0).alias("page"), F.posexplode("loose").alias("slot", "i"))
    every = slot.unionByName(loose).filter("i is not null")
    default = lambda c, v: F.coalesce(F.col(f"i.{c}"), F.lit(v)).alias(c)
    return every.select("collector", "binder_id", "binder_type", "page", "slot", F.col("i.card_id").alias("card_id"), default("variant", "normal"), default("condition", "NM"), default("keep", False))


def _wanted(cards: DataFrame) -> DataFrame:
    return cards.filter((F.col("number") <= F.col("printed_total")) | F.col("include_secrets"))


def set_gaps(binders: DataFrame, sets: DataFrame, items: DataFrame) -> DataFrame:
    """collector, binder_id, card_id, number, owned_elsewhere: what a set binder lacks of its set.

    binders(collector, binder_id, set_id, include_secrets) are set binders; sets(set_id, number, card_id, printed_total)
    their cards. Cards above the printed total are secrets. owned_elsewhere lists where other copies are.
    """
    wanted = _wanted(binders.join(sets, "set_id"))
    place = F.coalesce(F.col("binder_id").cast("string"), F.lit("loose"))
    placed = items.groupBy("collector", "card_id").agg(F.array_sort(F.collect_set(place)).alias("owned_elsewhere"), F.collect_set("binder_id").alias("here"))
    out = wanted.join(placed, ["collector", "card_id"], "left").filter(F.col("here").isNull() | ~F.array_contains("here", F.col("binder_id")))
    return out.select("collector", "binder_id", "card_id", "number", F.coalesce("owned_elsewhere", F.array().cast("array<string>")).alias("owned_elsewhere"))


def gaps_among(cards: DataFrame, binders: DataFrame, sets: DataFrame, items: DataFrame) -> DataFrame:
    """Those set_gaps that are in cards(collector, card_id), without owned_elsewhere; no other gap is formed."""
    key = ["collector", "set_id"]
    sought = cards.join(sets, "card_id").join(binders.select(*key), key, "left_semi").distinct()
    wanted = _wanted(binders.join(sought, key)).select("collector", "binder_id", "card_id", "number")
    held = items.join(wanted.select("binder_id").distinct(), "binder_id", "left_semi").select("collector", "binder_id", "card_id")
    return wanted.join(held, ["collector", "binder_id", "card_id"], "left_anti")


def open_wishes(wishes: DataFrame, items: DataFrame) -> DataFrame:
    """Wishes with an owned count below their quantity; null variant or minimum condition accepts any copy, null quantity is 1."""
    wishes = wishes.withColumn("quantity", F.coalesce("quantity", F.lit(1)))
    own = items.select("collector", "card_id", F.col("variant").alias("own_variant"), F.col("condition").alias("own_condition"))
    own = own.groupBy("collector", "card_id", "own_variant", "own_condition").agg(F.count(F.lit(1)).alias("copies"))
    met = wishes.join(own, ["collector", "card_id"], "left")
    fits = (F.col("variant").isNull() | (F.col("variant") == F.col("own_variant"))) & T.condition_ok(F.col("own_condition"), F.col("min_condition"))
    keys = wishes.columns
    count = F.coalesce(F.sum(F.when(fits, F.col("copies"))), F.lit(0)).alias("owned")
    return met.groupBy(*keys).agg(count).filter(F.col("owned") < F.col("quantity"))


def wish_list(wishes: DataFrame, gaps: DataFrame, items: DataFrame) -> DataFrame:
    """Open manual wishes and then gaps, as collector, card_id, priority, source, quantity, ordinal."""
    manual = open_wishes(wishes, items).select("collector", "card_id", "priority", F.lit("manual").alias("source"), F.col("quantity").cast("long").alias("quantity"), F.lit(0).alias("ordinal"))
    gap = gaps.select("collector", "card_id", F.lit("need").alias("priority"), F.lit("set_gap").alias("source"), F.lit(1).cast("long").alias("quantity"), F.lit(1).alias("ordinal"))
    return manual.unionByName(gap)


def tradeables(items: DataFrame, needs: DataFrame) -> DataFrame:
    """Copies in trade binders that aren't kept and whose card the collector doesn't need; loose items are not offered."""
    offered = items.filter((F.col("binder_type") == "trade") & ~F.col("keep"))
    return offered.join(needs.select("collector", "card_id").distinct(), ["collector", "card_id"], "left_anti")


def simple_offers(offered: DataFrame, wants: DataFrame) -> DataFrame:
    """First-fit matching where wishes accept any copy: the first sum(quantity) copies of each card, by ordinal.

    offered(pair, card_id, ordinal), wants(pair, card_id, quantity); a pair's cards don't interact, so a rank is enough.
    """
    room = wants.groupBy("pair", "card_id").agg(F.sum(F.coalesce("quantity", F.lit(1))).alias("room"))
    ranked = offered.withColumn("nth", F.row_number().over(Window.partitionBy("pair", "card_id").orderBy("ordinal")))
    return ranked.join(room, ["pair", "card_id"]).filter("nth <= room").select("pair", "card_id", "ordinal", "nth")


_OFFERS = "pair string, card_id string, ordinal long, variant string, condition string, outcome string, priority string, wanted_variant string, wanted_min_condition string"
_RANK = {c: i for i, c in enumerate(T.CONDITIONS)}


def _allot(offered: list[dict], wants: list[dict]) -> Iterator[tuple]:
    asked = sorted(wants, key=lambda w: ((w["priority"] or "want") != "need", w["ordinal"]))
    left = [1 if w["quantity"] is None else w["quantity"] for w in asked]
    for item in sorted(offered, key=lambda o: o["ordinal"]):
        own, near = (item["ordinal"], item["variant"], item["condition"]), None
        for i, w in enumerate(asked):
            if left[i] <= 0:
                continue
            least = w["min_condition"]
            good = least is None or (item["condition"] in _RANK and least in _RANK and _RANK[item["condition"]] >= _RANK[least])
            if good and w["variant"] in (None, item["variant"]):
                left[i] -= 1
                yield (*own, "offer", w["priority"] or "want", None, None)
                break
            near = near or w
        else:
            if near is not None:
                yield (*own, "near_miss", None, near["variant"], near["min_condition"])


def offers(offered: DataFrame, wants: DataFrame) -> DataFrame:
    """Copy by copy, the first wish with room that fits; else one near miss, the first unfit wish with room.

    offered(pair, card_id, ordinal, variant, condition); wants(pair, card_id, ordinal, variant, min_condition, priority,
    quantity, null for one). Needs come before wants. The state is of one card between two collectors; each such group is
    a row, so that a batch takes thousands of them, and cards that only one side has are never grouped. A group is what
    two collectors hold and wish of one card, which has to fit a row.
    """
    key = ["pair", "card_id"]
    met = offered.join(wants.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.collect_list(F.struct("ordinal", "variant", "condition")).alias("offered"))
    asked = wants.groupBy(*key).agg(F.collect_list(F.struct("ordinal", "variant", "min_condition", "priority", "quantity")).alias("wants"))
    names = [f.split()[0] for f in _OFFERS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, c, *out) for p, c, o, w in zip(*(col.to_pylist() for col in batch.columns)) for out in _allot(o, w)]
            yield pa.RecordBatch.from_arrays([pa.array(col, k) for col, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names=names)

    return met.join(asked, key).select(*key, "offered", "wants").mapInArrow(run, _OFFERS)


def ranked_offers(found: DataFrame, prices: DataFrame) -> DataFrame:
    """Offers with value (of card|variant, else of the card) and rank: needs first, then dearest, then by card."""
    by = lambda name: prices.select(F.col("key").alias(name), F.col("price").alias(f"p_{name}"))
    own = found.filter("outcome = 'offer'").withColumns({"exact": F.concat_ws("|", "card_id", "variant"), "any": F.col("card_id")})
    valued = own.join(by("exact"), "exact", "left").join(by("any"), "any", "left").withColumn("value", F.coalesce("p_exact", "p_any")).drop("exact", "any", "p_exact", "p_any")
    order = Window.partitionBy("pair").orderBy((F.col("priority") != "need").cast("int"), F.desc(F.coalesce("value", F.lit(0.0))), "card_id", "ordinal")
    return valued.withColumn("rank", F.row_number().over(order))


def fair_trade(sides: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """The rows of sides(pair, side get|give, card_id, ordinal, priority, value) that a balanced trade keeps.

    While one side outweighs the other by more than the tolerance, it gives up the priced item that best closes the
    gap, wants before needs; it never gives up its last item. A pair with an empty side is left as it is. A pair is a row,
    as each step depends on all that is left of it; it has to fit one.
    """

    def balance(rows: list[dict]) -> list[dict]:
        rows = sorted(rows, key=lambda r: (r["side"], r["ordinal"]))
        while True:
            own = {s: [r for r in rows if r["side"] == s] for s in ("get", "give")}
            get, give = (sum(r["value"] or 0.0 for r in own[s]) for s in ("get", "give"))
            gap, top = abs(get - give), max(get, give)
            heavy = own["get" if get > give else "give"]
            if not own["get"] or not own["give"] or top == 0 or gap <= tolerance * top or len(heavy) == 1:
                return rows
            options = [(r["priority"] == "need", abs(gap - r["value"]), r["card_id"], i) for i, r in enumerate(heavy) if r["value"] and abs(gap - r["value"]) < gap]
            if not options:
                return rows
            gone = heavy[min(options)[3]]
            rows = [r for r in rows if r is not gone]

    item = sides.schema.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [balance(rows) for rows in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(kept, batch.schema.field(0).type)], names=["rows"])

    each = sides.groupBy("pair").agg(F.collect_list(F.struct(*sides.columns)).alias("rows")).select("rows")
    return each.mapInArrow(run, f"rows array<{item}>").select(F.explode("rows").alias("r")).select("r.*")


def apply_trade(items: DataFrame, gave: DataFrame, got: DataFrame) -> DataFrame:
    """The items after a trade: for each given copy the first equal pocket goes, what was got is loose.

    gave and got are (collector, card_id, variant, condition). Only pockets of trade binders that aren't kept are
    taken; a given copy without one raises when the result is read.
    """
    same = ["collector", "card_id", "variant", "condition"]
    free = F.coalesce((F.col("binder_type") == "trade") & ~F.col("keep"), F.lit(False))
    order = Window.partitionBy(*same).orderBy("binder_id", "page", "slot")
    asked = gave.groupBy(*same).agg(F.count(F.lit(1)).alias("n"))
    ranked = items.filter(free).withColumn("nth", F.row_number().over(order))  # only free pockets are sorted
    stock = ranked.groupBy(*same).agg(F.count(F.lit(1)).alias("have"))
    checked = asked.join(stock, same, "left").withColumn("n", F.when(F.coalesce("have", F.lit(0)) >= F.col("n"), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("not tradeable: "), "card_id")).cast("long"))).drop("have")
    left = ranked.join(checked, same, "full_outer").filter(F.col("nth").isNotNull() & (F.col("n").isNull() | (F.col("nth") > F.col("n"))))
    loose = got.select("collector", F.lit(None).cast(items.schema["binder_id"].dataType).alias("binder_id"), F.lit(None).cast("string").alias("binder_type"), *same[1:], F.lit(False).alias("keep"), F.lit(0).cast(items.schema["page"].dataType).alias("page"), F.lit(0).cast(items.schema["slot"].dataType).alias("slot"))
    return items.filter(~free).unionByName(left.select(*items.columns)).unionByName(loose.select(*items.columns))


def profile(items: DataFrame, wishes: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What collectors share for a swap: tradeables(collector, card_id, ordinal, variant, condition) and wants(collector,
    card_id, ordinal, variant, min_condition, priority, quantity), each with its place in the collector's list.

    Wishes(collector, ordinal, ...) come before gaps, which are wished for once, in any form, as needs.
    """
    listed = Window.partitionBy("collector").orderBy("_source", "_place", "_binder", "_slot")
    place = F.row_number().over(listed).cast("long").alias("ordinal")
    order = lambda source, at, binder, slot: (F.lit(source).alias("_source"), at.cast("long").alias("_place"), binder.alias("_binder"), slot.cast("long").alias("_slot"))
    null, zero = F.lit(None).cast("string"), F.lit(0)
    columns = ["collector", "card_id", "variant", "min_condition", "priority", "quantity"]
    own = open_wishes(wishes, items).select(*columns, *order(0, F.col("ordinal"), F.lit(None).cast(gaps.schema["binder_id"].dataType), zero))
    needed = gaps.select("collector", "card_id", null.alias("variant"), null.alias("min_condition"), F.lit("need").alias("priority"), F.lit(1).alias("quantity"), *order(1, zero, F.col("binder_id"), F.col("number")))
    wants = own.unionByName(needed).select(*columns, place)
    return _places(tradeables(items, wants.filter("priority = 'need'"))), wants


def _places(free: DataFrame) -> DataFrame:
    """collector, card_id, ordinal, variant, condition of tradeables, in the order of binders, pages and slots."""
    listed = Window.partitionBy("collector").orderBy("binder_id", F.col("page").cast("long") * 1_000_000 + F.col("slot"))
    return free.select("collector", "card_id", F.row_number().over(listed).cast("long").alias("ordinal"), "variant", "condition")


def match(pairs: DataFrame, free: DataFrame, wants: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """offers(pair, side, rank, card_id, variant, condition, priority, value) and near_misses(pair, nth, card_id, variant,
    condition, wanted_variant, wanted_min_condition) of pairs(pair, mine, theirs) of collectors.

    for_me is what they offer and I want, for_them the other way round; both are first fit, copy by copy, and then
    ranked with values of prices(key, price). Near misses of my side come before those of theirs.
    """
    side = lambda name, giver, taker: F.struct(F.lit(name).alias("side"), F.col(giver).alias("giver"), F.col(taker).alias("taker"))
    ways = pairs.select("pair", F.explode(F.array(side("for_me", "theirs", "mine"), side("for_them", "mine", "theirs"))).alias("w")).select(F.concat_ws("|", "w.side", F.col("pair").cast("string")).alias("way"), "w.giver", "w.taker")
    text = F.col("card_id").cast("string").alias("card_id")
    offered = free.join(ways, F.col("collector") == F.col("giver")).select(F.col("way").alias("pair"), text, "ordinal", "variant", "condition")
    asked = wants.join(ways, F.col("collector") == F.col("taker")).select(F.col("way").alias("pair"), text, "ordinal", "variant", "min_condition", "priority", "quantity")
    found = offers(offered, asked)
    apart = {"side": F.substring_index("pair", "|", 1), "pair": F.regexp_replace("pair", r"^[a-z_]+\|", "")}
    good = ranked_offers(found, prices).withColumns(apart).select("pair", "side", "rank", "card_id", "variant", "condition", "priority", "value")
    near = found.filter("outcome = 'near_miss'").withColumns(apart)
    nth = F.row_number().over(Window.partitionBy("pair").orderBy("side", "ordinal"))
    return good, near.select("pair", nth.alias("nth"), "card_id", "variant", "condition", "wanted_variant", "wanted_min_condition")


#: Different cards that are named in a filter, which the sources of items can apply themselves; more are joined.
NAMED = 10_000


def _of_cards(items: DataFrame, cards: DataFrame) -> DataFrame:
    """items of the cards in cards(card_id); where these are few, nothing else is moved to find them."""
    ids = cards.select("card_id").filter("card_id is not null").distinct()
    few = ids.limit(NAMED + 1).collect()
    return items.filter(F.col("card_id").isin([r.card_id for r in few])) if len(few) <= NAMED else items.join(ids, "card_id", "left_semi")


def match_collections(pairs: DataFrame, items: DataFrame, wishes: DataFrame, binders: DataFrame, sets: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """match of the pairs' profiles, straight from what they hold; wishes, binders and sets as in profile and set_gaps.

    A collector lacks far more cards than any partner offers. So gaps are only sought among what the collectors of a
    pair offer, and of that only what the other one wishes for gets a place in a list; the order is that of whole lists.
    """
    both = pairs.select(F.col("mine").alias("collector"), F.col("theirs").alias("partner"))
    both = both.unionAll(both.select(F.col("partner").alias("collector"), F.col("collector").alias("partner"))).distinct()
    offered = items.filter((F.col("binder_type") == "trade") & ~F.col("keep"))
    cards = offered.select("collector", "card_id").join(both, "collector").select(F.explode(F.array("collector", "partner")).alias("collector"), "card_id")
    gaps = gaps_among(cards, binders, sets, items)
    wants = profile(_of_cards(items, wishes), wishes, gaps)[1]
    asked = wants.select(F.col("collector").alias("partner"), "card_id").join(both, "partner").select("collector", "card_id").distinct()
    free = _places(tradeables(offered.join(asked, ["collector", "card_id"], "left_semi"), wants.filter("priority = 'need'")))
    return match(pairs, free, wants, prices)


def _with_plan(rows: DataFrame, plan: str) -> DataFrame:
    """rows with the fields of their plan as p; an unknown plan raises when the result is read."""
    known = rows.sparkSession.createDataFrame(PLANS, PLAN_FIELDS).select(F.col("plan").alias("_plan"), F.struct("*").alias("p"))
    unknown = F.raise_error(F.concat(F.lit("unknown plan: "), F.coalesce(F.col(plan), F.lit("null")))).cast(known.schema["p"].dataType)
    return rows.join(F.broadcast(known), F.col(plan) == F.col("_plan"), "left").withColumn("p", F.coalesce("p", unknown)).drop("_plan")  # two rows


def plan_gate(counts: DataFrame, plan: str = "plan", held: str = "cards_held") -> DataFrame:
    """counts with can_add and remaining, by the limits of the row's plan; a null limit is none."""
    limit = F.col("p.cards")
    out = _with_plan(counts, plan).withColumn("can_add", limit.isNull() | (F.col(held) < limit))
    return out.withColumn("remaining", F.when(limit.isNotNull(), F.greatest(limit - F.col(held), F.lit(0)))).drop("p")


def plan_rules(rows: DataFrame, plan: str = "plan", held: str = "cards_held", binders: str = "binders_held") -> DataFrame:
    """rows with all that their plan allows: can_add_card, can_add_binder, can_add_pages, and shows_ and allows_ columns.

    Pages can be added as long as cards can; what is over a limit stays.
    """
    p = lambda name: F.col(f"p.{name}")
    below = lambda limit, n: limit.isNull() | (F.col(n) < limit)
    card = below(p("cards"), held)
    gates = {"can_add_card": card, "can_add_binder": below(p("binders"), binders), "can_add_pages": card, "shows_values": p("values"), "shows_gap_detail": p("set_gap_detail")}
    gates |= {f"allows_{c}": p(c) for c in ("trading", "backup", "export", "catalog_updates")} | {"trades_shown": p("trade_history")}
    return _with_plan(rows, plan).withColumns(gates).drop("p")


def trade_history(records: DataFrame, shown: int | None) -> DataFrame:
    """Each collector's newest records, at most ``shown`` (none: all), with their rank; equal times in input order."""
    ranked = records.withColumn("rank", F.row_number().over(Window.partitionBy("collector").orderBy(F.desc("completed_at"), "ordinal")))
    return ranked if shown is None else ranked.filter(F.col("rank") <= shown)


def visible_history(records: DataFrame, plan: str = "plan") -> DataFrame:
    """The records of trade_history that each collector's plan shows; none are deleted."""
    return _with_plan(trade_history(records, None), plan).filter(F.col("p.trade_history").isNull() | (F.col("rank") <= F.col("p.trade_history"))).drop("p")


def card_counts(items: DataFrame) -> DataFrame:
    """Copies a collector holds."""
    return items.groupBy("collector").agg(F.count(F.lit(1)).alias("cards_held"))
