"""Evidence fusion: candidates of a pocket become scores, probabilities and decisions.

Candidates are rows (page, pocket, card_id, set_id, number, visual, number_hit, total_hit, orb).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import first_per, most_common
from .vectors import dot

#: Weights of the evidence, the cap of matched points, and the decision's thresholds.
WEIGHTS = {"visual": 14.0, "number": 3.0, "total": 1.5, "set_prior": 2.0, "sequence": 3.5, "orb": 0.08}
ORB_CAP, CONFIRM, VISUAL_FLOOR, PICKED = 50, 0.90, 0.55, 4
_POCKET = ("page", "pocket")


def candidates(neighbours: DataFrame, reads: DataFrame, catalog: DataFrame, index: DataFrame, queries: DataFrame) -> DataFrame:
    """page, pocket, card_id, set_id, number, visual, number_hit, total_hit, orb: what may be in each pocket.

    neighbours(page, pocket, card_id, visual) are the best by look; cards of catalog(card_id, set_id, number,
    printed_total) with the number and total of reads(page, pocket, number, total) join them, with their own likeness
    if index(card_id, embedding) has them and queries(page, pocket, embedding) the pocket, else 0. Cards that the
    catalog lacks are left out. orb is null until verified.
    """
    read = reads.select(*_POCKET, F.col("number").alias("r_number"), F.col("total").alias("r_total"))
    known = catalog.select("card_id", "set_id", "number", "printed_total")
    like = known.join(read.filter("r_number is not null and r_total > 0"), (F.col("number") == F.col("r_number")) & (F.col("printed_total") == F.col("r_total"))).select(*_POCKET, "card_id")
    extra = like.join(neighbours, [*_POCKET, "card_id"], "left_anti").join(queries.withColumnRenamed("embedding", "q"), list(_POCKET), "left").join(index.select("card_id", F.col("embedding").alias("x")), "card_id", "left")
    extra = extra.select(*_POCKET, "card_id", F.coalesce(dot(F.col("q"), F.col("x")), F.lit(0.0)).alias("visual"))
    every = neighbours.select(*_POCKET, "card_id", "visual").unionByName(extra).join(known, "card_id").join(read, list(_POCKET), "left")
    number_hit = F.coalesce(F.col("number") == F.col("r_number"), F.lit(False))
    total_hit = F.coalesce((F.col("r_total") > 0) & F.col("r_number").isNotNull() & (F.col("printed_total") == F.col("r_total")), F.lit(False))
    return every.select(*_POCKET, "card_id", "set_id", "number", "visual", number_hit.alias("number_hit"), total_hit.alias("total_hit"), F.lit(None).cast("int").alias("orb"))


def raw_score(set_prior: Column, sequence: Column) -> Column:
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    w = WEIGHTS
    return (
        w["visual"] * F.coalesce("visual", F.lit(0.0)) + w["number"] * flag(F.col("number_hit")) + w["total"] * flag(F.col("total_hit"))
        + w["set_prior"] * flag(set_prior) + w["sequence"] * flag(sequence) + w["orb"] * F.least(F.coalesce("orb", F.lit(0)), F.lit(ORB_CAP))
    )


def with_probability(scored: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Softmax of score within each pocket, shifted by its maximum, and the rank with card_id on ties."""
    w = Window.partitionBy(*_POCKET)
    e = F.exp((F.col("score") - F.max("score").over(w)) / temperature)
    ranked = F.row_number().over(w.orderBy(F.desc("score"), "card_id"))
    return scored.withColumn("_e", e).withColumn("probability", F.col("_e") / F.sum("_e").over(w)).withColumn("rank", ranked).drop("_e")


def dominant_set(top: DataFrame, threshold: float = CONFIRM) -> DataFrame:
    """page, dominant: the set of most confident best candidates, if it has two and half of them; ties by first pocket."""
    sure = top.filter(F.col("probability") >= threshold)
    by_set = sure.groupBy("page", "set_id").agg(F.count(F.lit(1)).alias("n"), F.min("pocket").alias("seen"))
    w = Window.partitionBy("page")
    best = by_set.withColumn("all", F.sum("n").over(w)).withColumn("nth", F.row_number().over(w.orderBy(F.desc("n"), "seen")))
    return best.filter((F.col("nth") == 1) & (F.col("n") >= 2) & (F.col("n") * 2 >= F.col("all"))).select("page", F.col("set_id").alias("dominant"))


def slot_order(pocket: Column, rows: int, cols: int, column_major: bool = False) -> Column:
    """A pocket's place in reading order."""
    return F.pmod(pocket, F.lit(cols)) * rows + F.floor(pocket / cols) if column_major else pocket


def page_base(top: DataFrame, order: Column, threshold: float = CONFIRM) -> DataFrame:
    """page, base: the number that pocket 0 would have, by votes of confident pockets; ties by first pocket."""
    votes = top.filter((F.col("probability") >= threshold) & F.col("number").isNotNull()).withColumn("base", F.col("number") - order)
    counted = votes.groupBy("page", "base").agg(F.count(F.lit(1)).alias("n"), F.min("pocket").alias("seen"))
    return counted.withColumn("nth", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("n"), "seen"))).filter("nth = 1").select("page", "base")


def set_page_base(pages: DataFrame, voted: DataFrame) -> DataFrame:
    """page, base of pages(page, start_number, page_index, pockets): fixed by the page's index, else by vote; else no row."""
    fixed = F.col("start_number") + F.col("page_index") * F.col("pockets")
    return pages.join(voted, "page", "left").select("page", F.coalesce(fixed, "base").alias("base")).filter("base is not null")


def passes(candidates: DataFrame, order: Column, explicit: DataFrame | None = None, verified: DataFrame | None = None, best: int = 5) -> DataFrame:
    """Scores without priors, verified, and then with the page's set and sequence.

    verified(page, pocket, card_id, orb) has matched points of photo and card, which count for the best few of each
    pocket only; without it, candidates' own orb counts for all. explicit(page, set_id, base) is what a page's owner
    says: its set goes before the one found, and only there a number is expected (base, or by vote if that is null) of
    cards of that set.
    """
    plain = raw_score(F.lit(0), F.lit(0))
    if verified is not None:
        ranked = with_probability(candidates.withColumn("orb", F.lit(None).cast("int")).withColumn("score", plain))
        points = verified.select(*_POCKET, "card_id", F.col("orb").alias("_points"))
        candidates = ranked.join(points, [*_POCKET, "card_id"], "left").withColumn("orb", F.when(F.col("rank") <= best, F.col("_points"))).drop("_points", "score", "probability", "rank")
    first = with_probability(candidates.withColumn("score", plain)).filter("rank = 1")
    own, base = dominant_set(first), page_base(first, order)
    if explicit is not None:
        given = explicit.select("page", F.col("set_id").alias("given"), F.col("base").alias("given_base"))
        own = own.join(given, "page", "full_outer").select("page", F.coalesce("given", "dominant").alias("dominant"))
        base = given.join(base, "page", "left").select("page", F.coalesce("given_base", "base").alias("base"))
    second = candidates.join(own, "page", "left").join(base, "page", "left")
    in_set = F.coalesce(F.col("set_id") == F.col("dominant"), F.lit(False))
    sequence = F.coalesce(F.col("number") == F.col("base") + order, F.lit(False)) & (in_set if explicit is not None else F.lit(True))
    return with_probability(second.withColumn("score", raw_score(in_set, sequence)))


def decide(ranked: DataFrame, order: Column | None = None, states: DataFrame | None = None) -> DataFrame:
    """The best candidate of each pocket with status and flags; states(page, pocket, state) tells where no card's edges
    were found (unknown). Pockets that are empty by their state have no candidate that counts.
    """
    top = ranked.filter("rank = 1")
    flags = [F.when(F.col("visual") < VISUAL_FLOOR, "low_visual_match")]
    if states is not None:
        top = top.join(states.select(*_POCKET, F.col("state").alias("_state")), list(_POCKET), "left").filter("coalesce(_state, 'card') <> 'empty'")
        flags.append(F.when(F.col("_state") == "unknown", "card_edges_not_found"))
    sure = (F.col("probability") >= CONFIRM) & (F.col("visual") >= VISUAL_FLOOR)
    if order is not None:
        flags.append(F.when(F.col("base").isNotNull() & (F.col("number") != F.col("base") + order), "out_of_order"))
    return top.withColumn("status", F.when(sure, "confirmed").otherwise("review")).withColumn("flags", F.filter(F.array(*flags), lambda f: f.isNotNull())).drop("_state")


def main_numbers(cards: DataFrame) -> DataFrame:
    """card_id for each (set_id, number) of cards(card_id, set_id, number, number_prefix): of the set's main prefix, the first
    card by id on ties.
    """
    main = most_common(cards.filter("number is not null"), ["set_id"], "number_prefix", "card_id").select("set_id", "number_prefix")
    return first_per(cards.join(main, ["set_id", "number_prefix"]), ["set_id", "number"], "card_id").select("set_id", "number", "card_id")


def wish_additions(empty: DataFrame, base: DataFrame, cards: DataFrame, order: Column) -> DataFrame:
    """page, pocket, card_id: the card expected in each empty pocket, where the page's set has that number in its main
    numbering; cards(set_id, number, card_id), with number_prefix if some are numbered apart.
    """
    wanted = empty.join(base, "page").withColumn("number", F.col("base") + order)
    own = main_numbers(cards) if "number_prefix" in cards.columns else cards.select("set_id", "number", "card_id")
    return wanted.join(own, ["set_id", "number"]).select("page", "pocket", "card_id")


def result_json(pockets: DataFrame) -> DataFrame:
    """page, json: a page's result as JSON text, pockets in order; pockets(page, pocket, state, status, card_id, probability,
    flags).
    """
    one = F.struct("pocket", "state", "status", "card_id", "probability", "flags")
    listed = pockets.groupBy("page").agg(F.array_sort(F.collect_list(one)).alias("slots"))  # a page has a few pockets
    return listed.select("page", F.to_json(F.struct("page", "slots"), {"ignoreNullFields": "false"}).alias("json"))
