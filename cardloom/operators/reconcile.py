"""Reconciliation of two catalogs: which set is which, and where their cards differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .catalog import first_per


def map_sets(ours: DataFrame, theirs: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """our_id, their_id for each of ours that finds a partner: by override, else normalised id, else code and date, else
    name and date. ours(seq, id, name, code, date), theirs(seq, id, name, code, date); each of theirs is claimed once, by
    overrides first and then in the order of ours; who comes too late has none. Codes are compared in lower case, and
    empty ones match nothing. An override to a set that theirs lack counts for nothing.
    """
    last = lambda df, keys: first_per(df, keys, "seq", last=True)
    named = {"nid": T.normal_set_id(F.col("id")), "nname": T.normal_name("name"), "code": F.lower("code")}
    t = theirs.withColumns(named)
    by_id = last(t, ["nid"]).select("nid", F.col("id").alias("t1"))
    by_code = last(t.filter("coalesce(code, '') <> ''"), ["code", "date"]).select("code", "date", F.col("id").alias("t2"))
    by_name = last(t, ["nname", "date"]).select("nname", "date", F.col("id").alias("t3"))
    o = ours.withColumns(named)
    o = o.join(by_id, "nid", "left").join(by_code, ["code", "date"], "left").join(by_name, ["nname", "date"], "left")
    if overrides is not None:
        known = overrides.select(F.col("our_id").alias("id"), F.col("their_id").alias("t0")).join(theirs.select(F.col("id").alias("t0")), "t0", "left_semi")
        o = o.join(known, "id", "left")
    else:
        o = o.withColumn("t0", F.lit(None).cast("string"))
    picked = o.select("seq", F.col("id").alias("our_id"), "t0", F.coalesce("t0", "t1", "t2", "t3").alias("their_id")).filter("their_id is not null")
    claim = F.row_number().over(Window.partitionBy("their_id").orderBy(F.col("t0").isNull().cast("int"), "seq"))
    return picked.withColumn("_nth", claim).filter("_nth = 1 or t0 is not null").select("our_id", "their_id")


def unmatched(ids: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    return ids.join(mapping.select(F.col(column).alias("id")), "id", "left_anti")


def compare_cards(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """kind for each (set_id, number) of ours(seq, set_id, number, name, rarity, and if there id and suffix) and theirs(seq,
    set_id, number, name, rarity), agreements too.

    Numbers are normalised, the last card of a number stands. A name may have ours's suffix at its end; another name
    hides another rarity.
    """
    ours = ours.withColumns({c: F.lit(None).cast("string") for c in ("id", "suffix") if c not in ours.columns})

    def one(df: DataFrame, p: str, *more: str) -> DataFrame:
        last = first_per(df.withColumn("nn", T.normal_number(F.col("number"))), ["set_id", "nn"], "seq", last=True)
        return last.select("set_id", "nn", *(F.col(c).alias(f"{p}_{c}") for c in ("name", "rarity", *more)), F.lit(1).alias(f"{p}_has"))

    both = one(ours, "o", "id", "suffix").join(one(theirs, "t"), ["set_id", "nn"], "full_outer")
    both = both.withColumns({"t_plain": T.normal_name("t_name"), "o_plain": T.normal_name("o_name"), "o_long": T.normal_name(F.concat_ws(" ", "o_name", "o_suffix"))})
    tiers = T.rarity_tier(F.col("o_rarity")), T.rarity_tier(F.col("t_rarity"))
    kind = (
        F.when(F.col("t_has").isNull(), "xcheck_only_in_catalog")
        .when(F.col("o_has").isNull(), "xcheck_missing_from_catalog")
        .when((F.col("t_plain") != F.col("o_plain")) & (F.col("t_plain") != F.col("o_long")), "xcheck_name")
        .when(tiers[0].isNotNull() & tiers[1].isNotNull() & (tiers[0] != tiers[1]), "xcheck_rarity")
        .otherwise("agree")
    )
    return both.select("set_id", F.col("nn").alias("number"), kind.alias("kind"), "o_name", "t_name", "o_rarity", "t_rarity", F.col("o_id").alias("card_id"))


def crosscheck(mapping: DataFrame, our_sets: DataFrame, their_sets: DataFrame, our_cards: DataFrame, their_cards: DataFrame, partner: str) -> DataFrame:
    """scope, ref, kind, detail of all that differs. mapping(our_id, their_id), our_sets(id, printed_total), their_sets(id,
    printed_total), our_cards(seq, set_id, id, number, name, suffix, rarity), their_cards(seq, set_id, number, name,
    rarity), whose set_id are each side's own; partner is how the details call theirs.

    Of a set's cards on one side only there is one row, with the first 15 in reading order.
    """
    issue = lambda df, scope, ref, kind, detail: df.select(F.lit(scope).alias("scope"), F.col(ref).alias("ref"), kind if isinstance(kind, Column) else F.lit(kind).alias("kind"), detail.alias("detail"))
    totals = mapping.join(our_sets.select(F.col("id").alias("our_id"), F.col("printed_total").alias("ours")), "our_id").join(their_sets.select(F.col("id").alias("their_id"), F.col("printed_total").alias("theirs")), "their_id")
    totals = totals.filter("ours > 0 and theirs > 0 and ours <> theirs")
    out = issue(totals, "set", "our_id", "xcheck_printed_total", F.format_string(f"ours %s, {partner} %s", F.col("ours").cast("string"), F.col("theirs").cast("string")))
    mine = our_cards.join(mapping.select(F.col("our_id").alias("set_id")), "set_id", "left_semi")
    other = their_cards.withColumnRenamed("set_id", "their_id").join(mapping, "their_id").withColumnRenamed("our_id", "set_id").drop("their_id")
    found = compare_cards(mine, other)
    one_side = found.filter(F.col("kind").isin("xcheck_only_in_catalog", "xcheck_missing_from_catalog"))
    shown = F.when(F.col("kind") == "xcheck_only_in_catalog", F.col("number")).otherwise(F.concat_ws(" ", "number", "t_name"))
    listed = one_side.groupBy("set_id", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct(T.number_order(F.col("number")).alias("o"), shown.alias("s")))), lambda x: x.s).alias("l"))
    out = out.unionByName(issue(listed, "set", "set_id", F.col("kind"), T.short_list(F.col("l"), 15)))
    for kind, what in (("xcheck_name", "name"), ("xcheck_rarity", "rarity")):
        detail = F.concat(F.lit("ours "), T.quoted(F.col(f"o_{what}")), F.lit(f", {partner} "), T.quoted(F.col(f"t_{what}")))
        out = out.unionByName(issue(found.filter(F.col("kind") == kind), "card", "card_id", kind, detail))
    return out.unionByName(issue(unmatched(our_sets.select("id"), mapping, "our_id"), "set", "id", "xcheck_set_unmatched", F.lit(f"no {partner} set")))


def agreement(compared: DataFrame) -> DataFrame:
    """One row: cards compared, agreeing, and the share."""
    met = compared.filter(~F.col("kind").isin("xcheck_only_in_catalog", "xcheck_missing_from_catalog"))
    return met.agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("kind") == "agree").alias("agree")).withColumn("share", F.when(F.col("compared") > 0, F.col("agree") / F.col("compared")))
