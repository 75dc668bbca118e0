"""Catalog normalisation and its quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def first_per(rows: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """The first row of each key by order (or the last)."""
    by = F.desc(order) if last else F.asc(order)
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).filter("_nth = 1").drop("_nth")


def duplicates(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All rows of a key but the first."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_nth > 1").drop("_nth")


def most_common(rows: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """group, value, n: the most frequent value, the first seen on ties."""
    counted = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_seen"))
    best = counted.withColumn("_nth", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "_seen")))
    return best.filter("_nth = 1").select(*group, value, "n")


def main_prefixes(cards: DataFrame, order: str) -> DataFrame:
    """set_id, number_prefix: each set's most frequent prefix among numbered cards, the first seen on ties."""
    return most_common(cards.filter("number is not null"), ["set_id"], "number_prefix", order).select("set_id", "number_prefix")


def missing_numbers(sets: DataFrame, cards: DataFrame, order: str = "number") -> DataFrame:
    """set_id, printed_total, missing (sorted numbers) of sets(set_id, printed_total) that lack some of 1..printed_total.

    cards(set_id, number, number_prefix) count only with their set's main prefix. Sets without a total are left out.
    """
    have = cards.join(main_prefixes(cards.withColumn("_o", F.col(order)), "_o"), ["set_id", "number_prefix"]).select("set_id", "number").distinct()
    wanted = sets.filter("printed_total >= 1").select("set_id", "printed_total", F.explode(F.sequence(F.lit(1), F.col("printed_total"))).alias("number"))
    gone = wanted.join(have, ["set_id", "number"], "left_anti")
    return gone.groupBy("set_id", "printed_total").agg(F.array_sort(F.collect_list("number")).alias("missing"))


def missing_number_issues(sets: DataFrame, cards: DataFrame, order: str = "number") -> DataFrame:
    """scope, ref, kind, detail: sets without a printed total, with the number of their cards; numbers that are missing, 20
    of them shown.
    """
    n = cards.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    none = sets.filter("coalesce(printed_total, 0) = 0").join(n, "set_id", "left")
    none = none.select(F.lit("set").alias("scope"), F.col("set_id").alias("ref"), F.lit("missing_printed_total").alias("kind"), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" cards present")).alias("detail"))
    shown = F.array_join(F.slice(F.col("missing").cast("array<string>"), 1, 20), ", ")
    detail = F.concat(F.size("missing").cast("string"), F.lit("/"), F.col("printed_total").cast("string"), F.lit(" missing: "), shown, F.when(F.size("missing") > 20, " …").otherwise(""))
    some = missing_numbers(sets, cards, order).select(F.lit("set").alias("scope"), F.col("set_id").alias("ref"), F.lit("missing_numbers").alias("kind"), detail.alias("detail"))
    return some.unionByName(none)


def card_issues(cards: DataFrame, n_variants: Column) -> DataFrame:
    """scope, ref, kind, detail of cards(id, name, rarity): missing names and rarities, no variants."""
    kinds = F.filter(
        F.array(
            F.when(F.coalesce("name", F.lit("")) == "", "missing_name"),
            F.when(n_variants == 0, "no_variants"),
            F.when(F.col("rarity").isNull() | (F.col("rarity") == "None"), "missing_rarity"),
        ),
        lambda k: k.isNotNull(),
    )
    return cards.select(F.lit("card").alias("scope"), F.col("id").alias("ref"), F.explode(kinds).alias("kind"), F.lit("").alias("detail"))


def distinct_variants(variants: DataFrame) -> DataFrame:
    """variants(card_id, key, pos, market_id): the first of each key, with the later ones' ids as alt_ids (null if none)."""
    by = Window.partitionBy("card_id", "key").orderBy("pos")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = variants.withColumn("_nth", F.row_number().over(by)).withColumn("_ids", F.collect_list(F.struct("pos", "market_id")).over(whole))
    rest = F.transform(F.slice("_ids", 2, F.greatest(F.size("_ids"), F.lit(1))), lambda s: s.market_id)
    return ranked.filter("_nth = 1").withColumn("alt_ids", F.when(F.size("_ids") > 1, rest)).drop("_nth", "_ids")


#: What a variant has besides its key, and where images are.
_VARIANT = "type:string,subtype:string,stamp:array<string>,foil:string,size:string,languages:array<string>,thirdParty:struct<tcgplayer:bigint,cardmarket:bigint>"
ASSETS = "https://assets.tcgdex.net"


def listed_variants(raw: Column, lang: Column) -> Column:
    """Variants of JSON text as structs (type, subtype, stamps, foil, size, tcgplayer_id, cardmarket_id).

    A list is taken as it stands, less what isn't for this language. Anything else counts as an object of legacy flags,
    none if there is no text; normal is on unless it is there and off.
    """
    empty = F.array().cast("array<string>")
    null = lambda kind: F.lit(None).cast(kind)

    def shape(kind: Column, subtype: Column, stamps: Column, foil: Column, size: Column, a: Column, b: Column) -> Column:
        return F.struct(kind.alias("type"), subtype.alias("subtype"), stamps.alias("stamps"), foil.alias("foil"), size.alias("size"), a.alias("tcgplayer_id"), b.alias("cardmarket_id"))

    detailed = F.filter(F.from_json(raw, f"array<struct<{_VARIANT}>>"), lambda v: (F.coalesce(F.size(v.languages), F.lit(0)) <= 0) | F.array_contains(v.languages, lang))
    detailed = F.transform(detailed, lambda v: shape(v.type, v.subtype, F.coalesce(v.stamp, empty), v.foil, F.coalesce(F.nullif(v.size, F.lit("")), F.lit("standard")), v.thirdParty.tcgplayer, v.thirdParty.cardmarket))
    flags = F.from_json(F.coalesce(raw, F.lit("{}")), "map<string,string>")
    on = lambda k: F.coalesce(F.try_element_at(flags, F.lit(k)).isin("true", "1"), F.lit(False))
    normal = on("normal") | ~F.coalesce(F.map_contains_key(flags, "normal"), F.lit(False))
    first = on("firstEdition")
    each = [(normal, "normal", None), (normal & first, "normal", "1st-edition"), (normal & on("wPromo"), "normal", "w-promo"), (on("reverse"), "reverse", None), (on("reverse") & first, "reverse", "1st-edition"), (on("holo"), "holo", None), (on("holo") & first, "holo", "1st-edition")]
    made = [F.when(c, shape(F.lit(k), null("string"), empty if s is None else F.array(F.lit(s)), null("string"), F.lit("standard"), null("bigint"), null("bigint"))) for c, k, s in each]
    return F.when(F.substring(F.ltrim(raw), 1, 1) == "[", detailed).otherwise(F.filter(F.array(*made), lambda v: v.isNotNull()))


def variants_of(cards: DataFrame) -> DataFrame:
    """card_id, pos, variant_key and the variant's fields, with alt_ids, for cards(id, lang, raw): the first of each key."""
    each = cards.select(F.col("id").alias("card_id"), F.posexplode(listed_variants(F.col("raw"), F.col("lang"))).alias("pos", "v"))
    keyed = each.select("card_id", "pos", T.variant_key(F.col("v.type"), F.col("v.subtype"), F.col("v.stamps"), F.col("v.foil"), F.col("v.size")).alias("key"), "v.*")
    one = distinct_variants(keyed.withColumn("market_id", F.struct("tcgplayer_id", "cardmarket_id")))
    return one.select("card_id", "pos", F.col("key").alias("variant_key"), "type", "subtype", "stamps", "foil", "size", "tcgplayer_id", "cardmarket_id", "alt_ids")


def build(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """sets, cards, variants and issues of records(seq, source, lang, localId, serie, set, card) as they are read.

    The first record of a card and of a set wins; later ones of a card are duplicates. seq may be anything that sorts.
    """
    lang = F.col("lang")
    named = lambda texts: F.when(lang == "ja", T.localized(texts, "ja")).otherwise(T.localized(texts, "en"))
    rows = records.withColumns({"id": T.card_key("lang", "set.id", "localId"), "set_key": T.card_key("lang", "set.id")})
    issue = lambda df, scope, kind, detail: df.select(F.lit(scope).alias("scope"), F.col("id").alias("ref"), F.lit(kind).alias("kind"), detail.alias("detail"))
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("seq")))
    first = ranked.filter("nth = 1").withColumn("parts", T.number_parts(F.col("localId"))).withColumn("plain", named(F.col("card.name")))
    rarity = F.col("card.rarity")
    cards = first.select(
        "seq", "id", "lang", F.col("set_key").alias("set_id"), F.col("localId").alias("local_id"), F.col("parts.prefix").alias("number_prefix"), F.col("parts.number").alias("number"), F.col("parts.suffix").alias("number_suffix"),
        T.level_name(F.col("plain"), F.coalesce("card.stage", F.lit(""))).alias("name"), T.localized(F.col("card.name"), "en").alias("name_en"), F.nullif(F.nullif(rarity, F.lit("None")), F.lit("")).alias("rarity"), "card.category", "card.hp",
        F.coalesce("card.types", F.array().cast("array<string>")).alias("types"), "card.stage", "card.suffix", "card.illustrator", F.col("card.regulationMark").alias("regulation_mark"), F.coalesce("card.dexId", F.array().cast("array<int>")).alias("dex_ids"),
        F.concat_ws("/", F.lit(ASSETS), "lang", "serie.id", "set.id", "localId").alias("image_base"), F.col("source.path").alias("source_path"), F.col("card.variants").alias("raw"), rarity.alias("given_rarity"),
    )
    date = F.col("set.releaseDate")
    by_lang = F.from_json(date, "map<string,string>")
    total = F.nullif(F.col("set.cardCount.official"), F.lit(0))
    sets = first_per(rows, ["set_key"], "seq").select(
        F.col("set_key").alias("id"), "lang", F.col("set.id").alias("source_set_id"), F.col("serie.id").alias("serie_id"), named(F.col("serie.name")).alias("serie_name"), named(F.col("set.name")).alias("name"), T.localized(F.col("set.name"), "en").alias("name_en"),
        total.alias("printed_total"), F.when(F.substring(F.ltrim(date), 1, 1) == "{", F.when(lang == "ja", T.release_date(by_lang, "ja")).otherwise(T.release_date(by_lang, "en"))).otherwise(date).alias("release_date"),
        F.coalesce(F.nullif("set.abbreviations.official", F.lit("")), "set.tcgOnline").alias("abbreviation"), F.col("set.thirdParty.tcgplayer").alias("tcgplayer_group_id"), F.col("set.thirdParty.cardmarket").alias("cardmarket_id"),
    )
    counts = cards.groupBy(F.col("set_id").alias("id")).agg(F.count(F.lit(1)).alias("card_count"))
    prefixes = main_prefixes(cards, "seq").withColumnRenamed("set_id", "id")
    sets = sets.join(counts, "id", "left").join(prefixes, "id", "left").withColumns({"card_count": F.coalesce("card_count", F.lit(0)), "number_prefix": F.when(F.col("printed_total").isNotNull(), F.coalesce("number_prefix", F.lit(""))).otherwise("")})
    variants = variants_of(cards.select("id", "lang", "raw"))
    issues = issue(ranked.filter("nth > 1"), "card", "duplicate", F.col("source.path"))
    issues = issues.unionByName(issue(sets.filter("coalesce(name, '') = ''"), "set", "missing_name", F.format_string("no %s or fallback name", lang)))
    issues = issues.unionByName(issue(cards.filter(F.size(listed_variants(F.col("raw"), F.col("lang"))) <= 0), "card", "no_variants", F.lit("no printable variant for this language")))
    issues = issues.unionByName(issue(cards.filter("given_rarity is null or given_rarity = 'None'"), "card", "missing_rarity", F.lit("")))
    issues = issues.unionByName(missing_number_issues(sets.select(F.col("id").alias("set_id"), "printed_total"), cards.select("set_id", "number", "number_prefix", "seq"), "seq"))
    return sets, cards.drop("seq", "raw", "given_rarity"), variants, issues


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
