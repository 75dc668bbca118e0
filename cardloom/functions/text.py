"""Column functions for identifiers, names, numbers and printed text of cards."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Conditions from worst to best.
CONDITIONS = ("DMG", "HP", "MP", "LP", "NM")
#: Fields in which a price is looked for, by vendor.
PRICE_FIELDS = {"tcgplayer": ("marketPrice", "midPrice", "directLowPrice", "lowPrice"), "cardmarket": ("avg7", "trend", "avg", "avg30", "low")}
#: Languages that stand in for one another.
FALLBACK = {"en": ("en",), "ja": ("ja", "en")}

#: The forms of collector numbers, as stored, as loosely written, and as read from a print.
_NUMBER = r"^([A-Za-z-]*?)(\d+)([A-Za-z]*)$"
_LOOSE_NUMBER = r"^([A-Za-z]*?)0*(\d+)([A-Za-z]*)$"
_OCR = r"([A-Z]{0,4})\s*(\d{1,3})\s*/\s*([A-Z]{0,4})\s*(\d{2,3})"


def card_key(*parts) -> Column:
    return F.concat_ws("/", *parts)


def number_parts(local_id: Column) -> Column:
    """(prefix, number, suffix); an id of another form is all prefix, with a null number."""
    fits = local_id.rlike(_NUMBER)
    return F.struct(
        F.when(fits, F.regexp_extract(local_id, _NUMBER, 1)).otherwise(local_id).alias("prefix"),
        F.when(fits, F.regexp_extract(local_id, _NUMBER, 2).try_cast("int")).alias("number"),
        F.when(fits, F.regexp_extract(local_id, _NUMBER, 3)).otherwise("").alias("suffix"),
    )


def normal_set_id(set_id: Column) -> Column:
    """Lower case, dots as pt, no zeros between a letter and a digit."""
    return F.regexp_replace(F.replace(F.lower(set_id), F.lit("."), F.lit("pt")), r"(?<=[a-z])0+(?=\d)", "")


def normal_number(number: Column) -> Column:
    """Upper-case prefix, digits without leading zeros, lower-case suffix; other forms unchanged."""
    part = lambda k: F.regexp_extract(number, _LOOSE_NUMBER, k)
    return F.when(number.rlike(_LOOSE_NUMBER), F.concat(F.upper(part(1)), part(2), F.lower(part(3)))).otherwise(number)


@F.pandas_udf(StringType())
def normal_name(names: pd.Series) -> pd.Series:
    """Letters and digits only, without accents, in lower case; a null name is empty."""
    # Signs that stand for words.
    signs = str.maketrans({"’": "'", "δ": "delta", "♀": "f", "♂": "m"})

    def one(name: str | None) -> str:
        bare = "".join(c for c in unicodedata.normalize("NFKD", name or "") if not unicodedata.combining(c))
        return "".join(c for c in bare.lower().translate(signs) if c in "abcdefghijklmnopqrstuvwxyz0123456789")

    return names.map(one)


def rarity_tier(rarity: Column) -> Column:
    """common, uncommon or rare; null for none, an empty text and promos. A text of blanks is rare."""
    low = F.lower(F.btrim(rarity, F.lit(" \t\n\r\x0b\x0c")))
    return F.when(rarity.isNull() | (rarity == "") | (low == "promo"), None).when(low.isin("common", "uncommon"), low).otherwise("rare")


def number_order(number: Column) -> Column:
    """For sorting numbers as they are read: prefix, number, rest; other forms by their text."""
    form = r"^([A-Z]*)(\d+)(.*)$"
    fits = number.rlike(form)
    part = lambda k: F.regexp_extract(number, form, k)
    return F.struct(F.when(fits, part(1)).otherwise(number).alias("prefix"), F.when(fits, part(2).try_cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("n"), F.when(fits, part(3)).otherwise("").alias("rest"))


def quoted(text: Column) -> Column:
    """The text in quotes, double ones if it has single ones only, with backslashes and line ends escaped; null is None."""
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    plain = text
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(raw), F.lit(shown))
    return F.when(text.isNull(), "None").when(single & ~double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def language_of(card_id: Column) -> Column:
    """An id's text before its first slash."""
    return F.substring_index(card_id, "/", 1)


def set_of(card_id: Column) -> Column:
    """An id's text before its last slash; empty without one."""
    return F.regexp_extract(card_id, r"(?s)^(.*)/[^/]*$", 1)


def image_url(base: Column, quality: str, ending: str) -> Column:
    return F.concat(base, F.lit(f"/{quality}.{ending}"))


def price_url(api: str, lang: Column, source_set_id: Column, local_id: Column) -> Column:
    return F.concat(F.lit(f"{api}/"), lang, F.lit("/cards/"), source_set_id, F.lit("-"), local_id)


def variant_key(kind: Column, subtype: Column, stamps: Column, foil: Column, size: Column) -> Column:
    """type[/subtype][+stamp...][@foil][#size], parts in this order, stamps sorted, the standard size left out."""
    part = lambda sign, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(sign), c)).otherwise("")
    stamped = F.array_join(F.transform(F.array_sort(F.coalesce(stamps, F.array().cast("array<string>"))), lambda s: F.concat(F.lit("+"), s)), "")
    return F.concat(kind, part("/", subtype), stamped, part("@", foil), F.when(size != "standard", part("#", size)).otherwise(""))


def localized(texts: Column, lang: str) -> Column:
    """The text in lang or what stands in for it; an empty text counts as missing."""
    return F.coalesce(*(F.nullif(F.try_element_at(texts, F.lit(k)), F.lit("")) for k in FALLBACK[lang]))


def release_date(dates: Column, lang: str) -> Column:
    """Of a map from language to date: that of lang, else the first."""
    return F.coalesce(F.try_element_at(dates, F.lit(lang)), F.try_element_at(F.map_values(dates), F.lit(1)))


def number_label(local_id: Column, total: Column) -> Column:
    return F.when(local_id.isNull() | (local_id == ""), "").when(F.coalesce(total, F.lit(0)) > 0, F.concat(local_id, F.lit("/"), total.cast("string"))).otherwise(local_id)


def level_name(name: Column, stage: Column) -> Column:
    """Names of level-up cards end in LV.X."""
    return F.when((stage == "LEVEL-UP") & ~F.contains(name, F.lit("LV.X")), F.concat(name, F.lit(" LV.X"))).otherwise(name)


def short_list(items: Column, limit: int) -> Column:
    """How many, then the first of them."""
    return F.concat(F.size(items).cast("string"), F.lit(": "), F.array_join(F.slice(items, 1, limit), ", "), F.when(F.size(items) > limit, " …").otherwise(""))


def csv_cell(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n]'), quoted).otherwise(text)


def ocr_number(text: Column) -> Column:
    """(prefix, number, total) of the first collector number in OCR text; all null without one."""
    clean = F.translate(F.upper(text), "O\\|", "0//")
    hit = clean.rlike(_OCR)
    part = lambda k: F.when(hit, F.regexp_extract(clean, _OCR, k))
    return F.struct(part(1).alias("prefix"), part(2).try_cast("int").alias("number"), part(4).try_cast("int").alias("total"))


def condition_rank(condition: Column) -> Column:
    """0 for an unknown condition, which meets no minimum."""
    return F.array_position(F.array(*map(F.lit, CONDITIONS)), condition)


def condition_ok(condition: Column, minimum: Column) -> Column:
    """A null minimum accepts any condition."""
    return minimum.isNull() | ((condition_rank(condition) > 0) & (condition_rank(minimum) > 0) & (condition_rank(condition) >= condition_rank(minimum)))


def first_price(block: Column, vendor: str, suffix: str = "") -> Column:
    """The first numeric field of a JSON object in the vendor's order, of the fields' names with the suffix.

    Only its own fields count, and no numbers in quotes: values are read as variants, whose type tells them apart.
    """
    each = F.try_parse_json(block)

    def number(field: str) -> Column:
        path = f"$['{field}{suffix}']"
        kind = F.schema_of_variant(F.try_variant_get(each, path, "variant"))
        return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(each, path, "double"))

    return F.coalesce(*map(number, PRICE_FIELDS[vendor]))


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, of the text's UTF-8."""
    codes = F.transform(F.filter(F.split(F.hex(F.encode(text, "UTF-8")), "(?<=\\G..)"), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda acc, b: (acc.bitwiseXOR(b) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))


def iso_cutoff(now: str, hours: float) -> Column:
    """now (ISO, UTC) less some hours, as the ISO text that times are stored in."""
    return F.date_format(F.to_timestamp(F.lit(now)) - F.expr(f"make_dt_interval(0, 0, 0, {hours * 3600})"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
