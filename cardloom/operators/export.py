"""Exports whose bytes are fixed: JSON packs, wish lists as CSV and as text, Markdown tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: The columns of the CSV export.
CSV_COLUMNS = ("card_id", "name", "set", "number", "priority", "source", "quantity", "owned_elsewhere")
_LAST = 1 << 30
#: Fixed value: of the catalog's tables and packs.
SCHEMA_VERSION = 1


def wish_rows(wishes: DataFrame, meta: DataFrame) -> DataFrame:
    """wishes(collector, ordinal, card_id, priority, source, quantity, owned_elsewhere) with name, set and number."""
    own = meta.select("card_id", F.col("name"), F.col("set_name").alias("set"), F.col("number_label").alias("number"))
    return wishes.join(own, "card_id", "left").fillna("", ["name", "set", "number"])


def wishlist_csv(wishes: DataFrame, meta: DataFrame) -> DataFrame:
    """collector, csv: a header and a line for each wish in order, each line ended."""
    r = wish_rows(wishes, meta).withColumn("owned_elsewhere", F.array_join("owned_elsewhere", ";")).withColumn("quantity", F.col("quantity").cast("string"))
    line = F.concat_ws(",", *(T.csv_cell(F.col(c)) for c in CSV_COLUMNS))
    lines = r.groupBy("collector").agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("l"))
    return lines.select("collector", F.concat(F.lit(",".join(CSV_COLUMNS) + "\n"), F.array_join(F.transform("l", lambda x: x.line), "\n"), F.lit("\n")).alias("csv"))


def wishlist_text(collectors: DataFrame, wishes: DataFrame, meta: DataFrame, set_name: str | None = None) -> DataFrame:
    """collector, text for every one of collectors; without wishes it says that nothing is missing, without a line end."""
    r = wish_rows(wishes, meta)
    bits = F.array_join(F.filter(F.array("name", "number"), lambda x: x != ""), " ")
    line = F.concat(F.lit("  "), F.when(bits == "", F.col("card_id").cast("string")).otherwise(bits))
    if not set_name:
        line = F.concat(line, F.when(F.col("set") != "", F.concat(F.lit(" ("), "set", F.lit(")"))).otherwise(""))
    line = F.concat(line, F.when(F.col("quantity") > 1, F.concat(F.lit(" x"), F.col("quantity").cast("string"))).otherwise(""), F.when(F.size("owned_elsewhere") > 0, "  [have a copy elsewhere]").otherwise(""))
    lines = r.groupBy("collector").agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("l"))
    head = F.concat(F.lit(f"{set_name} — need " if set_name else "Need "), F.size("l").cast("string"), F.lit(":\n"))
    text = F.concat(head, F.array_join(F.transform("l", lambda x: x.line), "\n"), F.lit("\n"))
    return collectors.select("collector").distinct().join(lines, "collector", "left").select("collector", F.when(F.col("l").isNull(), "Nothing missing.").otherwise(text).alias("text"))


def _sorted(*columns: str) -> Column:
    """A struct whose fields come in alphabetical order, as keys do in a pack."""
    return F.struct(*sorted(columns))


#: What a pack has of each card and variant.
_CARD = ("id", "local_id", "number", "name", "rarity", "category", "image_base")
_VARIANT = ("variant_key", "type", "stamps", "foil", "size", "tcgplayer_id")
_SET = ("id", "lang", "source_set_id", "serie_id", "serie_name", "name", "name_en", "printed_total", "number_prefix", "release_date", "abbreviation", "tcgplayer_group_id", "cardmarket_id", "card_count")


def pruned_variant() -> Column:
    """JSON of a variant without keys whose value is null or an empty list."""
    fields = [(F.when(F.size(c) > 0, F.col(c)) if c == "stamps" else F.col(c)).alias(c) for c in sorted(_VARIANT)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})


def json_packs(sets: DataFrame, cards: DataFrame, variants: DataFrame) -> DataFrame:
    """id, lang, source_set_id, name, release_date, card_count, path, body, sha256 for each set of a built catalog.

    A body's keys are sorted, nulls kept but in variants, cards in printed order: prefix, number (none last), suffix, id. A
    set with all its cards is one row.
    """
    own = variants.groupBy(F.col("card_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", pruned_variant().alias("json")))).alias("v"))
    listed = F.concat(F.lit(',"variants":['), F.array_join(F.transform(F.coalesce("v", F.array().cast("array<struct<pos:int,json:string>>")), lambda x: x.json), ","), F.lit("]}"))
    plain = F.to_json(_sorted(*_CARD), {"ignoreNullFields": "false"})  # variants come last in the alphabet
    place = F.struct("number_prefix", F.coalesce("number", F.lit(_LAST)).alias("n"), "number_suffix", F.col("local_id").alias("l"))
    each = cards.join(own, "id", "left").select(F.col("set_id").alias("id"), F.struct(place.alias("place"), F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), listed).alias("json")).alias("c"))
    packed = each.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.json), ",").alias("cards"))
    body = F.concat(F.lit('{"cards":['), F.coalesce("cards", F.lit("")), F.lit('],"set":'), F.to_json(_sorted(*_SET), {"ignoreNullFields": "false"}), F.lit("}"))
    out = sets.join(packed, "id", "left").select("id", "lang", "source_set_id", "name", "release_date", "card_count", F.concat("lang", F.lit("/"), "source_set_id", F.lit(".json")).alias("path"), body.alias("body"))
    return out.withColumn("sha256", F.sha2("body", 256))


def write_packs(packs: DataFrame, out: str, meta: dict[str, str], most: int = 100_000) -> None:
    """Packs as text below out, a folder for each language and set, and index.json, which the driver writes.

    The index holds a line for each set; of more than ``most`` sets it is refused.
    """
    packs.select("lang", "source_set_id", "body").write.mode("overwrite").partitionBy("lang", "source_set_id").text(out)
    rows = packs.select("id", "name", "release_date", "card_count", "path", "sha256").orderBy("id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sets are too many for one index")
    index = {"schema_version": SCHEMA_VERSION, **meta, "sets": [r.asDict() for r in rows]}
    sc = packs.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(out, "index.json")
    stream = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(json.dumps(index, ensure_ascii=False, indent=1).encode()))
    finally:
        stream.close()


def write_catalog(sets: DataFrame, cards: DataFrame, variants: DataFrame, issues: DataFrame, out: str, meta: dict[str, str]) -> None:
    """A built catalog as tables below out, in place of what was there; meta is a table of keys and values, with the schema's
    version.
    """
    spark = sets.sparkSession
    known = spark.createDataFrame([("schema_version", str(SCHEMA_VERSION)), *sorted(meta.items())], "key string, value string").coalesce(1)
    for name, df in (("sets", sets), ("cards", cards), ("variants", variants), ("issues", issues), ("meta", known)):
        df.write.mode("overwrite").parquet(f"{out}/{name}")


def write_labels(pages: DataFrame, out: str) -> None:
    """Labelled pages(photo, layout, set_mode, slots, ...) as JSON, a line each, nulls in slots kept."""
    pages.write.mode("overwrite").option("ignoreNullFields", "false").json(out)


def write_results(pages: DataFrame, out: str) -> None:
    """JSON of pages(page, json), a line each, in order of page."""
    pages.select("page", "json").orderBy("page").select("json").write.mode("overwrite").text(out)
