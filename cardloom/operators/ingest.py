"""Incremental ingestion: what to fetch, how results replace what is stored, and how complete it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def refresh_plan(catalog: DataFrame, log: DataFrame, cutoff: str, langs: tuple[str, ...] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of catalog(card_id, ...) without a fetch since cutoff that didn't end in an error, by card_id.

    log(card_id, status, fetched_at): times are ISO texts and compared as such; nodata counts as fetched. langs keeps
    languages (column lang); the limit counts what is left to be fetched.
    """
    fresh = log.filter((F.col("fetched_at") >= cutoff) & (F.col("status") != "error")).select("card_id").distinct()
    wanted = catalog if langs is None else catalog.filter(F.col("lang").isin(*langs))
    return _first(wanted.join(fresh, "card_id", "left_anti"), limit)


def _first(plan: DataFrame, limit: int | None) -> DataFrame:
    """In order of card_id where a limit makes that matter; else it would be sorted for nothing."""
    return plan if limit is None else plan.orderBy("card_id").limit(limit)


def image_plan(catalog: DataFrame, manifest: DataFrame, files: DataFrame, retry_errors: bool = False, langs: tuple[str, ...] | None = None, sets: tuple[str, ...] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of catalog(card_id, url) whose image is still to be had, by card_id up to the limit.

    manifest(card_id, status, path, bytes) says what became of each; ok holds only while files(path, length) has the
    path with that length, or with any above 0 where none was noted; missing is final; errors are retried if asked.
    langs and sets (columns lang, set_id) keep part of the catalog.
    """
    wanted = catalog
    for column, only in (("lang", langs), ("set_id", sets)):
        wanted = wanted if only is None else wanted.filter(F.col(column).isin(*only))
    seen = manifest.join(files.select("path", "length"), "path", "left")
    whole = (F.col("length") > 0) & (F.col("bytes").isNull() | (F.col("length") == F.col("bytes")))
    done = (F.col("status") == "missing") | ((F.col("status") == "ok") & whole) | ((F.col("status") == "error") & F.lit(not retry_errors))
    return _first(wanted.join(seen.filter(done).select("card_id").distinct(), "card_id", "left_anti"), limit)


def with_images(cards: DataFrame, manifest: DataFrame) -> DataFrame:
    """Cards of (card_id, ...) that have an image, with its path; manifest(card_id, status, path)."""
    return cards.join(manifest.filter("status = 'ok'").select("card_id", "path"), "card_id")


def large_sets(cards: DataFrame, least: int = 12) -> DataFrame:
    """The cards of (set_id, card_id, ...) whose set has at least so many of them."""
    big = cards.groupBy("set_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("set_id")
    return cards.join(big, "set_id", "left_semi")


def numbered(cards: DataFrame) -> DataFrame:
    """The cards whose local_id is digits only."""
    return cards.filter(F.col("local_id").rlike("^[0-9]+$"))


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n of the rows without replacement, the same for a seed however they are spread: the first by a hash of seed and key."""
    return rows.orderBy(F.crc32(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old and new with the last row of each key by order; on equal order the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new")))
    return both.withColumn("_nth", nth).filter("_nth = 1").drop("_nth", "_new")


def replace_kinds(old: DataFrame, new: DataFrame, prefix: str) -> DataFrame:
    """old without the kinds that begin with prefix, and new: a rerun replaces what it wrote before."""
    return old.filter(~F.col("kind").startswith(prefix)).unionByName(new)


def price_rows(blocks: DataFrame) -> DataFrame:
    """card_id, variant, source, usd, eur, updated of blocks(card_id, pricing): JSON text with an object for each vendor.

    tcgplayer has an object for each variant; what isn't an object is skipped. cardmarket has numbers by field, those of
    foils with the suffix -holo, which become the variant any-foil. Variants without a price give no row.
    """
    part = lambda vendor: F.get_json_object("pricing", f"$.{vendor}")
    t = blocks.select("card_id", part("tcgplayer").alias("t")).select("card_id", F.get_json_object("t", "$.updated").alias("updated"), F.explode(F.from_json("t", "map<string,string>")).alias("variant", "v"))
    none = F.lit(None).cast("double")
    t = t.filter(F.trim("v").startswith("{")).select("card_id", "variant", F.lit("tcgplayer").alias("source"), T.first_price(F.col("v"), "tcgplayer").alias("usd"), none.alias("eur"), "updated")
    c = blocks.select("card_id", part("cardmarket").alias("c"))
    found = F.array(*(F.struct(F.lit(variant).alias("variant"), T.first_price(F.col("c"), "cardmarket", suffix).alias("eur")) for variant, suffix in (("normal", ""), ("any-foil", "-holo"))))
    c = c.select("card_id", F.get_json_object("c", "$.updated").alias("updated"), F.explode(found).alias("p")).select("card_id", "p.variant", F.lit("cardmarket").alias("source"), none.alias("usd"), "p.eur", "updated")
    return t.unionByName(c).filter("usd is not null or eur is not null")


def price_results(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prices, and a log(card_id, status, http_status, fetched_at), of fetched(card_id, status, http_status, body, fetched_at).

    An answer without any price is nodata, as is one that the vendor doesn't know; a body that isn't JSON is an error.
    """
    text = F.col("body").cast("string")
    read = fetched.select("card_id", "status", "http_status", "fetched_at", F.get_json_object(text, "$.pricing").alias("pricing"), F.try_parse_json(text).isNotNull().alias("read"))
    prices = price_rows(read.filter("status = 'ok' and read")).join(read.select("card_id", "fetched_at"), "card_id")
    some = prices.select("card_id").distinct().withColumn("priced", F.lit(True))
    answered = F.when(~F.col("read"), "error").when(F.col("priced"), "ok").otherwise("nodata")
    log = read.join(some, "card_id", "left").select("card_id", F.when(F.col("status") == "ok", answered).otherwise(F.col("status")).alias("status"), F.when((F.col("status") != "ok") | F.col("read"), F.col("http_status")).alias("http_status"), "fetched_at")
    return prices, log


def coverage(attempted: DataFrame, prices: DataFrame) -> DataFrame:
    """One row: cards attempted, with a price from each source, from any, and from none."""
    per = attempted.select("card_id").distinct().join(prices.groupBy("card_id").agg(F.count_if(F.col("source") == "tcgplayer").alias("t"), F.count_if(F.col("source") == "cardmarket").alias("c")), "card_id", "left")
    return per.agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("t") > 0).alias("tcgplayer"), F.count_if(F.col("c") > 0).alias("cardmarket"),
        F.count_if((F.col("t") > 0) | (F.col("c") > 0)).alias("any_source"), F.count_if(F.col("t").isNull()).alias("no_price"),
    )


def status_summary(log: DataFrame, group: str, statuses: tuple[str, ...], gate: float) -> DataFrame:
    """For each group the number of each status, the error rate, and whether it is within the gate."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses]
    out = log.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *counts, F.avg((F.col("status") == "error").cast("double")).alias("error_rate"))
    return out.withColumn("passes", F.col("error_rate") <= gate)


def missing_by_set(images: DataFrame, top: int, absent: str = "missing") -> DataFrame:
    """set_id, missing, total of the sets with most images that the source doesn't have."""
    per = images.groupBy("set_id").agg(F.count_if(F.col("status") == absent).alias("missing"), F.count(F.lit(1)).alias("total"))
    return per.filter("missing > 0").orderBy(F.desc("missing"), "set_id").limit(top)
