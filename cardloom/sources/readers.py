"""Readers with fixed schemas for the JSON the pipeline takes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TEXTS = "map<string,string>"
RECORD = (
    "source struct<repo:string,path:string>, lang string, localId string, serie struct<id:string,name:map<string,string>>, "
    "set struct<id:string,name:map<string,string>,cardCount:struct<official:int>,releaseDate:string,abbreviations:struct<official:string>,thirdParty:struct<tcgplayer:bigint,cardmarket:bigint>,tcgOnline:string>, "
    "card struct<name:map<string,string>,rarity:string,category:string,hp:int,types:array<string>,stage:string,suffix:string,illustrator:string,regulationMark:string,dexId:array<int>,variants:string>"
)
ITEM = "struct<card_id:string,variant:string,condition:string,keep:boolean>"
COLLECTION = f"collector string, binders array<struct<id:string,name:string,type:string,rows:int,cols:int,set_id:string,include_secrets:boolean,pages:array<array<{ITEM}>>>>, loose array<{ITEM}>"
LABELS = "name string, photo string, layout array<int>, set_mode struct<set_id:string,start_number:int,page_index:int,slot_order:string>, slots array<string>, expected_wishes array<string>"


def catalog_records(spark: SparkSession, path: str, langs: tuple[str, ...] = ("en", "ja"), excluded_series: tuple[str, ...] = ("tcgp",)) -> DataFrame:
    """One row for each record of newline-delimited JSON and each of langs in which its card has a name; no rows is an error.

    A record with a lang of its own stands for that language only. Records of excluded series go. Objects and lists in
    variants stay JSON text. seq is the input order: file name, place in the file, place in langs.
    """
    raw = spark.read.schema(RECORD).json(path).select("*", F.col("_metadata.file_path").alias("_file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("_place"))
    if raw.isEmpty():
        raise ValueError(f"no records in {path}")
    places = {lang: i for i, lang in enumerate(langs)}
    every = raw.filter(~F.coalesce(F.col("serie.id").isin(*excluded_series), F.lit(False))).withColumn("_lang", F.explode(F.array(*map(F.lit, langs))))
    own = every.filter((F.col("lang").isNull() | (F.col("lang") == F.col("_lang"))) & (F.coalesce(F.try_element_at("card.name", "_lang"), F.lit("")) != ""))
    nth = F.create_map(*(F.lit(x) for kv in places.items() for x in kv))[F.col("_lang")]
    return own.withColumn("lang", F.col("_lang")).withColumn("seq", F.struct("_file", "_place", nth.alias("nth"))).drop("_lang", "_file", "_place")


def _array(spark: SparkSession, path: str, item: str) -> DataFrame:
    """_file, _at and the fields of item: the elements of JSON arrays, a file each, with their places."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.from_json("value", f"array<struct<{item}>>").alias("l"))
    return raw.select("_file", F.posexplode("l").alias("_at", "r")).select(F.struct("_file", "_at").alias("seq"), "_file", "r.*")


def partner_sets(spark: SparkSession, path: str) -> DataFrame:
    """seq, id, name, printed_total, code, date of a JSON array of sets; seq is file name and place."""
    raw = _array(spark, path, "id:string,name:string,printedTotal:int,ptcgoCode:string,releaseDate:string")
    return raw.select("seq", "id", "name", F.col("printedTotal").alias("printed_total"), F.col("ptcgoCode").alias("code"), F.replace("releaseDate", F.lit("/"), F.lit("-")).alias("date"))


def partner_cards(spark: SparkSession, path: str) -> DataFrame:
    """seq, set_id, number, name, rarity; the set is the file's name without its ending."""
    raw = _array(spark, path, "number:string,name:string,rarity:string")
    return raw.select("seq", F.url_decode(F.regexp_extract("_file", r"([^/]+)\.json$", 1)).alias("set_id"), "number", "name", "rarity")


def collections(spark: SparkSession, path: str) -> DataFrame:
    """Nested collections; keys that are missing are null here and get their defaults in pockets()."""
    return spark.read.option("multiLine", True).schema(COLLECTION).json(path)


def labelled_pages(spark: SparkSession, path: str) -> DataFrame:
    """photo, layout, pocket, truth: a row for each pocket; truth is null for an empty one."""
    raw = spark.read.option("multiLine", True).schema(LABELS).json(path)
    return raw.select("photo", "layout", "set_mode", F.posexplode("slots").alias("pocket", "truth"))


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files, read where they lie."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
