"""Queries of the catalog: it is built from parts, priced, packed, and compared with another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, export, ingest, reconcile
from . import roles
from .base import query
from .roles import table, with_roles

_LISTED = '[{"type":"holo","languages":["ja"]},{"type":"normal","stamp":["w","a"],"thirdParty":{"tcgplayer":7}},{"type":"normal","stamp":["a","w"],"thirdParty":{"tcgplayer":8,"cardmarket":9}},{"type":"reverse","foil":"ball","size":"jumbo"}]'
_FLAGS = {1: '{"holo":true,"firstEdition":true,"normal":false}', 3: '{"reverse":true,"wPromo":true,"holo":false}', 4: '[{"type":"holo","languages":["ja"]}]'}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records, every third one in Japanese; numbers recur, so that later ones are duplicates."""
    k, size = F.col("p_partkey"), F.col("p_size")
    lang = F.when(k % 3 == 0, "ja").otherwise("en")
    raw = F.when(size % 5 == 2, _LISTED)
    for m, text in _FLAGS.items():
        raw = raw.when(size % 5 == m, text)
    local = F.concat(F.when(k % 7 == 0, "TG").otherwise(""), (k % 60 + 1).cast("string"))
    names = F.when(k % 11 == 0, F.create_map(F.lit("ja"), F.lit(""), F.lit("en"), F.lit(""))).otherwise(F.create_map(F.lit("en"), F.col("p_name")))
    date = F.when(k % 2 == 0, '{"en":"2020-01-02","ja":"2020-03-04"}').otherwise("2021-05-06")
    zero = F.lit(None)
    return table(spark, sf_dir, "part").select(
        k.alias("seq"), F.struct(F.lit("r").alias("repo"), F.concat(k.cast("string"), F.lit(".ts")).alias("path")).alias("source"), lang.alias("lang"), local.alias("localId"),
        F.struct(F.lit("s").alias("id"), F.create_map(F.lit("en"), F.lit("S")).alias("name")).alias("serie"),
        F.struct(F.col("p_brand").alias("id"), F.when(F.col("p_brand") == "Brand#3", F.create_map(F.lit("fr"), F.lit("x"))).otherwise(F.create_map(F.lit("en"), F.concat(F.lit("Set "), "p_brand"))).alias("name"), F.struct(F.when(F.col("p_brand") == "Brand#4", 0).otherwise(50).alias("official")).alias("cardCount"), date.alias("releaseDate"),
                 F.struct(F.when(k % 2 == 0, "AB").alias("official")).alias("abbreviations"), F.struct(k.alias("tcgplayer"), zero.cast("bigint").alias("cardmarket")).alias("thirdParty"), F.lit("TO").alias("tcgOnline")).alias("set"),
        F.struct(names.alias("name"), F.when(k % 13 == 0, "None").when(k % 17 != 0, F.col("p_type")).alias("rarity"), F.lit("c").alias("category"), size.alias("hp"), F.array("p_type").alias("types"), F.when(k % 19 == 0, "LEVEL-UP").alias("stage"), zero.cast("string").alias("suffix"),
                 F.lit("i").alias("illustrator"), zero.cast("string").alias("regulationMark"), zero.cast("array<int>").alias("dexId"), raw.alias("variants")).alias("card"),
    )


_BUILT = """rec AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 3 = 0 THEN 'ja' ELSE 'en' END AS lang, CASE WHEN p_partkey % 7 = 0 THEN 'TG' ELSE '' END AS prefix, p_partkey % 60 + 1 AS number, p_brand, CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS plain, p_partkey % 19 = 0 AS up, p_size, p_type FROM part),
keyed AS (SELECT *, lang || '/' || p_brand AS set_id, lang || '/' || p_brand || '/' || prefix || number AS id FROM rec),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS nth FROM keyed),
cards AS (SELECT *, CASE WHEN up AND plain NOT LIKE '%LV.X%' THEN plain || ' LV.X' ELSE plain END AS name, CASE WHEN seq % 13 = 0 OR seq % 17 = 0 THEN NULL ELSE p_type END AS rarity FROM ranked WHERE nth = 1),
main AS (SELECT set_id, prefix FROM (SELECT set_id, prefix, row_number() OVER (PARTITION BY set_id ORDER BY count(*) DESC, min(seq)) AS nth FROM cards GROUP BY set_id, prefix) WHERE nth = 1),
sets AS (SELECT s.set_id AS id, s.lang, s.p_brand AS source_set_id, s.seq, CASE WHEN s.p_brand <> 'Brand#3' THEN 'Set ' || s.p_brand END AS name, CASE WHEN s.p_brand <> 'Brand#4' THEN 50 END AS printed_total, (SELECT count(*) FROM cards c WHERE c.set_id = s.set_id) AS card_count,
  CASE WHEN s.p_brand <> 'Brand#4' THEN m.prefix ELSE '' END AS number_prefix, CASE WHEN s.seq % 2 = 1 THEN '2021-05-06' WHEN s.lang = 'ja' THEN '2020-03-04' ELSE '2020-01-02' END AS release_date, CASE WHEN s.seq % 2 = 0 THEN 'AB' ELSE 'TO' END AS abbreviation
  FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY seq) AS first FROM keyed) s JOIN main m USING (set_id) WHERE first = 1)"""
_VARIANTS = """forms(m, lang, pos, variant_key, alt) AS (VALUES (0, NULL, 0, 'normal', 0), (1, NULL, 5, 'holo', 0), (1, NULL, 6, 'holo+1st-edition', 0), (2, 'ja', 0, 'holo', 0), (2, NULL, 1, 'normal+a+w', 1), (2, NULL, 3, 'reverse@ball#jumbo', 0),
  (3, NULL, 0, 'normal', 0), (3, NULL, 2, 'normal+w-promo', 0), (3, NULL, 3, 'reverse', 0), (4, 'ja', 0, 'holo', 0)),
variants AS (SELECT id AS card_id, variant_key, pos, alt FROM cards JOIN forms f ON p_size % 5 = m AND (f.lang IS NULL OR f.lang = cards.lang))"""


@query(f"WITH {_BUILT} SELECT id, lang, source_set_id, name, printed_total, card_count, number_prefix, release_date, abbreviation, seq AS tcgplayer_group_id FROM sets")
def q_catalog_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.build(records(spark, sf_dir))[0].select("id", "lang", "source_set_id", "name", "printed_total", "card_count", "number_prefix", "release_date", "abbreviation", "tcgplayer_group_id")


@query(f"WITH {_BUILT} SELECT id, set_id, prefix || number AS local_id, prefix AS number_prefix, CAST(number AS INTEGER) AS number, name, rarity, 'https://assets.tcgdex.net/' || lang || '/s/' || p_brand || '/' || prefix || number AS image_base, seq || '.ts' AS source_path FROM cards")
def q_catalog_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.build(records(spark, sf_dir))[1].select("id", "set_id", "local_id", "number_prefix", "number", "name", "rarity", "image_base", "source_path")


@query(f"WITH {_BUILT}, {_VARIANTS} SELECT card_id, variant_key, CASE WHEN alt > 0 THEN '8/9' ELSE '' END AS alt_ids FROM variants")
def q_catalog_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    alt = F.array_join(F.transform(F.coalesce("alt_ids", F.array().cast("array<struct<tcgplayer_id:bigint,cardmarket_id:bigint>>")), lambda a: F.concat_ws("/", a.tcgplayer_id.cast("string"), a.cardmarket_id.cast("string"))), ",")
    return catalog.build(records(spark, sf_dir))[2].select("card_id", "variant_key", alt.alias("alt_ids"))


@query(f"""WITH {_BUILT},
have AS (SELECT DISTINCT set_id, number FROM cards JOIN main USING (set_id, prefix)),
gone AS (SELECT id, list_sort(list(n)) AS l FROM (SELECT id, unnest(range(1, 51)) AS n FROM sets WHERE printed_total > 0) w WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.set_id = w.id AND h.number = w.n) GROUP BY 1)
SELECT 'card' AS scope, id AS ref, 'duplicate' AS kind, seq || '.ts' AS detail FROM ranked WHERE nth > 1
UNION ALL SELECT 'card', id, 'no_variants', 'no printable variant for this language' FROM cards WHERE p_size % 5 = 4 AND lang = 'en'
UNION ALL SELECT 'card', id, 'missing_rarity', '' FROM cards WHERE rarity IS NULL
UNION ALL SELECT 'set', id, 'missing_name', 'no ' || lang || ' or fallback name' FROM sets WHERE name IS NULL
UNION ALL SELECT 'set', id, 'missing_printed_total', card_count || ' cards present' FROM sets WHERE printed_total IS NULL
UNION ALL SELECT 'set', id, 'missing_numbers', len(l) || '/50 missing: ' || array_to_string(l[1:20], ', ') || CASE WHEN len(l) > 20 THEN ' …' ELSE '' END FROM gone""")
def q_catalog_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.build(records(spark, sf_dir))[3]


_QUOTE = "CASE WHEN {0} IS NULL THEN 'null' ELSE '\"' || {0} || '\"' END"


@query(f"""WITH {_BUILT}, {_VARIANTS},
fields(variant_key, foil, size, stamps, ids, type) AS (VALUES ('normal', '', 'standard', '', '', 'normal'), ('holo', '', 'standard', '', '', 'holo'), ('holo+1st-edition', '', 'standard', '"stamps":["1st-edition"],', '', 'holo'), ('normal+a+w', '', 'standard', '"stamps":["w","a"],', '"tcgplayer_id":7,', 'normal'),
  ('reverse@ball#jumbo', '"foil":"ball",', 'jumbo', '', '', 'reverse'), ('normal+w-promo', '', 'standard', '"stamps":["w-promo"],', '', 'normal'), ('reverse', '', 'standard', '', '', 'reverse')),
v AS (SELECT card_id, string_agg('{{' || foil || '"size":"' || size || '",' || stamps || ids || '"type":"' || type || '","variant_key":"' || variant_key || '"}}', ',' ORDER BY pos) AS json FROM variants JOIN fields USING (variant_key) GROUP BY 1),
c AS (SELECT set_id, string_agg('{{"category":"c","id":"' || id || '","image_base":"https://assets.tcgdex.net/' || lang || '/s/' || p_brand || '/' || prefix || number || '","local_id":"' || prefix || number || '","name":' || {_QUOTE.format("name")} || ',"number":' || number || ',"rarity":' || {_QUOTE.format("rarity")}
  || ',"variants":[' || coalesce(json, '') || ']}}', ',' ORDER BY prefix, number) AS json FROM cards LEFT JOIN v ON card_id = id GROUP BY 1),
b AS (SELECT s.id, source_set_id, s.lang, card_count, '{{"cards":[' || json || '],"set":{{"abbreviation":"' || abbreviation || '","card_count":' || card_count || ',"cardmarket_id":null,"id":"' || s.id || '","lang":"' || s.lang || '","name":' || {_QUOTE.format("s.name")} || ',"name_en":' || {_QUOTE.format("s.name")}
  || ',"number_prefix":"' || number_prefix || '","printed_total":' || coalesce(CAST(printed_total AS VARCHAR), 'null') || ',"release_date":"' || release_date || '","serie_id":"s","serie_name":"S","source_set_id":"' || source_set_id || '","tcgplayer_group_id":' || seq || '}}}}' AS body FROM sets s JOIN c ON c.set_id = s.id)
SELECT id, card_count, lang || '/' || source_set_id || '.json' AS path, sha256(body) AS sha256 FROM b""")
def q_pack_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets, cards, variants, _ = catalog.build(records(spark, sf_dir))
    return export.json_packs(sets, cards, variants).select("id", "card_count", "path", "sha256")


# Prices

_PRICED = """e AS (SELECT event_id, value, event_id % 6 AS m, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers of a price server: prices of both vendors, of one, of none, a body that is no JSON, and failures."""
    m, k = F.col("event_id") % 6, F.get_json_object("props", "$.k")
    num = lambda c: c.cast("string")
    both = F.concat(F.lit('{"pricing":{"tcgplayer":{"unit":"USD","updated":"u","normal":{"lowPrice":1,"marketPrice":'), k, F.lit('},"holo":{"marketPrice":"9","midPrice":'), num(F.col("value")), F.lit('}},"cardmarket":{"avg":"3","trend":'), k, F.lit(',"avg7-holo":'), num(F.col("value")), F.lit("}}}"))
    body = F.when(m == 0, both).when(m == 1, F.concat(F.lit('{"pricing":{"cardmarket":{"low":'), k, F.lit("}}}"))).when(m == 2, '{"pricing":{}}').when(m == 3, "<html>")
    status = F.when(m < 4, "ok").when(m == 4, "nodata").otherwise("error")
    code = F.when(m < 4, 200).when(m == 4, 404)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("card_id"), status.alias("status"), code.alias("http_status"), F.encode(body, "UTF-8").alias("body"), F.lit("now").alias("fetched_at"))


@query(f"""WITH {_PRICED} SELECT event_id AS card_id, 'normal' AS variant, 'tcgplayer' AS source, k AS usd, NULL::DOUBLE AS eur, 'u' AS updated, 'now' AS fetched_at FROM e WHERE m = 0
UNION ALL SELECT event_id, 'holo', 'tcgplayer', value, NULL, 'u', 'now' FROM e WHERE m = 0 UNION ALL SELECT event_id, 'normal', 'cardmarket', NULL, k, NULL, 'now' FROM e WHERE m <= 1 UNION ALL SELECT event_id, 'any-foil', 'cardmarket', NULL, value, NULL, 'now' FROM e WHERE m = 0""")
def q_price_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.price_results(_answers(spark, sf_dir))[0]


@query(f"""WITH {_PRICED} SELECT event_id AS card_id, CASE WHEN m <= 1 THEN 'ok' WHEN m IN (2, 4) THEN 'nodata' ELSE 'error' END AS status, CAST(CASE WHEN m < 3 THEN 200 WHEN m = 4 THEN 404 END AS INTEGER) AS http_status, 'now' AS fetched_at FROM e""")
def q_price_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.price_results(_answers(spark, sf_dir))[1]


@query("""WITH c AS (SELECT p_partkey AS card_id, CASE WHEN p_partkey % 3 = 0 THEN 'ja' ELSE 'en' END AS lang, p_brand FROM part), m AS (SELECT card_id, CASE card_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'missing' WHEN 2 THEN 'error' WHEN 3 THEN 'ok' END AS status, CASE WHEN card_id % 10 = 0 THEN NULL ELSE 100 END AS bytes, CASE WHEN card_id % 4 = 0 THEN 90 WHEN card_id % 4 = 1 THEN 100 WHEN card_id % 4 = 2 THEN 0 END AS length FROM c WHERE card_id % 5 < 4)
SELECT card_id FROM c WHERE lang = 'en' AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#7') AND NOT EXISTS (SELECT 1 FROM m WHERE m.card_id = c.card_id AND (status = 'missing' OR status = 'error' OR status = 'ok' AND length > 0 AND (bytes IS NULL OR bytes = length))) ORDER BY card_id LIMIT 100""")
def q_image_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred images to be had; files are there whole, cut short, empty, or not at all."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    cards = part.select(k.alias("card_id"), F.lit("u").alias("url"), F.when(k % 3 == 0, "ja").otherwise("en").alias("lang"), F.col("p_brand").alias("set_id"))
    status = F.element_at(F.array(*map(F.lit, ("ok", "missing", "error", "ok"))), (k % 5 + 1).cast("int"))
    manifest = part.filter("p_partkey % 5 < 4").select(k.alias("card_id"), status.alias("status"), k.cast("string").alias("path"), F.when(k % 10 != 0, 100).alias("bytes"))
    files = part.filter("p_partkey % 4 < 3").select(k.cast("string").alias("path"), F.element_at(F.array(F.lit(90), F.lit(100), F.lit(0)), (k % 4 + 1).cast("int")).alias("length"))
    return ingest.image_plan(cards, manifest, files, langs=("en",), sets=("Brand#1", "Brand#2", "Brand#7"), limit=100).select("card_id")


@query("""SELECT 'xcheck_a' AS kind, p_partkey AS id FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'duplicate', p_partkey FROM part WHERE p_partkey % 3 = 0""")
def q_replace_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    kind = F.when(F.col("id") % 3 == 0, "duplicate").otherwise("xcheck_old")
    return ingest.replace_kinds(part.select(kind.alias("kind"), "id"), part.filter("id % 2 = 0").select(F.lit("xcheck_a").alias("kind"), "id"), "xcheck_")


# Comparison with another catalog


def _two_catalogs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """mapping, our sets, their sets, our cards, their cards: every seventh set has no partner, every fifth another total."""
    own = roles.sets(spark, sf_dir).join(table(spark, sf_dir, "part"), F.col("card_id") == F.col("p_partkey"))
    k = F.col("p_partkey")
    number = F.regexp_extract("set_id", r"#(\d+)", 1).cast("int")
    sets = own.select("set_id", "printed_total").distinct().withColumn("n", number)
    mapping = sets.filter("n % 7 <> 0").select(F.col("set_id").alias("our_id"), F.lower("set_id").alias("their_id"))
    ours = own.filter(k % 11 != 0).select(k.alias("seq"), "set_id", k.cast("string").alias("id"), F.col("number").cast("string").alias("number"), F.when(k % 9 == 0, F.concat("p_name", F.lit(" o'x"))).otherwise(F.col("p_name")).alias("name"), F.when(k % 5 == 0, "GX").alias("suffix"), F.when(k % 6 == 0, "Common").otherwise("Rare Holo").alias("rarity"))
    name = F.when(k % 13 == 0, "other").when(k % 5 == 0, F.concat("p_name", F.when(k % 9 == 0, " o'x").otherwise(""), F.lit("-gx"))).when(k % 9 == 0, F.concat(F.upper("p_name"), F.lit(" OX"))).otherwise(F.upper("p_name"))
    theirs = own.filter(k % 17 != 0).select(k.alias("seq"), F.lower("set_id").alias("set_id"), F.lpad(F.col("number").cast("string"), 4, "0").alias("number"), name.alias("name"), F.when(k % 4 == 0, "common").otherwise("Rare").alias("rarity"))
    return mapping, sets.select(F.col("set_id").alias("id"), "printed_total"), sets.select(F.lower("set_id").alias("id"), F.when(F.col("n") % 5 == 0, F.col("printed_total") + 1).otherwise(F.col("printed_total")).alias("printed_total")), ours, theirs


_COMPARED = """sn AS (SELECT DISTINCT set_id, printed_total, CAST(regexp_extract(set_id, '#([0-9]+)', 1) AS INTEGER) AS n FROM sets),
p AS (SELECT card_id AS k, set_id, number, p_name || CASE WHEN card_id % 9 = 0 THEN ' o''x' ELSE '' END AS o_name, CASE WHEN card_id % 13 = 0 THEN 'other' WHEN card_id % 5 = 0 THEN p_name || CASE WHEN card_id % 9 = 0 THEN ' o''x' ELSE '' END || '-gx' WHEN card_id % 9 = 0 THEN upper(p_name) || ' OX' ELSE upper(p_name) END AS t_name,
  CASE WHEN card_id % 6 = 0 THEN 'Common' ELSE 'Rare Holo' END AS o_rarity, CASE WHEN card_id % 4 = 0 THEN 'common' ELSE 'Rare' END AS t_rarity, card_id % 11 <> 0 AS ours, card_id % 17 <> 0 AS theirs FROM sets JOIN part ON p_partkey = card_id JOIN sn USING (set_id) WHERE sn.n % 7 <> 0),
k AS (SELECT *, CASE WHEN NOT theirs THEN 'xcheck_only_in_catalog' WHEN NOT ours THEN 'xcheck_missing_from_catalog' WHEN k % 13 = 0 THEN 'xcheck_name' WHEN (o_rarity = 'Common') <> (t_rarity = 'common') THEN 'xcheck_rarity' ELSE 'agree' END AS kind FROM p WHERE ours OR theirs)"""


@query(f"""{with_roles("sets")}, {_COMPARED},
l AS (SELECT set_id, kind, list(CASE WHEN kind = 'xcheck_only_in_catalog' THEN CAST(number AS VARCHAR) ELSE number || ' ' || t_name END ORDER BY number) AS l FROM k WHERE NOT (ours AND theirs) GROUP BY ALL)
SELECT 'set' AS scope, set_id AS ref, 'xcheck_printed_total' AS kind, 'ours ' || printed_total || ', them ' || (printed_total + 1) AS detail FROM sn WHERE n % 7 <> 0 AND n % 5 = 0 AND printed_total > 0
UNION ALL SELECT 'set', set_id, 'xcheck_set_unmatched', 'no them set' FROM sn WHERE n % 7 = 0
UNION ALL SELECT 'set', set_id, kind, len(l) || ': ' || array_to_string(l[1:15], ', ') || CASE WHEN len(l) > 15 THEN ' …' ELSE '' END FROM l
UNION ALL SELECT 'card', CAST(k AS VARCHAR), kind, 'ours ' || CASE WHEN contains(o_name, '''') THEN '"' || o_name || '"' ELSE '''' || o_name || '''' END || ', them ''' || t_name || '''' FROM k WHERE kind = 'xcheck_name'
UNION ALL SELECT 'card', CAST(k AS VARCHAR), kind, 'ours ''' || o_rarity || ''', them ''' || t_rarity || '''' FROM k WHERE kind = 'xcheck_rarity'""")
def q_crosscheck_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.crosscheck(*_two_catalogs(spark, sf_dir), "them")


@query(f"""{with_roles("sets")}, {_COMPARED} SELECT count(*) AS compared, count(*) FILTER (WHERE kind = 'agree') AS agree, count(*) FILTER (WHERE kind = 'agree') / count(*) AS share FROM k WHERE ours AND theirs""")
def q_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping, _, _, ours, theirs = _two_catalogs(spark, sf_dir)
    mine = ours.join(mapping.select(F.col("our_id").alias("set_id")), "set_id", "left_semi")
    other = theirs.withColumnRenamed("set_id", "their_id").join(mapping, "their_id").select("seq", F.col("our_id").alias("set_id"), "number", "name", "rarity")
    return reconcile.agreement(reconcile.compare_cards(mine, other))


# Text


@query("""SELECT p_partkey AS part_id, CASE WHEN p_partkey % 3 = 0 THEN 'J' || p_name WHEN p_partkey % 3 = 1 THEN p_name END AS ja, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS en, CASE WHEN p_partkey % 2 = 0 AND p_name NOT LIKE '%bolt%' THEN p_name || ' LV.X' WHEN p_partkey % 2 = 0 THEN replace(p_name, 'bolt', 'bolt LV.X') ELSE p_name END AS name,
  CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN p_size || '/' || p_partkey ELSE CAST(p_size AS VARCHAR) END AS label, 'http://x/en/cards/' || p_brand || '-' || p_size AS url, split_part('en/' || p_brand || '/1', '/', 1) AS lang, 'en/' || p_brand AS set_id FROM part""")
def q_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by language, level names, number labels and addresses of parts."""
    k, name = F.col("p_partkey"), F.col("p_name")
    texts = F.when(k % 3 == 0, F.create_map(F.lit("ja"), F.concat(F.lit("J"), name), F.lit("en"), name)).when(k % 3 == 1, F.create_map(F.lit("ja"), F.lit(""), F.lit("en"), name)).otherwise(F.create_map(F.lit("fr"), name))
    level = T.level_name(F.replace(name, F.lit("bolt"), F.when(k % 2 == 0, "bolt LV.X").otherwise("bolt")), F.when(k % 2 == 0, "LEVEL-UP").otherwise("BASIC"))
    size = F.col("p_size").cast("string")
    card = F.concat(F.lit("en/"), "p_brand", F.lit("/1"))
    label = T.number_label(F.when(F.col("p_size") % 3 == 0, "").otherwise(size), F.when(F.col("p_size") % 3 == 1, k).otherwise(F.lit(0)))
    return table(spark, sf_dir, "part").select(k.alias("part_id"), T.localized(texts, "ja").alias("ja"), T.localized(texts, "en").alias("en"), level.alias("name"), label.alias("label"), T.price_url("http://x", F.lit("en"), F.col("p_brand"), size).alias("url"), T.language_of(card).alias("lang"), T.set_of(card).alias("set_id"))
