import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.operators import catalog, evaluate, export, ingest, reconcile
from cardloom.sources import readers


def one(spark, column, **values):
    kinds = {int: "long", str: "string", list: "array<string>", dict: "map<string,string>", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("125", ("", 125, "")), ("TG05", ("TG", 5, "")), ("SWSH001", ("SWSH", 1, "")), ("15a", ("", 15, "a")), ("?", ("?", None, "")), ("99999999999", ("", None, ""))])
def test_number_parts(spark, raw, want):
    assert tuple(one(spark, T.number_parts(F.col("v")), v=raw)) == want


def test_normal_forms(spark):
    assert one(spark, T.normal_set_id(F.col("v")), v="sv03.5") == one(spark, T.normal_set_id(F.col("v")), v="SV3pt5") == "sv3pt5"
    assert [one(spark, T.normal_number(F.col("v")), v=v) for v in ("001", "TG05", "15A", "tg5", "H-1")] == ["1", "TG5", "15a", "TG5", "H-1"]
    assert [one(spark, T.normal_name("v"), v=v) for v in ("Pokémon ★", "Nidoran♀", "Δ δ", None, "フシギ")] == ["pokemon", "nidoranf", "deltadelta", "", ""]
    assert [one(spark, T.rarity_tier(F.col("v")), v=v) for v in (" Common", "Promo", "", None, "Rare Holo", " ", "\tpromo\n")] == ["common", None, None, None, "rare", "rare", None]
    order = lambda v: tuple(one(spark, T.number_order(F.col("v")), v=v))
    assert sorted(["10", "TG2", "9", "TG10", "?", "1a"], key=order) == ["1a", "9", "10", "?", "TG2", "TG10"]
    for v in ("a", "it's", 'say "x"', "both ' and \"", "back\\slash\n\t"):
        assert one(spark, T.quoted(F.col("v")), v=v) == repr(v)
    assert [one(spark, f(F.col("v")), v="en/sv1/25") for f in (T.language_of, T.set_of)] == ["en", "en/sv1"]
    assert one(spark, T.price_url("http://x", F.lit("en"), F.col("v"), F.lit("7")), v="sv1") == "http://x/en/cards/sv1-7" and one(spark, T.image_url(F.col("v"), "high", "png"), v="b") == "b/high.png"


def test_keys_and_labels(spark):
    assert one(spark, T.variant_key(F.col("t"), F.col("s"), F.col("p"), F.col("f"), F.col("z")), t="holo", s="shadowless", p=["w", "a"], f="ball", z="jumbo") == "holo/shadowless+a+w@ball#jumbo"
    assert one(spark, T.variant_key(F.col("t"), F.col("s"), F.col("s").cast("array<string>") if False else F.lit(None).cast("array<string>"), F.col("s"), F.lit("standard")), t="normal", s=None) == "normal"
    assert [one(spark, T.localized(F.col("m"), k), m=m) for k, m in (("ja", {"en": "A", "ja": ""}), ("ja", {"ja": "B", "en": "A"}), ("en", {"ja": "B"}))] == ["A", "B", None]
    assert one(spark, T.release_date(F.col("m"), "ja"), m={"en": "2020-01-01"}) == "2020-01-01"
    assert [one(spark, T.number_label(F.col("v"), F.lit(t)), v=v) for v, t in (("7", 102), ("7", 0), ("", 5))] == ["7/102", "7", ""]
    assert one(spark, T.level_name(F.col("v"), F.lit("LEVEL-UP")), v="Dialga") == "Dialga LV.X"
    assert one(spark, T.csv_cell(F.col("v")), v='a "b", c') == '"a ""b"", c"' and one(spark, T.csv_cell(F.col("v")), v="plain") == "plain"
    assert tuple(one(spark, T.ocr_number(F.col("v")), v="tg O5 | 2O2 x")) == ("TG", 5, 202)
    assert one(spark, T.fnv1a(F.col("v")), v="foobar") == 0xBF9CF968
    assert one(spark, T.short_list(F.col("v"), 2), v=["a", "b", "c"]) == "3: a, b …"
    assert one(spark, T.iso_cutoff("2024-01-31T00:00:00Z", 120), v="") == "2024-01-26T00:00:00Z"


def test_prices(spark):
    block = {"tcgplayer": {"unit": "USD", "updated": "u1", "normal": {"lowPrice": 0.1, "marketPrice": 0.37}, "holo": {"marketPrice": "2.2"}, "odd": {"x": {"lowPrice": 9}, "lowPrice": None, "midPrice": 3}}, "cardmarket": {"avg": "9", "trend": 0.22, "avg7-holo": 1.5, "unit": "EUR", "updated": "u2"}}
    rows = [("c", json.dumps(block)), ("e", "{}"), ("n", None)]
    got = sorted((r.card_id, r.variant, r.source, r.usd, r.eur, r.updated) for r in ingest.price_rows(spark.createDataFrame(rows, "card_id string, pricing string")).collect())
    assert got == [("c", "any-foil", "cardmarket", None, 1.5, "u2"), ("c", "normal", "cardmarket", None, 0.22, "u2"), ("c", "normal", "tcgplayer", 0.37, None, "u1"), ("c", "odd", "tcgplayer", 3.0, None, "u1")]


def test_price_results(spark):
    schema = "card_id string, status string, http_status int, body binary, fetched_at string"
    rows = [("a", "ok", 200, b'{"pricing": {"cardmarket": {"avg7": 2}}}', "t"), ("b", "ok", 200, b'{"pricing": {}}', "t"), ("c", "nodata", 404, None, "t"), ("d", "error", None, None, "t"), ("e", "ok", 200, b"<html>", "t"), ("f", "ok", 200, b'{"pricing": null}', "t")]
    prices, log = ingest.price_results(spark.createDataFrame(rows, schema))
    assert [(r.card_id, r.variant, r.eur, r.fetched_at) for r in prices.collect()] == [("a", "normal", 2.0, "t")]
    assert sorted((r.card_id, r.status, r.http_status) for r in log.collect()) == [("a", "ok", 200), ("b", "nodata", 200), ("c", "nodata", 404), ("d", "error", None), ("e", "error", None), ("f", "nodata", 200)]


def test_distinct_variants(spark):
    v = spark.createDataFrame([("c", "normal", 0, 1), ("c", "normal", 2, 3), ("c", "holo", 1, 2)], "card_id string, key string, pos int, market_id long")
    assert sorted((r.key, r.market_id, r.alt_ids) for r in catalog.distinct_variants(v).collect()) == [("holo", 2, None), ("normal", 1, [3])]


RAW = [
    (None, "en", ["normal"]),
    ({}, "en", ["normal"]),
    ({"normal": False}, "en", []),
    ({"normal": None, "holo": True}, "en", ["holo"]),
    ({"holo": True, "firstEdition": True, "wPromo": True}, "en", ["normal", "normal+1st-edition", "normal+w-promo", "holo", "holo+1st-edition"]),
    ([{"type": "holo", "languages": ["ja"]}, {"type": "normal", "languages": []}, {"type": "reverse", "foil": "ball", "size": "jumbo", "stamp": ["z", "a"]}], "en", ["normal", "reverse+a+z@ball#jumbo"]),
    ([{"type": "holo", "languages": ["ja"]}], "en", []),
    ([{"type": "holo", "thirdParty": {"tcgplayer": 1}}, {"type": "holo", "thirdParty": {"cardmarket": 7}}], "ja", ["holo"]),
]


def test_variants_of_lists_and_flags(spark):
    cards = spark.createDataFrame([(str(i), lang, None if raw is None else json.dumps(raw)) for i, (raw, lang, _) in enumerate(RAW)], "id string, lang string, raw string")
    got = catalog.variants_of(cards).orderBy("card_id", "pos").collect()
    assert {str(i): want for i, (*_, want) in enumerate(RAW) if want} == {k: [r.variant_key for r in got if r.card_id == k] for k in dict.fromkeys(r.card_id for r in got)}
    last = [r for r in got if r.card_id == "7"][0]
    assert (last.tcgplayer_id, last.cardmarket_id) == (1, None) and [tuple(a) for a in last.alt_ids] == [(None, 7)]


def records(spark, tmp_path):
    def record(set_id, local, name, rarity="Rare", total=4, serie="s", **card):
        return {"source": {"repo": "r", "path": f"{set_id}/{local}.ts"}, "lang": "en", "localId": local, "serie": {"id": serie, "name": {"en": "S"}}, "set": {"id": set_id, "name": {"en": set_id.upper()} if set_id != "n" else {}, "cardCount": {"official": total}, "releaseDate": {"en": "2020-01-02"} if set_id == "a" else "2021-03-04", "tcgOnline": "AA"}, "card": {"name": {"en": name}, "rarity": rarity, **card}}

    rows = [record("a", "1", "One"), record("a", "3", "Three", None), record("a", "3", "Again"), record("a", "6", "Secret", "None"), record("a", "PR1", "Promo", variants=[{"type": "holo", "languages": ["ja"]}])]
    rows += [record("p", "1", "Gone", serie="tcgp"), record("b", "X", "Lone", "x", 0, stage="LEVEL-UP"), record("n", "1", "Un", "", 1), record("a", "9", "")]
    (tmp_path / "r.ndjson").write_text("\n".join(map(json.dumps, rows)) + "\n")
    return readers.catalog_records(spark, str(tmp_path / "r.ndjson"))


def test_build_catalog(spark, tmp_path):
    sets, cards, variants, issues = catalog.build(records(spark, tmp_path))
    assert sorted((r.id, r.printed_total, r.card_count, r.release_date, r.abbreviation) for r in sets.collect()) == [("en/a", 4, 4, "2020-01-02", "AA"), ("en/b", None, 1, "2021-03-04", "AA"), ("en/n", 1, 1, "2021-03-04", "AA")]
    none = "no printable variant for this language"
    assert {(r.scope, r.kind, r.ref, r.detail) for r in issues.collect()} == {
        ("card", "duplicate", "en/a/3", "a/3.ts"), ("card", "missing_rarity", "en/a/3", ""), ("card", "missing_rarity", "en/a/6", ""), ("set", "missing_numbers", "en/a", "2/4 missing: 2, 4"), ("set", "missing_printed_total", "en/b", "1 cards present"),
        ("card", "no_variants", "en/a/PR1", none), ("set", "missing_name", "en/n", "no en or fallback name"),
    }
    assert {(r.name, r.rarity) for r in cards.collect()} == {("One", "Rare"), ("Three", None), ("Secret", None), ("Promo", "Rare"), ("Lone LV.X", "x"), ("Un", None)}
    assert {r.card_id for r in variants.collect()} == {"en/a/1", "en/a/3", "en/a/6", "en/b/X", "en/n/1"}


def test_packs_and_tables(spark, tmp_path):
    sets, cards, variants, issues = catalog.build(records(spark, tmp_path))
    packs = export.json_packs(sets, cards, variants)
    body = {r.id: r.body for r in packs.collect()}["en/a"]
    pack = json.loads(body)
    assert body == json.dumps(pack, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert [c["local_id"] for c in pack["cards"]] == ["1", "3", "6", "PR1"] and pack["set"]["serie_id"] == "s" and pack["set"]["cardmarket_id"] is None
    assert pack["cards"][0]["variants"] == [{"size": "standard", "type": "normal", "variant_key": "normal"}] and pack["cards"][3]["variants"] == []
    export.write_packs(packs, str(tmp_path / "packs"), {"source": "x"})
    index = json.loads((tmp_path / "packs" / "index.json").read_text())
    assert index["schema_version"] == 1 and [s["path"] for s in index["sets"]] == ["en/a.json", "en/b.json", "en/n.json"]
    (stored,) = (tmp_path / "packs" / "lang=en" / "source_set_id=a").glob("*.txt")
    assert hashlib.sha256(stored.read_bytes().rstrip(b"\n")).hexdigest() == index["sets"][0]["sha256"]
    export.write_catalog(sets, cards, variants, issues, str(tmp_path / "db"), {"commit": "unknown"})
    export.write_catalog(sets, cards, variants, issues, str(tmp_path / "db"), {"commit": "unknown"})
    assert spark.read.parquet(str(tmp_path / "db" / "cards")).count() == 6 and dict(map(tuple, spark.read.parquet(str(tmp_path / "db" / "meta")).collect())) == {"schema_version": "1", "commit": "unknown"}


def test_reconcile(spark):
    schema = "seq long, id string, name string, code string, date string"
    ours = spark.createDataFrame([(1, "sv03.5", "x", None, "d"), (2, "b", "N", "svi", "d2"), (3, "c", "Név", None, "d3"), (4, "sv3.5", "y", None, "d"), (5, "o", "z", None, "d"), (6, "m", "Nev", "", "d3")], schema)
    theirs = spark.createDataFrame([(1, "sv3pt5", "q", "", "e"), (2, "k", "r", "SVI", "d2"), (3, "m", "nev", "", "d3"), (4, "late", "u", "", "f")], schema)
    over = spark.createDataFrame([("o", "late"), ("b", "absent"), ("who", "m")], "our_id string, their_id string")
    assert sorted(map(tuple, reconcile.map_sets(ours, theirs, over).collect())) == [("b", "k"), ("c", "m"), ("o", "late"), ("sv03.5", "sv3pt5")]
    card = "seq long, set_id string, number string, name string, rarity string, id string, suffix string"
    a = spark.createDataFrame([(1, "s", "001", "Mew", "Common", "i1", None), (2, "s", "2", "Abra", "Common", "i2", ""), (3, "s", "3", "X", "Rare", "i3", None), (4, "s", "4", "Y", None, "i4", None), (5, "s", "6", "Garchomp", "Rare", "i6", "LV.X"), (6, "s", "TG3", "W", " ", "i7", None)], card)
    b = spark.createDataFrame([(1, "s", "1", "MEW", "uncommon"), (2, "s", "2", "Kadabra", "Rare"), (3, "s", "10", "Z", "Rare"), (4, "s", "4", "y", "Rare"), (5, "s", "6", "Garchomp LV.X", "Rare"), (6, "s", "9", "It's", "Rare")], card.rsplit(", ", 2)[0])
    got = sorted((r.number, r.kind) for r in reconcile.compare_cards(a, b).collect())
    assert got == [("1", "xcheck_rarity"), ("10", "xcheck_missing_from_catalog"), ("2", "xcheck_name"), ("3", "xcheck_only_in_catalog"), ("4", "agree"), ("6", "agree"), ("9", "xcheck_missing_from_catalog"), ("TG3", "xcheck_only_in_catalog")]
    assert tuple(reconcile.agreement(reconcile.compare_cards(a, b)).first()) == (4, 2, 0.5)
    mapping = spark.createDataFrame([("s", "p")], "our_id string, their_id string")
    total = "id string, printed_total int"
    issues = reconcile.crosscheck(mapping, spark.createDataFrame([("s", 9), ("alone", 3)], total), spark.createDataFrame([("p", 8), ("q", 1)], total), a, b.replace("s", "p", "set_id"), "them")
    assert sorted((r.scope, r.ref, r.kind, r.detail) for r in issues.collect()) == [
        ("card", "i1", "xcheck_rarity", "ours 'Common', them 'uncommon'"), ("card", "i2", "xcheck_name", "ours 'Abra', them 'Kadabra'"), ("set", "alone", "xcheck_set_unmatched", "no them set"),
        ("set", "s", "xcheck_missing_from_catalog", "2: 9 It's, 10 Z"), ("set", "s", "xcheck_only_in_catalog", "2: 3, TG3"), ("set", "s", "xcheck_printed_total", "ours 9, them 8"),
    ]
    old = spark.createDataFrame([("set", "x", "xcheck_name", ""), ("set", "x", "duplicate", "")], "scope string, ref string, kind string, detail string")
    assert ingest.replace_kinds(old, issues, "xcheck_").count() == 7
    assert sorted(r.id for r in reconcile.unmatched(theirs.select("id"), mapping, "their_id").collect()) == ["k", "late", "m", "sv3pt5"]


def test_image_plan(spark):
    cat = spark.createDataFrame([(c, "u") for c in "abcde"], "card_id string, url string")
    man = spark.createDataFrame([("a", "ok", "pa", 5), ("b", "ok", "pb", 5), ("c", "missing", None, None), ("d", "error", None, None)], "card_id string, status string, path string, bytes long")
    files = spark.createDataFrame([("pa", 5), ("pb", 4)], "path string, length long")
    assert sorted(r.card_id for r in ingest.image_plan(cat, man, files).collect()) == ["b", "e"]
    assert sorted(r.card_id for r in ingest.image_plan(cat, man, files, True).collect()) == ["b", "d", "e"]
    assert [r.card_id for r in ingest.image_plan(cat, man, files, True, limit=2).collect()] == ["b", "d"]
    tagged = cat.withColumn("lang", F.when(F.col("card_id") == "e", "ja").otherwise("en")).withColumn("set_id", F.lit("s"))
    assert [r.card_id for r in ingest.image_plan(tagged, man, files, langs=("ja",), sets=("s",)).collect()] == ["e"] and ingest.image_plan(tagged, man, files, sets=("t",)).count() == 0
    log = spark.createDataFrame([("a", "ok", "2024-02"), ("b", "error", "2024-02"), ("c", "ok", "2023"), ("d", "nodata", "2024-02")], "card_id string, status string, fetched_at string")
    assert [r.card_id for r in ingest.refresh_plan(tagged, log, "2024", ("en",), 1).collect()] == ["b"]
    assert sorted(r.card_id for r in ingest.refresh_plan(tagged, log, "2024").collect()) == ["b", "c", "e"]
    assert sorted(map(tuple, ingest.with_images(cat, man).collect())) == [("a", "u", "pa"), ("b", "u", "pb")]


def test_pools_and_samples(spark):
    cards = spark.createDataFrame([(f"a{i}", "a", str(i)) for i in range(12)] + [(f"b{i}", "b", f"x{i}") for i in range(11)], "card_id string, set_id string, local_id string")
    assert {r.set_id for r in ingest.large_sets(cards).collect()} == {"a"} and ingest.numbered(cards).count() == 12
    one, two = ([r.card_id for r in ingest.sample(cards.repartition(k), "card_id", 5, 3).collect()] for k in (1, 4))
    assert one == two and len(set(one)) == 5 and one != [r.card_id for r in ingest.sample(cards, "card_id", 5, 4).collect()] and ingest.sample(cards, "card_id", 99).count() == 23


def test_vote_and_rates(spark):
    reads = spark.createDataFrame([("k", 1, 5, 10), ("k", 2, 6, None), ("k", 3, 5, 10), ("k", 4, 6, 9), ("k", 5, 6, 9), ("z", 1, None, 3)], "key string, attempt int, number int, total int")
    assert list(map(tuple, evaluate.vote(reads).collect())) == [("k", 5, 10, 2)]
    out = spark.createDataFrame([("a", "a", True, "card"), ("b", "x", True, "card"), (None, None, False, "empty"), ("?", "x", False, "card"), ("c", None, False, "empty")], "truth string, top string, in_top_k boolean, state string")
    assert tuple(evaluate.accuracy(out).first()) == (pytest.approx(1 / 3), pytest.approx(2 / 3), 1.0, 1)
    assert tuple(evaluate.accuracy(out.limit(0)).first()) == (None, None, None, 0)


def test_text_export(spark):
    meta = spark.createDataFrame([("x", "Charm, 'an'", "Obsidian", "3/197")], "card_id string, name string, set_name string, number_label string")
    wishes = spark.createDataFrame([(1, 0, "x", "need", "set_gap", 2, ["t"]), (1, 1, "y", "want", "manual", 1, [])], "collector long, ordinal int, card_id string, priority string, source string, quantity int, owned_elsewhere array<string>")
    who = spark.createDataFrame([(1,), (2,)], "collector long")
    got = dict(map(tuple, export.wishlist_text(who, wishes, meta).collect()))
    assert got == {1: "Need 2:\n  Charm, 'an' 3/197 (Obsidian) x2  [have a copy elsewhere]\n  y\n", 2: "Nothing missing."}
    assert dict(map(tuple, export.wishlist_text(who, wishes, meta, "Obsidian").collect()))[1].startswith("Obsidian — need 2:\n  Charm, 'an' 3/197 x2")
    csv = export.wishlist_csv(wishes, meta).first().csv
    assert csv == "card_id,name,set,number,priority,source,quantity,owned_elsewhere\nx,\"Charm, 'an'\",Obsidian,3/197,need,set_gap,2,t\ny,,,,want,manual,1,\n"
