import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.operators import evaluate, fusion, layout, vectors
from cardloom.sources import fetch, pack, readers
from cardloom.streaming import upsert


def index(spark, n=300, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[n // 2] = v[3]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>")


def test_search_is_exact(spark, monkeypatch):
    v, df = index(spark)
    want = {}
    s = np.zeros((len(v), len(v)))
    for d in range(v.shape[1]):
        s += v[:, d, None].astype(float) * v[:, d].astype(float)
    for q in range(0, 300, 10):
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-s[q, i], i))[:5]
        want |= {(q, k + 1): i for k, i in enumerate(order)}
    for block, pieces in ((4096, 64), (7, 2)):
        monkeypatch.setattr(vectors, "BLOCK", block)
        monkeypatch.setattr(vectors, "PIECES", pieces)
        got = vectors.search(df.repartition(4), df.filter("id % 10 = 0"), 5, exclude_self=True).collect()
        assert {(r.query_id, r["rank"]): r.id for r in got} == want
        ranked = vectors.ranks(df.withColumn("tag", F.col("id") % 3), df.filter("id % 10 = 0").withColumn("tag", F.col("id") % 3), exclude_self=True)
        for r in ranked.collect():
            best = max(s[r.query_id, i] for i in range(300) if i != r.query_id and i % 3 == r.query_id % 3)
            assert r.best == best and r.better == sum(s[r.query_id, i] > best for i in range(300) if i != r.query_id)
        blurred = spark.createDataFrame([(i, i, (v[i] + 0.3 * v[(i + 1) % 300]).tolist()) for i in range(0, 300, 7)], "id long, tag long, embedding array<float>")
        for r in vectors.ranks(df.withColumn("tag", F.col("id")), blurred).collect():
            q = (v[r.query_id] + 0.3 * v[(r.query_id + 1) % 300]).astype(np.float64)
            assert r.better == sum(v[i].astype(float) @ q > v[r.query_id].astype(float) @ q + 1e-12 for i in range(300))
    only = vectors.search(df, df.filter("id = 3"), 3, mask=F.col("id") % 2 == 0).collect()
    assert all(r.id % 2 == 0 for r in only) and vectors.search(df, df.limit(0), 3).count() == 0


def test_unit_dot_and_guard(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(vectors.unit(F.col("a")).alias("a"), vectors.unit(F.col("b")).alias("b"), vectors.dot(F.col("a"), F.col("a")).alias("d")).first()
    assert r.a == [0.6, 0.8] and r.b == [0.0, 0.0] and r.d == 25.0
    x = spark.createDataFrame([(1, [1.0], "e1")], "id long, embedding array<float>, embedder string")
    assert vectors.merge(x, x).count() == 2
    with pytest.raises(ValueError):
        vectors.merge(x, x.withColumn("embedder", F.lit("e2")))
    with pytest.raises(ValueError):
        vectors.require_embedder(x, "e2")


def test_pack_round_trip(spark, tmp_path):
    v, df = index(spark, 20)
    named = df.withColumn("id", F.concat(F.lit("en/é/"), F.col("id").cast("string")))
    pack.write(named, "e", str(tmp_path / "a.pack"))
    back = {r.id: r.embedding for r in pack.read(spark, str(tmp_path / "*.pack")).collect()}
    assert len(back) == 20 and all(np.allclose(back[f"en/é/{i}"], v[i].astype(np.float16)) for i in range(20))
    raw = (tmp_path / "a.pack").read_bytes()
    assert raw[:8] == pack.MAGIC and json.loads(raw[12 : 12 + int.from_bytes(raw[8:12], "little")]) == {"count": 20, "dim": 8, "dtype": "float16", "embedder": "e", "id_bytes": 8}
    with pytest.raises(ValueError):
        pack.decode(b"something else")
    with pytest.raises(ValueError):
        pack.encode(["a"], np.zeros((2, 3)), "e")


def test_fusion_passes(spark):
    schema = "page long, pocket long, card_id string, set_id string, number long, visual double, number_hit boolean, total_hit boolean, orb int"
    rows = [(0, p, f"a{p}", "A", 10 + p, 0.95, True, False, 40) for p in range(3)] + [(0, p, f"b{p}", "B", 50 + p, 0.5, None, None, None) for p in range(3)]
    rows += [(0, 3, "a3", "A", 13, 0.80, False, False, 0), (0, 3, "b3", "B", 99, 0.82, False, False, 0), (0, 4, "a9", "A", 90, 0.4, False, False, 0)]
    ranked = fusion.passes(spark.createDataFrame(rows, schema), F.col("pocket"))
    got = {r.pocket: r for r in fusion.decide(ranked, F.col("pocket")).collect()}
    assert got[3].card_id == "a3" and got[0].status == "confirmed" and got[4].status == "review"
    assert got[4].flags == ["low_visual_match", "out_of_order"] and got[0].flags == []
    cards = spark.createDataFrame([("A", 15, "a5")], "set_id string, number long, card_id string")
    empty = spark.createDataFrame([(0, 5, "A")], "page long, pocket long, set_id string")
    base = spark.createDataFrame([(0, 10)], "page long, base long")
    assert [tuple(r) for r in fusion.wish_additions(empty, base, cards, F.col("pocket")).collect()] == [(0, 5, "a5")]


def test_candidates_and_verification(spark):
    at = "page long, pocket long, "
    neighbours = spark.createDataFrame([(0, 0, "a1", 0.9), (0, 0, "b1", 0.8), (0, 1, "a2", 0.7), (0, 1, "zz", 0.99)], at + "card_id string, visual double")
    reads = spark.createDataFrame([(0, 0, 7, 50), (0, 1, None, None)], at + "number long, total long")
    catalog = spark.createDataFrame([("a1", "A", 1, 50), ("a2", "A", 2, 50), ("b1", "B", 7, 50), ("c7", "C", 7, 50), ("d7", "D", 7, 50)], "card_id string, set_id string, number long, printed_total long")
    index = spark.createDataFrame([("c7", [1.0, 0.0])], "card_id string, embedding array<float>")
    queries = spark.createDataFrame([(0, 0, [0.5, 0.5])], at + "embedding array<float>")
    got = fusion.candidates(neighbours, reads, catalog, index, queries)
    assert sorted((r.pocket, r.card_id, r.visual, r.number_hit, r.total_hit) for r in got.collect()) == [(0, "a1", 0.9, False, True), (0, "b1", 0.8, True, True), (0, "c7", 0.5, True, True), (0, "d7", 0.0, True, True), (1, "a2", 0.7, False, False)]
    points = spark.createDataFrame([(0, 0, c, 40) for c in ("a1", "b1", "c7", "d7")], at + "card_id string, orb int")
    orb = {r.card_id: r.orb for r in fusion.passes(got, F.col("pocket"), verified=points, best=2).collect() if r.pocket == 0}
    assert orb == {"b1": 40, "a1": 40, "c7": None, "d7": None}
    explicit = spark.createDataFrame([(0, "A", 1)], "page long, set_id string, base long")
    ranked = fusion.passes(got, F.col("pocket"), explicit)
    assert {r.dominant for r in ranked.collect()} == {"A"} and {r.base for r in ranked.collect()} == {1}
    states = spark.createDataFrame([(0, 0, "unknown"), (0, 1, "empty")], at + "state string")
    best = fusion.decide(ranked, F.col("pocket"), states).collect()
    assert [(r.pocket, "card_edges_not_found" in r.flags) for r in best] == [(0, True)]
    cards = spark.createDataFrame([("x2", "A", 2, "TG"), ("a9", "A", 9, ""), ("a2", "A", 2, ""), ("a2b", "A", 2, "")], "card_id string, set_id string, number long, number_prefix string")
    assert sorted((r.number, r.card_id) for r in fusion.main_numbers(cards).collect()) == [(2, "a2"), (9, "a9")]
    pockets = spark.createDataFrame([(0, 1, "empty", "empty", None, 0.0, []), (0, 0, "card", "review", "a1", 0.5, ["f"])], at + "state string, status string, card_id string, probability double, flags array<string>")
    assert [s["pocket"] for s in json.loads(fusion.result_json(pockets).first().json)["slots"]] == [0, 1]


def test_outcomes(spark):
    at = "photo string, pocket int, "
    labels = spark.createDataFrame([("p", 0, "a"), ("p", 1, None), ("p", 2, "?"), ("p", 3, "c"), ("p", 9, "z")], at + "truth string")
    results = spark.createDataFrame([("p", 0, "card"), ("p", 1, "empty"), ("p", 2, "card"), ("p", 3, "empty")], at + "state string")
    ranked = spark.createDataFrame([("p", 0, 1, "b", 0.6, "review"), ("p", 0, 2, "a", 0.4, "review"), ("p", 2, 1, "q", 0.95, "confirmed"), ("p", 0, 5, "x", 0.0, "review")], at + "rank int, card_id string, probability double, status string")
    found = evaluate.outcomes(labels, results, ranked)
    assert sorted((r.pocket, r.truth, r.top, r.probability, r.in_top_k, r.status) for r in found.collect()) == [(0, "a", "b", 0.6, True, "review"), (1, None, None, 0.0, False, "empty"), (2, "?", "q", 0.95, False, "confirmed"), (3, "c", None, 0.0, False, "empty")]
    assert tuple(evaluate.accuracy(found).first()) == (0.0, 0.5, 1.0, 1)
    sweep = evaluate.threshold_sweep(evaluate.confirmable(found), (0.5, 0.9))
    assert sorted((r.threshold, r.auto, r.precision) for r in sweep.collect()) == [(0.5, 2, 0.0), (0.9, 1, 0.0)] and evaluate.recommended(sweep).first().threshold is None
    assert evaluate.recommended(spark.createDataFrame([(0.5, 0.9), (0.9, 0.996), (0.95, 1.0)], "threshold double, precision double")).first().threshold == 0.9
    pages = spark.createDataFrame([(["a", "b"], ["a", "x"]), ([], ["y"])], "expected array<string>, found array<string>")
    assert tuple(evaluate.list_recall(pages).first()) == (0.5, 2)
    trials = spark.createDataFrame([(True, False, None), (False, True, None), (False, False, True), (True, True, None)], "x boolean, y boolean, z boolean")
    assert {r.attempt: (r.alone, r.lost) for r in evaluate.leave_one_out(trials, ["x", "y", "z"]).collect()} == {"x": (0.5, 0.25), "y": (0.5, 0.25), "z": (0.25, 0.25)}
    assert {r.subset: r.accuracy for r in evaluate.subsets(trials.fillna(False), ["x", "y", "z"], 2).collect()} == {"x": 0.5, "y": 0.5, "z": 0.25, "x+y": 0.75, "x+z": 0.75, "y+z": 0.75}


def test_index_by_language(spark, tmp_path):
    rows = [("en/a/2", "high", "ok", "p2"), ("en/a/1", "high", "ok", "p1"), ("ja/a/1", "high", "ok", "p3"), ("en/a/3", "low", "ok", "p4"), ("en/a/4", "high", "error", None), ("en/a/5", "high", "ok", "bad")]
    images = spark.createDataFrame(rows, "card_id string, quality string, status string, path string")
    vectors.build(images, F.when(F.col("path") != "bad", F.array(F.lit(1.0), F.lit(0.5))), str(tmp_path / "ix"), "e", ("en", "ja"), "high")
    back = spark.read.parquet(str(tmp_path / "ix"))
    assert sorted((r.lang, r.id) for r in back.collect()) == [("en", "en/a/1"), ("en", "en/a/2"), ("ja", "ja/a/1")] and vectors.path_of(back, "en/a/2") == "p2" and vectors.path_of(back, "q") is None
    assert vectors.require_embedder(back, "e") is back


def test_page_base_is_fixed_or_voted(spark):
    pages = spark.createDataFrame([(1, 1, 2, 9), (2, 1, None, 9), (3, 1, None, 9)], "page long, start_number long, page_index long, pockets long")
    voted = spark.createDataFrame([(1, 5), (2, 40)], "page long, base long")
    assert sorted(map(tuple, fusion.set_page_base(pages, voted).collect())) == [(1, 19), (2, 40)]


def test_layout(spark):
    def profile(cells, length=240):
        p = [1.0 + 0.01 * (i % 7) for i in range(length)]
        for k in range(1, cells):
            for i in range(-2, 3):
                p[k * length // cells + i] = 0.1
        return p

    def score(p, n):
        half = max(2, int(0.012 * len(p)))
        dips = [min(p[max(0, int(k * len(p) / n) - half) : int(k * len(p) / n) + half + 1]) for k in range(1, n)]
        cells = [np.median(p[int((k + 0.2) * len(p) / n) : int((k + 0.8) * len(p) / n)]) for k in range(n)]
        return (np.median(cells) - np.mean(dips)) / (np.median(cells) + 1e-6)

    df = spark.createDataFrame([(1, profile(3, 210), profile(3, 300)), (2, profile(2, 200), profile(2, 280))], "page long, col_profile array<double>, row_profile array<double>")
    flat, long = [1.0] * 240, [1.0] * 100
    df = df.unionAll(spark.createDataFrame([(3, flat[:180], flat), (4, flat, long)], df.schema))
    got = {r.page: r for r in layout.best_layout(df).collect()}
    assert [(got[3].rows, got[3].cols, got[3].score), (got[4].rows, got[4].cols, got[4].score)] == [(3, 4, 0.0), (3, 3, None)]
    assert (got[1].rows, got[1].cols) == (3, 3) and (got[2].rows, got[2].cols) == (2, 2)
    assert got[1].score == pytest.approx(score(profile(3, 210), 3) + score(profile(3, 300), 3))


def test_fetch(spark):
    def transport(url):
        if url == "boom":
            raise OSError("no route")
        return {"ok": (200, b"body"), "gone": (404, b""), "bad": (403, b"")}[url]

    plan = spark.createDataFrame([("a", "ok"), ("b", "gone"), ("c", "bad"), ("d", "boom")], "card_id string, url string")
    got = {r.card_id: (r.status, r.http_status, r.bytes, r.error) for r in fetch.fetch(plan, transport, "2024-01-01T00:00:00Z", 1, lambda n: 0.0).collect()}
    assert got == {"a": ("ok", 200, 4, None), "b": ("missing", 404, None, None), "c": ("error", None, None, "HTTP 403"), "d": ("error", None, None, "no route")}
    def price(url):
        return {"ok": (200, b'{"pricing": {}}'), "gone": (404, b""), "bad": (403, b""), "boom": (200, b"<html>")}[url]

    got = {r.card_id: (r.status, r.http_status) for r in fetch.fetch_prices(plan, price, "2024-01-01T00:00:00Z", 0).collect()}
    assert got == {"a": ("ok", 200), "b": ("nodata", 404), "c": ("error", None), "d": ("error", None)}
    slept, now = [], [0.0]
    pace = fetch.Pace(4.0, lambda: now[0], slept.append)
    for _ in range(3):
        pace()
    now[0] = 10.0
    pace()
    assert slept == [0.25, 0.5]
    waits, codes = [], iter([503, 500, 200])
    out = fetch.attempt_all("u", lambda u: (next(codes), b"x"), 3, fetch.doubling, "missing", False, waits.append)
    assert out["status"] == "ok" and waits == [1.0, 2.0]


def test_saved_index(spark, tmp_path):
    v, df = index(spark, 12)
    vectors.save(df, "e", str(tmp_path / "i"))
    back = spark.read.parquet(str(tmp_path / "i"))
    assert vectors.require_embedder(back, "e").count() == 12
    assert all(np.allclose(r.embedding, v[r.id].astype(np.float16)) for r in back.collect())


def test_readers(spark, tmp_path):
    record = {"lang": "en", "localId": "1", "serie": {"id": "s"}, "set": {"id": "a"}, "card": {"name": {"en": "One"}, "variants": {"holo": True}}}
    (tmp_path / "r.ndjson").write_text(json.dumps(record) + "\n\n" + json.dumps(record | {"lang": "fr"}) + "\n")
    both = {k: x for k, x in record.items() if k != "lang"} | {"card": {"name": {"en": "O", "ja": "P"}}}
    (tmp_path / "q.ndjson").write_text("\n".join(json.dumps(x) for x in (both, both | {"card": {"name": {"ja": "Q", "en": ""}}}, both | {"serie": {"id": "tcgp"}})))
    got = readers.catalog_records(spark, str(tmp_path / "r.ndjson")).collect()
    assert len(got) == 1 and json.loads(got[0].card.variants) == {"holo": True}
    assert [(r.lang, r.card.name["ja"]) for r in readers.catalog_records(spark, str(tmp_path / "q.ndjson")).orderBy("seq").collect()] == [("en", "P"), ("ja", "P"), ("ja", "Q")]
    (tmp_path / "base1.json").write_text(json.dumps([{"number": "1", "name": "A", "rarity": None}]))
    assert readers.partner_cards(spark, str(tmp_path / "base1.json")).first().set_id == "base1"
    (tmp_path / "sets.json").write_text(json.dumps([{"id": "x", "name": "X", "printedTotal": 3, "releaseDate": "2020/01/02"}]))
    assert readers.partner_sets(spark, str(tmp_path / "sets.json")).first().date == "2020-01-02"
    (tmp_path / "pages.json").write_text(json.dumps([{"photo": "p", "layout": [3, 3], "slots": ["a", None, "?"]}]))
    assert [(r.pocket, r.truth) for r in readers.labelled_pages(spark, str(tmp_path / "pages.json")).collect()] == [(0, "a"), (1, None), (2, "?")]
    (tmp_path / "empty.ndjson").write_text("")
    with pytest.raises(ValueError):
        readers.catalog_records(spark, str(tmp_path / "empty.ndjson"))


def test_stream_upsert(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "card_id long, value string, seq long"
    want = {}
    for k, rows in enumerate([[(i, f"a{i}", 1) for i in range(40)], [(1, "c", 2), (2, "old", 0), (99, "new", 1)], [(1, "d", 3)], [(1, "e", 4)]]):
        want |= {i: v for i, v, s in rows if v != "old"}
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        step = upsert.upsert_into(out, ["card_id"], "seq", 8)
        q = spark.readStream.schema(schema).parquet(str(source)).writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        step(spark.createDataFrame(rows, schema), k)  # run again
        assert {r.card_id: r.value for r in upsert.current(spark, out, schema).collect()} == want
    stored = upsert._stored(spark, out)
    assert max(map(len, stored.values())) <= 2 and len(stored) == 8  # the batches of one key have left the other buckets alone
    assert sum(len(v) for v in stored.values()) < 8 + 6


def test_reports(spark, tmp_path):
    from cardloom.operators import export, reports

    sets = spark.createDataFrame([("en/a", "en", "A|x"), ("ja/b", "ja", "B")], "id string, lang string, name string")
    cards = spark.createDataFrame([("en/a/1", "en"), ("en/a/2", "en"), ("ja/b/1", "ja")], "id string, lang string")
    variants = spark.createDataFrame([("en/a/1",), ("en/a/1",), ("ja/b/1",)], "card_id string")
    issues = spark.createDataFrame([("set", "en/a", "missing_numbers", "1/3 missing: 3"), ("card", "en/a/2", "missing_rarity", ""), ("card", "en/a/1", "duplicate", "f")], "scope string, ref string, kind string, detail string")
    text = reports.catalog_report(sets, cards, variants, issues, {"commit": "unknown"})
    for line in ("- commit: unknown", "| en | 1 | 2 | 2 |", "| ja | 1 | 1 | 1 |", "| en/a | A\\|x | 1/3 missing: 3 |", "| en/a | A\\|x | 1 |", "| duplicate | en/a/1 | f |", "| missing_rarity | 1 |"):
        assert line in text.splitlines(), line
    mapping = spark.createDataFrame([("en/a", "x")], "our_id string, their_id string")
    agreed = spark.createDataFrame([(4, 3, 0.75)], "compared long, agree long, share double")
    text = reports.crosscheck_report(mapping, agreed, spark.createDataFrame([("card", "c", "xcheck_name", "d")], issues.schema), sets.select("id").limit(0), sets.select("id"), "them")
    assert "- cards compared: 4, agreeing: 3 (75.0%)" in text and "| c | d |" in text and "## Sets of them without a partner" in text and "## Sets of the catalog" not in text
    images = spark.createDataFrame([("en/a/1", "ok", None), ("en/a/2", "missing", None), ("ja/b/1", "error", "HTTP 403")], "card_id string, status string, error string")
    text = reports.image_report(images, sets)
    assert "| en | 1 | 1 | 0 |" in text and "| en/a | A\\|x | 1 | 2 |" in text and "| ja/b/1 | HTTP 403 |" in text
    found = spark.createDataFrame([("p", 0, "a", "a", 0.99, True, "confirmed", "card"), ("p", 1, None, None, 0.0, False, "empty", "empty"), ("p", 2, "b", "c", 0.4, False, "review", "card")], "photo string, pocket int, truth string, top string, probability double, in_top_k boolean, status string, state string")
    layouts = spark.createDataFrame([([3, 3], [3, 3])], "expected array<int>, found array<int>")
    text = reports.evaluation_report(found, layouts, spark.createDataFrame([(["a"], ["a"])], "expected array<string>, found array<string>"), 3.0)
    assert "- pages: 1, pockets: 3, cards: 2" in text and "- layouts found: 100.0%" in text and "- wishes found: 100.0%, spurious: 0" in text and "Recommended threshold: 0.5" in text and "| p | 2 | b | c | 0.4 | review |" in text and "| p | 1 |" not in text
    pages = spark.createDataFrame([("p", ["a", None, "?"])], "photo string, slots array<string>")
    export.write_labels(pages, str(tmp_path / "labels"))
    assert [r.truth for r in readers.labelled_pages(spark, str(tmp_path / "labels")).orderBy("pocket").collect()] == ["a", None, "?"]
    export.write_results(spark.createDataFrame([(2, "{}"), (1, "[]")], "page int, json string"), str(tmp_path / "results"))
    assert [r.value for r in spark.read.text(str(tmp_path / "results")).collect()] == ["[]", "{}"]
