import random

import corpus_pipeline as P
import pytest
import sentencepiece

from cardloom.llm import common
from cardloom.llm import queries as Q
from cardloom.llm import sentence_pieces as S


def fixture(spark, folder):
    rng = random.Random(19)
    vocabulary = [a + b for a in "ba ko ri tu me".split() for b in "lan der sto vi nug".split()]
    fill = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = fill(20)
    rows, labels = [], []
    for i in range(240):
        insult = rng.choice(["moron", "imbecile"])
        rows.append((i, f"{fill(40)}\n{fill(6)} {insult} {fill(5)}" if i % 6 == 0 else f"{fill(50)}\n{fill(20)}"))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(500, rows[1][1]), (501, rows[1][1]), (502, f"{fill(30)} {item} {fill(9)}"), (503, f"write to someone@mail.example.com {fill(30)}"), (504, ""), (505, None), (None, fill(33))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, dict(rows)


def test_stages(spark, tmp_path):
    docs, texts = fixture(spark, str(tmp_path))
    kept, columns = {}, docs.columns
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != P.STAGES[-1][0]:
            assert out.columns == columns and out.dtypes == docs.dtypes
        kept[name] = {r.doc_id: r for r in out.collect()}
        docs = spark.createDataFrame(list(kept[name].values()), out.schema)
    assert set(texts) - set(kept["toxicity"]) == set(range(0, 240, 6))
    assert set(kept["toxicity"]) - set(kept["near_duplicates"]) == {500, 501, 505}  # 504 and 505 are both empty
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {502}
    masked = kept["personal_data"]
    assert masked[503].text.startswith("write to <EMAIL> ") and masked[503].n_chars == len(masked[503].text)
    assert all(masked[d].text == (texts[d] or masked[d].text) for d in masked if d != 503)
    sp = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    assert all(list(r.ids) == sp.encode(masked[d].text or "") and r.round_trip for d, r in kept["sentence_pieces"].items())
    final = {r.doc_id: list(r.ids) for r in P.run(spark, str(tmp_path)).collect()}
    assert final == {d: list(r.ids) for d, r in kept["sentence_pieces"].items()}


def left(spark):
    """What lies in this application's shared folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(common.shared_dir(spark))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return len(fs.listStatus(at)) if fs.exists(at) else 0


def test_nothing_is_left_in_the_shared_folder(spark, tmp_path):
    fixture(spark, str(tmp_path))
    spark.createDataFrame([(1, "http://example.com/en/x", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    common.release()
    for name, query in [*Q.QUERIES.items(), ("pipeline", P.run)]:
        df = query(spark, str(tmp_path))
        assert left(spark) <= 2, name  # only what the result itself reads
        df.count()
        common.release()
        assert left(spark) == 0, name


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        applicationId = "a"
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    Context.master = "local-cluster[2,1,1000]"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_shared_ids_and_clashing_columns(spark, tmp_path):
    docs, texts = fixture(spark, str(tmp_path))
    item = next(r.text for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect())
    more = [(1, "another text of the same id " * 3), (7, f"{item} leaks here"), (7, texts[7]), (900, "write to a@b.example.org now")]
    names = "score int, predicted int, spans string, clean_text string, _x int, _row_id int, own_id int, root int, n_term string"
    rows = [(d, t, "en", "s", 0) for d, t in [*texts.items(), *more]]
    given = spark.createDataFrame([(*r, i, 1, f"s{i}", "c", 2, 3, 4, 5, "n") for i, r in enumerate(rows)], f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    by_row = {r.score: r for r in given.collect()}
    now = given
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == given.columns
        now = spark.createDataFrame(out.collect(), out.schema)
    kept = {r.score: r for r in now.collect()}
    for k, r in kept.items():
        assert all(r[c] == by_row[k][c] for c in given.columns if c not in ("text", "n_chars"))
    n = len(texts)
    assert n in kept and 1 in kept  # both rows of doc_id 1
    assert n + 1 not in kept and (n + 2 in kept) != (7 in kept)  # the leak goes, and one of the two equal rows
    assert kept[n + 3].text == "write to <EMAIL> now"


def test_empty_tables(spark, tmp_path):
    docs, _ = fixture(spark, str(tmp_path / "full"))
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0
    now = docs
    for _, stage in P.STAGES:  # no labels and no benchmark: nothing is toxic or a leak
        now = stage(spark, now, f"{tmp_path}/none")
    assert now.count() == docs.count() - 3
