import random

import numpy as np

from cardloom.llm import toxicity as X


def plain_edits(a, b):
    prev = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        now = [i]
        for j, d in enumerate(b, 1):
            now.append(min(prev[j] + 1, now[-1] + 1, prev[j - 1] + (c != d)))
        prev = now
    return prev[-1]


def test_matcher_against_edit_distance():
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 11)))
    lexicon = {word(): 1.0 + i / 100 for i in range(25)}
    m = X.Matcher(lexicon, {"cab": 9.0})
    for _ in range(3000):
        w = word()
        limit = 0 if len(w) < X.EXACT_BELOW else 1 if len(w) < X.TWO_FROM else 2
        near = [(plain_edits(w, t), -v) for t, v in lexicon.items() if plain_edits(w, t) <= limit]
        want = (-min(near)[1], min(near)[0], False) if near else None
        if w.startswith("cab") and (want is None or want[1] > 0):
            want = (9.0, 0, True)
        assert m.find(w) == want, w


def test_normal():
    assert X.normal('"Id1ot!!"') == "idiot" and X.normal("1234") == "" and X.normal("s.t.u.p.i.d") == "stupid" and X.normal("ÄRGER") == "ärger"


def fixture(spark):
    rng = random.Random(17)
    fill = lambda n: " ".join(rng.choice("house garden water river walked home slowly the of and".split()) + rng.choice(["", "s"]) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        insult = rng.choice(["moron", "imbecile", "scoundrel"])
        text = f"{fill(15)}\n{fill(6)} {insult} {fill(5)}" if toxic else f"{fill(25)}\n{fill(9)}"
        rows.append((i, text))
        labels.append((i, int(toxic)))
    extra = [(1000, f"{fill(8)} imbecil {fill(4)}"), (1001, None), (1002, ""), (None, fill(5)), (1003, fill(20))]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").selectExpr("doc_id", "text", "7 as score", "'a' as y")
    return docs, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")


def test_learns_and_catches_misspelled_terms(spark):
    docs, labels = fixture(spark)
    model = X.fit(docs, labels)
    assert {"moron", "imbecile", "scoundrel"} <= set(model.lexicon[0])
    rows = X.score(docs, model).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 405 and all(0 <= r.score <= 1 for r in rows)
    held = [(got[i].predicted, int(i % 4 == 0)) for i in range(400) if got[i].held_out]
    assert len(held) > 80 and np.mean([p == y for p, y in held]) > 0.97
    assert got[1000].score > got[1003].score and got[1001].predicted == got[1002].predicted == got[1003].predicted == 0
    assert not got[None].held_out


def test_empty(spark):
    docs, labels = fixture(spark)
    model = X.fit(docs.limit(0), labels)
    assert X.score(docs.limit(0), model).count() == 0 and X.score(docs, model).count() == 405


def test_quotation_is_told_from_abuse(spark):
    docs, labels = fixture(spark)
    model = X.fit(docs, labels)
    said = [(1, "house garden you are a moron and the water"), (2, 'house garden she wrote "moron" and the water'), (3, "house the word moron is an insult and the water"), (4, "“moron” he quoted"), (5, "walked home moron slowly")]
    got = {r.doc_id: r for r in X.score(spark.createDataFrame(said * 2, "doc_id long, text string"), model).collect()}
    assert [got[i].predicted for i in range(1, 6)] == [1, 0, 0, 0, 1] and max(got[i].score for i in (2, 3, 4)) < 0.5 < got[5].score


def test_clashing_columns_repeated_rows_and_long_texts(spark):
    docs, labels = fixture(spark)
    model = X.fit(docs, labels)
    given = spark.createDataFrame([(1, "a moron", 3, 4), (1, "a moron", 3, 4), (2, "water " * 300_000 + "moron", 5, 6), (3, "x" * 1_000_000, 0, 0)], "doc_id long, text string, _x int, _X_ int")
    out = X.scored(given, model).collect()
    assert sorted((r.doc_id, r._x, r._X_) for r in out) == [(1, 3, 4), (1, 3, 4), (2, 5, 6), (3, 0, 0)] and len({r.score for r in out if r.doc_id == 1}) == 1


def test_mostly_toxic_samples_have_a_lexicon(spark):
    rows = [(i, f"line of number {i} with moron" if i % 10 else f"line of number {i} is clean") for i in range(600)]
    model = X.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(600)], "doc_id long, toxic int"))
    assert "moron" in model.lexicon[0]
