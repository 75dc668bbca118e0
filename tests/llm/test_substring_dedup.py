import hashlib
import random

from cardloom.llm import substring_dedup as S


def brute(rows):
    docs = [(1 << 63 if d is None else d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in docs:
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            first[key] = min(first.get(key, (d, s)), (d, s))
    out = []
    for (d, t), (o, w) in zip(rows, docs):
        keep = [True] * len(w)
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (o, s):
                keep[s : s + 20] = [False] * 20
        kept = b" ".join(x for x, k in zip(w, keep) if k)
        out.append((str(d), len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["naïve", "##", "The"]
    passage = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [passage(rng.randint(15, 60)) for _ in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            part = rng.choice(shared)
            a = rng.randrange(len(part))
            words += rng.choice([passage(rng.randint(0, 30)), part, part[a:], part[:a], passage(1) * rng.randint(1, 50)])
        if words and rng.random() < 0.2:
            words[rng.randrange(len(words))] = "edited"
        rows.append((i * 7 % 113 if i < 113 else 1000 + i, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows + [(None, " ".join(shared[0])), (2000, None), (2001, ""), (2002, " ".join(shared[1])), (2003, " ".join(shared[1]) + " "), (5000, " ".join(shared[2])), (5000, " ".join(shared[2]))]


def test_against_brute_force(spark, monkeypatch):
    for seed, block in ((1, 1 << 20), (2, 900)):
        monkeypatch.setattr(S, "SHARD", block)
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("text", "doc_id", "1 as block", "2 as uid")
        got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in S.deduplicated(df, seed == 1).collect())
        assert got == brute(rows)


def test_empty(spark):
    assert S.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_passage_in_all_documents_and_copies(spark, monkeypatch):
    rng = random.Random(3)
    own = lambda n: [f"v{rng.randrange(4000)}" for _ in range(n)]
    passage, copy = own(45), " ".join(own(70))
    rows = [(i, " ".join([*own(rng.randint(0, 40)), *passage, *own(rng.randint(0, 40))])) for i in range(150)]
    rows += [(1000 + i, copy) for i in range(100)] + [(None, copy)] * 3
    for shard in (1 << 20, 4000):
        monkeypatch.setattr(S, "SHARD", shard)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in S.deduplicated(df, False).collect())
        assert got == brute(rows)


def test_long_texts(spark):
    rows = [(1, "a b c d e " * 60_000), (2, "x" * 1_000_000), (3, " ".join(map(str, range(200_000)))), (4, " ".join(map(str, range(100_000, 100_030))))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in S.deduplicated(df, False).collect()}
    assert got == {1: (300_000, 299_995), 2: (1, 0), 3: (200_000, 0), 4: (30, 30)}


def test_against_sql(spark):
    import duckdb

    at = "/root/testdata/sf0.001/documents.parquet"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{at}'")
    want = sorted(duckdb.sql(S.oracle_sql()).fetchall())
    assert sorted(map(tuple, S.deduplicated(spark.read.parquet(at), False).collect())) == want and sum(r[2] for r in want) > 0
