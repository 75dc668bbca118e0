import itertools
import math
import random
import re

from cardloom.llm import decontaminate as D

DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def best(doc, item, run):
    top = 0
    for shift in range(-len(item), len(doc)):
        same = [int(0 <= p < len(doc) and 0 <= p - shift < len(item) and doc[p] == item[p - shift]) for p in range(max(0, shift), min(len(doc), shift + len(item)))]
        top = max([top, *(sum(same[i : i + run]) for i in range(len(same) - run + 1))])
    return top


def corpus():
    rng = random.Random(11)
    passage = lambda n: [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 30)) for _ in range(n)]
    items = [(k, passage(rng.randint(5, 40))) for k in range(12)]
    docs = []
    for i in range(60):
        k, part = rng.choice(items)
        part = list(part)
        for _ in range(rng.randint(0, 3)):
            part[rng.randrange(len(part))] = "zz"
        body = passage(rng.randint(0, 40)) + (part if i % 2 else []) + passage(rng.randint(0, 40))
        docs.append((i, " ".join(body) if i % 3 else ", ".join(body).upper()))
    return docs, [(k, " ".join(p)) for k, p in items]


def test_against_brute_force(spark):
    docs, items = corpus()
    got = {(r.doc_id, r.item_id): (r.n_equal, r.n_run) for r in D.contaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()}
    want = {}
    for d, t in docs:
        for k, p in items:
            w, v = words(t), words(p)
            run = min(13, len(v))
            top = best(w, v, run)
            if top >= 0.8 * run:
                want[d, k] = (top, run)
    assert set(got) <= set(want) and all(got[p][0] <= want[p][0] for p in got)
    missed = [p for p in want if p not in got]
    assert len(missed) <= 0.05 * len(want), missed  # overlaps whose every window has a substitution under each mask
    assert all(p in got for p, (n, run) in want.items() if n == run)


def test_shuffled_seeds_agree(spark, monkeypatch):
    docs, items = corpus()
    a, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    few = sorted(map(tuple, D.contaminated(a, b).collect()))
    monkeypatch.setattr(D, "MOST_BROADCAST", -1)
    assert sorted(map(tuple, D.contaminated(a, b).collect())) == few


def test_edges(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (None, text), (4, "x " * 5000 + text)], DOC).selectExpr("doc_id", "text", "1 as item_id", "'a' as hash", "2 as pos")
    items = spark.createDataFrame([(9, text), (9, text), (8, None), (7, "short one"), (None, text)], ITEM).selectExpr("item_id", "text", "5 as doc_id")
    assert sorted(map(tuple, D.contaminated(docs, items).collect())) == [(1, 9, 7, 7), (4, 9, 7, 7)]
    assert D.contaminated(docs.limit(0), items).count() == 0 and D.contaminated(docs, items.limit(0)).count() == 0


def test_every_allowed_substitution_is_found(spark, monkeypatch):
    items = [(n, [f"{chr(97 + n)}{i}" for i in range(n)]) for n in range(1, 14)]
    docs, want = [], set()
    for n, item in items:
        for k in range(n - math.ceil(0.8 * n) + 1):
            for places in itertools.combinations(range(n), k):
                docs.append((len(docs), " ".join(["q", *("zz" if i in places else w for i, w in enumerate(item)), "r"])))
                want.add((len(docs) - 1, n, n - k, n))
        docs += [(-n, " ".join(["zz"] * (n - math.ceil(0.8 * n) + 1) + item[n - math.ceil(0.8 * n) + 1 :]))]
    a = spark.createDataFrame(docs, DOC)
    b = spark.createDataFrame([(n, " ".join(w)) for n, w in items], ITEM)
    assert set(map(tuple, D.contaminated(a, b).collect())) == want
    monkeypatch.setattr(D, "MOST_BROADCAST", -1)
    assert set(map(tuple, D.contaminated(a, b).collect())) == want
