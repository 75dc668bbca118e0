import random

import corpus_pipeline as P
import numpy as np

from cardloom.llm import near_copies as N


def jaccard(a, b):
    runs = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(len(w) - 4, 1))}
    return len(runs(a) & runs(b)) / len(runs(a) | runs(b))


def corpus():
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([12, 60, 300]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            other = base[:]
            for _ in range(rng.randrange(1, 1 + max(1, len(base) // 40))):
                other[rng.randrange(len(other))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(other))
    return texts + ["a b", "A  b", "a c", "", None]


def brute(texts):
    root = list(range(len(texts)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, a in enumerate(texts):
        for j in range(i):
            if jaccard(a or "", texts[j] or "") >= 0.8:
                root[max(top(i), top(j))] = min(top(i), top(j))
    return {i for i in range(len(texts)) if root[i] == i}


def test_stage_against_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect()} == brute(texts)


def test_a_bucket_of_several_components(spark):
    # A chain: each text is similar to its neighbours only, so no one text of a bucket is similar to all others.
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[20 * i : 20 * i + 200]) for i in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect()} == brute(texts)
    assert N.near_copies(docs.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    rows = [(1, texts[0], "x"), (1, texts[1], "x"), (1, texts[1], "y"), (1, texts[1].upper(), "z"), (1, texts[0], "x"), (2, texts[1], "x"), (2, texts[2], "x"), (2, texts[2], "x")]
    docs = [spark.createDataFrame(some, "doc_id long, text string, lang string") for some in (rows, rows[::-1])]
    a, b = (sorted(map(tuple, P.drop_near_duplicates(spark, d.repartition(3), "").collect())) for d in docs)
    assert a == b and [(d, t.lower()) for d, t, _ in a] == [(1, texts[0]), (1, texts[1]), (2, texts[2])]


def test_overlaps_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(30)]
    for width in (1 << 14, 7):
        monkeypatch.setattr(N, "WIDTH", width)
        assert N.overlaps(sets).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    monkeypatch.setattr(N, "BLOCK", 5)
    rows = [(k, 100 * k + i, 1 if i < 23 else i) for k in (1, 2) for i in range(40)]  # a component of 23 nodes, 17 others
    groups = {}
    for r in N._blocks(spark.createDataFrame(rows, "key long, node long, root long")).collect():
        groups.setdefault(r.group, []).append((r.node, r.root))
    met = {(min(a, b)[0], max(a, b)[0]) for g in groups.values() for a in g for b in g if a[1] != b[1]}
    want = {(min(a, b), max(a, b)) for k, a, x in rows for m, b, y in rows if k == m and x != y}
    assert met == want and max(map(len, groups.values())) < 40


def test_what_stays_apart_from_the_original(spark, monkeypatch):
    """Copies changed in four places or more are near each other only where their changes agree."""
    monkeypatch.setattr(N, "BLOCK", 4)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(0, 150, 6), rng.choice([1, 2, 3, 4, 5])):
            words[at] = f"e{at}x{rng.randrange(2)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in N.near_copies(df).collect():
        got.setdefault(r.root, set()).add(r.doc_id)
    sets = [N.shingles(t.encode()) for t in texts]
    parent = list(range(60))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(60):
        for j in range(i):
            if N.similar(sets[i], sets[j]):
                parent[top(i)] = top(j)
    want = {}
    for i in range(60):
        want.setdefault(top(i), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) > 1


def test_nodes_that_meet_in_many_buckets_are_dealt_out_once(spark, monkeypatch):
    """Copies of one text, most of them changed too much to be near it, share dozens of buckets with each other."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    for i in range(119):
        words = list(base)
        for at in rng.sample(range(0, 150, 6), rng.choice([2, 4, 4, 5])):
            words[at] = f"e{at}x{rng.randrange(2)}"
        texts.append(" ".join(words))
    dealt, blocks = [], N._blocks

    def counted(every):
        out = blocks(every)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(N, "_blocks", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.root for r in N.near_copies(df).collect()}
    sets = [N.shingles(t.encode()) for t in texts]
    assert all(got[i] == got[j] for i in range(120) for j in range(i) if N.similar(sets[i], sets[j])) and len(set(got.values())) > 1
    assert sum(dealt) < 4 * len(texts)


def test_fingerprints_and_codewords():
    rng = np.random.default_rng(4)
    own = np.unique(rng.integers(0, 1 << 63, 501).astype(np.uint64))
    bits = [N._mixed(own * m) for m in N._VOTES]
    want = [sum(int(2 * int((bits[(23 * k + i) // 64] >> np.uint64((23 * k + i) % 64) & np.uint64(1)).sum()) > len(own)) << i for i in range(23)) for k in range(N.FUZZY)]
    assert N.fingerprint(own).tolist() == want
    word = np.array(want, np.uint32)
    other = word ^ (np.uint32(1) << rng.integers(0, 23, N.FUZZY).astype(np.uint32))
    anchor = np.arange(N.FUZZY)
    met = lambda a, w: set(zip(*map(np.ndarray.tolist, N.keys(a, w))))
    assert {k for k, _ in met(anchor, word) & met(anchor, other)} == set(range(N.FUZZY))  # a bit's difference loses no pair
    assert not {k for _, k in met(anchor, word)} & {k for _, k in met(anchor + 100, word)}


def test_keys_meet_at_the_least_similarity():
    """Sets at 0.8 share a key, however small; sets with a few shingles in common don't."""
    rng = np.random.default_rng(5)

    def meet(common, a, b):
        x = np.unique(rng.integers(0, 1 << 63, common + a + b).astype(np.uint64))
        rng.shuffle(x)
        pair = np.unique(x[: common + a]), np.unique(np.concatenate([x[:common], x[common + a :]]))
        one, two = (set(N.keys(np.array(N.anchors(s)), N.fingerprint(s))[1].tolist()) for s in pair)
        return bool(one & two)

    assert all(meet(*sizes) for sizes in ((4, 1, 0), (8, 1, 1), (80, 10, 10), (400, 100, 0)) for _ in range(100))
    assert sum(meet(9, 91, 91) for _ in range(100)) <= 2
