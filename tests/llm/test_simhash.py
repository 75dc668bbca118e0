import random

import numpy as np
import pytest
import xxhash

from cardloom.llm import golay, simhash
from cardloom.llm.components import components

DOC = "doc_id long, text string"


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(rows):
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    fps = [brute_fingerprint(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[top(i)] = top(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, f, least[top(i)]) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def test_golay_keys():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 4000, dtype=np.uint32)
    parity, *_ = golay.tables()
    code = (golay.nearest(x) << 11) | parity[golay.nearest(x)]
    assert (np.bitwise_count(code ^ x) <= 3).all()
    row, near = golay.nearby(x)
    words = (near << 11) | parity[near]
    assert (np.bitwise_count(words ^ x[row]) <= 4).all()
    every = (np.arange(4096, dtype=np.uint32) << 11) | parity
    assert [int((np.bitwise_count(every ^ v) <= 4).sum()) for v in x[:300]] == np.bincount(row, minlength=4000)[:300].tolist()


def test_no_pair_within_three_bits_is_lost():
    rng = random.Random(2)
    a = [rng.getrandbits(64) for _ in range(3000)]
    b = []
    for x in a:
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            x ^= 1 << bit
        b.append(x)
    both = np.array(a + b, np.uint64)
    ar, ak = simhash.keys(both, True)
    hr, hk = simhash.keys(both, False)
    asked, has = {}, {}
    for r, k in zip(ar.tolist(), ak.tolist()):
        asked.setdefault(r, set()).add(k)
    for r, k in zip(hr.tolist(), hk.tolist()):
        has.setdefault(r, set()).add(k)
    for i in range(3000):
        j = i + 3000
        assert asked[i] & has.get(j, set()) or asked[j] & has.get(i, set())


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(None, "a b c"), (7, None), (3, ""), (9, " \n\t"), (5, "one"), (6, "One"), (11, "x y z"), (12, "Ünï çödé TEXT")]
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.randint(3, 300))) for _ in range(40)]
    for i, t in enumerate(base):
        rows.append((100 + i, t))
        rows.append((300 - i, t))
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((500 + i, " ".join(w)))
    rows.append((100, base[0]))
    df = spark.createDataFrame(rows, DOC).selectExpr("text as fp", "'x' as component_id", "doc_id", "text", "1 as node")
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == brute_components(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


@pytest.mark.parametrize("n", [1, 40])
def test_chain_and_star(spark, n):
    chain = [(i, i + 1) for i in range(n)]
    star = [(1000, 1001 + i) for i in range(n)]
    got = {tuple(r) for r in components(spark.createDataFrame(chain + star, "u long, v long").repartition(8)).collect()}
    assert got == {(i, 0) for i in range(1, n + 1)} | {(1001 + i, 1000) for i in range(n)}


def test_any_long_is_an_id(spark):
    big = (1 << 63) - 1
    rows = [(big, "same words here now"), (-big, "same words here now"), (1 << 62, "others are there then"), ((1 << 62) + 5, "others are there then"), (None, "nobody knows this one"), (None, None), (-7, "")]
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOC)).collect()), key=str)
    assert got == brute_components(rows)


def test_very_long_text(spark):
    rows = [(1, "a b c " * 400_000), (2, "x" * 1_000_000), (3, "a b c " * 400_000)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
