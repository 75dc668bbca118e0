import random
import re
from collections import Counter
from itertools import product

import numpy as np

from cardloom.llm import quality_rules as Q

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def texts():
    rng = random.Random(13)
    out = ["", " ", "\n\n", "a", "a b c a b c", "x\ny\nx\n \nx", "é ü ß\x85z", "\x1c\x1d a"]
    for _ in range(200):
        out.append("".join(rng.choice(["a", "bb", "é", "#", "|", "漢"]) + rng.choice([" ", " ", "\n", "\t", ""]) for _ in range(rng.randint(0, 90))))
    return out + ["word " * 3000, " ".join(map(str, range(5000)))]


def test_counts_against_brute_force():
    for t in texts():
        assert Q.analyse(t.encode())[0] == brute(t), repr(t)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(14)
    for _ in range(40):
        crf = Q.Crf(rng.normal(size=(2, len(Q.FEATURES))), rng.normal(size=(2, 2)))
        x = rng.integers(0, 2, (rng.integers(1, 7), len(Q.FEATURES))).astype(float)
        s = x @ crf.emit.T
        value = lambda path: sum(s[i, p] for i, p in enumerate(path)) + sum(crf.move[a, b] for a, b in zip(path, path[1:]))  # noqa: E731, B023
        best = max(product((0, 1), repeat=len(x)), key=value)
        assert np.isclose(value(best), value(crf.mark(x).tolist()))


def test_fit_tells_boilerplate(spark):
    rng = random.Random(15)
    vocabulary = [a + b for a in "house garden water river walk home slow".split() for b in "er ing ly ed al ion ness".split()]
    prose = lambda: "\n".join("The " + " ".join(rng.choice(vocabulary) for _ in range(12)) + "." for _ in range(6))
    junk = lambda: "\n".join(" | ".join("$$$" + rng.choice(vocabulary) for _ in range(12)) for _ in range(6))
    rows = [(i, prose() if i % 3 else junk()) for i in range(150)] + [(None, prose()), (900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'y' as y", "0 as kept")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)] + [(None, 1), (7, None), (5, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.judge(docs, Q.fit(docs, labels)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept == (i % 3 > 0) for i in range(150)) and got[None].kept
    assert got[900].base_failed and not got[901].kept and got[900].n_words == 0
    crf = Q.fit(docs.limit(0), labels)
    assert Q.judge(docs.limit(0), crf).count() == 0 and Q.judge(docs, crf).count() == len(rows)


def test_gradient_against_differences():
    rng = np.random.default_rng(16)
    texts = [rng.integers(0, 2, (n, len(Q.FEATURES))).astype(float) for n in (1, 3, 5, 2)]
    labels = [rng.integers(0, 2, len(x)) for x in texts]
    emit, move = rng.normal(size=(2, len(Q.FEATURES))), rng.normal(size=(2, 2))

    def likelihood(emit, move):
        total = 0.0
        for x, y in zip(texts, labels):
            s = x @ emit.T
            value = lambda path: sum(s[i, p] for i, p in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:]))  # noqa: E731, B023
            total += value(y) - np.log(sum(np.exp(value(p)) for p in product((0, 1), repeat=len(x))))
        return total / sum(map(len, texts))

    ge, gm = Q.Crf.gradient(texts, labels)(emit, move)
    for g, w in ((ge, emit), (gm, move)):
        for at in np.ndindex(*w.shape):
            step = np.zeros_like(w)
            step[at] = 1e-5
            up, down = ((emit + s * step, move) if w is emit else (emit, move + s * step) for s in (1, -1))
            assert np.isclose(g[at], (likelihood(*up) - likelihood(*down)) / 2e-5, atol=1e-6)


def test_marks_that_a_label_allows():
    odds = np.array([0.5, -2.0, 1.0, -0.5])
    allowed = lambda marks, good: Q.Crf.allowed(np.array(marks), odds, good).tolist()
    assert allowed([0, 0, 0, 0], 1) == [1, 0, 1, 0] and allowed([0, 1, 0, 1], 1) == [0, 1, 0, 1]
    assert allowed([1, 1, 1, 1], 0) == [1, 0, 1, 1] and allowed([0, 1, 1, 1], 0) == [0, 1, 1, 1]


def test_lines_of_a_document_differ(spark):
    rng = random.Random(17)
    vocabulary = [a + b for a in "house garden water river walk home slow".split() for b in "er ing ly ed al ion ness".split()]
    prose = lambda n: ["The " + " ".join(rng.choice(vocabulary) for _ in range(12)) + "." for _ in range(n)]
    junk = lambda n: [" | ".join("$$$" + rng.choice(vocabulary) for _ in range(12)) for _ in range(n)]
    rows = [(i, "\n".join(prose(8) if i % 2 else prose(2) + junk(6))) for i in range(200)]  # bad documents hold good lines
    rows += [(1000, "\n".join(prose(5) + junk(5))), (1001, "\n".join(junk(2) + prose(9))), (1002, "\n".join(prose(1) + junk(9)))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = Q.judge(docs, Q.fit(docs, labels)).collect()
    share = {r.doc_id: (round(r.content_share, 1), r.kept) for r in got}
    assert len(got) == len(rows) and 0.3 < share[1000][0] < 0.7
    assert share[1001][0] >= 0.7 and share[1001][1] and share[1002][0] < 0.3 and not share[1002][1]
    assert all(share[i] == (1.0, True) if i % 2 else 0.1 < share[i][0] < 0.4 and not share[i][1] for i in range(200))
