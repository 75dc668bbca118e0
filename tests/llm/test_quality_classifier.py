import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cardloom.llm import quality_classifier as C
from cardloom.llm import word_shapes as W


def fixture(spark):
    rng = random.Random(18)
    good = lambda: " ".join(rng.choice("house garden water river walked home slowly the of and".split()) for _ in range(rng.randint(20, 60)))
    bad = lambda: rng.choice([" | ".join("BUY$$$" for _ in range(30)), ("spam " * 40).strip(), good().upper().replace(" ", "!! ")])
    rows = [(i, good() if i % 3 else bad()) for i in range(450)]
    docs = spark.createDataFrame(rows + [(1001, None), (1002, ""), (None, good())], "doc_id long, text string").selectExpr("text", "doc_id", "1 as out", "'z' as bucket")
    return docs, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(450)] + [(None, 1), (3, None)], "doc_id long, quality int")


@pytest.mark.parametrize("most", [C.WORDS, 6, 0])  # words of their own, some in buckets, all in buckets
def test_word_vectors_against_brute_force(spark, most):
    docs, _ = fixture(spark)
    texts = [(r.text or "").encode() for r in docs.collect()]
    count = Counter(C.shape_of(w) for t in texts for w in t.split())
    words = C.vocabulary(docs.repartition(3), most)
    assert len(words) <= most and (most < C.WORDS or set(words) == set(count))
    assert min((count[w] for w in words), default=1 << 60) >= max((n for w, n in count.items() if w not in words), default=0) / 2 ** (1 / 8)
    got = C.word_vectors(docs.repartition(3), words)
    place, sign = C.index_vectors(words)
    index = np.zeros((len(words) + C.BUCKETS, C.DIMS))
    for b in range(len(index)):
        for k in range(C.NONZERO):
            index[b, place[b, k]] += sign[b, k]
    want = np.zeros_like(index)
    slots = C.Slots(words)
    assert all(slots[w] == words.get(C.shape_of(w), slots[w]) for t in texts for w in t.split())
    for t in texts:
        ids = slots.of(t).tolist()
        for i, b in enumerate(ids):
            for j in range(max(0, i - C.WINDOW), min(len(ids), i + C.WINDOW + 1)):
                if j != i:
                    want[b] += index[ids[j]]
    size = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, np.divide(want, size, out=np.zeros_like(want), where=size > 0), atol=1e-6)


def test_held_out_accuracy(spark):
    docs, labels = fixture(spark)
    rows = C.score(docs, *C.fit(docs, labels)).collect()
    got = {r.doc_id: r for r in rows}
    held = [(got[i].predicted, int(i % 3 > 0)) for i in range(450) if got[i].held_out]
    assert len(rows) == 453 and len(held) > 90 and np.mean([p == y for p, y in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and not got[None].held_out


def test_empty(spark):
    docs, labels = fixture(spark)
    fitted = C.fit(docs.limit(0), labels)
    assert C.score(docs.limit(0), *fitted).count() == 0 and C.score(docs, *fitted).count() == 453


def test_long_and_repeated_texts(spark):
    docs, labels = fixture(spark)
    fitted = C.fit(docs, labels)
    rows = [(1, "word " * 400_000), (2, "x" * 1_000_000), (3, "same text here"), (3, "same text here")]
    got = C.score(spark.createDataFrame(rows, "doc_id long, text string"), *fitted).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id == 3}) == 1


ODD = ["The HOUSE, the end.", None, "", " \t ", "A É ÉA Éa x1 12-34 !!! $$$a a--B HELLO-World 7 \x1c\x00 x\x85y", "é" * 40 + " " + "x" * 31 + " " + "Y" * 32 + " z" * 3, "\n\x0bend", "AB", "CD", "a!b!!c!!!D9E99"]


@pytest.mark.parametrize("piece", [1, 7, 100, W.PIECE])
def test_shapes_of_a_batch_equal_those_of_single_words(monkeypatch, piece):
    monkeypatch.setattr(W, "PIECE", piece)
    rng = random.Random(8)
    signs = ["A", "B", "z", "q", "é", "É", "0", "7", " ", "\n", "!", "!", "-", "\0", "\x1c", "xyzw" * 5]
    for _ in range(50):
        texts = ODD + [None if rng.random() < 0.1 else "".join(rng.choices(signs, k=rng.choice([0, 1, 2, 30, 200]))) for _ in range(rng.choice([0, 1, 8]))]
        rng.shuffle(texts)
        column = pa.array(["Before ME", *texts, "after"]).slice(1, len(texts))  # neighbours in the buffer aren't read
        want = [[C.shape_of(w) for w in (t or "").encode().split()] for t in texts]
        flat, met = [w for words in want for w in words], C.Met()
        pieces = list(W.Shapes.of(column))
        assert sum(p.words for p in pieces).tolist() == [len(words) for words in want]
        assert [w for p in pieces for w in p.bytes_of(np.arange(len(p.hash))).to_pylist()] == flat
        assert [h for p in pieces for h in p.hash.tolist()] == [xxhash.xxh64_intdigest(w, 7) for w in flat]
        slots = C.Slots({w: i for i, w in enumerate(sorted(set(flat))[::2])})
        rows, words_in = slots.of_all(column)
        assert rows.tolist() == [slots[w] for t in texts for w in (t or "").encode().split()] and words_in.sum() == len(flat)
        for p in pieces:
            met.add(p)
        found, count = met.found(), Counter(flat)
        assert len(found["word"]) == len(count) and dict(zip(found["word"].to_pylist(), found["n"].to_pylist())) == count
    for none in ([], [None], ["", " "]):
        assert not len(C.Slots({}).of_all(pa.array(none, pa.string()))[0])


def test_blocks_do_not_show(spark, monkeypatch):
    docs, _ = fixture(spark)
    words = C.vocabulary(docs, 6)
    want = C.word_vectors(docs, words)
    ids = np.random.default_rng(1).integers(0, len(want), 1000)
    one = C.pooled(ids, want)
    monkeypatch.setattr(C, "BLOCK", 3)
    assert np.allclose(C.pooled(ids, want), one, atol=1e-6)
    assert np.array_equal(C.word_vectors(docs, words), want)


def test_rows_whose_places_clash():
    hashes = np.array([0, 1, 1 << 40, 1 << 41, 2, 1 << 42 | 1], np.uint64)
    rows = C.Rows(hashes)
    assert rows.of(hashes).tolist() == list(range(6))
    assert rows.of(np.array([1 << 43, 3, 1 << 43 | 2], np.uint64)).tolist() == [-1, -1, -1]


def test_a_batch_is_many_times_cheaper_than_single_words():
    """op8 took 1097 CPU seconds a GB (CHECK_r02), most of them for the shapes and rows of single words."""
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} Bb{i}." for i in range(17_576))
    words, column = text.encode().split(), pa.array([text] * 8)
    slots = C.Slots({})

    def cost(run):
        began = time.process_time()
        run()
        return time.process_time() - began

    assert 3 * min(cost(lambda: slots.of_all(column)) for _ in range(3)) < 8 * min(cost(lambda: [C.shape_of(w) for w in words]) for _ in range(3))
