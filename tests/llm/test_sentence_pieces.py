import random
import time

import numpy as np
import pytest
import sentencepiece

from cardloom.llm import sentence_pieces as S


@pytest.fixture(scope="module")
def both():
    return S.Vocabulary.read(), sentencepiece.SentencePieceProcessor(model_file=S.MODEL)


def check(both, texts):
    v, sp = both
    got = [np.frombuffer(p, np.int32).tolist() for p in S.encoder(v).encode([t.encode() for t in texts])]
    for t, ids in zip(texts, got):
        assert ids == sp.encode(t), repr(t)
        if S.SPACE not in t:
            assert S.decode(v, ids) == t.encode()


def test_against_the_library(both):
    rng = random.Random(4)
    syllables = "th er on an the re and ing ion éau çon schaft keit ñez über ß aaa lll ooo 00 123 !! ... $$ 漢字 が \U0001f600 ﬁ".split()
    texts = ["", " ", "  ", "\n", "a", "  Hello   world\n\tx  ", "a▁b", "\x00x", "<s> </s> <unk> <0x0A>", "x" * 500, " " * 70, "\n\n \n"]
    for _ in range(400):
        texts.append("".join(rng.choice(syllables) + rng.choice(["", "", " ", "  ", "\n", "\t"]) for _ in range(rng.randint(1, 60))))
    for _ in range(200):
        texts.append("".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x400, 0xD7FF), rng.randint(0x10000, 0x10FFF)])) for _ in range(rng.randint(1, 40))))
    check(both, texts)


def test_documents_against_the_library(both):
    import pyarrow.parquet as pq

    check(both, pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist())


def test_frame(spark, both):
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, "x"), (1, "Hello world")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "1 as ids", "'a' as n_tokens")
    got = sorted(((r.doc_id, list(r.ids), r.n_tokens, r.round_trip) for r in S.encoded(df).collect()), key=str)
    ids = both[1].encode("Hello world")
    assert got == sorted([(1, ids, len(ids), True)] * 2 + [(2, [], 0, True), (3, [], 0, True), (None, both[1].encode("x"), 1, True)], key=str)
    assert S.encoded(df.limit(0)).count() == 0


def test_long_runs_take_little_time(both):
    v, sp = both
    began = time.perf_counter()
    texts = [" " * 100_000 + "word", "\0" * 50_000, " \0" * 30_000, "x" * 300_000, " " * 33 + "a" + " " * 17 + "\n" + " " * 9]
    for t in texts:
        (packed,) = S.encoder(v).encode([t.encode()])
        assert np.frombuffer(packed, np.int32).tolist() == sp.encode(t), repr(t[:20])
    assert time.perf_counter() - began < 20


def test_merging_by_heap_is_merging_by_definition(both):
    """Again and again the neighbours whose piece scores best, the leftmost on ties."""
    v, _ = both
    enc, rng = S.encoder(v), random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice([S.SPACE, S.SPACE * 3, "a", "th", "e", "in", "\0", "ß", "00"]) for _ in range(rng.choice([rng.randint(1, 6), rng.randint(7, 40)])))
        parts = list(text)
        while True:
            fits = [(-v.pieces[a + b][1], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in v.pieces]
            if not fits:
                break
            i = min(fits)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert enc.merged(text) == parts, repr(text)
