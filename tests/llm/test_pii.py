import hashlib
import math
import random
import re
import time

from cardloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_against_brute_force():
    rng = random.Random(6)
    parts = ["a", "b.c", "@", "@x.org", "x@y.z", "1.2.3.4", "300.1.1.1", "1.2", ".", "4111 1111 1111 1111", "4111111111111111", "+1 (234) 555-0199", "+", "-", " ", "é", "\n", "0", "12", "(", ")", "%"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == brute(t), t


def corpus():
    rng = random.Random(7)
    fill = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of"]) + str(rng.randint(0, 40)) * rng.randint(0, 1) for _ in range(n))
    rows = [(i, f"{fill(9)} Zorblax, write to zor@blax.org {fill(8)}") for i in range(6)]
    rows += [(100 + i, f"{fill(30)}") for i in range(60)]
    rows += [(200, "only Zorblax here"), (201, None), (202, ""), (None, "call +1 234 555 0199 now")]
    return rows


def test_terms_that_disclose(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string").selectExpr("doc_id", "text", "'x' as spans", "1 as entity", "2 as term")
    rows = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert rows[200].spans == "term:5:12" and rows[200].clean_text == "only <TERM> here"
    assert rows[201].clean_text is None and rows[201].spans == "" and rows[202].clean_text == ""
    assert rows[None].n_phone == 1 and rows[None].clean_text == "call <PHONE> now"
    assert rows[0].n_email == 1 and "zor@blax.org" not in rows[0].clean_text and "Zorblax" not in rows[0].clean_text
    assert rows[120].n_term == 0
    t = dict(corpus())[3]
    at = t.index("zor@")
    assert rows[3].base_sha256 == hashlib.sha256(f"email:{at}:{at + 12}".encode()).hexdigest()


def test_joined_terms_agree(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    few = sorted(map(str, pii.sanitise(df).collect()))
    monkeypatch.setattr(pii, "MOST_BROADCAST", -1)
    assert sorted(map(str, pii.sanitise(df).collect())) == few


def test_empty(spark):
    assert pii.sanitise(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_do_not_suppress_a_term(spark):
    fill = lambda i: " ".join(f"w{(i * 7 + k) % 97}x{i % 13}" for k in range(20))
    rows = [f"{fill(i)} Zorblax zor@blax.org {fill(i + 50)}" for i in range(5)] + [fill(1000 + i) for i in range(300)]
    near = f"{fill(7)} Zorblax zor@blax.org {fill(8)}"
    far = f"{fill(9)} Zorblax"
    df = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    plain = {r.term: r.disclosure for r in pii.disclosing(df([*rows, near, far])).collect()}
    copied = {r.term: r.disclosure for r in pii.disclosing(df([*rows, *[near] * 40, *[far] * 200])).collect()}
    assert "zorblax" in plain and copied == plain


def test_two_texts_disclose_in_a_large_corpus(spark):
    rows = [f"n{i} Zorblax zor@blax.org m{i}" for i in range(2)] + [f"t{i} of a t{i + 1}" for i in range(3000)]
    found = {r.term for r in pii.disclosing(spark.createDataFrame([(t,) for t in rows], "text string")).collect()}
    assert "zorblax" in found and not found & {"of", "a"}


def test_terms_beside_an_entity_however_far():
    rng = random.Random(2)
    for gap in (" ", " " * 300, " " + "7 " * 500, f" {'z' * 400} "):
        for _ in range(50):
            left, right = ([rng.choice(["ab", "12", "(cd)", "--", "é"]) for _ in range(rng.randrange(12))] for _ in range(2))
            text = gap.join([*left, "x@y.org", *right])
            at = text.index("x@y.org")
            terms = lambda t: [w for w in map(pii.normal, t.split()) if w]
            assert list(pii.beside(text, [(at, 0, at + 7)])) == [(terms(text[:at])[-5:], terms(text[at + 7 :])[:5])]


def test_terms_far_from_an_entity_are_counted(spark):
    rows = [f"Zorblax {'7 ' * 300}zor@blax.org" for i in range(6)] + [f"t{i} of t{i + 1}" for i in range(100)]
    rows = [f"{t} end{i}" for i, t in enumerate(rows)]
    assert "zorblax" in {r.term for r in pii.disclosing(spark.createDataFrame([(t,) for t in rows], "text string")).collect()}


def test_very_long_texts_take_linear_time():
    began = time.perf_counter()
    for text in ("7" * 1_000_000, "1." * 500_000, "a@" * 300_000, "+1" + " (" * 400_000, "0" * 5000 + "1.0.0.0", "x" * 1_000_000 + "@y"):
        pii.base_spans(text)
    assert time.perf_counter() - began < 10
    assert pii.base_spans("0" * 5000 + "1.0.0.255") == [(0, 1, 5009)] and pii.base_spans("1.2.3.4.5.6.7.8") == [(0, 1, 7), (8, 1, 15)]


def brute_disclosure(texts):
    """Of each term, the most that it says of an entity, by the definition, over different texts."""
    near, words, mentions = {}, {}, {}
    different = sorted({t for t in texts if t is not None})
    for i, t in enumerate(different):
        for w in {pii.normal(w) for w in re.split(r"[\x20\x09-\x0D]+", t)} - {""}:
            words.setdefault(w, set()).add(i)
        spans = pii.base_spans(t)
        for span, (before, after) in zip(spans, pii.beside(t, spans)):
            e = pii.entity(t, span)
            mentions.setdefault(e, set()).add(i)
            for w in {*before, *after}:
                near.setdefault((e, w), set()).add(i)
    n, out = len(set(texts)), {}
    for (e, w), at in near.items():
        prior = len(mentions[e]) / n
        given = (len(at) + pii.SUPPORT * prior) / (max(len(at), len(words.get(w, ()))) + pii.SUPPORT)
        share = math.log2(given / prior) / -math.log2(prior) if prior < 1 else 0.0
        if w in words and share >= pii.DISCLOSURE:
            out[w] = max(out.get(w, 0.0), round(share, 9))
    return out


def test_disclosure_against_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["Ångström", "x@y.org", "a@b.net", "10.0.0.7", "(Zed),", "--"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    texts += [f"{rng.choice(words[:60])} Unique{i} me{i}@mail.org {k} {rng.choice(words[:60])}" for i in range(30) for k in range(4)] + [f"filler {i} w{i % 60}" for i in range(500)] + texts[:30] + texts[:5] * 4 + [None, "", None]
    got = {r.term: round(r.disclosure, 9) for r in pii.disclosing(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)).collect()}
    assert got == brute_disclosure(texts) and len(got) > 20


def test_columns_of_its_own_names(spark):
    docs = spark.createDataFrame([(1, "a@b.org x", 5, 6, 7)], "doc_id long, text string, _key int, _terms int, Spans int")
    row = pii.sanitise(docs).first()
    assert (row._key, row._terms, row.n_email) == (5, 6, 1) and row.spans == "email:0:7"
    assert pii.sanitise(docs.unionAll(docs)).count() == 2
