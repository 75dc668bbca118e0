import random
import re

from cardloom.llm import url_filter as U


def pattern(glob):
    return re.compile("".join("(?s:.*)" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*\*|\*)", glob)))


def test_automaton_against_regex():
    rng = random.Random(12)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "é", "."]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs] + ["x" * 80 + "*", "**" + "y" * 70]
    a = U.compile_globs(globs)
    texts = ["".join(rng.choice("ab/é.") for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["", "x" * 300, "y" * 70, "a" * 5000]
    hit = U.matches(a, [t.encode() for t in texts])
    for t, row in zip(texts, hit):
        for g, h in zip(globs, row):
            assert bool(pattern(g).fullmatch(t)) == h, (g, t)


def test_judge(spark):
    rows = [
        (1, "http://EXAMPLE.com/en/a?x#y"), (2, "https://www.example.com/en/"), (3, "https://a.www.example.com/en/q"), (4, "http://example.com/de/"), (5, "http://x.net/es/1"), (6, "http://x.net/de/1"),
        (7, None), (8, "no scheme"), (9, "http://example.com"), (10, "http://ads.x.org/a"), (11, "http://evil.org/a.example.com/en/"), (12, "http://notexample.com/en/"), (1, "http://EXAMPLE.com/en/a?x#y"), (None, "ftp://q.org/w#z/ads/"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("url", "page_id", "'h' as host", "1 as rule")
    got = [tuple(r) for r in U.judge(df).collect()]
    assert len(got) == len(rows) and got.count((1, "example.com", "/en/a", "example.com/en/", "block")) == 2
    by = {r[0]: r[1:] for r in got}
    assert by[2][2:] == ("www.example.com/en/", "allow") and by[3][2:] == ("www.example.com/en/", "allow")
    assert by[4] == ("example.com", "/de/", "com/", "allow") and by[5][2:] == ("net/es/", "block") and by[6][2:] == (None, "allow")
    assert by[7] == by[8] == ("", "", None, "allow") and by[9] == ("example.com", "", None, "allow")
    assert by[10][2:] == (None, "block") and by[11][2:] == (None, "allow") and by[12][2:] == ("com/", "allow") and by[None] == ("q.org", "/w", None, "allow")
    assert U.judge(df.limit(0)).count() == 0
