import duckdb
import pytest

import __spark_entry__ as entry
from cardloom.plans import registry

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", ["corpus_pipeline", "cardloom.llm", "ahocorasick"])
def test_without_the_corpus_package(monkeypatch, gone):
    import builtins
    import sys

    real = builtins.__import__

    def missing(name, *a, **k):
        if name.startswith(("corpus_pipeline", "cardloom.llm")):  # as they import nothing else first, whatever is gone
            raise ModuleNotFoundError(f"No module named {gone!r}", name=gone)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", missing)
    for name in [n for n in sys.modules if n.startswith(("corpus_pipeline", "cardloom.llm"))]:
        monkeypatch.delitem(sys.modules, name)
    if gone == "ahocorasick":
        with pytest.warns(UserWarning, match="ahocorasick"):
            assert set(entry.queries()) == set(registry.QUERIES)
    else:
        assert set(entry.queries()) == set(registry.QUERIES) and set(entry.oracle_sql()) == set(registry.ORACLE)


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    rel = con.sql(registry.ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    want = sorted(str([plain(r[rel.columns.index(c)]) for c in cols]) for r in rel.fetchall())
    assert got == want


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["collector", "binder_id", "card_id", "number", "owned_elsewhere"] and df.count() > 0
