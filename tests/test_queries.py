"""Every query against its SQL form on the smallest tables."""

import os

import duckdb
import pytest

from foliant import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shown = [tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in data]
    return [names[i] for i in order], sorted(shown)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{os.path.join(SF, t)}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n, e in catalog.entries().items() if e.sql])
def test_query_equals_sql(spark, duck, name):
    e = catalog.entries()[name]
    df = e.run(spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    q = duck.execute(e.sql)
    assert got == rows([d[0] for d in q.description], q.fetchall())


@pytest.mark.parametrize("name", [n for n, e in catalog.entries().items() if not e.sql])
def test_query_runs(spark, name):
    assert catalog.entries()[name].run(spark, SF).count() > 0


def test_citations_are_read_from_whole_texts(spark, duck):
    from foliant.plans import linking

    texts = dict(duck.execute("select doc_id, text from documents").fetchall())
    got = linking._cited(spark, SF).collect()
    assert len(got) == len(texts) and all(r["text"].startswith(texts[r["id"]] + " [") for r in got)
