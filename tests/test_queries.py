"""Every registered query against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from cairn.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def rows(names, values, order):
    return sorted((tuple(plain(r[names.index(c)]) for c in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    if name in SQL:
        found = duck.execute(SQL[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got, sorted(names)) == rows(names, found.fetchall(), sorted(names))


def test_contamination_whatever_stands_around(spark):
    from cairn.plans.graphs import contained

    items = [(1, "Where does the old copper river bend near Harrow?"), (2, "Two words"), (3, "What is\nthe name of this long river?"), (4, "Name the bridge"), (5, "x"), (6, None), (7, "(see) über den alten Fluss hinaus gehen")]
    around = ["{}", "\n\n{}", "a\t{}.", 'said "{}"', "({})", "one\ntwo\nthree {}\nfour", "pre{}post", "{}\n\nmore words follow here"]
    docs = [(100 * i + k, form.format(text)) for i, text in items if text for k, form in enumerate(around)] + [(1, None), (2, ""), (None, "Name the bridge")]
    want = {(d, i) for d, text in docs for i, item in items if text is not None and item is not None and item in text}
    got = contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
