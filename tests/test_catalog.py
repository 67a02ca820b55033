"""Every registered query with SQL against it on the smallest given tables; those without have tests of their operators."""

import datetime
import decimal
import math

import duckdb
import pytest

from hyperweave.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(name, spark, sf_dir, duck):
    df = catalog.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=str)
    assert got == want


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() > 0


def test_isomorphism_classes_cover_all_records(spark, sf_dir):
    from hyperweave.sources.collections import event_incidence

    found = catalog.queries()["isomorphism_classes"](spark, sf_dir).collect()
    assert sum(r.members for r in found) == event_incidence(spark, sf_dir).select("hg").distinct().count()
    assert len({r.word for r in found}) == len(found) and all(r.word for r in found)


def test_whole_names_tell_suppliers_apart(spark, tmp_path):
    names = [(100 * k, f"Supplier#{100 * k:09d}") for k in range(1, 11)]
    spark.createDataFrame(names, "s_suppkey long, s_name string").write.parquet(f"file://{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, "Supplier#0000", "00100")], "p_partkey long, p_brand string, p_type string").write.parquet(f"file://{tmp_path}/part.parquet")
    found = catalog.queries()["pair_levenshtein_whole"](spark, f"file://{tmp_path}").collect()
    assert {r.i: r.d for r in found} == {100 * k: 0 if k == 1 else 2 if k == 10 else 1 for k in range(1, 11)}
