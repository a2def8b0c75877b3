"""Each registered query against its SQL on the smallest tables."""

import pytest

from tessera import catalog

TYPES = {"double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(name, spark, sf_dir, duck):
    df = catalog.QUERIES[name](spark, sf_dir)
    rel = duck.sql(catalog.ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(c) for c in names]
    ours = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    theirs = sorted((tuple(r[k] for k in at) for r in rel.fetchall()), key=str)
    assert ours == theirs
    kinds = dict(df.dtypes)
    assert [TYPES[kinds[c]] for c in names] == [str(rel.types[k]) for k in at]


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
