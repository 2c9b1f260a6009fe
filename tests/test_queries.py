"""Each query of the library against its DuckDB equivalent, on the smallest tables."""

import math

import duckdb
import pytest

from tesserae.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return float(x) if isinstance(x, float) else x


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((str(tuple(plain(row[k]) for k in order)) for row in values))


# each query once, whatever the number of its names
NAMES = sorted({registry.QUERIES[n]: n for n in sorted(registry.ORACLES, reverse=True)}.values())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    relation = duck.sql(registry.ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(relation.columns, relation.fetchall())


def test_murmur3():
    from tesserae.functions.hashing import murmur3_128

    # published vectors
    assert murmur3_128(b"").hex() == "00000000000000000000000000000000"
    assert murmur3_128(b"hello")[:8][::-1].hex() == "cbd8a7b341bd9b02"
    assert murmur3_128(b"hello, world")[:8][::-1].hex() == "342fac623a5ebc8e"
