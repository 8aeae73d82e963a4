"""Every registered query of the library against its DuckDB SQL on the same tables."""

import pytest

from maskrisk.plans import REGISTRY


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    cell = lambda v: (v is None, "%.9g" % v if isinstance(v, float) else str(v))
    return sorted(tuple(cell(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_query(name, spark, duck, sf):
    query, sql = REGISTRY[name]
    got, want = query(spark, sf), duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
