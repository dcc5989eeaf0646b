"""Components over a whole table against union-find."""

import duckdb

from ontospark.plans import catalogue


def test_connected_synonyms_over_all_rows(spark, tables):
    edges = duckdb.sql(f"select distinct 'p' || l_partkey, 's' || l_suppkey from '{tables}/lineitem.parquet'").fetchall()
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in catalogue.QUERIES["connected_synonyms"](spark, tables).collect()}
    assert got == {x: find(x) for x in list(up)}
