"""Biased walks over the whole graph: every node takes part, and steps keep their proportions."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from ontospark.operators import graph as gr
from ontospark.plans import catalogue


def test_biased_walks_start_at_every_node(spark, tables):
    rows = catalogue.QUERIES["walks_biased"](spark, tables).collect()
    customers = {f"customer:{k}" for (k,) in duckdb.sql(f"select c_custkey from '{tables}/customer.parquet'").fetchall()}
    assert customers <= {r.start for r in rows}
    steps = {}
    for r in rows:
        steps.setdefault((r.start, r.walk), {})[r.step] = r.id
    assert all(sorted(s) == [0, 1, 2, 3] and s[0] == start for (start, _), s in steps.items())
    of = {f"customer:{k}": f"nation:{n}" for k, n in duckdb.sql(f"select c_custkey, c_nationkey from '{tables}/customer.parquet'").fetchall()}
    assert all(s[1] == of[start] for (start, _), s in steps.items() if start in of)


def test_biased_walks_keep_their_proportions(spark):
    # From a the only step is to hub; there 1/p = 2 goes back, n (a neighbour of a, weight 3) has 3 and each of x, y has 1/q = 0.5.
    pairs = [("a", "hub", 1.0), ("a", "n", 1e-9), ("hub", "a", 1.0), ("hub", "n", 3.0), ("hub", "x", 1.0), ("hub", "y", 1.0), ("n", "a", 1.0), ("x", "hub", 1.0), ("y", "hub", 1.0)]
    e = spark.createDataFrame(pairs, "source string, target string, weight double")
    for tries in (0, 1, 16):
        out = gr.biased_walks(e, 3000, 2, 0.5, 2.0, seed=1, tries=tries).where(F.col("start") == "a").collect()
        got = Counter(r.id for r in out if r.step == 2)
        assert sum(got.values()) == 3000
        for target, share in (("a", 2 / 6), ("n", 3 / 6), ("x", 0.5 / 6), ("y", 0.5 / 6)):
            assert abs(got[target] / 3000 - share) < 0.04
