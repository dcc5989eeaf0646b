import random

import pytest
from pyspark.sql import functions as F

from ontospark.operators import graph as gr
from ontospark.runtime import connected_components


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "parent string, child string")


def reach(pairs):
    down = {}
    for a, b in pairs:
        down.setdefault(a, set()).add(b)
    out = set()
    for a in {x for p in pairs for x in p}:
        todo, seen = [a], set()
        while todo:
            for y in down.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out |= {(a, y) for y in seen}
    return out


@pytest.fixture(scope="module")
def dag():
    rng = random.Random(3)
    return sorted({(f"n{a}", f"n{b}") for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.25})


def test_closure_reduction_and_depths(spark, dag):
    e = edges_of(spark, dag + dag[:2])
    closed = gr.closure(e)
    got = {(r.ancestor, r.descendant) for r in closed.collect()}
    assert got == reach(dag)
    direct = {(r.parent, r.child) for r in gr.reduction(e).collect()}
    assert direct == {(a, b) for a, b in dag if not any((a, x) in got and (x, b) in got for x in {y for p in dag for y in p})}
    assert reach(sorted(direct)) == got


def test_closure_ends_on_cycles_and_empty_tables(spark):
    assert {(r.ancestor, r.descendant) for r in gr.closure(edges_of(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "c")])).collect()} == {("a", "b"), ("b", "a"), ("a", "a"), ("b", "b"), ("a", "c"), ("b", "c")}
    assert gr.closure(edges_of(spark, []).limit(0)).count() == 0
    assert {tuple(r) for r in gr.collapse_cycles(edges_of(spark, [("a", "b"), ("b", "a"), ("b", "c")])).collect()} == {("a", "c")}


def test_depths(spark):
    e = edges_of(spark, [("root", "a"), ("root", "b"), ("a", "b"), ("b", "c"), ("root", "c")])
    assert {r.id: (r.shortest, r.longest, r.longest_nodes) for r in gr.depths(e).collect()} == {"root": (0, 0, 1), "a": (1, 1, 2), "b": (1, 2, 3), "c": (1, 3, 4)}
    with pytest.raises(RuntimeError):
        gr.depths(e, "nowhere")


def test_prune_keeps_reachability(spark, dag):
    gone = {"n3", "n5", "n6"}
    kept = gr.prune(edges_of(spark, dag), spark.createDataFrame([(x,) for x in gone], "id string"))
    got = {(r.parent, r.child) for r in kept.collect()}
    assert not any(set(p) & gone for p in got)
    assert reach(sorted(got)) == {p for p in reach(dag) if not set(p) & gone}


def test_lca(spark):
    e = edges_of(spark, [("root", "a"), ("root", "b"), ("a", "x"), ("b", "x"), ("a", "y"), ("b", "y"), ("root", "z")])
    pairs = spark.createDataFrame([("x", "y"), ("x", "z"), ("a", "x")], "a string, b string")
    assert {(r.a, r.b): r.lca for r in gr.lowest_common_ancestors(pairs, e).collect()} == {("x", "y"): "a", ("x", "z"): "root", ("a", "x"): "a"}


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, None), (9, 9)]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    linked = {x for a, b in pairs if b is not None and a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b")
    assert {r.node: r.component for r in got.collect()} == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_walks_follow_edges(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("b", "s", "a"), ("c", "r", "a")], "source string, relation string, target string")
    rows = gr.random_walks(e, 3, 4, seed=1).collect()
    again = gr.random_walks(e.orderBy(F.desc("target")).repartition(3), 3, 4, seed=1).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    walks = {}
    for r in rows:
        walks.setdefault((r.start, r.walk), {})[r.step] = r.token
    known = {("a", "r", "b"), ("b", "r", "c"), ("b", "s", "a"), ("c", "r", "a")}
    for w in walks.values():
        assert all((w[k], w[k + 1], w[k + 2]) in known for k in range(0, max(w) - 1, 2))
    biased = gr.biased_walks(e.select("source", "target", F.lit(1.0).alias("weight")), 2, 3, 0.5, 2.0).collect()
    assert {r.step for r in biased} == {0, 1, 2, 3}
