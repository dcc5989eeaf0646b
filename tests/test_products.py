"""Rows that joins make, where a class or a node has very many below it."""

from ontospark.operators import graph as gr
from ontospark.operators import matching as ma
from ontospark.operators import reasoning as re_
from ontospark.plans import catalogue


def joined_rows(df):
    """The most rows that a join of the executed plan gave."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        else:
            if "Join" in node.nodeName():
                most = max(most, node.metrics().apply("numOutputRows").value())
            todo.extend(node.children().apply(k) for k in range(node.children().size()))
    return most


def test_direct_instances_of_a_class_above_all(spark):
    n = 300
    edges = spark.createDataFrame([("top", "mid"), ("mid", "low"), ("mid", "other"), *[("low", f"x{k}") for k in range(n)]], "parent string, child string")
    own = [(f"x{k}", c) for k in range(n) for c in ("top", "mid", "low")] + [("x0", "other"), ("y", "top"), ("y", "unknown"), ("z", None), (None, "top")]
    closed = gr.closure(edges)
    out = re_.direct_instances(spark.createDataFrame(own, "individual string, cls string"), closed)
    assert joined_rows(out) < 10 * n
    expected = [(f"x{k}", "low") for k in range(n)] + [("x0", "other"), ("y", "top"), ("y", "unknown"), ("z", None), (None, "top")]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, expected))


def test_extension_scores_no_product_of_children(spark, tmp_path, monkeypatch):
    many, few = 200, 50
    spark.range(many).selectExpr("id as c_custkey", "id % 2 as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(few).selectExpr("id as s_suppkey", "id % 2 as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(2).selectExpr("id as n_nationkey", "0L as n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    scored, plain = [], ma.materialize

    def spy(df, name="table"):
        out = plain(df, name)
        scored.extend([out.count()] if name == "scored" else [])
        return out

    monkeypatch.setattr(ma, "materialize", spy)
    out = sorted(tuple(r) for r in catalogue.QUERIES["mapping_extension_fix"](spark, str(tmp_path)).collect())
    assert out == sorted([(f"customer:{k}", f"supplier:{k}", 1.0) for k in range(few)] + [("nation:0", "nation:0", 1.0), ("nation:1", "nation:1", 1.0), ("region:0", "region:0", 1.0)])
    assert len(scored) > 2 and max(scored) <= few


def test_extension_by_blocks_finds_the_same(spark):
    se = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c"), ("a", "d"), (None, "e")], "parent string, child string")
    te = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "x"), ("a", "d"), ("a", "y")], "parent string, child string")
    seeds = spark.createDataFrame([("p", "p", 1.0)], "source string, target string, score double")
    same = lambda pairs: pairs.withColumn("score", (pairs["source"] == pairs["target"]).cast("double"))
    whole, blocks = (sorted(tuple(r) for r in ma.extend_mappings(seeds, se, te, same, block=block).collect()) for block in (None, lambda iri: iri))
    assert whole == blocks == [("a", "a", 1.0), ("b", "b", 1.0), ("d", "d", 1.0), ("p", "p", 1.0)]
