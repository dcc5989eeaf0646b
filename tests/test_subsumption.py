import pytest

from ontospark.operators import evaluation as ev
from ontospark.operators import graph as gr
from ontospark.operators import subsumption as su
from ontospark.plans.subsumption import _geo_ontology
from ontospark.sources import tables as tb
from ontospark.sources.adapters import Tables


def pairs(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def tree(spark):
    edges = [("r", "a"), ("r", "b"), ("a", "a1"), ("a", "a2"), ("b", "b1"), ("b", "b2"), ("c1", "x"), ("r", "c1")]
    return spark.createDataFrame(edges, "parent string, child string")


def test_sibling_draws(spark, tree):
    found = su.sibling_draws(tree, 300, 3).collect()
    assert len(found) == 300
    groups = [{"a", "b", "c1"}, {"a1", "a2"}, {"b1", "b2"}]
    assert all(r["a"] != r["b"] and any({r["a"], r["b"]} <= g for g in groups) for r in found)
    # Every ordered pair of siblings comes up, and the same seed draws the same.
    assert len({(r["a"], r["b"]) for r in found}) == 10
    assert pairs(su.sibling_draws(tree, 300, 3)) == {tuple(r) for r in found}
    assert su.sibling_draws(tree.limit(0), 5).isEmpty()


def test_class_draws(spark):
    classes = spark.createDataFrame([(c,) for c in "abcd"], "iri string")
    found = su.class_draws(classes, 400, 1).collect()
    assert len(found) == 400 and all(r["a"] != r["b"] for r in found)
    assert len({(r["a"], r["b"]) for r in found}) == 12
    assert su.class_draws(classes.limit(1), 5).isEmpty() and su.class_draws(classes.limit(0), 5).isEmpty()


def test_atomic_negatives(spark, tree):
    closed = gr.closure(tree)
    above = {(r["descendant"], r["ancestor"]) for r in closed.collect()}
    for hard in (False, True):
        found = pairs(su.atomic_negatives(tree, closed, 20, hard, seed=4))
        assert found and all((a, b) not in above and (b, a) not in above for a, b in found)
    # A shared descendant rules a pair out.
    dag = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "x"), ("b", "x")], "parent string, child string")
    assert su.atomic_negatives(dag, gr.closure(dag), 50, True).isEmpty()


def test_traversal(spark, tree):
    start = spark.createDataFrame([("a",), ("a1",), ("none",)], "id string")
    down = pairs(su.traversal(start, tree, hops=3, most=1).select("start", "sub", "sup"))
    assert down == {("a", "a1", "a")}
    up = pairs(su.traversal(start, tree, hops=3, up=True).select("start", "place", "sub", "sup"))
    assert up == {("a", 1, "a", "r"), ("a1", 1, "a1", "a"), ("a1", 2, "a", "r")}


def test_complex_negatives(spark, tables):
    t = Tables(spark, tables)
    onto = _geo_ontology(t)
    found = su.complex_negatives(onto, 4, 9).collect()
    region = {f"nation:{r['n_nationkey']}": f"region:{r['n_regionkey']}" for r in t.nation.collect()}
    assert found
    for r in found:
        assert r["replaced"] in (region[r["sub"]], "inRegion") and r["by"] != r["replaced"]
        assert r["by"] == "nearRegion" if r["replaced"] == "inRegion" else ":" in r["by"] or r["by"] == "root"
    many = {}
    for r in found:
        many[r["sub"]] = many.get(r["sub"], 0) + 1
    assert max(many.values()) <= 4


def test_complex_positives_cut(spark, tables):
    t = Tables(spark, tables)
    kept = su.complex_positives(_geo_ontology(t), gr.closure(su.edge_table(_geo_ontology(t).asserted_edges())), 3)
    assert kept.groupBy("axiom_id").count().where("count > 3").isEmpty() and kept.count() == 75


def test_intra_corpus(spark, tree):
    literals = spark.createDataFrame([(c, f"{c} {k}") for c in ("a", "b", "a1", "a2", "b1", "b2") for k in range(3)], "iri string, literal string")
    found = su.intra_corpus(literals, tree, seed=1).collect()
    yes = {(r["text_a"], r["text_b"]) for r in found if r["label"] == 1}
    no = {(r["text_a"], r["text_b"]) for r in found if r["label"] == 0}
    assert yes == {(f"{c} {i}", f"{c} {j}") for c in ("a", "b", "a1", "a2", "b1", "b2") for i in range(3) for j in range(3)}
    assert no and not yes & no and len(no) <= 4 * len(yes)
    assert all(a.split()[0] != b.split()[0] for a, b in no)
    assert su.intra_corpus(literals.limit(0), tree).isEmpty()


def test_samples_balance(spark):
    rows = lambda n, y: spark.createDataFrame([(f"x{k}", "" if k == 0 else "y", y) for k in range(n)], "text_a string, text_b string, label int")
    found = su.training_samples(rows(3, 1), rows(5, 0), 2, 2).collect()
    assert sum(r["label"] == 0 for r in found) == 8  # of ten, the empty ones go
    assert 6 <= sum(r["label"] == 1 for r in found) <= 8


def test_size_histogram(spark):
    sizes = spark.createDataFrame([(1,), (3,), (3,), (None,)], "s int")
    assert pairs(ev.size_histogram(sizes, "s")) == {(0, 0), (1, 1), (2, 0), (3, 2)}
    assert ev.size_histogram(sizes.limit(0), "s").isEmpty()


def test_once_and_synsets(spark, tmp_path):
    made = []
    build = lambda: made.append(1) or spark.range(3).toDF("x")
    for _ in range(2):
        assert tb.once(spark, str(tmp_path / "stage"), build).count() == 3
    assert made == [1]
    (tmp_path / "n.tsv").write_text("synset\trelation\tother\ndog.n.01\thypernym\tanimal.n.01\nleg.n.01\tpart_holonym\tdog.n.01\ncat.n.01\thypernym\tNA\n")
    assert pairs(tb.read_synset_edges(spark, str(tmp_path / "n.tsv"))) == {("animal.n.01", "dog.n.01")}
    assert pairs(tb.read_synset_edges(spark, str(tmp_path / "n.tsv"), "part_holonym")) == {("dog.n.01", "leg.n.01")}
    with pytest.raises(ValueError):
        tb.read_synset_edges(spark, "x", "antonym")
