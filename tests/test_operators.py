import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ontospark.functions import text as tx
from ontospark.operators import annotations as an
from ontospark.operators import corpora as co
from ontospark.operators import evaluation as ev
from ontospark.operators import matching as ma
from ontospark.operators import projection as pj
from ontospark.operators import reasoning as re_
from ontospark.operators import subsumption as sb
from ontospark.operators import verbalisation as vb
from ontospark.operators.ontology import Ontology
from ontospark.sources import owl
from ontospark.sources import tables as tb


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, words", [("SuperNaturalPower", "Super Natural Power"), ("APIReference", "API Reference"), ("Covid19", "Covid 19")])
def test_split_identifier(spark, text, words):
    assert one(spark, tx.split_identifier(F.lit(text))) == words


def test_text_functions(spark):
    assert one(spark, tx.clean_literal(F.lit("A_b"), lower=True)) == "a b"
    assert one(spark, tx.edit_similarity(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, tx.edit_similarity(F.lit("abcd"), F.lit("abce"))) == 0.75
    assert one(spark, tx.strip_marks(F.lit("<http://x>"))) == "http://x"
    assert one(spark, tx.is_a(F.lit("apple"))) == "It is an apple" and one(spark, tx.is_a(F.lit("Apple"), first=False)) == "it is a Apple"
    assert one(spark, tx.is_a(F.lit("something that eats"))) == "It is something that eats"
    assert [one(spark, tx.strip_preposition(F.lit(w))) for w in ("part of", "looks like", "known as", "up")] == ["part", "looks", "known as", "up"]
    assert one(spark, tx.as_clause(F.lit("It is.")).alias("c")) == "it is" and one(spark, tx.as_clause(F.lit("A (b)]~'"), first=True)) == "A (b"
    assert [one(spark, tx.verb_phrase(F.lit(w))) for w in ("located in", "need", "feeds on", "feed on")] == ["is located in", "need", "feeds on", "feed on"]


def test_idf_select_matches_the_formula(spark):
    q = {1: ["red apple", "apple pie"], 2: ["blue sky"]}
    t = {10: ["red apple"], 11: ["sky sky", "blue"], 12: ["apple"], 13: ["stone"]}
    table = lambda d: spark.createDataFrame([(k, s) for k, v in d.items() for s in v], "iri long, literal string")
    got = {(r.source, r.target): r.score for r in an.idf_select(table(q), table(t), 4, 10).collect()}
    tf = {k: Counter(w for s in v for w in s.split()) for k, v in t.items()}
    posted = Counter(w for c in tf.values() for w in c.elements())
    want = {}
    for s, texts in q.items():
        for word, n in Counter(w for x in texts for w in x.split()).items():
            for k, c in tf.items():
                if word in c:
                    want[s, k] = want.get((s, k), 0) + n * c[word] * math.log10(4 / posted[word])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_evaluation(spark):
    m = lambda rows: spark.createDataFrame(rows, "source string, target string")
    r = ev.precision_recall_f1(m([("a", "x"), ("b", "y"), ("c", "z")]), m([("a", "x"), ("b", "q"), ("n", "n")]), m([("n", "n")])).first()
    assert (r.P, r.R, r.F1) == (0.333, 0.5, 0.4)
    empty = ev.precision_recall_f1(m([]).limit(0), m([]).limit(0)).first()
    assert (empty.P, empty.R, empty.F1) == (None, None, None)
    cands = spark.createDataFrame([("a", "x", 0.1), ("a", "y", 0.9), ("b", "q", 0.5)], "source string, target string, score double")
    got = ev.ranking_metrics(ev.ranks(cands, m([("a", "x"), ("b", "q"), ("c", "k")]))).first()
    assert (got.MRR, got.Hits_1, got.Hits_5) == (0.5, round(1 / 3, 6), round(2 / 3, 6))


def test_online_subsumptions_take_order_into_account(spark):
    maps = spark.createDataFrame([(1, "s1", "t1"), (2, "s2", "t2"), (3, "s3", "p")], "position long, source string, target string")
    edges = spark.createDataFrame([("p", "t1"), ("p", "t2"), ("q", "p")], "parent string, child string")
    assert {tuple(r) for r in ma.subsumptions_from_equivalences(maps, edges, delete=True).collect()} == {("s1", "p"), ("s2", "p")}
    assert ma.subsumptions_from_equivalences(maps, edges).count() == 3
    # A parent that the cut leaves out has served all the same: its own mapping gives nothing.
    maps = spark.createDataFrame([(1, "s1", "t"), (2, "s2", "b")], "position long, source string, target string")
    edges = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "b")], "parent string, child string")
    assert {tuple(r) for r in ma.subsumptions_from_equivalences(maps, edges, delete=True, per_mapping=1).collect()} == {("s1", "a")}


def test_repair(spark):
    m = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.7), ("b", "y", 0.6)], "source string, target string, score double")
    assert {(r.source, r.target) for r in ma.repair_one_to_one(m).collect()} == {("a", "x"), ("b", "y")}


OFN = """Prefix(:=<http://e/>)
Prefix(ex:=<http://e/>)
Ontology(<http://e>
Declaration(Class(ex:A))
Declaration(Class(ex:B))
Declaration(Class(ex:C))
Declaration(Class(ex:D))
Declaration(ObjectProperty(ex:r))
SubClassOf(ex:A ex:B)
SubClassOf(ex:B ObjectSomeValuesFrom(ex:r ex:C))
SubClassOf(ObjectSomeValuesFrom(ex:r ex:C) ex:D)
EquivalentClasses(ex:C ObjectIntersectionOf(ex:D ex:A))
AnnotationAssertion(rdfs:label ex:A "the_A \\"x\\""@en)
ClassAssertion(ex:A ex:i)
)
"""


def test_functional_syntax_reasoning_and_round_trip(spark, tmp_path):
    (tmp_path / "in.ofn").write_text(OFN)
    onto = owl.read_functional(spark, str(tmp_path / "in.ofn"))
    assert {r.iri for r in onto.of_kind("Classes").collect()} == {f"http://e/{x}" for x in "ABCD"}
    assert onto.annotations.first()["literal"] == 'the_A "x"'
    s, _ = re_.saturate(re_.normalise(onto))
    got = {(r.x[-1], r.a[-1]) for r in s.where("x like 'http://e/_' and a like 'http://e/_'").collect()}
    assert {("A", "B"), ("A", "D"), ("B", "D"), ("C", "A"), ("C", "B"), ("A", "C")} <= got
    assert ("D", "A") not in got and ("B", "A") not in got
    owl.write_functional(onto, str(tmp_path / "out"))
    again = owl.read_functional(spark, str(tmp_path / "out"))
    for name in ("entities", "exprs", "annotations", "assertions"):
        assert sorted(map(str, getattr(onto, name).collect())) == sorted(map(str, getattr(again, name).collect()))
    pruned = onto.prune(spark.createDataFrame([("http://e/B",)], "iri string"))
    assert not any("http://e/B" in (r.sub_expr or "") + (r.sup_expr or "") for r in pruned.axioms.collect())
    assert pruned.axioms.where("sub_expr = '<http://e/A>' and sup_expr like 'ObjectSome%'").count() == 1


def test_axioms_of_other_kinds_data_and_prefixes_by_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ofn").write_text("Prefix(p:=<http://a/>)\nTransitiveObjectProperty(p:r)\nDataPropertyAssertion(p:age p:i \"5\\\"\"^^xsd:integer)\nObjectPropertyAssertion(p:r p:i p:j)\nDataPropertyRange(p:age xsd:integer)\n")
    (tmp_path / "in" / "b.ofn").write_text("Prefix(p:=<http://b/>)\nSubClassOf(p:A p:B)\nHasKey(p:A () (p:age))\n")
    onto = owl.read_functional(spark, str(tmp_path / "in"))
    assert {(r.axiom_type, r.sub_expr, r.text) for r in onto.axioms.collect()} == {
        ("TransitiveObjectProperty", None, "TransitiveObjectProperty(<http://a/r>)"),
        ("DataPropertyRange", None, "DataPropertyRange(<http://a/age> <http://www.w3.org/2001/XMLSchema#integer>)"),
        ("SubClassOf", "<http://b/A>", "SubClassOf(p:A p:B)"),
        ("HasKey", None, "HasKey(<http://b/A> () (<http://b/age>))"),
    }
    asserted = lambda kind: [tuple(r) for r in onto.assertion_axioms(kind).collect()]
    assert asserted("DataProperties") == [("DataPropertyAssertion", "http://a/i", "http://a/age", '5"')]
    assert asserted("ObjectProperties") == [("ObjectPropertyAssertion", "http://a/i", "http://a/r", "http://a/j")]
    assert asserted("Classes") == asserted("AnnotationProperties") == []
    owl.write_functional(onto, str(tmp_path / "out"))
    lines = {r.value for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert {"TransitiveObjectProperty(<http://a/r>)", "ObjectPropertyAssertion(<http://a/r> <http://a/i> <http://a/j>)", 'DataPropertyAssertion(<http://a/age> <http://a/i> "5\\"")'} <= lines
    again = owl.read_functional(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.assertions.collect())) == sorted(map(str, onto.assertions.collect()))


def test_completion_with_roles_chains_and_bottom(spark):
    top = "http://www.w3.org/2002/07/owl#Nothing"
    rows = [("some_right", "A", None, "r", "B"), ("some_right", "B", None, "s", "C"), ("some_left", "C", None, "t", "D"), ("some_left", "B", None, "q", "E"), ("and", "D", "E", None, "F"), ("some_right", "G", None, "r", "H"), ("sub", "H", None, None, top)]
    forms = spark.createDataFrame(rows, "form string, a string, b string, r string, c string")
    roles, chains = spark.createDataFrame([("r", "q")], "r string, s string"), spark.createDataFrame([("r", "s", "t")], "r string, s string, t string")
    s, r = re_.saturate(forms, roles, chains)
    below = {(x.x, x.a) for x in s.collect()}
    assert {("A", "D"), ("A", "E"), ("A", "F"), ("G", top)} <= below and ("B", "D") not in below
    assert {tuple(x) for x in r.collect()} >= {("r", "A", "B"), ("q", "A", "B"), ("t", "A", "C")}
    assert s.count() == s.distinct().count()


def test_inter_ontology_samples(spark):
    pairs = spark.createDataFrame([("s1", "t1"), ("s2", "t2")], "sub string, sup string")
    classes = spark.createDataFrame([("t0",), ("t1",), ("t2",), ("t3",)], "iri string")
    closed = spark.createDataFrame([("t0", "t1"), ("t0", "t2")], "ancestor string, descendant string")
    names = spark.createDataFrame([(x, x) for x in ("s1", "s2", "t0", "t1", "t2", "t3")], "iri string, literal string")
    rows = [tuple(r) for r in sb.inter_ontology_samples(pairs, classes, closed, names, names, 2, 2).collect()]
    assert Counter(r for r in rows if r[2] == 1) == {("s1", "t1", 1): 2, ("s2", "t2", 1): 2}
    assert Counter(r for r in rows if r[2] == 0) == {("s1", "t2", 0): 1, ("s1", "t3", 0): 1, ("s2", "t1", 0): 1, ("s2", "t3", 0): 1}


def test_walk_lines(spark, tmp_path):
    walks = spark.createDataFrame([("a", 0, 0, "a"), ("a", 0, 1, "r"), ("a", 0, 2, "b"), ("c", 0, 0, "c")], "start string, walk int, step int, token string")
    lines = lambda: sorted(r.value for r in spark.read.text(str(tmp_path / "w")).collect())
    tb.write_walks(walks, str(tmp_path / "w"))
    assert lines() == ["a r b", "c"]
    tb.write_walks(walks, str(tmp_path / "w"), spark.createDataFrame([("b",)], "id string"))
    assert lines() == ["a r b"]


def test_category_reading(spark):
    rows = [("A", "class", "A", None, None), ("B", "class", "B", None, None), ("C", "class", "C", None, None), ("rC", "some", None, "r", ["C"]), ("nC", "not", None, None, ["C"]), ("srC", "some", None, "s", ["rC"]), ("j", "and", None, None, ["srC", "nC"]), ("u", "or", None, None, ["B", "rC"]), ("nu", "not", None, None, ["u"])]
    exprs = spark.createDataFrame(rows, "expr_id string, kind string, iri string, prop string, operands array<string>")
    axioms = spark.createDataFrame([("1", "EquivalentClasses", None, None, ["A", "j"]), ("2", "DisjointClasses", None, None, ["A", "B"]), ("3", "SubClassOf", "B", "u", None), ("4", "EquivalentClasses", None, None, ["C", "nu"])], "axiom_id string, axiom_type string, sub_expr string, sup_expr string, operands array<string>")
    notes = spark.createDataFrame([("s", "http://www.w3.org/2000/01/rdf-schema#label", "part of", None)], "iri string, property_iri string, literal string, lang string")
    found = pj.category_triples(Ontology(None, axioms, exprs, notes, None))
    top, bottom = "http://www.w3.org/2002/07/owl#Thing", "http://www.w3.org/2002/07/owl#Nothing"
    got = {tuple(x) for x in found.where("relation <> 'id'").collect()}
    assert got == {("A", "projects_part_of_r", "C"), ("Not_C", "negate", "C"), ("A", "projects", "C"), (bottom, "projects", "A"), (bottom, "projects", "B"), ("Not_B", "negate", "B"), ("B", "injects", top)}
    assert {x.source for x in found.where("relation = 'id'").collect()} == {x for s, _, t in got for x in (s, t)}


def test_parser_and_verbaliser(spark):
    text = "EquivalentClasses(<http://purl.obolibrary.org/obo/FOODON_00001707> ObjectIntersectionOf(<http://purl.obolibrary.org/obo/FOODON_00002044> ObjectSomeValuesFrom(<http://purl.obolibrary.org/obo/RO_0001000> <http://purl.obolibrary.org/obo/FOODON_03412116>)) )"
    spans = [(n.name, n.start, n.end) for _, n in vb.parse(vb.abbreviate(text)).walk()][1:]
    assert spans == [("EQV", 0, 212), ("FOODON_00001707", 6, 54), ("AND", 55, 210), ("FOODON_00002044", 61, 109), ("EX.", 110, 209), ("RO_0001000", 116, 159), ("FOODON_03412116", 160, 208)]
    with pytest.raises(ValueError):
        vb.parse("[AND](<a>")
    rows = [("A", "class", "A", None, None), ("B", "class", "B", None, None), ("C", "class", "C", None, None), ("s1", "some", None, "r", ["B"]), ("s2", "some", None, "r", ["C"]), ("j", "and", None, None, ["A", "s1", "s2"]), ("k", "or", None, None, ["A", "s1"]), ("l", "and", None, None, ["s1", "s2"])]
    exprs = spark.createDataFrame(rows, "expr_id string, kind string, iri string, prop string, operands array<string>")
    vocab = spark.createDataFrame([("A", "apple"), ("B", "bee"), ("C", "cat"), ("r", "derived from")], "iri string, name string")
    got = {r.expr_id: r.text for r in vb.verbalise(exprs, vocab).collect()}
    assert got["s1"] == "something that is derived from some bee"
    assert got["j"] == "apple that is derived from some bee and cat"
    assert got["k"] == "apple or something that is derived from some bee"
    assert got["l"] == "something that is derived from some bee and cat"


def test_candidate_cells(spark):
    cells = ["['u1', 'u2']", "[('u1', 0.2), ('u2', 0.7)]", "[['u1', 0.04, False], ['u2', 0.9, True]]"]
    df = spark.createDataFrame([(c,) for c in cells], "c string").select(tb.parse_candidates(F.col("c")).alias("p"))
    got = [[(x["iri"], round(x["score"], 2), x["answer"]) for x in r.p] for r in df.collect()]
    assert got == [[("u1", 1.0, None), ("u2", 0.5, None)], [("u2", 0.7, None), ("u1", 0.2, None)], [("u2", 0.9, True), ("u1", 0.04, False)]]


def test_candidate_cells_keep_what_is_quoted(spark, tmp_path):
    rows = ["a\tb\t[('http://x/Foo_(bar)', 0.5, True), ('http://x/True, ]', 0.9, False), ('n', 0.1, None)]", "c\tUnMatched\t[('d', 0.7, True), ('e', 0.2, True)]"]
    (tmp_path / "c.tsv").write_text("SrcEntity\tTgtEntity\tTgtCandidates\n" + "\n".join(rows) + "\n")
    cands = tb.read_candidates(spark, str(tmp_path / "c.tsv"))
    assert [x["iri"] for x in cands.where("source = 'a'").first()["candidates"]] == ["http://x/True, ]", "http://x/Foo_(bar)", "n"]
    matched, unmatched, predicted, refs = tb.split_candidates(cands, 0.3)
    assert [r.source for r in matched.collect()] == ["a"] and [r.source for r in unmatched.collect()] == ["c"]
    assert {(r.source, r.target) for r in predicted.collect()} == {("a", "http://x/Foo_(bar)"), ("c", "d")}
    assert [tuple(r) for r in refs.collect()] == [("a", "b", 1.0)]


def test_unknown_relations_raise(spark, tmp_path):
    (tmp_path / "a.rdf").write_text('<A><map><Cell><entity1 rdf:resource="a"/><entity2 rdf:resource="b"/><relation>~</relation><measure>1.0</measure></Cell></map></A>')
    with pytest.raises(Exception, match="no such relation: ~"):
        tb.read_alignment(spark, str(tmp_path / "a.rdf"))[0].collect()


def test_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("SrcEntity\tTgtEntity\tScore\na\tx\t0.9\nb\ty\t0.2\nNULL\tNA\t1\n")
    assert {(r.source, r.target) for r in tb.read_mappings(spark, str(tmp_path / "m.tsv"), 0.5).collect()} == {("a", "x"), ("NULL", None)}
    (tmp_path / "a.rdf").write_text('<A><map><Cell><entity1 rdf:resource="a"/><entity2 rdf:resource="b"/><relation>=</relation><measure>1.0</measure></Cell></map><map><Cell><entity1 rdf:resource="c"/><entity2 rdf:resource="d"/><relation>?</relation><measure>0</measure></Cell></map></A>')
    refs, ignored = tb.read_alignment(spark, str(tmp_path / "a.rdf"))
    assert [(r.source, r.target) for r in refs.collect()] == [("a", "b")] and ignored.count() == 1
    (tmp_path / "l.jsonl").write_text('﻿{"a": 1, "b": "x"}\n{"c": true}\n', encoding="utf-8")
    assert tb.read_jsonl(spark, str(tmp_path / "l.jsonl")).columns == ["a", "b", "c"]
    (tmp_path / "s.csv").write_text("a,b,c,d\ne,f\n")
    assert sorted((r.sub, r.gold, r.negatives) for r in tb.read_subsumptions(spark, str(tmp_path / "s.csv")).collect()) == [("a", "b", ["c", "d"]), ("e", "f", [])]


def test_samplers(spark):
    groups = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "d")], "iri long, literal string")
    merged = co.synonym_groups(groups, transitive=True)
    assert {(r.group_id, r.literal) for r in merged.collect()} == {(1, "a"), (1, "b"), (1, "c"), (3, "d")}
    pairs = co.synonym_pairs(merged)
    assert pairs.count() == 10
    non = co.corpus([pairs], [spark.createDataFrame([("a", "c"), ("a", "d")], "a string, b string")])
    assert {(r.text_a, r.text_b) for r in non.where("label = 0").collect()} == {("a", "d")}
    rows = spark.createDataFrame([(k, int(k < 3)) for k in range(20)], "id long, label int")
    even = co.balanced(rows, ["id"])
    assert even.where("label = 1").count() == even.where("label = 0").count() == 17
    parts = co.split(rows, ["id"], {"x": 0.5, "y": 0.5})
    assert parts.count() == 20 and {r.split for r in parts.collect()} == {"x", "y"}


def test_incremental_matching(spark, tmp_path):
    from ontospark.streaming.incremental import match_new_sources

    spark.createDataFrame([(1, "red apple"), (2, "sky")], "iri long, literal string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("iri long, literal string").parquet(str(tmp_path / "in"))
    targets = spark.createDataFrame([(10, "apple"), (11, "stone")], "iri long, literal string")
    running = match_new_sources(stream, targets, 2, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    running.processAllAvailable()
    running.stop()
    assert [(r.source, r.target) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 10)]


def test_random_candidates_leave_out_golds_and_their_ancestors(spark):
    classes = spark.createDataFrame([(f"c{k}",) for k in range(12)], "iri string")
    gold = spark.createDataFrame([("s", "c1"), ("s", "c2"), ("t", "c3")], "source string, target string")
    closed = spark.createDataFrame([("c5", "c3"), ("c6", "c3")], "ancestor string, descendant string")
    rows = co.random_candidates(gold, classes, 4, seed=1, closed=closed).collect()
    by = {}
    for r in rows:
        by.setdefault((r.source, r.target), []).append(r.candidate)
    assert {k: len(set(v)) for k, v in by.items()} == {("s", "c1"): 4, ("s", "c2"): 4, ("t", "c3"): 4}
    assert not {"c1", "c2"} & {*by["s", "c1"], *by["s", "c2"]} and not {"c3", "c5", "c6"} & {*by["t", "c3"]}
    assert co.random_candidates(gold, classes, 50).where("source = 't'").count() == 11


def test_replace_entity_reaches_ids_and_texts(spark):
    onto = Ontology(
        entities=spark.createDataFrame([("x", "Classes"), ("y", "Classes")], "iri string, entity_type string"),
        axioms=spark.createDataFrame([("SubClassOf(<x> <y>)", "SubClassOf", "<x>", "<y>", None)], "axiom_id string, axiom_type string, sub_expr string, sup_expr string, operands array<string>"),
        exprs=spark.createDataFrame([("<x>", "x", None), ("ObjectUnionOf(<x> <y>)", None, ["<x>", "<y>"])], "expr_id string, iri string, operands array<string>"),
        annotations=spark.createDataFrame([("x", "p", "<x> is a mark")], "iri string, property_iri string, literal string"),
        assertions=spark.createDataFrame([("i", "x")], "individual string, cls string"),
    )
    new = onto.replace_entity("x", "z")
    assert [tuple(r) for r in new.axioms.collect()] == [("SubClassOf(<z> <y>)", "SubClassOf", "<z>", "<y>", None)]
    assert [tuple(r) for r in new.exprs.collect()] == [("<z>", "z", None), ("ObjectUnionOf(<z> <y>)", None, ["<z>", "<y>"])]
    assert new.assertions.first().cls == "z" and onto.assertions.first().cls == "x"


def test_equivalences_and_class_assertions_in_words(spark):
    texts = spark.createDataFrame([("e1", "wine"), ("e2", "something that is made from grapes")], "expr_id string, text string")
    axioms = spark.createDataFrame([("a", "EquivalentClasses", ["e1", "e2"]), ("b", "SubClassOf", None), ("c", "EquivalentClasses", ["e1"])], "axiom_id string, axiom_type string, operands array<string>")
    assert [tuple(r) for r in vb.verbalise_equivalences(axioms, texts).collect()] == [("a", "wine", "something that is made from grapes")]
    vocab = spark.createDataFrame([("i", "Merlot")], "iri string, name string")
    found = vb.verbalise_class_assertions(spark.createDataFrame([("i", "e1"), ("j", "?")], "individual string, cls string"), texts, vocab).collect()
    assert sorted(tuple(r) for r in found) == [("?", "j", "?", "j"), ("e1", "i", "wine", "Merlot")]


def test_model_scores_use_the_model_where_no_string_matches(spark):
    pairs = spark.createDataFrame([("s1", "t1"), ("s1", "t2"), ("s2", "t1")], "source string, target string")
    source = spark.createDataFrame([("s1", "heart"), ("s1", "cor"), ("s2", None)], "iri string, literal string")
    target = spark.createDataFrame([("t1", "heart"), ("t2", "hearts")], "iri string, literal string")
    got = {(r.source, r.target): r.score for r in ma.model_scores(pairs, source, target, tx.edit_similarity).collect()}
    assert got[("s1", "t1")] == 1.0 and got[("s2", "t1")] == 0.0 and abs(got[("s1", "t2")] - (5 / 6 + 1 / 6) / 2) < 1e-5
