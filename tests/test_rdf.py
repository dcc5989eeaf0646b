import pytest
from pyspark.sql import functions as F

from ontospark.operators import reasoning as re_
from ontospark.sources import owl, rdf

EX = "http://ex.org/o#"
DOC = f"""<?xml version="1.0"?>
<!DOCTYPE rdf:RDF [<!ENTITY owl "http://www.w3.org/2002/07/owl#">]>
<rdf:RDF xmlns="{EX}" xml:base="http://ex.org/o" xmlns:owl="http://www.w3.org/2002/07/owl#"
  xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#">
  <owl:Ontology rdf:about="http://ex.org/o"><rdfs:comment>about it</rdfs:comment></owl:Ontology>
  <owl:ObjectProperty rdf:about="#eats"><rdfs:domain rdf:resource="#Animal"/><owl:inverseOf rdf:resource="#eatenBy"/></owl:ObjectProperty>
  <owl:ObjectProperty rdf:ID="eatenBy"/>
  <owl:ObjectProperty rdf:about="#feedsOn"><owl:propertyChainAxiom rdf:parseType="Collection"><rdf:Description rdf:about="#eats"/><rdf:Description rdf:about="#eats"/></owl:propertyChainAxiom></owl:ObjectProperty>
  <owl:DatatypeProperty rdf:about="#age"/>
  <owl:Class rdf:about="#Animal"><rdfs:label xml:lang="en">animal "x"</rdfs:label><rdfs:label xml:lang="de">Tier</rdfs:label></owl:Class>
  <owl:Class rdf:about="#Cow">
    <rdfs:subClassOf rdf:resource="#Animal"/>
    <rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="#eats"/><owl:someValuesFrom rdf:resource="#Plant"/></owl:Restriction></rdfs:subClassOf>
  </owl:Class>
  <owl:Class rdf:about="#Plant"><owl:disjointWith rdf:resource="#Animal"/></owl:Class>
  <owl:Class rdf:about="#Herbivore">
    <owl:equivalentClass><owl:Class><owl:intersectionOf rdf:parseType="Collection">
      <rdf:Description rdf:about="#Animal"/>
      <owl:Restriction><owl:onProperty rdf:resource="&owl;topObjectProperty"/><owl:allValuesFrom><owl:Class><owl:complementOf rdf:resource="#Cow"/></owl:Class></owl:allValuesFrom></owl:Restriction>
      <owl:Restriction><owl:onProperty rdf:resource="#eats"/><owl:minQualifiedCardinality>2</owl:minQualifiedCardinality><owl:onClass rdf:resource="#Plant"/></owl:Restriction>
    </owl:intersectionOf></owl:Class></owl:equivalentClass>
  </owl:Class>
  <owl:Class rdf:about="#Both"><owl:unionOf rdf:parseType="Collection"><owl:Class rdf:about="#Cow"/><owl:Class rdf:about="#Plant"/></owl:unionOf></owl:Class>
  <owl:NamedIndividual rdf:about="#bella"><rdf:type rdf:resource="#Cow"/><eats rdf:resource="#grass1"/><age>7</age></owl:NamedIndividual>
  <Plant rdf:about="#grass1"/>
  <owl:Axiom><owl:annotatedSource rdf:resource="#Cow"/><rdfs:comment>why</rdfs:comment></owl:Axiom>
  <rdf:Description><rdf:type rdf:resource="&owl;AllDisjointClasses"/><owl:members rdf:parseType="Collection"><owl:Class rdf:about="#Cow"/><owl:Class rdf:about="#Plant"/></owl:members></rdf:Description>
</rdf:RDF>"""
AXIOMS = {
    f"SubObjectPropertyOf(ObjectPropertyChain(<{EX}eats> <{EX}eats>) <{EX}feedsOn>)",
    f"ObjectPropertyDomain(<{EX}eats> <{EX}Animal>)",
    f"InverseObjectProperties(<{EX}eats> <{EX}eatenBy>)",
    f"SubClassOf(<{EX}Cow> <{EX}Animal>)",
    f"SubClassOf(<{EX}Cow> ObjectSomeValuesFrom(<{EX}eats> <{EX}Plant>))",
    f"DisjointClasses(<{EX}Plant> <{EX}Animal>)",
    f"EquivalentClasses(<{EX}Herbivore> ObjectIntersectionOf(<{EX}Animal> ObjectAllValuesFrom(<http://www.w3.org/2002/07/owl#topObjectProperty> ObjectComplementOf(<{EX}Cow>)) ObjectMinCardinality(2 <{EX}eats> <{EX}Plant>)))",
    f"EquivalentClasses(<{EX}Both> ObjectUnionOf(<{EX}Cow> <{EX}Plant>))",
    f"DisjointClasses(<{EX}Cow> <{EX}Plant>)",
}


def column(df, name):
    return {r[name] for r in df.collect()}


def same(a, b):
    assert sorted(map(repr, a.distinct().collect())) == sorted(map(repr, b.distinct().collect()))


def test_rdf_xml(spark, tmp_path):
    (tmp_path / "o.owl").write_text(DOC)
    onto = rdf.read_owl(spark, str(tmp_path / "o.owl"))
    assert column(onto.axioms, "text") == AXIOMS
    kinds = {(r["iri"].removeprefix(EX), r["entity_type"]) for r in onto.entities.collect()}
    classes = {(c, "Classes") for c in ("Animal", "Cow", "Plant", "Herbivore", "Both")}
    assert kinds == classes | {("eats", "ObjectProperties"), ("feedsOn", "ObjectProperties"), ("eatenBy", "ObjectProperties"), ("age", "DataProperties"), ("bella", "Individuals")}
    notes = {(r["iri"], r["literal"], r["lang"]) for r in onto.annotations.collect()}
    assert notes == {("http://ex.org/o", "about it", None), (f"{EX}Animal", 'animal "x"', "en"), (f"{EX}Animal", "Tier", "de")}
    facts = {tuple(x.removeprefix(EX) for x in r) for r in onto.assertions.select("subject", "predicate", "object").collect()}
    assert facts == {("bella", "http://type", "Cow"), ("grass1", "http://type", "Plant"), ("bella", "eats", "grass1"), ("bella", "age", "7")}
    edges = {(r["parent"], r["child"]) for r in re_.told_edges(onto).collect()}
    assert edges == {(f"{EX}Animal", f"{EX}Cow")}


def test_syntaxes_agree(spark, tmp_path):
    (tmp_path / "o.owl").write_text(DOC)
    triples = rdf.read_rdf_xml(spark, str(tmp_path / "o.owl"))
    onto = rdf.ontology_of(triples)
    rdf.write_ntriples(triples, str(tmp_path / "o.nt"))
    again = rdf.read_owl(spark, str(tmp_path / "o.nt"))
    (tmp_path / "o.ofn").write_text("\n".join(sorted(AXIOMS)) + "\n")
    plain = rdf.read_owl(spark, str(tmp_path / "o.ofn"))
    for table in ("entities", "axioms", "exprs", "annotations", "assertions"):
        mine = getattr(onto, table)
        same(mine, getattr(again, table).select(mine.columns))
    same(onto.axioms.select("axiom_type", "sub_expr", "sup_expr", "operands", "text"), plain.axioms.select("axiom_type", "sub_expr", "sup_expr", "operands", "text"))
    same(onto.exprs, plain.exprs.select(onto.exprs.columns))
    owl.write_functional(onto, str(tmp_path / "w.ofn"))
    same(owl.read_functional(spark, str(tmp_path / "w.ofn")).axioms.select("text"), onto.axioms.select("text"))


def test_long_list_and_circle(spark):
    n = 300
    rows = [(f"_:c{k}", f"{rdf.RDF}first", f"http://ex.org/{k:03}", False, None) for k in range(n)]
    rows += [(f"_:c{k}", f"{rdf.RDF}rest", f"_:c{k + 1}" if k + 1 < n else f"{rdf.RDF}nil", False, None) for k in range(n)]
    found = rdf.list_items(spark.createDataFrame(rows, rdf.TRIPLES)).orderBy("i").collect()
    assert [(r["head"], r["i"], r["item"]) for r in found] == [("_:c0", k, f"http://ex.org/{k:03}") for k in range(n)]
    ring = [("_:x", f"{rdf.OWL}complementOf", "_:y", False, None), ("_:y", f"{rdf.OWL}complementOf", "_:x", False, None)]
    with pytest.raises(ValueError, match="circular"):
        rdf.ontology_of(spark.createDataFrame(ring, rdf.TRIPLES))


def test_empty_and_null(spark, tmp_path):
    onto = rdf.ontology_of(spark.createDataFrame([(None, "p", "o", False, None), ("s", "p", None, None, None)], rdf.TRIPLES))
    assert all(getattr(onto, t).isEmpty() for t in ("entities", "axioms", "exprs", "annotations", "assertions"))
    (tmp_path / "e.nt").write_text('# a comment\n<s> <p> "a\\\\n\\"b\\"\\n"@en .\n\nnot a triple\n')
    row = rdf.read_ntriples(spark, str(tmp_path / "e.nt")).collect()
    assert [(r["subject"], r["object"], r["literal"], r["lang"]) for r in row] == [("s", 'a\\n"b"\n', True, "en")]
    assert rdf.read_ntriples(spark, str(tmp_path / "e.nt")).where(F.col("literal").isNull()).isEmpty()
