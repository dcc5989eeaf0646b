"""Triples ``(source, relation, target)`` from ontology tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontospark.functions.text import strip_marks
from ontospark.operators.ontology import LABEL, NOTHING, THING, Ontology
from ontospark.runtime import materialize

SUB, SUPER, TYPE = "http://subclassof", "http://superclassof", "http://type"
EQUIVALENT = "http://equivalentto"
RDFS_SUB = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
QUANTIFIERS = ("some", "only", "min", "max")
#: Properties whose literals become triples: names, synonyms, and other texts.
LEXICAL = [
    "http://www.w3.org/2000/01/rdf-schema#label",
    "http://www.w3.org/2004/02/skos/core#prefLabel",
    "rdfs:label",
    "rdfs:comment",
    "http://purl.obolibrary.org/obo/IAO_0000111",
    "http://purl.obolibrary.org/obo/IAO_0000589",
    "http://www.geneontology.org/formats/oboInOwl#hasRelatedSynonym",
    "http://www.geneontology.org/formats/oboInOwl#hasExactSynonym",
    "http://www.geneontology.org/formats/oboInOWL#hasExactSynonym",
    "http://purl.bioontology.org/ontology/SYN#synonym",
    "http://scai.fraunhofer.de/CSEO#Synonym",
    "http://purl.obolibrary.org/obo/synonym",
    "http://ncicb.nci.nih.gov/xml/owl/EVS/Thesaurus.owl#FULL_SYN",
    "http://www.ebi.ac.uk/efo/alternative_term",
    "http://ncicb.nci.nih.gov/xml/owl/EVS/Thesaurus.owl#Synonym",
    "http://bioontology.org/projects/ontologies/fma/fmaOwlDlComponent_2_0#Synonym",
    "http://www.geneontology.org/formats/oboInOwl#hasDefinition",
    "http://bioontology.org/projects/ontologies/birnlex#preferred_label",
    "http://bioontology.org/projects/ontologies/birnlex#synonyms",
    "http://www.w3.org/2004/02/skos/core#altLabel",
    "https://cfpub.epa.gov/ecotox#latinName",
    "https://cfpub.epa.gov/ecotox#commonName",
    "https://www.ncbi.nlm.nih.gov/taxonomy#scientific_name",
    "https://www.ncbi.nlm.nih.gov/taxonomy#synonym",
    "https://www.ncbi.nlm.nih.gov/taxonomy#equivalent_name",
    "https://www.ncbi.nlm.nih.gov/taxonomy#genbank_synonym",
    "https://www.ncbi.nlm.nih.gov/taxonomy#common_name",
    "http://purl.obolibrary.org/obo/IAO_0000118",
    "http://www.w3.org/2000/01/rdf-schema#comment",
    "http://www.geneontology.org/formats/oboInOwl#hasDbXref",
    "http://purl.org/dc/elements/1.1/description",
    "http://purl.org/dc/terms/description",
    "http://purl.org/dc/elements/1.1/title",
    "http://purl.org/dc/terms/title",
    "http://purl.obolibrary.org/obo/IAO_0000115",
    "http://purl.obolibrary.org/obo/IAO_0000600",
    "http://purl.obolibrary.org/obo/IAO_0000602",
    "http://purl.obolibrary.org/obo/IAO_0000601",
    "http://www.geneontology.org/formats/oboInOwl#hasOBONamespace",
]


def _triples(df: DataFrame, s, r, t) -> DataFrame:
    return df.select(s.alias("source"), r.alias("relation"), t.alias("target"))


def taxonomy_triples(edges: DataFrame, bidirectional: bool = False) -> DataFrame:
    """A triple for each edge ``(parent, child)``, and one back if asked for."""
    up = _triples(edges, F.col("child"), F.lit(SUB), F.col("parent"))
    return (up.union(_triples(edges, F.col("parent"), F.lit(SUPER), F.col("child"))) if bidirectional else up).distinct()


def restriction_triples(restrictions: DataFrame, sub_roles: DataFrame | None = None, inverses: DataFrame | None = None) -> DataFrame:
    """Of ``(source, relation, target)`` for a quantified class also those by super roles, and by the inverse role back.

    ``sub_roles``: ``(sub, super)``; ``inverses``: ``(role, inverse)``, used in both directions.
    """
    out = restrictions.select("source", "relation", "target")
    if sub_roles is not None:
        out = out.union(restrictions.join(sub_roles, restrictions.relation == sub_roles["sub"]).select("source", F.col("super"), "target"))
    if inverses is not None:
        both = inverses.select("role", "inverse").union(inverses.select("inverse", "role"))
        out = out.union(restrictions.join(both, restrictions.relation == both["role"]).select("target", "inverse", "source"))
    return out.distinct()


def quantified(onto: Ontology) -> DataFrame:
    """``(expr_id, relation, filler)`` of quantified expressions with a named filler."""
    q = onto.exprs.where(F.col("kind").isin(*QUANTIFIERS)).select("expr_id", F.col("prop").alias("relation"), F.element_at("operands", 1).alias("f"))
    return q.join(onto.named().select(F.col("expr_id").alias("f"), F.col("iri").alias("filler")), "f").select("expr_id", "relation", "filler")


def class_triples(onto: Ontology, bidirectional: bool = False, sub_roles: DataFrame | None = None, inverses: DataFrame | None = None) -> DataFrame:
    """Triples of subsumptions and equivalences: named pairs, restrictions on either side, parts of intersections and unions."""
    named = onto.named()
    pairs = onto.subsumptions().select("sub_expr", "sup_expr")
    two = onto.equivalences().select(F.element_at("operands", 1).alias("sub_expr"), F.try_element_at("operands", F.lit(2)).alias("sup_expr")).where("sup_expr is not null")
    parts = onto.exprs.where(F.col("kind").isin("and", "or")).select(F.col("expr_id").alias("sup_expr"), F.explode("operands").alias("part"))
    spread = two.join(parts, "sup_expr").select("sub_expr", F.col("part").alias("sup_expr"))
    pairs = pairs.union(two).union(spread).distinct()
    sub = pairs.join(named.select(F.col("expr_id").alias("sub_expr"), F.col("iri").alias("child")), "sub_expr")
    plain = sub.join(named.select(F.col("expr_id").alias("sup_expr"), F.col("iri").alias("parent")), "sup_expr")
    q = quantified(onto)
    right = sub.join(q.withColumnRenamed("expr_id", "sup_expr"), "sup_expr").select(F.col("child").alias("source"), "relation", F.col("filler").alias("target"))
    sup = pairs.join(named.select(F.col("expr_id").alias("sup_expr"), F.col("iri").alias("source")), "sup_expr")
    left = sup.join(q.withColumnRenamed("expr_id", "sub_expr"), "sub_expr").select("source", "relation", F.col("filler").alias("target"))
    return taxonomy_triples(plain, bidirectional).union(restriction_triples(right.union(left), sub_roles, inverses)).distinct()


def relation_triples(onto: Ontology, relations: list[str], taxonomy: bool = False, bidirectional: bool = False) -> DataFrame:
    """Triples of subsumptions under ``some r.B`` for r in ``relations`` and, with ``taxonomy``, of those between named classes (with ``bidirectional`` also back)."""
    named = onto.named()
    sub = onto.subsumptions().select("sub_expr", "sup_expr").join(named.select(F.col("expr_id").alias("sub_expr"), F.col("iri").alias("child")), "sub_expr")
    some = onto.exprs.where("kind = 'some'").select("expr_id").join(quantified(onto).where(F.col("relation").isin(relations)), "expr_id")
    out = _triples(sub.join(some.withColumnRenamed("expr_id", "sup_expr"), "sup_expr"), F.col("child"), F.col("relation"), F.col("filler"))
    if taxonomy:
        plain = sub.join(named.select(F.col("expr_id").alias("sup_expr"), F.col("iri").alias("parent")), "sup_expr")
        out = out.union(taxonomy_triples(plain, bidirectional))
    return out.distinct()


def annotation_triples(annotations: DataFrame, properties: list[str] = LEXICAL) -> DataFrame:
    """Triples of the whitelisted properties, marks around the literal stripped, empty ones left out."""
    kept = annotations.where(F.col("property_iri").isin(properties))
    out = _triples(kept, F.col("iri"), F.col("property_iri"), strip_marks(F.col("literal")))
    return out.where("target <> ''").distinct()


def assertion_triples(types: DataFrame, facts: DataFrame) -> DataFrame:
    """``(individual, cls)`` as type triples, ``(subject, predicate, object)`` as they are."""
    return _triples(types, F.col("individual"), F.lit(TYPE), F.col("cls")).union(facts.select("subject", "predicate", "object")).distinct()


def domain_range_triples(domains: DataFrame, ranges: DataFrame, sub_roles: DataFrame | None = None, inverses: DataFrame | None = None) -> DataFrame:
    """``(domain, property, range)`` for each domain and range of a property, by super roles and inverses too."""
    both = domains.join(ranges, "property").select(F.col("domain").alias("source"), F.col("property").alias("relation"), F.col("range").alias("target"))
    return restriction_triples(both, sub_roles, inverses)


def project(parts: list[DataFrame], only_taxonomy: bool = False) -> DataFrame:
    """Distinct triples of all parts with a target; the name of the subclass relation is the RDFS one."""
    out = parts[0]
    for more in [] if only_taxonomy else parts[1:]:
        out = out.union(more)
    renamed = F.when(F.col("relation") == SUB, F.lit(RDFS_SUB)).otherwise(F.col("relation"))
    return out.where("target is not null and target <> ''").select("source", renamed.alias("relation"), "target").distinct()


def flatten_junctions(onto: Ontology) -> DataFrame:
    """``(expr_id, atom)``: the named classes under each expression, through intersections and unions only."""
    parts = onto.exprs.where(F.col("kind").isin("and", "or")).select("expr_id", F.explode("operands").alias("part"))
    at = materialize(onto.exprs.select("expr_id", F.col("expr_id").alias("part")), "parts")
    out = []
    while not at.isEmpty():
        out.append(at.join(onto.named().select(F.col("expr_id").alias("part"), F.col("iri").alias("atom")), "part").select("expr_id", "atom"))
        at = materialize(at.join(parts.select(F.col("expr_id").alias("part"), F.col("part").alias("next")), "part").select("expr_id", F.col("next").alias("part")), "parts")
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found.distinct()


def chain_triples(onto: Ontology) -> DataFrame:
    """Triples of nested quantifiers: every relation on the way to an innermost class, by that class."""
    named = onto.named()
    pairs = onto.subsumptions().select("sub_expr", "sup_expr").join(named.select(F.col("expr_id").alias("sub_expr"), F.col("iri").alias("source")), "sub_expr")
    inner = onto.exprs.where(F.col("kind").isin(*QUANTIFIERS)).select(F.col("expr_id").alias("at"), "prop", F.element_at("operands", 1).alias("filler"))
    at = materialize(pairs.select("source", F.array().cast("array<string>").alias("path"), F.col("sup_expr").alias("at")), "chains")
    atoms = flatten_junctions(onto)
    out = taxonomy_triples(pairs.join(atoms.withColumnRenamed("expr_id", "sup_expr"), "sup_expr").select(F.col("atom").alias("parent"), F.col("source").alias("child")))
    while not at.isEmpty():
        at = materialize(at.join(inner, "at").select("source", F.array_append("path", F.col("prop")).alias("path"), F.col("filler").alias("at")), "chains")
        ends = at.join(atoms.withColumnRenamed("expr_id", "at"), "at").select("source", F.explode("path").alias("relation"), F.col("atom").alias("target"))
        out = out.union(ends)
    heads = onto.equivalences().select(F.posexplode("operands").alias("i", "expr_id"), "axiom_id").join(named, "expr_id")
    first = heads.groupBy("axiom_id").agg(F.min_by("iri", "i").alias("source"))
    same = heads.join(first, "axiom_id").where("iri <> source")
    return out.union(_triples(same, F.col("source"), F.lit(EQUIVALENT), F.col("iri"))).distinct()


def category_triples(onto: Ontology) -> DataFrame:
    """Triples of the reading as a category, with an ``id`` for every node.

    A subsumption negates its named subclass and injects both sides into the
    top; a named class projects to the parts of an equivalent intersection, and
    those of a union are injected into it; the bottom projects to both sides of
    a disjointness. Relations on the way down an expression are joined to
    ``projects_r_s`` and ``injects_inv_r``. A relation is called by its label
    with ``_`` for spaces, or by its iri without one. Where a form has no
    reading (a union within an intersection, an intersection within a union,
    ``only`` and ``min`` under another quantifier, ``max``) there is no triple.
    """
    named = onto.named()
    label = onto.annotations.where(F.col("property_iri") == LABEL).groupBy(F.col("iri").alias("prop")).agg(F.min("literal").alias("label"))
    exprs = onto.exprs.join(label, "prop", "left")
    exprs = exprs.select("expr_id", "kind", "iri", F.regexp_replace(F.coalesce("label", "prop"), " ", "_").alias("rel"), F.coalesce("operands", F.array().cast("array<string>")).alias("operands"))
    exprs = materialize(exprs, "exprs")
    whole = lambda c: named.select(F.col("expr_id").alias(c), F.col("iri").alias("cls"))
    none, no = F.lit(None).cast("string"), F.lit(False)
    subs = onto.subsumptions().select("sub_expr", "sup_expr").join(whole("sub_expr"), "sub_expr")
    start = subs.select(F.lit(THING).alias("cls"), F.lit("injects").alias("way"), F.explode(F.array("sub_expr", "sup_expr")).alias("expr_id"), none.alias("rel"), no.alias("negated"))

    def others(axioms: DataFrame) -> DataFrame:
        each = axioms.select("axiom_id", F.explode("operands").alias("e"))
        return each.join(whole("e"), "e").alias("x").join(each.alias("y"), "axiom_id").where("x.e <> y.e").select("x.cls", F.col("y.e").alias("expr_id"))

    apart = others(onto.axioms.where("axiom_type = 'DisjointClasses'"))
    start = start.union(apart.select(F.lit(NOTHING), F.lit("projects"), "expr_id", none, no))
    # The parts of what a class is equivalent to: below quantifiers there is a reading for intersections and unions only.
    same = others(onto.equivalences())
    parts = exprs.select("expr_id", "kind", F.explode("operands").alias("part"))
    while not (same := materialize(same, "same")).isEmpty():
        inner = same.join(parts, "expr_id")
        way = F.when(F.col("kind") == "and", "projects").otherwise("injects")
        start = start.union(inner.where(F.col("kind").isin("and", "or")).select("cls", way, "part", none, no))
        same = inner.where("kind = 'some'").select("cls", F.col("part").alias("expr_id"))
    out = [_triples(subs, F.concat(F.lit("Not_"), "cls"), F.lit("negate"), F.col("cls")), _triples(apart, F.lit(NOTHING), F.lit("projects"), F.col("cls"))]
    while not (start := materialize(start.distinct(), "category")).isEmpty():
        at = start.withColumnRenamed("rel", "before").join(exprs, "expr_id")
        leaf = at.where("iri is not null")
        arrow = F.concat_ws("_", "way", "before")
        out.append(_triples(leaf.where("way = 'projects'"), F.col("cls"), arrow, F.col("iri")))
        out.append(_triples(leaf.where("way = 'injects'"), F.col("iri"), arrow, F.col("cls")))
        out.append(_triples(leaf.where("negated"), F.concat(F.lit("Not_"), "iri"), F.lit("negate"), F.col("iri")))
        # A negated expression is read in negation normal form: the kinds change places on the way down.
        swapped = F.when(F.col("negated"), F.element_at(F.create_map(*map(F.lit, ["and", "or", "or", "and", "some", "only", "only", "some", "not", "not"])), F.col("kind"))).otherwise(F.col("kind"))
        inverse = F.when((F.col("way") == "injects") | F.col("as").isin("min", "exact"), F.concat(F.lit("inv_"), "rel")).otherwise(F.col("rel"))
        inner = at.where("iri is null").withColumn("as", swapped)
        goes = (F.col("as").isin("not", "some")) | (F.col("as").isin("only", "min", "exact") & F.col("before").isNull()) | ((F.col("as") == "and") & (F.col("way") == "projects"))
        rel = F.when(F.col("as").isin("some", "only", "min", "exact"), F.concat_ws("_", "before", inverse)).otherwise(F.col("before"))
        start = inner.where(goes).select("cls", "way", F.explode("operands").alias("expr_id"), rel.alias("rel"), (F.col("negated") != (F.col("kind") == "not")).alias("negated"))
    found = materialize(functools.reduce(DataFrame.union, out).distinct(), "category")
    nodes = found.select("source").union(found.select("target")).distinct()
    return found.union(_triples(nodes, F.col("source"), F.lit("id"), F.col("source")))
