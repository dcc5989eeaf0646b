"""OWL in RDF, as RDF/XML or N-Triples, as ontology tables.

A reader gives triples ``(subject, predicate, object, literal, lang)``; blank
nodes begin with ``_:`` and are unique over files. ``ontology_of`` turns the
triples into tables by joins: lists are ranked by pointer doubling, so one of n
cells takes O(log n) rounds, and expressions are named from the leaves up, a
round per level of nesting. Expression ids are their functional texts, as the
functional syntax reader gives them, so the two kinds of files mix.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontospark.operators.ontology import Ontology
from ontospark.runtime import materialize
from ontospark.sources.owl import PREFIXES

RDF, RDFS, OWL, XSD = (PREFIXES[p] for p in ("rdf", "rdfs", "owl", "xsd"))
TRIPLES = "subject string, predicate string, object string, literal boolean, lang string"
#: The types that declare an entity, by its kind.
DECLARING = {f"{OWL}Class": "Classes", f"{OWL}ObjectProperty": "ObjectProperties", f"{OWL}DatatypeProperty": "DataProperties", f"{OWL}AnnotationProperty": "AnnotationProperties", f"{OWL}NamedIndividual": "Individuals"}
#: Predicates whose object is a list of parts, with the constructor's name and kind.
LISTED = {"intersectionOf": ("ObjectIntersectionOf", "and"), "unionOf": ("ObjectUnionOf", "or"), "oneOf": ("ObjectOneOf", "ObjectOneOf")}
#: Predicates of restrictions with a filler, and those with a number.
FILLED = {"someValuesFrom": ("ObjectSomeValuesFrom", "some"), "allValuesFrom": ("ObjectAllValuesFrom", "only")}
COUNTED = {"minCardinality": ("ObjectMinCardinality", "min"), "maxCardinality": ("ObjectMaxCardinality", "max"), "cardinality": ("ObjectExactCardinality", "exact")}
COUNTED |= {"minQualifiedCardinality": COUNTED["minCardinality"], "maxQualifiedCardinality": COUNTED["maxCardinality"], "qualifiedCardinality": COUNTED["cardinality"]}
#: A list or nesting that takes more rounds than this runs in a circle.
MOST_ROUNDS = 64
BATCH = 10_000
_XML = "{http://www.w3.org/XML/1998/namespace}"


class _Reader:
    """The triples of one RDF/XML document."""

    def __init__(self, scope: str):
        self.scope, self.made, self.out = scope, 0, []

    def blank(self, name: str | None = None) -> str:
        if name is None:
            self.made += 1
        return f"_:{self.scope}{f'n{name}' if name is not None else f'b{self.made}'}"

    def add(self, s: str, p: str, o: str, literal: bool = False, lang: str | None = None) -> None:
        self.out.append((s, p, o, literal, lang))

    @staticmethod
    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def node(self, e, base: str, lang: str | None) -> str:
        """The subject of a node element, whose triples are added."""
        base, lang = e.get(f"{_XML}base", base), e.get(f"{_XML}lang", lang) or None
        about, own, label = (e.get(f"{{{RDF}}}{k}") for k in ("about", "ID", "nodeID"))
        subject = urljoin(base, about) if about is not None else f"{base.partition('#')[0]}#{own}" if own is not None else self.blank(label)
        if about == "":
            subject = base
        if self.name(e.tag) != f"{RDF}Description":
            self.add(subject, f"{RDF}type", self.name(e.tag))
        self.attributes(subject, e, base, lang)
        for p in e:
            if isinstance(p.tag, str):
                self.property(subject, p, base, lang)
        return subject

    def attributes(self, subject: str, e, base: str, lang: str | None) -> None:
        for key, value in e.attrib.items():
            if key.startswith("{") and not key.startswith((_XML, f"{{{RDF}}}")):
                self.add(subject, self.name(key), value, True, lang)
            elif key == f"{{{RDF}}}type":
                self.add(subject, key[1:].replace("}", "", 1), urljoin(base, value))

    def property(self, subject: str, p, base: str, lang: str | None) -> None:
        predicate = self.name(p.tag)
        base, lang = p.get(f"{_XML}base", base), p.get(f"{_XML}lang", lang) or None
        resource, label, how = (p.get(f"{{{RDF}}}{k}") for k in ("resource", "nodeID", "parseType"))
        children = [c for c in p if isinstance(c.tag, str)]
        if how == "Collection":
            cells = [(self.blank(), self.node(c, base, lang)) for c in children]
            ends = [c for c, _ in cells] + [f"{RDF}nil"]
            self.add(subject, predicate, ends[0])
            for (cell, item), following in zip(cells, ends[1:]):
                self.add(cell, f"{RDF}first", item)
                self.add(cell, f"{RDF}rest", following)
        elif how == "Resource":
            inner = self.blank()
            self.add(subject, predicate, inner)
            for c in children:
                self.property(inner, c, base, lang)
        elif how is not None:
            self.add(subject, predicate, "".join([p.text or "", *(ElementTree.tostring(c, encoding="unicode") for c in children)]), True)
        elif resource is not None or label is not None:
            target = urljoin(base, resource) if resource else base if resource == "" else self.blank(label)
            self.add(subject, predicate, target)
            self.attributes(target, p, base, lang)
        elif children:
            for c in children:
                self.add(subject, predicate, self.node(c, base, lang))
        else:
            self.add(subject, predicate, p.text or "", True, None if p.get(f"{{{RDF}}}datatype") else lang)


def rdf_xml_triples(content: bytes, path: str) -> Iterator[list[tuple]]:
    """Batches of triples; elements below the root are freed as they end."""
    reader = _Reader(hashlib.sha1(path.encode()).hexdigest()[:12])
    depth, root, base, lang = 0, None, path, None
    for event, e in ElementTree.iterparse(io.BytesIO(content), ("start", "end")):
        if event == "start":
            depth += 1
            if depth == 1:
                root, base, lang = e, e.get(f"{_XML}base", path), e.get(f"{_XML}lang")
            continue
        depth -= 1
        if depth == 1 and reader.name(root.tag) == f"{RDF}RDF":
            reader.node(e, base, lang)
            root.clear()
        elif depth == 0 and reader.name(root.tag) != f"{RDF}RDF":
            reader.node(e, path, None)
        if len(reader.out) >= BATCH:
            yield reader.out
            reader.out = []
    yield reader.out


def read_rdf_xml(spark: SparkSession, path: str) -> DataFrame:
    """The triples of RDF/XML files; a file is read by one task, which holds its bytes but not its tree.

    An empty file has no triples; one that isn't well-formed raises an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                for rows in rdf_xml_triples(bytes(content), name) if content else ():
                    yield pd.DataFrame(rows, columns=["subject", "predicate", "object", "literal", "lang"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, TRIPLES)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """The triples of N-Triples files by column functions; blank nodes are told apart by file, other lines are left out.

    Escapes of quotes, backslashes, tabs and line ends in literals are undone, those of code points stay.
    """
    node = r"(?:<[^>]*>|_:\S+)"
    line = rf'^\s*({node})\s+<([^>]*)>\s+({node}|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'
    scope = F.substring(F.sha1(F.input_file_name().cast("binary")), 1, 12)
    rows = spark.read.text(path).select("value", scope.alias("scope")).where(F.col("value").rlike(line))
    part = lambda k: F.regexp_extract("value", line, k)
    raw = rows.select("scope", part(1).alias("s"), part(2).alias("p"), part(3).alias("o"))
    plain = lambda c: F.when(F.col(c).startswith("_:"), F.concat(F.lit("_:"), "scope", F.substr(c, F.lit(3)))).otherwise(F.expr(f"substring({c}, 2, length({c}) - 2)"))
    literal = F.col("o").startswith('"')
    body = F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*)"', 1)
    held = F.replace(body, F.lit("\\\\"), F.lit("\u0000"))
    for mark, char in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"'), ("\u0000", "\\")):
        held = F.replace(held, F.lit(mark), F.lit(char))
    lang = F.nullif(F.regexp_extract("o", r'"@([A-Za-z0-9-]+)$', 1), F.lit(""))
    return raw.select(plain("s").alias("subject"), F.col("p").alias("predicate"), F.when(literal, held).otherwise(plain("o")).alias("object"), literal.alias("literal"), F.when(literal, lang).alias("lang"))


def list_items(triples: DataFrame) -> DataFrame:
    """``(head, i, item)`` of all lists: every cell finds its head by doubling the distance it looks back."""
    of = lambda p: triples.where(F.col("predicate") == f"{RDF}{p}")
    first = materialize(of("first").groupBy(F.col("subject").alias("cell")).agg(F.min("object").alias("item")), "items")
    back = of("rest").where(F.col("object") != f"{RDF}nil").groupBy(F.col("object").alias("cell")).agg(F.min("subject").alias("before"))
    at = first.select("cell").join(back, "cell", "left").select("cell", F.coalesce("before", "cell").alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("i"))
    at = materialize(at, "cells")
    for _ in range(MOST_ROUNDS):
        step = at.select(F.col("cell").alias("head"), F.col("head").alias("further"), F.col("i").alias("more"))
        if at.join(step.where("more > 0"), "head", "left_semi").isEmpty():
            return at.join(first, "cell").select("head", "i", "item")
        at = materialize(at.join(step, "head").select("cell", F.col("further").alias("head"), (F.col("i") + F.col("more")).alias("i")), "cells")
    raise ValueError("a list runs in a circle")


def _choose(table: dict[str, tuple[str, str]], column: str, k: int):
    return F.element_at(F.create_map(*[F.lit(x) for p, v in table.items() for x in (OWL + p, v[k])]), F.col(column))


def _expressions(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, head, kind, number, prop, operands)`` of complex expressions, operands as nodes; and the lists."""
    of = lambda *names: t.where(F.col("predicate").isin([OWL + n for n in names]))
    items = list_items(t)
    grouped = items.groupBy(F.col("head").alias("object")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "item"))), lambda x: x["item"]).alias("operands"))
    grouped = materialize(grouped, "lists")
    none = F.lit(None).cast("string")
    shape = lambda df, table, number, prop, operands: df.select(F.col("subject").alias("node"), _choose(table, "predicate", 0).alias("head"), _choose(table, "predicate", 1).alias("kind"), number.alias("number"), prop.alias("prop"), operands.alias("operands"))
    listed = shape(of(*LISTED).join(grouped, "object"), LISTED, none, none, F.col("operands"))
    negated = shape(of("complementOf"), {"complementOf": ("ObjectComplementOf", "not")}, none, none, F.array("object"))
    inverse = of("inverseOf").where(F.col("subject").startswith("_:")).groupBy(F.col("subject").alias("prop")).agg(F.min("object").alias("inverse"))
    on = of("onProperty").groupBy("subject").agg(F.min("object").alias("prop")).join(inverse, "prop", "left")
    on = materialize(on.select("subject", F.when(F.col("inverse").isNotNull(), F.concat(F.lit("inverse "), "inverse")).otherwise(F.col("prop")).alias("prop")), "roles")
    filled = shape(of(*FILLED).join(on, "subject"), FILLED, none, F.col("prop"), F.array("object"))
    valued = shape(of("hasValue").where("not literal").join(on, "subject"), {"hasValue": ("ObjectHasValue", "ObjectHasValue")}, none, none, F.array("prop", "object"))
    target = of("onClass").groupBy("subject").agg(F.min("object").alias("target"))
    counted = of(*COUNTED).join(on, "subject").join(target, "subject", "left")
    counted = shape(counted, COUNTED, F.col("object"), F.col("prop"), F.when(F.col("target").isNotNull(), F.array("target")).otherwise(F.array().cast("array<string>")))
    return listed.union(negated).union(filled).union(valued).union(counted).dropDuplicates(["node"]), grouped


def angle(iri) -> Column:
    return F.concat(F.lit("<"), iri, F.lit(">"))


def _named(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, text)`` and the rows of ``exprs`` for the expressions ``nodes``, from the leaves up."""
    nodes = materialize(nodes, "nodes")
    parts = materialize(nodes.select("node", F.posexplode_outer("operands").alias("i", "part")), "parts")
    known = nodes.select("node", F.lit(None).cast("string").alias("text")).limit(0)
    left, rows = nodes, []
    for _ in range(MOST_ROUNDS):
        if left.isEmpty():
            break
        mine = parts.join(left.select("node"), "node", "left_semi").join(known.select(F.col("node").alias("part"), "text"), "part", "left")
        each = mine.withColumn("text", F.when(~F.col("part").startswith("_:"), angle("part")).otherwise(F.col("text")))
        done = each.groupBy("node").agg(F.count_if(F.col("part").isNotNull() & F.col("text").isNull()).alias("missing"), F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("i", "text")))), lambda x: x["text"]).alias("texts"))
        done = left.join(done.where("missing = 0").drop("missing"), "node")
        inside = F.concat(F.when(F.col("number").isNotNull(), F.concat("number", F.lit(" "))).otherwise(""), F.when(F.col("prop").isNotNull(), F.concat(angle("prop"), F.lit(" "))).otherwise(""), F.array_join("texts", " "))
        now = materialize(done.select("node", F.concat("head", F.lit("("), inside, F.lit(")")).alias("text"), "kind", "prop", F.col("texts").alias("operands")), "named")
        if now.isEmpty():
            raise ValueError("expressions with missing or circular parts")
        rows.append(now)
        known = known.union(now.select("node", "text"))
        left = materialize(left.join(now.select("node"), "node", "left_anti"), "nodes")
    else:
        raise ValueError("expressions run in a circle")
    exprs = nodes.select(F.lit("").alias("expr_id"), "kind", F.lit(None).cast("string").alias("iri"), "prop", "operands").limit(0)
    for now in rows:
        exprs = exprs.union(now.select("text", "kind", F.lit(None).cast("string"), "prop", "operands"))
    return known, exprs


def ontology_of(triples: DataFrame) -> Ontology:
    """The tables of the ontology that ``triples`` spell out.

    Repeated triples count once and triples with a null are left out. Axioms of
    blank nodes without a class expression (reified annotations, data ranges)
    are left out. A restriction or list that refers to itself raises an error.
    """
    whole = F.col("subject").isNotNull() & F.col("predicate").isNotNull() & F.col("object").isNotNull()
    t = triples.where(whole).select("subject", "predicate", "object", F.coalesce("literal", F.lit(False)).alias("literal"), "lang").distinct()
    # A constructor right at a class says that the class equals the expression.
    direct = ~F.col("subject").startswith("_:") & F.col("predicate").isin([f"{OWL}{n}" for n in (*LISTED, "complementOf")])
    moved = F.concat(F.lit("_:is "), "subject", F.lit(" "), "predicate", F.lit(" "), "object")
    t = materialize(t, "triples")
    t = materialize(t.where(~direct).union(t.where(direct).select(moved, "predicate", "object", "literal", "lang")).union(t.where(direct).select("subject", F.lit(f"{OWL}equivalentClass"), moved, F.lit(False), F.lit(None).cast("string"))), "triples")
    of = lambda *names: t.where(F.col("predicate").isin(list(names)))
    types = of(f"{RDF}type")
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in DECLARING.items() for x in pair]), F.col("object"))
    entities = types.where(F.col("object").isin(list(DECLARING)) & ~F.col("subject").startswith("_:")).select(F.col("subject").alias("iri"), kind.alias("entity_type")).distinct()
    entities = materialize(entities, "entities")
    nodes, lists = _expressions(t)
    texts, complex_ = _named(nodes)

    def named(df: DataFrame, column: str, out: str) -> DataFrame:
        joined = df.join(texts.select(F.col("node").alias(column), F.col("text").alias("_text")), column, "left")
        text = F.when(F.col(column).startswith("_:"), F.col("_text")).otherwise(angle(column))
        return joined.withColumn(out, text).drop("_text").where(F.col(out).isNotNull())

    properties = entities.where(F.col("entity_type").isin("ObjectProperties", "DataProperties", "AnnotationProperties"))
    role = properties.groupBy(F.col("iri").alias("subject")).agg(F.max("entity_type").alias("role"))
    relation = of(f"{RDFS}subClassOf", f"{OWL}equivalentClass", f"{OWL}disjointWith", f"{RDFS}subPropertyOf", f"{OWL}equivalentProperty", f"{OWL}inverseOf", f"{RDFS}domain", f"{RDFS}range").where("not literal")
    relation = relation.join(role, "subject", "left").withColumn("role", F.coalesce("role", F.lit("ObjectProperties")))
    stem = F.when(F.col("role") == "DataProperties", "DataProperty").when(F.col("role") == "AnnotationProperties", "AnnotationProperty").otherwise("ObjectProperty")
    p = F.col("predicate")
    name = F.when(p == f"{RDFS}subClassOf", "SubClassOf").when(p == f"{OWL}equivalentClass", "EquivalentClasses").when(p == f"{OWL}disjointWith", "DisjointClasses")
    name = name.when(p == f"{RDFS}subPropertyOf", F.concat(F.lit("Sub"), stem, F.lit("Of"))).when(p == f"{OWL}inverseOf", "InverseObjectProperties")
    name = name.when(p == f"{OWL}equivalentProperty", F.when(F.col("role") == "DataProperties", "EquivalentDataProperties").otherwise("EquivalentObjectProperties"))
    name = name.when(p == f"{RDFS}domain", F.concat(stem, F.lit("Domain"))).otherwise(F.concat(stem, F.lit("Range")))
    about = F.when(p.isin(f"{RDFS}subClassOf", f"{OWL}equivalentClass", f"{OWL}disjointWith"), "Classes").otherwise(F.col("role"))
    pairs = named(named(relation, "subject", "a"), "object", "b").select(name.alias("axiom_type"), about.alias("entity_type"), "a", "b")
    pairs = materialize(pairs, "pairs")
    symmetric = F.col("axiom_type").rlike("^(Equivalent|Disjoint|Inverse)")
    empty, none = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    axioms = pairs.where(~symmetric).select("axiom_type", "entity_type", F.col("a").alias("sub_expr"), F.col("b").alias("sup_expr"), empty.alias("operands"))
    axioms = axioms.union(pairs.where(symmetric).select("axiom_type", "entity_type", none, none, F.array("a", "b")))
    apart = types.where(F.col("object") == f"{OWL}AllDisjointClasses").select("subject").join(of(f"{OWL}members").select("subject", F.col("object").alias("list")), "subject")
    members = named(apart.join(lists.withColumnRenamed("object", "list"), "list").select("subject", F.posexplode("operands").alias("i", "part")), "part", "text")
    members = members.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("operands"))
    axioms = axioms.union(members.select(F.lit("DisjointClasses"), F.lit("Classes"), none, none, "operands"))
    chains = of(f"{OWL}propertyChainAxiom").select("subject", "object").join(lists, "object")
    chains = chains.select(angle("subject").alias("sup_expr"), F.transform("operands", angle).alias("operands"))
    chains = materialize(chains.withColumn("sub_expr", F.concat(F.lit("ObjectPropertyChain("), F.array_join("operands", " "), F.lit(")"))), "property_chains")
    axioms = axioms.union(chains.select(F.lit("SubObjectPropertyOf"), F.lit("ObjectProperties"), "sub_expr", "sup_expr", empty))
    complex_ = complex_.union(chains.select("sub_expr", F.lit("ObjectPropertyChain"), none, none, "operands"))
    body = F.concat("axiom_type", F.lit("("), F.when(F.col("operands").isNotNull(), F.array_join("operands", " ")).otherwise(F.concat_ws(" ", "sub_expr", "sup_expr")), F.lit(")"))
    axioms = axioms.withColumn("text", body).withColumn("axiom_id", F.sha1(F.col("text").cast("binary"))).dropDuplicates(["axiom_id"])
    axioms = materialize(axioms.select("axiom_id", "axiom_type", "entity_type", "sub_expr", "sup_expr", "operands", "text"), "axioms")

    outside = ~F.col("object").startswith(OWL) & ~F.col("object").startswith(RDF) & ~F.col("object").startswith(RDFS)
    typed = named(types.where(outside & ~F.col("subject").startswith("_:") & ~F.col("literal")), "object", "cls")
    typed = typed.select("subject", F.lit("http://type").alias("predicate"), F.when(F.col("cls").startswith("<"), F.col("object")).otherwise(F.col("cls")).alias("object"))
    data = entities.where(F.col("entity_type").isin("ObjectProperties", "DataProperties")).select(F.col("iri").alias("predicate")).distinct()
    facts = t.where(~F.col("subject").startswith("_:") & ~F.col("object").startswith("_:")).join(data, "predicate", "left_semi").select("subject", "predicate", "object")
    notes = t.where(F.col("literal") & ~F.col("subject").startswith("_:")).join(data, "predicate", "left_anti")

    iris = complex_.select(F.explode("operands").alias("x")).union(axioms.select(F.explode(F.concat(F.coalesce("operands", F.array().cast("array<string>")), F.array_compact(F.array("sub_expr", "sup_expr"))))))
    iris = iris.where(F.col("x").startswith("<")).distinct().select("x", F.lit("class"), F.expr("substring(x, 2, length(x) - 2)"), none, empty)
    return Ontology(
        entities=entities,
        axioms=axioms,
        exprs=materialize(complex_.dropDuplicates(["expr_id"]).union(iris), "exprs"),
        annotations=materialize(notes.select(F.col("subject").alias("iri"), F.col("predicate").alias("property_iri"), F.col("object").alias("literal"), "lang").distinct(), "annotations"),
        assertions=materialize(typed.union(facts).distinct(), "assertions"),
    )


def read_owl(spark: SparkSession, path: str) -> Ontology:
    """An ontology in the syntax that the suffix names: ``.nt``, ``.ofn`` (functional), else RDF/XML."""
    from ontospark.sources.owl import read_functional

    name = path.rstrip("/").lower()
    if name.endswith((".ofn", ".fss")):
        return read_functional(spark, path)
    return ontology_of(read_ntriples(spark, path) if name.endswith(".nt") else read_rdf_xml(spark, path))


def write_ntriples(triples: DataFrame, path: str) -> None:
    """Triples as lines of N-Triples."""
    term = lambda c: F.when(F.col(c).startswith("_:"), F.translate(c, " ", "_")).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    text = F.col("object")
    for char, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(char), F.lit(mark))
    tail = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).otherwise("")
    value = F.when(F.col("literal"), F.concat(F.lit('"'), text, F.lit('"'), tail)).otherwise(term("object"))
    triples.select(F.concat(term("subject"), F.lit(" <"), "predicate", F.lit("> "), value, F.lit(" ."))).write.mode("overwrite").text(path)
