"""OWL in functional syntax, one axiom per line, as ontology tables; and back."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontospark.operators.ontology import Ontology
from ontospark.runtime import materialize

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^\S+?(?=[\s)]))?|<[^>]*>|[()]|[^\s()"]+')
#: Declarations, expression constructors and the kind each stands for.
DECLARED = {"Class": "Classes", "ObjectProperty": "ObjectProperties", "DataProperty": "DataProperties", "AnnotationProperty": "AnnotationProperties", "NamedIndividual": "Individuals"}
KINDS = {"ObjectIntersectionOf": "and", "ObjectUnionOf": "or", "ObjectComplementOf": "not", "ObjectSomeValuesFrom": "some", "ObjectAllValuesFrom": "only", "ObjectMinCardinality": "min", "ObjectMaxCardinality": "max", "ObjectExactCardinality": "exact"}
PREFIXES = {"owl": "http://www.w3.org/2002/07/owl#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#"}


def _tree(tokens: list[str]) -> list:
    stack: list[list] = [[]]
    for t in tokens:
        if t == "(":
            named = stack[-1] and isinstance(stack[-1][-1], str) and stack[-1][-1].isalpha()  # a keyword, not an entity before a list
            head = stack[-1].pop() if named else ""
            stack.append([head])
        elif t == ")":
            if len(stack) == 1:
                raise ValueError("unbalanced )")
            node = stack.pop()
            stack[-1].append(node)
        else:
            stack[-1].append(t)
    if len(stack) > 1:
        raise ValueError("unbalanced (")
    return stack[0]


def _iri(token: str, prefixes: dict[str, str]) -> str:
    if token.startswith("<"):
        return token[1:-1]
    name, colon, rest = token.partition(":")
    return prefixes[name] + rest if colon and name in prefixes else token


def _literal(token: str) -> tuple[str, str | None]:
    body, _, tail = token[1:].rpartition('"')
    return body.replace('\\"', '"').replace("\\\\", "\\"), tail[1:] if tail.startswith("@") else None


def _full(node, prefixes: dict[str, str]) -> str:
    """A part of an axiom in functional syntax without prefixes."""
    if isinstance(node, list):
        return f"{node[0]}({' '.join(_full(x, prefixes) for x in node[1:])})"
    if node.startswith('"'):
        body, mark, kind = node.rpartition('"^^')
        return f"{body}{mark}<{_iri(kind, prefixes)}>" if mark else node
    return node if node.isdigit() or "=" in node else f"<{_iri(node, prefixes)}>"


def parse_line(line: str, prefixes: dict[str, str]) -> list[tuple]:
    """Rows ``(table, a, b, c, d, list)`` of one axiom; of a kind that has no table of its own the text is kept, with full iris."""
    out: list[tuple] = []

    def expr(node) -> str:
        """The id of an expression, whose rows are added: its canonical text."""
        if isinstance(node, str):
            iri = _iri(node, prefixes)
            out.append(("expr", f"<{iri}>", "class", iri, None, None))
            return f"<{iri}>"
        head, *args = node
        kind, prop, number = KINDS.get(head, head), None, ""
        if kind in ("min", "max", "exact"):
            number, args = f"{args[0]} ", args[1:]
        if kind in ("some", "only", "min", "max", "exact"):
            prop, args = _iri(args[0], prefixes) if isinstance(args[0], str) else f"inverse {_iri(args[0][1], prefixes)}", args[1:]
        parts = [expr(a) for a in args]
        text = f"{head}({number}{f'<{prop}> ' if prop else ''}{' '.join(parts)})"
        out.append(("expr", text, kind, None, prop, parts))
        return text

    for node in _tree(_TOKEN.findall(line)):
        if isinstance(node, str) or not node:
            continue
        head, *args = node
        args = [a for a in args if not (isinstance(a, list) and a[0] == "Annotation")]
        if head == "Declaration":
            out.append(("entity", _iri(args[0][1], prefixes), DECLARED.get(args[0][0], args[0][0]), None, None, None))
        elif head == "AnnotationAssertion":
            value = args[2]
            if value.startswith('"'):
                text, lang = _literal(value)
                out.append(("annotation", _iri(args[1], prefixes), _iri(args[0], prefixes), text, lang, None))
        elif head == "ClassAssertion":
            cls = expr(args[0])
            out.append(("assertion", _iri(args[1], prefixes), "http://type", cls[1:-1] if cls.startswith("<") else cls, None, None))
        elif head in ("ObjectPropertyAssertion", "DataPropertyAssertion"):
            if head == "DataPropertyAssertion":  # its objects are literals, and are written as such
                out.append(("entity", _iri(args[0], prefixes), DECLARED["DataProperty"], None, None, None))
            value = _literal(args[2])[0] if args[2].startswith('"') else _iri(args[2], prefixes)
            out.append(("assertion", _iri(args[1], prefixes), _iri(args[0], prefixes), value, None, None))
        elif head in ("SubClassOf", "SubObjectPropertyOf", "SubDataPropertyOf", "SubAnnotationPropertyOf", "ObjectPropertyDomain", "ObjectPropertyRange"):
            out.append(("axiom", head, expr(args[0]), expr(args[1]), line.strip(), None))
        elif head in ("EquivalentClasses", "DisjointClasses", "EquivalentObjectProperties", "EquivalentDataProperties", "InverseObjectProperties"):
            out.append(("axiom", head, None, None, line.strip(), [expr(a) for a in args]))
        else:
            out.append(("axiom", head, None, None, _full([head, *args], prefixes), None))
    return out


def read_functional(spark: SparkSession, path: str) -> Ontology:
    """The tables of the ontologies under ``path``; a file's prefixes are those of its ``Prefix`` lines."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line"))
    pattern = r"^Prefix\(\s*([^:\s]*):\s*=\s*<([^>]*)>"
    found = lines.where(F.col("line").startswith("Prefix(")).select("file", *(F.regexp_extract("line", pattern, k).alias(c) for k, c in ((1, "p"), (2, "i"))))
    by_file = found.groupBy("file", "p").agg(F.max("i").alias("i")).groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p", "i")))).alias("prefixes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for prefixes, part in batch.groupby("prefixes", dropna=False, sort=False):
                known = PREFIXES | (json.loads(prefixes) if isinstance(prefixes, str) else {})
                rows += [row for line in part["line"] for row in parse_line(line, known)]
            yield pd.DataFrame(rows, columns=["t", "a", "b", "c", "d", "l"])

    axioms = lines.where(~F.col("line").rlike(r"^(Prefix|Ontology|Import)\(") & ~F.col("line").isin("", ")") & ~F.col("line").startswith("#"))
    rows = materialize(axioms.join(by_file, "file", "left").select("line", "prefixes").mapInPandas(run, "t string, a string, b string, c string, d string, l array<string>"), "owl")
    of = lambda t: rows.where(F.col("t") == t)
    kind = F.when(F.col("a").contains("ObjectPropert"), "ObjectProperties").when(F.col("a").contains("DataPropert"), "DataProperties").when(F.col("a").contains("AnnotationPropert"), "AnnotationProperties").otherwise("Classes")
    axiom = of("axiom").select(F.sha1("d").alias("axiom_id"), F.col("a").alias("axiom_type"), kind.alias("entity_type"), F.col("b").alias("sub_expr"), F.col("c").alias("sup_expr"), F.col("l").alias("operands"), F.col("d").alias("text"))
    return Ontology(
        entities=of("entity").select(F.col("a").alias("iri"), F.col("b").alias("entity_type")).distinct(),
        axioms=axiom.dropDuplicates(["axiom_id"]),
        exprs=of("expr").select(F.col("a").alias("expr_id"), F.col("b").alias("kind"), F.col("c").alias("iri"), F.col("d").alias("prop"), F.col("l").alias("operands")).dropDuplicates(["expr_id"]),
        annotations=of("annotation").select(F.col("a").alias("iri"), F.col("b").alias("property_iri"), F.col("c").alias("literal"), F.col("d").alias("lang")).distinct(),
        assertions=of("assertion").select(F.col("a").alias("subject"), F.col("b").alias("predicate"), F.col("c").alias("object")).distinct(),
    )


def functional_lines(onto: Ontology) -> DataFrame:
    """``value``: the ontology's declarations, axioms, annotations and assertions as lines of functional syntax."""
    one = F.create_map(*[F.lit(x) for k, v in DECLARED.items() for x in (v, k)])
    declared = onto.entities.select(F.concat(F.lit("Declaration("), F.element_at(one, F.col("entity_type")), F.lit("(<"), "iri", F.lit(">))")))
    two = onto.axioms.where("sub_expr is not null").select(F.concat("axiom_type", F.lit("("), "sub_expr", F.lit(" "), "sup_expr", F.lit(")")))
    many = onto.axioms.where("sub_expr is null and operands is not null").select(F.concat("axiom_type", F.lit("("), F.array_join("operands", " "), F.lit(")")))
    if "text" in onto.axioms.columns:  # kinds of axioms without a table of their own
        many = many.union(onto.axioms.where("sub_expr is null and operands is null").select("text"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    tail = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).otherwise(F.lit(""))
    notes = onto.annotations.select(F.concat(F.lit("AnnotationAssertion(<"), "property_iri", F.lit("> <"), "iri", F.lit("> "), quoted(F.col("literal")), tail, F.lit(")")))
    typed = onto.assertions.where("predicate = 'http://type'").select(F.concat(F.lit("ClassAssertion("), F.when(F.col("object").contains("("), F.col("object")).otherwise(F.concat(F.lit("<"), "object", F.lit(">"))), F.lit(" <"), "subject", F.lit(">)")))
    data = onto.entities.where(F.col("entity_type") == DECLARED["DataProperty"]).select(F.col("iri").alias("predicate"), F.lit(True).alias("data")).distinct()
    head = F.concat(F.when(F.col("data"), F.lit("DataPropertyAssertion(<")).otherwise(F.lit("ObjectPropertyAssertion(<")), "predicate", F.lit("> <"), "subject", F.lit("> "))
    last = F.when(F.col("data"), quoted(F.col("object"))).otherwise(F.concat(F.lit("<"), "object", F.lit(">")))
    facts = onto.assertions.where("predicate <> 'http://type'").join(data, "predicate", "left").select(F.concat(head, last, F.lit(")")))
    return declared.union(two).union(many).union(notes).union(typed).union(facts).toDF("value")


def write_functional(onto: Ontology, path: str) -> None:
    functional_lines(onto).write.mode("overwrite").text(path)
