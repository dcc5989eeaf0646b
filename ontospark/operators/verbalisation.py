"""Class expressions in words: a parser of functional syntax, and folds over expression tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontospark.functions.text import strip_preposition, verb_phrase
from ontospark.runtime import materialize

#: Operator names of functional syntax and the five characters that stand for each.
FIXED = {
    "ObjectComplementOf": "[NEG]", "ObjectSomeValuesFrom": "[EX.]", "ObjectAllValuesFrom": "[ALL]", "ObjectUnionOf": "[OR.]", "ObjectIntersectionOf": "[AND]",
    "ObjectPropertyChain": "[OPC]", "EquivalentClasses": "[EQV]", "SubClassOf": "[SUB]", "SuperClassOf": "[SUP]", "ClassAssertion": "[CLA]",
    "SubObjectPropertyOf": "[SUB]", "SuperObjectPropertyOf": "[SUP]", "ObjectPropertyAssertion": "[OPA]", "ObjectPropertyDomain": "[OPD]",
    "DataPropertyDomain": "[DPD]", "AnnotationPropertyDomain": "[APD]", "ObjectPropertyRange": "[OPR]", "DataPropertyRange": "[DPR]", "AnnotationPropertyRange": "[APR]",
}
#: Names beyond those, of our own.
OWN = {"DisjointClasses": "[DIS]", "ObjectHasValue": "[HAS]", "ObjectMinCardinality": "[MIN]", "ObjectMaxCardinality": "[MAX]", "ObjectExactCardinality": "[EXA]"}
SHORT = FIXED | OWN
_NAMES = re.compile("|".join(sorted(SHORT, key=len, reverse=True)))
_TAG = re.compile(r"\[[A-Z.]{3,4}\]$")


def abbreviate(text: str) -> str:
    return _NAMES.sub(lambda m: SHORT[m[0]], text)


@dataclass
class Node:
    """A part ``[start, end)`` of an abbreviated expression: an operator with its parts, or an iri."""

    start: int
    end: int
    name: str
    text: str
    parts: list[Node] = field(default_factory=list)

    def walk(self, depth: int = 0) -> Iterator[tuple[int, Node]]:
        yield depth, self
        for part in self.parts:
            yield from part.walk(depth + 1)

    def render(self) -> str:
        return "\n".join("  " * depth + f"{node.name}@[{node.start}:{node.end}]" for depth, node in self.walk())


def parse(text: str) -> Node:
    """The tree of an abbreviated expression; operators begin at their tag, iris at their bracket."""
    root = Node(0, len(text), "Root", text)
    stack, at = [root], 0
    while at < len(text):
        c = text[at]
        if c == "(":
            tag = _TAG.search(text[:at])
            start = tag.start() if tag else at
            stack.append(Node(start, -1, tag[0][1:-1] if tag else "", ""))
        elif c == "<":
            end = text.find(">", at)
            if end < 0:
                raise ValueError("unbalanced <")
            iri = text[at + 1 : end]
            stack[-1].parts.append(Node(at, end + 1, iri.rpartition("/")[2].rpartition("#")[2], iri))
            at = end
        elif c == ")":
            if len(stack) == 1:
                raise ValueError("unbalanced )")
            node = stack.pop()
            node.end, node.text = at + 1, text[node.start : at + 1]
            stack[-1].parts.append(node)
        at += 1
    if len(stack) > 1:
        raise ValueError("unbalanced (")
    return root


def parse_expressions(expressions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, start, end, name, text, depth)``: the parts of every expression; a faulty one gives one row named ``error``."""
    kind = expressions.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"]):
                try:
                    rows.extend((key, n.start, n.end, n.name, n.text, d) for d, n in parse(abbreviate(text or "")).walk())
                except ValueError as fault:
                    rows.append((key, 0, 0, "error", str(fault), 0))
            yield pd.DataFrame(rows, columns=["id", "start", "end", "name", "text", "depth"])

    slim = expressions.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(run, f"id {kind}, start int, end int, name string, text string, depth int")


def vocabulary(entities: DataFrame, labels: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``(iri, name)``: an override, else the smallest label, else the iri."""
    name = labels.groupBy("iri").agg(F.min("literal").alias("label"))
    out = entities.select("iri").distinct().join(name, "iri", "left")
    if overrides is not None:
        out = out.join(overrides.select("iri", F.col("name").alias("own")), "iri", "left")
        return out.select("iri", F.coalesce("own", "label", "iri").alias("name"))
    return out.select("iri", F.coalesce("label", "iri").alias("name"))


def restriction_text(prop, quantifier, filler, standalone: bool = True):
    """``[something that ]r some|only C`` as a column."""
    lead = F.lit("something that ") if standalone else F.lit("")
    return F.concat(lead, verb_phrase(prop), F.lit(" "), quantifier, F.lit(" "), filler)


def verbalise(exprs: DataFrame, vocab: DataFrame, quantifiers: bool = True) -> DataFrame:
    """``(expr_id, text)`` for expressions of kind class, some, only, and, or, not: from the leaves up, a round per level.

    In a junction the restrictions of one property share it (``r C and D``);
    without other parts the junction reads ``something that ...``, else
    ``A and B that ...`` or ``A or B or something that ...``.
    """
    props = vocab.select(F.col("iri").alias("prop"), F.col("name").alias("p"))
    done = exprs.where("kind = 'class'").join(vocab, "iri", "left").select("expr_id", F.coalesce("name", F.concat(F.lit("<"), "iri", F.lit(">"))).alias("text"))
    done = materialize(done, "verbal")
    todo = exprs.where("kind <> 'class'").select("expr_id", "kind", "prop", "operands")
    parts = materialize(todo.select("expr_id", "kind", "prop", F.posexplode("operands").alias("i", "part")), "parts")
    kinds = exprs.select(F.col("expr_id").alias("part"), F.col("kind").alias("part_kind"), F.col("prop").alias("part_prop"))
    left = materialize(todo.select("expr_id"), "todo")
    word = F.when(F.col("kind") == "some", F.lit("some ")).otherwise(F.lit("only ")) if quantifiers else F.lit("")
    while not left.isEmpty():
        known = done.select(F.col("expr_id").alias("part"), F.col("text").alias("t"))
        joined = parts.join(left, "expr_id", "left_semi").join(known, "part", "left").join(kinds, "part")
        ready = joined.groupBy("expr_id").agg(F.count_if(F.col("t").isNull()).alias("missing")).where("missing = 0").select("expr_id")
        now = materialize(joined.join(ready, "expr_id", "left_semi"), "ready")
        if now.isEmpty():
            raise ValueError("expressions with missing or circular parts")
        single = now.where(F.col("kind").isin("some", "only")).join(props, "prop", "left")
        rel = verb_phrase(F.coalesce("p", "prop"))
        new = single.select("expr_id", F.concat(F.lit("something that "), rel, F.lit(" "), word, F.col("t")).alias("text"))
        new = new.union(now.where("kind = 'not'").select("expr_id", F.concat(F.lit("not "), "t")))
        each = now.where(F.col("kind").isin("and", "or"))
        inner = parts.select(F.col("expr_id").alias("part"), "prop", F.col("part").alias("filler"), F.col("kind").alias("q")).where(F.col("q").isin("some", "only"))
        filler = inner.join(known.select(F.col("part").alias("filler"), F.col("t").alias("f")), "filler").join(props, "prop", "left").select("part", F.coalesce("p", "prop").alias("r"), "f", "q")
        sorted_ = each.join(filler, "part", "left")
        restricted = sorted_.where("r is not null").groupBy("expr_id", "kind", "r", "q").agg(F.min("i").alias("i"), F.array_sort(F.collect_list(F.struct("i", "f"))).alias("fs"))
        quant = F.when(F.col("q") == "some", F.lit("some ")).otherwise(F.lit("only ")) if quantifiers else F.lit("")
        phrase = F.concat(verb_phrase(F.col("r")), F.lit(" "), quant, F.array_join(F.transform("fs", lambda x: x["f"]), "\u0001"))
        phrase = F.when(F.col("kind") == "and", F.replace(phrase, F.lit("\u0001"), F.lit(" and "))).otherwise(F.replace(phrase, F.lit("\u0001"), F.lit(" or ")))
        rs = restricted.select("expr_id", "kind", F.struct("i", phrase.alias("x")).alias("x")).groupBy("expr_id").agg(F.array_sort(F.collect_list("x")).alias("rs"))
        named = sorted_.where("r is null").groupBy("expr_id").agg(F.array_sort(F.collect_list(F.struct("i", F.col("t").alias("x")))).alias("ns"))
        whole = each.select("expr_id", "kind").distinct().join(named, "expr_id", "left").join(rs, "expr_id", "left")
        texts = lambda c: F.transform(c, lambda x: x["x"])
        ns_and, ns_or = F.array_join(texts("ns"), " and "), F.array_join(texts("ns"), " or ")
        rs_and, rs_or = F.array_join(texts("rs"), " and "), F.array_join(texts("rs"), " or ")
        is_and, bare, alone = F.col("kind") == "and", F.col("rs").isNull(), F.col("ns").isNull()
        text = F.when(is_and & bare, ns_and).when(bare, ns_or).when(is_and & alone, F.concat(F.lit("something that "), rs_and)).when(alone, F.concat(F.lit("something that "), rs_or))
        text = text.when(is_and, F.concat(ns_and, F.lit(" that "), rs_and)).otherwise(F.concat(ns_or, F.lit(" or something that "), rs_or))
        new = materialize(new.union(whole.select("expr_id", text)), "verbal")
        left = materialize(left.join(new, "expr_id", "left_anti"), "todo")
        done = materialize(done.union(new), "verbal")
    return done


def verbalise_axioms(axioms: DataFrame, texts: DataFrame) -> DataFrame:
    """``(axiom_id, axiom_type, left, right)``: both sides of two-sided axioms in words."""
    side = lambda c, n: texts.select(F.col("expr_id").alias(c), F.col("text").alias(n))
    return axioms.select("axiom_id", "axiom_type", "sub_expr", "sup_expr").join(side("sub_expr", "left"), "sub_expr").join(side("sup_expr", "right"), "sup_expr").select("axiom_id", "axiom_type", "left", "right")


def verbalise_equivalences(axioms: DataFrame, texts: DataFrame) -> DataFrame:
    """``(axiom_id, left, right)``: the first two operands of class equivalences in words."""
    side = lambda c, n: texts.select(F.col("expr_id").alias(c), F.col("text").alias(n))
    ends = axioms.where((F.col("axiom_type") == "EquivalentClasses") & (F.size("operands") > 1)).select("axiom_id", F.get("operands", F.lit(0)).alias("a"), F.get("operands", F.lit(1)).alias("b"))
    return ends.join(side("a", "left"), "a").join(side("b", "right"), "b").select("axiom_id", "left", "right")


def verbalise_class_assertions(assertions: DataFrame, texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(cls, individual, class_text, individual_text)`` for ``(individual, cls)``; a name that isn't known is the iri itself."""
    named = vocab.select(F.col("iri").alias("individual"), F.col("name").alias("i"))
    known = texts.select(F.col("expr_id").alias("cls"), F.col("text").alias("c"))
    both = assertions.select("individual", "cls").distinct().join(named, "individual", "left").join(known, "cls", "left")
    return both.select("cls", "individual", F.coalesce("c", F.col("cls").cast("string")).alias("class_text"), F.coalesce("i", "individual").alias("individual_text"))


def verbalise_property_assertions(facts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(subject, predicate, object, text)`` for facts of that shape: both ends' names around the property's phrase."""
    name = lambda c: vocab.select(F.col("iri").alias(c), F.col("name").alias(f"{c}_name"))
    out = facts.select("subject", "predicate", "object").distinct()
    for c in ("subject", "predicate", "object"):
        out = out.join(name(c), c, "left")
    s, p, o = (F.coalesce(f"{c}_name", c) for c in ("subject", "predicate", "object"))
    return out.select("subject", "predicate", "object", F.concat(s, F.lit(" "), verb_phrase(p), F.lit(" "), o).alias("text"))


def chain_text(names):
    """A property chain: ``r something that s``."""
    return F.array_join(F.transform(names, lambda n: verb_phrase(n)), " something that ")


def noun(text):
    return strip_preposition(text)
