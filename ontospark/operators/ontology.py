"""Ontologies as tables, and the lookups and changes on them.

``entities(iri, entity_type)``, ``axioms(axiom_id, axiom_type, entity_type,
sub_expr, sup_expr, operands)``, ``exprs(expr_id, kind, iri, prop, operands)``,
``annotations(iri, property_iri, literal, lang)`` and ``assertions(subject,
predicate, object)``. Expressions are rows that name their operands, so nested
ones need no recursive type. A table never changes: a mutation gives a new one.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontospark.runtime import materialize

THING, NOTHING = "http://www.w3.org/2002/07/owl#Thing", "http://www.w3.org/2002/07/owl#Nothing"
TYPE = "http://type"
LABEL, DEPRECATED = "http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/2002/07/owl#deprecated"
#: The top and bottom entity of each kind.
TOPS = {"Classes": THING, "ObjectProperties": "http://www.w3.org/2002/07/owl#topObjectProperty", "DataProperties": "http://www.w3.org/2002/07/owl#topDataProperty"}
BOTTOMS = {"Classes": NOTHING, "ObjectProperties": "http://www.w3.org/2002/07/owl#bottomObjectProperty", "DataProperties": "http://www.w3.org/2002/07/owl#bottomDataProperty"}
#: Entity kinds in the order in which a lookup prefers them, with their names for one entity.
KINDS = {"Classes": "Class", "ObjectProperties": "ObjectProperty", "DataProperties": "DataProperty", "AnnotationProperties": "AnnotationProperty", "Individuals": "NamedIndividual"}
SUBSUMPTION = {"Classes": "SubClassOf", "ObjectProperties": "SubObjectPropertyOf", "DataProperties": "SubDataPropertyOf", "AnnotationProperties": "SubAnnotationPropertyOf"}
EQUIVALENCE = {"Classes": "EquivalentClasses", "ObjectProperties": "EquivalentObjectProperties", "DataProperties": "EquivalentDataProperties"}
ASSERTION = {"Classes": "ClassAssertion", "ObjectProperties": "ObjectPropertyAssertion", "DataProperties": "DataPropertyAssertion", "AnnotationProperties": "AnnotationAssertion"}
#: Parts of axiom texts outside the EL profile, by which a TBox is cut down before it is normalised.
NOT_EL = ["UnionOf", "MinCardinality", "MaxCardinality", "ExactCardinality", "ComplementOf", "AllValuesFrom", "Annotation", "ObjectHasSelf", "urn:swrl", "EquivalentObjectProperties", "SymmetricObjectProperty", "AsymmetricObjectProperty", "ObjectOneOf"]


def entity_summary(entities: DataFrame) -> DataFrame:
    """``(entity_type, n)``: how many entities there are of each kind, those of no row included."""
    kinds = entities.sparkSession.createDataFrame([(k,) for k in KINDS], "entity_type string")
    found = entities.select("iri", "entity_type").distinct().groupBy("entity_type").agg(F.count("*").alias("n"))
    return kinds.join(found, "entity_type", "left").select("entity_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@dataclass(frozen=True)
class Ontology:
    entities: DataFrame
    axioms: DataFrame
    exprs: DataFrame
    annotations: DataFrame
    assertions: DataFrame

    def of_kind(self, kind: str) -> DataFrame:
        if kind not in KINDS:
            raise ValueError(f"no such kind of entity: {kind}")
        return self.entities.where(F.col("entity_type") == kind).select("iri")

    def lookup(self, iris: DataFrame) -> DataFrame:
        """``(iri, entity_type, singular)``: each iri's first kind in the order of ``KINDS``."""
        order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("entity_type"))
        one = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
        best = self.entities.join(iris.select("iri").distinct(), "iri", "left_semi").groupBy("iri").agg(F.min_by("entity_type", order).alias("entity_type"))
        return best.withColumn("singular", F.element_at(one, F.col("entity_type")))

    def _axioms(self, names: dict[str, str], kind: str) -> DataFrame:
        if kind not in names:
            raise ValueError(f"no such axioms for {kind}")
        return self.axioms.where(F.col("axiom_type") == names[kind])

    def subsumptions(self, kind: str = "Classes") -> DataFrame:
        return self._axioms(SUBSUMPTION, kind)

    def equivalences(self, kind: str = "Classes") -> DataFrame:
        return self._axioms(EQUIVALENCE, kind)

    def assertion_axioms(self, kind: str = "Classes") -> DataFrame:
        """``(axiom_type, subject, predicate, object)``: assertions of classes, of properties of a kind, or annotations."""
        if kind not in ASSERTION:
            raise ValueError(f"no such axioms for {kind}")
        if kind == "AnnotationProperties":
            rows = self.annotations.select(F.col("iri").alias("subject"), F.col("property_iri").alias("predicate"), F.col("literal").alias("object"))
        elif kind == "Classes":
            rows = self.assertions.where(F.col("predicate") == TYPE)
        else:
            data = self.of_kind("DataProperties").select(F.col("iri").alias("predicate")).distinct()
            rows = self.assertions.where(F.col("predicate") != TYPE).join(data, "predicate", "left_semi" if kind == "DataProperties" else "left_anti")
        return rows.select(F.lit(ASSERTION[kind]).alias("axiom_type"), "subject", "predicate", "object").distinct()

    def named(self) -> DataFrame:
        """``(expr_id, iri)`` of the expressions that are entities."""
        return self.exprs.where("iri is not null").select("expr_id", "iri")

    def complex_classes(self, inclusions_only: bool = False) -> DataFrame:
        """Distinct expressions without an iri that stand on a side of a subsumption or in an equivalence."""
        subs = self.subsumptions()
        sides = subs.select(F.explode(F.array("sub_expr", "sup_expr")).alias("expr_id"))
        if not inclusions_only:
            sides = sides.union(self.equivalences().select(F.explode("operands")))
        return sides.distinct().join(self.named(), "expr_id", "left_anti")

    def asserted_edges(self, named_only: bool = True) -> DataFrame:
        """``(parent, child)`` of the subsumptions between classes; with ``named_only`` False parents may be expressions."""
        pairs = self.subsumptions().select("sub_expr", "sup_expr")
        named = self.named()
        child = pairs.join(named.select(F.col("expr_id").alias("sub_expr"), F.col("iri").alias("child")), "sub_expr")
        parent = child.join(named.select(F.col("expr_id").alias("sup_expr"), F.col("iri").alias("parent")), "sup_expr", "inner" if named_only else "left")
        return parent.select(F.coalesce("parent", "sup_expr").alias("parent"), "child").distinct()

    def deprecated(self) -> DataFrame:
        """Iris whose first ``owl:deprecated`` literal says so."""
        flag = self.annotations.where(F.col("property_iri") == DEPRECATED).groupBy("iri").agg(F.min("literal").alias("v"))
        return flag.where(F.col("v").isin("true", "True")).select("iri")

    def not_for_alignment(self, property_iri: str) -> DataFrame:
        flag = self.annotations.where(F.col("property_iri") == property_iri).groupBy("iri").agg(F.min(F.lower("literal")).alias("v"))
        return flag.where("v = 'false'").select("iri")

    def named_classes(self) -> DataFrame:
        ends = [*TOPS.values(), *BOTTOMS.values()]
        return self.of_kind("Classes").where(~F.col("iri").isin(ends)).join(self.deprecated(), "iri", "left_anti")

    def el_axioms(self) -> DataFrame:
        """Axioms whose text stays within EL; ``text`` is a column of ``axioms``."""
        return self.axioms.where(~F.col("text").rlike("|".join(NOT_EL)))

    def add_axioms(self, more: DataFrame) -> Ontology:
        return replace(self, axioms=self.axioms.unionByName(more, allowMissingColumns=True))

    def remove_axioms(self, ids: DataFrame) -> Ontology:
        return replace(self, axioms=self.axioms.join(ids.select("axiom_id"), "axiom_id", "left_anti"))

    def replace_entity(self, iri: str, by: str) -> Ontology:
        """Every use of ``iri`` becomes ``by``: as an entity, in expressions and their ids, in axioms, their ids and texts, and in annotations and assertions.

        An ontology is a value, so the one before remains: keeping it is the undo of this and of every other change.
        """

        def swapped(df: DataFrame) -> DataFrame:
            def new(field) -> Column:
                kind, c = field.dataType.simpleString(), F.col(field.name)
                if kind == "string":
                    within = F.replace(c, F.lit(f"<{iri}>"), F.lit(f"<{by}>"))
                    return F.when(c == iri, F.lit(by)).otherwise(within).alias(field.name)
                if kind == "array<string>":
                    return F.transform(c, lambda x: F.when(x == iri, F.lit(by)).otherwise(F.replace(x, F.lit(f"<{iri}>"), F.lit(f"<{by}>")))).alias(field.name)
                return c

            return df.select(*map(new, df.schema.fields))

        return replace(self, **{f.name: swapped(getattr(self, f.name)) for f in fields(self)})

    def prune(self, removed: DataFrame) -> Ontology:
        """Without the classes ``iri``: their children get their parents, and axioms that mention them go."""
        from ontospark.operators.graph import prune

        gone = materialize(removed.select("iri").distinct(), "removed")
        edges = self.asserted_edges(named_only=False)
        kept = prune(edges, gone.select(F.col("iri").alias("id")))
        dead = self.mentions(gone)
        named = self.named().groupBy("iri").agg(F.min("expr_id").alias("expr_id"))
        side = lambda c: named.select(F.col("iri").alias(c), F.col("expr_id").alias(f"{c}_id"))
        new = kept.join(side("child"), "child").join(side("parent"), "parent", "left")
        new = new.select(F.col("child_id").alias("sub_expr"), F.coalesce("parent_id", "parent").alias("sup_expr")).join(dead.select(F.col("expr_id").alias("sup_expr")), "sup_expr", "left_anti")
        old = self.subsumptions().select("sub_expr", "sup_expr")
        added = new.join(old, ["sub_expr", "sup_expr"], "left_anti").select(F.concat(F.lit("pruned:"), "sub_expr", F.lit("|"), "sup_expr").alias("axiom_id"), F.lit("SubClassOf").alias("axiom_type"), F.lit("Classes").alias("entity_type"), "sub_expr", "sup_expr")
        bad = self.axioms.select("axiom_id", F.explode(F.flatten(F.array(F.array("sub_expr", "sup_expr"), F.coalesce("operands", F.array().cast("array<string>"))))).alias("expr_id")).join(dead, "expr_id", "left_semi").select("axiom_id").distinct()
        axioms = self.axioms.withColumn("axiom_id", F.col("axiom_id").cast("string")).join(bad.select(F.col("axiom_id").cast("string").alias("axiom_id")), "axiom_id", "left_anti")
        return replace(self, entities=self.entities.join(gone, "iri", "left_anti"), axioms=axioms.unionByName(added, allowMissingColumns=True))

    def mentions(self, iris: DataFrame) -> DataFrame:
        """``expr_id`` of expressions that hold one of ``iris`` at any depth."""
        use = self.exprs.select("expr_id", F.explode(F.coalesce("operands", F.array().cast("array<string>"))).alias("part"))
        found = materialize(self.exprs.join(iris.select("iri"), "iri", "left_semi").select("expr_id"), "mentions")
        new = found
        while not new.isEmpty():
            up = use.join(new.select(F.col("expr_id").alias("part")), "part", "left_semi").select("expr_id").distinct()
            new = materialize(up.join(found, "expr_id", "left_anti"), "mentions")
            found = found.union(new)
        return found
