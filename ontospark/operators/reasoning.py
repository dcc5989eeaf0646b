"""Reasoning as joins: told closure for hierarchies, and EL completion for expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontospark.operators.graph import closure, collapse_cycles, reduction
from ontospark.operators.ontology import NOTHING, THING, Ontology
from ontospark.runtime import materialize


def told_edges(onto: Ontology) -> DataFrame:
    """``(parent, child)`` between named classes: subsumptions, and equivalences in both directions."""
    same = onto.equivalences().select(F.explode("operands").alias("expr_id"), "axiom_id").join(onto.named(), "expr_id").select("axiom_id", "iri")
    both = same.alias("a").join(same.alias("b"), "axiom_id").select(F.col("a.iri").alias("parent"), F.col("b.iri").alias("child"))
    return onto.asserted_edges().union(both).where("parent <> child").distinct()


def inferred_supers(edges: DataFrame, direct: bool = False) -> DataFrame:
    """``(parent, child)``: all or only direct superclasses, without the top."""
    found = reduction(collapse_cycles(edges)) if direct else closure(edges).select(F.col("ancestor").alias("parent"), F.col("descendant").alias("child")).where("parent <> child")
    return found.where(~F.col("parent").isin(THING) & ~F.col("child").isin(NOTHING))


def subsumed(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """``(a, b, holds)``: whether a is below or equal to b."""
    known = closed.select(F.col("descendant").alias("a"), F.col("ancestor").alias("b"), F.lit(True).alias("k")).distinct()
    found = pairs.select("a", "b").join(known, ["a", "b"], "left")
    return found.select("a", "b", (F.col("k").isNotNull() | (F.col("a") == F.col("b"))).alias("holds"))


def common_descendants(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` with a strict descendant of one that is the other or below it."""
    down = closed.where("ancestor <> descendant").select("ancestor", "descendant")
    p = pairs.select("a", "b").distinct()
    below = p.join(down.select(F.col("ancestor").alias("a"), F.col("descendant").alias("x")), "a").join(down.select(F.col("ancestor").alias("b"), F.col("descendant").alias("x")), ["b", "x"]).select("a", "b")
    nested = p.join(down.select(F.col("ancestor").alias("a"), F.col("descendant").alias("b")), ["a", "b"], "left_semi")
    nested = nested.union(p.join(down.select(F.col("ancestor").alias("b"), F.col("descendant").alias("a")), ["a", "b"], "left_semi").select("a", "b"))
    return below.union(nested).distinct()


def instances(assertions: DataFrame, closed: DataFrame) -> DataFrame:
    """``(individual, cls)`` with all classes above the asserted ones; ``assertions`` has the asserted ones."""
    own = assertions.select("individual", "cls").distinct()
    up = own.join(closed.select(F.col("descendant").alias("cls"), "ancestor"), "cls").select("individual", F.col("ancestor").alias("cls"))
    return own.union(up).distinct()


def direct_instances(assertions: DataFrame, closed: DataFrame) -> DataFrame:
    """``(individual, cls)``: of an individual's asserted classes those with no other of them below."""
    own = assertions.select("individual", "cls").distinct()
    # From each class up to what it covers: a class has few ancestors, but may have all individuals as descendants.
    known = own.select(F.col("cls").alias("lower")).distinct()
    above = closed.where("ancestor <> descendant").select(F.col("descendant").alias("lower"), F.col("ancestor").alias("cls")).join(known, "lower", "left_semi")
    covered = own.select("individual", F.col("cls").alias("lower")).join(above, "lower")
    return own.join(covered.select("individual", "cls"), ["individual", "cls"], "left_anti")


def check_instances(pairs: DataFrame, typed: DataFrame) -> DataFrame:
    """``(individual, cls, holds)``: whether an individual is in a class; ``typed`` is what ``instances`` gives."""
    known = typed.select("individual", "cls").distinct().withColumn("k", F.lit(True))
    return pairs.select("individual", "cls").join(known, ["individual", "cls"], "left").select("individual", "cls", F.col("k").isNotNull().alias("holds"))


def common_instances(pairs: DataFrame, typed: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` that share an individual; ``typed`` is what ``instances`` gives."""
    p = pairs.select("a", "b").distinct()
    return p.join(typed.select(F.col("cls").alias("a"), "individual"), "a").join(typed.select(F.col("cls").alias("b"), "individual"), ["b", "individual"]).select("a", "b").distinct()


def disjoint_pairs(asserted: DataFrame, closed: DataFrame) -> DataFrame:
    """``(a, b)`` in both orders: classes below or equal to two asserted disjoint ones ``(a, b)``."""
    both = asserted.select("a", "b").union(asserted.select("b", "a")).distinct()
    own = closed.select(F.col("ancestor").alias("x"), F.col("descendant").alias("y"))
    ends = both.select(F.explode(F.array("a", "b")).alias("x")).distinct()
    own = own.union(ends.select("x", F.col("x").alias("y"))).distinct()
    left = both.withColumnRenamed("a", "x").join(own, "x").select(F.col("y").alias("a"), F.col("b").alias("x"))
    return left.join(own, "x").select("a", F.col("y").alias("b")).distinct()


def assumed_disjoint(pairs: DataFrame, closed: DataFrame, typed: DataFrame | None = None) -> DataFrame:
    """Pairs ``(a, b)`` that could be disjoint: neither subsumes the other, no common descendant, no common instance."""
    out = pairs.select("a", "b").distinct().where("a <> b").join(common_descendants(pairs, closed), ["a", "b"], "left_anti")
    return out.join(common_instances(pairs, typed), ["a", "b"], "left_anti") if typed is not None else out


def normalise(onto: Ontology) -> DataFrame:
    """EL normal forms ``(form, a, b, r, c)`` of the subsumptions and equivalences.

    ``sub``: a < c; ``and``: a & b < c; ``some_right``: a < some r.c; ``some_left``: some r.a < c.
    Every expression is its own fresh name, so a nested one costs one axiom per
    part; named ones stand for themselves. Intersections of many parts are
    chained. Expressions outside EL raise an error.
    """
    odd = onto.exprs.where(~F.col("kind").isin("class", "and", "some")).select("kind").distinct().collect()
    if odd:
        raise ValueError(f"outside EL: {sorted(r['kind'] for r in odd)}")
    names = onto.exprs.select("expr_id", F.coalesce("iri", "expr_id").alias("name"))
    name = lambda c: names.select(F.col("expr_id").alias(c), F.col("name").alias(f"{c}_name"))
    subs = onto.subsumptions().select("sub_expr", "sup_expr")
    parts = onto.equivalences().select("axiom_id", F.explode("operands").alias("e"))
    subs = subs.union(parts.alias("x").join(parts.alias("y"), "axiom_id").where("x.e <> y.e").select("x.e", "y.e"))
    none = F.lit(None).cast("string")
    top = subs.join(name("sub_expr"), "sub_expr").join(name("sup_expr"), "sup_expr").select(F.lit("sub").alias("form"), F.col("sub_expr_name").alias("a"), none.alias("b"), none.alias("r"), F.col("sup_expr_name").alias("c"))
    some = onto.exprs.where("kind = 'some'").select("expr_id", "prop", F.element_at("operands", 1).alias("filler")).join(name("filler"), "filler")
    out = top.union(some.select(F.lit("some_right"), "expr_id", none, "prop", "filler_name")).union(some.select(F.lit("some_left"), "filler_name", none, "prop", "expr_id"))
    each = onto.exprs.where("kind = 'and'").select("expr_id", F.size("operands").alias("n"), F.posexplode("operands").alias("i", "part")).join(name("part"), "part")
    out = out.union(each.select(F.lit("sub"), "expr_id", none, none, "part_name"))
    # The first i + 1 parts of an intersection have a name of their own, the last such name is the expression.
    step = lambda i: F.when(i == F.col("n") - 1, F.col("expr_id")).otherwise(F.concat("expr_id", F.lit("/"), i.cast("string")))
    first = each.where("i = 0").select("expr_id", F.col("part_name").alias("first"))
    chained = each.where("i > 0").join(first, "expr_id").select(F.lit("and"), F.when(F.col("i") == 1, F.col("first")).otherwise(step(F.col("i") - 1)), "part_name", none, step(F.col("i")))
    return out.union(chained).distinct().where("form <> 'sub' or a <> c")


def saturate(forms: DataFrame, sub_roles: DataFrame | None = None, chains: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The completion ``S(x, a)`` (x is below a) and ``R(r, x, y)`` of EL normal forms.

    ``sub_roles`` has ``(r, s)`` for r below s, ``chains`` ``(r, s, t)`` for r then s
    below t. Rules are joins, applied to all that is known until nothing is new.
    """
    spark = forms.sparkSession
    forms = materialize(forms, "forms")
    names = forms.select(F.explode(F.array("a", "b", "c")).alias("x")).where("x is not null").distinct()
    s = materialize(names.select("x", F.col("x").alias("a")).union(names.select("x", F.lit(THING).alias("a"))).distinct(), "s")
    r = materialize(spark.createDataFrame([], "r string, x string, y string"), "r")
    f = {k: forms.where(F.col("form") == k) for k in ("sub", "and", "some_right", "some_left")}
    while True:
        new = s.join(f["sub"].select("a", "c"), "a").select("x", F.col("c").alias("a"))
        both = s.select("x", "a").join(f["and"].select("a", "b", "c"), "a").join(s.select("x", F.col("a").alias("b")), ["x", "b"]).select("x", F.col("c").alias("a"))
        links = s.join(f["some_right"].select("a", "r", "c"), "a").select("r", "x", F.col("c").alias("y"))
        back = r.join(s.select(F.col("x").alias("y"), "a"), "y")
        left = back.join(f["some_left"].select("a", "r", "c"), ["a", "r"]).select("x", F.col("c").alias("a"))
        bottom = back.where(F.col("a") == NOTHING).select("x", "a")
        if sub_roles is not None:
            links = links.union(r.join(sub_roles, "r").select(F.col("s").alias("r"), "x", "y"))
        if chains is not None:
            second = r.select(F.col("r").alias("s"), F.col("x").alias("y"), F.col("y").alias("z"))
            links = links.union(r.join(chains, "r").join(second, ["s", "y"]).select(F.col("t").alias("r"), "x", F.col("z").alias("y")))
        more_s = materialize(new.union(both).union(left).union(bottom).distinct().join(s, ["x", "a"], "left_anti"), "s")
        more_r = materialize(links.distinct().join(r, ["r", "x", "y"], "left_anti"), "r")
        if more_s.isEmpty() and more_r.isEmpty():
            return s, r
        s, r = materialize(s.union(more_s.select("x", "a")), "s"), materialize(r.union(more_r.select("r", "x", "y")), "r")


def unsatisfiable(s: DataFrame) -> DataFrame:
    return s.where((F.col("a") == NOTHING) & (F.col("x") != NOTHING)).select("x").distinct()


def is_consistent(s: DataFrame, typed: DataFrame) -> bool:
    """Whether no individual of ``typed(individual, cls)`` is of an unsatisfiable class."""
    return typed.join(unsatisfiable(s).select(F.col("x").alias("cls")), "cls", "left_semi").isEmpty()


def hypothetical_disjoint(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` both of which stay satisfiable if they are made disjoint.

    For a told or EL hierarchy a class becomes unsatisfiable exactly if it is,
    or must have a successor that is, below both; one completion answers all pairs.
    """
    s, r = saturate(forms)
    p = pairs.select("a", "b").distinct()
    hit = p.join(s.select("x", "a"), "a").join(s.select("x", F.col("a").alias("b")), ["x", "b"]).select("a", "b", "x")
    dead = materialize(hit.distinct(), "dead")
    new = dead
    while not new.isEmpty():
        up = new.withColumnRenamed("x", "y").join(r.select("x", "y"), "y").select("a", "b", "x")
        down = up.union(new.withColumnRenamed("x", "z").join(s.select("x", F.col("a").alias("z")), "z").select("a", "b", "x"))
        new = materialize(down.distinct().join(dead, ["a", "b", "x"], "left_anti"), "dead")
        dead = materialize(dead.union(new), "dead")
    lost = dead.where("x = a or x = b").select("a", "b").distinct()
    return p.join(lost, ["a", "b"], "left_anti")
