"""Subsumptions for training and testing: extraction, contexts, positive and negative pairs, whole corpora.

Draws are hashes of a draw's number and a seed. To draw within a group no group
is collected: rows are numbered in the order of their group, so a group is a
run of numbers, and a draw is a lookup by number.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontospark.operators.corpora import balanced, corpus, draw_order, negative_classes, numbered, synonym_groups, synonym_pairs
from ontospark.operators.graph import edge_table, sibling_groups
from ontospark.operators.ontology import Ontology
from ontospark.operators.reasoning import assumed_disjoint, normalise, saturate
from ontospark.runtime import materialize


def basic_restrictions(onto: Ontology) -> DataFrame:
    """``(expr_id, prop, filler)``: complex classes ``some r.C`` with a named role and a named class."""
    some = onto.exprs.where("kind = 'some' and prop is not null and not startswith(prop, 'inverse ')").select("expr_id", "prop", F.element_at("operands", 1).alias("f"))
    some = some.join(onto.named().select(F.col("expr_id").alias("f"), F.col("iri").alias("filler")), "f").select("expr_id", "prop", "filler")
    return some.join(onto.complex_classes(), "expr_id", "left_semi").distinct()


def declared_pairs(onto: Ontology, restrictions: bool = False) -> DataFrame:
    """``(sub, sup)``: subsumptions of classes in use, by iri; with ``restrictions`` those whose super is a basic restriction, by its id."""
    used = materialize(onto.named().join(onto.deprecated(), "iri", "left_anti"), "used")
    pairs = onto.subsumptions().select("sub_expr", "sup_expr").join(used.select(F.col("expr_id").alias("sub_expr"), F.col("iri").alias("sub")), "sub_expr")
    above = basic_restrictions(onto).select(F.col("expr_id").alias("sup_expr"), F.col("expr_id").alias("sup")) if restrictions else used.select(F.col("expr_id").alias("sup_expr"), F.col("iri").alias("sup"))
    return pairs.join(above, "sup_expr").select("sub", "sup").distinct()


def traversal(starts: DataFrame, edges: DataFrame, hops: int = 1, up: bool = False, most: int = 5) -> DataFrame:
    """``(start, place, hop, sub, sup)``: edges met going down (or up) from each start ``id``, nearer and then smaller first.

    A start goes no further once it has ``most`` edges, and keeps as many.
    """
    edges = materialize(edge_table(edges), "edges")
    here, there = ("child", "parent") if up else ("parent", "child")
    front = starts.select(F.col("id").alias("start"), "id").distinct()
    found = None
    for hop in range(1, hops + 1):
        met = front.join(edges, F.col("id") == F.col(here)).select("start", F.lit(hop).alias("hop"), F.col("child").alias("sub"), F.col("parent").alias("sup")).distinct()
        if found is not None:
            met = met.join(found.select("start", "sub", "sup"), ["start", "sub", "sup"], "left_anti").select("start", "hop", "sub", "sup")
        met = materialize(met, "met")
        found = met if found is None else found.unionByName(met)
        full = found.groupBy("start").agg(F.count("*").alias("n")).where(F.col("n") >= most).select("start")
        front = met.join(full, "start", "left_anti").select("start", F.col("sup" if up else "sub").alias("id")).distinct()
    order = Window.partitionBy("start").orderBy("hop", "sub", "sup")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("start", "place", "hop", "sub", "sup")


def traversal_strings(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """``(start, context)`` of what ``traversal`` gives: ``sub <SUB> sup`` joined by ``<SEP>``; nodes without a name stand as they are."""
    name = lambda c: names.groupBy(F.col("iri").alias(c)).agg(F.min("name").alias(f"{c}_name"))
    named = pairs.join(name("sub"), "sub", "left").join(name("sup"), "sup", "left")
    text = F.concat(F.coalesce("sub_name", "sub"), F.lit(" <SUB> "), F.coalesce("sup_name", "sup"))
    listed = named.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("place", text.alias("text")))).alias("l"))
    return listed.select("start", F.array_join(F.transform("l", lambda x: x["text"]), " <SEP> ").alias("context"))


def label_samples(pairs: DataFrame, sub_names: DataFrame, sup_names: DataFrame, label: int) -> DataFrame:
    """``(text_a, text_b, label)``: every literal of ``sub`` with every literal of ``sup``, an empty one where there is none."""
    side = lambda df, c, out: df.select(F.col("iri").alias(c), F.col("literal").alias(out))
    out = pairs.select("sub", "sup").join(side(sub_names, "sub", "text_a"), "sub", "left").join(side(sup_names, "sup", "text_b"), "sup", "left")
    return out.select(F.coalesce("text_a", F.lit("")).alias("text_a"), F.coalesce("text_b", F.lit("")).alias("text_b"), F.lit(label).alias("label"))


def training_samples(positives: DataFrame, negatives: DataFrame, pos_dup: int = 1, neg_dup: int = 1) -> DataFrame:
    """Samples repeated so often, the rarer label filled up to the other's number, then those with an empty text left out."""
    times = lambda df, n: df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    whole = materialize(times(positives, pos_dup).unionByName(times(negatives, neg_dup)), "samples")
    return balanced(whole, ["text_a", "text_b", "_copy"]).where("text_a <> '' and text_b <> ''").drop("_copy")


def inter_ontology_samples(pairs: DataFrame, target_classes: DataFrame, target_closed: DataFrame, sub_names: DataFrame, sup_names: DataFrame, pos_dup: int = 1, neg_dup: int = 1, seed: int = 0) -> DataFrame:
    """Training samples of subsumptions ``(sub, sup)`` from one ontology into another.

    For each pair ``neg_dup`` classes of the target that are neither ``sup`` nor
    above it make the negatives, each pair with draws of its own.
    """
    drawn = negative_classes(pairs.select(F.col("sup").alias("sub"), F.col("sub").alias("sup")), target_classes, target_closed, neg_dup, seed)
    negatives = drawn.select(F.col("sup").alias("sub"), F.col("negative").alias("sup"))
    return training_samples(label_samples(pairs, sub_names, sup_names, 1), label_samples(negatives, sub_names, sup_names, 0), pos_dup)


def _runs(df: DataFrame, group: str, item: str) -> tuple[DataFrame, int]:
    """``(k, group, item, start, size)``, numbered by group and then item, with the run of numbers that the group has; and their number."""
    rows = materialize(numbered(df.select(F.col(group).alias("group"), F.col(item).alias("item")).distinct(), ["group", "item"]), "rows")
    runs = rows.groupBy("group").agg(F.min("k").alias("start"), F.count("*").alias("size"))
    out = materialize(rows.join(runs, "group"), "runs")
    return out, out.count()


def _draw(size: Column | int, salt: str, seed: int) -> Column:
    return F.pmod(F.xxhash64("draw", F.lit(salt), F.lit(seed)), F.lit(size) if isinstance(size, int) else size)


def sibling_draws(edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``(draw, a, b)``: ``n`` draws of two siblings each; a group is drawn as often as it is large. No siblings: no rows."""
    spark = edges.sparkSession
    rows, total = _runs(sibling_groups(edges), "parent", "child")
    draws = spark.range(n if total else 0).withColumnRenamed("id", "draw").withColumn("k", _draw(max(total, 1), "first", seed) + 1)
    one = draws.join(rows, "k").withColumn("k2", F.col("start") + F.pmod(F.col("k") - F.col("start") + 1 + _draw(F.col("size") - 1, "second", seed), F.col("size")))
    other = rows.select(F.col("k").alias("k2"), F.col("item").alias("b"))
    return one.join(other, "k2").select("draw", F.col("item").alias("a"), "b")


def class_draws(classes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``(draw, a, b)``: ``n`` draws of two different classes ``iri`` each. Fewer than two classes: no rows."""
    rows = materialize(numbered(classes.select("iri").distinct(), ["iri"]), "classes")
    total = rows.count()
    draws = classes.sparkSession.range(n if total > 1 else 0).withColumnRenamed("id", "draw").withColumn("k", _draw(max(total, 1), "first", seed))
    draws = draws.withColumn("k2", F.pmod(F.col("k") + 1 + _draw(max(total - 1, 1), "second", seed), F.lit(max(total, 1))))
    pick = lambda k, out: rows.select((F.col("k") - 1).alias(k), F.col("iri").alias(out))
    return draws.join(pick("k", "a"), "k").join(pick("k2", "b"), "k2").select("draw", "a", "b")


def atomic_negatives(edges: DataFrame, closed: DataFrame, n: int, hard: bool = False, typed: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """``(a, b)``: at most ``n`` pairs of classes that could be disjoint, from twice as many draws; ``hard``: of siblings."""
    classes = edge_table(edges).select(F.explode(F.array("parent", "child")).alias("iri"))
    drawn = materialize(sibling_draws(edges, 2 * n, seed) if hard else class_draws(classes, 2 * n, seed), "drawn")
    fit = drawn.join(assumed_disjoint(drawn, closed, typed), ["a", "b"], "left_semi")
    return fit.groupBy("a", "b").agg(F.min("draw").alias("draw")).orderBy("draw", "a", "b").limit(n).select("a", "b")


def anchors(onto: Ontology) -> DataFrame:
    """``(axiom_id, iri, expr_id)``: equivalences of one named and one complex class."""
    two = onto.equivalences().where("size(operands) = 2").select("axiom_id", F.explode("operands").alias("expr_id")).join(onto.exprs.select("expr_id", "iri"), "expr_id")
    sides = two.groupBy("axiom_id").agg(F.max("iri").alias("iri"), F.max(F.when(F.col("iri").isNull(), F.col("expr_id"))).alias("expr_id"))
    return sides.where("iri is not null and expr_id is not null")


def complex_positives(onto: Ontology, closed: DataFrame, per_anchor: int | None = 10, seed: int = 0) -> DataFrame:
    """``(axiom_id, sub, sup)``: each anchor both ways, its expression below the class's ancestors and above its descendants.

    Of each anchor ``per_anchor`` pairs are drawn; None keeps all.
    """
    a = materialize(anchors(onto), "anchors")
    strict = closed.where("ancestor <> descendant")
    both = a.select("axiom_id", F.col("iri").alias("sub"), F.col("expr_id").alias("sup")).union(a.select("axiom_id", "expr_id", "iri"))
    over = a.join(strict, a.iri == strict.descendant).select("axiom_id", "expr_id", "ancestor")
    under = a.join(strict, a.iri == strict.ancestor).select("axiom_id", "descendant", "expr_id")
    out = both.union(over).union(under).distinct()
    if per_anchor is None:
        return out
    order = Window.partitionBy("axiom_id").orderBy(draw_order("sub", "sup", seed=seed), "sub", "sup")
    return out.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_anchor).drop("_k")


def complex_negatives(onto: Ontology, per_anchor: int = 10, seed: int = 0) -> DataFrame:
    """``(axiom_id, sub, sup, replaced, by)``: anchors with one name in the expression replaced, where both sides could be disjoint.

    An anchor is tried ``per_anchor`` + 2 times. A try replaces the role or a
    named operand of the expression itself (not of nested ones) by another
    entity of its kind. One EL completion over all tries tells which pairs
    neither subsume each other nor share a named class below them; expressions
    outside EL raise an error. ``sub`` is the named class, ``sup`` the original
    expression, in which ``by`` stands for ``replaced``.
    """
    kinds = materialize(onto.entities.where(F.col("entity_type").isin("Classes", "ObjectProperties")).select("entity_type", "iri").distinct(), "kinds")
    ring, _ = _runs(kinds, "entity_type", "iri")
    named = onto.named().select(F.col("expr_id").alias("part"), F.col("iri").alias("replaced"))
    bodies = anchors(onto).join(onto.exprs.select("expr_id", "kind", "prop", "operands"), "expr_id")
    slots = bodies.select("axiom_id", F.posexplode("operands").alias("at", "part")).join(named, "part").select("axiom_id", "at", "replaced")
    slots = slots.union(bodies.where("prop is not null").select("axiom_id", F.lit(-1), "prop"))
    slots = slots.join(ring.select(F.col("item").alias("replaced"), "k", "start", "size"), "replaced").where("size > 1")
    order = Window.partitionBy("axiom_id").orderBy("at")
    slots = materialize(slots.withColumn("slot", F.row_number().over(order) - 1).withColumn("slots", F.count("*").over(Window.partitionBy("axiom_id"))), "slots")
    tries = slots.select("axiom_id", "slots").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(per_anchor + 2))))
    tries = tries.withColumn("slot", F.pmod(F.xxhash64("axiom_id", "draw", F.lit(seed)), F.col("slots")).cast("int")).drop("slots").join(slots.drop("slots"), ["axiom_id", "slot"])
    tries = tries.withColumn("k2", F.col("start") + F.pmod(F.col("k") - F.col("start") + 1 + F.pmod(F.xxhash64("axiom_id", "draw", F.lit(seed + 1)), F.col("size") - 1), F.col("size")))
    tries = tries.join(ring.select(F.col("k").alias("k2"), F.col("item").alias("by")), "k2").join(bodies, "axiom_id")
    tries = tries.withColumn("new_id", F.concat_ws(" ", F.lit("changed"), "axiom_id", "at", "by")).dropDuplicates(["new_id"])
    ids = onto.named().groupBy(F.col("iri").alias("by")).agg(F.min("expr_id").alias("by_id"))
    tries = materialize(tries.join(ids, "by", "left").withColumn("by_id", F.coalesce("by_id", "by")), "tries")
    new = tries.select(F.col("new_id").alias("expr_id"), "kind", F.lit(None).cast("string").alias("iri"), F.when(F.col("at") == -1, F.col("by")).otherwise(F.col("prop")).alias("prop"), F.transform("operands", lambda x, i: F.when(i == F.col("at"), F.col("by_id")).otherwise(x)).alias("operands"))
    fresh = tries.where("at >= 0").select(F.col("by_id").alias("expr_id"), F.lit("class"), F.col("by"), F.lit(None).cast("string"), F.lit(None).cast("array<string>")).distinct().join(onto.exprs.select("expr_id"), "expr_id", "left_anti")
    columns = ["expr_id", "kind", "iri", "prop", "operands"]
    wider = replace(onto, exprs=onto.exprs.select(*columns).union(fresh).union(new.select(*columns)))
    s, _ = saturate(normalise(wider))
    pairs = tries.select("iri", "new_id")
    classes = onto.of_kind("Classes").select(F.col("iri").alias("x"))
    below = s.join(classes, "x", "left_semi")
    shared = pairs.join(below.select("x", F.col("a").alias("iri")), "iri").join(below.select("x", F.col("a").alias("new_id")), ["x", "new_id"]).select("iri", "new_id")
    nested = pairs.join(s.select(F.col("x").alias("new_id"), F.col("a").alias("iri")), ["iri", "new_id"], "left_semi")
    fit = tries.join(shared.union(nested).distinct(), ["iri", "new_id"], "left_anti")
    first = Window.partitionBy("axiom_id").orderBy("draw", "new_id")
    kept = fit.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= per_anchor)
    return kept.select("axiom_id", F.col("iri").alias("sub"), F.col("expr_id").alias("sup"), "replaced", "by")


def _literal_of(rows: DataFrame, draws: DataFrame, group: str, salt: str, out: str, seed: int) -> DataFrame:
    """``draws`` with a drawn literal of the group that column ``group`` names; groups without one go."""
    runs = rows.select(F.col("group").alias(group), "start", "size").distinct()
    k = draws.join(runs, group).withColumn("_k", F.col("start") + _draw(F.col("size"), salt, seed)).drop("start", "size")
    return k.join(rows.select(F.col("k").alias("_k"), F.col("item").alias(out)), "_k").drop("_k")


def _nonsynonyms(rows: DataFrame, make, n: int, seed: int, tries: int) -> DataFrame:
    """At most ``n`` distinct pairs of different literals from draws of two groups, drawn again while some lack."""
    found, have = None, 0
    for k in range(tries):
        drawn = make(n - have, seed + k).withColumnRenamed("a", "g").withColumnRenamed("b", "h")
        drawn = _literal_of(rows, _literal_of(rows, drawn, "g", "left", "a", seed + k), "h", "right", "b", seed + k).where("a <> b").select("a", "b")
        found = materialize(drawn.distinct() if found is None else found.union(drawn).distinct(), "pairs")
        have = found.count()
        if have >= n:
            break
    return found


def intra_corpus(literals: DataFrame, edges: DataFrame, soft: int = 2, hard: int = 2, seed: int = 0, tries: int = 5) -> DataFrame:
    """``(text_a, text_b, label)``: all synonym pairs of an ontology, ``hard`` times as many of siblings that aren't, and random ones up to ``soft`` + ``hard`` times.

    What the siblings don't yield after ``tries`` rounds is drawn at random.
    """
    groups = materialize(synonym_groups(literals), "groups")
    positives = materialize(synonym_pairs(groups), "synonyms")
    many = positives.count()
    rows, _ = _runs(groups, "group_id", "literal")
    parts = []
    if many and hard:
        parts.append(_nonsynonyms(rows, lambda n, s: sibling_draws(edges, n, s), hard * many, seed, tries))
    got = parts[0].count() if parts else 0
    lack = (soft + hard) * many - got
    if many and lack > 0:
        parts.append(_nonsynonyms(rows, lambda n, s: class_draws(groups.select(F.col("group_id").alias("iri")), n, s), lack, seed + tries, tries))
    none = positives.limit(0)
    return corpus([positives], [reduce(DataFrame.union, parts, none)])
