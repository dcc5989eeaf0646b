"""Matching concepts of two ontologies: string and edit matches, extension, subsumptions, repair."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontospark.functions.text import edit_similarity
from ontospark.operators.annotations import top_per_source
from ontospark.operators.graph import edge_table
from ontospark.runtime import connected_components, materialize

PAIR = ["source", "target"]


def at_least(mappings: DataFrame, threshold: float | None, column: str = "score") -> DataFrame:
    return mappings.where(F.col(column) >= threshold) if threshold else mappings


def string_match(source: DataFrame, target: DataFrame) -> DataFrame:
    """``(source, target, score)``: pairs that share a literal, with score 1."""
    s = source.select(F.col("iri").alias("source"), "literal")
    t = target.select(F.col("iri").alias("target"), "literal")
    return s.join(t, "literal").select("source", "target").distinct().withColumn("score", F.lit(1.0))


def edit_scores(pairs: DataFrame, source: DataFrame, target: DataFrame, digits: int = 6) -> DataFrame:
    """``(source, target, score)`` of candidate pairs: the largest edit similarity of their literals, 0 without any."""
    s = source.select(F.col("iri").alias("source"), F.col("literal").alias("a"))
    t = target.select(F.col("iri").alias("target"), F.col("literal").alias("b"))
    scored = pairs.select(*PAIR).distinct().join(s, "source", "left").join(t, "target", "left")
    best = scored.groupBy(*PAIR).agg(F.max(edit_similarity(F.col("a"), F.col("b"))).alias("best"))
    return best.select(*PAIR, F.round(F.coalesce("best", F.lit(0.0)), digits).alias("score"))


def mean_scores(pairs: DataFrame, source: DataFrame, target: DataFrame, scorer=edit_similarity, digits: int = 6) -> DataFrame:
    """``(source, target, score)`` of candidate pairs: the mean of ``scorer`` over all pairs of their literals, 0 without any.

    ``scorer(a, b)`` is a column: a built-in similarity, or a pandas UDF around a model of synonyms.
    """
    s = source.select(F.col("iri").alias("source"), F.col("literal").alias("a"))
    t = target.select(F.col("iri").alias("target"), F.col("literal").alias("b"))
    scored = pairs.select(*PAIR).distinct().join(s, "source", "left").join(t, "target", "left")
    mean = scored.groupBy(*PAIR).agg(F.avg(scorer(F.col("a"), F.col("b"))).alias("mean"))
    return mean.select(*PAIR, F.round(F.coalesce("mean", F.lit(0.0)), digits).alias("score"))


def model_scores(pairs: DataFrame, source: DataFrame, target: DataFrame, scorer, digits: int = 6) -> DataFrame:
    """``(source, target, score)``: 1 for pairs that share a literal, the mean synonym score of the others."""
    exact = string_match(source, target).join(pairs.select(*PAIR).distinct(), PAIR, "left_semi")
    rest = pairs.select(*PAIR).distinct().join(exact.select(*PAIR), PAIR, "left_anti")
    return exact.unionByName(mean_scores(rest, source, target, scorer, digits))


def drop_ignored(mappings: DataFrame, ignored_source: DataFrame, ignored_target: DataFrame) -> DataFrame:
    """Mappings neither of whose ends is among the ids ``iri``."""
    out = mappings.join(ignored_source.select(F.col("iri").alias("source")), "source", "left_anti")
    return out.join(ignored_target.select(F.col("iri").alias("target")), "target", "left_anti")


def light_match(candidates: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """The candidates that match by string: the matcher without a trained model."""
    return string_match(source, target).join(candidates.select(*PAIR), PAIR, "left_semi")


def match(candidates: DataFrame, source: DataFrame, target: DataFrame, scorer, best: int = 10, threshold: float = 0.9) -> DataFrame:
    """String matches of a source if it has any, else its ``best`` candidates that score ``threshold`` or more.

    ``scorer(pairs, source, target)`` gives ``(source, target, score)``; it sees
    only the sources that no string matched.
    """
    exact = materialize(light_match(candidates, source, target), "exact")
    rest = candidates.select(*PAIR).join(exact.select("source").distinct(), "source", "left_anti")
    scored = at_least(scorer(rest, source, target), threshold)
    return exact.unionByName(top_per_source(scored, best).select(*PAIR, "score"))


def one_hop(frontier: DataFrame, source_edges: DataFrame, target_edges: DataFrame, block: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pairs of parents, and pairs of children, of the mapped pairs in ``frontier``.

    ``block`` gives a key of an id: only pairs whose keys are equal are formed.
    """
    out = []
    for near, far in (("child", "parent"), ("parent", "child")):
        s = edge_table(source_edges).select(F.col(near).alias("source"), F.col(far).alias("s"))
        t = edge_table(target_edges).select(F.col(near).alias("target"), F.col(far).alias("t"))
        if block:
            s, t = s.withColumn("key", block(F.col("s"))), t.withColumn("key", block(F.col("t")))
        met = frontier.select(*PAIR).join(s, "source").join(t, ["target", "key"] if block else "target")
        out.append(met.select(F.col("s").alias("source"), F.col("t").alias("target")))
    return out[0].union(out[1]).distinct()


def extend_mappings(mappings: DataFrame, source_edges: DataFrame, target_edges: DataFrame, scorer, kappa: float = 0.9, rounds: int = 10, block: Callable[[Column], Column] | None = None) -> DataFrame:
    """``mappings`` and those found from them hop by hop: each new pair is scored once and goes on if it reaches ``kappa``.

    All pairs of the children of a mapped pair are scored, which is their product. ``block`` spares that where a
    scorer allows it: a key of an id, such that ids of different keys are known to score below ``kappa``.
    """
    known = materialize(mappings.select(*PAIR, "score"), "known")
    scored, frontier, found = known.select(*PAIR), known, [known]
    for _ in range(rounds):
        new = one_hop(frontier, source_edges, target_edges, block).join(scored, PAIR, "left_anti")
        new = materialize(scorer(new).select(*PAIR, "score"), "scored")
        scored = scored.union(new.select(*PAIR))
        frontier = new.where(F.col("score") >= kappa)
        if frontier.isEmpty():
            break
        found.append(frontier)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def subsumptions_from_equivalences(mappings: DataFrame, target_edges: DataFrame, delete: bool = False, per_mapping: int | None = None) -> DataFrame:
    """``(source, target)``: each mapped source is below the parents of its target.

    Without ``delete`` this is a join. With it the mappings are taken in the
    order of ``position``: a target that has served as a parent gives nothing
    any more, and parents that are mapped targets themselves are left out once
    used, so targets and parents that touch are folded together, and apart from
    the others. Of more than ``per_mapping`` parents the first ones stay, but all
    of them have served.
    """
    pairs = mappings.join(edge_table(target_edges).select(F.col("child").alias("target"), F.col("parent")), "target")
    if not delete:
        order = Window.partitionBy("source", "target").orderBy("parent")
        if per_mapping:
            pairs = pairs.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_mapping)
        return pairs.select("source", F.col("parent").alias("target")).distinct()
    pairs = materialize(pairs.select("position", "source", "target", "parent"), "pairs")
    groups = connected_components(pairs.select("target", "parent"), "target", "parent")
    grouped = pairs.join(groups.select(F.col("node").alias("target"), "component"), "target")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        supers, used, out = set(), set(), []
        for (_, source, target), rows in pdf.sort_values(["position", "parent"]).groupby(["position", "source", "target"], sort=False):
            if target in supers:
                continue
            parents = [p for p in rows["parent"] if p not in used]
            supers.update(parents)
            out += [(source, p) for p in parents[:per_mapping]]
            if parents:
                used.add(target)
        return pd.DataFrame(out, columns=["source", "target"])

    kinds = f"source {pairs.schema['source'].dataType.simpleString()}, target {pairs.schema['target'].dataType.simpleString()}"
    return grouped.groupBy("component").applyInPandas(fold, kinds).distinct()


def repair_one_to_one(mappings: DataFrame) -> DataFrame:
    """A consistent subset: each end mapped once, better scores first.

    In each round the mappings that are the best of both their ends stay and
    their rivals go, which gives what taking all of them in order would.
    """
    left = materialize(mappings.select(*PAIR, "score").distinct(), "mappings")
    kept = []
    while not left.isEmpty():
        rank = lambda end, other: F.row_number().over(Window.partitionBy(end).orderBy(F.desc("score"), "source", "target"))
        best = materialize(left.withColumn("a", rank("source", "target")).withColumn("b", rank("target", "source")).where("a = 1 and b = 1").select(*PAIR, "score"), "best")
        kept.append(best)
        left = left.join(best.select("source"), "source", "left_anti").join(best.select("target"), "target", "left_anti")
        left = materialize(left, "rivals")
    out = left
    for some in kept:
        out = out.unionByName(some)
    return out


def drop_incoherent(mappings: DataFrame, source_closure: DataFrame, target_disjoint: DataFrame) -> DataFrame:
    """Mappings without those that put a class under two disjoint ones; of two in conflict the lower score goes.

    ``source_closure`` has ``(ancestor, descendant)``, ``target_disjoint``
    ``(a, b)`` in both orders.
    """
    m = mappings.select(*PAIR, "score")
    own = source_closure.select(F.col("ancestor").alias("x"), F.col("descendant").alias("y"))
    first = m.select(F.col("source").alias("x"), F.col("target").alias("a"), F.col("score").alias("sa"))
    second = m.select(F.col("source").alias("y"), F.col("target").alias("b"), F.col("score").alias("sb"))
    clash = first.join(own, "x").join(second, "y").join(target_disjoint.select("a", "b"), ["a", "b"])
    loses = clash.select(F.when(F.col("sa") < F.col("sb"), F.struct(F.col("x").alias("source"), F.col("a").alias("target"))).otherwise(F.struct(F.col("y").alias("source"), F.col("b").alias("target"))).alias("l"))
    return m.join(loses.select("l.*").distinct(), PAIR, "left_anti")
