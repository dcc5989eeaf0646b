"""Evaluation of mappings and of ranked candidates. A mapping is its two ends; relation and score don't count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontospark.operators.matching import PAIR
from ontospark.operators.ordering import running_sum


def precision_recall_f1(predicted: DataFrame, reference: DataFrame, unknown: DataFrame | None = None, digits: int = 3) -> DataFrame:
    """One row ``(P, R, F1)``; mappings in ``unknown`` are left out of both sides. Nulls where there is nothing to divide by."""
    predicted, reference = predicted.select(*PAIR).distinct(), reference.select(*PAIR).distinct()
    if unknown is not None:
        predicted, reference = (x.join(unknown.select(*PAIR), PAIR, "left_anti") for x in (predicted, reference))
    both = predicted.withColumn("p", F.lit(1)).join(reference.withColumn("r", F.lit(1)), PAIR, "full")
    counts = both.agg(F.count("p").alias("p"), F.count("r").alias("r"), F.count(F.expr("p + r")).alias("hit"))
    exact = counts.select(F.try_divide("hit", "p").alias("p"), F.try_divide("hit", "r").alias("r"))
    f1 = F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return exact.select(F.round("p", digits).alias("P"), F.round("r", digits).alias("R"), F.round(f1, digits).alias("F1"))


def ranks(candidates: DataFrame, reference: DataFrame, last_in_ties: bool = False) -> DataFrame:
    """``(source, target, rank)`` per reference: its place among the source's candidates by score; null: absent.

    Ties go by target; with ``last_in_ties`` the reference stands behind all of its score.
    """
    known = reference.select(*PAIR).distinct().withColumn("gold", F.lit(1))
    marked = candidates.select(*PAIR, "score").join(known, PAIR, "left")
    tie = F.coalesce("gold", F.lit(0)) if last_in_ties else F.lit(0)
    order = Window.partitionBy("source").orderBy(F.desc("score"), tie, "target")
    placed = marked.withColumn("rank", F.row_number().over(order)).where("gold = 1").select(*PAIR, "rank")
    return known.select(*PAIR).join(placed, PAIR, "left")


def ranking_metrics(ranked: DataFrame, ks: tuple[int, ...] = (1, 5, 10), digits: int = 6) -> DataFrame:
    """One row: ``MRR`` and ``Hits_k``, over all references."""
    hits = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), digits).alias(f"Hits_{k}") for k in ks]
    return ranked.agg(F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), digits).alias("MRR"), *hits)


def running_metrics(ranked: DataFrame, order: str, digits: int = 6) -> DataFrame:
    """``ranked`` with the mean reciprocal rank up to each row in the order of column ``order``.

    Running means over all rows need their order, so the rows are numbered by
    range partitions and only per-partition sums meet in one place.
    """
    value = F.coalesce(1.0 / F.col("rank"), F.lit(0.0))
    summed = running_sum(ranked.withColumn("rr", value), order, {"rr": "sum_rr"}, "n")
    return summed.withColumn("running_mrr", F.round(F.col("sum_rr") / F.col("n"), digits)).drop("sum_rr", "rr")


def positional_scores(lists: DataFrame, column: str) -> DataFrame:
    """``lists`` with one row per element: ``item`` and its ``score`` (n - i) / n."""
    n = F.size(column)
    out = lists.select("*", F.posexplode(column).alias("i", "item"))
    return out.withColumn("score", (n - F.col("i")) / n).drop("i", column)


def rejection_rate(answers: DataFrame, unmatched: DataFrame, digits: int = 6) -> DataFrame:
    """One row ``(RR,)``: the share of unmatched sources none of whose candidates ``(source, answer)`` is true."""
    said = answers.groupBy("source").agg(F.bool_or("answer").alias("any"))
    found = unmatched.select("source").distinct().join(said, "source", "left")
    return found.agg(F.round(F.avg(F.when(F.coalesce("any", F.lit(False)), 0.0).otherwise(1.0)), digits).alias("RR"))


def answered_metrics(candidates: DataFrame, reference: DataFrame, threshold: float = 0.0, ks: tuple[int, ...] = (1,), digits: int = 3) -> DataFrame:
    """One row ``(P, R, F1, MRR, Hits_k, RR)`` of candidates ``(source, target, score, answer)`` of matched and unmatched sources.

    Predicted is what is answered true at ``threshold`` or more. Sources without
    a reference are the unmatched; the rejection rate is over them.
    """
    predicted = candidates.where(F.col("answer") & (F.col("score") >= threshold))
    unmatched = candidates.select("source").distinct().join(reference.select("source").distinct(), "source", "left_anti")
    ranked = ranking_metrics(ranks(candidates, reference), ks, digits)
    parts = [precision_recall_f1(predicted, reference, digits=digits), ranked, rejection_rate(candidates.withColumn("answer", F.col("answer") & (F.col("score") >= threshold)), unmatched, digits)]
    out = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:  # one row each
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def size_histogram(sizes: DataFrame, column: str) -> DataFrame:
    """``(size, n)`` for every size from 0 to the largest, those that no row has included."""
    counts = sizes.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("size")).agg(F.count("*").alias("_n"))
    every = counts.agg(F.max("size").alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("size"))
    return every.join(counts, "size", "left").select("size", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def check_candidates(result: DataFrame, reference: DataFrame) -> DataFrame:
    """Faults in a ranking result ``(position, source, candidates)`` against its reference: no row means it fits."""
    r, g = result.alias("r"), reference.alias("g")
    joined = r.join(g, F.col("r.position") == F.col("g.position"), "full")
    fault = F.when(F.col("r.position").isNull(), F.lit("missing row")).when(F.col("g.position").isNull(), F.lit("extra row"))
    fault = fault.when(~F.col("r.source").eqNullSafe(F.col("g.source")), F.lit("other source"))
    fault = fault.when(F.size(F.array_except("r.candidates", "g.candidates")) > 0, F.lit("unknown candidate"))
    return joined.select(F.coalesce("r.position", "g.position").alias("position"), fault.alias("fault")).where("fault is not null")
