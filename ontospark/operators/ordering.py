"""Running sums over a whole table without putting it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontospark.runtime import materialize

GROUP_ROWS = 100_000


def running_sum(df: DataFrame, order: str, sums: dict[str, str], count: str) -> DataFrame:
    """``df`` with running sums (column to new name) and a running ``count`` in the order of unique integers ``order``.

    The order's range is cut into groups of about ``GROUP_ROWS`` rows; a window
    runs within each, and the groups' totals, one row each, run over all.
    """
    df = materialize(df, "ordered")
    bounds = df.agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count("*").alias("n")).first()
    groups = max(1, -(-bounds["n"] // GROUP_ROWS))
    width = max(1, -(-((bounds["b"] or 0) - (bounds["a"] or 0) + 1) // groups))
    df = df.withColumn("_g", F.floor((F.col(order) - F.lit(bounds["a"] or 0)) / width))
    totals = df.groupBy("_g").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_bn"), *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    within = Window.partitionBy("_g").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.join(base, "_g").withColumns({count: F.count("*").over(within) + F.col("_bn")} | {new: F.sum(c).over(within) + F.col(f"_b_{c}") for c, new in sums.items()})
    return out.drop("_g", "_bn", *[f"_b_{c}" for c in sums])
