"""Scorers of text pairs. A scorer takes ``(text_a, text_b)`` rows and adds ``score``; others plug in as functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontospark.functions.text import edit_similarity

Scorer = Callable[[DataFrame], DataFrame]


def exact(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("score", (F.col("text_a") == F.col("text_b")).cast("double"))


def edit(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("score", edit_similarity(F.col("text_a"), F.col("text_b")))


def cosine(pairs: DataFrame, a: str, b: str, digits: int = 6) -> DataFrame:
    """``pairs`` with the cosine of two array columns, in double precision; null for a zero vector."""
    x, y = (F.transform(c, lambda v: v.cast("double")) for c in (a, b))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(total(F.transform(x, lambda v: v * v))) * F.sqrt(total(F.transform(y, lambda v: v * v)))
    return pairs.withColumn("score", F.round(F.try_divide(dot, norm), digits))


def batched(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Scorer:
    """A scorer around a model: ``load`` runs once per task and gives a function from two lists of texts to scores."""

    def score(pairs: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = load()
            for a, b in batches:
                yield pd.Series(model(a.tolist(), b.tolist()), dtype="float64")

        return pairs.withColumn("score", run("text_a", "text_b"))

    return score


def train_pair_classifier(samples: DataFrame, features: int = 1 << 12) -> Scorer:
    """A logistic model over hashed character trigrams that two texts share or don't, as a scorer of class 1."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    def grams(column: str):
        padded = F.concat(F.lit(" "), F.lower(column), F.lit(" "))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substr(padded, i, F.lit(3))))

    def prepared(df: DataFrame) -> DataFrame:
        a, b = grams("text_a"), grams("text_b")
        tag = lambda arr, t: F.transform(arr, lambda g: F.concat(F.lit(t), g))
        shared, apart = F.array_intersect(a, b), F.concat(F.array_except(a, b), F.array_except(b, a))
        ratio = F.floor(10 * F.size(shared) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))).cast("string")
        terms = F.concat(tag(shared, "+"), tag(apart, "-"), F.array_repeat(F.concat(F.lit("="), ratio), 3))
        return HashingTF(numFeatures=features, inputCol="_terms", outputCol="_features").transform(df.withColumn("_terms", terms))

    model = LogisticRegression(featuresCol="_features", labelCol="label", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred", regParam=0.01, maxIter=30).fit(prepared(samples))

    def score(pairs: DataFrame) -> DataFrame:
        out = model.transform(prepared(pairs)).withColumn("score", vector_to_array("_p")[1])
        return out.drop("_terms", "_features", "_p", "_raw", "_pred")

    return score


def accuracy(scored: DataFrame, threshold: float = 0.5, digits: int = 6) -> DataFrame:
    hit = ((F.col("score") >= threshold).cast("int") == F.col("label")).cast("double")
    return scored.agg(F.round(F.avg(hit), digits).alias("accuracy"))


def length_histogram(lengths: DataFrame, column: str, cuts: tuple[int, ...] = (128, 256, 512), digits: int = 6) -> DataFrame:
    """One row: mean, share up to each cut, and maximum of a length column."""
    shares = [F.round(F.avg((F.col(column) <= c).cast("double")), digits).alias(f"upto_{c}") for c in cuts]
    return lengths.agg(F.round(F.avg(column), digits).alias("mean"), *shares, F.max(column).alias("longest"))
