"""Annotation literals, inverted index and idf candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontospark.functions.text import clean_literal, space_tokens


def annotation_literals(annotations: DataFrame, properties: list[str] | None = None, lang: str | None = None, lower: bool = True, split_identifiers: bool = False) -> DataFrame:
    """``(iri, literal)``: distinct cleaned literals, without empty ones, of the properties and language asked for."""
    kept = annotations.where(F.col("literal").isNotNull())
    if properties is not None:
        kept = kept.where(F.col("property_iri").isin(properties))
    if lang is not None:
        kept = kept.where(F.col("lang") == lang)
    cleaned = kept.select("iri", clean_literal(F.col("literal"), lower, split_identifiers).alias("literal"))
    return cleaned.where("literal <> ''").distinct()


def annotation_index(entities: DataFrame, literals: DataFrame) -> DataFrame:
    """``(iri, literal)`` with a row of null literal for entities without any: every entity is a key."""
    return entities.select("iri").distinct().join(literals, "iri", "left")


def postings(literals: DataFrame, tokenise=space_tokens) -> DataFrame:
    """``(token, iri, tf)``: how often each token stands in an entity's literals."""
    return literals.select("iri", F.explode(tokenise(F.col("literal"))).alias("token")).groupBy("token", "iri").agg(F.count("*").alias("tf"))


def token_idf(index: DataFrame, keys: Column | int) -> DataFrame:
    """``(token, idf)``: log10(keys / postings), which a token with more postings than keys makes negative."""
    keys = F.lit(keys) if isinstance(keys, int) else keys
    return index.groupBy("token").agg(F.sum("tf").alias("n")).select("token", F.log10(keys / F.col("n")).alias("idf"))


def idf_select(queries: DataFrame, targets: DataFrame, keys: int, pool: int = 200, tokenise=space_tokens, digits: int = 6) -> DataFrame:
    """``(source, target, score, place)``: for each source its ``pool`` targets of the largest summed idf.

    Both sides are ``(iri, literal)``. Counts are gathered before the join, so
    a token contributes one row per pair that shares it; ties go to the
    smaller target. The queries' postings are dealt by source before that join
    multiplies them: where the index is small enough for Spark to broadcast it,
    sums and ranks then follow without another shuffle.
    """
    index = postings(targets, tokenise)
    weighted = index.join(token_idf(index, keys), "token").select("token", F.col("iri").alias("target"), (F.col("tf") * F.col("idf")).alias("w"))
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = postings(queries, tokenise).select("token", F.col("iri").alias("source"), F.col("tf").alias("qf")).repartition(parts, "source")
    scores = asked.join(weighted, "token").groupBy("source", "target").agg(F.round(F.sum(F.col("qf") * F.col("w")), digits).alias("score"))
    return top_per_source(scores, pool)


def top_per_source(scores: DataFrame, most: int) -> DataFrame:
    """The ``most`` best targets of each source, ties by target, with their place."""
    order = Window.partitionBy("source").orderBy(F.desc("score"), "target")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def mean_literals(index: DataFrame, digits: int = 3) -> DataFrame:
    """``(n_keys, n_literals, mean)`` of an annotation index."""
    found = index.agg(F.count_distinct("iri").alias("n_keys"), F.count("literal").alias("n_literals"))
    return found.withColumn("mean", F.round(F.try_divide("n_literals", "n_keys"), digits))
