"""The corpus pipeline: documents in, token ids out, one operator per stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before it kept; what it returns is written as Parquet and read again. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontospark.llm import decontaminate, langid, nearcopies, toxicity
from ontospark.llm.queries import digest_tokens
from ontospark.llm.words import fresh
from ontospark.runtime import drop_materialized, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay; null and empty texts score 0 and stay. Without labels all stay.

    Rows are judged one by one, so repeated and null ids don't matter; columns of any name are kept.
    """
    (name,) = fresh(docs.columns, "toxicity")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, out_col=name).where(F.col(name) < 0.5).select(*docs.columns)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay that have a language, and one that holds at least half of them.

    Null texts and texts without a letter have none and go. Rows are judged one by one; columns of any name are kept.
    """
    prefix = "found_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    found = langid.identify(docs, langid.train(docs), prefix=prefix)
    return found.where((F.col(prefix + "lang_pred") != "und") & (F.col(prefix + "score") >= 0.5)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, Jaccard 0.8 or more) the document with the smallest id stays.

    Rows without an id come last, so one of them stays only where a group has no id; null and empty texts are one group.
    """
    return nearcopies.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item stay, judged by their text alone; null and empty texts stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token counts and digests of their ids and decoded texts, a row each; null texts count as empty."""
    return digest_tokens(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_identified),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode_tokens),
]

#: SQL can't express the trained stages; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's table is deleted as soon as the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        drop_materialized(before)
    return docs
