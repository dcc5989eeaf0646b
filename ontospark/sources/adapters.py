"""Ontology inputs from the relational tables: hierarchies, annotations, assertions and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontospark.functions.text import clean_literal


class Tables:
    """The tables of one folder, read on use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def tagged(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def _edges(df: DataFrame, parent: Column, child: Column) -> DataFrame:
    return df.select(parent.alias("parent"), child.alias("child"))


def geo_edges(t: Tables) -> DataFrame:
    """root, region, nation, customer and supplier: a tree."""
    out = _edges(t.region, F.lit("root"), tagged("region", "r_regionkey"))
    out = out.union(_edges(t.nation, tagged("region", "n_regionkey"), tagged("nation", "n_nationkey")))
    out = out.union(_edges(t.customer, tagged("nation", "c_nationkey"), tagged("customer", "c_custkey")))
    return out.union(_edges(t.supplier, tagged("nation", "s_nationkey"), tagged("supplier", "s_suppkey")))


def part_edges(t: Tables) -> DataFrame:
    """Parts under their brand and type, with a direct edge from the type that the longer path implies."""
    both = F.concat(F.lit("tb:"), "p_type", F.lit("|"), "p_brand")
    kinds = t.part.select("p_type", "p_brand").distinct()
    out = _edges(kinds, F.lit("root"), tagged("type", "p_type")).union(_edges(kinds, F.lit("root"), tagged("brand", "p_brand")))
    out = out.union(_edges(kinds, tagged("type", "p_type"), both)).union(_edges(kinds, tagged("brand", "p_brand"), both))
    part = t.part
    out = out.union(_edges(part, both, tagged("part", "p_partkey"))).union(_edges(part, tagged("type", "p_type"), tagged("part", "p_partkey")))
    return out.distinct()


def line_literals(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(iri, literal)``: the distinct non-empty lines of a text, cleaned and in lower case."""
    lines = df.select(F.col(key).alias("iri"), F.explode(F.split(text, "\n")).alias("line"))
    return lines.select("iri", clean_literal(F.col("line"), lower=True).alias("literal")).where("literal <> ''").distinct()


def document_edges(t: Tables) -> DataFrame:
    """Documents under their language and source."""
    d = t.documents
    return _edges(d, tagged("lang", "lang"), tagged("doc", "doc_id")).union(_edges(d, tagged("source", "source"), tagged("doc", "doc_id")))


def order_facts(t: Tables) -> DataFrame:
    """``(subject, predicate, object)``: orders contain parts, parts are supplied by suppliers."""
    li = t.lineitem
    out = li.select(tagged("order", "l_orderkey").alias("subject"), F.lit("contains").alias("predicate"), tagged("part", "l_partkey").alias("object"))
    return out.union(li.select(tagged("part", "l_partkey"), F.lit("suppliedBy"), tagged("supplier", "l_suppkey"))).distinct()


def customer_types(t: Tables) -> DataFrame:
    """``(individual, cls)``: customers as instances of their nation."""
    return t.customer.select(tagged("customer", "c_custkey").alias("individual"), tagged("nation", "c_nationkey").alias("cls"))
