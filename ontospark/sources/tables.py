"""Readers and writers of mapping, candidate, subsumption and sample files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ontospark.operators.corpora import split as hash_split

#: Cells that mean a missing value; NULL, null and n/a are strings.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NaN", "None", "nan"]
#: A string in quotes, or what stands between two of them.
_PIECES = r"""'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+"|[^'"]++"""
UNMATCHED = "UnMatched"
CANDIDATES = "array<struct<iri:string,score:double,answer:boolean>>"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A csv or tsv file (by its suffix) with a header, all strings; cells in ``MISSING`` are null."""
    sep = "\t" if path.rstrip("/").endswith(".tsv") else ","
    df = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", False).csv(path)
    return df.select(*[F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_mappings(spark: SparkSession, path: str, threshold: float | None = None, relation: str = "<?rel>", is_reference: bool = False) -> DataFrame:
    """``(source, target, relation, score)``; reference mappings score 1."""
    df = read_table(spark, path)
    score = F.lit(1.0) if is_reference else F.col("Score").cast("double")
    out = df.select(F.col("SrcEntity").alias("source"), F.col("TgtEntity").alias("target"), F.lit(relation).alias("relation"), score.alias("score"))
    return out.where(F.col("score") >= threshold) if threshold else out


def parse_candidates(cell: Column) -> Column:
    """A list cell as ``CANDIDATES``: bare iris (scored by place), ``(iri, score)`` or ``(iri, score, answer)``, best first.

    Nothing is evaluated: the cell is turned into JSON and read as such, what stands in quotes as it is.
    """
    pieces = F.regexp_extract_all(F.trim(cell), F.lit(_PIECES), F.lit(0))
    plain = lambda x: F.replace(F.replace(F.replace(F.translate(x, "()", "[]"), F.lit("True"), F.lit("true")), F.lit("False"), F.lit("false")), F.lit("None"), F.lit("null"))
    json = F.array_join(F.transform(pieces, lambda x: F.when(x.rlike("^['\"]"), x).otherwise(F.regexp_replace(plain(x), r",\s*\]", "]"))), "")
    options = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    nested = F.from_json(json, "array<array<string>>", options)
    bare = F.from_json(json, "array<string>", options)
    scored = F.transform(nested, lambda x: F.struct(x[0].alias("iri"), x[1].cast("double").alias("score"), F.try_element_at(x, F.lit(3)).cast("boolean").alias("answer")))
    placed = F.transform(bare, lambda x, i: F.struct(x.alias("iri"), ((F.size(bare) - i) / F.size(bare)).alias("score"), F.lit(None).cast("boolean").alias("answer")))
    return F.when(json.rlike(r"^\[\s*\["), F.sort_array(F.transform(scored, lambda x: F.struct((-x["score"]).alias("k"), x["iri"].alias("iri"), x["score"].alias("score"), x["answer"].alias("answer"))))).otherwise(
        F.transform(placed, lambda x: F.struct((-x["score"]).alias("k"), x["iri"].alias("iri"), x["score"].alias("score"), x["answer"].alias("answer")))
    )


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """``(source, target, candidates)`` with the candidates of each row best first."""
    df = read_table(spark, path)
    drop_key = F.transform(parse_candidates(F.col("TgtCandidates")), lambda x: F.struct(x["iri"].alias("iri"), x["score"].alias("score"), x["answer"].alias("answer")))
    return df.select(F.col("SrcEntity").alias("source"), F.col("TgtEntity").alias("target"), drop_key.alias("candidates"))


def explode_candidates(candidates: DataFrame) -> DataFrame:
    """``(source, reference, target, score, answer)`` per candidate."""
    each = candidates.select("source", F.col("target").alias("reference"), F.explode("candidates").alias("c"))
    return each.select("source", "reference", F.col("c.iri").alias("target"), F.col("c.score").alias("score"), F.col("c.answer").alias("answer"))


def _known_relation(relation: Column) -> Column:
    bad = F.raise_error(F.concat(F.lit("no such relation: "), F.coalesce(relation, F.lit("none"))))
    return F.when(relation.isin("=", "<", ">", "?"), relation).otherwise(bad.cast("string"))


def split_candidates(candidates: DataFrame, threshold: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What ``read_candidates`` gives as matched and unmatched rows, predictions and references.

    Rows whose target is ``UnMatched`` are unmatched and give no reference.
    Predictions ``(source, target, score)`` are the candidates of either kind
    whose answer is true and that score ``threshold`` or more.
    """
    matched, unmatched = (candidates.where(cond) for cond in (~F.col("target").eqNullSafe(UNMATCHED), F.col("target").eqNullSafe(UNMATCHED)))
    predicted = explode_candidates(candidates).where(F.col("answer") & (F.col("score") >= threshold)).select("source", "target", "score")
    return matched, unmatched, predicted, matched.select("source", "target", F.lit(1.0).alias("score"))


def read_alignment(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Mappings of an alignment in XML by relation: ``=``, ``<``, ``>`` are references, ``?`` is ignored; the others, or none, raise on use."""
    schema = "entity1 struct<`_rdf:resource`:string>, entity2 struct<`_rdf:resource`:string>, relation string, measure string"
    cells = spark.read.format("xml").option("rowTag", "Cell").schema(schema).load(path)
    flat = cells.select(F.col("entity1.`_rdf:resource`").alias("source"), F.col("entity2.`_rdf:resource`").alias("target"), _known_relation(F.trim("relation")).alias("relation"), F.col("measure").cast("double").alias("score"))
    return flat.where(F.col("relation").isin("=", "<", ">")), flat.where("relation = '?'")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, with or without a byte order mark; columns (strings) are the union of the keys."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where("trim(value) <> ''")
    keys = [r["k"] for r in lines.select(F.explode(F.json_object_keys("value")).alias("k")).distinct().orderBy("k").collect()]
    return lines.select(*[F.get_json_object("value", f"$['{k}']").alias(k) for k in keys])


def write_mappings(mappings: DataFrame, path: str) -> None:
    """A tsv with a header: SrcEntity, TgtEntity, Score."""
    out = mappings.select(F.col("source").alias("SrcEntity"), F.col("target").alias("TgtEntity"), F.col("score").alias("Score"))
    out.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def repair_lines(mappings: DataFrame) -> DataFrame:
    """``value``: ``source|target|=|score|CLS``, the input of an external repair tool."""
    return mappings.select(F.concat_ws("|", "source", "target", F.lit("="), F.col("score").cast("string"), F.lit("CLS")).alias("value"))


def read_subsumptions(spark: SparkSession, path: str) -> DataFrame:
    """``(position, sub, gold, negatives)`` of headerless lines; positions are those of the lines within their file's ranges."""
    cells = F.split("value", ",")
    rows = spark.read.text(path).withColumn("position", F.monotonically_increasing_id())
    return rows.select("position", cells[0].alias("sub"), cells[1].alias("gold"), F.slice(cells, F.lit(3), F.greatest(F.size(cells) - 2, F.lit(0))).alias("negatives"))


def write_scores(scores: DataFrame, path: str) -> None:
    """One line of comma-joined scores per row of ``(position, scores)``."""
    scores.orderBy("position").select(F.concat_ws(",", F.transform("scores", lambda s: s.cast("string")))).write.mode("overwrite").text(path)


def write_corpus(samples: DataFrame, path: str) -> None:
    """Samples ``(text_a, text_b, label)`` as JSON lines in a folder per label."""
    samples.write.mode("overwrite").partitionBy("label").json(path)


def write_walks(walks: DataFrame, path: str, of_interest: DataFrame | None = None) -> None:
    """A line of space-joined tokens per walk ``(start, walk, step, token)``; with nodes ``id`` of interest only walks that meet one."""
    if of_interest is not None:
        met = walks.join(of_interest.select(F.col("id").alias("token")), "token", "left_semi").select("start", "walk").distinct()
        walks = walks.join(met, ["start", "walk"], "left_semi")
    tokens = F.array_sort(F.collect_list(F.struct("step", "token")))
    lines = walks.groupBy("start", "walk").agg(F.concat_ws(" ", F.transform(tokens, lambda x: x["token"])).alias("value"))
    lines.select("value").write.mode("overwrite").text(path)


def new_rows(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is left to do of ``df`` when ``done`` was written already: a restart goes on where it stopped."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; ``build`` makes it if no finished one is there, so a restarted pipeline skips the stages it has done."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_synset_edges(spark: SparkSession, path: str, relation: str = "hypernym") -> DataFrame:
    """``(parent, child)`` of an exported lexical network, a table ``synset, relation, other``.

    ``hypernym`` and ``instance_hypernym``: the other one is the parent;
    ``part_holonym``: the other one is the whole. Any other relation is an error.
    """
    if relation not in ("hypernym", "instance_hypernym", "part_holonym"):
        raise ValueError(f"no such relation: {relation}")
    rows = read_table(spark, path).where(F.col("relation") == relation)
    return rows.select(F.col("other").alias("parent"), F.col("synset").alias("child")).where("parent is not null and child is not null").distinct()


def evaluation_split(subsumptions: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """``split``: valid 5 %, test 10 %, train the rest."""
    return hash_split(subsumptions, keys, {"valid": 0.05, "test": 0.10, "train": 0.85}, seed)


def best_first(candidates: DataFrame) -> DataFrame:
    order = Window.partitionBy("source", "reference").orderBy(F.desc("score"), "target")
    return candidates.withColumn("place", F.row_number().over(order))
