"""Every operator and stage with nulls, empty and very long texts, ties, repeated rows, no rows, and columns named like its own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ontospark.llm import bpe, decontaminate, embeddings, langid, licenses, nearcopies, queries, sharding, simhash, toxicity, urlfilter, warc

TEXT = "The quick brown fox jumps over the lazy dog near the river bank today. "
ROWS = [(1, TEXT, "en"), (1, TEXT, "en"), (1, TEXT + "x", "en"), (None, None, None), (None, "", "en"), (None, TEXT, None), (2, "word " * 60_000, "en"), (3, "a", "en"), (4, " \n\t", "de"), (5, "12 34", "de"), (6, TEXT * 3, "de")]
#: Names that the operators use for columns of their own.
OWN = ["id", "row", "th", "tc", "cls", "n", "fp", "key", "block", "word", "ids", "decoded", "hits", "items", "score", "toxicity", "label", "label_", "lang_pred", "languages", "rank", "k", "node", "shard", "slot", "size", "tie", "d0", "place", "component", "kept", "kept_id", "kept_th", "kept_n", "dirty_th", "dirty_tc", "h", "host", "path", "rule", "verdict", "u_host", "template", "text_", "found_score", "_id", "_label", "_n", "_score", "_toxicity", "_lang_pred", "_languages", "_kept_id", "_lang", "_rank"]


def frame(spark, rows=ROWS, kind="long"):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df = df.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("source", F.lit(None).cast("string"))
    return df.withColumns({c: F.lit(c) for c in OWN})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges"))
    frame(spark).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (6, 0), (6, 1)], "doc_id long, toxic int").withColumns({c: F.lit(c) for c in OWN}).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, TEXT), (2, None), (None, "12 34"), (3, "")], "item_id long, text string").withColumns({c: F.lit(c) for c in OWN}).write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage(spark, docs, folder)
    if name != "bpe":
        assert out.columns == docs.columns
        rows = out.collect()
        assert all(r[c] == c for r in rows for c in OWN)
        assert 0 < len(rows) <= len(ROWS)
    else:
        assert out.count() == len(ROWS)
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_near_copies_and_decontamination_keep_the_right_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    same = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())
    kept = same(corpus_pipeline.drop_near_copies(spark, docs, folder))
    # Without words: rows 4, null and null, of which the id stays; a text, its repeat and the one with a letter more are one group.
    assert [k for k, _ in kept].count("1") == 1 and ("4", " \n\t") in kept and all(k != "None" for k, _ in kept)
    clean = same(corpus_pipeline.drop_contaminated(spark, docs, folder))
    assert clean == sorted((str(k), str(t)) for k, t, _ in ROWS if not (t and (t.startswith("The quick") or t == "12 34")))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_operators(spark, folder, kind):
    docs, none = frame(spark, kind=kind), frame(spark, [], kind)
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumn("doc_id", F.col("doc_id").cast(kind))
    model = toxicity.train(docs, labels)
    language = langid.train(docs)
    each = {
        "bpe": lambda d: bpe.encode(d, queries.tokenizer_path(), decoded=True),
        "decode": lambda d: bpe.decode(d.withColumn("ids", F.lit(None).cast("binary")), queries.tokenizer_path()),
        "toxicity": lambda d: toxicity.score(d, model),
        "sentences": lambda d: toxicity.offending_sentences(d, model, least=2.0),
        "contamination": lambda d: decontaminate.contamination(d, bench),
        "language": lambda d: langid.identify(d, language),
        "licences": licenses.scan_licenses,
        "simhash": simhash.simhash_components,
        "near copies": nearcopies.near_copy_components,
        "sharding": lambda d: sharding.shard_documents(d, 3),
        "urls": lambda d: urlfilter.judge_urls(d, spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string"), url_col="text"),
        "warc": lambda d: warc.archive_round_trip(d, "doc_id", "lang", "text"),
    }
    for name, run in each.items():
        got = run(docs).collect()
        assert len(got) == (0 if name == "sentences" else len(ROWS)), name
        # A repeated row gets what its twin gets.
        assert run(none).count() == 0, name
    bits = simhash.simhash_components(docs).where(F.col("id") == "1").select("fp", "component").distinct().collect()
    assert len(bits) <= 2
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns
    assert toxicity.train(none, labels).bias < 0 and langid.train(none).languages == []


def test_language_of_many_languages(spark):
    """A text of five languages is given all five."""
    words = {lang: [f"{a}{b}{lang}{a}" for a in "aeiou" for b in "klmnr"] for lang in ["x", "y", "z", "w", "v", "q"]}
    rows = [(k, " ".join(words[lang] * 6), lang) for k, lang in enumerate(list(words) * 8)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = " ".join(w for lang in "xyzwv" for w in words[lang] * 6)
    _, scores, sets = langid.predict(model, [mixed])
    assert sorted(sets[0]) == sorted("xyzwv") and scores[0] < 0.4


def test_embedding_edges(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [0.0, 0.0], "a"), (3, None, "a"), (None, [1.0, 0.0], "a"), (4, [1.0, 0.01], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumns({c: F.lit(c) for c in OWN if c != "label"})
    got = sorted((str(r.id), r.n_links, r.component) for r in embeddings.link_embeddings(df).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("2", 0, 2), ("3", 0, 3), ("4", 0, 4), ("None", 2, 1)]
