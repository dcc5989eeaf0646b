"""The stages one by one on a small corpus with planted cases, against plain versions."""

import hashlib
import random

import pytest

import corpus_pipeline
from ontospark.llm import queries, simhash
from tests.llm.test_operators import toxic_corpus, windows_brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rng = random.Random(1)
    rows = [(k, t, "en", "s", len(t)) for k, t, _ in toxic_corpus()]
    item = " ".join(f"item{k}" for k in range(14))
    clean = [r for r in rows if "zog" not in r[1] and "yuk" not in r[1]]
    planted = [(5000, clean[3][1], "en", "s", 1), (5001, clean[4][1] + " " + item + " " + clean[5][1], "en", "s", 1), (5002, "12 34 56", "en", "s", 1), (5003, None, "en", "s", 0)]
    docs = rows + planted
    rng.shuffle(docs)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, y) for k, _, y in toxic_corpus()], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, item, {k for k, _, y in toxic_corpus() if y}


def test_stages(spark, folder):
    path, rows, item, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    text = {r[0]: r[1] for r in rows}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "simhash", "decontamination", "bpe"]

    kept = corpus_pipeline.drop_toxic(spark, docs, path)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & toxic) <= 0.05 * len(toxic) and len(ids - toxic) >= 0.98 * (len(text) - len(toxic))

    found = corpus_pipeline.keep_identified(spark, docs, path)
    assert found.columns == docs.columns
    assert set(text) - {r.doc_id for r in found.collect()} == {5002, 5003}

    once = corpus_pipeline.drop_near_copies(spark, docs, path)
    assert once.columns == docs.columns
    groups = {}
    for key, value in text.items():
        groups.setdefault(int(simhash.text_fingerprints([value])[0]), []).append(key)
    got = {r.doc_id for r in once.collect()}
    assert 5000 not in got and all(sum(k in got for k in g) <= 1 for g in groups.values())

    clean = corpus_pipeline.drop_contaminated(spark, docs, path)
    assert clean.columns == docs.columns
    dirty = {k for k, _, hits, _ in windows_brute([r[:2] for r in rows], [(1, item)], 10) if hits}
    assert {str(k) for k in text} - {str(r.doc_id) for r in clean.collect()} == dirty == {"5001"}


def test_run_encodes_what_is_left(spark, folder):
    from tokenizers import Tokenizer

    path, rows, _, toxic = folder
    text = {r[0]: r[1] for r in rows}
    tok = Tokenizer.from_file(queries.tokenizer_path())
    out = corpus_pipeline.run(spark, path).collect()
    assert 0.6 * len(rows) < len(out) < len(rows)
    for r in out:
        ids = tok.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
