"""Near copies against all pairs compared."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ontospark.llm import nearcopies, simhash
from tests.llm.test_operators import DOCS, TEXTS, brute_components, lower


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9


def planted(seed=5):
    """Texts of many lengths, copies with a word in fifty replaced, chains of copies, and shared paragraphs."""
    rng = random.Random(seed)
    new = lambda n: [str(rng.randrange(10**6)) for _ in range(n)]
    shared, texts = new(40), []
    for n in (3, 5, 8, 12, 30, 100, 100, 300, 1000):
        base = new(n)
        texts.append(base)
        for _ in range(4):
            copy = list(base)
            for k in rng.sample(range(n), max(1, n // 50)):
                copy[k] = str(rng.randrange(10**6))
            texts.append(copy)
            base = copy if rng.random() < 0.5 else base
    texts += [shared + new(rng.randint(1, 60)) for _ in range(30)] + [shared[:3] * 20, new(200) + shared]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return [(100 + k, t) for k, (_, t) in enumerate(rows)]


def test_bitmaps_differ_no_more_than_sets():
    rng = np.random.default_rng(2)
    for n in (1, 5, 100, 3000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.r_[x[rng.random(len(x)) < 0.8], rng.integers(0, 1 << 63, n // 3 + 1).astype(np.uint64)])
        a, b = nearcopies.bitmaps(np.r_[x, y], np.array([len(x), len(y)]))
        assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("tile,common,heavy", [(1024, 8, 16), (4, 8, 2), (4, 10**9, 10**9)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, tile, common, heavy):
    monkeypatch.setattr(nearcopies, "COMMON", common)
    monkeypatch.setattr(nearcopies, "HEAVY", heavy)
    monkeypatch.setattr(nearcopies, "CENTRES", 1 + heavy % 2)
    rows = [*TEXTS, *planted()]
    got = sorted((str(r.id), r.component) for r in nearcopies.near_copy_components(spark.createDataFrame(rows, DOCS), tile=tile).collect())
    comp = brute_components([(k, shingles(t)) for k, t in rows], similar)
    assert got == sorted((str(k), c) for (k, _), c in zip(rows, comp))


def test_stage_drops_near_copies_that_differ_in_many_bits(spark):
    rows = planted()
    comp = brute_components([(k, shingles(t)) for k, t in rows], similar)
    docs = spark.createDataFrame(rows, DOCS).withColumn("cls", F.lit("x")).withColumn("kept_id", F.lit(1)).withColumn("TH", F.lit(2))
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert kept == {k for (k, _), c in zip(rows, comp) if k == c}
    by_bits = {r.id for r in simhash.simhash_components(docs).where("id = component").collect()}
    assert len(by_bits) > len(kept)
    assert nearcopies.deduplicate(docs.limit(0)).count() == 0


def test_rows_are_told_apart_when_ids_repeat(spark):
    x, y = "a b c d e f g h", "p q r s t u v w"
    near = "a b c d e f g h " * 10
    kept = lambda rows: sorted((str(r.doc_id), r.text) for r in nearcopies.deduplicate(spark.createDataFrame(rows, DOCS)).collect())
    assert kept([(5, x), (5, y), (7, x)]) == [("5", x), ("5", y)]
    assert kept([(2, y), (5, x), (5, y)]) == [("2", y), ("5", x)]
    assert kept([(None, x), (None, x), (None, y), (3, y), (4, None), (6, "")]) == [("3", y), ("4", None), ("None", x)]
    assert kept([(1, near), (1, near), (1, near), (2, near + "z")]) == [("1", near)]
    strings = spark.createDataFrame([("b", x), ("a", x), ("c", y)], "doc_id string, text string")
    assert sorted(r.doc_id for r in nearcopies.deduplicate(strings).collect()) == ["a", "c"]
