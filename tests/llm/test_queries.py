"""The query of every operator on the smallest tables: the contract's columns, against SQL or a plain version."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from ontospark.llm import langid, queries, toxicity
from tests.llm.test_operators import brute_components, fingerprint_brute

FOLDER = "/root/testdata/sf0.001"


def table(name):
    return duckdb.sql(f"SELECT * FROM '{FOLDER}/{name}.parquet'").to_arrow_table().to_pylist()


def rows(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    return df.columns, [r.asDict() for r in df.collect()]


def held_out(key):
    return zlib.crc32(str(key).encode()) % 5 == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    columns, got = rows(spark, name)
    want = con.sql(queries.ORACLE_SQL[name]).to_arrow_table().to_pylist()
    plain = lambda some: sorted(str(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in sorted(columns))) for r in some)
    assert set(want[0]) == set(columns) and plain(got) == plain(want)


def test_op1(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    columns, got = rows(spark, "op1_bpe")
    assert columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for d in table("documents"):
        ids = tok.encode(d["text"] or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        want.append((d["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(tuple(r[c] for c in columns[:4]) for r in got) == sorted(want)


def test_op3(spark):
    columns, got = rows(spark, "op3_toxicity")
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert sorted(r["doc_id"] for r in got) == sorted(d["doc_id"] for d in table("documents"))
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_op7(spark):
    columns, got = rows(spark, "op7_language")
    assert columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    docs = {d["doc_id"]: d for d in table("documents")}
    known = {d["lang"] for k, d in docs.items() if not held_out(k)} - {None}
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        text = docs[r["doc_id"]]["text"] or ""
        letters = any(c.isalpha() for c in text)
        assert r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and (r["lang_pred"] in known if letters else r["lang_pred"] == "und")


def test_op9(spark):
    columns, got = rows(spark, "op9_simhash")
    assert columns[:3] == ["doc_id", "fingerprint", "component_id"]
    prints = [(d["doc_id"], fingerprint_brute(d["text"])) for d in table("documents")]
    comp = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    assert sorted(tuple(r[c] for c in columns[:3]) for r in got) == sorted((k, f"{f:016x}", c) for (k, f), c in zip(prints, comp))


def test_op10(spark):
    columns, got = rows(spark, "op10_sharding")
    assert columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    want = sorted((d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in table("documents"))
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    shards = {}
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        shards.setdefault(r["shard"], []).append(r)
    assert sorted(shards) == list(range(8)) and all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in shards.values())


def plain_mixture(probs, count, rounds=20000):
    theta = np.full(probs.shape[1], 1 / probs.shape[1])
    for _ in range(rounds):
        joint = probs * theta
        new = ((joint / joint.sum(axis=1, keepdims=True)) * count[:, None]).sum(axis=0) / count.sum()
        still = np.abs(new - theta).max() <= langid.STILL
        theta = new
        if still:
            break
    return theta, float((count * np.log((probs * theta).sum(axis=1))).sum())


def test_language_mixtures_are_those_of_plain_em():
    """Every document by itself, with the sets of the k largest languages tried one after the other."""
    texts = [d["text"] for d in table("documents")][:60] + [None, "a", "ÿ", "1 2", "", "x" * 5000]
    docs = [(d["text"], d["lang"]) for d in table("documents") if d["text"] and d["lang"] and not held_out(d["doc_id"])]
    counts = {}
    for text, lang in docs:
        _, slot, many = langid.trigrams([text])
        counts[lang] = counts.get(lang, 0) + np.bincount(slot, many, langid.SLOTS)
    model = langid.learn(counts)
    names, scores, sets = langid.predict(model, texts)
    langs = len(model.languages)
    for text, name, score, found in zip(texts, names, scores, sets):
        if not text or not any(c.isalpha() for c in text):
            assert (name, score, found) == ("und", 0.0, [])
            continue
        _, slot, many = langid.trigrams([text])
        probs = model.grams[slot]
        order = np.argsort(-plain_mixture(probs, many)[0][:langs], kind="stable")
        best, share, chosen = -np.inf, None, None
        for k in range(1, langs + 1):
            theta, likelihood = plain_mixture(probs[:, [*order[:k], langs]], many)
            value = likelihood / langid.OVERLAP - k * np.log(max(many.sum(), 2)) / 2
            if value <= best:
                break
            best, share, chosen = value, theta[:k] / theta[:k].sum(), order[:k]
        assert name == model.languages[chosen[share.argmax()]] and abs(score - share.max()) < 1e-9
        assert found == sorted(model.languages[x] for x, s in zip(chosen, share) if s > 0)
        # A text's result doesn't depend on its neighbours.
        alone = langid.predict(model, [text])
        assert (alone[0][0], alone[2][0]) == (name, found) and abs(alone[1][0] - score) < 1e-9


def plain_loss(weights, bias, bags, total, labels):
    out = 0.0
    for (slots, sentence), n, y in zip(bags, total, labels):
        clean = 1.0
        for s in range(n):
            clean *= 1 - 1 / (1 + np.exp(-(bias + weights[slots[sentence == s]].sum())))
        out -= np.log(max(1 - clean if y else clean, 1e-12))
    return out / len(bags)


def test_fit_minimises_the_plain_noisy_or_loss():
    rng = np.random.default_rng(5)
    bags, labels, total = [], [], []
    for k in range(80):
        n = int(rng.integers(1, 5))
        slots = rng.integers(0, 12, size=3 * n)
        bags.append((slots, np.repeat(np.arange(n), 3)))
        total.append(n)
        labels.append(int((slots == 3).any() ^ (rng.random() < 0.05)))
    total, labels = np.array(total), np.array(labels)
    model = toxicity.fit(bags, total, labels, rounds=2000, l1=0.0)
    weights, bias = model.weights[:12].copy(), model.bias
    found = plain_loss(weights, bias, bags, total, labels)
    assert found < 0.6 * plain_loss(np.zeros(12), -2.0, bags, total, labels)
    for _ in range(60):  # no nearby point is better by more than a hair
        assert found <= plain_loss(weights + rng.normal(size=12) * 0.05, bias + rng.normal() * 0.05, bags, total, labels) + 2e-3
