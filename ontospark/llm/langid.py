"""Language identification by mixture inference.

Each language is a distribution over hashed byte trigrams of lower-cased text.
A document is a mixture of languages and a uniform rest: expectation
maximisation, run until each document's proportions stand still, estimates
them, first of all languages and then, for k = 1, 2, ... of the k largest,
until the likelihood less a penalty for each language stops rising; the best
set is taken. The prediction is its largest member, the score that member's
share of the languages' part.

The distributions come from a bounded sample of the documents that aren't held
out: for each language the first by a hash of id and text, ``SAMPLE_DOCS`` of
them, or fewer where many languages share ``SAMPLE_ROWS``. Rows of one id with
different texts are documents of their own, equal rows count once. Prediction
covers every whole text and depends on that text alone. Null texts and texts
without a letter are ``und`` with score 0, as is everything where nothing was
learned; any letter gives a trigram, with the text's ends as spaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontospark.llm.toxicity import held_out
from ontospark.llm.words import CHUNK, LOWER, chunks, lean
from ontospark.runtime import drop_materialized, materialize

#: Documents of a language that its distribution is learned from, at most.
SAMPLE_DOCS = 4000
#: Languages that a model may have (more are an error): it is sent to every task.
MAX_LANGUAGES = 500
SLOTS = 1 << 16
#: Documents of all languages together that are learned from, at most.
SAMPLE_ROWS = 1 << 18
#: A document's proportions stand still when none moves by more in a round.
STILL = 1e-3
#: Neighbouring trigrams share bytes, so each counts as a third of an observation.
OVERLAP = 3.0
_LETTER = regex.compile(r"\p{L}").search


class Model(NamedTuple):
    languages: list[str]
    grams: np.ndarray  #: (slots, languages + 1): probabilities; the last column is the uniform rest


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, slot and count of each distinct trigram of each text; signs and digits count as spaces."""
    raw = [(t or "").encode() for t in texts]
    low = LOWER[np.frombuffer(b"".join(b"\n%b\n" % t for t in raw), np.uint8)]
    low = np.where((low >= 97) & (low < 123) | (low >= 128), low, 32).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in raw])
    a, b, c = low[:-2], low[1:-1], low[2:]
    fit = (owner[:-2] == owner[2:]) & ~((b == 32) & ((a == 32) | (c == 32)))
    slot = ((a * 31 + b) * 1009 + c * 7 + (a ^ (c << 3))) * np.uint32(2654435761) >> np.uint32(16)
    key, count = np.unique(owner[:-2][fit] * SLOTS + slot[fit], return_counts=True)
    return key // SLOTS, key % SLOTS, count


def learn(counts: dict[str, np.ndarray]) -> Model:
    names = sorted(counts)
    grams = np.stack([*[counts[n] for n in names], np.zeros(SLOTS)], axis=1).astype(float)
    total = grams.sum(axis=0)
    # A tenth of a count for each slot, so what a language hasn't shown is rare but possible.
    grams = (grams + 0.1) / (total + 0.1 * SLOTS)
    return Model(names, grams)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCS) -> Model:
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    rows = known.select("id", "lang", "th").withColumn("rank", F.xxhash64("id", "th"))
    # A hash threshold leaves each language about as many rows as are wanted, so none is sorted whole.
    counts = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    many = counts.count()
    if many > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sample = min(sample, max(1, SAMPLE_ROWS // max(1, many)))
    few = rows.join(F.broadcast(counts), "lang").where(F.pmod("rank", F.lit(1 << 30)) < F.lit(1.5 * (1 << 30) * sample) / F.col("n")).select("id", "lang", "th", "rank").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "id", "th"))
    chosen = materialize(few.withColumn("k", place).where(F.col("k") <= sample).select("id", "lang", "th"), "chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for part, texts in chunks(batch.column(1)):
                owner, slot, count = trigrams(texts)
                names = np.array(langs[part], object)
                for name in set(langs[part]):
                    own = np.flatnonzero(names == name)
                    fit = np.isin(owner, own)
                    sums[name] = sums.get(name, 0) + np.bincount(slot[fit], count[fit], SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype("<f8").tobytes() for v in sums.values()], pa.binary())], names=["lang", "counts"])

    texts = known.join(F.broadcast(chosen), ["id", "lang", "th"]).dropDuplicates(["id", "lang", "th"]).select("lang", "text")
    sums: dict[str, np.ndarray] = {}
    for r in texts.repartition(8, F.xxhash64("text")).mapInArrow(lean(run), "lang string, counts binary").toLocalIterator():
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.frombuffer(r["counts"], "<f8")
    drop_materialized(counts, chosen)
    return learn(sums)


def mixtures(probs: np.ndarray, owner: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the components for each document, by expectation maximisation, and the log-likelihood.

    ``probs``: a row for each observation, a column for each component; rows
    are sorted by their document ``owner`` and stand for ``count`` observations.
    """
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(owner)])
    docs, parts = len(starts), probs.shape[1]
    theta = np.full((docs, parts), 1 / parts)
    moving, p, c, own, at = np.arange(docs), probs, count, np.repeat(np.arange(docs), sizes), starts
    total = np.add.reduceat(count, starts).astype(float) if docs else np.zeros(0)
    while len(moving):
        joint = p * theta[moving][own]
        joint *= (c / joint.sum(axis=1))[:, None]
        new = np.add.reduceat(joint, at, axis=0) / total[moving][:, None]
        going = np.abs(new - theta[moving]).max(axis=1) > STILL
        theta[moving] = new
        if not going.all():  # documents that stand still leave the arrays
            kept = going[own]
            moving, p, c = moving[going], p[kept], c[kept]
            left = sizes[moving]
            own, at = np.repeat(np.arange(len(moving)), left), np.cumsum(left) - left
    likelihood = np.add.reduceat(count * np.log((probs * np.repeat(theta, sizes, axis=0)).sum(axis=1)), starts) if docs else np.zeros(0)
    return theta, likelihood


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[list[str]]]:
    """Language, score and the chosen language set of each text."""
    many, langs = len(texts), len(model.languages)
    best_name, best_score = ["und"] * many, np.zeros(many)
    sets: list[list[str]] = [[] for _ in range(many)]
    # Only texts with a letter take part; each of them has a trigram.
    named = np.array([k for k, t in enumerate(texts) if t and _LETTER(t)], np.int64)
    if not langs or not len(named):
        return best_name, best_score, sets
    owner, slot, count = trigrams([texts[k] for k in named])
    probs = model.grams[slot]
    theta, _ = mixtures(probs, owner, count)
    order = np.argsort(-theta[:, :langs], axis=1, kind="stable")
    penalty = np.log(np.maximum(np.bincount(owner, count, len(named)), 2)) / 2
    best, share = np.full(len(named), -np.inf), np.zeros((len(named), langs))
    rising = np.arange(len(named))
    for k in range(1, langs + 1):
        place = np.full(len(named), -1)
        place[rising] = np.arange(len(rising))
        rows = np.flatnonzero(place[owner] >= 0)
        mine = owner[rows]
        columns = np.c_[order[mine, :k], np.full(len(rows), langs)]
        fitted, likelihood = mixtures(np.take_along_axis(probs[rows], columns, axis=1), place[mine], count[rows])
        value = likelihood / OVERLAP - k * penalty[rising]
        better = value > best[rising]
        fitted, rising = fitted[better], rising[better]
        if not len(rising):
            break
        best[rising], share[rising] = value[better], 0.0
        np.put_along_axis(own := share[rising], order[rising, :k], fitted[:, :k] / np.maximum(fitted[:, :k].sum(axis=1, keepdims=True), 1e-300), axis=1)
        share[rising] = own
    for d, at in enumerate(named.tolist()):
        top = int(share[d].argmax())
        best_name[at], best_score[at] = model.languages[top], min(1.0, float(share[d, top]))
        sets[at] = [model.languages[x] for x in np.flatnonzero(share[d] > 0)]
    return best_name, best_score, sets


def identify(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``languages`` (the chosen set); columns of those names are replaced.

    ``prefix`` goes before the three names.
    """
    added = [prefix + n for n in ("lang_pred", "score", "languages")]
    if text_col.lower() in added:
        raise ValueError("a result can't replace the text")
    docs = docs.drop(*added)
    size = max(1 << 14, CHUNK // max(1, len(model.languages) // 8))  # a trigram takes a number for each language
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch.column(at), size):
                names, scores, sets = predict(shared.value, texts)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(part.start, part.stop - part.start).columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string()))], names=[*batch.schema.names, *added]
                )

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *map(T.StructField, added, [T.StringType(), T.DoubleType(), T.ArrayType(T.StringType())])]))
