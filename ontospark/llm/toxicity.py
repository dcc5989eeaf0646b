"""Toxicity by multiple-instance learning.

A document is a bag of sentences of which only the bag is labelled. A sentence
scores p = sigmoid(sum of its words' weights + bias), a document scores the
noisy-or 1 - product(1 - p) over its sentences, and the weights are learned
from the documents' labels through that formula, so the sentence scores tell
where the offence stands. Words are hashed; weights are kept sparse by L1.

The fit takes a bounded sample of labelled documents: the first by a hash of
their id and text, ``SAMPLE_DOCS`` of them and ``SAMPLE_BYTES`` of text at
most (a text that goes beyond it by itself teaches nothing). Scoring covers
every whole text. Null and empty texts have no sentence and score 0. An id with
several labels is toxic if one of them says so; of an id with several texts
each counts as a document, and equal rows count once. Null labels and null ids
teach nothing. Without labels, or labels of one kind only, all scores are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontospark.llm.words import chunks, lean, scan
from ontospark.runtime import drop_materialized, materialize

#: Labelled documents that the model is fitted on, at most.
SAMPLE_DOCS = 12_000
#: UTF-8 bytes of their texts, at most.
SAMPLE_BYTES = 64 << 20
#: Slots that words are hashed to.
SLOTS = 1 << 18
#: Lengths in bytes of the words' beginnings that count.
HEADS = (4, 6)
#: A feature gets a weight if so many toxic documents have it, so many times as often as others.
LEAST_DOCS, LEAST_RATIO = 3, 2.0
FOLDS = 5
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n|;"]] = True


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def sentences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of each word's features; the first word of each sentence; sentences per text; words per text."""
    found = scan([(t or "").encode() for t in texts], HEADS)
    slots = np.stack([found.hashes, *(h + np.uint64(k + 1) for k, h in enumerate(found.heads))], axis=1)
    slots = (slots % np.uint64(SLOTS)).astype(np.int32)
    number = np.cumsum(_ENDS[found.data])[found.starts] if len(found.starts) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.zeros(0, np.int64)
    bounds = np.searchsorted(first, np.cumsum(found.counts))
    return slots, first, np.diff(np.r_[0, bounds]), found.counts


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sentence_logits(model: Model, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(model.weights[slots].sum(axis=1), first) + model.bias if len(first) else np.zeros(0)


def document_scores(model: Model, texts: list[str | None]) -> np.ndarray:
    slots, first, counts, _ = sentences(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    survive = np.bincount(owner, _softplus(sentence_logits(model, slots, first)), len(texts))
    return -np.expm1(-survive)


def useful_slots(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Which slots get a weight, by the number of toxic and clean documents that have them."""
    return (toxic >= LEAST_DOCS) & ((toxic + 0.5) / (n_toxic + 1) >= LEAST_RATIO * (clean + 0.5) / (n_clean + 1))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], total: np.ndarray, labels: np.ndarray, rounds: int = 200, rate: float = 0.1, l1: float = 2e-5) -> Model:
    """Weights by proximal Adam on the noisy-or likelihood, from each document's useful slots, the sentences they are in, and its number of sentences.

    Sentences without a useful slot score the bias alone and are only counted.
    """
    if not bags or labels.min() == labels.max():
        return Model(np.zeros(SLOTS), 30.0 if len(bags) and labels[0] else -30.0)
    positive = labels.astype(float)
    owner = np.repeat(np.arange(len(bags)), [len(s) for s, _ in bags])
    slots, local = (np.concatenate([b[n].astype(np.int64) for b in bags]) for n in (0, 1))
    used, slots = np.unique(slots, return_inverse=True)
    place, sentence = np.unique(owner * (1 << 32) + local, return_inverse=True)
    bag = place >> 32
    empty = total - np.bincount(bag, minlength=len(bags))
    w, b = np.zeros(len(used)), -np.log(max(1.0, total.mean()) * 4)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(sentence, w[slots], len(place)) + b
        p, p0 = 1 / (1 + np.exp(-np.clip(z, -40, 40))), 1 / (1 + np.exp(-b))
        clean = np.exp(-np.bincount(bag, _softplus(z), len(bags)) - empty * _softplus(b))
        pull = np.where(positive > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0) / len(bags)
        grad = p * pull[bag]
        g, gb = np.bincount(slots, grad[sentence], len(used)), grad.sum() + (p0 * pull * empty).sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate / (1 + t / rounds)
        scale = np.sqrt(v / (1 - 0.99**t)) + 1e-6
        w -= step * (m / (1 - 0.9**t)) / scale
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1 / scale, 0)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    weights = np.zeros(SLOTS)
    weights[used] = w
    return Model(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from the labelled documents that aren't held out; the sample's numbers, not texts, are sorted."""
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    wanted = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.octet_length(text_col).alias("bytes"), F.col(text_col).alias("text")).where("bytes > 0")
    # Ids may repeat, so the bound is kept by rows of id and text.
    listed = slim.join(F.broadcast(wanted), "id").select("id", "th", "bytes", "label").distinct().orderBy(F.xxhash64("id", "th"), "id", "th").limit(sample).collect()
    taken, left = [], sample_bytes
    for r in listed:
        if r["bytes"] <= left:
            left -= r["bytes"]
            taken.append((r["id"], r["th"], r["label"]))
    kinds = T.StructType([slim.schema["id"], T.StructField("th", T.LongType()), T.StructField("label", T.IntegerType())])
    chosen = spark.createDataFrame(taken, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                slots, first, many, _ = sentences([text.as_py()])
                number = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(slots)])) if len(first) else first
                # Each feature of a sentence once: what a repeated word says twice adds nothing here.
                once = np.unique(number[:, None] * SLOTS + slots)
                packed = [pa.array([x.astype("<i4").tobytes()]) for x in (once % SLOTS, once // SLOTS)]
                yield pa.RecordBatch.from_arrays([*packed, pa.array(many.astype(np.int32)), pa.array([label.as_py()], pa.int32())], names=["slots", "sentence", "total", "label"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, SLOTS), np.int64)
        for batch in batches:
            for slots, label in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                seen[int(label > 0)][np.unique(np.frombuffer(slots, "<i4"))] += 1
        at = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[1][at]), pa.array(seen[0][at])], names=["slot", "toxic", "clean"])

    texts = slim.join(F.broadcast(chosen), ["id", "th"]).dropDuplicates(["id", "th"]).select("text", "label")
    rows = materialize(texts.mapInArrow(lean(run), "slots binary, sentence binary, total int, label int"), "features")
    many = {int(r["label"] > 0): r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    counts = rows.repartition(4).mapInArrow(lean(count), "slot long, toxic long, clean long").groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    useful = np.zeros(SLOTS, bool)
    for r in counts.where(F.col("toxic") >= LEAST_DOCS).collect():
        useful[r["slot"]] = useful_slots(np.int64(r["toxic"]), np.int64(r["clean"]), many.get(1, 0), many.get(0, 0))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list[bytes], list[bytes]] = ([], [])
            for slots, sentence in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                slots, sentence = np.frombuffer(slots, "<i4"), np.frombuffer(sentence, "<i4")
                out[0].append(slots[useful[slots]].tobytes())
                out[1].append(sentence[useful[slots]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), *batch.columns[2:]], names=batch.schema.names)

    found = [(bytes(r["slots"]), bytes(r["sentence"]), r["total"], r["label"]) for r in rows.mapInArrow(lean(keep), rows.schema).collect() if r["total"]]
    drop_materialized(rows)
    found.sort()  # sums don't depend on the tasks' order
    bags = [(np.frombuffer(s, "<i4"), np.frombuffer(k, "<i4")) for s, k, _, _ in found]
    return fit(bags, np.array([t for _, _, t, _ in found]), np.array([y for _, _, _, y in found]))


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text as ``out_col``, a name that ``docs`` hasn't, or its column is replaced."""
    if out_col.lower() == text_col.lower():
        raise ValueError("the score can't replace the text")
    docs = docs.drop(out_col)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch.column(at)):
                found = document_scores(shared.value, texts)
                yield pa.RecordBatch.from_arrays([*batch.slice(part.start, part.stop - part.start).columns, pa.array(found)], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())]))


def offending_sentences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``(id, sentence, score, text)``: sentences that score ``least`` or more by themselves, by number within their text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, scores, found = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                raw = (text or "").encode()
                words = scan([raw])
                slots, first, _, _ = sentences([text])
                p = 1 / (1 + np.exp(-np.clip(sentence_logits(shared.value, slots, first), -40, 40)))
                last = np.r_[first[1:], len(slots)] - 1
                for s in np.flatnonzero(p >= least).tolist():
                    ids.append(k), numbers.append(s), scores.append(float(p[s]))
                    found.append(raw[words.starts[first[s]] : words.ends[last[s]]].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(numbers, pa.int64()), pa.array(scores, pa.float64()), pa.array(found, pa.string())], names=["id", "sentence", "score", "text"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(lean(run), T.StructType([slim.schema["id"], T.StructField("sentence", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("text", T.StringType())]))
