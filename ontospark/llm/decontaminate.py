"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z
lower-cased. An item with at least ``span`` words is searched by its windows
of ``span`` words, a shorter one as a single window. For windows of L words,
k-grams with k = ceil(L/2) are hashed, and of every L-k+1 consecutive ones the
smallest hash is kept as a fingerprint. Two texts that share L words share a
fingerprint inside them, so the join of document and benchmark fingerprints
misses no shared span. The hits are extended to the windows around them, and
those are joined with the items' windows on the words themselves.

What holds of a text holds of every row with that text, so rows are never told
apart by their ids: results are kept by two hashes of the text (96 bits) and
joined back to all its rows. Ids of documents and items may be of any type.

Null and empty texts have no words: such documents are clean and such items
match nothing. Repeated documents and items are judged row by row, alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontospark.llm.words import IS_WORD, LOWER, ODD, chunks, fresh, grams, lean, mix, scan
from ontospark.runtime import drop_materialized, materialize

SPAN = 10
#: Rows (a few numbers each) up to which a table goes to every task rather than through a shuffle.
BROADCAST_ROWS = 1 << 20
_FIND = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` one after the other, and the number of words in each."""
    found = scan(texts)
    return found.hashes, found.counts


def count_words(texts: list[str | None]) -> np.ndarray:
    raw = [(t or "").encode() for t in texts]
    inside = np.r_[False, IS_WORD[LOWER[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]]]
    starts = np.r_[0, np.cumsum(inside[1:] & ~inside[:-1])]
    bounds = np.r_[0, np.cumsum([len(t) + 1 for t in raw])].astype(np.int64)
    return np.diff(starts[bounds]) if len(raw) else np.zeros(0, np.int64)


def words_of(text: str | None) -> list[bytes]:
    return _FIND(text.encode().lower()) if text else []


def winnow(words: np.ndarray, counts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept k-grams of texts that lie one after the other in ``words``."""
    k = -(-span // 2)
    wide = span - k + 1
    hashes = grams(words, k)
    windows = len(words) - span + 1
    if windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, at = hashes[:windows].copy(), np.arange(windows)
    for j in range(1, wide):
        new = hashes[j : j + windows]
        better = new <= least
        least = np.where(better, new, least)
        at = np.where(better, np.arange(windows) + j, at)
    last = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    whole = np.arange(windows) + span <= last[owner[:windows]]
    at = np.unique(at[whole])
    return at, hashes[at]


def _key(size: int, hashes: np.ndarray) -> np.ndarray:
    """Fingerprints of windows of different lengths don't meet."""
    return mix(hashes + np.uint64(size * int(ODD) % (1 << 64))).view(np.int64)


def _text_keys(text_col: str) -> list[Column]:
    """Two hashes that stand for a text."""
    return [F.xxhash64(text_col).alias("th"), F.crc32(F.col(text_col).cast("binary")).alias("tc")]


def _item_windows(items: DataFrame, span: int) -> DataFrame:
    """``(item, size, window)`` for every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch.column(1)):
                owners, sizes, found = [], [], []
                for k, text in enumerate(texts, part.start):
                    words = words_of(text)
                    size = min(span, len(words))
                    for a in range(len(words) - size + 1 if words else 0):
                        owners.append(k), sizes.append(size), found.append(b" ".join(words[a : a + size]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), pa.array(sizes, pa.int32()), pa.array(found, pa.binary())], names=["item", "size", "window"])

    return items.mapInArrow(lean(run), T.StructType([items.schema["item"], T.StructField("size", T.IntegerType()), T.StructField("window", T.BinaryType())]))


def _window_prints(windows: DataFrame) -> DataFrame:
    """``(print)``: the fingerprint of each window; those of a text's windows are those of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(0).to_numpy()
            for size in np.unique(sizes).tolist():
                words, counts = hash_words(batch.column(1).filter(pa.array(sizes == size)).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_key(size, winnow(words, counts, size)[1])))], names=["print"])

    return windows.select("size", "window").mapInArrow(lean(run), "print long").distinct()


def _document_prints(slim: DataFrame, sizes: list[int]) -> DataFrame:
    """``(th, tc, size, at, print)``: the fingerprints of each text for windows of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch.column(2)):
                th, tc = (batch.column(k)[part.start : part.stop] for k in (0, 1))
                words, counts = hash_words([(t or "").encode() for t in texts])
                last = np.cumsum(counts)
                for size in sizes:
                    at, hashes = winnow(words, counts, size)
                    owner = np.searchsorted(last, at, "right")
                    first = (last - counts)[owner] if len(at) else at
                    own = pa.array(owner)
                    yield pa.RecordBatch.from_arrays([th.take(own), tc.take(own), pa.array(np.full(len(at), size, np.int32)), pa.array(at - first), pa.array(_key(size, hashes))], names=["th", "tc", "size", "at", "print"])

    return slim.select("th", "tc", "text").mapInArrow(lean(run), "th long, tc long, size int, at long, print long")


def _extended(texts: DataFrame) -> DataFrame:
    """``(th, tc, size, start, window)``: every window around the hits ``ats`` of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, sizes, starts, found = [], [], [], []
            for row, (text, ats) in enumerate(zip(batch.column(2), batch.column(3))):
                words = words_of(text.as_py())
                hits: dict[int, set[int]] = {}
                for x in ats.as_py():
                    hits.setdefault(x["size"], set()).update(range(x["at"] - (x["size"] - -(-x["size"] // 2)), x["at"] + 1))
                for size, near in hits.items():
                    for a in sorted(a for a in near if 0 <= a <= len(words) - size):
                        owners.append(row), sizes.append(size), starts.append(a), found.append(b" ".join(words[a : a + size]))
            own = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(1).take(own), pa.array(sizes, pa.int32()), pa.array(starts, pa.int64()), pa.array(found, pa.binary())], names=["th", "tc", "size", "start", "window"]
            )

    return texts.mapInArrow(lean(run), "th long, tc long, size int, start long, window binary")


def _met(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, span: int) -> DataFrame:
    """``(th, tc, size, start, item)``: where each item's windows occur in each text."""
    slim = docs.select(*_text_keys(text_col), F.col(text_col).alias("text")).where(F.octet_length("text") > 0)
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    windows = materialize(_item_windows(items, span).distinct(), "windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # no more than ``span``
    prints = materialize(_window_prints(windows), "prints")
    few = prints.count() <= BROADCAST_ROWS
    hits = _document_prints(slim, sizes).join(F.broadcast(prints) if few else prints, "print").select("th", "tc", "size", "at")
    hits = materialize(hits.groupBy("th", "tc").agg(F.collect_set(F.struct("size", "at")).alias("ats")), "hits")
    few = (hits.agg(F.sum(F.size("ats"))).first()[0] or 0) <= BROADCAST_ROWS
    around = _extended(slim.join(F.broadcast(hits) if few else hits, ["th", "tc"]).select("th", "tc", "text", "ats"))
    met = materialize(around.join(windows, ["size", "window"]).select("th", "tc", "size", "start", "item").distinct(), "met")
    drop_materialized(windows, prints, hits)
    return met


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN) -> DataFrame:
    """``(id, n_words, hits, items)`` per row of ``docs``: word positions inside item windows, and those items, sorted.

    Items whose id is null are left out of ``items``; the words they hit count.
    """
    met = _met(docs, benchmark, text_col, item_col, item_text_col, span)
    places = F.sequence("start", F.col("start") + F.col("size") - 1)
    per_text = materialize(met.groupBy("th", "tc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(places)))).alias("hits"), F.array_sort(F.collect_set("item")).alias("items")), "spans")
    drop_materialized(met)
    slim = docs.select(F.col(id_col).alias("id"), *_text_keys(text_col), F.col(text_col).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch.column(3)):
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(count_words(texts))], names=["id", "th", "tc", "n_words"])

    kinds = T.StructType([*slim.schema.fields[:3], T.StructField("n_words", T.LongType())])
    few = (per_text.agg(F.sum(F.size("hits") + F.size("items"))).first()[0] or 0) <= BROADCAST_ROWS
    out = slim.mapInArrow(lean(counted), kinds).join(F.broadcast(per_text) if few else per_text, ["th", "tc"], "left")
    none = [F.array().cast(per_text.schema[c].dataType) for c in ("hits", "items")]
    return out.select("id", "n_words", F.coalesce("hits", none[0]).alias("hits"), F.coalesce("items", none[1]).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN) -> DataFrame:
    """The rows of ``docs`` without those that hold a window of an item; all columns stay, of any name.

    Rows are judged by their text alone: null and repeated ids don't matter.
    """
    th, tc = fresh(docs.columns, "dirty_th", "dirty_tc")
    met = _met(docs, benchmark, text_col, item_col, item_text_col, span)
    dirty = materialize(met.select(F.col("th").alias(th), F.col("tc").alias(tc)).distinct(), "dirty")
    drop_materialized(met)
    few = dirty.count() <= BROADCAST_ROWS
    own = _text_keys(text_col)
    return docs.join(F.broadcast(dirty) if few else dirty, (own[0] == dirty[th]) & (own[1] == dirty[tc]), "left_anti")
