"""Near-duplicate detection by SimHash, with deletion-variant signatures as the index.

Fingerprints are 64 bits. Two of them that differ in at most three bits have,
when cut into two segments, a segment that differs in at most one bit. So each
segment is indexed once per bit position with that bit as a wildcard; linked
fingerprints share at least one such key, and an equality join on the keys
followed by a check of the whole fingerprints finds every link.

Null and empty texts have no words and so fingerprint zero, which links like
any other. Copies collapse into their fingerprint before anything is joined, so
repeated rows are no group of their own. Rows without an id get a fingerprint
and the component of that fingerprint. Ids may be of any type with an order.
Removing near copies from a corpus is ``nearcopies.deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontospark.llm.words import chunks, lean
from ontospark.runtime import connected_components, drop_materialized, materialize

SEGMENTS, BITS = 2, 32
MAX_DISTANCE = 3
#: Hashes whose bits are counted at once; bounds a task's memory for texts of any length.
CHUNK = 1 << 17
#: Members of one key that a single comparison block holds; larger keys are cut into blocks.
TILE = 1024
#: Fingerprints per task when their variants are made.
SPREAD = 8192


def _shingle_hashes(words: list[bytes], width: int, seed: int) -> list[int]:
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return [digest(b" ".join(words), seed)]
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())]


def _bit_counts(hashes: list[int], bounds: list[int]) -> np.ndarray:
    """How often each bit is set in each run of ``hashes``; ``bounds`` are the runs' starts."""
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, bounds, axis=0, dtype=np.int64)


def text_fingerprints(texts: list[str | None], width: int = 3, seed: int = 42) -> np.ndarray:
    """The SimHash of each text as an unsigned 64-bit integer."""
    counts, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    bounds: list[int] = []
    owners: list[int] = []

    def flush() -> None:
        if hashes:
            np.add.at(counts, owners, _bit_counts(hashes, bounds))
        for kept in (hashes, bounds, owners):
            kept.clear()

    for k, text in enumerate(texts):
        words = text.encode().lower().split() if text else []
        for at in range(0, max(1, len(words) - width + 1) if words else 0, CHUNK):
            found = _shingle_hashes(words[at : at + CHUNK + width - 1], width, seed)
            bounds.append(len(hashes))
            owners.append(k)
            hashes.extend(found)
            totals[k] += len(found)
            if len(hashes) >= CHUNK:
                flush()
    flush()
    on = (2 * counts > totals[:, None]).astype(np.uint8)
    return np.packbits(on, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)``: one row per row of ``docs``; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch.column(1)):
                fp = text_fingerprints(texts).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.array(fp)], names=["id", "fp"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(lean(run), T.StructType([slim.schema["id"], T.StructField("fp", T.LongType())]))


def _variants(fps: DataFrame) -> DataFrame:
    """``(key, side, fp)``: for each segment and bit the segment without that bit, and the bit."""
    def signature(k: Column) -> Column:
        seg = F.when(k < BITS, F.col("fp").bitwiseAND(F.lit((1 << BITS) - 1))).otherwise(F.shiftrightunsigned("fp", BITS))
        return F.struct(k.alias("k"), seg.alias("seg"))

    rows = fps.select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS * BITS - 1)), signature)).alias("s"))
    bit = F.expr(f"shiftleft(1L, s.k % {BITS})")
    return rows.select(
        F.expr(f"shiftleft(cast(s.k as bigint), {BITS})").bitwiseOR(F.col("s.seg").bitwiseAND(F.bitwise_not(bit))).alias("key"),
        (F.col("s.seg").bitwiseAND(bit) != 0).cast("int").alias("side"),
        "fp",
    )


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; of signed numbers numpy would count those of the absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _spanning_links(fp: np.ndarray, side: np.ndarray, first: bool, cross: np.ndarray | None) -> list[tuple[int, int]]:
    """Tree edges of the links within one block: breadth first, so each row is compared once with the rest.

    ``first``: the key's bit is the lowest, where segments that are equal count
    too; elsewhere only rows that differ in the key's bit do. ``cross``: the
    part each row is from, where only links between the parts are sought.
    """
    edges = []
    left = np.arange(len(fp))
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            k = todo.pop()
            near = _distance(fp[left], fp[k]) <= MAX_DISTANCE
            if not first:
                near &= side[left] != side[k]
            if cross is not None:
                near &= cross[left] != cross[k]
            found = left[near]
            edges.extend((int(fp[k]), int(fp[x])) for x in found)
            todo.extend(found.tolist())
            left = left[~near]
    return edges


def _link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the blocks in rows sorted by ``(key, i, j)``; blocks may go on in the next batch."""

    def edges(t: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, (t["key"][1:] != t["key"][:-1]) | (t["i"][1:] != t["i"][:-1]) | (t["j"][1:] != t["j"][:-1])])
        ends = np.r_[starts[1:], len(t)]
        out = []
        pairs = starts[ends - starts == 2]
        x, y = t[pairs], t[pairs + 1]
        fit = _distance(x["fp"], y["fp"]) <= MAX_DISTANCE
        fit &= ((x["key"] >> BITS) % BITS == 0) | (x["side"] != y["side"])
        fit &= (x["i"] == x["j"]) | (x["tile"] != y["tile"])
        out.extend(zip(x["fp"][fit].tolist(), y["fp"][fit].tolist()))
        for a, b in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
            r = t[a:b]
            out.extend(_spanning_links(r["fp"], r["side"], (int(r["key"][0]) >> BITS) % BITS == 0, r["tile"] if r["i"][0] != r["j"][0] else None))
        pairs_out = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs_out[:, 0]), pa.array(pairs_out[:, 1])], names=["a", "b"])

    kind = np.dtype([("key", "i8"), ("i", "i4"), ("j", "i4"), ("tile", "i4"), ("side", "i4"), ("fp", "i8")])
    rest = np.zeros(0, kind)
    for batch in batches:
        if not batch.num_rows:
            continue
        now = np.zeros(batch.num_rows, kind)
        for name in kind.names:
            now[name] = batch.column(batch.schema.get_field_index(name)).to_numpy()
        rest = np.concatenate([rest, now])
        same = (rest["key"] == rest["key"][-1]) & (rest["i"] == rest["i"][-1]) & (rest["j"] == rest["j"][-1])
        cut = len(rest) - int(same.sum())
        if cut:
            yield edges(rest[:cut])
            rest = rest[cut:]
    if len(rest):
        yield edges(rest)


def fingerprint_links(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """``(a, b)``: enough links between distinct fingerprints ``fp`` to connect all that are linked.

    Keys with one member, or whose members all agree in the wildcard bit (their
    links show at the segment's lowest bit), go before the members are joined
    to them. A key with more than ``tile`` members is cut into blocks of about
    that size, and every pair of blocks is compared in a group of its own, so
    no task holds a key's whole group and no link is left out.
    """
    # A few rows become 64 each, so they are spread by their number first.
    rows = _variants(fps.repartition(max(1, -(-fps.count() // SPREAD)), "fp"))
    low = F.shiftright("key", BITS) % BITS == 0
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("side").alias("s0"), F.max("side").alias("s1"))
    keys = keys.where((F.col("n") > 1) & (low | (F.col("s0") < F.col("s1")))).select("key", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    # Spark takes the variants to be no larger than the fingerprints, so it is told not to broadcast them.
    found = rows.hint("merge").join(keys, "key").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    found = found.select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "side", "fp")
    parts = found.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return parts.mapInArrow(lean(_link_blocks), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component)``: per row its fingerprint and the smallest id reachable over links."""
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    linked = connected_components(fingerprint_links(classes.select("fp")), "a", "b")
    named = classes.join(linked, classes.fp == linked.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    named = materialize(named, "named")
    least = named.groupBy("c").agg(F.min("least").alias("component"))
    of_class = materialize(named.select("fp", "c").join(least, "c").select("fp", "component"), "components")
    drop_materialized(classes, linked, named)
    return rows.join(of_class.hint("merge"), "fp").select("id", "fp", "component")
