"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors of cosine t or more lie within a squared distance of 2 - 2t. All
are turned by one fixed rotation and cut into blocks of a few dimensions; if
each block gets a share of that distance in proportion to its dimensions, a
linked pair keeps within it in at least one block. So each block is joined by
range on its own, and the union of the candidates is verified in full. A pair
counts in the first block that finds it and nowhere else.

The range join of a block deals vectors over grid cells two radii wide, in as
many of its dimensions as the number of vectors with the label asks for; a
vector meets the links of its own cell's vectors in every cell that its ball
touches. A cell that is still large, as one of near copies is, is cut into
tiles, and each pair of tiles is a group of its own. Links are counted where
they are found; of the edges, a spanning forest of each group goes on.

Equal vectors of a label are one class with a count. Vectors that are null,
empty, zero or hold null or non-finite numbers, and those without a label, link
with nothing. Vectors of different lengths don't link. Repeated ids are rows
like any other, and rows without an id take the component of their links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontospark.runtime import connected_components, materialize

THRESHOLD = 0.98
BLOCKS = 8
#: Vectors that a cell or tile holds.
TILE = 8192
#: Rows whose candidates are worked out at once.
ROWS = 256


def _blocks(dim: int) -> list[slice]:
    cuts = np.linspace(0, dim, min(BLOCKS, dim) + 1).round().astype(int)
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def _rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))[0]


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares of large numbers would overflow
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _dealt(threshold: float):
    """Rows, without the vectors, for each block and each grid cell that a vector's ball touches; ``home`` in its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                turned = _unit(_matrix(part.column(4), dim)) @ _rotation(dim)
                grid = part.column(3).to_numpy()
                for j, block in enumerate(_blocks(dim)):
                    width = block.stop - block.start
                    radius = np.sqrt((2 - 2 * threshold + 1e-9) * width / dim)
                    for g in np.unique(grid).tolist():
                        rows = np.flatnonzero(grid == g)
                        g = min(g, width)
                        own = turned[rows, block.start : block.start + g]
                        low, high = np.floor((own - radius) / (2 * radius)).astype(int), np.floor((own + radius) / (2 * radius)).astype(int)
                        at = np.floor(own / (2 * radius)).astype(int)
                        for side in product(*[(0, 1, 2)] * g):
                            cell = low + np.array(side, int)
                            fit = (cell <= high).all(axis=1)
                            if not fit.any():
                                continue
                            home = (cell == at).all(axis=1)[fit]
                            names = [",".join(map(str, c)) for c in cell[fit].tolist()]
                            sent = part.take(pa.array(rows[fit]))
                            yield pa.RecordBatch.from_arrays(
                                [sent.column(1), sent.column(2), pa.array(np.full(len(names), j, np.int32)), pa.array(names, pa.string()), sent.column(0), pa.array(home)],
                                names=["label", "dim", "block", "cell", "row", "home"],
                            )

    return run


def _group_links(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        dim, j = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
        unit = _unit(_matrix(table.column("embedding"), dim))
        turned, blocks = unit @ _rotation(dim), _blocks(dim)
        row, copies = table.column("row").to_numpy(), table.column("copies").to_numpy()
        # In a group of two tiles only rows of the first are asked for, and only with rows of the second.
        asked = np.flatnonzero(table.column("home").to_numpy() & table.column("asks").to_numpy())
        others = np.flatnonzero(table.column("answers").to_numpy())
        counts, comp = np.zeros(len(row), np.int64), np.arange(len(row))
        own, budget = turned[:, blocks[j]], (2 - 2 * threshold + 1e-9) / dim
        squares = (own**2).sum(axis=1)
        for at in range(0, len(asked), ROWS):
            a = asked[at : at + ROWS]
            near = squares[a, None] + squares[None, others] - 2 * own[a] @ own[others].T <= budget * own.shape[1] + 1e-9
            x, y = np.nonzero(near)
            x, y = a[x], others[y]
            fit = row[x] != row[y]
            x, y = x[fit], y[fit]
            first = _squared(own, x, y) <= budget * own.shape[1] + 1e-12
            for earlier in blocks[:j]:
                width = earlier.stop - earlier.start
                p = turned[:, earlier]
                first &= _squared(p, x, y) > budget * width + 1e-12
            x, y = x[first], y[first]
            linked = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
            x, y = x[linked], y[linked]
            np.add.at(counts, x, copies[y])
            for k in np.unique(x).tolist():
                met = np.unique(comp[np.r_[k, y[x == k]]])
                if len(met) > 1:
                    comp[np.isin(comp, met)] = met[0]
        found, moved = np.flatnonzero(counts), np.flatnonzero(comp != np.arange(len(row)))
        ids = np.r_[row[found], row[moved]]
        links = np.r_[counts[found], np.zeros(len(moved), np.int64)]
        to = pa.array([None] * len(found) + row[comp[moved]].tolist(), pa.int64())
        return pa.table({"row": pa.array(ids), "links": pa.array(links), "to": to})

    return run


def _squared(points: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by the same sum for either order of a pair, so that both count it in the same block."""
    return ((points[x] - points[y]) ** 2).sum(axis=1)


def link_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``(id, n_links, component, kept)`` per row of ``vectors``.

    ``n_links``: other rows of the same label with a cosine of ``threshold`` or
    more; ``component``: the smallest id reachable by links, its own included.
    """
    element = vectors.schema[vector_col].dataType.elementType
    element = element if isinstance(element, (T.FloatType, T.DoubleType)) else T.DoubleType()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(T.ArrayType(element)).alias("embedding"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0))
    classes = valid.groupBy("label", "embedding").agg(F.min("row").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("dim", F.size("embedding")), "classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    grid = F.greatest(F.lit(0), F.ceil(F.log(F.col("n") / tile) / F.log(F.lit(4.0)))).cast("int")
    asked = classes.join(sizes.select("label", "dim", grid.alias("grid")), ["label", "dim"]).select(F.col("rep").alias("row"), "label", "dim", "grid", "embedding")
    # Cells are worked out once and written without the vectors, which join what is left of them.
    dealt = materialize(asked.mapInArrow(_dealt(threshold), "label string, dim int, block int, cell string, row long, home boolean"), "cells")
    key = ["label", "dim", "block", "cell"]
    # A cell's size is counted before its vectors move.
    cells = dealt.groupBy(*key).agg(F.count("*").alias("n"), F.max("home").alias("asks")).where("n > 1 and asks").select(*key, F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    dealt = dealt.join(F.broadcast(cells) if cells.count() <= 1 << 16 else cells, key).join(classes.select(F.col("rep").alias("row"), "copies", "embedding"), "row")
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    roles = F.when(F.col("tile") == F.col("other"), F.array(F.struct(F.col("tile").alias("i"), F.col("tile").alias("j"), F.lit(True).alias("asks"), F.lit(True).alias("answers"))))
    roles = roles.otherwise(F.array(F.struct(F.col("tile").alias("i"), F.col("other").alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("answers")), F.struct(F.col("other").alias("i"), F.col("tile").alias("j"), F.lit(False).alias("asks"), F.lit(True).alias("answers"))))
    sent = dealt.withColumn("r", F.explode(roles)).select(*key, "r.i", "r.j", "r.asks", "r.answers", "row", "home", "copies", "embedding")
    found = materialize(sent.groupBy(*key, "i", "j").applyInArrow(_group_links(threshold), "row long, links long, to long"), "links")
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    joined = connected_components(found.where("to is not null"), "row", "to")
    of_class = classes.join(links, classes.rep == links.row, "left").drop("row").join(joined, F.col("rep") == joined.node, "left")
    of_class = of_class.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    whole = materialize(valid.join(of_class, ["label", "embedding"]).select("row", "id", "n_links", "c"), "members")
    least = whole.groupBy("c").agg(F.min("id").alias("component"))
    linked = whole.join(least, "c").select("row", "n_links", "component")
    out = rows.select("row", "id").join(linked, "row", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))
