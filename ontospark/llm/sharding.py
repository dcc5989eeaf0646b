"""Sharding by a k-d tree over the rows' metadata.

Rows with equal texts are one unit and stay together, but for those groups that
weigh more than ``GROUP_SHARE`` of a shard: they are divided by a hash of their
ids into units of about that weight, since otherwise no shards of near equal
bytes would be possible. A unit has the metadata of its smallest row.

Each node is split along the metadata dimension in which it is widest, at the
point that divides its bytes in the ratio of the shards on either side. Units
are ordered by that dimension and then by a hash of theirs, so a value that
holds a third of all rows is divided like any other. The dividing point is
found by histograms: one aggregation gives every open node 256 sums, the bin that holds the
point becomes the next range, until the bin weighs next to nothing or holds a
single place. What reaches the driver is one row per open node; the units'
nodes are written once per level.

A string's place in its dimension is its rank among the column's distinct
values. Null texts count as empty, null metadata as a value just below all
others. Ids may be of any type; repeated rows are rows like any other. The law
is ``bytes``: the shards' bytes are near equal, as far as single units allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontospark.operators.ordering import running_sum
from ontospark.runtime import drop_materialized, materialize

BINS = 256
#: A bin under this share of its node's bytes is not divided further.
TOLERANCE = 0.0005
#: A group of equal texts beyond this share of a shard's bytes is divided.
GROUP_SHARE = 0.01
#: Rows per group within a shard in which positions are counted.
SLOT_ROWS = 50_000
#: Rows up to which a table of groups or of ranks goes to every task.
BROADCAST_ROWS = 1 << 16


def _coordinate(df: DataFrame, column: str) -> Column:
    """A column as a number that keeps its order, or as a string that ``_ranked`` makes one of."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.col(column).cast("string")
    if isinstance(kind, T.NumericType):
        return F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double"))
    return F.col(column).cast("timestamp").cast("double")


def _ranked(rows: DataFrame, dim: str) -> DataFrame:
    """``rows`` with the strings of ``dim`` replaced by their rank."""
    values = rows.where(F.col(dim).isNotNull()).select(F.col(dim).alias("value")).distinct()
    ordered = values.orderBy("value").withColumn("place", F.monotonically_increasing_id())
    ranks = materialize(running_sum(ordered, "place", {}, "rank").select("value", F.col("rank").cast("double")), "ranks")
    ranks = F.broadcast(ranks) if ranks.count() <= BROADCAST_ROWS else ranks
    return rows.join(ranks, rows[dim] == ranks["value"], "left").drop(dim, "value").withColumnRenamed("rank", dim)


def _widest(rows: DataFrame, dims: list[str], spans: dict[str, float]) -> DataFrame:
    """``(node, dim, lo, hi, weight)``: each node's widest dimension, relative to the whole table's width."""
    found = rows.groupBy("node").agg(F.sum("size").alias("weight"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))])
    options = [F.struct(((F.col(f"hi_{d}") - F.col(f"lo_{d}")) / F.lit(spans[d] or 1.0)).alias("width"), F.lit(-k).alias("order"), F.lit(k).alias("dim"), F.col(f"lo_{d}").alias("lo"), F.col(f"hi_{d}").alias("hi")) for k, d in enumerate(dims)]
    return found.select("node", "weight", (F.greatest(*options) if len(options) > 1 else options[0]).alias("w")).select("node", "weight", "w.dim", "w.lo", "w.hi")


_STATE = "node long, dim int, pinned boolean, value double, lo double, hi double, base double, target double, weight double"


def _medians(rows: DataFrame, dims: list[str], state: list[dict]) -> dict[int, tuple[int, float, float]]:
    """For each node ``(dim, value, tie)``: rows below ``(value, tie)`` in that dimension go left."""
    spark, out = rows.sparkSession, {}
    while state:
        s = F.broadcast(spark.createDataFrame([tuple(x[n.split()[0]] for n in _STATE.split(", ")) for x in state], _STATE))
        joined = rows.join(s, "node").withColumn("own", F.element_at(F.array(*dims), F.col("dim") + 1))
        place = F.when(F.col("pinned"), F.col("tie")).otherwise(F.col("own"))
        joined = joined.withColumn("x", place).where("(not pinned or own = value) and x between lo and hi")
        width = F.col("hi") - F.col("lo")
        bin_ = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
        sums = joined.groupBy("node", bin_.alias("bin")).agg(F.sum("size").cast("double").alias("w"), F.min("x").alias("least"), F.max("x").alias("most"))
        order = Window.partitionBy("node").orderBy("bin")
        sums = sums.withColumn("upto", F.sum("w").over(order)).join(s.select("node", "base", "target"), "node")
        last = Window.partitionBy("node").orderBy(F.desc("bin"))
        sums = sums.withColumn("is_last", F.row_number().over(last) == 1)
        first = sums.where((F.col("base") + F.col("upto") >= F.col("target")) | F.col("is_last")).withColumn("k", F.row_number().over(order)).where("k = 1")
        following = []
        found = {r["node"]: r for r in first.collect()}
        for x in state:
            r = found[x["node"]]
            before = x["base"] + r["upto"] - r["w"]
            if r["least"] < r["most"] and r["w"] > TOLERANCE * x["weight"]:
                following.append(x | {"lo": r["least"], "hi": r["most"], "base": before})
            elif r["least"] == r["most"] and not x["pinned"] and r["w"] > TOLERANCE * x["weight"]:
                following.append(x | {"pinned": True, "value": r["least"], "lo": 0.0, "hi": float(1 << 52), "base": before})
            else:
                left = x["target"] - before > r["w"] / 2  # whether the last bin goes left
                if x["pinned"]:
                    out[x["node"]] = (x["dim"], x["value"], r["most"] + 1 if left else r["least"])
                else:
                    out[x["node"]] = (x["dim"], r["most"], float(1 << 53)) if left else (x["dim"], r["least"], -1.0)
        state = following
    return out


def kd_shards(rows: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """``rows`` (with ``size``, the columns ``dims`` as numbers, and ``tie``) with ``shard``."""
    spark = rows.sparkSession
    whole = rows.agg(*[f(d).alias(f"{n}{d}") for d in dims for n, f in (("a", F.min), ("b", F.max))]).first()
    spans = {d: (whole[f"b{d}"] or 0.0) - (whole[f"a{d}"] or 0.0) for d in dims}
    # Nulls stand a hair below the least value, so that they don't make a dimension look wider than it is.
    rows = rows.withColumns({d: F.coalesce(d, F.lit((whole[f"a{d}"] or 0.0) - (spans[d] or 1.0) / 1024)) for d in dims})
    split_type = "node long, s_dim int, s_value double, s_tie double, left long, right long"
    # Open nodes by number, with the shards that each covers.
    open_, count = {0: (0, shards)}, 1
    placed = materialize(rows.withColumn("node", F.lit(0).cast("long")), "nodes")
    leaves: dict[int, int] = {}
    while open_:
        for node, (first, many) in list(open_.items()):
            if many == 1:
                leaves[node] = first
                del open_[node]
        if not open_:
            break
        todo = F.broadcast(spark.createDataFrame([(k,) for k in open_], "node long"))
        state = []
        for r in _widest(placed.join(todo, "node", "left_semi"), dims, spans).collect():
            first, many = open_[r["node"]]
            w = float(r["weight"])
            state.append({"node": r["node"], "dim": r["dim"], "pinned": False, "value": 0.0, "lo": r["lo"], "hi": r["hi"], "base": 0.0, "target": w * (many // 2) / many, "weight": w})
        table, following = [], {}
        for node, (dim, value, tie) in _medians(placed, dims, state).items():
            first, many = open_[node]
            table.append((node, dim, value, tie, count, count + 1))
            following |= {count: (first, many // 2), count + 1: (first + many // 2, many - many // 2)}
            count += 2
        if not table:
            break
        splits = F.broadcast(spark.createDataFrame(table, split_type))
        own = F.element_at(F.array(*dims), F.col("s_dim") + 1)
        goes_left = (own < F.col("s_value")) | ((own == F.col("s_value")) & (F.col("tie") < F.col("s_tie")))
        node = F.when(F.col("s_dim").isNull(), F.col("node")).when(goes_left, F.col("left")).otherwise(F.col("right"))
        before, placed = placed, materialize(placed.join(splits, "node", "left").withColumn("node", node).drop("s_dim", "s_value", "s_tie", "left", "right"), "nodes")
        drop_materialized(before)
        open_ = following
    names = F.broadcast(spark.createDataFrame(list(leaves.items()) or [(0, 0)], "node long, shard int"))
    return placed.join(names, "node", "left").withColumn("shard", F.coalesce("shard", F.lit(0))).drop("node")


def with_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2 ... within each shard, by groups of a hash and counts of the groups."""
    many = rows.count()
    groups = max(1, -(-many // SLOT_ROWS))
    rows = rows.withColumn("g", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    counts = rows.groupBy("shard", "g").agg(F.count("*").alias("n"))
    base = counts.select("shard", "g", (F.sum("n").over(Window.partitionBy("shard").orderBy("g")) - F.col("n")).alias("base"))
    within = Window.partitionBy("shard", "g").orderBy(*order)
    numbered = rows.withColumn("k", F.row_number().over(within) - 1).join(base, ["shard", "g"])
    return numbered.withColumn("slot", (F.col("base") + F.col("k")).cast("long")).drop("g", "k", "base")


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = ("lang", "source", "n_chars"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard, group_divided)`` per row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus one. ``shards`` shards, or as many
    as ``target_bytes`` asks for. Without any of ``dims`` the hash alone
    decides. ``group_divided``: whether the rows with this text were too many
    for one shard, and so may stand in several.
    """
    have = [d for d in dims if d in docs.columns]
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    names = [f"d{k}" for k in range(len(have))] or ["d0"]
    values = [_coordinate(docs, d).alias(n) for d, n in zip(have, names)] or [F.lit(0.0).alias("d0")]
    kept = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("th"), *values)
    kept = materialize(kept, "metadata")
    total = kept.agg(F.sum("size").alias("b")).first()["b"] or 0
    if shards is None:
        shards = max(1, -(-total // (target_bytes or 1 << 30)))
    limit = max(1, int(total / shards * GROUP_SHARE))
    key = ["text_crc32", "th", "size"]
    groups = kept.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", *names)).alias("m"))
    groups = materialize(groups.withColumn("pieces", F.when(F.col("n") > 1, F.least(F.col("n"), F.ceil(F.col("n") * F.col("size") / limit))).otherwise(F.lit(1)).cast("long")), "groups")
    # Of divided groups there are no more than total bytes over limit, of two rows or more each.
    large = F.broadcast(groups.where("pieces > 1").select(*key, "pieces"))
    # Rows of a divided group that are equal in id as well are dealt by their place in the table.
    piece = F.pmod(F.xxhash64("doc_id", "place"), F.col("pieces"))
    rows = materialize(kept.select("doc_id", *key, F.monotonically_increasing_id().alias("place")).join(large, key, "left").withColumn("piece", F.coalesce(piece, F.lit(0).cast("long"))), "rows")
    heavy = rows.where("pieces is not null").groupBy(*key, "piece").agg(F.count("*").alias("n"))
    heavy = heavy.join(groups.select(*key, "m"), key).select(*key, "piece", "n", "m")
    units = groups.where("pieces = 1").select(*key, F.lit(0).cast("long").alias("piece"), "n", "m").union(heavy)
    units = units.select(F.col("size").alias("bytes"), "text_crc32", "th", "piece", (F.col("size") * F.col("n")).alias("size"), *[F.col(f"m.{n}").alias(n) for n in names])
    for name, d in zip(names, have):
        if isinstance(docs.schema[d].dataType, (T.StringType, T.BinaryType)):
            units = _ranked(units, name)
    units = units.withColumn("tie", F.pmod(F.xxhash64("th", "text_crc32", "bytes", "piece"), F.lit(1 << 52)).cast("double"))
    placed = kd_shards(units, names, shards).select(F.col("bytes").alias("size"), "text_crc32", "th", "piece", "shard")
    out = materialize(rows.join(placed, [*key, "piece"]).select("doc_id", "size", "text_crc32", "place", "shard", F.col("pieces").isNotNull().alias("group_divided")), "shards")
    drop_materialized(kept, groups, rows)
    return with_slots(out, ["doc_id", "text_crc32", "size", "place"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_divided")
