"""Where intermediate tables go, and loops over DataFrames that need them."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes up to which a join sends a table to every task: as Spark estimates them beforehand, and as it measures them while it runs.
#: Estimates are of compressed files and pass over what an explode adds, so a table may be a hundred times as large on the driver.
_BROADCASTS = {"spark.sql.autoBroadcastJoinThreshold": 1 << 18, "spark.sql.adaptive.autoBroadcastJoinThreshold": 1 << 22}

#: Bytes of a batch that goes to a Python worker, and the setting: the JVM holds batches outside its heap, up to three times as large while they grow.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 22


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``.

    Only where that setting is absent (tests on one machine) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        folder = sc._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else None
    if not folder:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ontospark-")
        sc.setCheckpointDir(folder)
        folder = sc._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/ontospark/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: the result survives the loss of any executor, and each
    reader of it costs one scan instead of the plan above. Unlike
    ``DataFrame.checkpoint`` it computes the plan once and compresses it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_removed(spark), broadcasts_bounded(spark), batches_bounded(spark):
        df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ontospark_path = path
    return out


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, Spark removes the shuffle files of every execution at its end: what was written has no use for them."""
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)


@contextlib.contextmanager
def broadcasts_bounded(spark: SparkSession) -> Iterator[None]:
    """Within, no join broadcasts a table beyond ``_BROADCASTS`` unless told to; lower settings of the session hold."""
    before = {name: spark.conf.get(name, None) for name in _BROADCASTS}
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for name, most in _BROADCASTS.items():
        own = before[name] or usual
        own = -1 if own.startswith("-") else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(own)
        spark.conf.set(name, str(min(own, most)))
    try:
        yield
    finally:
        for name, own in before.items():
            spark.conf.unset(name) if own is None else spark.conf.set(name, own)


@contextlib.contextmanager
def batches_bounded(spark: SparkSession) -> Iterator[None]:
    """Within, rows go to Python workers in batches of ``BATCH_BYTES``, or one larger row; a lower setting of the session holds."""
    before, own = spark.conf.get(_BATCH, None), spark.conf.get(_BATCH)
    own = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(own)
    spark.conf.set(_BATCH, str(min(own, BATCH_BYTES)))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def drop_materialized(*frames: DataFrame) -> None:
    """Delete the tables that ``materialize`` gave; other DataFrames are passed over."""
    for df in frames:
        path = getattr(df, "_ontospark_path", None)
        if path:
            remove_path(df.sparkSession, path)


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, component)`` for every node linked to another; ``component`` is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, shortens the chains
    by pointer jumping, and rewrites the edges between the labels, so the edge
    table at least shrinks by the merged nodes and a component of n nodes needs
    O(log n) rounds whatever its diameter. Rounds are Parquet tables in the
    shared folder. Nulls at either end are ignored; self edges and repeated
    edges change nothing; an empty table gives an empty result.
    """
    a, b = F.col("a"), F.col("b")

    def ordered(x: Column, y: Column, df: DataFrame) -> DataFrame:
        return df.where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()

    current = materialize(ordered(F.col(left), F.col(right), edges), "edges")
    maps: list[DataFrame] = []
    while not current.isEmpty():
        both = current.union(current.select(b.alias("a"), a.alias("b")))
        parent = both.groupBy(a.alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("parent"))
        parent = materialize(parent, "parents")
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = materialize(parent.join(up, "parent").select("node", F.col("above").alias("parent")), "parents")
        drop_materialized(parent)
        maps.append(jumped)
        pa = jumped.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        pb = jumped.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        following = materialize(ordered(F.col("pa"), F.col("pb"), current.join(pa, "a").join(pb, "b")), "edges")
        drop_materialized(current)
        current = following
    if not maps:
        return current.select(a.alias("node"), a.alias("component"))
    found = maps[-1].select("node", F.col("parent").alias("component"))
    for earlier in reversed(maps[:-1]):
        above = found.select(F.col("node").alias("parent"), "component")
        found = earlier.join(above, "parent", "left").select("node", F.coalesce("component", "parent").alias("component"))
    out = materialize(found, "components")
    drop_materialized(current, *maps)
    return out
