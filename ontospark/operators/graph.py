"""Taxonomy graphs as ``(parent, child)`` edges. Loops are semi-naive and keep their rounds in the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontospark.runtime import materialize

ROOT = "root"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def edge_table(edges: DataFrame) -> DataFrame:
    """Distinct edges without nulls and self loops."""
    return edges.select("parent", "child").where("parent is not null and child is not null and parent <> child").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("id")).union(edges.select(F.col("child").alias("id"))).distinct()


def closure(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``(ancestor, descendant, distance)``: all pairs joined by a path, with the fewest edges; ``most`` bounds the hops.

    Each round joins only the pairs that the last one found, so a pair is
    extended once; cycles end as their pairs are known already.
    """
    edges = materialize(edge_table(edges), "edges")
    step = edges.select(F.col("parent").alias("descendant"), F.col("child").alias("next"))
    rounds = [edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("distance"))]
    while most is None or len(rounds) < most:
        known = _union(rounds).select("ancestor", F.col("descendant").alias("next"))
        new = rounds[-1].select("ancestor", "descendant").join(step, "descendant").select("ancestor", "next").distinct()
        new = materialize(new.join(known, ["ancestor", "next"], "left_anti").select("ancestor", F.col("next").alias("descendant"), F.lit(len(rounds) + 1).alias("distance")), "closure")
        if new.isEmpty():
            break
        rounds.append(new)
    return _union(rounds)


def with_self(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """A closure with every node as its own ancestor at distance 0."""
    own = nodes(edges).select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(0).alias("distance"))
    return pairs.where("ancestor <> descendant").unionByName(own)


def collapse_cycles(edges: DataFrame) -> DataFrame:
    """Edges between strongly connected components, each named by its smallest node."""
    pairs = closure(edges).select("ancestor", "descendant")
    back = pairs.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("ancestor"))
    mutual = pairs.join(back, ["ancestor", "descendant"]).groupBy(F.col("ancestor").alias("id")).agg(F.min("descendant").alias("name"))
    named = mutual.select("id", F.least("id", "name").alias("name"))
    left = edges.join(named.select(F.col("id").alias("parent"), F.col("name").alias("p")), "parent", "left")
    both = left.join(named.select(F.col("id").alias("child"), F.col("name").alias("c")), "child", "left")
    return edge_table(both.select(F.coalesce("p", "parent").alias("parent"), F.coalesce("c", "child").alias("child")))


def reduction(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Direct edges only: those of a closure with nothing between their ends."""
    edges = edge_table(edges)
    pairs = closure(edges) if pairs is None else pairs
    above = pairs.select(F.col("ancestor").alias("parent"), F.col("descendant").alias("middle"))
    last = edges.select(F.col("parent").alias("middle"), "child")
    indirect = above.join(last, "middle").select("parent", "child").distinct()
    return edges.join(indirect, ["parent", "child"], "left_anti")


def depths(edges: DataFrame, root: str = ROOT, most: int = 1000) -> DataFrame:
    """``(id, shortest, longest, longest_nodes)``: edges on the shortest and longest path from ``root``, and nodes on the longest.

    A graph that still has nodes after ``most`` rounds holds a cycle.
    """
    edges = materialize(edge_table(edges), "edges")
    if edges.where(F.col("parent") == root).isEmpty():
        raise RuntimeError(f"no root {root}")
    level = edges.where(F.col("parent") == root).select(F.col("parent").alias("id")).distinct()
    levels, k = [level.withColumn("level", F.lit(0))], 0
    while True:
        level = levels[-1].select(F.col("id").alias("parent")).join(edges, "parent").select(F.col("child").alias("id")).distinct()
        k += 1
        level = materialize(level.withColumn("level", F.lit(k)), "level")
        if level.isEmpty():
            break
        if k > most:
            raise RuntimeError("the graph has a cycle")
        levels.append(level)
    return _union(levels).groupBy("id").agg(F.min("level").alias("shortest"), F.max("level").alias("longest"), (F.max("level") + 1).alias("longest_nodes"))


def lowest_common_ancestors(pairs: DataFrame, edges: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """``(a, b, lca)`` for pairs ``(a, b)``: a common ancestor above no other; of several the smallest."""
    closed = materialize(closure(edges) if closed is None else closed, "closure")
    own = with_self(closed, edges).select("ancestor", "descendant")
    pairs = pairs.select("a", "b").distinct()
    common = pairs.join(own.select(F.col("descendant").alias("a"), "ancestor"), "a").join(own.select(F.col("descendant").alias("b"), "ancestor"), ["b", "ancestor"])
    common = materialize(common.select("a", "b", "ancestor"), "common")
    lower = common.select("a", "b", F.col("ancestor").alias("descendant")).join(closed.where("ancestor <> descendant").select("ancestor", "descendant"), "descendant")
    lowest = common.join(lower.select("a", "b", "ancestor").distinct(), ["a", "b", "ancestor"], "left_anti")
    return lowest.groupBy("a", "b").agg(F.min("ancestor").alias("lca"))


def descendant_graph(edges: DataFrame, top: str, pairs: DataFrame | None = None) -> DataFrame:
    """The edges among the descendants of ``top``, which itself is left out."""
    below = (closure(edges) if pairs is None else pairs).where((F.col("ancestor") == top) & (F.col("descendant") != top)).select("descendant")
    out = edge_table(edges).join(below.select(F.col("descendant").alias("parent")), "parent", "left_semi")
    return out.join(below.select(F.col("descendant").alias("child")), "child", "left_semi").select("parent", "child")


def orphans_to_root(edges: DataFrame, entities: DataFrame, root: str = ROOT) -> DataFrame:
    """``edges`` and one from ``root`` to each entity ``id`` without a parent."""
    edges = edge_table(edges)
    alone = entities.select("id").where(F.col("id") != root).distinct().join(edges.select(F.col("child").alias("id")), "id", "left_anti")
    return edges.unionByName(alone.select(F.lit(root).alias("parent"), F.col("id").alias("child")))


def sibling_groups(edges: DataFrame) -> DataFrame:
    """``(parent, child, siblings)``: children of parents with more than one; a long table, as a group may be large."""
    edges = edge_table(edges)
    size = edges.groupBy("parent").agg(F.count("*").alias("siblings")).where("siblings > 1")
    return edges.join(size, "parent").select("parent", "child", "siblings")


def prune(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """The edges left when the nodes ``id`` of ``removed`` go and their children join their parents.

    An edge stands for each path whose inner nodes are all removed.
    """
    edges = materialize(edge_table(edges), "edges")
    gone = materialize(removed.select("id").distinct(), "removed")
    open_ = edges.join(gone.select(F.col("id").alias("parent")), "parent", "left_anti")
    found, seen = [], None
    while True:
        is_gone = gone.select(F.col("id").alias("child"), F.lit(True).alias("gone"))
        marked = materialize(open_.join(is_gone, "child", "left").select("parent", "child", F.coalesce("gone", F.lit(False)).alias("gone")), "paths")
        found.append(marked.where("not gone").select("parent", "child"))
        at = marked.where("gone").select("parent", "child")
        seen = at if seen is None else seen.unionByName(at)
        below = edges.select(F.col("parent").alias("child"), F.col("child").alias("next"))
        open_ = at.join(below, "child").select("parent", F.col("next").alias("child")).where("parent <> child").distinct()
        open_ = materialize(open_.join(seen, ["parent", "child"], "left_anti"), "open")
        if open_.isEmpty():
            return _union(found).distinct()


def sibling_pairs(edges: DataFrame) -> DataFrame:
    """``(a, b, shared)``: nodes with a parent in common, in both orders, and how many parents they share.

    The result holds every pair of a parent's children: for parents of bounded degree.
    """
    edges = edge_table(edges)
    pairs = edges.select("parent", F.col("child").alias("a")).join(edges.select("parent", F.col("child").alias("b")), "parent")
    return pairs.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def neighbours(starts: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``(start, id, hop)``: nodes within ``hops`` edges in either direction, at their fewest hops."""
    edges = edge_table(edges)
    both = materialize(edges.select(F.col("parent").alias("id"), F.col("child").alias("next")).union(edges.select(F.col("child").alias("id"), F.col("parent").alias("next"))), "both")
    rounds = [starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hop")).distinct()]
    for hop in range(1, hops + 1):
        new = rounds[-1].select("start", "id").join(both, "id").select("start", F.col("next").alias("id")).distinct()
        new = new.join(_union(rounds).select("start", "id"), ["start", "id"], "left_anti")
        rounds.append(materialize(new.withColumn("hop", F.lit(hop)), "hop"))
    return _union(rounds[1:])


def bounded_neighbours(starts: DataFrame, edges: DataFrame, depth: int = 3, width: int = 8) -> DataFrame:
    """``neighbours`` whose frontier keeps the ``width`` smallest nodes of each start in each round."""
    edges = edge_table(edges)
    both = materialize(edges.select(F.col("parent").alias("id"), F.col("child").alias("next")).union(edges.select(F.col("child").alias("id"), F.col("parent").alias("next"))), "both")
    rounds = [starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hop")).distinct()]
    order = Window.partitionBy("start").orderBy("id")
    for hop in range(1, depth + 1):
        new = rounds[-1].select("start", "id").join(both, "id").select("start", F.col("next").alias("id")).distinct()
        new = new.join(_union(rounds).select("start", "id"), ["start", "id"], "left_anti")
        new = new.withColumn("k", F.row_number().over(order)).where(F.col("k") <= width).drop("k")
        rounds.append(materialize(new.withColumn("hop", F.lit(hop)), "hop"))
    return _union(rounds[1:])


def greedy_paths(starts: DataFrame, edges: DataFrame, hops: int, up: bool = True) -> DataFrame:
    """``(start, step, id)``: from each start to its smallest parent (or child), again and again."""
    ends = ("child", "parent") if up else ("parent", "child")
    step = edge_table(edges).groupBy(F.col(ends[0]).alias("id")).agg(F.min(ends[1]).alias("next"))
    step = materialize(step, "steps")
    rounds = [starts.select(F.col("id").alias("start"), F.lit(0).alias("step"), "id").distinct()]
    for k in range(1, hops + 1):
        rounds.append(rounds[-1].join(step, "id").select("start", F.lit(k).alias("step"), F.col("next").alias("id")))
    return _union(rounds)


def _pick(draw: Column, total: Column) -> Column:
    return F.pmod(draw, total)


def random_walks(edges: DataFrame, walks: int, length: int, restart: float = 0.0, seed: int = 0, first: bool = False) -> DataFrame:
    """``(start, walk, step, token)``: walks over ``(source, relation, target)`` edges, relations between the nodes.

    A walk ends at a node without edges; with probability ``restart`` it emits
    ``*****`` and goes on from its start. Choices are hashes of walk, step and
    ``seed``, so they repeat; ``first`` always takes the smallest edge.
    """
    order = Window.partitionBy("source").orderBy("relation", "target")
    steps = edges.select("source", "relation", "target").distinct().withColumn("k", F.row_number().over(order) - 1)
    steps = materialize(steps.withColumn("degree", F.count("*").over(Window.partitionBy("source")).cast("long")), "adjacency")
    starts = steps.select(F.col("source").alias("start")).distinct().withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))))
    at = starts.withColumn("source", F.col("start"))
    out = [at.select("start", "walk", F.lit(0).alias("step"), F.col("source").alias("token"))]
    for k in range(1, length + 1):
        draw = F.xxhash64("start", "walk", F.lit(k), F.lit(seed))
        jumps = F.pmod(F.xxhash64("start", "walk", F.lit(k), F.lit(seed + 1)), F.lit(1_000_000)) < int(restart * 1_000_000)
        degree = steps.where("k = 0").select("source", "degree")
        chosen = at.join(degree, "source").withColumn("k", F.lit(0) if first else _pick(draw, F.col("degree")).cast("int")).withColumn("jumps", jumps)
        moved = chosen.join(steps.select("source", "k", "relation", "target"), ["source", "k"])
        moved = materialize(moved.select("start", "walk", F.when(F.col("jumps"), F.col("start")).otherwise(F.col("target")).alias("source"), F.when(F.col("jumps"), F.lit("*****")).otherwise(F.col("relation")).alias("relation")), "walk")
        out.append(moved.select("start", "walk", F.lit(2 * k - 1).alias("step"), F.col("relation").alias("token")))
        out.append(moved.select("start", "walk", F.lit(2 * k).alias("step"), F.col("source").alias("token")))
        at = moved.select("start", "walk", "source")
    return _union(out)


#: Draws of a next step made at once by rejection; walks that none of them moves go through all their edges.
TRIES = 16


def biased_walks(edges: DataFrame, walks: int, length: int, p: float = 1.0, q: float = 1.0, seed: int = 0, tries: int = TRIES) -> DataFrame:
    """``(start, walk, step, id)``: second-order walks over ``(source, target, weight)``.

    A step back weighs 1/p of the edge, one to a neighbour of the last node 1,
    any other 1/q. A step draws ``tries`` numbered edges of its node and takes
    the first that is accepted, in proportion to its weight; only walks without
    one list all edges of their node, and take a point on the cumulated weights.
    """
    e = edges.groupBy("source", "target").agg(F.sum("weight").cast("double").alias("weight"))
    e = e.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("target")) - 1)
    e = materialize(e, "adjacency")
    nodes_ = materialize(e.groupBy("source").agg(F.count("*").alias("degree"), F.max("weight").alias("most")), "degrees")
    starts = nodes_.select(F.col("source").alias("start")).withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))))
    at = starts.select("start", "walk", F.lit(None).cast(e.schema["source"].dataType).alias("last"), F.col("start").alias("source"))
    out = [at.select("start", "walk", F.lit(0).alias("step"), F.col("source").alias("id"))]
    key = ["start", "walk"]
    near = e.select(F.col("source").alias("last"), "target", F.lit(True).alias("near"))
    bias = F.when(F.col("target") == F.col("last"), 1.0 / p).when(F.col("last").isNull() | F.coalesce("near", F.lit(False)), 1.0).otherwise(1.0 / q)
    top = max(1.0, 1.0 / p, 1.0 / q)

    def point(*salt: Column | int) -> Column:
        return F.pmod(F.xxhash64(*key, *(F.lit(x) if isinstance(x, int) else x for x in salt), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)

    for k in range(1, length + 1):
        drawn = at.join(nodes_, "source").withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(tries)))) if tries else None
        if drawn is not None:
            drawn = drawn.withColumn("k", F.floor(point(k, F.col("try"), 1) * F.col("degree")).cast("int"))
            drawn = drawn.join(e, ["source", "k"]).join(near, ["last", "target"], "left")
            fit = drawn.where(point(k, F.col("try"), 2) * F.col("most") * top < F.col("weight") * bias)
            moved = materialize(fit.groupBy(*key).agg(F.min_by("target", "try").alias("target"), F.first("source").alias("source")).select(*key, "source", "target"), "moved")
        left = at.join(moved.select(*key), key, "left_anti") if drawn is not None else at
        options = left.join(e.drop("k"), "source").join(near, ["last", "target"], "left")
        options = options.withColumn("w", F.col("weight") * bias)
        upto = F.sum("w").over(Window.partitionBy(*key).orderBy("target").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        total = F.sum("w").over(Window.partitionBy(*key))
        marked = options.withColumn("upto", upto).withColumn("total", total).where(F.col("upto") > point(k) * F.col("total"))
        picked = marked.groupBy(*key, "source").agg(F.min_by("target", "upto").alias("target")).select(*key, "source", "target")
        picked = moved.unionByName(picked) if drawn is not None else picked
        at = materialize(picked.select(*key, F.col("source").alias("last"), F.col("target").alias("source")), "walk")
        out.append(at.select(*key, F.lit(k).alias("step"), F.col("source").alias("id")))
    return _union(out)
