"""Training corpora and samplers. Randomness is a hash of the keys and a seed, so that every run draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontospark.operators.graph import edge_table, neighbours
from ontospark.runtime import connected_components, materialize


def draw_order(*keys: str, seed: int = 0) -> Column:
    return F.xxhash64(*keys, F.lit(seed))


def synonym_groups(literals: DataFrame, transitive: bool = False) -> DataFrame:
    """``(group_id, literal)``: an entity's literals are a group; with ``transitive`` groups that share one are merged."""
    own = literals.select(F.col("iri").alias("group_id"), "literal").where("literal is not null").distinct()
    if not transitive:
        return own
    own = materialize(own, "groups")
    hub = own.groupBy("literal").agg(F.min("group_id").alias("hub"))
    joined = connected_components(own.join(hub, "literal"), "group_id", "hub")
    return own.join(joined, own.group_id == joined.node, "left").select(F.coalesce("component", "group_id").alias("group_id"), "literal").distinct()


def synonym_pairs(groups: DataFrame) -> DataFrame:
    """``(a, b)``: all pairs within a group, a literal with itself and both orders included, distinct."""
    g = groups.select("group_id", "literal").distinct()
    return g.select("group_id", F.col("literal").alias("a")).join(g.select("group_id", F.col("literal").alias("b")), "group_id").select("a", "b").distinct()


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``k``: 1, 2, 3 ... in the order of its columns ``order``.

    Rows are dealt by ranges of the order; only each range's count meets the others'.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    base = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    within = Window.partitionBy("_p").orderBy(*order)
    return ranged.join(F.broadcast(base), "_p").withColumn("k", (F.row_number().over(within) + F.col("_b")).cast("long")).drop("_p", "_b")


def soft_nonsynonyms(groups: DataFrame, shift: int = 1) -> DataFrame:
    """``(a, b)``: the smallest literal of each group with that of the group ``shift`` places on, around the end."""
    first = groups.groupBy("group_id").agg(F.min("literal").alias("literal"))
    rows = materialize(numbered(first, ["group_id"]), "numbered")
    n = rows.count()
    other = rows.select(F.col("literal").alias("b"), (F.pmod(F.col("k") - 1 - shift, F.lit(max(n, 1))) + 1).alias("k"), F.col("group_id").alias("g"))
    return rows.join(other, "k").where("group_id <> g and literal <> b").select(F.col("literal").alias("a"), "b").distinct()


def hard_nonsynonyms(edges: DataFrame, literals: DataFrame) -> DataFrame:
    """``(a, b)``: the smallest literals of each class and of the next sibling under the same parent."""
    name = literals.groupBy(F.col("iri").alias("child")).agg(F.min("literal").alias("literal"))
    named = edge_table(edges).join(name, "child")
    order = Window.partitionBy("parent").orderBy("child")
    paired = named.withColumn("b", F.lead("literal").over(order)).where("b is not null and literal <> b")
    return paired.select(F.col("literal").alias("a"), "b").distinct()


def cross_synonyms(mappings: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """``(a, b)``: literals of mapped classes, without equal ones, in both orders."""
    s = source.select(F.col("iri").alias("source"), F.col("literal").alias("a"))
    t = target.select(F.col("iri").alias("target"), F.col("literal").alias("b"))
    pairs = mappings.select("source", "target").distinct().join(s, "source").join(t, "target").where("a <> b").select("a", "b")
    return pairs.union(pairs.select("b", "a")).distinct()


def corpus(positives: list[DataFrame], negatives: list[DataFrame]) -> DataFrame:
    """``(text_a, text_b, label)``: all positives, and the negatives that aren't positive, distinct."""
    def whole(parts: list[DataFrame]) -> DataFrame:
        out = parts[0].select("a", "b")
        for more in parts[1:]:
            out = out.union(more.select("a", "b"))
        return out.where("a <> '' and b <> ''").distinct()

    yes = whole(positives)
    no = whole(negatives).join(yes, ["a", "b"], "left_anti")
    return yes.withColumn("label", F.lit(1)).unionByName(no.withColumn("label", F.lit(0))).select(F.col("a").alias("text_a"), F.col("b").alias("text_b"), "label")


def split(df: DataFrame, keys: list[str], shares: dict[str, float], seed: int = 0) -> DataFrame:
    """``df`` with ``split``: a row's hash decides, so rows stay where they are when others come."""
    point = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000))
    out, upto = None, 0.0
    for name, share in shares.items():
        upto += share
        test = point < round(upto * 1_000_000)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return df.withColumn("split", out.otherwise(F.lit(list(shares)[-1])))


def few_shot(samples: DataFrame, keys: list[str], per_label: int, seed: int = 0) -> DataFrame:
    """``per_label`` rows of each label, the first by a hash of their keys."""
    order = Window.partitionBy("label").orderBy(draw_order(*keys, seed=seed), *keys)
    return samples.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_label).drop("k")


def balanced(samples: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """``samples`` with rows of the rarer label (0 or 1) repeated until both are as many."""
    counts = {r["label"]: r["n"] for r in samples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2 or counts[0] == counts[1]:
        return samples
    rare = min(counts, key=counts.get)
    most, few = max(counts.values()), min(counts.values())
    rows = numbered(samples.where(F.col("label") == rare), keys)
    times = F.lit(most // few) + F.when(F.col("k") <= most % few, 1).otherwise(0)
    again = rows.withColumn("_t", F.explode(F.sequence(F.lit(1), times))).drop("_t", "k")
    return samples.where(F.col("label") != rare).unionByName(again.select(samples.columns))


def weighted_sample(df: DataFrame, keys: list[str], weight: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows drawn without repeats, likelier the larger their weight: exponential keys, top n."""
    uniform = (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit((1 << 53) - 1)) + 1) / float(1 << 53)
    return df.where(F.col(weight) > 0).withColumn("_e", -F.log(uniform) / F.col(weight)).orderBy("_e", *keys).limit(n).drop("_e")


def normalised_weights(df: DataFrame, weight: str, group: list[str] | None = None) -> DataFrame:
    """``df`` with ``share``: the weight over its group's (or the table's) sum."""
    total = df.groupBy(*(group or [])).agg(F.sum(weight).alias("_sum"))
    joined = df.join(total, group) if group else df.crossJoin(F.broadcast(total))  # one row
    return joined.withColumn("share", F.try_divide(F.col(weight), F.col("_sum"))).drop("_sum")


def negative_classes(pairs: DataFrame, classes: DataFrame, closed: DataFrame, n: int, seed: int | None = None, keep_descendants: bool = True) -> DataFrame:
    """``(sub, sup, negative, place)``: for each positive ``n`` classes that aren't ancestors of ``sub`` or itself.

    Each positive probes the ring of all numbered classes from a place that its
    hash (or, without a seed, its own number) gives, and takes the first ``n``
    that fit, so the work per positive is n plus its ancestors, not all classes.
    """
    rows = materialize(numbered(classes.select("iri").distinct(), ["iri"]), "classes")
    size = max(rows.count(), 1)
    above = closed.where("ancestor <> descendant").select(F.col("descendant").alias("sub"), F.col("ancestor").alias("negative"))
    if not keep_descendants:
        above = above.union(closed.where("ancestor <> descendant").select(F.col("ancestor").alias("sub"), F.col("descendant").alias("negative")))
    above = materialize(above.distinct(), "above")
    many = above.groupBy("sub").agg(F.count("*").alias("banned"))
    place = rows.select(F.col("iri").alias("sub"), "k")
    start = F.col("k") if seed is None else F.pmod(F.xxhash64("sub", "sup", F.lit(seed)), F.lit(size)) + 1
    p = pairs.select("sub", "sup").distinct().join(place, "sub").join(many, "sub", "left").withColumn("start", start)
    # From its own place a class comes last on the ring, from a drawn one anywhere.
    steps = F.least(F.lit(size - (seed is None)).cast("long"), F.lit(n + 1) + F.coalesce("banned", F.lit(0)))
    probes = p.where(steps >= 1).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), steps)))
    probes = probes.withColumn("k", F.pmod(F.col("start") + F.col("i") - 1, F.lit(size)) + 1).select("sub", "sup", "i", "k")
    found = probes.join(rows.select("k", F.col("iri").alias("negative")), "k").where("negative <> sub")
    found = found.join(above, ["sub", "negative"], "left_anti")
    order = Window.partitionBy("sub", "sup").orderBy("i")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("sub", "sup", "negative", "place")


def random_candidates(references: DataFrame, classes: DataFrame, n: int, seed: int = 0, closed: DataFrame | None = None) -> DataFrame:
    """``(source, target, candidate, place)``: ``n`` classes for each reference that are none of its source's targets.

    With ``closed`` the ancestors of those targets are left out as well. Each
    reference probes the ring of all numbered classes from a place that its hash
    gives, and takes the first that fit, so the work per reference is ``n`` plus
    what is left out.
    """
    rows = materialize(numbered(classes.select("iri").distinct(), ["iri"]), "classes")
    size = max(rows.count(), 1)
    gold = references.select("source", "target").distinct()
    out = gold.select("source", F.col("target").alias("candidate"))
    if closed is not None:
        out = out.union(gold.join(closed.select(F.col("descendant").alias("target"), "ancestor"), "target").select("source", "ancestor"))
    out = materialize(out.distinct(), "left_out")
    many = out.groupBy("source").agg(F.count("*").alias("left_out"))
    start = F.pmod(F.xxhash64("source", "target", F.lit(seed)), F.lit(size))
    steps = F.least(F.lit(size).cast("long"), F.col("left_out") + n)
    probes = gold.join(many, "source").select("source", "target", start.alias("start"), F.posexplode(F.sequence(F.lit(1).cast("long"), steps)).alias("i", "_"))
    found = probes.select("source", "target", "i", (F.pmod(F.col("start") + F.col("i"), F.lit(size)) + 1).alias("k")).join(rows.select("k", F.col("iri").alias("candidate")), "k")
    order = Window.partitionBy("source", "target").orderBy("i")
    kept = found.join(out, ["source", "candidate"], "left_anti").withColumn("place", F.row_number().over(order))
    return kept.where(F.col("place") <= n).select("source", "target", "candidate", "place")


def neighbour_candidates(references: DataFrame, edges: DataFrame, n: int, hops: int = 5) -> DataFrame:
    """``(source, target, candidate, hop, place)``: the ``n`` nearest classes of a reference's target, nearer and then smaller first.

    Classes are ranked once per target; a reference is joined with only as many
    of them as it can need: ``n``, and one more for each target of its source.
    """
    starts = references.select(F.col("target").alias("id")).distinct()
    near = neighbours(starts, edges, hops)
    gold = references.select("source", F.col("target").alias("candidate")).distinct()
    many = gold.groupBy("source").agg(F.count("*").alias("golds"))
    asked = references.select("source", "target").distinct().join(many, "source")
    most = asked.groupBy(F.col("target").alias("start")).agg((F.max("golds") + n).alias("most"))
    ranked = near.join(most, "start").withColumn("rank", F.row_number().over(Window.partitionBy("start").orderBy("hop", "id"))).where("rank <= most").drop("most")
    found = asked.join(ranked, (F.col("target") == F.col("start")) & (F.col("rank") <= F.col("golds") + n)).select("source", "target", F.col("id").alias("candidate"), "hop")
    found = found.join(gold, ["source", "candidate"], "left_anti")
    order = Window.partitionBy("source", "target").orderBy("hop", "candidate")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def mixed_candidates(references: DataFrame, strategies: list[tuple[str, DataFrame, int]], random: DataFrame, total: int) -> DataFrame:
    """``(source, target, candidate, strategy)``: up to so many from each strategy in turn, then topped up at random.

    Each strategy has ``(source, target, candidate, place)``. A candidate counts
    for the first strategy that selects it; what a strategy lacks goes to
    ``random``, which fills up to ``total``.
    """
    key = ["source", "target", "candidate"]
    order = Window.partitionBy("source", "target").orderBy("place", "candidate")
    chosen = None
    for name, ranked, n in strategies:
        left = ranked if chosen is None else ranked.join(chosen.select(*key), key, "left_anti")
        part = left.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).select(*key, F.lit(name).alias("strategy"))
        chosen = materialize(part if chosen is None else chosen.unionByName(part), "chosen")
    have = chosen.groupBy("source", "target").agg(F.count("*").alias("have"))
    rest = random.join(chosen.select(*key), key, "left_anti").withColumn("_k", F.row_number().over(order))
    lack = references.select("source", "target").distinct().join(have, ["source", "target"], "left").select("source", "target", (F.lit(total) - F.coalesce("have", F.lit(0))).alias("lack"))
    more = rest.join(lack, ["source", "target"]).where(F.col("_k") <= F.col("lack"))
    return chosen.unionByName(more.select(*key, F.lit("random").alias("strategy")))


def context_strings(paths: DataFrame, names: DataFrame, separator: str) -> DataFrame:
    """``(start, context)``: the names along each path ``(start, step, id)``, joined by ``separator``."""
    named = paths.join(names.select(F.col("iri").alias("id"), "name"), "id", "left").select("start", "step", F.coalesce("name", F.col("id").cast("string")).alias("name"))
    listed = named.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("step", "name"))).alias("l"))
    return listed.select("start", F.array_join(F.transform("l", lambda x: x["name"]), separator).alias("context"))


def corrupt(exprs: DataFrame, entities: DataFrame, seed: int = 0) -> DataFrame:
    """``exprs`` with one named part of each replaced by the next entity of the same kind, around the end.

    ``exprs`` has ``(id, parts array<string>)``, ``entities`` ``(iri, entity_type)``.
    """
    order = Window.partitionBy("entity_type").orderBy("iri")
    ring = entities.select("iri", "entity_type").distinct().withColumn("next", F.lead("iri").over(order)).withColumn("first", F.first("iri").over(order))
    ring = ring.select("iri", F.coalesce("next", "first").alias("by"))
    at = F.pmod(F.xxhash64("id", F.lit(seed)), F.size("parts")).cast("int")
    chosen = exprs.where(F.size("parts") > 0).withColumn("at", at).withColumn("iri", F.element_at("parts", F.col("at") + 1))
    swapped = chosen.join(ring, "iri")
    return swapped.select("id", F.transform("parts", lambda x, i: F.when(i == F.col("at"), F.col("by")).otherwise(x)).alias("parts"), F.col("iri").alias("replaced"), "by")
