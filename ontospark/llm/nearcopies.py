"""Near copies: SimHash links completed to all pairs of Jaccard 0.8 or more over word shingles.

Documents that differ in a few words of a hundred have 5-word shingles in
common to 0.8, but differ in some seven of 64 SimHash bits, beyond the reach of
deletion-variant signatures over segments that are still selective. So the
SimHash join gives the first candidates, and a set join by prefixes the rest.

Shingles are runs of ``width`` words (a text of fewer is one shingle), hashed
to 64 bits. All shingles have one order: common ones last, others by their
hash. Two sets of Jaccard t or more share at least ceil(t * n) members of each
set of n, so they share one of the first n - ceil(t * n) + 1 of both. An
equality join on these prefixes with a check of the whole sets therefore misses
no pair, whatever counts as common: that decides the work alone. Common are
those that a sample of documents shows to be, and then, for some rounds, keys
that more than ``HEAVY`` prefixes turn out to share; sets with such a key get
their prefix anew. So a passage in many documents is no evidence in any.

Equal sets are one class. Null and empty texts have no words, so they are one
class too. The work beyond the prefixes is one comparison per SimHash link, one
per member of a key, with one member of its size, then a few for members that
are still outside the components of others, and at last all pairs of a key that
are not yet in one component, in blocks. Each set has a bitmap of the parities
of its members by hash: two bitmaps differ in no more bits than the sets differ
in members, so pairs that differ in too many are out before sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontospark.llm.simhash import fingerprint_links
from ontospark.llm.words import NOT_SPACE, chunks, fresh, grams, lean, scan
from ontospark.runtime import connected_components, drop_materialized, materialize

WIDTH, THRESHOLD = 5, 0.8
#: Documents, about, in which common shingles are counted, how many of them make a shingle common, and how many such are kept at most: order only.
SAMPLE_DOCS, COMMON, MOST_COMMON = 16384, 8, 1 << 18
#: Prefixes that share a key before it counts as common, and rounds in which such keys are sought.
HEAVY, ROUNDS = 16, 3
#: Members of a key that a single block of comparisons holds.
TILE = 1024
#: Members of a key that the others are compared with in the second round.
CENTRES = 8
#: 64-bit parts of a set's bitmap.
PARTS = 8
BITS = [f"b{k}" for k in range(PARTS)]
#: Rows (a few numbers each) up to which a table goes to every task rather than through a shuffle with the texts.
BROADCAST_ROWS = 1 << 20
SLACK = 1e-9


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, one text after the other, and how many each has."""
    found = scan([(t or "").encode() for t in texts], is_word=NOT_SPACE)
    last = np.cumsum(found.counts)
    owner = np.repeat(np.arange(len(texts)), found.counts)
    hashes, owners = [], []
    whole = grams(found.hashes, width)
    fit = np.arange(len(whole)) + width <= last[owner[: len(whole)]] if len(whole) else np.zeros(0, bool)
    hashes.append(whole[fit])
    owners.append(owner[: len(whole)][fit])
    for size in range(1, width):  # texts of fewer words
        short = np.flatnonzero(found.counts == size)
        if len(short):
            at = (last - found.counts)[short]
            hashes.append(np.array([grams(found.hashes[a : a + size], size)[0] for a in at.tolist()], np.uint64) + np.uint64(size))
            owners.append(short)
    value, own = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    first = np.r_[True, (value[1:] != value[:-1]) | (own[1:] != own[:-1])] if len(value) else np.zeros(0, bool)
    return value[first], np.bincount(own[first], minlength=len(texts))


def _is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    return table[np.minimum(at, len(table) - 1)] == values


def prefixes(values: np.ndarray, counts: np.ndarray, common: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each set its first members in the order of the join, enough to meet every similar set, and their number."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, _is_in(values, common), owner))
    many = np.where(counts > 0, counts - np.ceil(threshold * counts - SLACK).astype(np.int64) + 1, 0)
    place = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    return values[order][place < many[owner]], many


def _fingerprints(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The SimHash of each set of hashes."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(counts) - counts)[some]
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        on = (2 * sums > counts[some, None]).astype(np.uint8)
        out[some] = np.packbits(on, axis=1, bitorder="little").view("<u8").ravel()
    return out


def bitmaps(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``PARTS`` numbers for each set: a bit is 1 if an odd number of members fall on it."""
    wide, bounds = 64 * PARTS, np.r_[0, np.cumsum(counts)]
    out = np.zeros((len(counts), PARTS), np.int64)
    for at in range(0, len(counts), 1024):  # as many sets at once as memory bears
        some = counts[at : at + 1024]
        own = np.repeat(np.arange(len(some)), some) * wide
        odd = np.bincount(own + (values[bounds[at] : bounds[at + len(some)]] >> np.uint64(20)).astype(np.int64) % wide, minlength=len(some) * wide) & 1
        out[at : at + len(some)] = np.packbits(odd.astype(np.uint8).reshape(-1, 64), axis=1, bitorder="little").view("<i8").reshape(-1, PARTS)
    return out


def _numbers(df: DataFrame) -> np.ndarray:
    """A column of longs, without a Python object for each."""
    return df.toArrow().column(0).to_numpy().astype(np.int64)


def _common_shingles(slim: DataFrame, width: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(texts, width)[0].view(np.int64))], names=["h"])

    every = max(1, slim.count() // SAMPLE_DOCS)
    some = slim.select("text", "th").where(F.pmod("th", F.lit(every)) == 0).dropDuplicates(["th"]).select("text")  # copies are one class
    found = some.mapInArrow(lean(run), "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(_numbers(found.orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h")).view(np.uint64))


_SETS = ["cls", "n", "fp", "prefix", *BITS]


def _set_columns(shared, width: int, threshold: float, seen: set | None):
    """The columns ``_SETS`` of some texts; of a class in ``seen`` the prefix is empty."""

    def run(texts: list[str | None]) -> list[pa.Array]:
        values, counts = shingle_sets(texts, width)
        bounds = np.r_[0, np.cumsum(counts)].tolist()
        cls = [xxhash.xxh3_64_intdigest(values[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
        first = np.ones(len(cls), bool)
        if seen is not None:
            for k, c in enumerate(cls):
                first[k] = c not in seen
                seen.add(c)
        kept, many = prefixes(values[np.repeat(first, counts)], np.where(first, counts, 0), shared.value, threshold)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), pa.array(kept.view(np.int64)))
        return [pa.array(np.array(cls, np.uint64).view(np.int64)), pa.array(counts.astype(np.int32)), pa.array(_fingerprints(values, counts).view(np.int64)), lists, *map(pa.array, bitmaps(values, counts).T.copy())]

    return run


def _classes(slim: DataFrame, common: np.ndarray, width: int, threshold: float) -> DataFrame:
    """``(id, th, cls, n, fp, prefix)`` per row; a task gives the prefix of a class once."""
    shared = slim.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _set_columns(shared, width, threshold, set())
        for batch in batches:
            for part, texts in chunks(batch.column(2)):
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[part.start : part.stop] for k in (0, 1)), *columns(texts)], names=["id", "th", *_SETS])

    kinds = [slim.schema["id"].dataType, T.LongType(), T.LongType(), T.IntegerType(), T.LongType(), T.ArrayType(T.LongType()), *[T.LongType()] * PARTS]
    return materialize(slim.select("id", "th", "text").mapInArrow(lean(run), T.StructType(list(map(T.StructField, ["id", "th", *_SETS], kinds)))), "classes")


def _texts(slim: DataFrame, one: DataFrame) -> DataFrame:
    """``(cls, text)`` for classes ``(cls, th)``; a class comes once for each row with its text."""
    few = one.count() <= BROADCAST_ROWS
    return slim.select("th", "text").join(F.broadcast(one) if few else one, "th").select("cls", "text")


def _exploded(sets: DataFrame) -> DataFrame:
    return sets.select("cls", "n", F.posexplode("prefix").alias("pos", "key"))


def _prefix_table(slim: DataFrame, rows: DataFrame, common: np.ndarray, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(cls, n, th, prefix)`` once for each class, with keys that turn out to be common last, and the shared keys."""
    spark = slim.sparkSession
    sets = materialize(rows.where(F.size("prefix") > 0).select("cls", "n", "th", "prefix").dropDuplicates(["cls"]), "prefixes")
    for k in range(ROUNDS + 1):
        # A key's rows are combined in each task before they are counted.
        keys = materialize(_exploded(sets).groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "keys")
        known = spark.createDataFrame(pa.table({"key": pa.array(common.view(np.int64))}), "key long")
        new = keys.where(F.col("m") > HEAVY).join(F.broadcast(known), "key", "left_anti")
        # As many as there is room for among the common ones.
        bins, left, least = new.groupBy(F.floor(F.log2("m") * 8).cast("int").alias("b")).agg(F.count("*").alias("n")).collect(), MOST_COMMON - len(common), 1 << 30
        for r in sorted(bins, key=lambda r: -r["b"]):
            left -= r["n"]
            if left < 0:
                break
            least = r["b"]
        heavy = _numbers(new.where(F.floor(F.log2("m") * 8) >= least).select("key")) if k < ROUNDS and least < 1 << 30 else []
        if not len(heavy):
            return sets, keys
        drop_materialized(keys)
        common = np.union1d(common, heavy.view(np.uint64))
        shared, newly = spark.sparkContext.broadcast(common), spark.createDataFrame(pa.table({"key": pa.array(heavy)}), "key long")
        moved = materialize(_exploded(sets).join(F.broadcast(newly), "key", "left_semi").groupBy("cls").agg(F.count("*").alias("n")).select("cls"), "moved")
        once = sets.join(moved, "cls", "left_semi").select("cls", "th")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns = _set_columns(shared, width, threshold, None)
            for batch in batches:
                for part, texts in chunks(batch.column(1)):
                    _, n, _, prefix, *_ = columns(texts)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], n, prefix], names=["cls", "n", "prefix"])

        again = _texts(slim, materialize(once, "once")).mapInArrow(lean(run), "cls long, n int, prefix array<long>").dropDuplicates(["cls"])
        again = again.join(once, "cls").select("cls", "n", "th", "prefix")
        before, sets = sets, materialize(sets.join(moved, "cls", "left_anti").union(again), "prefixes")
        drop_materialized(before, moved)
    raise AssertionError


def _similar(pairs: DataFrame, slim: DataFrame, rows: DataFrame, width: int, threshold: float) -> DataFrame:
    """Those of the pairs ``(a, b)`` of classes whose sets are similar."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch.column(1)):
                values, counts = shingle_sets(texts, width)
                bounds = np.r_[0, np.cumsum(counts)].tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.array([values[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], names=["cls", "members"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = int(_is_in(x, y).sum())
                fit.append(both >= threshold * (len(x) + len(y) - both) - SLACK)
            yield batch.select(["a", "b"]).filter(pa.array(fit, pa.bool_()))

    bits = rows.groupBy("cls").agg(F.first("n").alias("n"), *[F.first(b).alias(b) for b in BITS])
    bits = materialize(bits.join(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), "cls", "left_semi"), "bits")
    own, other = (F.struct("n", *BITS).alias(name) for name in ("l", "r"))
    near = pairs.join(bits.select(F.col("cls").alias("a"), own), "a").join(bits.select(F.col("cls").alias("b"), other), "b")
    pairs = materialize(near.where(_bits_fit(threshold)).select("a", "b"), "pairs")
    drop_materialized(bits)
    needed = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    # One text stands for a class; a hash tells texts apart, so rows may share an id.
    one = materialize(rows.join(needed, "cls", "left_semi").groupBy("cls").agg(F.min("th").alias("th")), "needed")
    found = _texts(slim, one).mapInArrow(lean(sets), "cls long, members binary").dropDuplicates(["cls"])
    full = pairs.join(found.toDF("b", "y"), "b").join(found.toDF("a", "x"), "a").select("a", "b", "x", "y")
    out = materialize(full.mapInArrow(lean(check), "a long, b long"), "links")
    drop_materialized(one, pairs)
    return out


def _simhash_pairs(rows: DataFrame) -> DataFrame:
    """Classes of one fingerprint with the smallest of them, and those smallest ones where SimHash links their fingerprints."""
    least = materialize(rows.groupBy("fp").agg(F.min("cls").alias("least"), F.max("cls").alias("most")), "least")
    same = rows.select("fp", "cls").join(least.where("least < most").select("fp", "least"), "fp").where("least < cls").select(F.col("least").alias("a"), F.col("cls").alias("b"))
    links = materialize(fingerprint_links(least.select("fp")), "links")
    ends = least.select("fp", "least")
    near = links.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.union(near)


def _may_be_similar(threshold: float):
    """Of two members ``l`` and ``r`` of a key: the sizes fit, and so do the members from the key on."""
    least = (F.col("l.n") + F.col("r.n")) * F.lit(threshold / (1 + threshold)) - SLACK
    return F.least(F.col("l.n") - F.col("l.pos"), F.col("r.n") - F.col("r.pos")) >= least


def _bits_fit(threshold: float):
    """Whether the bitmaps of two sets ``l`` and ``r`` differ in no more bits than similar sets can in members."""
    apart = sum((F.bit_count(F.col(f"l.{b}").bitwiseXOR(F.col(f"r.{b}"))) for b in BITS[1:]), F.bit_count(F.col("l.b0").bitwiseXOR(F.col("r.b0"))))
    return apart <= (F.col("l.n") + F.col("r.n")) * F.lit((1 - threshold) / (1 + threshold)) + SLACK


def _star_pairs(shared: DataFrame, threshold: float) -> DataFrame:
    """Each member of a key with one member of about its size: that whose own prefix is shared the most.

    Of a text and its copies, each changed elsewhere, that is the text or the copy nearest to it.
    """
    sized = shared.withColumn("about", F.floor(F.log("n") / -F.log(F.lit(threshold))))
    centre = F.max(F.struct("share", "cls", "n", "pos"))
    best = sized.groupBy("key", "about").agg(centre.alias("m"), F.min("cls").alias("c0"), F.max("cls").alias("c1")).where("c0 < c1").select("key", "about", "m.cls", "m.n", "m.pos")
    met = best.alias("l").join(sized.alias("r"), ["key", "about"]).where((F.col("l.cls") != F.col("r.cls")) & _may_be_similar(threshold))
    return _ordered(met)


def _ordered(met: DataFrame) -> DataFrame:
    return met.select(F.least("l.cls", "r.cls").alias("a"), F.greatest("l.cls", "r.cls").alias("b")).distinct()


def _open_members(shared: DataFrame, components: DataFrame, rows: DataFrame) -> DataFrame:
    """The members, with component and bitmap, of the keys whose members aren't all in one component."""
    members = shared.join(components.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    keys = members.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("key", "m")
    bits = rows.groupBy("cls").agg(*[F.first(b).alias(b) for b in BITS])
    return materialize(members.join(keys, "key").join(bits, "cls"), "members")


def _more_pairs(members: DataFrame, threshold: float, centres: int) -> DataFrame:
    """Each member of a key with the ``centres`` members, of other components, whose prefixes are shared the most."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("share"), "cls"))
    best = members.withColumn("place", place).where(F.col("place") <= centres)
    fit = (F.col("l.component") != F.col("r.component")) & _may_be_similar(threshold) & _bits_fit(threshold)
    return _ordered(best.alias("l").join(members.alias("r"), "key").where(fit))


def _other_pairs(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """All pairs of members of a key that are not in one component; large keys in blocks."""
    rows = members.withColumn("tiles", F.ceil(F.col("m") / tile).cast("int")).withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    left = rows.withColumn("i", F.col("tile")).withColumn("j", F.explode(F.sequence("tile", F.col("tiles") - 1)))
    right = rows.withColumn("j", F.col("tile")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tile"))))
    fit = (F.col("l.component") != F.col("r.component")) & ((F.col("l.i") < F.col("l.j")) | (F.col("l.cls") < F.col("r.cls"))) & _may_be_similar(threshold) & _bits_fit(threshold)
    return _ordered(left.alias("l").join(right.alias("r"), ["key", "i", "j"]).where(fit))


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def _named_classes(slim: DataFrame, width: int, threshold: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """``(id, th, cls, ...)`` per row, and ``(node, component)`` for the classes that are linked to others."""
    common = _common_shingles(slim, width)
    rows = _classes(slim, common, width, threshold)
    sets, keys = _prefix_table(slim, rows, common, width, threshold)
    few = keys.count() <= BROADCAST_ROWS
    keys = keys.select("key")
    met = materialize(_exploded(sets).join(F.broadcast(keys) if few else keys, "key"), "met")
    shares = met.groupBy("cls").agg((F.count("*") / F.first("n")).cast("float").alias("share"))
    shared = materialize(met.join(shares, "cls"), "shared")
    drop_materialized(sets, met)
    tried = materialize(_simhash_pairs(rows).union(_star_pairs(shared, threshold)).distinct(), "tried")
    links = materialize(_similar(tried, slim, rows, width, threshold), "links")
    linked = connected_components(links, "a", "b")
    for find in (lambda m: _more_pairs(m, threshold, CENTRES), lambda m: _other_pairs(m, threshold, tile)):
        members = _open_members(shared, linked, rows)
        pairs = materialize(find(members).join(tried, ["a", "b"], "left_anti"), "pairs")
        more = _similar(pairs, slim, rows, width, threshold)
        tried, before = materialize(tried.union(pairs), "tried"), tried
        links, old = materialize(links.union(more), "links"), links
        drop_materialized(before, old, members, pairs, more, linked)
        linked = connected_components(links, "a", "b")
    drop_materialized(shared, tried, links)
    return rows, linked


def near_copy_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``(id, component)``: per row the smallest id reachable over pairs of Jaccard ``threshold`` or more.

    ``docs`` is read several times: hand in a table, not a long plan. Repeated
    rows are members of one class; ids may be of any type that has an order;
    rows without an id take the component of their class (null, if no row of
    it has an id). An empty table gives an empty result.
    """
    rows, linked = _named_classes(_slim(docs, id_col, text_col), width, threshold, tile)
    least = rows.groupBy("cls").agg(F.min("id").alias("least"))
    named = materialize(least.join(linked, least.cls == linked.node, "left").select("cls", "least", F.coalesce("component", "cls").alias("c")), "named")
    of_class = named.select("cls", "c").join(named.groupBy("c").agg(F.min("least").alias("component")), "c").select("cls", "component")
    return rows.select("id", "cls").join(of_class, "cls").select("id", "component")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each component of near copies, with all its columns: that of the smallest id.

    Rows without an id come after all others; of rows of one id, that whose
    text has the smallest hash stays, and of rows equal in id and text any one.
    Null and empty texts are one component. Columns of any name are kept.
    """
    rows, linked = _named_classes(_slim(docs, id_col, text_col), width, threshold, TILE)
    # Equal rows are one before anything is joined, so no key of the joins below is hot.
    texts = materialize(rows.groupBy("cls", "id", "th").agg(F.count("*").alias("n")), "texts")
    least = texts.groupBy("cls").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th", "n")).alias("m"))
    named = least.join(linked, least.cls == linked.node, "left").select("m", F.coalesce("component", "cls").alias("c"))
    id_, th, n = fresh(docs.columns, "kept_id", "kept_th", "kept_n")
    kept = materialize(named.groupBy("c").agg(F.min("m").alias("m")).select(F.col("m.id").alias(id_), F.col("m.th").alias(th), F.col("m.n").alias(n)), "kept")
    drop_materialized(rows, texts, linked)
    same = docs[id_col].eqNullSafe(kept[id_]) & (F.xxhash64(docs[text_col]) == kept[th])
    if kept.where(F.col(n) > 1).isEmpty():  # the usual case: rows differ
        return docs.join(kept, same, "left_semi")
    marked = docs.join(kept, same)
    once = marked.where(F.col(n) == 1).select(*docs.columns)
    return once.unionByName(marked.where(F.col(n) > 1).dropDuplicates([id_, th]).select(*docs.columns))
