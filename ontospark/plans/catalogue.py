"""All queries over the relational tables, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ontospark.functions import text as tx
from ontospark.operators import annotations as an
from ontospark.operators import corpora as co
from ontospark.operators import evaluation as ev
from ontospark.operators import graph as gr
from ontospark.operators import matching as ma
from ontospark.operators import projection as pj
from ontospark.operators import reasoning as re_
from ontospark.operators import scoring as sc
from ontospark.operators import verbalisation as vb
from ontospark.operators.ontology import Ontology, entity_summary
from ontospark.runtime import connected_components, materialize
from ontospark.sources import adapters as ad
from ontospark.sources.adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "idf_select_topk"


def query(sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            ORACLE_SQL[build.__name__] = sql
        return build

    return register


# --- shared pieces, in Spark and in SQL ---------------------------------------------------------

DL = """dl AS (SELECT DISTINCT iri, literal FROM (SELECT doc_id AS iri, lower(replace(line, '_', ' ')) AS literal FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE literal <> '')"""
BL = """bl AS (SELECT DISTINCT iri, literal FROM (SELECT item_id AS iri, lower(replace(line, '_', ' ')) AS literal FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark)) WHERE literal <> '')"""
IDF = f"""{DL}, {BL},
    dt AS (SELECT iri AS source, token, count(*) AS qf FROM (SELECT iri, unnest(string_split(literal, ' ')) AS token FROM dl) WHERE token <> '' GROUP BY ALL),
    bt AS (SELECT iri AS target, token, count(*) AS tf FROM (SELECT iri, unnest(string_split(literal, ' ')) AS token FROM bl) WHERE token <> '' GROUP BY ALL),
    idf AS (SELECT token, log10((SELECT count(DISTINCT item_id) FROM benchmark) / sum(tf)) AS idf FROM bt GROUP BY token),
    scored AS (SELECT source, target, round(sum(qf * tf * idf), 6) AS score FROM dt JOIN bt USING (token) JOIN idf USING (token) GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS place FROM scored)"""
GOLD = "gold AS (SELECT DISTINCT dl.iri AS source, bl.iri AS target FROM dl JOIN bl USING (literal))"
PART = """kinds AS (SELECT DISTINCT p_type, p_brand FROM part),
    edges AS (SELECT 'root' AS parent, 'type:' || p_type AS child FROM kinds UNION SELECT 'root', 'brand:' || p_brand FROM kinds
        UNION SELECT 'type:' || p_type, 'tb:' || p_type || '|' || p_brand FROM kinds UNION SELECT 'brand:' || p_brand, 'tb:' || p_type || '|' || p_brand FROM kinds
        UNION SELECT 'tb:' || p_type || '|' || p_brand, 'part:' || p_partkey FROM part UNION SELECT 'type:' || p_type, 'part:' || p_partkey FROM part)"""
GEO = """edges AS (SELECT 'root' AS parent, 'region:' || r_regionkey AS child FROM region UNION SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey FROM nation
        UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer UNION SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier)"""
CLOS = "clos(a, d) AS (SELECT parent, child FROM edges UNION SELECT clos.a, edges.child FROM clos JOIN edges ON clos.d = edges.parent)"


def _docs(t: Tables) -> DataFrame:
    return ad.line_literals(t.documents, "doc_id")


def _items(t: Tables) -> DataFrame:
    return ad.line_literals(t.benchmark, "item_id")


def _keys(t: Tables) -> int:
    return t.benchmark.select("item_id").distinct().count()


def _idf(t: Tables, pool: int) -> DataFrame:
    return an.idf_select(_docs(t), _items(t), _keys(t), pool)


def _gold(t: Tables) -> DataFrame:
    return ma.string_match(_docs(t), _items(t))


def _ignored(t: Tables) -> DataFrame:
    return t.labels.where("toxic = 1").select(F.col("doc_id").alias("iri"))


# --- entities and annotations ---------------------------------------------------------------------


@query("""SELECT 'Classes' AS entity_type, CAST((SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM part) AS BIGINT) AS n
    UNION ALL SELECT 'Individuals', CAST((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS BIGINT)
    UNION ALL SELECT 'ObjectProperties', CAST(2 AS BIGINT) UNION ALL SELECT 'DataProperties', CAST(0 AS BIGINT) UNION ALL SELECT 'AnnotationProperties', CAST(0 AS BIGINT)""")
def entity_counts(t: Tables) -> DataFrame:
    kind = lambda df, prefix, key, k: df.select(ad.tagged(prefix, key).alias("iri"), F.lit(k).alias("entity_type"))
    rows = kind(t.region, "region", "r_regionkey", "Classes").union(kind(t.nation, "nation", "n_nationkey", "Classes")).union(kind(t.part, "part", "p_partkey", "Classes"))
    rows = rows.union(kind(t.customer, "customer", "c_custkey", "Individuals")).union(kind(t.supplier, "supplier", "s_suppkey", "Individuals"))
    return entity_summary(rows.union(t.spark.createDataFrame([("contains", "ObjectProperties"), ("suppliedBy", "ObjectProperties")], "iri string, entity_type string")))


@query(f"WITH {DL} SELECT iri, literal FROM dl")
def annotation_index_long(t: Tables) -> DataFrame:
    return _docs(t)


@query(f"WITH {DL} SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS n_keys, count(*) AS n_literals, round(count(*) / (SELECT count(DISTINCT doc_id) FROM documents), 3) AS mean FROM dl")
def annotation_stats(t: Tables) -> DataFrame:
    return an.mean_literals(an.annotation_index(t.documents.select(F.col("doc_id").alias("iri")), _docs(t)))


@query("SELECT DISTINCT conv_id AS iri, lower(replace(text, '_', ' ')) AS literal FROM conversations WHERE role = 'user' AND text <> ''")
def annotations_by_property(t: Tables) -> DataFrame:
    annotations = t.conversations.select(F.col("conv_id").alias("iri"), F.col("role").alias("property_iri"), F.col("text").alias("literal"))
    return an.annotation_literals(annotations, ["user"])


@query(f"WITH {BL} SELECT iri, token, count(*) AS tf FROM (SELECT iri, unnest(string_split(literal, ' ')) AS token FROM bl) WHERE token <> '' GROUP BY ALL")
def inverted_index_postings(t: Tables) -> DataFrame:
    return an.postings(_items(t)).select("iri", "token", "tf")


@query(f"WITH {IDF} SELECT token, round(idf, 6) AS idf FROM idf")
def token_idf(t: Tables) -> DataFrame:
    return an.token_idf(an.postings(_items(t)), _keys(t)).select("token", F.round("idf", 6).alias("idf"))


@query(f"WITH {IDF} SELECT source, target, score, place FROM placed WHERE place <= 10")
def idf_select_topk(t: Tables) -> DataFrame:
    return _idf(t, 10).select("source", "target", "score", F.col("place").cast("long").alias("place"))


@query("SELECT iri, literal FROM (SELECT page_id AS iri, regexp_extract(html, '<title>([^<]*)</title>', 1) AS literal FROM pages) WHERE literal <> ''")
def page_titles(t: Tables) -> DataFrame:
    return t.pages.select(F.col("page_id").alias("iri"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("literal")).where("literal <> ''")


# --- matching -----------------------------------------------------------------------------------------


@query(f"WITH {DL}, {BL}, {GOLD} SELECT source, target, CAST(1 AS DOUBLE) AS score FROM gold")
def string_match_mappings(t: Tables) -> DataFrame:
    return _gold(t)


@query(f"WITH {IDF}, {GOLD} SELECT source, target, CAST(1 AS DOUBLE) AS score FROM gold JOIN placed USING (source, target) WHERE place <= 200")
def lt_matcher(t: Tables) -> DataFrame:
    return ma.light_match(_idf(t, 200), _docs(t), _items(t))


@query(f"WITH {DL}, {BL}, {GOLD} SELECT source, target, CAST(1 AS DOUBLE) AS score FROM gold WHERE source NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def ignored_filter(t: Tables) -> DataFrame:
    none = t.benchmark.select(F.col("item_id").alias("iri")).where("false")
    return ma.drop_ignored(_gold(t), _ignored(t), none).select("source", "target", "score")


@query("""WITH names AS (SELECT DISTINCT p_type AS kind, p_name AS name FROM part)
    SELECT a.name AS source, b.name AS target, round(max(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))), 6) AS score
    FROM names a JOIN names b ON a.kind = b.kind AND a.name < b.name GROUP BY ALL""")
def edit_similarity_max(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_type").alias("kind"), F.col("p_name").alias("iri")).distinct()
    pairs = names.select("kind", F.col("iri").alias("source")).join(names.select("kind", F.col("iri").alias("target")), "kind").where("source < target").select("source", "target")
    own = names.select("iri", F.col("iri").alias("literal")).distinct()
    return ma.edit_scores(pairs, own, own)


@query(f"WITH {IDF} SELECT source, target, score FROM placed WHERE place = 1 AND score >= 5")
def threshold_top1(t: Tables) -> DataFrame:
    return ma.at_least(_idf(t, 1), 5.0).select("source", "target", "score")


@query("""WITH g AS (SELECT nation.n_nationkey AS n, n_regionkey AS r FROM nation),
    seeds AS (SELECT DISTINCT 'customer:' || c_custkey AS source, 'supplier:' || s_suppkey AS target FROM customer JOIN supplier ON c_custkey = s_suppkey),
    pe AS (SELECT 'customer:' || c_custkey AS child, 'nation:' || c_nationkey AS parent FROM customer), te AS (SELECT 'supplier:' || s_suppkey AS child, 'nation:' || s_nationkey AS parent FROM supplier)
    SELECT DISTINCT pe.parent AS source, te.parent AS target FROM seeds JOIN pe ON seeds.source = pe.child JOIN te ON seeds.target = te.child""")
def mapping_extension_1hop(t: Tables) -> DataFrame:
    seeds = t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey")).select(ad.tagged("customer", "c_custkey").alias("source"), ad.tagged("supplier", "s_suppkey").alias("target"))
    ce = t.customer.select(ad.tagged("customer", "c_custkey").alias("child"), ad.tagged("nation", "c_nationkey").alias("parent"))
    se = t.supplier.select(ad.tagged("supplier", "s_suppkey").alias("child"), ad.tagged("nation", "s_nationkey").alias("parent"))
    return ma.one_hop(seeds, ce, se)


@query("""WITH RECURSIVE seeds AS (SELECT 'customer:' || c_custkey AS source, 'supplier:' || s_suppkey AS target FROM customer JOIN supplier ON c_custkey = s_suppkey),
    pe AS (SELECT 'customer:' || c_custkey AS child, 'nation:' || c_nationkey AS parent FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
    te AS (SELECT 'supplier:' || s_suppkey AS child, 'nation:' || s_nationkey AS parent FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
    ps AS (SELECT child AS x, parent AS y, 'up' AS way FROM pe UNION SELECT parent, child, 'down' FROM pe), ts AS (SELECT child AS x, parent AS y, 'up' AS way FROM te UNION SELECT parent, child, 'down' FROM te),
    ext(source, target) AS (SELECT source, target FROM seeds UNION SELECT ps.y, ts.y FROM ext JOIN ps ON source = ps.x JOIN ts ON target = ts.x AND ps.way = ts.way WHERE ps.y = ts.y)
    SELECT source, target, CAST(1 AS DOUBLE) AS score FROM ext""")
def mapping_extension_fix(t: Tables) -> DataFrame:
    seeds = t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey")).select(ad.tagged("customer", "c_custkey").alias("source"), ad.tagged("supplier", "s_suppkey").alias("target"), F.lit(1.0).alias("score"))
    up = t.nation.select(ad.tagged("nation", "n_nationkey").alias("child"), ad.tagged("region", "n_regionkey").alias("parent"))
    ce = t.customer.select(ad.tagged("customer", "c_custkey").alias("child"), ad.tagged("nation", "c_nationkey").alias("parent")).union(up)
    se = t.supplier.select(ad.tagged("supplier", "s_suppkey").alias("child"), ad.tagged("nation", "s_nationkey").alias("parent")).union(up)
    same = lambda pairs: pairs.withColumn("score", (F.col("source") == F.col("target")).cast("double"))
    return ma.extend_mappings(seeds, ce, se, same, kappa=0.9, block=lambda iri: iri)  # different ids score 0


@query(f"""WITH {DL}, {BL}, {GOLD}, te AS (SELECT item_id AS child, 'n' || (item_id // 10) AS parent FROM benchmark) SELECT DISTINCT source, parent AS target FROM gold JOIN te ON target = child""")
def subs_from_equiv(t: Tables) -> DataFrame:
    te = t.benchmark.select(F.col("item_id").alias("child"), F.concat(F.lit("n"), F.expr("item_id div 10").cast("string")).alias("parent"))
    edges = te.select("parent", F.col("child").cast("string").alias("child"))
    gold = _gold(t).select("source", F.col("target").cast("string").alias("target"))
    return ma.subsumptions_from_equivalences(gold, edges).select("source", "target")


@query()
def subs_from_equiv_online(t: Tables) -> DataFrame:
    te = t.benchmark.select(F.concat(F.lit("n"), F.expr("item_id div 10").cast("string")).alias("parent"), F.col("item_id").cast("string").alias("child"))
    gold = _gold(t).select(F.struct("source", "target").cast("struct<source:string,target:string>").alias("p"), "source", F.col("target").cast("string").alias("target"))
    ordered = gold.select(F.xxhash64("source", "target").alias("position"), "source", "target")
    return ma.subsumptions_from_equivalences(ordered, te, delete=True)


@query()
def mapping_repair(t: Tables) -> DataFrame:
    return ma.repair_one_to_one(_idf(t, 10).select("source", "target", "score"))


# --- evaluation ---------------------------------------------------------------------------------------

_TOP1 = "top1 AS (SELECT source, target FROM placed WHERE place = 1)"
_PRF = """SELECT round(hit / nullif(p, 0), 3) AS P, round(hit / nullif(r, 0), 3) AS R, round(2 * (hit / nullif(p, 0)) * (hit / nullif(r, 0)) / nullif(hit / nullif(p, 0) + hit / nullif(r, 0), 0), 3) AS F1"""


@query(f"WITH {IDF}, {GOLD}, {_TOP1} {_PRF} FROM (SELECT (SELECT count(*) FROM top1) AS p, (SELECT count(*) FROM gold) AS r, (SELECT count(*) FROM top1 JOIN gold USING (source, target)) AS hit)")
def matching_eval(t: Tables) -> DataFrame:
    return ev.precision_recall_f1(_idf(t, 1), _gold(t))


@query(f"""WITH {IDF}, {GOLD}, {_TOP1}, ig AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), p2 AS (SELECT * FROM top1 WHERE source NOT IN (SELECT doc_id FROM ig)), g2 AS (SELECT * FROM gold WHERE source NOT IN (SELECT doc_id FROM ig))
    {_PRF} FROM (SELECT (SELECT count(*) FROM p2) AS p, (SELECT count(*) FROM g2) AS r, (SELECT count(*) FROM p2 JOIN g2 USING (source, target)) AS hit)""")
def matching_eval_null(t: Tables) -> DataFrame:
    bad = _ignored(t).select(F.col("iri").alias("source"))
    top, gold = _idf(t, 1), _gold(t)
    unknown = top.join(bad, "source", "left_semi").select("source", "target").union(gold.join(bad, "source", "left_semi").select("source", "target"))
    return ev.precision_recall_f1(top, gold, unknown)


_RANKS = f"WITH {IDF}, {GOLD}, ranked AS (SELECT gold.source, gold.target, place AS rank FROM gold LEFT JOIN (SELECT * FROM placed WHERE place <= 200) USING (source, target))"


@query(f"{_RANKS} SELECT round(avg(coalesce(1 / rank, 0)), 6) AS MRR, round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS Hits_1, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS Hits_5, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS Hits_10 FROM ranked")
def ranking_eval(t: Tables) -> DataFrame:
    return ev.ranking_metrics(ev.ranks(_idf(t, 200), _gold(t)))


@query(f"{_RANKS} SELECT source, target, CAST(rank AS BIGINT) AS rank FROM ranked")
def gold_ranks(t: Tables) -> DataFrame:
    return ev.ranks(_idf(t, 200), _gold(t)).select("source", "target", F.col("rank").cast("long").alias("rank"))


@query("""WITH l AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id)
    SELECT conv_id, role AS item, (n - i) / n AS score FROM (SELECT conv_id, unnest(roles) AS role, unnest(range(0, len(roles))) AS i, len(roles) AS n FROM l)""")
def positional_scores(t: Tables) -> DataFrame:
    lists = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    return ev.positional_scores(lists, "roles")


@query(f"""WITH {IDF}, um AS (SELECT doc_id AS source FROM documents EXCEPT SELECT dl.iri FROM dl JOIN bl USING (literal)), said AS (SELECT source, bool_or(score >= 5) AS any FROM placed WHERE place <= 10 GROUP BY source)
    SELECT round(avg(CASE WHEN coalesce("any", false) THEN 0.0::DOUBLE ELSE 1 END), 6) AS RR FROM um LEFT JOIN said USING (source)""")
def rejection_rate(t: Tables) -> DataFrame:
    unmatched = t.documents.select(F.col("doc_id").alias("source")).distinct().join(_gold(t).select("source"), "source", "left_anti")
    return ev.rejection_rate(_idf(t, 10).select("source", (F.col("score") >= 5).alias("answer")), unmatched)


@query("""WITH r AS (SELECT event_id, CASE WHEN value >= 1 THEN CAST(floor(value) AS BIGINT) END AS rank FROM events)
    SELECT event_id, rank, row_number() OVER w AS n, round(avg(coalesce(1 / rank, 0)) OVER w, 6) AS running_mrr FROM r WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def running_metrics(t: Tables) -> DataFrame:
    ranked = t.events.select("event_id", F.when(F.col("value") >= 1, F.floor("value").cast("long")).alias("rank"))
    return ev.running_metrics(ranked, "event_id").select("event_id", "rank", "n", "running_mrr")


@query("SELECT round(avg(CASE WHEN (CASE WHEN quality = 1 THEN 0 ELSE 1 END) = toxic THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM labels")
def label_accuracy(t: Tables) -> DataFrame:
    return sc.accuracy(t.labels.select((F.lit(1.0) - F.col("quality")).alias("score"), F.col("toxic").alias("label")))


# --- graph ----------------------------------------------------------------------------------------------


@query(f"WITH {PART} SELECT parent, child FROM edges")
def part_hierarchy(t: Tables) -> DataFrame:
    return ad.part_edges(t)


@query(f"WITH RECURSIVE {PART}, {CLOS} SELECT a AS ancestor, d AS descendant FROM clos")
def ancestors(t: Tables) -> DataFrame:
    return gr.closure(ad.part_edges(t)).select("ancestor", "descendant")


@query(f"WITH RECURSIVE {GEO}, {CLOS} SELECT d AS descendant FROM clos WHERE a = 'region:1'")
def descendants(t: Tables) -> DataFrame:
    return gr.closure(ad.geo_edges(t)).where("ancestor = 'region:1'").select("descendant")


@query(f"WITH {GEO} SELECT parent, count(*) AS n_children, min(child) AS first_child FROM edges GROUP BY parent")
def parents_children(t: Tables) -> DataFrame:
    return gr.edge_table(ad.geo_edges(t)).groupBy("parent").agg(F.count("*").alias("n_children"), F.min("child").alias("first_child"))


@query(f"WITH RECURSIVE {PART}, {CLOS}, under AS (SELECT d FROM clos WHERE a = 'type:SMALL') SELECT parent, child FROM edges WHERE parent IN (SELECT d FROM under) AND child IN (SELECT d FROM under)")
def descendant_graph(t: Tables) -> DataFrame:
    return gr.descendant_graph(ad.part_edges(t), "type:SMALL")


@query(f"""WITH RECURSIVE {PART}, lev(id, k) AS (SELECT 'root', 0 UNION SELECT child, k + 1 FROM lev JOIN edges ON id = parent) SELECT id, CAST(min(k) AS INTEGER) AS shortest, CAST(max(k) AS INTEGER) AS longest, CAST(max(k) + 1 AS INTEGER) AS longest_nodes FROM lev GROUP BY id""")
def depths(t: Tables) -> DataFrame:
    return gr.depths(ad.part_edges(t))


@query(f"""WITH RECURSIVE {PART}, {CLOS}, own AS (SELECT a, d FROM clos UNION SELECT child, child FROM edges UNION SELECT 'root', 'root'),
    pairs AS (SELECT 'part:' || x.p_partkey AS a, 'part:' || y.p_partkey AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 7),
    common AS (SELECT p.a, p.b, o.a AS c FROM pairs p JOIN own o ON o.d = p.a JOIN own q ON q.d = p.b AND q.a = o.a)
    SELECT a, b, min(c) AS lca FROM common c1 WHERE NOT EXISTS (SELECT 1 FROM common c2 JOIN clos ON clos.a = c1.c AND clos.d = c2.c WHERE c2.a = c1.a AND c2.b = c1.b) GROUP BY a, b""")
def lca_pairs(t: Tables) -> DataFrame:
    other = t.part.select((F.col("p_partkey") - 7).alias("p_partkey"), ad.tagged("part", "p_partkey").alias("b"))
    pairs = t.part.join(other, "p_partkey").select(ad.tagged("part", "p_partkey").alias("a"), "b")
    return gr.lowest_common_ancestors(pairs, ad.part_edges(t))


@query(f"WITH RECURSIVE {PART}, {CLOS} SELECT parent, child FROM edges e WHERE NOT EXISTS (SELECT 1 FROM clos JOIN edges f ON clos.d = f.parent WHERE clos.a = e.parent AND f.child = e.child)")
def direct_parents(t: Tables) -> DataFrame:
    return gr.reduction(ad.part_edges(t))


@query("""SELECT 'nation:' || n_nationkey AS parent, 'customer:' || c_custkey AS child FROM nation JOIN customer ON n_nationkey = c_nationkey
    UNION ALL SELECT 'root', 'nation:' || n_nationkey FROM nation""")
def orphans_to_root(t: Tables) -> DataFrame:
    edges = t.customer.select(ad.tagged("nation", "c_nationkey").alias("parent"), ad.tagged("customer", "c_custkey").alias("child"))
    ids = gr.nodes(edges).union(t.nation.select(ad.tagged("nation", "n_nationkey")))
    return gr.orphans_to_root(edges, ids)


@query(f"WITH {PART}, n AS (SELECT parent, count(*) AS siblings FROM edges GROUP BY parent HAVING count(*) > 1) SELECT parent, child, siblings FROM edges JOIN n USING (parent)")
def sibling_groups(t: Tables) -> DataFrame:
    return gr.sibling_groups(ad.part_edges(t))


@query("""SELECT 'brand:' || a.p_brand AS a, 'brand:' || b.p_brand AS b, CAST(count(*) AS BIGINT) AS shared FROM (SELECT DISTINCT p_brand, p_type FROM part) a JOIN (SELECT DISTINCT p_brand, p_type FROM part) b USING (p_type) WHERE a.p_brand <> b.p_brand GROUP BY ALL""")
def sibling_pairs(t: Tables) -> DataFrame:
    return gr.sibling_pairs(t.part.select(ad.tagged("type", "p_type").alias("parent"), ad.tagged("brand", "p_brand").alias("child")))


@query(f"""WITH {PART} SELECT parent, child FROM edges WHERE NOT starts_with(parent, 'tb:') AND NOT starts_with(child, 'tb:')
    UNION SELECT e.parent, f.child FROM edges e JOIN edges f ON e.child = f.parent WHERE starts_with(e.child, 'tb:')""")
def prune_bridge(t: Tables) -> DataFrame:
    edges = ad.part_edges(t)
    return gr.prune(edges, gr.nodes(edges).where(F.col("id").startswith("tb:")))


@query(f"""WITH {GEO}, near_ AS (SELECT parent AS x, child AS y FROM edges UNION SELECT child, parent FROM edges),
    s AS (SELECT 'nation:' || n_nationkey AS s FROM nation), h1 AS (SELECT s, y FROM s JOIN near_ ON s = x), h2 AS (SELECT DISTINCT s, near_.y FROM h1 JOIN near_ ON h1.y = x WHERE near_.y <> s AND (s, near_.y) NOT IN (SELECT s, y FROM h1))
    SELECT s AS start, y AS id, CAST(1 AS INTEGER) AS hop FROM h1 UNION ALL SELECT s, y, 2 FROM h2""")
def neighbour_hops(t: Tables) -> DataFrame:
    return gr.neighbours(t.nation.select(ad.tagged("nation", "n_nationkey").alias("id")), ad.geo_edges(t), 2)


@query()
def bounded_neighbours(t: Tables) -> DataFrame:
    return gr.bounded_neighbours(t.nation.select(ad.tagged("nation", "n_nationkey").alias("id")), ad.geo_edges(t), 3, 8)


@query(f"""WITH {GEO}, up AS (SELECT child, min(parent) AS parent FROM edges GROUP BY child), s0 AS (SELECT 'customer:' || c_custkey AS start, 'customer:' || c_custkey AS id FROM customer),
    s1 AS (SELECT start, parent AS id FROM s0 JOIN up ON id = child), s2 AS (SELECT start, parent AS id FROM s1 JOIN up ON id = child)
    SELECT start, CAST(0 AS INTEGER) AS step, id FROM s0 UNION ALL SELECT start, 1, id FROM s1 UNION ALL SELECT start, 2, id FROM s2""")
def greedy_paths(t: Tables) -> DataFrame:
    return gr.greedy_paths(t.customer.select(ad.tagged("customer", "c_custkey").alias("id")), ad.geo_edges(t), 2)


@query(f"""WITH {GEO}, up AS (SELECT child, min(parent) AS parent FROM edges GROUP BY child)
    SELECT a.child AS start, a.child || ' <SUB> ' || a.parent || coalesce(' <SUB> ' || b.parent, '') AS context FROM up a LEFT JOIN up b ON a.parent = b.child WHERE starts_with(a.child, 'customer:')""")
def path_context(t: Tables) -> DataFrame:
    edges = ad.geo_edges(t)
    paths = gr.greedy_paths(t.customer.select(ad.tagged("customer", "c_custkey").alias("id")), edges, 2)
    return co.context_strings(paths, gr.nodes(edges).select(F.col("id").alias("iri"), F.col("id").alias("name")), " <SUB> ")


@query("SELECT conv_id AS start, string_agg(role, ' <SEP> ' ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def traversal_context(t: Tables) -> DataFrame:
    paths = t.conversations.select(F.col("conv_id").alias("start"), F.col("turn").alias("step"), F.col("role").alias("id"))
    names = t.conversations.select(F.col("role").alias("iri"), F.col("role").alias("name")).distinct()
    return co.context_strings(paths, names, " <SEP> ")


@query("""WITH RECURSIVE e AS (SELECT 'order:' || l_orderkey AS s, 'contains' AS r, 'part:' || l_partkey AS t FROM lineitem UNION SELECT 'part:' || l_partkey, 'suppliedBy', 'supplier:' || l_suppkey FROM lineitem),
    f AS (SELECT s, min_by({'r': r, 't': t}, r || ' ' || t) AS n FROM e GROUP BY s)
    SELECT s AS start, CAST(0 AS INTEGER) AS walk, CAST(0 AS INTEGER) AS step, s AS token FROM f
    UNION ALL SELECT s, 0, 1, n.r FROM f UNION ALL SELECT s, 0, 2, n.t FROM f
    UNION ALL SELECT a.s, 0, 3, b.n.r FROM f a JOIN f b ON a.n.t = b.s UNION ALL SELECT a.s, 0, 4, b.n.t FROM f a JOIN f b ON a.n.t = b.s""")
def walks_det(t: Tables) -> DataFrame:
    facts = ad.order_facts(t).toDF("source", "relation", "target")
    return gr.random_walks(facts, 1, 2, first=True)


@query()
def walks_random(t: Tables) -> DataFrame:
    return gr.random_walks(ad.order_facts(t).toDF("source", "relation", "target"), 2, 3, restart=0.1, seed=7)


@query()
def walks_biased(t: Tables) -> DataFrame:
    e = ad.geo_edges(t)
    both = e.select(F.col("parent").alias("source"), F.col("child").alias("target")).union(e.select("child", "parent")).withColumn("weight", F.lit(1.0))
    return gr.biased_walks(both, 1, 3, p=0.5, q=2.0, seed=3)


@query()
def connected_synonyms(t: Tables) -> DataFrame:
    """Over every part and supplier of lineitem; the closure of pairs that SQL would need is too large."""
    g = t.lineitem.select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()
    return connected_components(g, "a", "b")


# --- corpora --------------------------------------------------------------------------------------------

_GROUPS = "g AS (SELECT DISTINCT p_brand AS group_id, p_name AS literal FROM part)"


def _name_groups(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_brand").alias("iri"), F.col("p_name").alias("literal"))


@query(f"WITH {_GROUPS} SELECT DISTINCT x.literal AS a, y.literal AS b FROM g x JOIN g y USING (group_id)")
def synonym_pairs(t: Tables) -> DataFrame:
    return co.synonym_pairs(co.synonym_groups(_name_groups(t)))


@query("""WITH f AS (SELECT c_nationkey AS group_id, min(c_name) AS literal FROM customer GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY group_id) AS k, count(*) OVER () AS n FROM f)
    SELECT DISTINCT x.literal AS a, y.literal AS b FROM k x JOIN k y ON y.k = x.k % x.n + 1 WHERE x.group_id <> y.group_id AND x.literal <> y.literal""")
def soft_nonsynonyms_det(t: Tables) -> DataFrame:
    groups = t.customer.select(F.col("c_nationkey").alias("group_id"), F.col("c_name").alias("literal"))
    return co.soft_nonsynonyms(groups)


@query("""WITH n AS (SELECT c_nationkey AS parent, 'customer:' || c_custkey AS child, c_name AS literal FROM customer), l AS (SELECT literal AS a, lead(literal) OVER (PARTITION BY parent ORDER BY child) AS b FROM n) SELECT DISTINCT a, b FROM l WHERE b IS NOT NULL AND a <> b""")
def hard_nonsynonyms_det(t: Tables) -> DataFrame:
    edges = t.customer.select(F.col("c_nationkey").cast("string").alias("parent"), ad.tagged("customer", "c_custkey").alias("child"))
    return co.hard_nonsynonyms(edges, t.customer.select(ad.tagged("customer", "c_custkey").alias("iri"), F.col("c_name").alias("literal")))


_CROSS = f"{DL}, {BL}, {GOLD}, cross_(a, b) AS (SELECT dl.literal, bl.literal FROM gold JOIN dl ON source = dl.iri JOIN bl ON target = bl.iri WHERE dl.literal <> bl.literal)"


@query(f"WITH {_CROSS} SELECT a, b FROM cross_ UNION SELECT b, a FROM cross_")
def cross_synonyms(t: Tables) -> DataFrame:
    return co.cross_synonyms(_gold(t), _docs(t), _items(t))


@query(f"""WITH {_GROUPS}, syn AS (SELECT DISTINCT x.literal AS a, y.literal AS b FROM g x JOIN g y USING (group_id)),
    n AS (SELECT p_type AS parent, p_brand AS child, min(p_name) AS literal FROM part GROUP BY ALL), non AS (SELECT literal AS a, lead(literal) OVER (PARTITION BY parent ORDER BY child) AS b FROM n),
    no2 AS (SELECT DISTINCT a, b FROM non WHERE b IS NOT NULL AND a <> b EXCEPT SELECT a, b FROM syn)
    SELECT a AS text_a, b AS text_b, CAST(1 AS INTEGER) AS label FROM syn UNION ALL SELECT a, b, 0 FROM no2""")
def corpora_union(t: Tables) -> DataFrame:
    both = t.part.groupBy("p_type", "p_brand").agg(F.min("p_name").alias("literal"))
    named = both.select(F.col("p_type").alias("parent"), F.concat("p_type", F.lit("/"), "p_brand").alias("child"), "literal", "p_brand")
    hard = co.hard_nonsynonyms(named, named.select(F.col("child").alias("iri"), "literal"))
    return co.corpus([co.synonym_pairs(co.synonym_groups(_name_groups(t)))], [hard])


@query("SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN 'valid' WHEN c_custkey % 20 IN (1, 2) THEN 'test' ELSE 'train' END AS split FROM customer")
def subsumption_split(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 20
    return t.customer.select("c_custkey", F.when(k == 0, "valid").when(k.isin(1, 2), "test").otherwise("train").alias("split"))


@query()
def hashed_split(t: Tables) -> DataFrame:
    return co.split(t.customer.select("c_custkey"), ["c_custkey"], {"valid": 0.05, "test": 0.1, "train": 0.85}, 1)


@query(f"""WITH RECURSIVE {GEO}, {CLOS}, cls AS (SELECT iri, row_number() OVER (ORDER BY iri) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT child AS iri FROM edges)),
    pos AS (SELECT child AS sub, parent AS sup FROM edges WHERE parent <> 'root'),
    probe AS (SELECT sub, sup, c.iri AS negative, (c.k - s.k + s.n - 1) % s.n AS i FROM pos JOIN cls s ON s.iri = sub JOIN cls c ON c.iri <> sub AND (c.k - s.k + s.n - 1) % s.n < 12 WHERE NOT EXISTS (SELECT 1 FROM clos WHERE clos.d = sub AND clos.a = c.iri)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY sub, sup ORDER BY i) AS place FROM probe) SELECT sub, sup, negative, CAST(place AS INTEGER) AS place FROM placed WHERE place <= 5""")
def negative_named(t: Tables) -> DataFrame:
    edges = ad.geo_edges(t)
    positives = edges.where("parent <> 'root'").select(F.col("child").alias("sub"), F.col("parent").alias("sup"))
    return co.negative_classes(positives, edges.select(F.col("child").alias("iri")), gr.closure(edges), 5)


@query(f"""WITH {GEO}, near_ AS (SELECT parent AS x, child AS y FROM edges UNION SELECT child, parent FROM edges), ref AS (SELECT 'customer:' || c_custkey AS source, 'nation:' || c_nationkey AS target FROM customer),
    h1 AS (SELECT DISTINCT target, y FROM ref JOIN near_ ON target = x), near AS (SELECT target, y, 1 AS hop FROM h1 UNION ALL SELECT DISTINCT h1.target, b.y, 2 FROM h1 JOIN near_ b ON h1.y = b.x WHERE b.y <> h1.target AND (h1.target, b.y) NOT IN (SELECT target, y FROM h1)),
    p AS (SELECT source, target, y AS candidate, hop, row_number() OVER (PARTITION BY source, target ORDER BY hop, y) AS place FROM ref JOIN near USING (target))
    SELECT source, target, candidate, CAST(hop AS INTEGER) AS hop, CAST(place AS INTEGER) AS place FROM p WHERE place <= 5""")
def neighbour_candidates(t: Tables) -> DataFrame:
    ref = t.customer.select(ad.tagged("customer", "c_custkey").alias("source"), ad.tagged("nation", "c_nationkey").alias("target"))
    return co.neighbour_candidates(ref, ad.geo_edges(t), 5, 2).select("source", "target", "candidate", "hop", "place")


@query(f"""WITH {IDF}, {GOLD}, ref AS (SELECT source, target FROM gold),
    i1 AS (SELECT r.source, r.target, p.target AS candidate, row_number() OVER (PARTITION BY r.source, r.target ORDER BY p.place, p.target) AS k FROM ref r JOIN placed p ON p.source = r.source AND p.place <= 200 AND (p.source, p.target) NOT IN (SELECT source, target FROM gold)),
    s1 AS (SELECT source, target, candidate FROM i1 WHERE k <= 5),
    ring AS (SELECT r.source, r.target, b.item_id AS candidate, b.item_id AS place FROM ref r, benchmark b WHERE (r.source, b.item_id) NOT IN (SELECT source, target FROM gold)),
    rest AS (SELECT source, target, candidate, row_number() OVER (PARTITION BY source, target ORDER BY place, candidate) AS k FROM ring WHERE (source, target, candidate) NOT IN (SELECT source, target, candidate FROM s1)),
    have AS (SELECT source, target, count(*) AS n FROM s1 GROUP BY ALL)
    SELECT source, target, candidate, 'idf' AS strategy FROM s1 UNION ALL SELECT source, target, candidate, 'random' FROM rest LEFT JOIN have USING (source, target) WHERE k <= 8 - coalesce(n, 0)""")
def mixed_candidates_det(t: Tables) -> DataFrame:
    gold = materialize(_gold(t).select("source", "target"), "gold")
    known = gold.select("source", F.col("target").alias("candidate"))
    idf = gold.join(_idf(t, 200).select("source", F.col("target").alias("candidate"), "place"), "source").join(known, ["source", "candidate"], "left_anti")
    # The stand-in for random candidates: the smallest items; no reference needs more than its golds and 8 others.
    many = known.groupBy("source").agg(F.count("*").alias("n"))
    items = materialize(co.numbered(t.benchmark.select(F.col("item_id").alias("candidate")), ["candidate"]), "items")
    need = gold.join(many, "source").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") + 16)))
    ring = need.join(items, "k").select("source", "target", "candidate", F.col("candidate").alias("place")).join(known, ["source", "candidate"], "left_anti")
    return co.mixed_candidates(gold, [("idf", idf, 5)], ring, 8).select("source", "target", "candidate", "strategy")


@query("""WITH k AS (SELECT toxic AS label, doc_id, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS k FROM labels) SELECT label, doc_id FROM k WHERE k <= 16""")
def few_shot_det(t: Tables) -> DataFrame:
    order = Window.partitionBy("label").orderBy("doc_id")
    rows = t.labels.select(F.col("toxic").alias("label"), "doc_id")
    return rows.withColumn("k", F.row_number().over(order)).where("k <= 16").select("label", "doc_id")


@query()
def few_shot(t: Tables) -> DataFrame:
    return co.few_shot(t.labels.select(F.col("toxic").alias("label"), "doc_id"), ["doc_id"], 16, 3)


@query()
def balanced_samples(t: Tables) -> DataFrame:
    return co.balanced(t.labels.select("doc_id", F.col("toxic").alias("label")), ["doc_id"])


@query("SELECT event_type, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY event_type")
def weight_shares(t: Tables) -> DataFrame:
    counts = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return co.normalised_weights(counts, "n").select("event_type", "share")


@query()
def weighted_sample(t: Tables) -> DataFrame:
    return co.weighted_sample(t.customer.select("c_custkey", F.abs("c_acctbal").alias("w")), ["c_custkey"], "w", 100, 5)


# --- reasoning --------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {GEO}, {CLOS}, own AS (SELECT 'customer:' || c_custkey AS individual, 'nation:' || c_nationkey AS cls FROM customer) SELECT individual, cls FROM own UNION SELECT individual, a FROM own JOIN clos ON d = cls""")
def instances_of(t: Tables) -> DataFrame:
    return re_.instances(ad.customer_types(t), gr.closure(ad.geo_edges(t)))


@query(f"""WITH RECURSIVE {PART}, {CLOS}, pairs AS (SELECT DISTINCT 'type:' || p_type AS a, 'brand:' || p_brand AS b FROM part UNION SELECT DISTINCT 'type:' || x.p_type, 'type:' || y.p_type FROM part x, (SELECT DISTINCT p_type FROM part) y WHERE x.p_type < y.p_type)
    SELECT a, b FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM clos x JOIN clos y ON x.d = y.d WHERE x.a = p.a AND y.a = p.b) AND NOT EXISTS (SELECT 1 FROM clos WHERE (clos.a = p.a AND clos.d = p.b) OR (clos.a = p.b AND clos.d = p.a))""")
def assumed_disjoint_alt(t: Tables) -> DataFrame:
    kinds = t.part.select(ad.tagged("type", "p_type").alias("x"), ad.tagged("brand", "p_brand").alias("y")).distinct()
    types = kinds.select("x", F.lit("root").alias("parent")).distinct()
    siblings = types.select("parent", F.col("x").alias("a")).join(types.select("parent", F.col("x").alias("b")), "parent").where("a < b").select("a", "b")
    return re_.assumed_disjoint(kinds.toDF("a", "b").union(siblings), gr.closure(ad.part_edges(t)))


@query("""WITH typed AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) SELECT DISTINCT x.p AS a, y.p AS b FROM typed x JOIN typed y USING (o) WHERE y.p BETWEEN x.p + 1 AND x.p + 7""")
def common_instances(t: Tables) -> DataFrame:
    pairs = t.part.select(F.col("p_partkey").alias("a"), F.explode(F.sequence(F.col("p_partkey") + 1, F.col("p_partkey") + 7)).alias("b"))
    return re_.common_instances(pairs, t.lineitem.select(F.col("l_orderkey").alias("individual"), F.col("l_partkey").alias("cls")).distinct())


@query("""WITH own AS (SELECT DISTINCT o_custkey AS c, 'order:' || o_orderkey AS o FROM orders) SELECT 'customer:' || c_custkey AS individual, 'nation:' || n_nationkey AS cls, c_nationkey = n_nationkey AS holds FROM customer JOIN nation ON n_nationkey IN (c_nationkey, (c_custkey % 25))""")
def check_instance(t: Tables) -> DataFrame:
    own, other = ad.tagged("nation", "c_nationkey"), F.concat(F.lit("nation:"), (F.col("c_custkey") % 25).cast("string"))
    pairs = t.customer.select(ad.tagged("customer", "c_custkey").alias("individual"), F.explode(F.array_distinct(F.array(own, other))).alias("cls"))
    return re_.check_instances(pairs, re_.instances(ad.customer_types(t), gr.closure(ad.geo_edges(t))))


@query("""SELECT 'customer:' || c_custkey AS individual, 'nation:' || c_nationkey AS cls FROM customer""")
def direct_instances(t: Tables) -> DataFrame:
    closed = gr.closure(ad.geo_edges(t))
    return re_.direct_instances(re_.instances(ad.customer_types(t), closed), closed)


@query("""WITH l AS (SELECT p_partkey AS iri, p_name AS literal FROM part UNION SELECT p_partkey, p_type FROM part)
    SELECT a.iri AS source, b.iri AS target, round(avg(1 - levenshtein(a.literal, b.literal) / greatest(length(a.literal), length(b.literal))), 6) AS score FROM l a JOIN l b ON b.iri = a.iri + 1 GROUP BY ALL""")
def mean_edit_score(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_partkey").alias("iri"), F.explode(F.array_distinct(F.array("p_name", "p_type"))).alias("literal"))
    pairs = t.part.select((F.col("p_partkey") - 1).alias("source"), F.col("p_partkey").alias("target")).where("source >= 0")
    return ma.mean_scores(pairs, names, names)


@query()
def random_candidates(t: Tables) -> DataFrame:
    gold = materialize(_gold(t).select("source", "target"), "gold")
    return co.random_candidates(gold, t.benchmark.select(F.col("item_id").alias("iri")), 8, 3)


@query("""SELECT 'order:' || o_orderkey AS subject, 'placedBy' AS predicate, 'customer:' || o_custkey AS object, 'order:' || o_orderkey || ' is placed by ' || coalesce(c_name, 'customer:' || o_custkey) AS text FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def verbalise_facts(t: Tables) -> DataFrame:
    facts = t.orders.select(ad.tagged("order", "o_orderkey").alias("subject"), F.lit("placedBy").alias("predicate"), ad.tagged("customer", "o_custkey").alias("object"))
    names = t.customer.select(ad.tagged("customer", "c_custkey").alias("iri"), F.col("c_name").alias("name")).union(t.spark.createDataFrame([("placedBy", "placed by")], "iri string, name string"))
    return vb.verbalise_property_assertions(facts, names)


@query(f"""WITH RECURSIVE {GEO}, {CLOS} SELECT 'customer:' || c_custkey AS a, 'region:' || r_regionkey AS b, EXISTS (SELECT 1 FROM clos WHERE clos.d = 'customer:' || c_custkey AND clos.a = 'region:' || r_regionkey) AS holds FROM customer JOIN region ON r_regionkey = c_nationkey % 5""")
def check_subsumption(t: Tables) -> DataFrame:
    pairs = t.customer.select(ad.tagged("customer", "c_custkey").alias("a"), F.concat(F.lit("region:"), (F.col("c_nationkey") % 5).cast("string")).alias("b"))
    return re_.subsumed(pairs, gr.closure(ad.geo_edges(t)))


def _part_ontology(t: Tables) -> Ontology:
    """Parts as classes: part below its type and below ``some hasBrand.brand``."""
    edges = t.part.select(ad.tagged("part", "p_partkey").alias("child"), ad.tagged("type", "p_type").alias("parent"), ad.tagged("brand", "p_brand").alias("brand"))
    some = lambda: F.concat(F.lit("some hasBrand "), "brand")
    axioms = edges.select(F.concat(F.lit("s:"), "child").alias("axiom_id"), F.lit("SubClassOf").alias("axiom_type"), F.lit("Classes").alias("entity_type"), F.col("child").alias("sub_expr"), F.col("parent").alias("sup_expr"), F.lit(None).cast("array<string>").alias("operands"))
    axioms = axioms.union(edges.select(F.concat(F.lit("r:"), "child"), F.lit("SubClassOf"), F.lit("Classes"), "child", some(), F.lit(None).cast("array<string>")))
    names = edges.select(F.explode(F.array("child", "parent", "brand")).alias("iri")).distinct()
    exprs = names.select(F.col("iri").alias("expr_id"), F.lit("class").alias("kind"), "iri", F.lit(None).cast("string").alias("prop"), F.lit(None).cast("array<string>").alias("operands"))
    exprs = exprs.union(edges.select(some(), F.lit("some"), F.lit(None).cast("string"), F.lit("hasBrand"), F.array("brand")).distinct())
    entities = names.select("iri", F.lit("Classes").alias("entity_type"))
    none = t.spark.createDataFrame([], "iri string, property_iri string, literal string, lang string")
    facts = t.spark.createDataFrame([], "subject string, predicate string, object string")
    return Ontology(entities, axioms, exprs, none, facts)


@query("""SELECT 'sub' AS form, 'part:' || p_partkey AS a, 'type:' || p_type AS c, NULL::VARCHAR AS r FROM part UNION SELECT 'sub', 'part:' || p_partkey, 'some hasBrand brand:' || p_brand, NULL FROM part
    UNION SELECT 'some_right', 'some hasBrand brand:' || p_brand, 'brand:' || p_brand, 'hasBrand' FROM part UNION SELECT 'some_left', 'brand:' || p_brand, 'some hasBrand brand:' || p_brand, 'hasBrand' FROM part""")
def el_normal_forms(t: Tables) -> DataFrame:
    return re_.normalise(_part_ontology(t)).select("form", "a", "c", "r")


@query("""WITH n AS (SELECT 'part:' || p_partkey AS x FROM part UNION SELECT 'type:' || p_type FROM part UNION SELECT 'brand:' || p_brand FROM part UNION SELECT 'some hasBrand brand:' || p_brand FROM part)
    SELECT x, x AS a FROM n UNION SELECT x, 'http://www.w3.org/2002/07/owl#Thing' FROM n UNION SELECT 'part:' || p_partkey, 'type:' || p_type FROM part UNION SELECT 'part:' || p_partkey, 'some hasBrand brand:' || p_brand FROM part""")
def el_saturation(t: Tables) -> DataFrame:
    return re_.saturate(re_.normalise(_part_ontology(t)))[0]


@query("SELECT DISTINCT 'some hasBrand brand:' || p_brand AS expr_id FROM part")
def complex_classes(t: Tables) -> DataFrame:
    return _part_ontology(t).complex_classes()


# --- triples ----------------------------------------------------------------------------------------------

_SUB = "'http://www.w3.org/2000/01/rdf-schema#subClassOf'"


@query(f"WITH {GEO} SELECT child AS source, {_SUB} AS relation, parent AS target FROM edges")
def project_taxonomy(t: Tables) -> DataFrame:
    return pj.project([pj.taxonomy_triples(ad.geo_edges(t))])


@query(f"WITH {GEO} SELECT child AS source, {_SUB} AS relation, parent AS target FROM edges UNION SELECT parent, 'http://superclassof', child FROM edges")
def project_bidirectional(t: Tables) -> DataFrame:
    return pj.project([pj.taxonomy_triples(ad.geo_edges(t), True)])


@query(f"SELECT 'part:' || p_partkey AS source, {_SUB} AS relation, 'type:' || p_type AS target FROM part UNION SELECT 'part:' || p_partkey, 'hasBrand', 'brand:' || p_brand FROM part UNION SELECT 'part:' || p_partkey, 'hasMaker', 'brand:' || p_brand FROM part UNION SELECT 'brand:' || p_brand, 'brandOf', 'part:' || p_partkey FROM part")
def project_relations(t: Tables) -> DataFrame:
    roles = t.spark.createDataFrame([("hasBrand", "hasMaker")], "sub string, super string")
    inverse = t.spark.createDataFrame([("hasBrand", "brandOf")], "role string, inverse string")
    return pj.project([pj.class_triples(_part_ontology(t), sub_roles=roles, inverses=inverse)])


@query(f"SELECT 'part:' || p_partkey AS source, '{pj.SUB}' AS relation, 'type:' || p_type AS target FROM part UNION SELECT 'part:' || p_partkey, 'hasBrand', 'brand:' || p_brand FROM part")
def project_chains(t: Tables) -> DataFrame:
    return pj.chain_triples(_part_ontology(t))


@query("""WITH t AS (SELECT 'Not_part:' || p_partkey AS source, 'negate' AS relation, 'part:' || p_partkey AS target FROM part UNION SELECT 'part:' || p_partkey, 'injects', 'http://www.w3.org/2002/07/owl#Thing' FROM part
    UNION SELECT 'type:' || p_type, 'injects', 'http://www.w3.org/2002/07/owl#Thing' FROM part UNION SELECT 'brand:' || p_brand, 'injects_inv_hasBrand', 'http://www.w3.org/2002/07/owl#Thing' FROM part)
    SELECT * FROM t UNION SELECT source, 'id', source FROM t UNION SELECT target, 'id', target FROM t""")
def project_category(t: Tables) -> DataFrame:
    return pj.category_triples(_part_ontology(t))


@query("SELECT DISTINCT d.event_type AS source, 'p' || d.user_id AS relation, r.event_type AS target FROM events d JOIN events r USING (user_id)")
def domain_range(t: Tables) -> DataFrame:
    uses = t.events.select(F.concat(F.lit("p"), "user_id").alias("property"), "event_type").distinct()
    return pj.domain_range_triples(uses.withColumnRenamed("event_type", "domain"), uses.withColumnRenamed("event_type", "range"))


@query("""SELECT DISTINCT 'page:' || page_id AS source, 'title' AS relation, literal AS target FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '^<(.*)>$', '\\1'), '^"(.*)"$', '\\1') AS literal FROM pages) WHERE literal <> ''""")
def project_annotations(t: Tables) -> DataFrame:
    notes = t.pages.select(ad.tagged("page", "page_id").alias("iri"), F.lit("title").alias("property_iri"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("literal"))
    return pj.annotation_triples(notes, ["title"])


@query("""SELECT 'customer:' || c_custkey AS source, 'http://type' AS relation, 'nation:' || c_nationkey AS target FROM customer UNION SELECT 'order:' || l_orderkey, 'contains', 'part:' || l_partkey FROM lineitem UNION SELECT 'part:' || l_partkey, 'suppliedBy', 'supplier:' || l_suppkey FROM lineitem""")
def project_assertions(t: Tables) -> DataFrame:
    return pj.assertion_triples(ad.customer_types(t), ad.order_facts(t))


# --- verbalisation and text -----------------------------------------------------------------------------


@query("SELECT 'part:' || p_partkey AS subject, p_name AS left_text, 'something that is supplied by some ' || lower(p_brand) AS right_text FROM part")
def verbalise_restrictions(t: Tables) -> DataFrame:
    right = vb.restriction_text(F.lit("supplied by"), F.lit("some"), F.lower("p_brand"))
    return t.part.select(ad.tagged("part", "p_partkey").alias("subject"), F.col("p_name").alias("left_text"), right.alias("right_text"))


@query("SELECT axiom_id, 'SubClassOf' AS axiom_type, \"left\", \"right\" FROM (SELECT 's:part:' || p_partkey AS axiom_id, p_name AS \"left\", 'type:' || p_type AS \"right\" FROM part UNION ALL SELECT 'r:part:' || p_partkey, p_name, 'something that has brand some brand:' || p_brand FROM part)")
def verbalise_axioms(t: Tables) -> DataFrame:
    onto = _part_ontology(t)
    labels = t.part.select(ad.tagged("part", "p_partkey").alias("iri"), F.col("p_name").alias("literal"))
    named = vb.vocabulary(onto.entities, labels).union(t.spark.createDataFrame([("hasBrand", "has brand")], "iri string, name string"))
    return vb.verbalise_axioms(onto.axioms, vb.verbalise(onto.exprs, named))


@query()
def parse_axioms(t: Tables) -> DataFrame:
    text = F.concat(F.lit("SubClassOf(<"), ad.tagged("part", "p_partkey"), F.lit("> ObjectSomeValuesFrom(<hasBrand> <"), ad.tagged("brand", "p_brand"), F.lit(">))"))
    return vb.parse_expressions(t.part.select("p_partkey", text.alias("axiom")), "p_partkey", "axiom")


@query("""SELECT p_partkey, 'It is ' || CASE WHEN starts_with(p_name, 'something') THEN '' WHEN regexp_matches(p_name, '^[aeiou]') THEN 'an ' ELSE 'a ' END || p_name AS sentence, lower(substr(p_type, 1, 1)) || substr(p_type, 2) AS clause FROM part""")
def article_templates(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.is_a(F.col("p_name")).alias("sentence"), tx.as_clause(F.concat("p_type", F.lit(".)"))).alias("clause"))


@query("SELECT p_partkey, upper(p_type[1]) || lower(p_type[2:]) || ' ' || upper(p_name[1]) || substr(string_split(p_name, ' ')[1], 2) || ' ' || upper(string_split(p_name, ' ')[2][1]) || substr(string_split(p_name, ' ')[2], 2) AS words FROM part")
def split_identifier(t: Tables) -> DataFrame:
    camel = F.concat(F.initcap("p_type"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")))
    return t.part.select("p_partkey", tx.split_identifier(camel).alias("words"))


@query("""WITH n AS (SELECT len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS n FROM documents) SELECT round(avg(n), 6) AS mean, round(avg(CASE WHEN n <= 128 THEN 1.0::DOUBLE ELSE 0 END), 6) AS upto_128, round(avg(CASE WHEN n <= 256 THEN 1.0::DOUBLE ELSE 0 END), 6) AS upto_256, round(avg(CASE WHEN n <= 512 THEN 1.0::DOUBLE ELSE 0 END), 6) AS upto_512, CAST(max(n) AS INTEGER) AS longest FROM n""")
def token_length_hist(t: Tables) -> DataFrame:
    return sc.length_histogram(t.documents.select(F.size(tx.space_tokens(F.col("text"))).alias("n")), "n")


@query("""WITH n AS (SELECT label, vec_id, embedding, lead(embedding) OVER w AS e, lead(vec_id) OVER w AS other FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))
    SELECT vec_id, other, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM n WHERE other IS NOT NULL""")
def cosine_scores(t: Tables) -> DataFrame:
    order = Window.partitionBy("label").orderBy("vec_id")
    pairs = t.embeddings.withColumn("e", F.lead("embedding").over(order)).withColumn("other", F.lead("vec_id").over(order)).where("other is not null")
    return sc.cosine(pairs, "embedding", "e").select("vec_id", "other", "score")


@query()
def trained_scorer(t: Tables) -> DataFrame:
    samples = corpora_union(t)
    return sc.accuracy(sc.train_pair_classifier(samples)(samples))
