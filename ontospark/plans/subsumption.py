"""Queries of subsumption extraction, sampling, RDF input and whole-run evaluation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontospark.operators import evaluation as ev
from ontospark.operators import graph as gr
from ontospark.operators import projection as pj
from ontospark.operators import subsumption as su
from ontospark.operators.ontology import DEPRECATED, Ontology
from ontospark.plans.catalogue import CLOS, GEO, _part_ontology, query
from ontospark.sources import adapters as ad
from ontospark.sources import rdf
from ontospark.sources.adapters import Tables


def _with_deprecated(t: Tables) -> Ontology:
    """The ontology of parts, in which parts of size 1 are deprecated."""
    onto = _part_ontology(t)
    old = t.part.where("p_size = 1").select(ad.tagged("part", "p_partkey").alias("iri"), F.lit(DEPRECATED).alias("property_iri"), F.lit("true").alias("literal"), F.lit(None).cast("string").alias("lang"))
    return replace(onto, annotations=old)


@query("SELECT DISTINCT 'some hasBrand brand:' || p_brand AS expr_id, 'hasBrand' AS prop, 'brand:' || p_brand AS filler FROM part")
def basic_restrictions(t: Tables) -> DataFrame:
    return su.basic_restrictions(_part_ontology(t))


@query("SELECT 'part:' || p_partkey AS sub, 'type:' || p_type AS sup FROM part WHERE p_size <> 1")
def declared_named(t: Tables) -> DataFrame:
    return su.declared_pairs(_with_deprecated(t))


@query("SELECT 'part:' || p_partkey AS sub, 'some hasBrand brand:' || p_brand AS sup FROM part WHERE p_size <> 1")
def declared_restrictions(t: Tables) -> DataFrame:
    return su.declared_pairs(_with_deprecated(t), restrictions=True)


_TRAVERSE = f"""{GEO}, h1 AS (SELECT parent AS start, 1 AS hop, child AS sub, parent AS sup FROM edges WHERE starts_with(parent, 'region:')), more AS (SELECT start FROM h1 GROUP BY start HAVING count(*) < 12),
    h2 AS (SELECT start, 2 AS hop, e.child AS sub, e.parent AS sup FROM h1 JOIN more USING (start) JOIN edges e ON e.parent = h1.sub),
    placed AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hop, sub, sup) AS place FROM (FROM h1 UNION ALL FROM h2))"""


def _traversal(t: Tables) -> DataFrame:
    regions = t.region.select(ad.tagged("region", "r_regionkey").alias("id"))
    return su.traversal(regions, ad.geo_edges(t), hops=2, most=12)


@query(f"WITH {_TRAVERSE} SELECT start, CAST(place AS INTEGER) AS place, CAST(hop AS INTEGER) AS hop, sub, sup FROM placed WHERE place <= 12")
def traversal_pairs(t: Tables) -> DataFrame:
    return _traversal(t)


@query(f"WITH {_TRAVERSE} SELECT start, string_agg(sub || ' <SUB> ' || coalesce('region ' || r_name, sup), ' <SEP> ' ORDER BY place) AS context FROM placed LEFT JOIN region ON sup = 'region:' || r_regionkey WHERE place <= 12 GROUP BY start")
def traversal_strings(t: Tables) -> DataFrame:
    names = t.region.select(ad.tagged("region", "r_regionkey").alias("iri"), F.concat(F.lit("region "), "r_name").alias("name"))
    return su.traversal_strings(_traversal(t), names)


@query(f"""WITH {GEO}, pos AS (SELECT n.n_name AS text_a, r.r_name AS text_b FROM nation n JOIN region r ON r_regionkey = n_regionkey),
    neg AS (SELECT n.n_name AS text_a, r.r_name AS text_b FROM nation n JOIN region r ON r_regionkey <> n_regionkey), sizes AS (SELECT (SELECT count(*) FROM pos) * 4 AS p, (SELECT count(*) FROM neg) AS n)
    SELECT text_a, text_b, CAST(1 AS INTEGER) AS label, CAST(4 AS BIGINT) AS copies FROM pos UNION ALL SELECT text_a, text_b, 0, 1 FROM neg""")
def training_samples(t: Tables) -> DataFrame:
    nation = t.nation.select(ad.tagged("nation", "n_nationkey").alias("iri"), F.col("n_name").alias("literal"))
    region = t.region.select(ad.tagged("region", "r_regionkey").alias("iri"), F.col("r_name").alias("literal"))
    true = t.nation.select(ad.tagged("nation", "n_nationkey").alias("sub"), ad.tagged("region", "n_regionkey").alias("sup"))
    # As many wrong regions as there are others: of five, four.
    others = t.nation.withColumn("r", F.explode(F.array(*[F.lit(k) for k in range(5)]))).where("r <> n_regionkey")
    false = others.select(ad.tagged("nation", "n_nationkey").alias("sub"), ad.tagged("region", "r").alias("sup"))
    found = su.training_samples(su.label_samples(true, nation, region, 1), su.label_samples(false, nation, region, 0), pos_dup=2)
    return found.groupBy("text_a", "text_b", "label").agg(F.count("*").alias("copies"))


def _geo_ontology(t: Tables) -> Ontology:
    """Nations that equal ``some inRegion.region``; customers and suppliers below them."""
    edges = ad.geo_edges(t)
    pairs = t.nation.select(ad.tagged("nation", "n_nationkey").alias("iri"), F.concat(F.lit("some inRegion "), ad.tagged("region", "n_regionkey"), F.lit(" of "), F.col("n_nationkey").cast("string")).alias("e"), ad.tagged("region", "n_regionkey").alias("region"))
    none, no_list = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    axioms = pairs.select(F.concat(F.lit("e:"), "iri").alias("axiom_id"), F.lit("EquivalentClasses").alias("axiom_type"), F.lit("Classes").alias("entity_type"), none.alias("sub_expr"), none.alias("sup_expr"), F.array("iri", "e").alias("operands"))
    axioms = axioms.union(edges.select(F.concat(F.lit("s:"), "child"), F.lit("SubClassOf"), F.lit("Classes"), "child", "parent", no_list))
    names = gr.nodes(edges).select(F.col("id").alias("iri"))
    exprs = names.select(F.col("iri").alias("expr_id"), F.lit("class").alias("kind"), "iri", none.alias("prop"), no_list.alias("operands"))
    exprs = exprs.union(pairs.select("e", F.lit("some"), none, F.lit("inRegion"), F.array("region")))
    entities = names.select("iri", F.lit("Classes").alias("entity_type")).union(t.spark.createDataFrame([("inRegion", "ObjectProperties"), ("nearRegion", "ObjectProperties")], "iri string, entity_type string"))
    empty = t.spark.createDataFrame([], "iri string, property_iri string, literal string, lang string")
    return Ontology(entities, axioms, exprs, empty, t.spark.createDataFrame([], "subject string, predicate string, object string"))


@query(f"""WITH RECURSIVE {GEO}, {CLOS}, a AS (SELECT 'e:nation:' || n_nationkey AS axiom_id, 'nation:' || n_nationkey AS iri, 'some inRegion region:' || n_regionkey || ' of ' || n_nationkey AS e FROM nation)
    SELECT axiom_id, iri AS sub, e AS sup FROM a UNION SELECT axiom_id, e, iri FROM a UNION SELECT axiom_id, e, clos.a FROM a JOIN clos ON d = iri UNION SELECT axiom_id, d, e FROM a JOIN clos ON clos.a = iri""")
def complex_positives(t: Tables) -> DataFrame:
    return su.complex_positives(_geo_ontology(t), gr.closure(ad.geo_edges(t)), None)


@query()
def complex_negatives(t: Tables) -> DataFrame:
    return su.complex_negatives(_geo_ontology(t), 3, 5)


@query()
def atomic_negatives_soft(t: Tables) -> DataFrame:
    edges = ad.part_edges(t)
    return su.atomic_negatives(edges, gr.closure(edges), 200, seed=1)


@query()
def atomic_negatives_hard(t: Tables) -> DataFrame:
    edges = ad.part_edges(t)
    return su.atomic_negatives(edges, gr.closure(edges), 200, hard=True, seed=1)


@query()
def intra_corpus(t: Tables) -> DataFrame:
    """Customers by two spellings of their name, siblings by nation."""
    iri = ad.tagged("customer", "c_custkey")
    edges = t.customer.select(ad.tagged("nation", "c_nationkey").alias("parent"), iri.alias("child"))
    literals = t.customer.select(iri.alias("iri"), F.explode(F.array("c_name", F.lower(F.replace("c_name", F.lit("#"), F.lit(" "))))).alias("literal"))
    return su.intra_corpus(literals, edges, seed=2)


# --- projection, RDF ---------------------------------------------------------------------------------------


@query(f"SELECT 'part:' || p_partkey AS source, 'hasBrand' AS relation, 'brand:' || p_brand AS target FROM part UNION SELECT 'part:' || p_partkey, '{pj.SUB}', 'type:' || p_type FROM part UNION SELECT 'type:' || p_type, '{pj.SUPER}', 'part:' || p_partkey FROM part")
def project_chosen_relations(t: Tables) -> DataFrame:
    return pj.relation_triples(_part_ontology(t), ["hasBrand"], taxonomy=True, bidirectional=True)


@query("SELECT 'part:' || p_partkey AS source, 'http://www.w3.org/2000/01/rdf-schema#label' AS relation, p_name AS target FROM part WHERE p_name <> ''")
def project_lexical(t: Tables) -> DataFrame:
    iri = ad.tagged("part", "p_partkey").alias("iri")
    label = t.part.select(iri, F.lit("http://www.w3.org/2000/01/rdf-schema#label").alias("property_iri"), F.col("p_name").alias("literal"))
    return pj.annotation_triples(label.union(t.part.select(iri, F.lit("http://ex.org/size"), F.col("p_size").cast("string"))))


def _part_triples(t: Tables) -> DataFrame:
    """Parts in RDF: below their type, and equal to an intersection of a brand restriction and a bound on makers."""
    node, key = lambda s: F.concat(F.lit(f"_:{s}"), "p_partkey"), ad.tagged("part", "p_partkey")
    o, r, s = rdf.OWL, rdf.RDF, rdf.RDFS
    rows = [
        (key, f"{r}type", F.lit(f"{o}Class")), (key, f"{s}subClassOf", ad.tagged("type", "p_type")), (key, f"{o}equivalentClass", node("e")), (node("e"), f"{o}intersectionOf", node("l")),
        (node("l"), f"{r}first", node("b")), (node("l"), f"{r}rest", node("m")), (node("m"), f"{r}first", node("n")), (node("m"), f"{r}rest", F.lit(f"{r}nil")),
        (node("b"), f"{o}onProperty", F.lit("hasBrand")), (node("b"), f"{o}someValuesFrom", ad.tagged("brand", "p_brand")),
        (node("n"), f"{o}onProperty", F.lit("hasMaker")), (node("n"), f"{o}maxQualifiedCardinality", F.lit("2")), (node("n"), f"{o}onClass", ad.tagged("brand", "p_brand")),
    ]
    each = F.array(*[F.struct(a.alias("subject"), F.lit(p).alias("predicate"), b.alias("object")) for a, p, b in rows])
    return t.part.select(F.explode(each).alias("x")).select("x.*", F.lit(False).alias("literal"), F.lit(None).cast("string").alias("lang"))


@query("""SELECT 'SubClassOf(<part:' || p_partkey || '> <type:' || p_type || '>)' AS text FROM part UNION ALL SELECT 'EquivalentClasses(<part:' || p_partkey || '> ObjectIntersectionOf(ObjectSomeValuesFrom(<hasBrand> <brand:' || p_brand || '>) ObjectMaxCardinality(2 <hasMaker> <brand:' || p_brand || '>)))' FROM part""")
def rdf_axioms(t: Tables) -> DataFrame:
    return rdf.ontology_of(_part_triples(t)).axioms.select("text")


@query("""SELECT 'SubClassOf(<part:' || p_partkey || '> <type:' || p_type || '>)' AS text FROM part""")
def el_profile(t: Tables) -> DataFrame:
    return rdf.ontology_of(_part_triples(t)).el_axioms().select("text")


# --- evaluation --------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), s AS (SELECT unnest(generate_series(0, (SELECT max(n) FROM n))) AS size)
    SELECT CAST(size AS BIGINT) AS size, CAST(count(n.n) AS BIGINT) AS n FROM s LEFT JOIN n ON n.n = size GROUP BY size""")
def size_histogram(t: Tables) -> DataFrame:
    return ev.size_histogram(t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns")), "turns")


@query("""WITH c AS (SELECT l_orderkey AS source, l_partkey AS target, max(l_quantity) / 50 AS score, bool_or(l_returnflag = 'R') AS answer FROM lineitem GROUP BY ALL),
    ref AS (SELECT source, max(target) AS target FROM c WHERE source % 3 <> 0 GROUP BY source), pred AS (SELECT source, target FROM c WHERE answer AND score >= 0.2),
    k AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS k FROM c), rk AS (SELECT k FROM ref JOIN k USING (source, target)),
    un AS (SELECT source, bool_or(answer AND score >= 0.2) AS said FROM c WHERE source NOT IN (SELECT source FROM ref) GROUP BY source),
    n AS (SELECT (SELECT count(*) FROM pred)::DOUBLE AS p, (SELECT count(*) FROM ref)::DOUBLE AS r, (SELECT count(*) FROM pred JOIN ref USING (source, target))::DOUBLE AS h)
    SELECT round(h / p, 3) AS "P", round(h / r, 3) AS "R", round(2 * (h / p) * (h / r) / (h / p + h / r), 3) AS "F1", (SELECT round(avg(1.0::DOUBLE / k), 3) FROM rk) AS "MRR",
        (SELECT round(avg(CASE WHEN k <= 1 THEN 1.0::DOUBLE ELSE 0 END), 3) FROM rk) AS "Hits_1", (SELECT round(avg(CASE WHEN said THEN 0.0::DOUBLE ELSE 1 END), 3) FROM un) AS "RR" FROM n""")
def answered_metrics(t: Tables) -> DataFrame:
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target")).agg((F.max("l_quantity") / 50).alias("score"), F.bool_or(F.col("l_returnflag") == "R").alias("answer"))
    ref = c.where("source % 3 <> 0").groupBy("source").agg(F.max("target").alias("target"))
    return ev.answered_metrics(c, ref, 0.2)
