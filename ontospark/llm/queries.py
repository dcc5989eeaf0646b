"""One query per operator, over whole tables with production parameters, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontospark.llm import bpe, decontaminate, embeddings, langid, licenses, sharding, simhash, toxicity, urlfilter, warc

#: The url rules of op2: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def digest_tokens(docs: DataFrame) -> DataFrame:
    """The documents' packed ids and their decoded text as counts and digests."""
    encoded = bpe.encode(docs, tokenizer_path(), decoded=True)
    return encoded.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_tokens(_read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = urlfilter.judge_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform(F.array_distinct("items"), lambda x: x.cast("string")))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_read(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = embeddings.link_embeddings(_read(spark, sf_dir, "embeddings"))
    return linked.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"), 8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_url_filter, op3_toxicity, op4_decontaminate, op5_warc, op6_embeddings, op7_language, op8_licenses, op9_simhash, op10_sharding)
}

_LOWER = f"'{urlfilter.UPPER}', '{urlfilter.LOWER}'"
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_TEMPLATES = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(licenses.TEMPLATES))
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
_BIGRAMS = f"list_filter(string_split_regex(translate(%s, {_LOWER}), '[^a-z0-9]+'), lambda w: w <> '')"

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": f"""
        WITH rules(rhost, rpath, verdict) AS (VALUES {_RULES}),
        cut AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        numbered AS (SELECT *, row_number() OVER () AS k FROM parts),
        fits AS (SELECT k, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY k ORDER BY length(rhost || rpath) DESC) AS place
                 FROM numbered JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM numbered LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (k)""",
    "op4_decontaminate": f"""
        WITH docs AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
        items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        sized AS (SELECT item_id, w, least(10, len(w)) AS s FROM items WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, s, array_to_string(w[i:i + s - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - s + 2)) AS i FROM sized)),
        seen AS (SELECT k, i, s, array_to_string(w[i:i + s - 1], ' ') AS win FROM (SELECT k, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM docs, (SELECT DISTINCT s FROM sized))),
        met AS (SELECT k, i, s, item_id FROM seen JOIN windows USING (s, win)),
        hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + s)) AS p FROM met) GROUP BY k),
        own AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM met WHERE item_id IS NOT NULL) GROUP BY k)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hit USING (k) LEFT JOIN own USING (k)""",
    "op5_warc": """
        WITH body AS (SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha1(coalesce(html, '')) AS digest FROM pages),
        best AS (SELECT digest, max(page_id) AS first_id FROM body WHERE bytes >= 1000 GROUP BY digest)
        SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, body.digest AS payload_digest,
               CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM body LEFT JOIN best ON body.digest = best.digest AND bytes >= 1000""",
    "op6_embeddings": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        fit AS (SELECT vec_id, label, list_transform(e, lambda x: x / m) AS e
                FROM (SELECT vec_id, label, e, list_max(list_transform(e, lambda x: abs(x))) AS m FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
                      AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0) WHERE m > 0),
        unit AS (SELECT vec_id, label, list_transform(e, lambda x: x / n) AS e FROM (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM fit)),
        link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM unit a JOIN unit b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
                 WHERE list_inner_product(a.e, b.e) >= 0.98),
        reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
        least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
        many AS (SELECT x, count(*) AS n FROM link GROUP BY x)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN least ON vec_id = least.x LEFT JOIN many ON vec_id = many.x""",
    "op8_licenses": f"""
        WITH listed(template, license, ttext) AS (VALUES {_TEMPLATES}),
        known AS (SELECT template, license, len(w) AS length, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS tb FROM (SELECT template, license, {_BIGRAMS % "ttext"} AS w FROM listed) WHERE len(w) > 1),
        docs AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
        cut AS (SELECT k, list_filter(list_transform(string_split(text, chr(10)), lambda l: {_BIGRAMS % "l"}), lambda l: len(l) > 0) AS lines FROM docs WHERE text IS NOT NULL),
        flat AS (SELECT k, lines, flatten(lines) AS w, list_transform(range(1, len(lines) + 1), lambda i: coalesce(list_sum(list_transform(lines[:i - 1], lambda l: len(l))), 0)::BIGINT) AS starts FROM cut),
        texts AS (SELECT k, lines, w, starts, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM flat WHERE len(w) > 1),
        pairs AS (SELECT t.*, template, license, length, tb, list_intersect(list_distinct(b), tb) AS common FROM texts t JOIN known ON len(list_intersect(list_distinct(b), tb)) >= len(tb) * {licenses.THRESHOLD / (2 - licenses.THRESHOLD)} - 1e-9),
        begun AS (SELECT *, unnest(range(1, len(lines) + 1)) AS l FROM pairs),
        runs AS (SELECT * EXCLUDE (l), l, starts[l] AS s, coalesce(starts[l + 1], len(w)) AS e, len(list_filter(starts, lambda x: x < least(starts[l] + length, len(w)))) AS upto FROM begun),
        near AS (SELECT * FROM runs WHERE list_has_any(b[s + 1:e - 1], common)),
        units AS (SELECT k, template, license, tb, b, s, e FROM near
                  UNION ALL SELECT k, template, license, tb, b, s, coalesce(starts[upto + 1], len(w)) FROM near
                  UNION ALL SELECT k, template, license, tb, b, s, starts[upto] FROM near WHERE upto > l
                  UNION ALL SELECT k, template, license, tb, b, 0, len(w) FROM pairs),
        dice AS (SELECT k, template, license, 2 * len(list_intersect(list_distinct(b[s + 1:e - 1]), tb)) / (len(list_distinct(b[s + 1:e - 1])) + len(tb)) AS d FROM units),
        best AS (SELECT k, template, license, max(d) AS d FROM dice GROUP BY k, template, license HAVING max(d) >= {licenses.THRESHOLD}),
        found AS (SELECT k, count(*) AS n, array_to_string(list_sort(list(DISTINCT license)), ',') AS names, max(d) AS top FROM best GROUP BY k)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(names, '') AS licenses, CAST(top AS DOUBLE) AS best_score FROM docs LEFT JOIN found USING (k)""",
}
