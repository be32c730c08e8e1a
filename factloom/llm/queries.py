"""The registered queries of the training-data operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (conversation_repair, html_extract, jaccard_join, language_id, mixing, oracles, packing, quality_rules, resampling, secret_scan, site_quality, suffix_dedup,
               topk_search, toxicity)
from .common import key_crc, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op2_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.profiles(docs.where(key_crc() % 4 != 2)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels").where(key_crc() % 5 != 0))
    return toxicity.score(docs, net)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))[0].select("doc_id", "n_shingles", "component_id")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk_search.search(vectors, vectors.where(F.col("id") % 50 == 0))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    share = [F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(mixing.DOMAINS)]
    return mixed.select("d.doc_id", "n_tokens", *share, "rate")


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audited(table(spark, sf_dir, "conversations"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_suffix_dedup, op2_site_quality, op3_language_id, op4_quality_rules, op5_packing, op6_toxicity,
           op7_jaccard_join, op8_secret_scan, op9_topk_search, op10_mixing, op11_html_extract, op12_conversation_repair, op13_resampling, pipeline)
    return {f.__name__: f for f in own}


def _secret_sql(scope: int = 300) -> str:
    """SQL of op8: matches and their places from split texts, links by a join of a row's spans."""
    quoted = {kind: pattern.replace("'", "''") for kind, _, _, pattern, _ in secret_scan.KINDS}
    matches = "\nUNION ALL ".join(
        f"SELECT k, '{kind}' AS kind, '{role}' AS role, {n} AS ord, regexp_extract_all(t, '{quoted[kind]}') AS f, regexp_split_to_array(t, '{quoted[kind]}') AS b FROM d"
        for kind, role, n, _, _ in secret_scan.KINDS)
    near = "EXISTS (FROM s p WHERE p.k = w.k AND p.role = '{}' AND abs(p.a - w.a) <= " + str(scope) + ")"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({matches}),
e AS (SELECT k, kind, role, ord, f[i] AS m, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS a
  FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM f)),
s AS MATERIALIZED (SELECT k, kind, role, ord, CAST(a AS BIGINT) AS a, CAST(a + length(m) AS BIGINT) AS z FROM e
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m, '^(?:{quoted["assign"]})$', 2)) >= 6 WHEN 'access' THEN length(m) >= 20
    WHEN 'string' THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') ELSE true END),
w AS (SELECT * FROM s w WHERE ord <= 2 OR ((ord = 5 OR NOT EXISTS (FROM s c WHERE c.k = w.k AND c.ord <= 2 AND c.a <= w.a AND w.a < c.z))
  AND CASE ord WHEN 3 THEN {near.format("id")} WHEN 4 THEN {near.format("secret")} ELSE {near.format("id")} AND {near.format("secret")} END)),
g AS (SELECT k, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
    string_agg(concat_ws(':', kind, a, z), ',' ORDER BY a, ord) FILTER (ord <= 2) AS base, string_agg(concat_ws(':', kind, a, z), ',' ORDER BY a, ord) AS spans FROM w GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (k)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_html_extract": oracles.PAGES,
        "op12_conversation_repair": oracles.CONVERSATIONS,
        "op13_resampling": oracles.RESAMPLING,
        "op8_secret_scan": _secret_sql(),
        "op7_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS t FROM d),
n AS (SELECT doc_id, len(t) AS n FROM s),
u AS (SELECT doc_id, unnest(t) AS t FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.root) AS component_id FROM n JOIN r USING (doc_id) GROUP BY 1, 2""",
        "op9_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5""",
    }
