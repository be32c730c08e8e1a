"""Proof queries of the scalar functions: each over a whole table, on texts made from its columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.functions import text as T
from factloom.plans.proofs import _proof
from factloom.sources.tables import table

_CAMEL = "regexp_replace({}, '([a-z0-9])([A-Z])|([A-Z]+)([A-Z][a-z])', '\\1\\3 \\2\\4', 'g')"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_NAME = "p_type || 'APIController' || p_partkey || 'Id_' || p_name"


@_proof(f"""SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex({_CAMEL.format('(' + _NAME + ')')}, '[^a-zA-Z0-9]+'), lambda x: x <> ''), lambda x: lower(x)), ' ') AS words,
array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(regexp_replace({_NAME}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 3 AND x NOT IN ({_STOP})))), ' ') AS search FROM part""")
def name_tokens(spark, d):
    name = F.expr(_NAME)
    return table(spark, d, "part").select("p_partkey", F.array_join(C.tokens(name), " ").alias("words"), F.array_join(F.array_sort(T.search_tokens(name)), " ").alias("search"))


_SUFFIX = "CASE " + " ".join(f"WHEN length(n) > {len(s)} AND ends_with(n, '{s}') THEN left(n, length(n) - {len(s)})" for s in T.DTO_SUFFIXES) + " ELSE n END"


@_proof(f"""WITH n AS (SELECT p_partkey, p_name, replace(p_name, ' ', '-') || CASE p_partkey % 4 WHEN 0 THEN 'BaseOut' WHEN 1 THEN 'Create' WHEN 2 THEN 'ies' ELSE 'sses' END AS n FROM part)
SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(n, '[^a-zA-Z0-9]+'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), '') AS pascal,
lower(regexp_replace(regexp_replace(n, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[-\\s]+', '_', 'g')) AS snake, {_SUFFIX} AS base,
CASE WHEN regexp_matches(s, 'ies$') THEN left(s, length(s) - 3) || 'y' WHEN regexp_matches(s, '(ches|shes|xes|zes|sses)$') THEN left(s, length(s) - 2) WHEN regexp_matches(s, 's$') AND NOT regexp_matches(s, 'ss$') THEN left(s, length(s) - 1) END AS singular
FROM (SELECT *, replace(n, '-', '_') AS s FROM n)""")
def name_forms(spark, d):
    n = F.expr("replace(p_name, ' ', '-') || CASE p_partkey % 4 WHEN 0 THEN 'BaseOut' WHEN 1 THEN 'Create' WHEN 2 THEN 'ies' ELSE 'sses' END")
    return table(spark, d, "part").select("p_partkey", T.pascal_case(n).alias("pascal"), T.snake_case(n).alias("snake"), T.dto_base(n).alias("base"), T.singular(F.replace(n, F.lit("-"), F.lit("_"))).alias("singular"))


@_proof("""SELECT page_id, replace(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|', '\\|'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), '<br>') AS markdown,
regexp_replace(url, '[.*+?^$()|\\[\\]{}\\\\]', '\\\\\\0', 'g') AS pattern FROM pages""")
def escaped_texts(spark, d):
    return table(spark, d, "pages").select("page_id", T.markdown_escaped(F.col("html")).alias("markdown"), T.regex_escaped(F.col("url")).alias("pattern"))


_ROUTE = "regexp_replace(url, '^https?:/', '') || CASE page_id % 3 WHEN 0 THEN '//{orgId}/' WHEN 1 THEN '/:user_id([0-9]+)' ELSE '' END"


@_proof(f"""WITH r AS (SELECT page_id, url, {_ROUTE} AS route FROM pages), n AS (SELECT *, regexp_replace(route, '/+', '/', 'g') AS one FROM r)
SELECT page_id, CASE WHEN length(one) > 1 THEN regexp_replace(one, '/$', '') ELSE one END AS normal,
regexp_replace(CASE WHEN length(one) > 1 THEN regexp_replace(one, '/$', '') ELSE one END, '\\{{[^/{{}}]+\\}}|:[A-Za-z_][A-Za-z0-9_]*(\\([^/]*\\))?', ':param', 'g') AS shape,
CASE page_id % 3 WHEN 0 THEN 'orgId' WHEN 1 THEN 'user_id' ELSE '' END AS ids,
CASE WHEN regexp_replace(url, '^/', '') = '' THEN '/api' ELSE '/api/' || regexp_replace(url, '^/', '') END AS joined FROM n""")
def routes(spark, d):
    route = F.expr(_ROUTE)
    return table(spark, d, "pages").select("page_id", T.normal_route(route).alias("normal"), T.route_shape(route).alias("shape"),
                                           F.array_join(T.id_params(C.path_params(F.regexp_replace(route, r"\([^/]*\)", ""))), ",").alias("ids"), T.joined_route(F.lit("/api/"), F.col("url")).alias("joined"))


_REPO = "CASE p_partkey % 5 WHEN 0 THEN '/' WHEN 1 THEN './' WHEN 2 THEN 'a/../' WHEN 3 THEN 'c:' ELSE '' END || replace(p_name, ' ', '//') || '/' || p_size"


@_proof(f"""WITH p AS (SELECT p_partkey, {_REPO} AS path FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 IN (1, 4) THEN regexp_replace(regexp_replace(path, '/+', '/', 'g'), '^\\./', '') END AS path FROM p""")
def repo_paths(spark, d):
    return table(spark, d, "part").select("p_partkey", T.repo_path(F.expr(_REPO)).alias("path"))


@_proof("""WITH p AS (SELECT p_brand, [p_type, p_name, CAST(p_size AS VARCHAR)] AS s FROM part), f AS (SELECT p_brand, any_value(s) AS f FROM (SELECT p_brand, first(s) OVER (PARTITION BY p_brand ORDER BY s) AS s FROM p) GROUP BY 1)
SELECT p.p_brand, '/' || array_to_string(any_value(f)[1:min(CASE WHEN s[1] <> f[1] THEN 0 WHEN s[2] <> f[2] THEN 1 WHEN s[3] <> f[3] THEN 2 ELSE 3 END)], '/') AS prefix FROM p JOIN f USING (p_brand) GROUP BY 1""")
def segment_prefix(spark, d):
    routes_ = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set(F.expr("'/' || p_type || '/' || p_name || '/' || p_size")).alias("routes"))
    return routes_.select("p_brand", T.common_prefix(F.col("routes")).alias("prefix"))


@_proof("""SELECT conv_id, turn, length(text) // 2 + 1 - length(replace(left(text, length(text) // 2), chr(10), '')) - (length(text) // 2 - length(left(text, length(text) // 2))) AS line FROM conversations""")
def line_numbers(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.line_at(F.col("text"), (F.length("text") / 2).cast("int")).cast("long").alias("line"))


@_proof("""SELECT o_orderkey, 'operation-changed:' || o_orderpriority || ':' || left(sha256(o_orderstatus), 12) AS change,
'sha256:' || sha256('{"a":"' || o_orderpriority || '","b":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}') AS token FROM orders""")
def digests(spark, d):
    inputs = F.create_map(F.lit("b"), F.expr("IF(o_orderkey % 3 = 0, NULL, o_orderstatus)"), F.lit("a"), F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", T.change_key(F.lit("operation-changed"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("change"), T.gate_token(inputs).alias("token"))


_NS = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


@_proof(f"""WITH h AS (SELECT s_suppkey, s_name, sha1(unhex('{_NS.replace('-', '')}') || encode(s_name)) AS h, replace(replace(rtrim(base64(encode(s_name || chr(233) || s_suppkey)), '='), '+', '-'), '/', '_') AS e FROM supplier)
SELECT s_suppkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', CAST(('0x' || h[17]) AS INTEGER) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS uid, e AS handle, s_name || chr(233) || s_suppkey AS decoded FROM h""")
def handles(spark, d):
    name = F.expr("s_name || chr(233) || s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", T.uuid5(_NS, F.col("s_name")).alias("uid"), T.handle_encoded(name).alias("handle"), T.handle_decoded(T.handle_encoded(name)).alias("decoded"))


_WHEN = "CASE event_id % 4 WHEN 0 THEN '2024-02-30T00:00:00Z' WHEN 1 THEN '2024-01-0' || (event_id % 9 + 1) || 'T10:20:30Z' WHEN 2 THEN '2024-01-01 00:00:00' END"


@_proof(f"""SELECT event_id, CASE WHEN event_id % 4 = 1 THEN CAST(replace(replace({_WHEN}, 'T', ' '), 'Z', '') AS TIMESTAMP) END AS at, CAST(floor(value - 50.5 + 0.5) AS BIGINT) AS rounded,
CASE WHEN event_id % 7 <> 0 THEN (value - event_id % 7) * 100 / (event_id % 7) END AS pct FROM events""")
def dates_and_numbers(spark, d):
    return table(spark, d, "events").select("event_id", T.strict_instant(F.expr(_WHEN)).cast("timestamp_ntz").alias("at"), T.js_round(F.col("value") - 50.5).alias("rounded"), T.pct_delta(F.col("value"), F.col("event_id") % 7).alias("pct"))


@_proof("""SELECT p_brand, max(p_size * 1000000 + p_partkey % 12 * 1000 + p_partkey % 100) FILTER (p_partkey % 5 <> 0) AS latest FROM part GROUP BY 1""")
def newest_version(spark, d):
    version = F.expr("p_size || '.' || p_partkey % 12 || '.' || p_partkey % 100 || IF(p_partkey % 5 = 0, '-rc', '')")
    best = table(spark, d, "part").groupBy("p_brand").agg(F.max(T.semver_key(version)).alias("v"))
    return best.selectExpr("p_brand", "v.major * 1000000 + v.minor * 1000 + v.patch AS latest")


_TYPES = "CASE c_custkey % 6 WHEN 0 THEN ' UUID ' WHEN 1 THEN 'java.util.UUID' WHEN 2 THEN 'Non-UUID' WHEN 3 THEN '' WHEN 4 THEN c_mktsegment END"


@_proof(f"""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'uuid' WHEN 1 THEN 'uuid' WHEN 2 THEN 'non-uuid' WHEN 4 THEN c_mktsegment ELSE 'unknown' END AS key_type, 'a.b' AS parent_table, 'x' || c_custkey AS parent_column, c_custkey % 2 = 0 AS valid FROM customer""")
def names_parsed(spark, d):
    fk = T.fk_parts(F.expr("'s.t.c -> a.b.x' || c_custkey"))
    return table(spark, d, "customer").select("c_custkey", T.key_type(F.expr(_TYPES)).alias("key_type"), fk["references_table"].alias("parent_table"), fk["references_column"].alias("parent_column"),
                                              T.valid_feature_id(F.expr("IF(c_custkey % 2 = 0, '001-a-b', '1-A')")).alias("valid"))


_FILES = "CASE p_partkey % 9 WHEN 0 THEN 'README.md' WHEN 1 THEN 'docs/' WHEN 2 THEN 'specs/' || p_brand || '/' WHEN 3 THEN 'src/tests/' WHEN 4 THEN '.git/' WHEN 5 THEN 'pom/AGENTS.md' WHEN 6 THEN 'x/package.json' WHEN 7 THEN 'secrets.' ELSE 'src/' END || CASE WHEN p_partkey % 9 IN (0, 5, 6) THEN '' ELSE replace(p_name, ' ', '_') || CASE p_partkey % 2 WHEN 0 THEN '.py' ELSE '.TXT' END END"


@_proof(f"""WITH f AS (SELECT p_partkey, p_brand, p_partkey % 9 AS k, {_FILES} AS path FROM part)
SELECT p_partkey, p_partkey % 2 = 0 AND k IN (2, 8) AS candidate, k IN (0, 1) AS documentation, CASE WHEN k = 2 THEN p_brand END AS feature,
CASE WHEN k = 5 THEN 'instructions' WHEN k = 3 THEN 'test' WHEN k = 6 THEN 'manifest' WHEN k IN (0, 1) OR (k IN (2, 4, 7, 8) AND p_partkey % 2 = 1) THEN 'documentation' ELSE 'source' END AS role FROM f""")
def path_predicates(spark, d):
    p = F.expr(_FILES)
    return table(spark, d, "part").select("p_partkey", T.candidate_source(p).alias("candidate"), T.documentation_path(p).alias("documentation"), T.feature_of_path(p).alias("feature"), T.source_role(p, ["package.json", "README.md"]).alias("role"))


_IP = "(c_custkey * 37 % 260) || '.' || (c_custkey * 11 % 256) || '.' || (c_custkey % 256) || '.1'"


@_proof(f"""WITH o AS (SELECT c_custkey, c_custkey * 37 % 260 AS a, c_custkey * 11 % 256 AS b, c_custkey % 256 AS c FROM customer)
SELECT c_custkey, CASE WHEN a > 255 THEN 'invalid' WHEN a = 0 THEN 'unspecified' WHEN a = 10 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) THEN 'private'
WHEN a = 127 THEN 'loopback' WHEN a = 169 AND b = 254 THEN 'link-local' WHEN (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 192 AND b = 88 AND c = 99) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) THEN 'reserved'
WHEN a BETWEEN 224 AND 239 THEN 'multicast' WHEN a >= 240 THEN 'reserved' ELSE 'public' END AS class FROM o""")
def address_classes(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.address_class(F.expr(_IP)).alias("class"))


@_proof("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN '(source-declared: none)' ELSE list_aggregate(list_sort(list_distinct([o_orderpriority, o_orderstatus, 'F'])), 'string_agg', ', ') END AS security,
CASE WHEN o_orderstatus = 'F' THEN false WHEN o_orderkey % 2 = 0 THEN true ELSE o_orderstatus <> 'O' END AS blocking FROM orders""")
def contract_columns(spark, d):
    one = lambda c: F.create_map(c, F.lit(1))
    given = F.when(F.col("o_orderkey") % 3 == 1, F.array().cast("array<map<string,int>>")).when(F.col("o_orderkey") % 3 == 2, F.array(one(F.col("o_orderstatus")), one(F.col("o_orderpriority")), one(F.lit("F"))))
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'not_run' ELSE 'stale' END")
    return table(spark, d, "orders").select("o_orderkey", T.security_names(given).alias("security"), T.blocks(F.expr("IF(o_orderkey % 2 = 0, 'required', 'when-present')"), status).alias("blocking"))
