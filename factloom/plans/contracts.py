"""Proof queries of JSON functions, contract tables and readiness over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import json as J
from factloom.operators import contracts, decisions, readiness
from factloom.plans.proofs import _proof
from factloom.sources.tables import spread, table

# --- JSON ------------------------------------------------------------------------------------------------------------
_EVENT = """'{"v": ' || event_id || ', "props": ' || coalesce(props, 'null') || ', "a": {"t": "' || event_type || '", "b": [1.50, null, true, {"z": ' || user_id || ', "y": "~"}]}' || CASE WHEN event_id % 9 = 0 THEN '' ELSE '}' END"""


@_proof("""SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN '{"a":{"b":[1.5,null,true,{"y":"~","z":' || user_id || '}],"t":"' || event_type || '"},"props":' || replace(coalesce(props, 'null'), ' ', '') || ',"v":' || event_id || '}' END AS canonical FROM events""")
def canonical_events(spark, d):
    return table(spark, d, "events").selectExpr("event_id", f"{_EVENT} AS doc").select("event_id", J.canonical_json(F.col("doc")).alias("canonical"))


@_proof("""SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN CAST(user_id AS VARCHAR) END AS deep, CASE WHEN event_id % 9 <> 0 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 9 <> 0 THEN 'null' END AS nothing, CAST(NULL AS VARCHAR) AS absent FROM events""")
def pointer_values(spark, d):
    doc = table(spark, d, "events").selectExpr("event_id", f"try_parse_json({_EVENT}) AS doc")
    found = {"deep": "/a/b/3/z", "k": "/props/k", "nothing": "/a/b/1", "absent": "/a/b/9/z"}
    return doc.select("event_id", *(F.to_json(J.pointer_value(F.col("doc"), p)).alias(n) for n, p in found.items()))


_SCHEMA = """'{"type": "' || CASE WHEN p_size % 11 = 0 THEN 'array' ELSE 'object' END || '", "required": ["name", 7], "properties": {"name": {"type": "string", "pattern": "^' || p_size || '"}, "size": {"type": "' || CASE WHEN p_size % 3 = 0 THEN 'integer' ELSE 'null' END || '"}, "tags": {"type": "string", "items": {}}}' || CASE WHEN p_size % 7 = 0 THEN ', "anyOf": []' ELSE '' END || '}'"""


def _schemas(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", "p_size", f"try_parse_json({_SCHEMA}) AS schema")


@_proof("""SELECT p_partkey, CASE WHEN odd THEN '' ELSE 'name' END AS required, CASE WHEN odd THEN '' WHEN p_size % 3 = 0 THEN 'name,size' ELSE 'name' END AS leaves, CASE WHEN NOT odd THEN '^' || p_size END AS pattern, CASE WHEN odd THEN '' WHEN p_size % 3 = 0 THEN '/tags' ELSE '/size,/tags' END AS unsupported
FROM (SELECT *, p_size % 11 = 0 OR p_size % 7 = 0 AS odd FROM part)""")
def schema_projection(spark, d):
    rows = _schemas(spark, d).select("p_partkey", J.schema_leaves(F.col("schema")).alias("s"))
    return rows.select("p_partkey", F.array_join("s.required", ",").alias("required"), F.array_join(F.array_sort(F.map_keys("s.properties")), ",").alias("leaves"), F.expr("try_element_at(s.properties, 'name').pattern").alias("pattern"), F.array_join("s.unsupported", ",").alias("unsupported"))


@_proof("""SELECT p_partkey, p, CASE WHEN p_size % 11 = 0 THEN 'no-schema' WHEN p IN ('/name', '/tags') OR (p = '/size' AND p_size % 3 = 0) THEN 'ok' ELSE 'unknown-pointer' END AS code, CASE WHEN p_size % 11 = 0 THEN NULL WHEN p IN ('/name', '/tags') THEN 'string' WHEN p = '/size' AND p_size % 3 = 0 THEN 'integer' END AS type
FROM part, (SELECT unnest(['/name', '/size', '/tags', '/gone', '/name/x', 'name']) AS p)""")
def rule_pointers(spark, d):
    rows = _schemas(spark, d).selectExpr("p_partkey", "schema", "explode(array('/name', '/size', '/tags', '/gone', '/name/x', 'name')) AS p")
    return rows.select("p_partkey", "p", J.rule_pointer(F.col("schema"), F.col("p")).alias("r")).select("p_partkey", "p", "r.*")


@_proof("""SELECT a, b, (a IN ('number', 'integer') AND b IN ('number', 'integer')) OR (a = 'string' AND b = 'string') AS comparable FROM (SELECT DISTINCT ['string', 'number', 'integer', 'boolean', 'null'][CAST(p_size % 5 + 1 AS INT)] AS a, ['string', 'number', 'integer', 'boolean', 'null'][CAST(p_partkey % 5 + 1 AS INT)] AS b FROM part)""")
def comparable_types(spark, d):
    kinds = "array('string', 'number', 'integer', 'boolean', 'null')"
    return table(spark, d, "part").selectExpr(f"get({kinds}, p_size % 5) AS a", f"get({kinds}, CAST(p_partkey % 5 AS INT)) AS b").distinct().select("a", "b", J.comparable(F.col("a"), F.col("b")).alias("comparable"))


@_proof("""SELECT doc_id, CASE WHEN doc_id % 10 <> 0 AND source IS NOT NULL AND source <> '' THEN sha256('{"adapter_digest":"' || h || '","config_digest":"' || h || '","namespace":"scan/1","parser_digest":"' || h || '","policy_digest":"' || h || '","resolver_digest":"' || h || '","runtime_fingerprint":"' || source || '","schema_digest":"' || h || '","source_digest":"' || sha256(coalesce(text, '')) || '"}') END AS digest
FROM (SELECT *, sha256(coalesce(lang, '')) AS h FROM documents)""")
def scan_cache_keys(spark, d):
    h = F.sha2(F.coalesce("lang", F.lit("")), 256)
    parts = {n: h for n in J.CACHE_DIGESTS} | {"source": F.when(F.col("doc_id") % 10 != 0, F.sha2(F.coalesce("text", F.lit("")), 256)).otherwise("latest")}
    return table(spark, d, "documents").select("doc_id", J.cache_key(F.lit("scan/1"), parts, F.col("source")).alias("digest"))


@_proof("""SELECT p_partkey, 'entity:jpa:' || replace(p_name, ' ', '%20') || ':' || CASE WHEN p_size % 3 = 0 THEN 'src%2F' || replace(replace(p_brand, '#', '%23'), ' ', '%20') WHEN p_size % 3 = 1 THEN replace(p_type, ' ', '%20') ELSE replace(p_name, ' ', '%20') END AS entity, 'item:' || substr(sha256('{"a":' || p_size || ',"b":' || p_partkey || '}'), 1, 20) AS item FROM part""")
def stable_ids(spark, d):
    file, name = F.expr(r"CASE WHEN p_size % 3 = 0 THEN 'src\\' || p_brand END"), F.expr("IF(p_size % 3 = 1, p_type, '')")
    item = F.expr("""'{"b": ' || p_partkey || ', "a": ' || p_size || '}'""")
    return table(spark, d, "part").select("p_partkey", J.entity_id(F.lit("jpa"), F.col("p_name"), file, name).alias("entity"), J.item_id(F.lit("item"), item).alias("item"))


# --- contracts -------------------------------------------------------------------------------------------------------
@_proof("""SELECT 'op' || p_partkey AS operation_id, 'GET' AS verb, '/' || p_size || '/{id}' AS path, CASE WHEN p_size % 2 = 0 THEN 'id, other' ELSE '' END AS path_params, CASE WHEN p_size % 3 = 0 THEN 'zid, aid' ELSE '' END AS path_params_unverified,
CASE WHEN p_size % 5 = 0 THEN 'true' ELSE 'false' END AS body, CASE WHEN p_size % 4 = 0 THEN 'true' WHEN p_size % 4 = 1 THEN 'false' ELSE '' END AS request_body_required, 'a, b' AS request_body_fields, p_name AS response_fields, '' AS error_fields, 'source' AS provenance,
CASE WHEN p_size % 6 = 0 THEN '' ELSE p_type END AS summary, p_brand || ', x' AS tags, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '(source-declared: none)' ELSE 'bearer, oauth' END AS security FROM part""")
def contract_projection(spark, d):
    ops = table(spark, d, "part").selectExpr(
        "'op' || p_partkey AS operation_id", "'GET' AS verb", "'/' || p_size || '/{id}' AS path", "IF(p_size % 2 = 0, map('other', 1, 'id', 2), NULL) AS path_params", "IF(p_size % 3 = 0, array('zid', 'aid'), NULL) AS path_params_unverified", "p_size % 5 = 0 AS body",
        "CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false END AS request_body_required", "map('b', 1, 'a', 1) AS request_body", "map(p_name, 1) AS response", "CAST(map() AS map<string,int>) AS error", "'source' AS provenance", "IF(p_size % 6 = 0, NULL, p_type) AS summary", "array(p_brand, 'x') AS tags",
        "CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST(array() AS array<map<string,int>>) ELSE array(map('oauth', 1), map('bearer', 1, 'oauth', 2)) END AS security")
    return contracts.projection(ops)


@_proof("""SELECT p_partkey AS operation_id, 'GET' AS verb, p_name AS path, sha256('{"a":' || p_size || ',"b":[' || p_partkey || ']}') AS request_shape, CASE WHEN p_size % 2 = 0 THEN sha256('{}') END AS response_shape, CAST(NULL AS VARCHAR) AS error_shape FROM part""")
def contract_surface(spark, d):
    return contracts.surface(table(spark, d, "part").selectExpr("p_partkey AS operation_id", "'GET' AS verb", "p_name AS path", """'{ "b": [' || p_partkey || '], "a" : ' || p_size || '}' AS request""", "IF(p_size % 2 = 0, '{ }', 'false') AS response", "IF(p_size % 2 = 0, 'null', CAST(NULL AS STRING)) AS error"))


_BARS = "b AS (SELECT 'parameters' AS measure, CAST(p_size % 6 AS BIGINT) AS size, count(*) AS operations, min(p_partkey) AS example FROM part GROUP BY 2 UNION ALL SELECT 'responses', CAST(length(p_name) AS BIGINT), count(*), min(p_partkey) FROM part WHERE p_size % 7 <> 0 GROUP BY 2)"


def _bars(spark, d):
    return contracts.measured(table(spark, d, "part").selectExpr("p_partkey", "p_size % 6 AS parameters", "IF(p_size % 7 <> 0, length(p_name), NULL) AS responses"), "p_partkey", ["parameters", "responses"])


@_proof(f"WITH {_BARS} SELECT * FROM b")
def measure_histograms(spark, d):
    return _bars(spark, d)


@_proof(f"WITH {_BARS} SELECT measure, max(size) AS size, arg_max(example, size) AS example FROM b GROUP BY 1")
def measure_maxima(spark, d):
    return contracts.largest(_bars(spark, d))


@_proof("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'too-large' WHEN 1 THEN 'unreadable' WHEN 2 THEN 'no-paths' ELSE 'ok' END AS code, CASE WHEN p_size % 6 > 2 THEN '/a/' || p_brand END AS path, CASE WHEN p_size % 6 > 2 THEN verb END AS verb, CASE WHEN p_size % 6 > 2 AND verb = 'get' THEN 'op' || p_partkey END AS operation_id
FROM part, (SELECT unnest(['get', 'post']) AS verb) WHERE p_size % 6 > 2 OR verb = 'get'""")
def openapi_operations(spark, d):
    text = """CASE p_size % 6 WHEN 0 THEN repeat('x', 900) WHEN 1 THEN '{' WHEN 2 THEN '{"info": {}}' ELSE '{"paths": {"/a/' || p_brand || '": {"get": {"operationId": "op' || p_partkey || '"}, "post": {}, "parameters": [], "x-y": {}}, "/none": {"summary": "s"}}}' END AS text"""
    return contracts.openapi_operations(table(spark, d, "part").selectExpr("p_partkey", text), "p_partkey", "text", 500)


@_proof("""SELECT p_partkey, 'route' AS code, p_brand AS name, m AS method, '/' || p_name AS path, 'C@a' AS action FROM part, (SELECT unnest(['GET', 'HEAD']) AS m) WHERE p_size % 5 <> 0 UNION ALL SELECT p_partkey, 'invalid-row', NULL, NULL, NULL, NULL FROM part WHERE p_size % 5 <> 0
UNION ALL SELECT p_partkey, 'incomplete', 'n', NULL, NULL, NULL FROM part WHERE p_size % 5 <> 0 UNION ALL SELECT p_partkey, 'unreadable', NULL, NULL, NULL, NULL FROM part WHERE p_size % 5 = 0""")
def laravel_routes(spark, d):
    text = """IF(p_size % 5 = 0, '{"a": 1}', '[{"method": "get | HEAD|", "uri": "//' || p_name || '", "name": "' || p_brand || '", "action": "C@a"}, 7, {"uri": "x", "name": "n"}]') AS text"""
    return contracts.laravel_routes(table(spark, d, "part").selectExpr("p_partkey", text), "p_partkey", "text")


@_proof("""SELECT p_partkey, 'route' AS code, 'users' AS name, m AS method, '/u/' || p_size || '/{id}' AS path, 'users' AS controller, 'show' AS action FROM part, (SELECT unnest(['GET', 'PUT']) AS m) UNION ALL SELECT p_partkey, 'incomplete', NULL, NULL, '/x', NULL, NULL FROM part UNION ALL SELECT p_partkey, 'target-unresolved', 'blob', 'GET', '/b', NULL, NULL FROM part""")
def rails_routes(spark, d):
    text = r"""'head\n--[ Route 1 ]------\nPrefix            | users\nVerb | GET|PUT\nURI | /u/' || p_size || '/:id(.:format)\nController#Action | users#show\n--[ Route 2 ]---\nPrefix |\nVerb |\nURI | /x\nController#Action | a#b\n--[ Route 3 ]---\nPrefix | blob\nVerb | get\nURI | /b\nController#Action | redirect(301)' AS text"""
    return contracts.rails_routes(spread(table(spark, d, "part"), "p_partkey").selectExpr("p_partkey", text), "p_partkey", "text")


_PAIR = "p AS (SELECT event_id AS id, event_id % 4 AS k, value, event_type FROM events)"


@_proof(f"""WITH {_PAIR} SELECT id, 'list' AS path, 'array-length' AS kind FROM p WHERE k = 1 UNION ALL SELECT id, 'list[0].v', 'value' FROM p WHERE k = 1 UNION ALL SELECT id, 'obj', 'type' FROM p WHERE k = 2 UNION ALL SELECT id, 'gone', 'missing' FROM p WHERE k = 2 UNION ALL SELECT id, 'new', 'unexpected' FROM p WHERE k = 2
UNION ALL SELECT id, 'obj[7]', 'value' FROM p WHERE k = 3 UNION ALL SELECT id, 'obj.deep.t', 'value' FROM p WHERE k = 3""")
def deep_differences(spark, d):
    return contracts.deep_differences(_documents(spark, d), "id", "a", "b")


@_proof(f"""WITH {_PAIR} SELECT id, 'list' AS path, 'array-length' AS kind FROM p WHERE k = 1 UNION ALL SELECT id, 'list[0].v', 'value' FROM p WHERE k = 1 UNION ALL SELECT id, 'gone', 'missing' FROM p WHERE k = 2 UNION ALL SELECT id, 'new', 'unexpected' FROM p WHERE k = 2
UNION ALL SELECT id, 'obj.deep.t', 'value' FROM p WHERE k = 3 UNION ALL SELECT id, 'obj[7]', 'value' FROM p WHERE k = 3""")
def first_differences(spark, d):
    return contracts.first_differences(contracts.deep_differences(_documents(spark, d), "id", "a", "b"), "id", 2)


def _documents(spark, d):
    doc = lambda items, obj, more: f"""'{{"list": {items}, "obj": ' || {obj} || '{more}}}'"""
    plain = """'{"7": 1, "deep": {"t": "' || event_type || '"}}'"""
    a, b = doc('[{"v": 1}, 2]', plain, ', "gone": null'), doc('[{"v": 1}, 2]', plain, ', "gone": null')
    other = f"""CASE event_id % 4 WHEN 0 THEN {b} WHEN 1 THEN {doc('[{"v": 2}, 2, 3]', plain, ', "gone": null')} WHEN 2 THEN {doc('[{"v": 1}, 2]', "'[]'", ', "new": 0')} ELSE {doc('[{"v": 1}, 2]', "'{{\"deep\": {{\"t\": null}}, \"7\": 2}}'".replace("{{", "{").replace("}}", "}"), ', "gone": null')} END"""
    return table(spark, d, "events").selectExpr("event_id AS id", f"{a} AS a", f"{other} AS b")


@_proof("""WITH c AS (SELECT p_size AS feature, p_brand AS class, min(CASE WHEN p_partkey % 3 <> 0 THEN p_name END) AS file FROM part GROUP BY 1, 2), w AS (SELECT p_partkey, p_size AS feature, p_brand AS target, p_size + 1 AS source_feature, p_brand AS source FROM part)
SELECT w.*, CASE WHEN t.file IS NULL OR s.file IS NULL THEN 'unresolved' WHEN w.feature % 4 = 0 OR (w.feature % 4 = 1 AND w.source_feature % 3 = 0) THEN 'stale' ELSE 'synced' END AS resolution, CASE WHEN t.file IS NULL THEN 'target' WHEN s.file IS NULL THEN 'source' END AS side
FROM w LEFT JOIN c t ON t.feature = w.feature AND t.class = w.target LEFT JOIN c s ON s.feature = w.source_feature AND s.class = w.source""")
def field_wires(spark, d):
    part = table(spark, d, "part")
    wires = part.selectExpr("p_partkey", "p_size AS feature", "p_brand AS target", "p_size + 1 AS source_feature", "p_brand AS source")
    changed = part.selectExpr("p_size AS feature", "CASE WHEN p_size % 4 = 0 THEN 'target:' || p_brand WHEN p_size % 4 = 1 AND (p_size + 1) % 3 = 0 THEN 'source:' || (p_size + 1) || ':' || p_brand END AS input").where("input IS NOT NULL")
    return contracts.field_wires(wires, part.selectExpr("p_size AS feature", "p_brand AS class", "IF(p_partkey % 3 <> 0, p_name, NULL) AS file"), changed)


@_proof("""SELECT conv_id, turn, CASE WHEN role <> 'user' THEN CAST(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS VARCHAR) END AS operation FROM conversations""")
def nearest_operations(spark, d):
    rows = table(spark, d, "conversations").withColumn("op", F.when(F.col("role") == "user", F.col("turn")))
    return contracts.nearest_before(rows, "conv_id", "turn", "op").select("conv_id", "turn", F.when(F.col("role") != "user", F.col("nearest")).cast("string").alias("operation"))


@_proof("""SELECT 1 AS section, '  n_' || p_partkey || '["' || replace(p_name || '"', '"', '''') || '"]' AS line FROM part UNION ALL SELECT 2, '  n_' || p_partkey || CASE WHEN p_size % 2 = 0 THEN ' -->|fk| n_' ELSE ' -.->|fk| n_' END || p_size FROM part""")
def mermaid_lines(spark, d):
    part = table(spark, d, "part")
    return contracts.mermaid_lines(part.selectExpr("'n:' || p_partkey AS id", "p_name || '\"' AS label"), part.selectExpr("'n:' || p_partkey AS source", "'n:' || p_size AS target", "'fk' AS relation", "IF(p_size % 2 = 0, 'proven', NULL) AS confidence"))


# --- readiness -------------------------------------------------------------------------------------------------------
@_proof("""WITH l AS (SELECT p_brand AS name, p_size % 5 AS s, count(*) AS n, max(CASE WHEN p_size % 10 < 5 THEN 'uuid' ELSE 'bigint' END) AS t FROM part WHERE p_size < 20 GROUP BY 1, 2),
b AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 's' || p_size % 5 END AS schema, CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS name, p_size % 5 AS s, p_partkey % 7 = 0 AS bad, [NULL, 'UUID', 'non-uuid', 'bigint'][CAST(p_partkey % 4 + 1 AS INT)] AS key_type FROM part),
j AS (SELECT b.*, n, t, CASE WHEN b.name IS NULL OR n IS NULL OR n > 1 THEN 'unknown' WHEN bad THEN 'mismatch' ELSE 'verified' END AS key_status FROM b LEFT JOIN l ON l.name = b.name AND l.s = b.s),
k AS (SELECT *, CASE WHEN key_status <> 'verified' THEN 'unknown' WHEN key_type IS NULL THEN 'observed' WHEN lower(key_type) = t OR (key_type = 'non-uuid' AND t <> 'uuid') THEN 'verified' ELSE 'mismatch' END AS key_type_status FROM j)
SELECT p_partkey, CASE WHEN name IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'verified' END AS table_status, key_status, key_type_status,
CASE WHEN key_status <> 'verified' THEN coalesce(key_type, 'unknown') WHEN key_type IS NULL THEN t WHEN key_type_status = 'verified' THEN t WHEN key_type = 'UUID' THEN 'uuid' ELSE key_type END AS effective_key_type, key_status = 'verified' AND key_type_status <> 'mismatch' AS verified FROM k""")
def bindings_verified(spark, d):
    part = table(spark, d, "part")
    schema = "IF(p_size % 5 = 0, NULL, 's' || p_size % 5) AS schema"
    bindings = part.selectExpr("p_partkey", schema, "IF(p_partkey % 13 <> 0, p_brand, NULL) AS name", "IF(p_partkey % 7 = 0, array('other'), array('id')) AS pk", "get(array(NULL, 'UUID', 'non-uuid', 'bigint'), CAST(p_partkey % 4 AS INT)) AS key_type")
    live = part.where("p_size < 20").selectExpr(schema, "p_brand AS name", "array('id') AS pk", "'live' AS pk_source", "IF(p_size % 10 < 5, 'uuid', 'bigint') AS pk_type")
    return readiness.verified_bindings(bindings, live, "public").drop("schema", "name", "pk", "key_type")


_BLOCKED = "b AS (SELECT p_partkey, p_brand, concat_ws(',', CASE WHEN p_size % 2 = 0 THEN 'persistence-target-not-admitted' END, CASE WHEN p_size % 3 = 0 THEN 'entity-binding-missing' END, CASE WHEN p_size % 5 = 0 THEN 'physical-table-unknown' END, CASE WHEN p_size % 7 = 0 THEN 'primary-key-unknown' END, CASE WHEN p_size % 11 = 0 THEN 'read-by-primary-key-not-candidate' END, CASE WHEN p_size % 13 = 0 THEN 'read-by-primary-key-not-verified' END) AS blockers FROM part)"


def _blocked(spark, d):
    x = F.expr
    blockers = readiness.binding_blockers(x("p_size % 2 <> 0"), x("IF(p_size % 3 = 0, NULL, 'e')"), x("IF(p_size % 5 = 0, '', 't')"), x("IF(p_size % 7 = 0, CAST(array() AS array<string>), array('id'))"), x("IF(p_size % 11 = 0, NULL, true)"), x("p_size % 13 <> 0"))
    return table(spark, d, "part").select("p_partkey", "p_brand", blockers.alias("blockers"))


@_proof(f"WITH {_BLOCKED} SELECT p_partkey, blockers FROM b")
def binding_blockers(spark, d):
    return _blocked(spark, d).select("p_partkey", "blockers")


@_proof(f"""WITH {_BLOCKED}, r AS (SELECT p_brand || p_partkey % 50 AS provider, count(*) FILTER (blockers <> '') AS blocked FROM b GROUP BY 1), c AS (SELECT p_brand || p_partkey % 50 AS provider, count(*) AS conflicts FROM part WHERE p_size = 1 GROUP BY 1)
SELECT provider, CASE WHEN blocked = 0 AND conflicts IS NULL THEN 'runtime-read-verified' ELSE 'partial-or-blocked' END AS status, blocked, coalesce(conflicts, 0) AS conflicts FROM r LEFT JOIN c USING (provider)""")
def binding_certificates(spark, d):
    provider = "p_brand || p_partkey % 50 AS provider"
    return readiness.binding_certificate(_blocked(spark, d).selectExpr(provider, "blockers"), table(spark, d, "part").where("p_size = 1").selectExpr(provider), "provider")


@_proof("""SELECT p_partkey, p_size % 3 > 0 AND p_size % 4 > 0 AND p_size % 9 > 0 AS ready, concat_ws(',', CASE WHEN p_size % 3 = 0 THEN 'semantic-parity-not-verified' END, CASE WHEN p_size % 4 = 0 THEN 'exact-head-ci-not-green' END) AS blockers, CASE WHEN p_size % 9 = 0 THEN 'extra' ELSE '' END AS unknown FROM part""")
def cutover_readiness(spark, d):
    said = {"semantic_parity_verified": "p_size % 3 <> 0", "exact_head_ci_green": "IF(p_size % 4 = 0, NULL, true)"}
    checks = ", ".join(f"'{n}', {said.get(n, 'true')}" for n in readiness.CUTOVER_CHECKS)
    return table(spark, d, "part").select("p_partkey", readiness.cutover(F.expr(f"map_concat(map({checks}), IF(p_size % 9 = 0, map('extra', true), CAST(map() AS map<string,boolean>)))")).alias("c")).select("p_partkey", "c.*")


_PROMOTED = "SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey * 10 + l_linenumber AS id, l_partkey AS p, l_suppkey AS s, l_returnflag AS f, l_linestatus AS z FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus"


@_proof(f"""WITH x AS ({_PROMOTED}), y AS (SELECT id, concat_ws(',', CASE WHEN p % 5 = 0 THEN 'openapi-context-not-attached' END, CASE p % 7 WHEN 0 THEN 'source-spec-binding-not-bound:unbound:why' WHEN 1 THEN 'source-spec-binding-not-bound:unknown:missing-binding-state' END,
CASE f WHEN 'N' THEN 'route-field-not-resolved:operation.identity:unknown:because' WHEN 'R' THEN 'route-field-not-resolved:operation.identity:missing:field-missing' END, CASE WHEN z = 'F' THEN 'route-field-not-resolved:http.path:conflict:path-drift' END) AS source_blockers,
CASE WHEN s % 11 = 0 THEN 'runtime-binding-not-bound:unknown:missing-runtime-binding-state' WHEN s % 11 = 1 THEN 'runtime-report-not-supplied' WHEN s % 11 = 2 THEN 'runtime-report-version-unsupported' WHEN s % 11 = 3 THEN 'runtime-report-not-ready:stale:old' WHEN s % 11 = 4 THEN 'runtime-report-source-ref-mismatch' WHEN s % 11 = 5 THEN 'runtime-report-attempt-mismatch'
WHEN p % 4 = 0 THEN 'runtime-endpoint-result-missing' WHEN p % 4 = 1 THEN 'runtime-route-not-observed:absent:runtime-route-state-missing' WHEN f <> 'A' OR z = 'F' THEN 'runtime-expected-route-unavailable' WHEN s % 2 = 0 THEN 'runtime-expected-route-mismatch' END AS runtime_blocker FROM x)
SELECT *, source_blockers = '' AS source_ready, source_blockers = '' AND runtime_blocker IS NULL AS runtime_ready FROM y""")
def promotion_readiness(spark, d):
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")).alias("m")
    x = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(first).selectExpr("id", "m.l_partkey AS p", "m.l_suppkey AS s", "m.l_returnflag AS f", "m.l_linestatus AS z")
    made = x.selectExpr("id", "f", """inline(array(named_struct('field', 'operation.identity', 'state', IF(f = 'A', 'resolved', 'unknown'), 'value', 'op', 'reason', IF(f = 'A', 'ok', 'because')),
        named_struct('field', 'http.method', 'state', 'resolved', 'value', 'GET', 'reason', 'ok'), named_struct('field', 'http.path', 'state', IF(z = 'F', 'conflict', 'resolved'), 'value', '/x', 'reason', IF(z = 'F', 'path-drift', 'ok'))))""").where("NOT (f = 'R' AND field = 'operation.identity')")
    pairs = ", ".join(f"'{n}', '{n}'" for n, _ in readiness.REPORT_PAIRS)
    odd = pairs.replace("'source_ref', 'source_ref'", "'source_ref', IF(s % 11 = 4, 'other', 'source_ref')").replace("'nonce', 'nonce'", "'nonce', IF(s % 11 = 5, NULL, 'nonce')")
    context = x.selectExpr("id", "p % 5 <> 0 AS audited", f"""named_struct('source_state', CASE p % 7 WHEN 0 THEN 'unbound' WHEN 1 THEN NULL ELSE 'bound' END, 'source_reason', IF(p % 7 = 0, 'why', NULL), 'runtime_state', IF(s % 11 = 0, NULL, 'bound'), 'runtime_reason', CAST(NULL AS STRING), {pairs}) AS binding""",
        f"IF(s % 11 = 1, NULL, named_struct('supported', s % 11 <> 2, 'state', IF(s % 11 = 3, 'stale', 'ready'), 'reason', IF(s % 11 = 3, 'old', NULL), {odd})) AS report",
        "IF(p % 4 = 0, NULL, named_struct('state', IF(p % 4 = 1, 'absent', 'observed'), 'reason', CAST(NULL AS STRING), 'operation_id', 'op', 'method', IF(s % 2 = 0, 'PUT', 'GET'), 'path', '/x')) AS observed")
    got = readiness.promotion(made, "id", context, decisions.ROUTE_FIELDS)
    told = F.transform("source_blockers", lambda b: F.concat_ws(":", b["code"], b["field"], b["state"], b["reason"]))
    return got.select("id", F.array_join(told, ",").alias("source_blockers"), F.when(F.col("runtime_blocker").isNotNull(), F.concat_ws(":", "runtime_blocker.code", "runtime_blocker.state", "runtime_blocker.reason")).alias("runtime_blocker"), "source_ready", "runtime_ready")


@_proof("""SELECT o_orderkey, role, coalesce(lo = ref AND hi = ref, false) AS fits FROM (SELECT o_orderkey, unnest(['A', 'R']) AS role, 'r1' AS ref FROM orders) LEFT JOIN (SELECT l_orderkey, l_returnflag AS role, min('r' || l_linenumber % 2) AS lo, max('r' || l_linenumber % 2) AS hi FROM lineitem GROUP BY 1, 2) e USING (role) WHERE l_orderkey = o_orderkey
UNION ALL SELECT o_orderkey, role, false FROM (SELECT o_orderkey, unnest(['A', 'R']) AS role FROM orders) o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = role)""")
def evidence_bound(spark, d):
    evidence = table(spark, d, "lineitem").selectExpr("l_orderkey AS o_orderkey", "l_returnflag AS role", "'r' || l_linenumber % 2 AS ref")
    return readiness.evidence_bound(evidence, table(spark, d, "orders").selectExpr("o_orderkey", "explode(array('A', 'R')) AS role", "'r1' AS ref"), "o_orderkey")


@_proof("""WITH c(kind, name, want) AS (VALUES ('positive', 'n1', '2'), ('negative', 'n2', '^bad'), ('artifact', 'n3', 'x')), r AS (SELECT l_orderkey AS consumer, CASE l_linenumber % 4 WHEN 1 THEN 'positive' WHEN 2 THEN 'negative' WHEN 3 THEN 'artifact' ELSE 'positive' END AS kind, 'n' || l_linenumber % 4 AS name, CASE WHEN l_quantity > 45 THEN 'fail' ELSE 'pass' END AS outcome, CASE WHEN l_linenumber % 4 = 1 THEN CASE WHEN l_tax > 0.02 THEN '2' ELSE '3' END WHEN l_linenumber % 4 = 2 THEN CASE WHEN l_tax > 0.02 THEN 'bad thing' ELSE 'a bad' END ELSE 'x' END AS observed FROM lineitem),
g AS (SELECT consumer, kind, name, count(*) AS n, min(outcome) AS lo, min(observed) AS observed FROM r GROUP BY 1, 2, 3)
SELECT consumer, kind, name, CASE WHEN n > 1 THEN 'duplicate' WHEN want IS NULL THEN 'unexpected' WHEN lo <> 'pass' THEN 'not-passed' ELSE 'mismatch' END AS fault FROM g LEFT JOIN c USING (kind, name) WHERE n > 1 OR want IS NULL OR lo <> 'pass' OR NOT CASE WHEN kind = 'negative' THEN starts_with(observed, 'bad') ELSE observed = want END
UNION ALL SELECT consumer, c.kind, c.name, 'missing' FROM (SELECT DISTINCT consumer FROM r), c WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.consumer = r.consumer AND g.kind = c.kind AND g.name = c.name)""".replace("(SELECT DISTINCT consumer FROM r), c", "(SELECT DISTINCT consumer FROM r) r, c"))
def consumer_faults(spark, d):
    cases = spark.createDataFrame([("p", "positive", "n1", "2"), ("p", "negative", "n2", "^bad"), ("p", "artifact", "n3", "x")], "pack string, kind string, name string, want string")
    observed = "CASE l_linenumber % 4 WHEN 1 THEN IF(l_tax > 0.02, '2', '3') WHEN 2 THEN IF(l_tax > 0.02, 'bad thing', 'a bad') ELSE 'x' END AS observed"
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey AS consumer", "'p' AS pack", "get(array('positive', 'positive', 'negative', 'artifact'), l_linenumber % 4) AS kind", "'n' || l_linenumber % 4 AS name", "IF(l_quantity > 45, 'fail', 'pass') AS outcome", observed)
    return readiness.case_faults(cases, rows, "consumer")


_ENTITIES = "a AS (SELECT DISTINCT p_brand AS entity, p_name AS name, CASE WHEN p_size % 4 > 0 THEN p_type END AS type FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT DISTINCT p_brand AS entity, p_name AS name, CASE WHEN p_size % 4 > 0 THEN p_type END AS type FROM part WHERE p_partkey % 7 <> 0 AND p_brand NOT LIKE '%1')"


@_proof(f"""WITH {_ENTITIES} SELECT *, 'missing-or-mismatched' AS code FROM (SELECT * FROM a WHERE entity IN (SELECT entity FROM b) EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) WHERE entity LIKE '%2' UNION ALL SELECT DISTINCT entity, NULL, NULL, 'entity-missing' FROM a WHERE entity NOT IN (SELECT entity FROM b)""")
def entity_conformance(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", "p_brand AS entity", "p_name AS name", "IF(p_size % 4 > 0, p_type, NULL) AS type")
    return readiness.conformance(rows.where("p_partkey % 5 <> 0"), rows.where("p_partkey % 7 <> 0 AND entity NOT LIKE '%1'"), rows.where("entity LIKE '%2'"), ["name", "type"])


_USES = "u AS (SELECT DISTINCT p_partkey % 400 AS file, 'p' || p_partkey % 8 AS package, CASE p_size % 5 WHEN 0 THEN 'x.Y' WHEN 1 THEN 'Override' ELSE 'A' || p_size % 12 END AS name FROM part)"


@_proof(f"""WITH {_USES}, t AS (SELECT fqn FROM (SELECT DISTINCT p_size % 12 AS n, p_partkey % 8 AS k, p_type FROM part WHERE p_partkey < 60), (SELECT 1), LATERAL (SELECT 'p' || k || '.A' || n AS fqn) GROUP BY fqn HAVING count(*) = 1),
i AS (SELECT DISTINCT p_partkey % 400 AS file, CASE WHEN p_size % 2 = 0 THEN 'q.A' || p_size % 12 ELSE 'p' || p_size % 8 || '.*' END AS import FROM part),
c AS (SELECT u.file, u.name, import AS fqn, 1 AS r FROM u JOIN i ON i.file = u.file AND import NOT LIKE '%.*' AND split_part(import, '.', 2) = u.name UNION SELECT u.file, u.name, package || '.' || name, 2 FROM u WHERE package || '.' || name IN (FROM t) UNION SELECT u.file, u.name, split_part(import, '.', 1) || '.' || name, 3 FROM u JOIN i ON i.file = u.file AND import LIKE '%.*' WHERE split_part(import, '.', 1) || '.' || name IN (FROM t)),
g AS (SELECT file, name, count(DISTINCT fqn) AS n, min(fqn) AS fqn, min(r) AS r, string_agg(DISTINCT fqn, ',' ORDER BY fqn) AS alls FROM c GROUP BY 1, 2)
SELECT u.file, u.package, u.name, CASE WHEN u.name = 'x.Y' OR n = 1 THEN 'resolved' WHEN n > 1 THEN 'conflict' WHEN u.name = 'Override' THEN 'resolved' ELSE 'unknown' END AS status, CASE WHEN u.name = 'x.Y' THEN 'x.Y' WHEN n = 1 THEN fqn WHEN n IS NULL AND u.name = 'Override' THEN 'java.lang.Override' END AS fqn,
CASE WHEN u.name = 'x.Y' THEN 'written-qualified' WHEN n = 1 THEN ['explicit-import', 'same-package-project-type', 'wildcard-project-type'][r] WHEN n > 1 THEN 'multiple-proven-candidates' WHEN u.name = 'Override' THEN 'java-lang' ELSE 'insufficient-static-evidence' END AS basis,
CASE WHEN u.name = 'x.Y' THEN 'x.Y' WHEN n > 0 THEN alls WHEN u.name = 'Override' THEN 'java.lang.Override' ELSE '' END AS candidates FROM u LEFT JOIN g USING (file, name)""")
def annotation_names(spark, d):
    part = table(spark, d, "part")
    uses = part.selectExpr("p_partkey % 400 AS file", "'p' || p_partkey % 8 AS package", "CASE p_size % 5 WHEN 0 THEN 'x.Y' WHEN 1 THEN 'Override' ELSE 'A' || p_size % 12 END AS name")
    imports = part.selectExpr("p_partkey % 400 AS file", "IF(p_size % 2 = 0, 'q.A' || p_size % 12, 'p' || p_size % 8 || '.*') AS name")
    types = part.where("p_partkey < 60").selectExpr("p_size % 12 AS n", "p_partkey % 8 AS k", "p_type").distinct().selectExpr("'p' || k || '.A' || n AS fqn")
    return readiness.annotation_names(uses, imports, types).withColumn("candidates", F.array_join("candidates", ","))


_META = "e AS (SELECT DISTINCT p_partkey AS src, CASE WHEN p_size % 9 = 0 THEN p_partkey - 3 WHEN p_size % 9 = 1 THEN -1 ELSE p_partkey + 1 END AS dst FROM part UNION SELECT p_partkey, p_partkey + 2 FROM part WHERE p_size % 4 = 0)"


@_proof(f"""WITH RECURSIVE {_META}, r(node, stack, src, dst, known, cyc, depth) AS (SELECT e.src, [e.src], e.src, e.dst, e.dst IN (SELECT p_partkey FROM part), e.dst = e.src, 1 FROM e
UNION ALL SELECT r.node, list_append(r.stack, r.dst), e.src, e.dst, e.dst IN (SELECT p_partkey FROM part), list_contains(list_append(r.stack, r.dst), e.dst), r.depth + 1 FROM r JOIN e ON e.src = r.dst WHERE r.known AND NOT r.cyc AND r.depth < 9)
SELECT p_partkey AS node, CASE WHEN bool_or(cyc AND depth <= 8) THEN 'cycle' WHEN bool_or(known AND depth = 9) THEN 'partial' ELSE 'resolved' END AS status, count(*) FILTER (depth <= 8) AS edges, count(*) FILTER (cyc AND depth <= 8) AS cycles FROM part LEFT JOIN r ON r.node = p_partkey GROUP BY 1""")
def annotation_paths(spark, d):
    part = table(spark, d, "part")
    edges = part.selectExpr("p_partkey AS src", "CASE WHEN p_size % 9 = 0 THEN p_partkey - 3 WHEN p_size % 9 = 1 THEN -1 ELSE p_partkey + 1 END AS dst").union(part.where("p_size % 4 = 0").selectExpr("p_partkey", "p_partkey + 2"))
    return readiness.annotation_paths(part.selectExpr("p_partkey AS node"), edges.distinct())


@_proof("""WITH s AS (SELECT *, ['proposed', 'approved', 'applied', 'rolled_back'][CAST(CASE WHEN turn % 11 = 10 THEN 3 ELSE turn % 4 + 1 END AS INT)] AS status FROM conversations), b AS (SELECT *, lag(status) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM s)
SELECT conv_id, turn, CASE WHEN (status = 'proposed' AND before IS NOT NULL) OR (status = 'approved' AND before IS NULL) OR (status = 'applied' AND before IS DISTINCT FROM 'approved') OR (status = 'rolled_back' AND before IS DISTINCT FROM 'applied') THEN 'wrong-state' WHEN status IN ('approved', 'rolled_back') AND conv_id % 5 = 0 THEN 'no-reason' WHEN status IN ('approved', 'applied') AND conv_id % 7 = 0 THEN 'stale' END AS fault FROM b""")
def transaction_faults(spark, d):
    status = "get(array('proposed', 'approved', 'applied', 'rolled_back'), CAST(IF(turn % 11 = 10, 2, turn % 4) AS INT)) AS status"
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", status, "IF(conv_id % 5 = 0, ' ', 'why') AS reason", "'h' AS region", "IF(conv_id % 7 = 0, 'g', 'h') AS fresh_region")
    return readiness.transaction_faults(rows, "conv_id", "turn").select("conv_id", "turn", "fault")


@_proof("""SELECT p_partkey, t = 'allowed' AS ready, CASE t WHEN 'revoked' THEN 'package-digest-revoked' WHEN 'untrusted' THEN 'package-digest-untrusted' END AS blocker FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'allowed' WHEN 1 THEN 'revoked' ELSE 'untrusted' END AS t FROM part)""")
def package_reviews(spark, d):
    trust = F.expr("get(array('allowed', 'revoked', 'untrusted'), p_size % 3)")
    return table(spark, d, "part").select("p_partkey", readiness.package_review(trust).alias("r")).select("p_partkey", "r.*")


@_proof("""SELECT event_type, count(*) AS runs, count(*) FILTER (event_id % 9 = 0 OR props IS NULL) AS errors, CAST(coalesce(sum(CASE WHEN event_id % 9 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END), 0) AS BIGINT) AS found FROM events GROUP BY 1""")
def corpus_tallies(spark, d):
    rows = table(spark, d, "events").selectExpr("event_type", "try_parse_json(IF(event_id % 9 = 0, '{', props)) AS doc")
    return readiness.tallied(rows, "event_type", F.try_variant_get("doc", "$.k", "bigint"), F.col("doc").isNotNull())


@_proof("""SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_type) AS place FROM (SELECT DISTINCT p_brand, p_name, p_type FROM part)""")
def grouped_rules(spark, d):
    return readiness.grouped_rules(table(spark, d, "part"), "p_brand", "p_name", ["p_type"])
