"""Proof queries of contract construction, ordered mounts, inlined schemas and migrations over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import context, contract_build, graph, schemas
from factloom.plans.proofs import _proof
from factloom.sources.extract import migrations as _migrations
from factloom.sources.extract import schema_states as _schema_states
from factloom.sources.protocols import graphql, protobuf
from factloom.sources.python_routes import fastapi_routes
from factloom.sources.tables import durable, spread, table

# --- contracts -------------------------------------------------------------------------------------------------------
#: Orders are features, their lines endpoints of two controllers in two modules.
_ENDPOINTS = """SELECT DISTINCT l_orderkey AS feature, 'm' || l_linenumber % 2 AS module, l_linenumber % 3 AS controller, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS ordinal, CASE WHEN l_suppkey % 9 > 1 THEN 'op' || l_partkey % 4 WHEN l_suppkey % 9 = 1 THEN '' END AS operation_id,
l_suppkey % 11 = 0 AS synthesized, 'GET' AS verb, '/a/:id/' || l_suppkey % 3 AS path, 'm' || l_partkey AS method, CASE WHEN l_partkey % 3 = 0 THEN true WHEN l_partkey % 3 = 1 THEN false END AS body, l_partkey, l_suppkey FROM {lines}"""
_KIND = "CASE l_suppkey % 8 WHEN 0 THEN 'matched' WHEN 1 THEN 'adopted' WHEN 2 THEN 'drift' WHEN 3 THEN 'missing' WHEN 4 THEN 'ambiguous' WHEN 5 THEN 'unresolved' ELSE 'matched' END"
_FOUND = f"""SELECT feature, controller, ordinal, {_KIND} AS kind, 'op' || l_partkey % 5 AS operation_id, 'PUT' AS verb, '/v1/a/:id/:x/' || l_suppkey % 3 AS path, CASE WHEN l_suppkey % 8 IN (2, 5) THEN 'why' END AS reason, CASE WHEN l_partkey % 6 = 0 THEN 'big' END AS request_cause,
CAST(NULL AS VARCHAR(9)) AS response_cause, CASE WHEN l_partkey % 7 = 0 THEN 'cyc' END AS error_cause, CAST(NULL AS VARCHAR(9)) AS parameters_cause, CASE WHEN l_partkey % 5 = 0 THEN 'scheme' END AS security_cause, CAST(NULL AS VARCHAR(9)) AS media_cause, CAST(NULL AS VARCHAR(9)) AS description_cause FROM {{endpoints}} WHERE feature % 4 > 0 AND l_suppkey % 10 < 9"""
_BUILT = f"""f AS (SELECT o_orderkey AS feature, CASE o_custkey % 4 WHEN 0 THEN 'm1' WHEN 1 THEN 'none' END AS wanted FROM orders), ep AS ({_ENDPOINTS.format(lines='lineitem')}), mo AS (SELECT feature, module, min(ordinal) AS rank FROM ep GROUP BY 1, 2),
pick AS (SELECT f.feature, CASE WHEN wanted IS NULL THEN (SELECT arg_min(module, rank) FROM mo WHERE mo.feature = f.feature) WHEN EXISTS (SELECT 1 FROM mo WHERE mo.feature = f.feature AND mo.module = wanted) THEN wanted END AS module FROM f),
res AS ({_FOUND.format(endpoints='ep')}), j AS (SELECT ep.*, coalesce(res.kind, '') AS kind, res.operation_id AS rid, res.verb AS rv, res.path AS rp, reason, request_cause, error_cause, security_cause FROM ep JOIN pick USING (feature, module) LEFT JOIN res USING (feature, controller, ordinal)),
e AS (SELECT *, CASE WHEN kind <> 'ambiguous' THEN CASE WHEN kind = 'adopted' THEN rid ELSE nullif(operation_id, '') END END AS id, kind IN ('matched', 'adopted') AS safe, CASE WHEN kind IN ('matched', 'adopted') THEN rv ELSE verb END AS tv, CASE WHEN kind IN ('matched', 'adopted') THEN rp ELSE path END AS tp FROM j),
k AS (SELECT *, id IS NOT NULL AND row_number() OVER (PARTITION BY feature, id ORDER BY controller, ordinal) = 1 AS kept FROM e),
w AS (SELECT feature, 'CONTRACT_OPENAPI_DERIVED_OPERATION_ID' AS code, id AS subject, NULL AS reason FROM k WHERE kind = 'adopted' UNION ALL SELECT feature, 'CONTRACT_OPENAPI_DRIFT', operation_id, reason FROM k WHERE kind = 'drift'
  UNION ALL SELECT feature, 'CONTRACT_OPENAPI_MISSING_OPERATION', operation_id, NULL FROM k WHERE kind = 'missing' UNION ALL SELECT feature, 'CONTRACT_OPENAPI_AMBIGUOUS', verb || ' ' || path, NULL FROM k WHERE kind = 'ambiguous'
  UNION ALL SELECT feature, 'CONTRACT_OPENAPI_MISSING_OPERATION', operation_id, reason FROM k WHERE kind = 'unresolved' AND synthesized UNION ALL SELECT feature, 'CONTRACT_UNMATCHED_ENDPOINT', verb || ' ' || path, CASE WHEN kind = 'unresolved' THEN reason END FROM k WHERE kind <> 'ambiguous' AND id IS NULL
  UNION ALL SELECT feature, 'CONTRACT_DUPLICATE_OPERATION_ID', id, NULL FROM k WHERE id IS NOT NULL AND NOT kept UNION ALL SELECT feature, 'CONTRACT_BODY_UNKNOWN', tv || ' ' || tp, NULL FROM k WHERE kept AND body IS NULL
  UNION ALL SELECT feature, 'CONTRACT_OPENAPI_SCHEMA_UNRESOLVED', id, request_cause FROM k WHERE kept AND safe AND request_cause IS NOT NULL UNION ALL SELECT feature, 'CONTRACT_OPENAPI_ERROR_SCHEMA_UNRESOLVED', id, error_cause FROM k WHERE kept AND safe AND error_cause IS NOT NULL
  UNION ALL SELECT feature, 'CONTRACT_OPENAPI_SECURITY_UNRESOLVED', id, security_cause FROM k WHERE kept AND safe AND security_cause IS NOT NULL),
n AS (SELECT pick.feature, pick.module, count(*) FILTER (kept) AS operation_count, count(k.feature) AS endpoint_count FROM pick LEFT JOIN k USING (feature) GROUP BY 1, 2),
o AS (SELECT DISTINCT feature FROM k WHERE kept AND feature % 3 = 0 AND NOT starts_with(tp, '/v1/')),
x AS (SELECT * FROM w UNION ALL SELECT feature, 'CONTRACT_NO_MODULE', NULL, NULL FROM n WHERE module IS NULL UNION ALL SELECT feature, 'CONTRACT_EMPTY', NULL, NULL FROM n WHERE operation_count = 0 UNION ALL SELECT feature, 'CONTRACT_UNREFLECTED_PATH_PREFIX', '/v1', NULL FROM o
  UNION ALL SELECT feature, 'CONTRACT_OPENAPI_UNSUPPORTED_ANNOTATION_PRESENT', 'xml', NULL FROM pick WHERE feature % 5 = 0)"""


def _built(spark, d):
    # a line's four keys tell its endpoint, so lines are made distinct by them, before the endpoints' texts, and written once for all that follows
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    endpoints = spark.sql(_ENDPOINTS.replace("SELECT DISTINCT", "SELECT"), lines=durable(lines, broadcast=False))
    modules = endpoints.groupBy("feature", "module").agg(F.min("ordinal").alias("rank"))
    features = table(spark, d, "orders").selectExpr("o_orderkey AS feature", "CASE o_custkey % 4 WHEN 0 THEN 'm1' WHEN 1 THEN 'none' END AS wanted")
    results = spark.sql(_FOUND.replace("CAST(NULL AS VARCHAR(9))", "CAST(NULL AS STRING)"), endpoints=endpoints)
    prefixes = features.where("feature % 3 = 0").selectExpr("feature", "'/v1' AS prefix")
    return contract_build.built(features, modules, endpoints, results, prefixes, features.where("feature % 5 = 0").selectExpr("feature", "'xml' AS keyword"))


@_proof(f"""WITH {_BUILT} SELECT feature, id AS operation_id, tv AS verb, tp AS path, CASE WHEN safe THEN 'id,x' ELSE 'id' END AS path_params, coalesce(CAST(body AS VARCHAR), 'unknown') AS body,
CASE kind WHEN 'matched' THEN 'scan+openapi' WHEN 'adopted' THEN 'openapi' ELSE CASE WHEN synthesized THEN 'scan-synthesized' ELSE 'scan' END END AS provenance, CAST(ordinal AS VARCHAR) AS ordinal FROM k WHERE kept""")
def contract_operations(spark, d):
    return _built(spark, d)[0].withColumns({"path_params": F.array_join("path_params", ","), "ordinal": F.col("ordinal").cast("string")}).drop("controller")


@_proof(f"""WITH {_BUILT} SELECT feature, code, subject, reason, CASE WHEN code IN ('CONTRACT_NO_MODULE', 'CONTRACT_EMPTY', 'CONTRACT_UNMATCHED_ENDPOINT', 'CONTRACT_DUPLICATE_OPERATION_ID', 'CONTRACT_OPENAPI_DRIFT', 'CONTRACT_OPENAPI_MISSING_OPERATION', 'CONTRACT_OPENAPI_AMBIGUOUS', 'CONTRACT_UNREFLECTED_PATH_PREFIX') THEN 'error' ELSE 'warn' END AS severity,
code NOT IN ('CONTRACT_NO_MODULE', 'CONTRACT_EMPTY') AS waivable, count(*) AS n FROM x GROUP BY ALL""")
def contract_warnings(spark, d):
    return _built(spark, d)[1].groupBy("feature", "code", "subject", "reason", "severity", "waivable").agg(F.count("*").alias("n"))


@_proof(f"""WITH {_BUILT} SELECT feature, module, CASE WHEN module IS NULL THEN 'none' WHEN feature IN (SELECT feature FROM res) THEN 'scan+openapi' ELSE 'scan' END AS provenance, operation_count, endpoint_count, CASE WHEN operation_count = 0 THEN 'blocked'
WHEN feature IN (FROM o) OR feature IN (SELECT feature FROM w WHERE code IN ('CONTRACT_UNMATCHED_ENDPOINT', 'CONTRACT_DUPLICATE_OPERATION_ID', 'CONTRACT_OPENAPI_DRIFT', 'CONTRACT_OPENAPI_MISSING_OPERATION', 'CONTRACT_OPENAPI_AMBIGUOUS')) THEN 'partial' ELSE 'complete' END AS status FROM n""")
def contract_completeness(spark, d):
    return _built(spark, d)[2]


# --- mounts ----------------------------------------------------------------------------------------------------------
#: Suppliers are applications in a heap order: each mounts two others, some themselves or one above them.
_APPS = "SELECT s_suppkey AS node, 'f' || s_suppkey % 3 AS file, CASE WHEN s_suppkey % 4 = 0 THEN '/b' || s_suppkey || '/' END AS base, s_suppkey % 13 > 0 AS literal FROM {suppliers}"
_MOUNTS = """SELECT s_suppkey AS node, 3 AS at, '/l' AS path, 2 * s_suppkey AS child FROM {suppliers} UNION ALL SELECT s_suppkey, 5, 'r//', CASE WHEN s_suppkey % 6 = 5 THEN NULL ELSE 2 * s_suppkey + 1 END FROM {suppliers}
UNION ALL SELECT s_suppkey, 6, '/up', CASE WHEN s_suppkey % 10 = 8 THEN CAST(floor(s_suppkey / 2) AS BIGINT) ELSE s_suppkey END FROM {suppliers} WHERE s_suppkey % 10 > 7"""
_ROUTES = "SELECT DISTINCT l_suppkey AS node, l_linenumber AS at, CASE WHEN l_linenumber % 2 = 0 THEN 'GET' ELSE 'POST' END AS verb, '/x' || l_linenumber AS path FROM {lines}"
_JOIN = lambda a, b: f"regexp_replace(CASE WHEN regexp_replace({b}, '^/', '') <> '' THEN regexp_replace({a}, '/$', '') || '/' || regexp_replace({b}, '^/', '') WHEN regexp_replace({a}, '/$', '') <> '' THEN regexp_replace({a}, '/$', '') ELSE '/' END, '/+', '/', 'g')"
_MOUNTED = f"""n AS ({_APPS.format(suppliers='supplier')}), m AS ({_MOUNTS.format(suppliers='supplier')}), l AS (SELECT m.*, n.file AS cf FROM m LEFT JOIN n ON n.node = child), q AS ({_ROUTES.format(lines='lineitem')}),
z AS (SELECT node FROM n WHERE node NOT IN (SELECT child FROM l WHERE cf IS NOT NULL)),
r(root, node, prefix, upto, ats, above) AS (SELECT node, node, '', NULL::BIGINT, []::BIGINT[], [node] FROM (SELECT node FROM z UNION ALL SELECT node FROM n WHERE NOT EXISTS (FROM z))
UNION ALL SELECT root, child, {_JOIN(_JOIN('prefix', "coalesce(base, '')"), 'path')}, CASE WHEN file = cf THEN l.at END, list_append(ats, l.at), list_append(above, child) FROM r JOIN n USING (node) JOIN l USING (node) WHERE literal AND cf IS NOT NULL AND (upto IS NULL OR l.at < upto) AND NOT list_contains(above, child))"""


def _mounted(spark, d):
    at = {"suppliers": table(spark, d, "supplier")}
    return graph.mounted_routes(spark.sql(_APPS, **at), spark.sql(_ROUTES, lines=table(spark, d, "lineitem")), spark.sql(_MOUNTS, **at))


@_proof(f"""WITH RECURSIVE {_MOUNTED} SELECT root, node, verb, {_JOIN(_JOIN('prefix', "coalesce(base, '')"), 'q.path')} AS path, array_to_string(list_append(ats, q.at), ',') AS ats FROM r JOIN n USING (node) JOIN q USING (node) WHERE literal AND (upto IS NULL OR q.at < upto)""")
def mounted_routes(spark, d):
    return _mounted(spark, d)[0].withColumn("ats", F.array_join("ats", ","))


@_proof(f"""WITH RECURSIVE {_MOUNTED} SELECT DISTINCT node, l.at AS at, CASE WHEN NOT literal THEN 'base-not-literal' WHEN cf IS NULL THEN 'child-unresolved' ELSE 'cycle' END AS note FROM r JOIN n USING (node) JOIN l USING (node) WHERE (upto IS NULL OR l.at < upto) AND (NOT literal OR cf IS NULL OR list_contains(above, child))
UNION SELECT node, q.at, 'base-not-literal' FROM r JOIN n USING (node) JOIN q USING (node) WHERE NOT literal AND (upto IS NULL OR q.at < upto)""")
def mount_notes(spark, d):
    return _mounted(spark, d)[1]


# --- schemas ---------------------------------------------------------------------------------------------------------
#: Parts are components, each with a reference to another one of its document, to itself, or none.
_NEXT = "CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN p_partkey WHEN 2 THEN p_partkey - 10 ELSE p_partkey + 5 * (p_size % 3 + 1) END"


@_proof(f"""WITH RECURSIVE c AS (SELECT p_partkey % 5 AS doc, 'P' || p_partkey AS name, p_size AS size, 'P' || ({_NEXT}) AS next FROM part), s AS (SELECT doc, name AS key, []::VARCHAR[] AS path, next FROM c),
r AS (SELECT doc, key, path, next, 0 AS depth FROM s UNION ALL SELECT r.doc, r.key, list_append(r.path, c.name), c.next, r.depth + 1 FROM r JOIN c ON c.doc = r.doc AND c.name = r.next WHERE NOT list_contains(r.path, r.next) AND r.depth < 40),
t AS (SELECT doc, key, path, next FROM r QUALIFY row_number() OVER (PARTITION BY doc, key ORDER BY depth DESC) = 1),
u AS (SELECT *, 1 + len(path) AS n, coalesce(list_contains(path, next), false) AS cyclic FROM t),
x AS (SELECT *, CASE WHEN n > 4 THEN 'max-depth-exceeded' WHEN next IS NOT NULL AND NOT cyclic THEN 'component-not-found' END AS reason FROM u)
SELECT doc, key, reason, CASE WHEN reason IS NULL THEN n ELSE 0 END AS objects, CASE WHEN reason IS NULL AND cyclic THEN next END AS cut FROM x""")
def inlined_schemas(spark, d):
    parts = table(spark, d, "part").selectExpr("p_partkey % 5 AS doc", "'P' || p_partkey AS name", f"concat('{{\"type\":\"object\",\"title\":\"', p_size, '\"', coalesce(concat(',\"properties\":{{\"next\":{{\"$ref\":\"#/components/schemas/P', {_NEXT}, '\"}}}}'), ''), '}}') AS schema")
    got = schemas.inlined(parts.withColumnRenamed("name", "key"), parts, most_depth=3)
    body = F.regexp_replace("schema", r',"\$defs":.*', "")
    return got.select("doc", "key", "reason", F.coalesce(F.regexp_count(body, F.lit('"object"')), F.lit(0)).cast("long").alias("objects"), F.nullif(F.regexp_extract("schema", r'"\$defs":\{"(\w+)"', 1), F.lit("")).alias("cut"))


# --- migrations ------------------------------------------------------------------------------------------------------
#: Parts are files of their brand's repository: tables created, columns and keys added later, nested types, comments and strings.
_DDL = """CASE p_partkey % 4 WHEN 0 THEN 'CREATE TABLE t' || p_size % 7 || ' (id uuid PRIMARY KEY, c' || p_partkey % 9 || ' numeric(10, 2) CHECK (f(g(h((1, 2), 3), 4)) > 0), note text DEFAULT ''a, b) -- '' , r uuid REFERENCES base' || CASE WHEN p_size % 2 = 0 THEN '(uid)' ELSE '' END || ', PRIMARY KEY (id, r), FOREIGN KEY (id) REFERENCES "up" ("k"));'
WHEN 1 THEN '-- CREATE TABLE no (a int);' || chr(10) || 'ALTER TABLE t' || p_size % 7 || ' ADD COLUMN IF NOT EXISTS a' || p_size || ' int;' WHEN 2 THEN '/* ( */ ALTER TABLE "t' || p_size % 7 || '" ADD CONSTRAINT f FOREIGN KEY (x' || p_partkey % 3 || ') REFERENCES late (z);' ELSE 'CREATE TABLE open (a int, (b' END"""
_PATH = "CASE WHEN p_size % 3 = 0 OR p_brand LIKE '%3' THEN 'app/db/changelog/' ELSE 'app/db/migration/' END || 'V' || p_size || '_' || p_partkey || '__x.' || CASE WHEN p_partkey % 11 = 0 THEN 'xml' ELSE 'sql' END"
_MIGRATED = f"""f AS (SELECT p_brand AS repo, {_PATH} AS path, p_partkey AS k, p_size AS s FROM part), g AS (SELECT *, CASE WHEN path LIKE '%/db/migration/%.sql' THEN 'flyway' WHEN path LIKE '%/db/changelog/%' THEN 'liquibase' END AS own FROM f),
u AS (SELECT repo, CASE WHEN bool_or(coalesce(own = 'flyway', false)) THEN 'flyway' WHEN bool_or(coalesce(own = 'liquibase', false)) THEN 'liquibase' ELSE 'none' END AS tool FROM g GROUP BY 1), h AS (SELECT g.* FROM g JOIN u USING (repo) WHERE own = tool),
q AS (SELECT repo, path, [s, k] AS version, 't' || s % 7 AS t, CASE k % 4 WHEN 0 THEN ['c' || k % 9, 'id', 'note', 'r'] WHEN 1 THEN ['a' || s] WHEN 2 THEN [] END AS columns,
CASE k % 4 WHEN 0 THEN ['r>base.' || CASE WHEN s % 2 = 0 THEN 'uid' ELSE '' END, 'id>up.k'] WHEN 1 THEN [] WHEN 2 THEN ['x' || k % 3 || '>late.z'] END AS fks FROM h WHERE path LIKE '%.sql' AND k % 4 < 3)"""


def _migrated(spark, d):
    files = table(spark, d, "part").selectExpr("p_brand AS repo", f"{_PATH} AS path", _DDL.replace("''a, b) -- ''", "\\'a, b) -- \\'") + " AS sql")
    return _migrations(files, "repo", "path", "sql")


def _named(keys):
    return F.array_join(F.transform(keys, lambda k: F.concat(k["column"], F.lit(">"), k["references_table"], F.lit("."), F.coalesce(k["references_column"], F.lit("")))), ",")


@_proof(f"""WITH {_MIGRATED} SELECT repo, tool, coalesce(string_agg(path, ',' ORDER BY path), '') AS files FROM u LEFT JOIN h USING (repo) GROUP BY 1, 2""")
def migration_repositories(spark, d):
    return _migrated(spark, d)[0].withColumn("files", F.array_join("files", ","))


@_proof(f"""WITH {_MIGRATED} SELECT repo, path, array_to_string(version, '.') AS version, t AS "table", array_to_string(columns, ',') AS columns, array_to_string(fks, ',') AS foreign_keys FROM q""")
def migration_files(spark, d):
    return _migrated(spark, d)[1].withColumns({"version": F.array_join("version", "."), "columns": F.array_join("columns", ","), "foreign_keys": _named("foreign_keys")})


@_proof(f"""WITH {_MIGRATED}, c AS (SELECT repo, t, c, min(version) AS v FROM (SELECT *, unnest(columns) AS c FROM q) GROUP BY 1, 2, 3), k AS (SELECT repo, t, x, min(v) AS v FROM (SELECT repo, t, unnest(fks) AS x, list_append(version, unnest(range(1, len(fks) + 1))) AS v FROM q) GROUP BY 1, 2, 3)
SELECT repo, t AS "table", (SELECT coalesce(string_agg(c, ',' ORDER BY v, c), '') FROM c WHERE c.repo = q.repo AND c.t = q.t) AS columns, (SELECT coalesce(string_agg(x, ',' ORDER BY v), '') FROM k WHERE k.repo = q.repo AND k.t = q.t) AS foreign_keys, count(*) AS files FROM q GROUP BY 1, 2""")
def schema_states(spark, d):
    rows = _schema_states(_migrated(spark, d)[1], "repo", "path")
    return rows.select("repo", "table", F.coalesce(F.array_join("columns", ","), F.lit("")).alias("columns"), F.coalesce(_named("foreign_keys"), F.lit("")).alias("foreign_keys"), F.size("files").cast("long").alias("files"))


# --- files of operations ---------------------------------------------------------------------------------------------
#: Parts are source files of their brand's repository; every repository has four operations.
_SOURCES = """SELECT p_brand AS repo, 'src/' || CASE WHEN p_size % 2 = 0 THEN 'routes/' ELSE '' END || 'widget' || p_size % 4 || '_' || p_partkey || '.py' AS path, CASE p_size % 5 WHEN 0 THEN 'def loadWidget' || p_size % 4 || '(a):' WHEN 1 THEN 'x = loadWidget' || p_size % 4 || '(1)  # def loadWidget9(' WHEN 2 THEN '@app.get("/API/widget' || p_size % 4 || '")' WHEN 3 THEN '// loadWidget0' ELSE '' END AS text FROM {parts}"""
_CONTEXT = """s AS (SELECT p_brand AS repo, 'src/' || CASE WHEN p_size % 2 = 0 THEN 'routes/' ELSE '' END || 'widget' || p_size % 4 || '_' || p_partkey || '.py' AS path, 'loadWidget' || p_size % 4 AS operation_id, p_size AS z, 'widget' || p_size % 4 AS w FROM part),
c AS (SELECT *, CAST(CASE z % 5 WHEN 0 THEN 240 WHEN 1 THEN 25 WHEN 2 THEN 135 ELSE 0 END + 80 + CASE WHEN z % 2 = 0 THEN 10 ELSE 0 END AS BIGINT) AS score, CAST(CASE WHEN z % 5 = 2 THEN 1 ELSE 0 END AS BIGINT) AS term_hits,
CASE z % 5 WHEN 0 THEN 'handler_declaration,' WHEN 1 THEN 'symbol_reference,' WHEN 2 THEN 'full_route_literal,http_method_registration,' ELSE '' END || 'filename_operation:' || w || ',filename_route:' || w AS signals FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY repo, operation_id ORDER BY score DESC, path) AS rank FROM c)"""


def _context(spark, d):
    part = _files(spark, d)
    operations = part.select(F.col("p_brand").alias("repo")).distinct().selectExpr("repo", "explode(sequence(0, 3)) AS k").selectExpr("repo", "'loadWidget' || k AS operation_id", "'GET' AS verb", "'/api/widget' || k || '/' AS path")
    return context.selected(context.scored(operations, spark.sql(_SOURCES, parts=part)))


@_proof(f"WITH {_CONTEXT} SELECT repo, operation_id, path, score, signals, term_hits, rank FROM k WHERE rank <= 4")
def context_files(spark, d):
    return _context(spark, d)[0].withColumns({"signals": F.array_join("signals", ","), "rank": F.col("rank").cast("long")}).drop("verb", "route")


@_proof(f"""WITH {_CONTEXT}, g AS (SELECT repo, operation_id, count(*) AS matched, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS gap, max(signals) FILTER (rank = 1) AS top FROM k GROUP BY 1, 2),
v AS (SELECT *, coalesce(gap < 30, false) AS ambiguous, CASE WHEN top LIKE 'handler%' THEN CASE WHEN coalesce(gap >= 30, true) THEN 'high' ELSE 'medium' END WHEN top LIKE 'full%' THEN 'medium' ELSE 'low' END AS confidence FROM g)
SELECT repo, operation_id, matched, CAST(gap AS VARCHAR) AS gap, ambiguous, confidence, concat_ws(',', CASE WHEN matched > 4 THEN 'ranked_candidates_truncated' END, CASE WHEN confidence = 'low' THEN 'no_confirmed_declaration' END, CASE WHEN ambiguous THEN 'ambiguous_top_scores' END, CASE WHEN top NOT LIKE 'handler%' THEN 'no_confirmed_handler_declaration' END) AS incomplete_reasons FROM v""")
def context_verdicts(spark, d):
    return _context(spark, d)[1].withColumns({"gap": F.col("gap").cast("string"), "incomplete_reasons": F.array_join("incomplete_reasons", ",")}).drop("verb", "route")


# --- routes over files -----------------------------------------------------------------------------------------------
#: Parts are modules with a router, which the application of their brand mounts.
_MODULE = """SELECT p_brand AS repo, 'pkg/m' || p_partkey || '.py' AS path, 'from fastapi import APIRouter' || chr(10) || CASE WHEN p_size % 7 = 0 THEN 'r = APIRouter()' || chr(10) ELSE '' END || 'r = APIRouter(prefix=' || CASE WHEN p_size % 11 = 0 THEN 'BASE' ELSE '"/p' || p_size || '"' END || ', tags=["a", "(b"])' || chr(10) ||
'@r.get(' || CASE WHEN p_size % 13 = 0 THEN 'f' ELSE '' END || '"/x/{{id}}")  # @r.get("/no")' || chr(10) || '@cached(1)' || chr(10) || 'async def f' || p_partkey || '(a=Depends(b)): pass' AS text FROM {parts}"""
_ENDS = "s AS (SELECT p_brand AS repo, p_partkey AS k, p_size AS z FROM part)"


def _fastapi(spark, d):
    part = _files(spark, d)
    line = F.concat(F.lit("from .m"), "p_partkey", F.lit(" import r as r"), "p_partkey", F.lit("\napp.include_router(r"), "p_partkey", F.lit(", prefix="), F.when(F.col("p_size") % 6 == 0, F.lit("V")).otherwise(F.concat(F.lit("'/v"), F.col("p_size") % 3, F.lit("/'"))), F.lit(")\n"))
    main = part.groupBy(F.col("p_brand").alias("repo")).agg(F.concat(F.lit("import fastapi\napp = fastapi.FastAPI()\n"), F.array_join(F.array_sort(F.collect_list(line)), "")).alias("text")).withColumn("path", F.lit("pkg/main.py"))
    return fastapi_routes(main.unionByName(spark.sql(_MODULE, parts=part)), "repo", "path", "text")


@_proof(f"""WITH {_ENDS} SELECT repo, CASE WHEN z % 6 = 0 THEN 'pkg.m' || k || '#r' ELSE 'pkg.main#app' END AS root, 'pkg.m' || k || '#r' AS router, 'GET' AS verb, CASE WHEN z % 6 = 0 THEN '' ELSE '/v' || z % 3 END || '/p' || z || '/x/{{id}}' AS path, 'f' || k AS function FROM s WHERE z % 7 > 0 AND z % 11 > 0 AND z % 13 > 0""")
def fastapi_composed(spark, d):
    return _fastapi(spark, d)[0]


@_proof(f"""WITH {_ENDS} SELECT repo, 'pkg.m' || k AS module, CASE WHEN z % 13 = 0 THEN 'route-path-not-literal' WHEN z % 7 = 0 THEN 'router-ambiguous' ELSE 'router-prefix-not-literal' END AS reason, 1 AS n FROM s WHERE z % 7 = 0 OR z % 11 = 0 OR z % 13 = 0
UNION ALL SELECT repo, 'pkg.main', 'mount-prefix-not-literal', count(*) FROM s WHERE z % 6 = 0 GROUP BY 1""")
def fastapi_unknowns(spark, d):
    return _fastapi(spark, d)[1].groupBy("repo", "module", "reason").agg(F.count("*").alias("n"))


# --- protocols -------------------------------------------------------------------------------------------------------
#: Parts are .proto files: a message within a message, a oneof, a service with streams; some are left open.
_PROTO = """SELECT 'f' || p_partkey AS path, CASE WHEN p_size % 4 > 0 THEN 'syntax = "proto3";' ELSE '' END || ' package p' || p_size || '; // message No {{ string a = 1; }}' || chr(10) || 'message M' || p_size % 9 || ' {{ string id = 1; message In {{ repeated int32 n = ' || (p_size + 2) || '; }} oneof one {{ In a = 4; map<string, In> b = 5; }} string t = 6 [default = "x {{ int32 q = 1;"]; }}' || chr(10) ||
CASE WHEN p_size % 5 = 0 THEN 'service S {{ rpc Do (' || CASE WHEN p_size % 2 = 0 THEN 'stream ' ELSE '' END || 'In) returns (stream M) {{ option (o) = {{ g: "/v" }}; }} }}' WHEN p_size % 5 = 1 THEN 'message Open {{ int32 z = 1;' ELSE '' END AS text FROM {parts}"""


def _files(spark, d):
    """Parts as the rows of many files, dealt before their texts are made."""
    return spread(table(spark, d, "part"), "p_partkey")


def _proto(spark, d, name):
    return protobuf(spark.sql(_PROTO, parts=_files(spark, d)), "path", "text")[name]


@_proof("""SELECT 'f' || p_partkey AS file, 'M' || p_size % 9 || CASE n WHEN 2 THEN '.In' ELSE '' END AS message, ['id', 'n', 'a', 'b', 't'][n] AS name, ['string', 'int32', 'In', 'map<string,In>', 'string'][n] AS type, CASE n WHEN 2 THEN 'repeated' END AS label, CAST([1, p_size + 2, 4, 5, 6][n] AS BIGINT) AS number, CASE WHEN n IN (3, 4) THEN 'one' END AS "oneof" FROM part, range(1, 6) t(n)""")
def proto_fields(spark, d):
    return _proto(spark, d, "fields")


@_proof("""SELECT 'f' || p_partkey AS file, 'S' AS service, 'Do' AS name, 'In' AS request_type, 'M' AS response_type, p_size % 2 = 0 AS client_streaming, true AS server_streaming FROM part WHERE p_size % 5 = 0""")
def proto_methods(spark, d):
    return _proto(spark, d, "methods")


@_proof("""SELECT 'f' || p_partkey AS file, 'PROTO_NESTED_DECLARATION_NOT_EXPANDED' AS code, 'message In' AS subject FROM part UNION ALL SELECT 'f' || p_partkey, 'PROTO_SYNTAX_UNRESOLVED', NULL FROM part WHERE p_size % 4 = 0 UNION ALL SELECT 'f' || p_partkey, 'PROTO_UNCLOSED_BLOCK', 'message Open' FROM part WHERE p_size % 5 = 1""")
def proto_warnings(spark, d):
    return _proto(spark, d, "warnings")


_GRAPHQL = """SELECT 'g' || p_partkey AS path, CASE WHEN p_size % 3 = 0 THEN 'schema {{ query: Root }}' ELSE '' END || chr(10) || '# type No {{ a: Int }}' || chr(10) || 'type ' || CASE WHEN p_size % 3 = 0 THEN 'Root' ELSE 'Query' END || ' @d(a: 1) {{ "a: b" item(id: ID!, f: F = {{a: 1}}): [P' || p_size || '!]! all: Int }}' || chr(10) || 'enum E {{ A B }} scalar D' || p_size || chr(10) || CASE WHEN p_size % 7 = 0 THEN 'type Open {{ a: Int' ELSE '' END AS text FROM {parts}"""


@_proof("""SELECT 'g' || p_partkey AS file, 'query' AS kind, ['item', 'all'][n] AS name, ['[P' || p_size || '!]!', 'Int'][n] AS type FROM part, range(1, 3) t(n)""")
def graphql_operations(spark, d):
    return graphql(spark.sql(_GRAPHQL, parts=_files(spark, d)), "path", "text")["operations"]


@_proof("""SELECT 'g' || p_partkey AS file, kind, name FROM (SELECT p_partkey, unnest(['type', 'enum', 'scalar']) AS kind, unnest([CASE WHEN p_size % 3 = 0 THEN 'Root' ELSE 'Query' END, 'E', 'D' || p_size]) AS name FROM part UNION ALL SELECT p_partkey, 'type', 'Open' FROM part WHERE p_size % 7 = 0)""")
def graphql_types(spark, d):
    return graphql(spark.sql(_GRAPHQL, parts=_files(spark, d)), "path", "text")["types"]
