"""Proof queries of framework extraction and field decisions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import decisions
from factloom.plans.proofs import _proof
from factloom.sources import frameworks
from factloom.sources.tables import durable, spread, table, tasks_for

_P = "regexp_replace(p_brand, '[^A-Za-z0-9]', '')"
_DP = "regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')"


def _texts(spark, d, text):
    # written once dealt: filters on the text would be moved before the deal, into the few tasks that read the file
    return durable(spread(table(spark, d, "part"), "p_partkey")).selectExpr("p_partkey", f"{text} AS text")


_SPRING = f"""'// @GetMapping("/no")\n@RestController /* @PostMapping */\n@RequestMapping("/api/' || p_size || '/")\npublic class ' || {_P} || 'Controller {{ @Operation(summary = "a (b)", operationId = "list' || p_partkey || '") @ApiResponses(@X(1)) @GetMapping\n List<A> l() {{}} @PostMapping(value = "http://x/' || p_size || '", produces = "j") void p() {{}} @Operation(summary="s") @DeleteMapping("/{{id}}") void d() {{}} }}'"""


@_proof(f"""SELECT p_partkey, {_DP} || 'Controller' AS class, verb, '/api/' || p_size || CASE verb WHEN 'GET' THEN '' WHEN 'POST' THEN '/http://x/' || p_size ELSE '/{{id}}' END AS path, CASE WHEN verb <> 'DELETE' THEN 'list' || p_partkey END AS operation_id FROM part, (SELECT unnest(['GET', 'POST', 'DELETE']) AS verb)""")
def spring_endpoints(spark, d):
    return frameworks.spring_endpoints(_texts(spark, d, _SPRING), "text")


@_proof(f"""SELECT p_partkey, {_DP} AS class, CASE WHEN p_size % 2 = 0 THEN 't' || p_size END AS "table", CASE WHEN p_size % 2 = 0 THEN 'explicit' END AS table_source, 'key' AS id_field, CASE WHEN p_size % 3 = 0 THEN 'UUID' ELSE 'Long' END AS id_type, p_size % 3 = 0 AS id_is_uuid FROM part WHERE p_size % 5 > 0""")
def spring_entities(spark, d):
    text = f"""IF(p_size % 5 = 0, '// ', '') || '@Entity ' || IF(p_size % 2 = 0, '@Table(name = "t' || p_size || '") ', '') || 'public class ' || {_P} || ' {{ private String a; @Id @GeneratedValue(strategy = X.Y) private ' || IF(p_size % 3 = 0, 'UUID', 'Long') || ' key; }}'"""
    return frameworks.spring_entities(_texts(spark, d, text), "text")


@_proof("""SELECT p_partkey, 'Kind' || p_size AS enum, 'A_1,B' || p_size || ',C' AS constants FROM part WHERE p_partkey % 3 > 0""")
def spring_enums(spark, d):
    text = """IF(p_partkey % 3 = 0, 'class X {}', 'public enum Kind' || p_size || ' {\n  A_1("x", 2), // D,\n  B' || p_size || ', C;\n  private int v;\n}')"""
    return frameworks.spring_enums(_texts(spark, d, text), "text").withColumn("constants", F.array_join("constants", ","))


@_proof("""SELECT p_partkey, 'configurePathMatch' AS kind, '/p' || p_size AS value FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'context-path', '/c' FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 'paths-to-match', '/d/**' FROM part""")
def prefix_signals(spark, d):
    text = """IF(p_size % 2 = 0, 'void configurePathMatch(C c) { c.addPathPrefix( "/p' || p_size || '", x); }', 'c.addPathPrefix("/q")') || IF(p_size % 3 = 0, '\nserver.servlet.context-path=/c', '') || '\n  paths-to-match: "/d/**"'"""
    return frameworks.prefix_signals(_texts(spark, d, text), "text")


_FAST = """'router = APIRouter(prefix="/items", tags=["a"])\ninner_router = APIRouter(dependencies=[Depends(f(1))], prefix=\\'/in' || p_size || '\\')\n@router.get("/", response_model=P, dependencies=[Depends(g())])\nasync def read_all(x: int):\n  pass\n@inner_router.post(\n  "/{id}/' || p_partkey || '"\n)\ndef make_' || p_size || '(a):\n  pass\n@router.put(path)\ndef no(): pass\n@other.delete("x")\ndef gone(): pass'"""


@_proof("""SELECT p_partkey, 'router' AS router, 'GET' AS verb, '/items' AS path, 'read_all' AS function FROM part UNION ALL SELECT p_partkey, 'inner_router', 'POST', '/in' || p_size || '/{id}/' || p_partkey, 'make_' || p_size FROM part UNION ALL SELECT p_partkey, 'other', 'DELETE', '/x', 'gone' FROM part""")
def fastapi_endpoints(spark, d):
    return frameworks.fastapi_endpoints(_texts(spark, d, _FAST), "text")


@_proof(f"""SELECT p_partkey, {_DP} AS class, 'table' AS kind, CASE WHEN p_size % 2 = 0 THEN 'named_' || p_size ELSE lower({_DP}) END AS "table", CASE WHEN p_size % 2 = 0 THEN 'explicit' ELSE 'inferred' END AS table_source, 'key' AS id_field FROM part
UNION ALL SELECT p_partkey, 'ItemPublic', 'dto', NULL, NULL, NULL FROM part UNION ALL SELECT p_partkey, 'Last', 'table', 'last', 'inferred', NULL FROM part""")
def fastapi_classes(spark, d):
    text = f"""'import x\nclass ' || {_P} || '(Base, table=True):\n' || IF(p_size % 2 = 0, '    __tablename__: str = "named_' || p_size || '"\n', '') || '    key: uuid.UUID = Field(default=1, primary_key=True)\nclass ItemPublic(ItemBase):\n    id: int\nclass Settings(BaseSettings):\n    a: int\nclass Last(Base, table = True):\n    a: int = 3\n'"""
    return frameworks.fastapi_classes(_texts(spark, d, text), "text")


_MANY = "(VALUES ('index', 'GET', ''), ('create', 'POST', ''), ('new', 'GET', '/new'), ('edit', 'GET', '/{id}/edit'), ('show', 'GET', '/{id}'), ('update', 'PATCH', '/{id}'), ('update', 'PUT', '/{id}'), ('destroy', 'DELETE', '/{id}')) t(action, method, below)"


@_proof(f"""SELECT p_partkey, 'resources' AS kind, 'u' || p_size AS name, action, method, '/u' || p_size || below AS path FROM part, {_MANY} WHERE CASE p_size % 3 WHEN 0 THEN action IN ('index', 'show') WHEN 1 THEN action <> 'destroy' ELSE true END
UNION ALL SELECT p_partkey, 'resource', 'profile', 'show', 'GET', '/profile' FROM part UNION ALL SELECT p_partkey, 'route', NULL, 'c#a', 'GET', '/x/{{id}}/' || p_size FROM part UNION ALL SELECT p_partkey, 'route', NULL, NULL, 'POST', '/y' FROM part""")
def rails_actions(spark, d):
    text = """'Rails.routes do\n  resources :u' || p_size || CASE p_size % 3 WHEN 0 THEN ', only: [:index, :show]' WHEN 1 THEN ', except: :destroy' ELSE '' END || '\n  resource :profile, only: :show\n  get "/x/:id/' || p_size || '", to: "c#a"\n  post \\'y\\'\n  # resources :no\nend'"""
    return frameworks.rails_actions(_texts(spark, d, text), "text")


# --- decisions -------------------------------------------------------------------------------------------------------
_ID = "l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey"
_RESULTS = """SELECT {id} AS id, {at} AS kind, CASE WHEN l_suppkey % 2 = 0 THEN 'verb' ELSE 'path' END AS drift, CASE WHEN l_suppkey % 5 > 0 THEN 'op' || l_partkey END AS operation_id, l_suppkey % 13 = 0 AS synthesized, 'GET' AS verb, '/api/x' || l_suppkey % 4 AS path,
'PUT' AS scan_verb, CASE l_suppkey % 3 WHEN 0 THEN '/api/x' WHEN 1 THEN '/x' ELSE '/y' END || l_suppkey % 4 AS scan_path, CASE WHEN l_suppkey % 7 = 0 THEN 'because' END AS cause, CASE WHEN l_linestatus = 'F' THEN 'schema' END AS request, CASE WHEN l_tax > 0.04 THEN 'too-big' END AS request_cause, l_discount > 0.05 AS project, l_suppkey, l_partkey,
's' || l_suppkey AS source_ref, CASE WHEN l_suppkey % 17 > 0 THEN 'o1' ELSE '' END AS openapi_ref{also} FROM {t}"""
_KINDS = ["matched", "adopted", "drift", "missing", "ambiguous", "unresolved"]
_R = "r AS (" + _RESULTS.format(id=_ID, also="", at="['matched', 'adopted', 'drift', 'missing', 'ambiguous', 'unresolved'][CAST(l_partkey % 6 + 1 AS INT)]", t="lineitem") + ")"
_LOST = "legacy-result-does-not-retain-none-vs-skipped-media-type"
_ROOT = "root-security-inheritance-not-retained-by-legacy-result"
_DECIDED = f"""{_R}, x AS (SELECT *, kind IN ('matched', 'adopted') AS safe, scan_path = path AS exact, scan_path = path OR '/api' || scan_path = path AS fits, kind = 'drift' AND drift = 'verb' AS vd, CASE WHEN NOT synthesized THEN operation_id END AS own, coalesce(cause, 'unresolved') AS why,
CASE WHEN openapi_ref <> '' THEN 'openapi:' || openapi_ref ELSE '' END AS eo, 'scan:' || source_ref AS es FROM r), z AS (SELECT *, concat_ws(',', es, nullif(eo, '')) AS eb FROM x), y AS (
SELECT id, 'operation.identity' AS field, CASE WHEN safe OR (kind = 'drift' AND own IS NOT NULL) THEN 'resolved' WHEN kind = 'ambiguous' THEN 'conflict' ELSE 'unknown' END AS state, operation_id AS v, CASE WHEN kind IN ('missing', 'unresolved') THEN own WHEN kind = 'ambiguous' THEN 'a' || l_partkey || ',b' END AS candidates,
  CASE kind WHEN 'matched' THEN 'scan+openapi' WHEN 'adopted' THEN 'openapi' WHEN 'ambiguous' THEN 'conflict' WHEN 'drift' THEN CASE WHEN own IS NULL THEN 'none' ELSE 'scan+openapi' END ELSE CASE WHEN own IS NULL THEN 'none' ELSE 'scan' END END AS authority,
  CASE WHEN kind = 'adopted' THEN eo WHEN kind = 'missing' OR (kind = 'unresolved' AND own IS NOT NULL) THEN es ELSE eb END AS evidence,
  CASE kind WHEN 'matched' THEN 'operation-id-match' WHEN 'adopted' THEN 'single-route-adoption' WHEN 'drift' THEN CASE WHEN own IS NULL THEN 'operation-id-not-retained-in-reconciliation-result' ELSE 'operation-id-anchor' END WHEN 'missing' THEN 'operation-id-missing-from-openapi' WHEN 'ambiguous' THEN 'multiple-route-candidates' ELSE why END AS reason FROM z
UNION ALL SELECT id, 'http.method', CASE WHEN vd THEN 'conflict' WHEN kind IN ('missing', 'unresolved') THEN 'unknown' ELSE 'resolved' END, CASE WHEN safe THEN verb ELSE scan_verb END, CASE WHEN vd THEN 'PUT,GET' WHEN kind IN ('missing', 'unresolved') THEN 'PUT' END,
  CASE WHEN vd THEN 'conflict' WHEN kind IN ('missing', 'unresolved') THEN 'scan' ELSE 'scan+openapi' END, CASE WHEN kind IN ('missing', 'unresolved') THEN es ELSE eb END,
  CASE WHEN vd THEN 'method-drift' ELSE CASE kind WHEN 'adopted' THEN 'single-route-match' WHEN 'ambiguous' THEN 'route-index-is-method-scoped' WHEN 'missing' THEN 'openapi-operation-missing' WHEN 'unresolved' THEN why ELSE 'method-match' END END FROM z
UNION ALL SELECT id, 'http.path', CASE WHEN safe OR (vd AND fits) THEN 'resolved' WHEN kind IN ('missing', 'unresolved') THEN 'unknown' ELSE 'conflict' END, path,
  CASE WHEN safe OR (vd AND fits) THEN NULL WHEN kind IN ('missing', 'unresolved') THEN scan_path WHEN kind = 'ambiguous' THEN scan_path || ',/q' || CASE WHEN scan_path = path THEN '' ELSE ',' || path END ELSE CASE WHEN exact THEN path ELSE scan_path || ',' || path END END,
  CASE WHEN safe OR (vd AND fits) THEN 'reconciled' WHEN kind IN ('missing', 'unresolved') THEN 'scan' ELSE 'conflict' END, CASE WHEN kind IN ('missing', 'unresolved') THEN es ELSE eb END,
  CASE WHEN safe OR (vd AND fits) THEN CASE WHEN exact THEN 'exact-' ELSE 'prefix-' END || CASE WHEN kind = 'adopted' THEN 'route-adoption' WHEN exact THEN 'path' ELSE 'reconciled' END WHEN vd THEN 'path-not-proven' WHEN kind = 'drift' THEN 'path-drift' WHEN kind = 'missing' THEN 'openapi-operation-missing' WHEN kind = 'ambiguous' THEN 'multiple-route-candidates' ELSE why END FROM z
UNION ALL SELECT id, f, CASE WHEN s IS NOT NULL THEN 'resolved' WHEN c IS NULL AND NOT project THEN 'skipped' ELSE 'unknown' END, s, NULL, CASE WHEN s IS NULL AND c IS NULL AND project AND NOT safe THEN 'none' ELSE 'openapi' END, CASE WHEN s IS NULL AND c IS NULL AND project AND NOT safe THEN eb ELSE eo END,
  CASE WHEN s IS NOT NULL THEN 'projected-from-safely-reconciled-openapi' WHEN c IS NOT NULL THEN c WHEN NOT project THEN 'schema-projection-disabled' WHEN safe THEN '{_LOST}' ELSE 'endpoint-not-safely-reconciled' END
FROM (SELECT *, 'api.request.schema' AS f, request AS s, request_cause AS c FROM z UNION ALL SELECT *, 'api.response.schema', NULL, NULL FROM z UNION ALL SELECT *, 'api.error.schema', NULL, 'cut' FROM z)
UNION ALL SELECT id, 'api.security.declared', CASE WHEN l_suppkey % 4 > 1 THEN 'resolved' ELSE 'unknown' END, CASE WHEN l_suppkey % 4 = 2 THEN 'bearer,key' ELSE '' END, NULL, CASE WHEN l_suppkey % 4 = 0 AND NOT safe THEN 'none' ELSE 'openapi' END, CASE WHEN l_suppkey % 4 = 0 AND NOT safe THEN eb ELSE eo END,
  CASE l_suppkey % 4 WHEN 3 THEN 'operation-explicitly-declared-public' WHEN 2 THEN 'operation-security-requirements-declared' WHEN 1 THEN 'unreadable' ELSE CASE WHEN safe THEN '{_ROOT}' ELSE 'endpoint-not-safely-reconciled' END END FROM z),
d AS (SELECT id, field, state, CASE WHEN state = 'resolved' THEN v END AS value, candidates, authority, evidence, reason FROM y)"""


def _lines(spark, d):
    # a result's columns are made of these few, after they are dealt
    return table(spark, d, "lineitem").selectExpr(f"{_ID} AS id", "l_partkey", "l_suppkey", "l_linestatus", "l_tax", "l_discount")


def _results(spark, lines, also=""):
    kinds = "array(" + ", ".join(f"'{k}'" for k in _KINDS) + ")"
    rows = spark.sql(_RESULTS.format(id="id", also=also, at=f"get({kinds}, CAST(l_partkey % 6 AS INT))", t="{lines}"), lines=lines)
    return rows.selectExpr("*", "CAST(NULL AS STRING) AS response", "CAST(NULL AS STRING) AS response_cause", "CAST(NULL AS STRING) AS error", "'cut' AS error_cause",
                           "IF(kind = 'ambiguous', array(named_struct('operation_id', 'a' || l_partkey, 'path', '/q'), named_struct('operation_id', 'b', 'path', path), named_struct('operation_id', 'b', 'path', NULL)), NULL) AS candidates",
                           "CASE l_suppkey % 4 WHEN 3 THEN CAST(array() AS array<string>) WHEN 2 THEN array('bearer', 'key') END AS security", "IF(l_suppkey % 4 = 1, 'unreadable', NULL) AS security_cause")


def _decided(spark, d, dealt=False):
    lines = _lines(spark, d)
    rows = _results(spark, spread(lines, "id") if dealt else lines)
    return rows, decisions.decided(rows, "id", F.lit("/api"), F.col("project"))


def _flat(made):
    return made.withColumns({"candidates": F.array_join("candidates", ","), "evidence": F.array_join(F.transform("evidence", lambda e: F.concat(e["role"], F.lit(":"), e["ref"])), ",")})


@_proof(f"WITH {_DECIDED} SELECT * FROM d")
def field_decisions(spark, d):
    return _flat(_decided(spark, d)[1])


@_proof(f"WITH {_DECIDED} SELECT state, field, count(*) AS n FROM d GROUP BY 1, 2")
def decision_counts(spark, d):
    return _decided(spark, d)[1].groupBy("state", "field").agg(F.count("*").alias("n"))


_KNOWN = """SELECT {distinct}id, CASE l_suppkey % 12 WHEN 0 THEN 'unknown' WHEN 4 THEN 'inherit' WHEN 3 THEN 'unknown' ELSE 'operation' END AS security_state, CASE WHEN l_suppkey % 3 = 0 THEN 'malformed-operation-security' END AS security_reason,
CASE l_suppkey % 5 WHEN 0 THEN 'absent' WHEN 1 THEN 'skipped' WHEN 2 THEN 'present' WHEN 3 THEN 'unknown' END AS request_state, CASE WHEN l_suppkey % 2 = 0 THEN 'request-why' END AS request_reason, 'absent' AS response_state, 'success-responses-absent' AS response_reason, 'present' AS error_state, NULL AS error_reason FROM {r} WHERE l_suppkey % 12 <> 8"""


@_proof(f"""WITH {_DECIDED}, k AS ({_KNOWN.format(distinct="DISTINCT ", r="r")}), u AS (SELECT 'op' || p_partkey AS o FROM part WHERE p_size % 4 = 0),
n AS (SELECT d.*, k.id IS NOT NULL AS there, security_state AS s, security_reason AS sr, CASE field WHEN 'api.request.schema' THEN request_state WHEN 'api.response.schema' THEN response_state WHEN 'api.error.schema' THEN error_state END AS ps, CASE field WHEN 'api.request.schema' THEN request_reason WHEN 'api.response.schema' THEN response_reason END AS pr,
  field = 'operation.identity' AND state = 'resolved' AND value IN (FROM u) AS clash, d.reason = '{_LOST}' AND k.id IS NOT NULL AS lost, d.reason = '{_ROOT}' AS o FROM d LEFT JOIN k USING (id)),
m AS (SELECT *, field = 'api.security.declared' AND coalesce(s = 'unknown', false) AS bad FROM n),
c AS (SELECT *, CASE WHEN lost AND ps IN ('absent', 'skipped') THEN ps WHEN lost AND ps IS NOT NULL THEN 'unknown' WHEN bad THEN 'unknown' WHEN clash THEN 'conflict' WHEN o AND s = 'inherit' THEN 'resolved' WHEN o THEN 'unknown' END AS ns,
  CASE WHEN lost AND ps IN ('absent', 'skipped') THEN pr WHEN lost AND ps = 'present' THEN 'openapi-schema-present-but-legacy-result-did-not-project' WHEN lost AND ps IS NOT NULL THEN coalesce(pr, 'openapi-schema-presence-unknown') WHEN bad THEN sr WHEN clash THEN 'duplicate-openapi-operation-id'
    WHEN o AND s IS NULL THEN 'operation-security-context-missing' WHEN o AND s = 'operation' THEN 'operation-security-present-but-legacy-result-did-not-project' WHEN o THEN 'inherited-document-security' END AS nr FROM m)
SELECT id, field, coalesce(ns, state) AS state, CASE WHEN ns IS NULL THEN value WHEN ns = 'resolved' THEN 'root' END AS value, CASE WHEN ns IS NULL THEN candidates END AS candidates, CASE WHEN ns IS NULL THEN authority WHEN ns = 'conflict' THEN 'conflict' ELSE 'openapi' END AS authority,
CASE WHEN ns IS NULL THEN evidence ELSE 'openapi:o1' END AS evidence, CASE WHEN ns IS NULL THEN reason ELSE nr END AS reason FROM c""")
def context_decisions(spark, d):
    lines = _lines(spark, d)
    n = tasks_for(lines, 1 << 20)
    # the narrow lines are dealt by id, once for their results and once for the operations: the first of a key is taken where it lies
    known = spark.sql(_KNOWN.format(distinct="", r="{lines}"), lines=lines.select("id", "l_suppkey").repartition(n, "id"))
    twice = table(spark, d, "part").where("p_size % 4 = 0").selectExpr("'op' || p_partkey AS operation_id")
    told = decisions.attached(lines.repartition(n, "id"), "id", decisions.identities(_results(spark, lines), "id"), twice, known, n)
    made = decisions.decided(_results(spark, told, also=", _o, _shared"), "id", F.lit("/api"), F.col("project"), documented=True)
    root = F.struct(F.lit("resolved").alias("state"), F.lit("root").alias("value"), F.lit(None).cast("string").alias("reason"))
    return _flat(decisions.narrowed(made, "id", F.lit("o1"), root))


@_proof("""SELECT p_brand, omission, count(*) AS operations FROM (SELECT p_brand, unnest([CASE WHEN p_size % 2 = 0 THEN 'summaries' END, CASE WHEN p_size % 3 = 0 THEN 'tags' END, CASE WHEN p_size % 5 = 0 THEN 'security' END]) AS omission FROM part) WHERE omission IS NOT NULL GROUP BY 1, 2""")
def export_omissions(spark, d):
    return decisions.omissions(table(spark, d, "part"), "p_brand", {"summaries": F.expr("p_size % 2 = 0"), "tags": F.expr("IF(p_size % 3 = 0, true, NULL)"), "security": F.expr("p_size % 5 = 0")})


@_proof("""SELECT p_partkey, blockers = '' AS ready, blockers FROM (SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 4 <> 0 THEN 'secret-leaks' END, CASE WHEN p_size % 6 = 0 THEN 'orphans' END, CASE WHEN p_size % 8 < 4 THEN 'adversarial-not-ready' END) AS blockers FROM part)""")
def security_closeout(spark, d):
    state = decisions.closeout({"secret-leaks": F.expr("p_size % 4"), "orphans": F.expr("IF(p_size % 6 = 0, NULL, 0)")}, {"adversarial-not-ready": F.expr("p_size % 8 >= 4")})
    return table(spark, d, "part").select("p_partkey", state.alias("s")).select("p_partkey", "s.*")


@_proof("""SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS complete, CAST(CASE WHEN bool_and(l_returnflag <> 'R') THEN count(*) FILTER (l_returnflag = 'A') ELSE 0 END AS BIGINT) AS edges, count(*) FILTER (l_returnflag = 'R') AS open FROM lineitem GROUP BY 1""")
def snapshot_graphs(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "CASE l_returnflag WHEN 'A' THEN 'resolved' WHEN 'N' THEN 'bare' END AS status")
    return decisions.snapshot_graphs(rows, "l_orderkey")
