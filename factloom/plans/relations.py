"""Proof queries of the relational operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import collisions, diff, evidence, graph, logs, ownership, paths, routes, trust
from factloom.plans.proofs import NOW, TERMS, _MATCHED, _part_facts, _proof
from factloom.sources.tables import table


# --- scoring ---------------------------------------------------------------------------------------------------------
_SCORED = f"{_MATCHED}, g AS (SELECT module, CAST(sum(weight) AS BIGINT) AS score FROM k WHERE r <= 5 GROUP BY module)"
_CASE = "CASE WHEN {0} >= 10 THEN 'collision' WHEN {0} > 0 THEN 'adjacent' ELSE 'greenfield' END"


@_proof(f"WITH {_SCORED}, a AS (SELECT DISTINCT p_brand AS module FROM part) SELECT a.module, coalesce(score, 0) AS score, {_CASE.format('coalesce(score, 0)')} AS verdict FROM a LEFT JOIN g USING (module)")
def module_verdicts(spark, d):
    facts = _part_facts(spark, d)
    return evidence.module_verdicts(evidence.scores(facts, TERMS), facts)


@_proof(f"WITH {_SCORED} SELECT {_CASE.format('coalesce(max(score), 0)')} AS verdict FROM g")
def scan_verdict(spark, d):
    return evidence.overall_verdict(evidence.scores(_part_facts(spark, d), TERMS))


@_proof("""WITH u AS (SELECT 'priority' AS param, o_orderpriority AS value FROM orders UNION ALL SELECT 'status', nullif(o_orderstatus, 'P') FROM orders), n AS (SELECT param, value, count(*) AS records FROM u WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT *, (SELECT count(*) FROM orders) AS total, row_number() OVER (PARTITION BY param ORDER BY records DESC, value) AS rank FROM n""")
def parameter_frequencies(spark, d):
    orders = table(spark, d, "orders").withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return evidence.frequencies(orders, {"priority": "o_orderpriority", "status": "status"})


_AUDIT = "SELECT o_orderkey AS handle, o_orderstatus = 'P' AS revoked, count(l_linenumber) AS snapshots, max(l_shipdate) AS last FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1, 2"


def _handles(spark, d):
    handles = table(spark, d, "orders").selectExpr("o_orderkey AS handle", "o_orderstatus = 'P' AS revoked", "o_orderpriority AS resource_type")
    taken = table(spark, d, "lineitem").selectExpr("l_orderkey AS handle", "l_linenumber AS snapshot_id", "l_shipdate AS recorded_at")
    return evidence.handle_audit(handles, taken, F.array(F.lit("1-URGENT"), F.lit("5-LOW")))


@_proof(_AUDIT)
def handles_of_types(spark, d):
    return _handles(spark, d)


@_proof(f"SELECT count(*) AS handles, count(*) FILTER (revoked) AS revoked, count(*) FILTER (snapshots = 0) AS never, CAST(coalesce(sum(snapshots), 0) AS BIGINT) AS snapshots FROM ({_AUDIT})")
def handles_summary(spark, d):
    return evidence.audit_summary(_handles(spark, d))


_RECEIPTS = "r AS (SELECT event_type AS contract, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'v' || event_id % 3 END AS contract_ref, 'op' || user_id % 4 AS operation, list_filter(['unsupported', 'type', 'range'], lambda x: length(x) > event_id % 12) AS v, event_id % 7 <> 0 AS signed FROM events), c AS (SELECT DISTINCT event_type AS contract, 'v1' AS current_ref FROM events)"


def _receipts(spark, d):
    e = table(spark, d, "events")
    rows = e.selectExpr("event_type AS contract", "IF(event_id % 5 = 0, NULL, 'v' || event_id % 3) AS contract_ref", "'op' || user_id % 4 AS operation", "filter(array('unsupported', 'type', 'range'), x -> length(x) > event_id % 12) AS violations", "event_id % 7 <> 0 AS signed")
    return rows, e.selectExpr("event_type AS contract", "'v1' AS current_ref").distinct()


@_proof(f"WITH {_RECEIPTS} SELECT contract, count(*) FILTER (coalesce(contract_ref = current_ref, false)) AS matched, count(*) FILTER (NOT coalesce(contract_ref = current_ref, false)) AS stale, CAST(sum(len(list_filter(v, lambda x: x = 'unsupported'))) AS BIGINT) AS unsupported, CAST(sum(len(list_filter(v, lambda x: x <> 'unsupported'))) AS BIGINT) AS violations FROM r JOIN c USING (contract) WHERE signed GROUP BY 1")
def receipts_by_contract(spark, d):
    return evidence.receipts(*_receipts(spark, d), F.col("signed"))


@_proof(f"WITH {_RECEIPTS} SELECT contract, operation, count(*) AS n FROM (SELECT contract, operation, unnest(v) FROM r JOIN c USING (contract) WHERE contract_ref = current_ref) GROUP BY 1, 2")
def receipts_by_operation(spark, d):
    return evidence.operation_violations(*_receipts(spark, d))


_IMPACT = """e AS (SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target, CASE l_linenumber % 3 WHEN 0 THEN 'derives_from' WHEN 1 THEN 'fk_references' ELSE 'contains' END AS relation FROM lineitem),
o AS (SELECT 'p' || p_partkey AS node, p_brand AS feature FROM part UNION ALL SELECT 's' || s_suppkey, 'Brand#' || s_nationkey FROM supplier)"""


@_proof(f"""WITH {_IMPACT}, x AS (SELECT target AS subject, source AS node, relation FROM e WHERE relation <> 'contains' UNION ALL SELECT source, target, relation FROM e WHERE relation = 'fk_references')
SELECT DISTINCT subject, relation, feature FROM x JOIN o USING (node) WHERE subject IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0) AND feature <> 'Brand#1'""")
def outbound_impacts(spark, d):
    edges = table(spark, d, "lineitem").selectExpr("'p' || l_partkey AS source", "'s' || l_suppkey AS target", "CASE l_linenumber % 3 WHEN 0 THEN 'derives_from' WHEN 1 THEN 'fk_references' ELSE 'contains' END AS relation")
    owners = table(spark, d, "part").selectExpr("'p' || p_partkey AS node", "p_brand AS feature").unionByName(table(spark, d, "supplier").selectExpr("'s' || s_suppkey AS node", "'Brand#' || s_nationkey AS feature"))
    return evidence.outbound(table(spark, d, "supplier").where("s_acctbal > 0").selectExpr("'s' || s_suppkey AS subject"), edges, owners, "Brand#1")


@_proof("""WITH g AS (SELECT l_partkey AS change_key, l_suppkey AS downstream_feature, arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) AS mode FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 10 GROUP BY 1, 2)
SELECT DISTINCT l_partkey AS change_key, l_suppkey AS downstream_feature, mode FROM lineitem LEFT JOIN g ON change_key = l_partkey AND downstream_feature = l_suppkey""")
def disposition_modes(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_partkey AS change_key", "l_suppkey AS downstream_feature", "l_returnflag AS mode", "l_orderkey * 10 + l_linenumber AS ordinal", "l_linestatus = 'O' AND l_quantity > 10 AS active")
    return evidence.dispositions(rows.select("change_key", "downstream_feature").distinct(), rows, F.col("active"))


@_proof("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey = 3 AND l_partkey % 10 <> 3")
def inbound_migrations(spark, d):
    given = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_partkey", "IF(l_returnflag = 'R', 'migrate', 'waive') AS mode", "CAST(l_suppkey AS STRING) AS downstream_feature", "CAST(l_partkey % 10 AS STRING) AS feature")
    return evidence.inbound(given, "3").select("l_orderkey", "l_partkey")


@_proof("SELECT l_partkey AS feature, count(*) AS n FROM lineitem WHERE l_suppkey = 2 GROUP BY 1")
def downstream_dependents(spark, d):
    return evidence.dependents(table(spark, d, "lineitem").selectExpr("l_partkey AS feature", "l_suppkey AS source_feature"), 2)


@_proof("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END, p_size, p_name, p_partkey) AS ordinal FROM part")
def traversal_order(spark, d):
    section = F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_type") == "STANDARD", 1).otherwise(2)
    return evidence.in_order(table(spark, d, "part"), "p_brand", section, F.col("p_size"), F.col("p_name"), F.col("p_partkey")).select("p_partkey", F.col("ordinal").cast("long").alias("ordinal"))


# --- collisions and catalogs -----------------------------------------------------------------------------------------
@_proof("SELECT a.p_brand, a.p_partkey, a.p_name, b.p_brand AS other_feature, min(b.p_partkey) AS other_ordinal FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_type = b.p_type AND a.p_brand <> b.p_brand GROUP BY 1, 2, 3, 4")
def resource_collisions(spark, d):
    part = table(spark, d, "part").withColumn("cls", F.concat_ws("|", "p_name", "p_type"))
    out = collisions.resources(part, "p_brand", "cls", "p_partkey")
    return out.select("p_brand", "p_partkey", F.split("cls", r"\|")[0].alias("p_name"), "other_feature", "other_ordinal")


_TABLES = "t AS (SELECT p_brand, p_partkey, CASE WHEN p_size = 7 THEN '' ELSE lower(p_name || p_size) END AS t, p_partkey % 2 = 0 AS explicit FROM part)"


@_proof(f"""WITH {_TABLES}, f AS (SELECT t, p_brand AS other_feature, min(p_partkey) AS other_ordinal FROM t WHERE t <> '' GROUP BY 1, 2)
SELECT t.p_brand, t.p_partkey, t.t AS "table", other_feature, other_ordinal, CASE WHEN explicit AND other_ordinal % 2 = 0 THEN 'high' ELSE 'low' END AS confidence FROM t JOIN f USING (t) WHERE p_brand <> other_feature""")
def table_collisions(spark, d):
    part = table(spark, d, "part").withColumn("t", F.expr("IF(p_size = 7, '', upper(p_name || p_size))"))
    return collisions.tables(part, "p_brand", "t", "p_partkey", F.col("p_partkey") % 2 == 0)


_IDS = "o AS (SELECT DISTINCT o_custkey % 40 AS f, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 500 END AS id FROM orders)"


@_proof(f"WITH {_IDS} SELECT a.f, a.id, b.f AS other_feature FROM o a JOIN o b ON a.id = b.id AND a.f <> b.f")
def operation_collisions(spark, d):
    return collisions.operations(table(spark, d, "orders").selectExpr("o_custkey % 40 AS f", "IF(o_orderkey % 9 = 0, NULL, o_orderkey % 500) AS id"), "f", "id")


def _fks(spark, d):
    fks = table(spark, d, "lineitem").selectExpr("'P' || l_partkey AS child", "'S' || l_suppkey AS parent").distinct()
    both = table(spark, d, "part").selectExpr("'p' || p_partkey AS table", "p_brand AS feature", "p_partkey AS ordinal").unionByName(table(spark, d, "supplier").selectExpr("'s' || s_suppkey AS table", "'nation' || s_nationkey AS feature", "s_suppkey AS ordinal"))
    return fks, both.where("ordinal % 3 = 0"), both.where("ordinal % 3 = 1")


_FKS = """k AS (SELECT DISTINCT 'P' || l_partkey AS child, 'S' || l_suppkey AS parent FROM lineitem), b AS (SELECT 'p' || p_partkey AS t, p_brand AS feature, p_partkey AS n FROM part UNION ALL SELECT 's' || s_suppkey, 'nation' || s_nationkey, s_suppkey FROM supplier),
o AS (SELECT t FROM b WHERE n % 3 = 0), x AS (SELECT t, feature FROM b WHERE n % 3 = 1)"""


@_proof(f"""WITH {_FKS} SELECT child, parent, 'references' AS relation, feature FROM k JOIN o ON o.t = lower(child) JOIN x ON x.t = lower(parent)
UNION ALL SELECT child, parent, 'referenced_by', feature FROM k JOIN o ON o.t = lower(parent) JOIN x ON x.t = lower(child)""")
def fk_between_features(spark, d):
    return collisions.fk_edges(*_fks(spark, d))


@_proof(f"""WITH {_FKS}, y AS (SELECT child, parent, lower(child) IN (FROM o) AS co, lower(parent) IN (FROM o) AS po, lower(child) IN (SELECT t FROM x) AS cx, lower(parent) IN (SELECT t FROM x) AS px FROM k)
SELECT child, parent, CASE WHEN co AND NOT po AND NOT px THEN parent ELSE child END AS unknown FROM y WHERE (co AND NOT po AND NOT px) OR (po AND NOT co AND NOT cx)""")
def fk_unattributed(spark, d):
    return collisions.fk_unknown(*_fks(spark, d))


def _catalog(spark, d):
    lines = table(spark, d, "lineitem")
    constraints = lines.selectExpr("'c' || l_orderkey AS constraint_name", "'s' || l_orderkey % 2 AS table_schema", "IF(l_orderkey % 3 = 0, 'PRIMARY KEY', 'FOREIGN KEY') AS constraint_type").distinct()
    usage = lines.selectExpr("'c' || l_orderkey AS constraint_name", "'s' || l_orderkey % 2 AS table_schema", "'t' || l_orderkey % 50 AS table_name", "'k' || l_linenumber AS column_name").distinct()
    return constraints, usage


_CATALOG = """c AS (SELECT DISTINCT 'c' || l_orderkey AS n, 's' || l_orderkey % 2 AS s, CASE WHEN l_orderkey % 3 = 0 THEN 'PRIMARY KEY' ELSE 'FOREIGN KEY' END AS kind FROM lineitem),
u AS (SELECT DISTINCT 'c' || l_orderkey AS n, 's' || l_orderkey % 2 AS s, 't' || l_orderkey % 50 AS t, 'k' || l_linenumber AS col FROM lineitem)"""


@_proof(f"WITH {_CATALOG} SELECT c.n, u.t, u.col, r.t AS references_table, r.col AS references_column FROM c JOIN u USING (n, s) JOIN u r ON r.n = c.n AND r.s = c.s WHERE kind = 'FOREIGN KEY'")
def fk_catalog(spark, d):
    constraints, usage = _catalog(spark, d)
    return collisions.catalog_keys(constraints, usage, "FOREIGN KEY", usage).select(F.col("constraint_name").alias("n"), F.col("table_name").alias("t"), F.col("column_name").alias("col"), "references_table", "references_column")


@_proof(f"WITH {_CATALOG} SELECT c.n, u.t, u.col FROM c JOIN u USING (n, s) WHERE kind = 'PRIMARY KEY'")
def pk_catalog(spark, d):
    return collisions.catalog_keys(*_catalog(spark, d), "PRIMARY KEY").select(F.col("constraint_name").alias("n"), F.col("table_name").alias("t"), F.col("column_name").alias("col"))


@_proof("""SELECT c_custkey, coalesce((SELECT string_agg(o_orderkey || o_orderstatus, ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS orders, coalesce((SELECT count(*) FROM events WHERE user_id = c_custkey), 0) AS events FROM customer""")
def assembled_tables(spark, d):
    lists = {"orders": table(spark, d, "orders").selectExpr("o_custkey AS c_custkey", "o_orderkey", "o_orderstatus"), "events": table(spark, d, "events").selectExpr("user_id AS c_custkey", "event_id")}
    out = collisions.assembled(table(spark, d, "customer").select("c_custkey"), "c_custkey", lists)
    return out.select("c_custkey", F.array_join(F.transform("orders", lambda x: F.concat(x["o_orderkey"].cast("string"), x["o_orderstatus"])), ",").alias("orders"), F.size("events").cast("long").alias("events"))


@_proof("""SELECT p_brand AS name, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS columns, string_agg(p_name, ',' ORDER BY p_name) AS relations, string_agg(DISTINCT 'V' || p_size, ',' ORDER BY 'V' || p_size) AS files FROM part GROUP BY 1""")
def migration_tables(spark, d):
    parts = table(spark, d, "part").selectExpr("p_brand AS name", "array(p_type) AS columns", "array(p_name) AS relations", "'V' || p_size AS file")
    return collisions.merged_tables(parts).select("name", *(F.array_join(c, ",").alias(c) for c in ("columns", "relations", "files")))


@_proof("""SELECT 't' || l_suppkey AS "table", 'p' || l_partkey % 90 AS parent, string_agg(DISTINCT 'k' || l_linenumber, ',' ORDER BY 'k' || l_linenumber) AS columns, CASE WHEN count(*) = 1 THEN 'resolved' ELSE 'ambiguous' END AS pairing FROM lineitem GROUP BY 1, 2""")
def live_relations(spark, d):
    fks = table(spark, d, "lineitem").selectExpr("'t' || l_suppkey AS table", "'p' || l_partkey % 90 AS parent", "'k' || l_linenumber AS column")
    return collisions.relation_groups(fks).withColumn("columns", F.array_join("columns", ","))


_ERD = """k AS (SELECT DISTINCT 's' || l_suppkey AS child, 'p' || l_partkey % 90 AS parent, 'c' || l_linenumber AS col, 'r' || l_linenumber % 2 AS ref FROM lineitem WHERE l_quantity > 48),
c AS (SELECT DISTINCT 's' || s_suppkey AS t, 'c' || x AS col, (s_suppkey + x) % 2 = 0 AS nullable FROM supplier, range(1, 6) r(x) UNION ALL SELECT DISTINCT 'p' || p_partkey % 80, 'r0', false FROM part), pk AS (SELECT DISTINCT 's' || s_suppkey AS t, 'c' || s_suppkey % 5 AS col FROM supplier)"""


@_proof(f"""WITH {_ERD}, n AS (SELECT child, parent, count(DISTINCT ref) AS targets, string_agg(DISTINCT col, '+' ORDER BY col) AS every FROM k GROUP BY 1, 2),
l AS (SELECT DISTINCT k.child, k.parent, CASE WHEN targets < 2 THEN k.col ELSE every END AS label, CASE WHEN targets < 2 THEN k.col END AS col FROM k JOIN n USING (child, parent))
SELECT l.child, l.parent, label, CASE WHEN c.nullable = false THEN '||' ELSE '|o' END AS cardinality, pk.col IS NOT NULL AS identifying, l.parent NOT IN (SELECT t FROM c) AS external
FROM l LEFT JOIN c ON c.t = l.child AND c.col = l.col LEFT JOIN pk ON pk.t = l.child AND pk.col = l.col""")
def erd_lines(spark, d):
    fks = table(spark, d, "lineitem").where("l_quantity > 48").selectExpr("'s' || l_suppkey AS child", "'p' || l_partkey % 90 AS parent", "'c' || l_linenumber AS column", "'r' || l_linenumber % 2 AS references_column").distinct()
    own = table(spark, d, "supplier").selectExpr("s_suppkey", "explode(sequence(1, 5)) AS x").selectExpr("'s' || s_suppkey AS table", "'c' || x AS column", "(s_suppkey + x) % 2 = 0 AS nullable")
    own = own.unionByName(table(spark, d, "part").selectExpr("'p' || p_partkey % 80 AS table", "'r0' AS column", "false AS nullable").distinct())
    return collisions.erd_relationships(fks, own, table(spark, d, "supplier").selectExpr("'s' || s_suppkey AS table", "'c' || s_suppkey % 5 AS column"))


def _ir(spark, d, where, shift):
    rows = table(spark, d, "part").where(where).selectExpr("p_brand AS schema", "IF(p_size % 4 = 0, p_name, upper(p_name)) AS name", f"p_type AS c", f"p_size % {shift} AS copy", "p_partkey")
    return rows.groupBy("schema", "name", "copy").agg(F.array_sort(F.collect_set("c")).alias("columns"), F.array(F.min("c")).alias("primary_key")).drop("copy")


def _ir_sql(where, shift):
    return f"SELECT p_brand AS schema, CASE WHEN p_size % 4 = 0 THEN p_name ELSE upper(p_name) END AS name, list_sort(list_distinct(list(p_type))) AS columns, [min(p_type)] AS pk FROM part WHERE {where} GROUP BY 1, 2, p_size % {shift}"


def _drift_sql(a, b):
    return f"""SELECT l.schema, l.name, CASE WHEN n IS NULL THEN 'table-missing' WHEN n > 1 THEN 'ambiguous' WHEN len(m) > 0 THEN 'column-missing' WHEN l.pk <> o.pk THEN 'primary-key' ELSE 'same' END AS status, CASE WHEN n = 1 THEN array_to_string(m, ',') ELSE '' END AS missing
FROM ({a}) l LEFT JOIN (SELECT schema, name, count(*) AS n, any_value(columns) AS columns, any_value(pk) AS pk FROM ({b}) GROUP BY 1, 2) o USING (schema, name), LATERAL (SELECT list_sort(list_filter(l.columns, lambda x: NOT list_contains(coalesce(o.columns, []), x))) AS m)"""


_SOURCE, _MIGRATION, _LIVE = ("p_partkey % 2 = 0", 1), ("p_partkey % 3 <> 0", 1), ("p_partkey % 5 <> 0", 2)


@_proof(_drift_sql(_ir_sql(*_SOURCE), _ir_sql(*_LIVE)))
def ir_drift(spark, d):
    return diff.ir_drift(_ir(spark, d, *_SOURCE), _ir(spark, d, *_LIVE)).withColumn("missing", F.array_join("missing", ","))


@_proof(" UNION ALL ".join(f"SELECT *, '{x}' AS left, '{y}' AS right FROM ({_drift_sql(_ir_sql(*a), _ir_sql(*b))})" for x, a, y, b in (("source", _SOURCE, "migration", _MIGRATION), ("source", _SOURCE, "live", _LIVE), ("migration", _MIGRATION, "live", _LIVE))))
def three_plane_drift(spark, d):
    planes = {n: _ir(spark, d, *x) for n, x in (("source", _SOURCE), ("migration", _MIGRATION), ("live", _LIVE))}
    return diff.planes_drift(planes).withColumn("missing", F.array_join("missing", ","))


# --- routes ----------------------------------------------------------------------------------------------------------
_ENDPOINTS = "e AS (SELECT p_partkey AS key, CASE p_size % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS verb, '/w' || p_partkey % 60 || '/{id}' AS path, CASE WHEN p_partkey % 3 <> 0 THEN 'op' || p_partkey END AS id, '/w' || p_partkey % 60 || '/:param' AS shape FROM part)"
_OPS = "o AS (SELECT CASE (p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END) % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS verb, CASE WHEN p_partkey % 11 = 0 THEN '/other' ELSE '/api/v0' END || '/w' || p_partkey % 60 || '/:param' AS shape, CASE WHEN p_partkey % 4 <> 0 THEN 'op' || p_partkey END AS id FROM part WHERE p_partkey % 5 <> 0)"


def _routes(spark, d):
    part = table(spark, d, "part")
    endpoints = part.selectExpr("p_partkey AS key", "IF(p_size % 2 = 0, 'GET', 'POST') AS verb", "'/w' || p_partkey % 60 || '/{id}' AS path", "IF(p_partkey % 3 <> 0, 'op' || p_partkey, NULL) AS operation_id")
    ops = part.where("p_partkey % 5 <> 0").selectExpr("IF((p_size + IF(p_partkey % 7 = 0, 1, 0)) % 2 = 0, 'GET', 'POST') AS verb", "IF(p_partkey % 11 = 0, '/other', '/api/v0') || '//w' || p_partkey % 60 || '/:key([0-9]+)/' AS path", "IF(p_partkey % 4 <> 0, 'op' || p_partkey, NULL) AS operation_id")
    return endpoints, ops


@_proof(f"""WITH {_ENDPOINTS}, {_OPS}, n AS (SELECT e.key, e.verb, o.id AS oid, o.verb AS overb, o.shape = '/api/v0' || e.shape AS fits, e.id FROM e LEFT JOIN o ON o.id = e.id WHERE e.id IS NOT NULL),
u AS (SELECT e.key, count(o.verb) AS n, max(o.id) AS oid FROM e LEFT JOIN o ON o.verb = e.verb AND o.shape IN ('/api/v0' || e.shape, e.shape) WHERE e.id IS NULL GROUP BY 1)
SELECT key, CASE WHEN oid IS NULL THEN 'missing' WHEN overb <> verb OR NOT fits THEN 'drift' ELSE 'matched' END AS kind, CASE WHEN overb <> verb THEN 'verb' WHEN NOT fits THEN 'path' ELSE '' END AS reason, CASE WHEN overb = verb AND fits THEN id END AS operation FROM n
UNION ALL SELECT key, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 AND oid IS NOT NULL THEN 'adopted' ELSE 'unresolved' END, CASE WHEN n > 1 OR (n = 1 AND oid IS NOT NULL) THEN '' WHEN n = 1 THEN 'document-missing-operation-id' ELSE 'no-candidate' END, CASE WHEN n = 1 THEN oid END FROM u""")
def document_reconciliation(spark, d):
    return routes.reconcile(*_routes(spark, d), spark.range(1).select(F.lit("/api/v0").alias("value")))


@_proof(f"WITH {_ENDPOINTS}, {_OPS}, x AS (SELECT DISTINCT replace(o.shape, e.shape, '') AS delta FROM e JOIN o ON o.id = e.id AND o.verb = e.verb WHERE ends_with(o.shape, e.shape)) SELECT CASE WHEN count(*) = 1 THEN min(delta) END AS value, CASE WHEN count(*) = 1 THEN 'inferred' ELSE 'none' END AS origin, CASE WHEN count(*) > 1 THEN string_agg(delta, ',' ORDER BY delta) ELSE '' END AS conflicting FROM x")
def path_prefix(spark, d):
    return routes.inferred_prefix(routes.prefix_deltas(*_routes(spark, d)))


def _runtime(spark, d):
    endpoints, ops = _routes(spark, d)
    endpoints = endpoints.withColumnRenamed("verb", "method").withColumn("path", F.concat(F.lit("/api/v0"), "path"))
    seen = table(spark, d, "part").where("p_partkey % 5 <> 0").selectExpr("p_partkey AS index", "IF((p_size + IF(p_partkey % 7 = 0, 1, 0)) % 2 = 0, 'GET', 'POST') AS method", "IF(p_partkey % 11 = 0, '/other', '/api/v0') || '/w' || p_partkey % 60 || '/' || IF(p_partkey % 2 = 0, '{id}', ':id') AS path", "IF(p_partkey % 4 <> 0, 'op' || (p_partkey - IF(p_partkey % 13 = 0, 1, 0)), NULL) AS operation_id")
    return routes.observe(endpoints, seen, True)


_SEEN = """r AS (SELECT p_partkey AS i, CASE (p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END) % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS m, CASE WHEN p_partkey % 11 = 0 THEN '/other' ELSE '/api/v0' END || '/w' || p_partkey % 60 AS s, p_partkey % 2 = 0 AS braces, CASE WHEN p_partkey % 4 <> 0 THEN 'op' || (p_partkey - CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END) END AS id FROM part WHERE p_partkey % 5 <> 0),
q AS (SELECT key, verb AS m, '/api/v0/w' || key % 60 AS s, id FROM e), a AS (SELECT id, count(*) AS ids, min(i) AS ii FROM r WHERE id IS NOT NULL GROUP BY 1), b AS (SELECT m, s, count(*) AS n, min(i) AS ri, arg_min(coalesce(id, ''), i) AS rid, arg_min(braces, i) AS braces FROM r GROUP BY 1, 2),
j AS (SELECT q.key, q.id, ids, ii, n, ri, nullif(rid, '') AS rid, braces FROM q LEFT JOIN a ON a.id = q.id LEFT JOIN b ON b.m = q.m AND b.s = q.s),
v AS (SELECT *, CASE WHEN id IS NULL THEN 'source-spec-route-not-resolved' WHEN ids > 1 THEN 'duplicate-runtime-operation-id' WHEN n = 1 AND rid <> id THEN 'runtime-operation-id-conflict' WHEN n = 1 AND rid IS NULL AND ids = 1 AND ii <> ri THEN 'runtime-operation-id-route-conflict'
WHEN n = 1 AND braces THEN 'runtime-route-exact-match' WHEN n = 1 THEN 'runtime-route-shape-match' WHEN ids = 1 THEN 'runtime-route-drift' ELSE 'runtime-route-missing-from-complete-snapshot' END AS reason FROM j)"""


@_proof(f"WITH {_ENDPOINTS}, {_SEEN} SELECT key, reason, CASE WHEN id IS NULL THEN 'unknown' WHEN reason LIKE '%-match' THEN 'observed' WHEN reason LIKE '%missing%' THEN 'missing' ELSE 'conflict' END AS state FROM v")
def runtime_routes(spark, d):
    return _runtime(spark, d)[0]


@_proof(f"""WITH {_ENDPOINTS}, {_SEEN} SELECT i AS index, id AS operation_id FROM r WHERE i NOT IN (SELECT ri FROM v WHERE id IS NOT NULL AND n = 1 AND NOT coalesce(ids > 1, false))
AND coalesce(id, '') NOT IN (SELECT id FROM v WHERE id IS NOT NULL AND (ids > 1 OR (ids = 1 AND reason IN ('runtime-operation-id-route-conflict', 'runtime-route-drift'))))""")
def runtime_only(spark, d):
    return _runtime(spark, d)[1].select("index", "operation_id")


@_proof("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'never') AS never FROM orders GROUP BY 1")
def state_counts(spark, d):
    return routes.state_counts(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "never"])


@_proof("SELECT o_custkey FROM orders WHERE o_totalprice > 1000 GROUP BY 1 HAVING count(DISTINCT o_orderpriority) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')) = 3")
def resolved_endpoints(spark, d):
    return routes.promotable(table(spark, d, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"], F.col("o_totalprice") > 1000)


@_proof("SELECT l_returnflag AS code, count(*) AS n FROM lineitem GROUP BY 1")
def count_by_code(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("code")).agg(F.count("*").alias("n"))
