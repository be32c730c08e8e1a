"""Proof queries of ownership, budgets, gates, trust, graphs and set operations over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import diff, graph, logs, ownership, paths, trust
from factloom.plans.proofs import NOW, _proof
from factloom.sources.extract import ddl_facts as _ddl_facts
from factloom.sources.extract import generic_routes as _generic_routes
from factloom.sources.extract import grouped_routes
from factloom.sources.tables import spread, table

# --- ownership -------------------------------------------------------------------------------------------------------
_SCOPES = "s AS (SELECT DISTINCT p_type AS repo, 't' || p_size % 6 AS track, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN lower(p_brand) || '/' || p_size % 8 ELSE p_brand || '/' || p_size % 8 || '/' || p_name END AS scope FROM part)"


def _scopes(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", "p_type AS repo", "'t' || p_size % 6 AS track", "CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN lower(p_brand) || '/' || p_size % 8 ELSE p_brand || '/' || p_size % 8 || '/' || p_name END AS scope")


def _overlap_sql(scopes: str) -> str:
    return f"""WITH {scopes} SELECT a.repo, a.track, a.scope, b.track AS other_track, b.scope AS other_scope FROM s a JOIN s b ON a.repo = b.repo AND a.track <> b.track AND (a.track, a.scope) < (b.track, b.scope)
AND (lower(a.scope) = lower(b.scope) OR starts_with(lower(a.scope), lower(b.scope) || '/') OR starts_with(lower(b.scope), lower(a.scope) || '/'))"""


@_proof(_overlap_sql(_SCOPES))
def scope_overlaps(spark, d):
    return ownership.overlapping(_scopes(spark, d), "repo", "track", "scope")


@_proof(_overlap_sql(_SCOPES.replace("FROM part", "FROM part WHERE p_partkey % 50 <= 25 AND 25 < p_partkey % 50 + p_size")))
def lease_conflicts(spark, d):
    leases = _scopes(spark, d).join(table(spark, d, "part").selectExpr("p_partkey", "p_partkey % 50 AS issued", "p_partkey % 50 + p_size AS expires"), "p_partkey")
    return ownership.lease_conflicts(leases, "repo", "track", "scope", F.lit(25))


_OWNED = "p AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN upper(p_brand) ELSE p_brand END || '/' || p_size || '/' || p_name || p_partkey AS path FROM part), o AS (SELECT DISTINCT p_brand || '/' || p_size AS scope, 'o' || p_partkey % 3 AS owner FROM part WHERE p_size % 3 <> 0), h AS (SELECT DISTINCT p_brand AS scope FROM part WHERE p_brand LIKE '%5')"


@_proof(f"""WITH {_OWNED}, x AS (SELECT path, string_agg(DISTINCT owner, ',' ORDER BY owner) AS l, count(DISTINCT owner) AS n FROM p JOIN o ON starts_with(path, scope || '/') GROUP BY 1), f AS (SELECT path, string_agg(DISTINCT owner, ',' ORDER BY owner) AS l FROM p JOIN o ON starts_with(lower(path), lower(scope) || '/') GROUP BY 1)
SELECT path, CASE WHEN EXISTS (SELECT 1 FROM h WHERE starts_with(path, h.scope || '/')) THEN 'hot' WHEN x.n > 1 THEN 'multiple' WHEN x.n = 1 THEN 'owned' WHEN f.l IS NOT NULL THEN 'case-fold' ELSE 'unowned' END AS class, coalesce(x.l, f.l, '') AS owners FROM p LEFT JOIN x USING (path) LEFT JOIN f USING (path)""")
def path_owners(spark, d):
    part = table(spark, d, "part")
    rows = part.selectExpr("IF(p_partkey % 4 = 0, upper(p_brand), p_brand) || '/' || p_size || '/' || p_name || p_partkey AS path")
    owners = part.where("p_size % 3 <> 0").selectExpr("p_brand || '/' || p_size AS scope", "'o' || p_partkey % 3 AS owner")
    return ownership.classified(rows, "path", part.where("p_brand LIKE '%5'").selectExpr("p_brand AS scope"), owners)


@_proof("""WITH k AS (SELECT DISTINCT p_name AS name, p_size % 3 AS project FROM part WHERE p_partkey % 4 = 0), n AS (SELECT name, count(DISTINCT project) AS n, min(project) AS target FROM k GROUP BY 1), d AS (SELECT DISTINCT p_size % 7 AS project, p_name AS name FROM part)
SELECT project, name, CASE WHEN n = 1 THEN CAST(target AS VARCHAR) END AS target, CASE WHEN n = 1 THEN 'local' ELSE 'ambiguous' END AS status FROM d JOIN n USING (name) WHERE n > 1 OR target <> project""")
def package_edges(spark, d):
    part = table(spark, d, "part")
    return ownership.package_edges(part.selectExpr("p_size % 7 AS project", "p_name AS name").distinct(), part.where("p_partkey % 4 = 0").selectExpr("p_name AS name", "p_size % 3 AS project").distinct()).withColumn("target", F.col("target").cast("string"))


@_proof("""WITH i AS (SELECT DISTINCT 'src/' || p_size || '/a.ts' AS path, p_partkey % 4 AS k, p_partkey % 90 AS n, p_size FROM part), f AS (SELECT DISTINCT 'src/' || p_size || '/m' || p_partkey % 90 || CASE WHEN p_partkey % 2 = 0 THEN '.ts' ELSE '/index.js' END AS file FROM part),
c AS (SELECT path, k, n, p_size, (SELECT count(*) FROM f WHERE file IN ('src/' || p_size || '/m' || n || '.ts', 'src/' || p_size || '/m' || n || '/index.js')) AS hits FROM i)
SELECT DISTINCT path, CASE k WHEN 0 THEN 'm' || n WHEN 1 THEN './../../../m' || n WHEN 2 THEN './m' || n ELSE '../' || p_size || '/m' || n END AS specifier, CASE WHEN k = 0 THEN 'bare' WHEN k = 1 THEN 'blocked' WHEN hits = 0 THEN 'missing' WHEN hits > 1 THEN 'ambiguous' ELSE 'resolved' END AS status,
CASE WHEN k > 1 AND hits = 1 THEN (SELECT min(file) FROM f WHERE file IN ('src/' || p_size || '/m' || n || '.ts', 'src/' || p_size || '/m' || n || '/index.js')) END AS target FROM c""")
def imports_resolved(spark, d):
    part = table(spark, d, "part")
    imports = part.selectExpr("'src/' || p_size || '/a.ts' AS path", "CASE p_partkey % 4 WHEN 0 THEN 'm' || p_partkey % 90 WHEN 1 THEN './../../../m' || p_partkey % 90 WHEN 2 THEN './m' || p_partkey % 90 ELSE '../' || p_size || '/m' || p_partkey % 90 END AS specifier")
    files = part.selectExpr("'src/' || p_size || '/m' || p_partkey % 90 || IF(p_partkey % 2 = 0, '.ts', '/index.js') AS file")
    return ownership.resolved_imports(imports, files, [".ts", ".js"])


# --- gates, logs and budgets -----------------------------------------------------------------------------------------
_GATES = "g AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'soon' ELSE CAST(ts AS VARCHAR) END AS moment, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_type = 'click' THEN 'awaiting' WHEN value > 90 THEN 'revoke' WHEN event_id % 3 = 0 THEN 'force' ELSE 'pass' END AS event, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 43200 END AS minutes, user_id % 5 = 0 AS changed FROM events)"


@_proof(f"""WITH {_GATES} SELECT event_id, CASE WHEN event IS NULL THEN 'not_run' WHEN event = 'awaiting' THEN 'awaiting' WHEN event = 'revoke' THEN 'revoked' WHEN changed OR (minutes > 0 AND (TRY_CAST(moment AS TIMESTAMP) IS NULL OR floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(TRY_CAST(moment AS TIMESTAMP))) > 60 * minutes)) THEN 'stale' WHEN event = 'force' THEN 'forced' ELSE 'pass' END AS status FROM g""")
def gate_states(spark, d):
    e = table(spark, d, "events")
    event = F.when(F.col("event_id") % 13 != 0, logs.event_type(F.col("event_type") == "click", F.col("value") > 90, F.col("event_id") % 3 == 0))
    at = F.try_to_timestamp(F.when(F.col("event_id") % 11 == 0, "soon").otherwise(F.col("ts").cast("string")))
    return e.select("event_id", logs.gate_status(F.lit(NOW).cast("timestamp"), at, event, F.expr("IF(event_id % 2 = 0, 0, 43200)"), F.col("user_id") % 5 == 0).alias("status"))


_STATUS = "CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'N' THEN 'forced' ELSE 'stale' END"


@_proof(f"SELECT l_orderkey, coalesce(string_agg(DISTINCT CASE WHEN l_returnflag = 'R' AND l_linenumber < 4 THEN 'g' || l_linenumber END, ',' ORDER BY CASE WHEN l_returnflag = 'R' AND l_linenumber < 4 THEN 'g' || l_linenumber END), '') AS blocking, count(*) FILTER (l_returnflag <> 'R') AS passing, count(*) AS total, NOT bool_or(l_returnflag = 'R' AND l_linenumber < 4) AS ok FROM lineitem GROUP BY 1")
def gate_verdicts(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "'g' || l_linenumber AS gate", f"{_STATUS} AS status", "l_returnflag = 'R' AND l_linenumber < 4 AS blocking")
    return logs.gate_verdict(rows, "l_orderkey", "gate", "status", F.col("blocking"))


@_proof("""WITH e AS (SELECT conv_id, turn, CASE WHEN turn % 7 <> 3 THEN sha256(coalesce(text, '')) END AS h, coalesce(text, '') AS body FROM conversations), b AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'genesis') AS before FROM e),
p AS (SELECT *, CASE WHEN turn % 5 = 4 THEN 'x' ELSE before END AS prev FROM b) SELECT conv_id, turn, prev = before AS linked, coalesce(h = sha256(prev || body), false) AS own, turn + 1 = row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS contiguous FROM p""")
def audit_chain(spark, d):
    digest = F.when(F.col("turn") % 7 != 3, F.sha2(F.coalesce("text", F.lit("")), 256))
    log = table(spark, d, "conversations").withColumn("sha256", digest)
    before = F.coalesce(F.last("sha256", ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit("genesis"))
    log = log.withColumn("prev_sha256", F.when(F.col("turn") % 5 == 4, "x").otherwise(before)).withColumn("seq", F.col("turn") + 1)
    return logs.audit_chain(log, "conv_id", "seq", "genesis", F.coalesce("text", F.lit(""))).select("conv_id", "turn", "linked", "own", "contiguous")


@_proof("""SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') THEN 'orphan' WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) > 1 THEN 'duplicate' END AS fault FROM lineitem""")
def outcome_faults(spark, d):
    decisions = table(spark, d, "orders").where("o_orderstatus <> 'P'").selectExpr("o_orderkey AS l_orderkey")
    lines = table(spark, d, "lineitem").withColumn("seq", F.struct("l_linenumber", "l_partkey"))
    return logs.outcome_faults(decisions, lines, "l_orderkey", "seq").select("l_orderkey", "l_linenumber", "fault")


@_proof("""WITH r AS (SELECT *, row_number() OVER w AS nth, sum(n_chars) OVER w AS used FROM documents WINDOW w AS (PARTITION BY source ORDER BY sha256(coalesce(text, '') || doc_id) ROWS UNBOUNDED PRECEDING)) SELECT doc_id, source FROM r WHERE nth <= 30 AND used <= 40000""")
def gc_candidates(spark, d):
    docs = table(spark, d, "documents").withColumn("digest", F.sha2(F.concat(F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")), 256))
    return logs.gc_prefix(docs, "source", "digest", "n_chars", 30, 40000).select("doc_id", "source")


@_proof("""WITH RECURSIVE s AS (SELECT l_orderkey, l_quantity AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem), r AS (SELECT l_orderkey, n, CASE WHEN size <= 100 THEN size ELSE 0 END AS used, size <= 100 AS kept FROM s WHERE n = 1
UNION ALL SELECT s.l_orderkey, s.n, r.used + CASE WHEN r.used + s.size <= 100 THEN s.size ELSE 0 END, r.used + s.size <= 100 FROM r JOIN s ON s.l_orderkey = r.l_orderkey AND s.n = r.n + 1) SELECT l_orderkey, n FROM r WHERE kept""")
def skip_budget(spark, d):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = table(spark, d, "lineitem").withColumn("n", n.cast("long"))
    return logs.skip_budget(rows.select("l_orderkey", "n", "l_quantity"), "l_orderkey", "n", "l_quantity", 100).where("included").select("l_orderkey", "n")


@_proof("""WITH RECURSIVE s AS (SELECT l_orderkey AS request, l_linenumber AS source, l_quantity AS size, row_number() OVER w AS n, count(*) OVER (PARTITION BY l_orderkey) AS c FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
r AS (SELECT request, source, n, c, CASE WHEN size <= 60 THEN size ELSE 0 END AS used, size <= 60 AS included FROM s WHERE n = 1 AND c <= 4
UNION ALL SELECT s.request, s.source, s.n, s.c, r.used + CASE WHEN r.used + s.size <= 60 THEN s.size ELSE 0 END, r.used + s.size <= 60 FROM r JOIN s ON s.request = r.request AND s.n = r.n + 1)
SELECT request, CAST(source AS VARCHAR) AS source, included, false AS refused FROM r UNION ALL SELECT DISTINCT request, NULL, false, true FROM s WHERE c > 4""")
def packet_requests(spark, d):
    one = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("source")).agg(F.min("l_quantity").alias("size"))
    return logs.skip_budget(one, "request", "source", "size", 60, 4).withColumn("source", F.col("source").cast("string"))


@_proof("""WITH m AS (SELECT p_brand, max(p_size) AS m FROM part GROUP BY 1), b AS (SELECT p_brand, count(DISTINCT p_name) AS n, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS names FROM part JOIN m USING (p_brand) WHERE p_size = m GROUP BY 1)
SELECT p_brand, CASE WHEN n = 1 THEN names END AS winner, CASE WHEN n > 1 THEN names END AS tied FROM b""")
def adapter_arbitration(spark, d):
    return logs.arbitrate(table(spark, d, "part"), "p_brand", "p_name", "p_size")


@_proof("""SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders WHERE (o_custkey, o_orderpriority) NOT IN (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P') AND o_orderstatus <> 'P' GROUP BY 1, 2
UNION ALL SELECT o_custkey, o_orderpriority, max(o_orderkey) FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2 HAVING max(o_orderkey) % 4 <> 0""")
def dispositions_upserted(spark, d):
    orders, keys = table(spark, d, "orders"), ["o_custkey", "o_orderpriority"]
    old = orders.where("o_orderstatus <> 'P'").groupBy(*keys).agg(F.min("o_orderkey").alias("k"))
    new = orders.where("o_orderstatus = 'P'").groupBy(*keys).agg(F.max("o_orderkey").alias("k"))
    return logs.upserted(old, new, keys, F.col("k") % 4 == 0)


@_proof("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45)")
def evicted_entries(spark, d):
    cache = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("deps"))
    return logs.evicted(cache, "l_orderkey", "deps", table(spark, d, "part").where("p_size > 45").select("p_partkey"))


@_proof("SELECT DISTINCT p_brand AS feature_id, 'feature_scoped_changes' AS reason FROM part WHERE p_partkey % 7 = 0")
def ci_features(spark, d):
    part = table(spark, d, "part")
    changed = part.selectExpr("IF(p_partkey % 7 = 0, p_brand, NULL) AS f", "p_partkey % 7 <> 0 AS doc")
    return logs.ci_selection(changed, part.selectExpr("p_brand AS feature_id"), F.col("f"), F.col("doc"))


_WORK = "SELECT c_custkey AS id, c_custkey % 9 AS samples, c_acctbal + 2000 AS cold, c_nationkey + 1.0 AS rss, c_acctbal / 2 AS hit FROM customer"


@_proof(f"""WITH b AS ({_WORK} WHERE c_custkey % 10 <> 0), c AS (SELECT id, samples + 1 AS samples, cold * CASE WHEN id % 4 = 0 THEN 1.2 ELSE 1 END AS cold, rss + 1 AS rss, hit FROM ({_WORK}) WHERE id % 11 <> 0),
j AS (SELECT coalesce(b.id, c.id) AS id, CASE WHEN b.id IS NULL OR c.id IS NULL THEN 'WORKLOAD_SET_MISMATCH' WHEN least(b.samples, c.samples) < 5 THEN 'INSUFFICIENT_SAMPLES' WHEN (c.cold - b.cold) * 100 / b.cold > 15 THEN 'COLD_REGRESSION' WHEN (c.rss - b.rss) * 100 / b.rss > 15 THEN 'RSS_REGRESSION' WHEN c.hit / c.cold > 0.5 THEN 'CACHE_HIT_TOO_SLOW' END AS code FROM b FULL JOIN c ON b.id = c.id)
SELECT id, code, CASE WHEN code IN ('WORKLOAD_SET_MISMATCH', 'INSUFFICIENT_SAMPLES') THEN 'blocked' WHEN code IS NULL THEN 'pass' ELSE 'fail' END AS status FROM j""")
def performance_gate(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_custkey % 9 AS samples", "c_acctbal + 2000 AS cold", "CAST(c_nationkey + 1 AS DOUBLE) AS rss", "c_acctbal / 2 AS hit")
    candidate = rows.where("id % 11 <> 0").selectExpr("id", "samples + 1 AS samples", "cold * IF(id % 4 = 0, 1.2D, 1.0D) AS cold", "rss + 1 AS rss", "hit")
    return logs.performance_gate(rows.where("id % 10 <> 0"), candidate)


@_proof("SELECT c_name, arg_max(c_custkey, c_custkey) AS latest FROM customer GROUP BY 1")
def latest_ids(spark, d):
    return logs.latest(table(spark, d, "customer").selectExpr("c_name", "c_custkey AS latest"), "c_name", "latest")


# --- set operations --------------------------------------------------------------------------------------------------
@_proof("""SELECT o_orderkey, 'priority' AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'added' WHEN o_orderkey % 5 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 OR o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0 OR (o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0)""")
def gate_inputs(spark, d):
    orders = table(spark, d, "orders")
    before = orders.selectExpr("o_orderkey", "IF(o_orderkey % 3 = 0, map('status', o_orderstatus), map('status', o_orderstatus, 'priority', o_orderpriority)) AS i")
    after = orders.selectExpr("o_orderkey", "IF(o_orderkey % 5 = 0, map('status', o_orderstatus), map('status', o_orderstatus, 'priority', IF(o_orderkey % 7 = 0, NULL, o_orderpriority))) AS i")
    return diff.input_delta(before, after, "o_orderkey", "i")


_ROOTS = "a AS (SELECT DISTINCT p_brand || '/' || p_size AS root FROM part WHERE p_size % 2 = 0 UNION SELECT DISTINCT p_brand FROM part WHERE p_brand LIKE '%1'), b AS (SELECT DISTINCT p_brand || '/' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '/' || p_type ELSE '' END AS root FROM part)"


@_proof(f"WITH {_ROOTS} SELECT root FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.root = a.root OR starts_with(b.root, a.root || '/'))")
def permission_roots(spark, d):
    part = table(spark, d, "part")
    before = part.where("p_size % 2 = 0").selectExpr("p_brand || '/' || p_size AS root").unionByName(part.where("p_brand LIKE '%1'").selectExpr("p_brand AS root"))
    return trust.root_expansions(before, part.selectExpr("p_brand || '/' || p_size || IF(p_partkey % 3 = 0, '/' || p_type, '') AS root"), "root", paths.ancestors)


_POLICY = "SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'allow' ELSE 'revoke' END AS list, l_returnflag AS usage, 'h' || l_partkey AS sha256 FROM lineitem WHERE "


@_proof(f"""WITH a AS ({_POLICY} l_quantity < 40), b AS ({_POLICY} l_quantity > 10) SELECT list, usage, sha256, CASE WHEN list = 'allow' THEN 'expansion' ELSE 'reduction' END AS kind FROM (FROM b EXCEPT FROM a)
UNION ALL SELECT list, usage, sha256, CASE WHEN list = 'revoke' THEN 'expansion' ELSE 'reduction' END FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'generation', NULL, NULL, 'expansion'""")
def trust_policy_delta(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("IF(l_linenumber % 2 = 0, 'allow', 'revoke') AS list", "l_returnflag AS usage", "'h' || l_partkey AS sha256", "l_quantity")
    return diff.policy_delta(rows.where("l_quantity < 40"), rows.where("l_quantity > 10"), (5, 4))


@_proof("SELECT c_nationkey, c_mktsegment FROM customer GROUP BY 1, 2")
def distinct_json(spark, d):
    return diff.distinct_json(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@_proof("""WITH f AS (SELECT l_linenumber AS backend, l_suppkey AS case_id, list_sort(list_distinct(list(l_returnflag || l_linestatus))) AS facts FROM lineitem WHERE l_quantity > 44 GROUP BY 1, 2), c AS (SELECT b.x AS backend, s_suppkey AS case_id, (s_suppkey + b.x) % 6 = 0 AS error FROM supplier, range(1, 5) b(x)),
r AS (SELECT c.*, coalesce(facts, []) AS facts FROM c LEFT JOIN f USING (backend, case_id)) SELECT r.backend, r.case_id, CASE WHEN r.error OR q.error THEN 'not-comparable' WHEN r.facts = q.facts THEN 'agrees' ELSE 'differs' END AS status FROM r JOIN r q ON q.case_id = r.case_id AND q.backend = 1 WHERE r.backend <> 1""")
def backend_agreement(spark, d):
    facts = table(spark, d, "lineitem").where("l_quantity > 44").selectExpr("l_linenumber AS backend", "l_suppkey AS case_id", "l_returnflag || l_linestatus AS fact")
    cases = table(spark, d, "supplier").selectExpr("s_suppkey AS case_id", "explode(sequence(1, 4)) AS backend").selectExpr("backend", "case_id", "IF((case_id + backend) % 6 = 0, 'failed', NULL) AS error")
    return diff.backend_agreement(facts, cases, 1)


# --- trust -----------------------------------------------------------------------------------------------------------
@_proof("""SELECT l_orderkey, l_linenumber, CASE WHEN 'h' || l_partkey IN (SELECT 'h' || p_partkey FROM part WHERE p_size > 40) THEN 'revoked' WHEN ('u' || l_suppkey % 3, 'h' || l_partkey) IN (SELECT ('u' || p_partkey % 3, 'h' || p_partkey) FROM part) THEN 'allowed' ELSE 'untrusted' END AS trust FROM lineitem""")
def artifact_trust(spark, d):
    part = table(spark, d, "part")
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "'u' || l_suppkey % 3 AS usage", "'h' || l_partkey AS sha256")
    return trust.artifact_trust(rows, part.selectExpr("'u' || p_partkey % 3 AS usage", "'h' || p_partkey AS sha256"), part.where("p_size > 40").selectExpr("'h' || p_partkey AS sha256")).select("l_orderkey", "l_linenumber", "trust")


_CASES = """x AS (SELECT DISTINCT 'l' || p_size % 3 AS layer, p_name || p_size AS case_id FROM part WHERE p_partkey % 4 <> 0), g AS (SELECT 'l' || p_size % 3 AS layer, p_name || p_size AS case_id, count(*) AS n, bool_and(p_retailprice > 950) AS passed, bool_and(p_partkey % 9 <> 0) AS verified FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1, 2),
v AS (SELECT layer, case_id, CASE WHEN g.n IS NULL THEN 'missing' WHEN x.case_id IS NULL THEN 'unknown' WHEN n > 1 THEN 'duplicate' WHEN NOT verified THEN 'unverified' WHEN NOT passed THEN 'failed' ELSE 'passed' END AS status FROM (SELECT *, 1 AS k FROM x) x FULL JOIN g USING (layer, case_id))"""


def _cases(spark, d):
    part = table(spark, d, "part").selectExpr("'l' || p_size % 3 AS layer", "p_name || p_size AS case_id", "p_retailprice > 950 AS passed", "p_partkey % 9 <> 0 AS verified", "p_partkey")
    return trust.evaluated(part.where("p_partkey % 4 <> 0"), part.where("p_partkey % 5 <> 0"))


@_proof(f"WITH {_CASES.replace('x.case_id IS NULL', 'x.k IS NULL')} SELECT layer, case_id, status FROM v")
def adversarial_cases(spark, d):
    return _cases(spark, d)


@_proof(f"WITH {_CASES.replace('x.case_id IS NULL', 'x.k IS NULL')} SELECT layer, bool_and(status = 'passed') AS ready, coalesce(string_agg(DISTINCT nullif(status, 'passed'), ',' ORDER BY nullif(status, 'passed')), '') AS blockers FROM v GROUP BY 1")
def layers_ready(spark, d):
    return trust.ready(_cases(spark, d), "layer")


@_proof("SELECT p_name, p_type, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def matrix_duplicates(spark, d):
    return trust.duplicate_rows(table(spark, d, "part"), ["p_name", "p_type"])


@_proof("""WITH h AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS h FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN list_has_all(h, ['1-URGENT', '2-HIGH', '5-LOW', '3-MEDIUM']) THEN 'runtime' WHEN list_has_all(h, ['1-URGENT', '2-HIGH', '5-LOW']) THEN 'build' WHEN list_has_all(h, ['1-URGENT', '2-HIGH']) THEN 'unit' ELSE 'none' END AS level FROM h""")
def certification_levels(spark, d):
    levels = {"unit": ["1-URGENT", "2-HIGH"], "build": ["5-LOW"], "runtime": ["3-MEDIUM"]}
    return trust.certified(table(spark, d, "orders"), "o_custkey", "o_orderpriority", levels)


@_proof("""WITH r AS (SELECT o_custkey AS release, o_orderkey AS c, CASE WHEN o_orderstatus = 'P' THEN 'SKIP' ELSE 'PASS' END AS required FROM orders), e AS (SELECT DISTINCT 'e' || p_partkey AS ref FROM part WHERE p_size < 40),
b AS (SELECT l_orderkey AS c, bool_and(l_returnflag <> 'A') AS passed, bool_and(ref IS NOT NULL) AS held FROM lineitem LEFT JOIN e ON ref = 'e' || l_partkey GROUP BY 1),
k AS (SELECT release, CASE WHEN required <> 'PASS' OR NOT coalesce(passed, false) THEN 'check-not-passed' WHEN NOT held THEN 'evidence-missing' END AS code FROM r LEFT JOIN b USING (c)) SELECT release, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS blockers FROM k GROUP BY 1""")
def release_blockers(spark, d):
    required = table(spark, d, "orders").selectExpr("o_custkey AS release", "o_orderkey AS check_id", "IF(o_orderstatus = 'P', 'SKIP', 'PASS') AS required")
    observed = table(spark, d, "lineitem").selectExpr("l_orderkey AS check_id", "IF(l_returnflag <> 'A', 'PASS', 'FAIL') AS result", "'e' || l_partkey AS ref")
    return trust.checks_pass(required, observed, table(spark, d, "part").where("p_size < 40").selectExpr("'e' || p_partkey AS ref"))


_NEED = "SELECT DISTINCT c_nationkey AS adapter, c_mktsegment AS capability FROM customer"
_HAVE = "SELECT s_nationkey AS adapter, CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'FURNITURE' END AS capability, CASE WHEN s_acctbal < 0 THEN 'unknown' WHEN s_acctbal < 3000 THEN 'partial' ELSE 'supported' END AS status FROM supplier"


@_proof(f"""WITH h AS (SELECT adapter, capability, min(status) AS lo, max(status) AS hi FROM ({_HAVE}) GROUP BY ALL), s AS (SELECT adapter, capability, lo, hi, CASE WHEN lo = hi THEN lo ELSE 'unknown' END AS status FROM ({_NEED}) LEFT JOIN h USING (adapter, capability))
SELECT adapter, capability, status, status = 'supported' AS allowed, CASE WHEN lo IS NULL THEN 'capability record is missing' WHEN lo <> hi THEN 'capability records conflict' WHEN status <> 'supported' THEN 'status ' || status || ' is not accepted by this policy' END AS reason FROM s""")
def capability_policy(spark, d):
    have = table(spark, d, "supplier").selectExpr("s_nationkey AS adapter", "CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'FURNITURE' END AS capability",
                                                  "CASE WHEN s_acctbal < 0 THEN 'unknown' WHEN s_acctbal < 3000 THEN 'partial' ELSE 'supported' END AS status")
    needs = table(spark, d, "customer").selectExpr("c_nationkey AS adapter", "c_mktsegment AS capability").distinct()
    return trust.capability_allowed(needs, have, F.array(F.lit("supported"), F.lit("unknown")))


@_proof(f"""WITH w AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'trust.secret-leak' ELSE event_type END AS code, 's' || user_id % 3 AS subject, CASE WHEN event_id % 7 <> 0 THEN 's' || event_id % 2 END AS scope,
  CASE event_id % 5 WHEN 0 THEN ['click', 'evidence.replay'] WHEN 1 THEN ['view'] ELSE ['click', 'view', 'signup'] END AS codes, CASE event_id % 3 WHEN 0 THEN 'never' WHEN 1 THEN '2024-01-01 00:00:00' ELSE '2030-01-01 00:00:00' END AS x FROM events)
SELECT event_id, CASE WHEN code = 'trust.secret-leak' THEN code || ' is non-waivable' WHEN scope IS NULL THEN 'no waiver supplied' WHEN scope <> subject THEN 'waiver scope ' || scope || ' does not match subject ' || subject
  WHEN NOT list_contains(codes, code) THEN 'waiver does not cover ' || code WHEN list_contains(codes, 'evidence.replay') THEN 'waiver attempts to cover a non-waivable failure code'
  WHEN x = 'never' THEN 'waiver.expiresAt must be a valid date-time' WHEN TRY_CAST(x AS TIMESTAMP) <= TIMESTAMP '{NOW}' THEN 'waiver is expired' END AS reason FROM w""")
def waivers_admitted(spark, d):
    rows = table(spark, d, "events").selectExpr(
        "event_id", "IF(event_type = 'purchase', 'trust.secret-leak', event_type) AS code", "'s' || user_id % 3 AS subject", "IF(event_id % 7 <> 0, 's' || event_id % 2, NULL) AS scope",
        "CASE event_id % 5 WHEN 0 THEN array('click', 'evidence.replay') WHEN 1 THEN array('view') ELSE array('click', 'view', 'signup') END AS codes",
        "CASE event_id % 3 WHEN 0 THEN 'never' WHEN 1 THEN '2024-01-01 00:00:00' ELSE '2030-01-01 00:00:00' END AS x")
    reason = trust.waiver_reason(F.col("code"), F.col("subject"), F.col("scope"), F.col("codes"), F.col("x"), F.lit(NOW).cast("timestamp"))
    return rows.select("event_id", reason.alias("reason"))


@_proof("""SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'missing' WHEN a.p_partkey IS NULL THEN 'unexpected' ELSE 'changed' END AS fault FROM (SELECT p_partkey, sha256(p_name) AS h FROM part WHERE p_partkey % 5 <> 0) a
FULL JOIN (SELECT p_partkey, sha256(CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END) AS h FROM part WHERE p_partkey % 7 <> 0) b ON a.p_partkey = b.p_partkey WHERE a.h IS DISTINCT FROM b.h""")
def inventory_faults(spark, d):
    part = table(spark, d, "part")
    found = part.where("p_partkey % 7 <> 0").selectExpr("p_partkey", "sha2(IF(p_partkey % 3 = 0, upper(p_name), p_name), 256) AS h")
    return trust.inventory_faults(part.where("p_partkey % 5 <> 0").selectExpr("p_partkey", "sha2(p_name, 256) AS h"), found, "p_partkey", "h")


# --- graphs ----------------------------------------------------------------------------------------------------------
def _impact(spark, d):
    first = table(spark, d, "part").selectExpr("'p' || p_partkey AS id", "'part' AS type", "p_name AS label", "p_partkey AS ordinal")
    second = table(spark, d, "lineitem").selectExpr("IF(l_linenumber = 1, 'p' || l_partkey, 's' || l_suppkey) AS id", "'line' AS type", "l_returnflag AS label", "l_orderkey * 10 + l_linenumber AS ordinal")
    edges = table(spark, d, "orders").selectExpr("'p' || o_custkey AS source", "'s' || o_orderkey % 15 AS target", "o_orderstatus AS relation")
    return graph.impact_graph([first, second], [edges])


_NODES = """a AS (SELECT 'p' || p_partkey AS id, 'part' AS type, p_name AS label, 0 AS t, p_partkey AS n FROM part UNION ALL SELECT CASE WHEN l_linenumber = 1 THEN 'p' || l_partkey ELSE 's' || l_suppkey END, 'line', l_returnflag, 1, l_orderkey * 10 + l_linenumber FROM lineitem),
g AS (SELECT id, type, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t, n, label) AS r FROM a) WHERE r = 1)"""


@_proof(f"WITH {_NODES} SELECT id, type FROM g")
def impact_nodes(spark, d):
    return _impact(spark, d)[0].select("id", "type")


@_proof(f"WITH {_NODES}, e AS (SELECT 'p' || o_custkey AS source, 's' || o_orderkey % 15 AS target, o_orderstatus AS relation FROM orders) SELECT source, target, relation FROM e WHERE source IN (SELECT id FROM g) AND target IN (SELECT id FROM g)")
def impact_edges(spark, d):
    return _impact(spark, d)[1].select("source", "target", "relation")


_MOUNTS = "m AS (SELECT DISTINCT 'n' || p_size AS parent, 'n' || CASE WHEN p_partkey % 40 = 0 THEN p_size // 2 ELSE p_size * 2 END AS child, CASE WHEN p_partkey % 2 = 0 THEN '/a' ELSE '/b' END AS prefix FROM part WHERE p_size < 20)"


@_proof(f"""WITH RECURSIVE {_MOUNTS}, r(node, prefix, seen) AS (SELECT DISTINCT parent, '', [parent] FROM m WHERE parent NOT IN (SELECT child FROM m) UNION SELECT m.child, r.prefix || m.prefix, list_append(seen, m.child) FROM r JOIN m ON m.parent = r.node WHERE NOT list_contains(seen, m.child))
SELECT DISTINCT node, prefix FROM r""")
def mount_prefixes(spark, d):
    mounts = table(spark, d, "part").where("p_size < 20").selectExpr("'n' || p_size AS parent", "'n' || IF(p_partkey % 40 = 0, p_size DIV 2, p_size * 2) AS child", "IF(p_partkey % 2 = 0, '/a', '/b') AS prefix").distinct()
    return graph.prefix_chains(mounts)


_ALIAS = "a AS (SELECT p_partkey AS name, CASE WHEN p_partkey % 10 = 0 THEN p_partkey - 5 ELSE p_partkey + 1 END AS next FROM part WHERE p_partkey % 17 <> 0)"


@_proof(f"""WITH RECURSIVE {_ALIAS}, r(name, far, seen) AS (SELECT name, next, [name] FROM a UNION ALL SELECT r.name, a.next, list_append(seen, r.far) FROM r JOIN a ON a.name = r.far WHERE NOT list_contains(seen, r.far))
SELECT a.name, CAST((SELECT min(far) FROM r WHERE r.name = a.name AND far NOT IN (SELECT name FROM a)) AS VARCHAR) AS target FROM a""")
def alias_targets(spark, d):
    return graph.alias_targets(table(spark, d, "part").where("p_partkey % 17 <> 0").selectExpr("p_partkey AS name", "IF(p_partkey % 10 = 0, p_partkey - 5, p_partkey + 1) AS next")).withColumn("target", F.col("target").cast("string"))


def _packages(spark, d):
    """Local dependencies of orders' lines in order, as project edges: a supplier to the next line's one."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").withColumn("nxt", F.lead("l_suppkey").over(order))
    return lines.where("nxt IS NOT NULL AND nxt > l_suppkey").selectExpr("l_suppkey AS src", "nxt AS dst").distinct()


_PACKAGES = "e AS (SELECT DISTINCT l_suppkey AS src, nxt AS dst FROM (SELECT l_suppkey, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS nxt FROM lineitem WHERE l_returnflag = 'R') WHERE nxt > l_suppkey)"


@_proof(f"""WITH RECURSIVE {_PACKAGES}, r(node, dist) USING KEY (node) AS (SELECT s_suppkey, CAST(0 AS BIGINT) FROM supplier WHERE s_acctbal < 2000
UNION SELECT e.dst, min(r.dist) + 1 FROM r JOIN e ON e.src = r.node WHERE e.dst NOT IN (SELECT node FROM recurring.r) GROUP BY 1) SELECT node, dist FROM r""")
def project_invalidation(spark, d):
    return graph.invalidated(_packages(spark, d), table(spark, d, "supplier").selectExpr("s_suppkey AS node"), table(spark, d, "supplier").where("s_acctbal < 2000").selectExpr("s_suppkey AS node"))


@_proof("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 300 + 3 AS dst FROM lineitem WHERE l_quantity > 49), t(a, b) AS (SELECT src, dst FROM e UNION SELECT t.a, e.dst FROM t JOIN e ON e.src = t.b), c AS (SELECT a FROM t WHERE a = b)
SELECT a AS node FROM c UNION SELECT b FROM t WHERE a IN (SELECT a FROM c)""")
def protocol_cycles(spark, d):
    return graph.on_cycles(table(spark, d, "lineitem").where("l_quantity > 49").selectExpr("l_suppkey AS src", "l_partkey % 300 + 3 AS dst"))


@_proof(f"""WITH RECURSIVE {_PACKAGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(node, dist) USING KEY (node) AS (SELECT min(src), CAST(0 AS BIGINT) FROM e HAVING count(*) > 0
UNION SELECT u.dst, min(r.dist) + 1 FROM r JOIN u ON u.src = r.node WHERE u.dst NOT IN (SELECT node FROM recurring.r) GROUP BY 1), n AS (SELECT node, CASE WHEN dist <= 1 THEN CAST(node AS VARCHAR) ELSE 'beyond' END AS name FROM r)
SELECT DISTINCT a.name AS src, b.name AS dst FROM e JOIN n a ON a.node = e.src JOIN n b ON b.node = e.dst WHERE a.name <> b.name""")
def collapsed_rings(spark, d):
    edges = _packages(spark, d)
    seed = edges.agg(F.min("src").alias("node")).where("node IS NOT NULL")
    dist = graph.hops(graph.undirected(edges), seed).withColumn("node", F.col("node").cast("string"))
    return graph.collapsed(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")), dist, 1)[1]


@_proof("""WITH m AS (SELECT conv_id, turn, lower(regexp_extract(x, '^app\\.([a-z]+)', 1)) AS verb, regexp_extract(x, '"([^"]+)"', 1) AS path FROM (SELECT conv_id, turn, unnest(regexp_extract_all('app.get("/c/' || conv_id || '") ' || text || ' app.POST(  "/t/' || turn || '")', '(?i)app\\.(?:get|post)\\(\\s*"[^"]+"')) AS x FROM conversations))
SELECT conv_id, turn, 'express' AS framework, CASE WHEN path LIKE '/c/%' THEN 'GET' ELSE 'POST' END AS verb, path FROM m""")
def generic_routes(spark, d):
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", """'app.get("/c/' || conv_id || '") ' || text || ' app.POST(  "/t/' || turn || '")' AS text""")
    return _generic_routes(rows, "text").select("conv_id", "turn", "framework", "verb", "path")


@_proof("""SELECT source, '/' || CASE WHEN count(DISTINCT lang) = 1 THEN any_value(lang) || CASE WHEN count(DISTINCT doc_id) = 1 THEN '/' || any_value(doc_id) ELSE '' END ELSE '' END AS prefix, count(*) AS routes FROM documents WHERE lang IS NOT NULL GROUP BY 1""")
def route_groups(spark, d):
    return grouped_routes(table(spark, d, "documents").where("lang IS NOT NULL").selectExpr("source AS file", "'/' || lang || '/' || doc_id AS path"), "file", "path").withColumnRenamed("file", "source")


_DDL = "'CREATE TABLE IF NOT EXISTS app.' || replace(p_brand, '#', '_') || ' (id uuid NOT NULL, ' || p_type || ' numeric(10, 2), CONSTRAINT pk PRIMARY KEY (id), FOREIGN KEY (id) REFERENCES base(uid)); ALTER TABLE ' || replace(p_brand, '#', '_') || ' ADD COLUMN size_' || p_size || ' int; CREATE TABLE broken (a int'"


@_proof("""SELECT p_partkey, 'column' AS kind, replace(p_brand, '#', '_') AS "table", unnest(['id', p_type, 'size_' || p_size]) AS name, NULL AS parent FROM part UNION ALL SELECT p_partkey, 'fk', replace(p_brand, '#', '_'), 'id', 'base.uid' FROM part""")
def ddl_facts(spark, d):
    return _ddl_facts(spread(table(spark, d, "part"), "p_partkey").selectExpr("p_partkey", f"{_DDL} AS sql"), "sql").drop("sql", "parent_table", "parent_column", "ordinal")
