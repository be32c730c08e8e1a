"""Registered queries over the supplied tables, each with SQL that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators import diff, evidence, graph, logs, paths, rules
from factloom.sources.tables import table

FLAGSHIP = "term_score"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
TERMS = ["widgets", "cold bolt", "econ", "brass"]
NOW = "2024-03-01 00:00:00"


def _proof(sql: str):
    def add(f):
        if f.__name__ in _QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _part_facts(spark, d) -> DataFrame:
    signals = "stack(3, 'name', 10, p_name, 'type', 6, p_type, 'brand', 5, p_brand) AS (signal, weight, value)"
    return table(spark, d, "part").selectExpr("p_brand AS module", "p_partkey AS ordinal", signals)


_TOK = "list_filter(string_split_regex(lower(regexp_replace(coalesce({}, ''), '([a-z0-9])([A-Z])|([A-Z]+)([A-Z][a-z])', '\\1\\3 \\2\\4', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"
_MATCHED = f"""f AS (SELECT p_brand AS module, p_partkey AS ordinal, u.signal, u.weight, u.value FROM part,
  LATERAL (VALUES ('name', 10, p_name), ('type', 6, p_type), ('brand', 5, p_brand)) AS u(signal, weight, value)),
t AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(TERMS))}) AS v(term_ordinal, term)),
h AS (SELECT f.*, {_TOK.format('value')} AS a FROM f), w AS (SELECT t.*, {_TOK.format('term')} AS b FROM t),
m AS (SELECT h.*, w.term, w.term_ordinal FROM h, w WHERE len(list_filter(range(0, greatest(0, len(a) - len(b) + 1)), lambda s:
  len(list_filter(range(1, len(b) + 1), lambda i: starts_with(a[s + i], b[i]) OR starts_with(b[i], a[s + i]))) = len(b))) > 0),
k AS (SELECT *, count(*) OVER (PARTITION BY module, signal) AS n, row_number() OVER (PARTITION BY module, signal ORDER BY ordinal, term_ordinal) AS r FROM m)"""


@_proof(f"""WITH {_MATCHED}, g AS (SELECT module, CAST(sum(weight) AS BIGINT) AS score,
  coalesce(string_agg(DISTINCT CASE WHEN n > 5 THEN signal END, ',' ORDER BY CASE WHEN n > 5 THEN signal END), '') AS capped FROM k WHERE r <= 5 GROUP BY module)
SELECT *, CASE WHEN score >= 10 THEN 'collision' WHEN score > 0 THEN 'adjacent' ELSE 'greenfield' END AS verdict FROM g""")
def term_score(spark, d):
    return evidence.scores(_part_facts(spark, d), TERMS)


@_proof("SELECT p_brand AS module, count(*) AS parts, 'inventory' AS verdict FROM part GROUP BY 1")
def inventory_mode(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("module")).agg(F.count("*").alias("parts"), F.lit("inventory").alias("verdict"))


@_proof("""WITH u AS (SELECT 'priority' AS param, o_orderpriority AS value FROM orders UNION ALL SELECT 'status', o_orderstatus FROM orders),
n AS (SELECT count(*) AS total FROM orders) SELECT param, value, count(*) AS records, any_value(total) AS total FROM u, n WHERE value IS NOT NULL GROUP BY 1, 2""")
def value_frequency(spark, d):
    orders = table(spark, d, "orders")
    long = orders.selectExpr("stack(2, 'priority', o_orderpriority, 'status', o_orderstatus) AS (param, value)").where("value IS NOT NULL")
    total = orders.agg(F.count("*").alias("total"))  # one row
    return long.groupBy("param", "value").agg(F.count("*").alias("records")).join(F.broadcast(total))


@_proof("""SELECT o_orderkey, count(l_linenumber) AS snapshots, max(l_shipdate) AS last FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1""")
def handle_audit(spark, d):
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("l_linenumber").alias("snapshots"), F.max("l_shipdate").alias("last"))
    return table(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("snapshots", F.lit(0)).alias("snapshots"), "last")


@_proof("""WITH a AS (SELECT o_orderkey, count(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1)
SELECT count(*) AS handles, count(*) FILTER (n = 0) AS never, CAST(coalesce(sum(n), 0) AS BIGINT) AS snapshots FROM a""")
def handle_audit_summary(spark, d):
    return handle_audit(spark, d).agg(F.count("*").alias("handles"), F.count_if(F.col("snapshots") == 0).alias("never"), F.coalesce(F.sum("snapshots"), F.lit(0)).alias("snapshots"))


@_proof("""WITH b AS (SELECT lower(p_name) AS name, min(p_partkey) AS other FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
SELECT p_partkey, lower(p_name) AS name, other FROM part JOIN b ON lower(p_name) = name WHERE p_partkey % 2 = 0""")
def collision_table(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name"))
    return diff.first_match(part.where("p_partkey % 2 = 0"), part.where("p_partkey % 2 = 1"), "name", "p_partkey").select("p_partkey", "name", F.col("other.p_partkey").alias("other"))


@_proof("""SELECT 'references' AS relation, n_name AS child, r_name AS parent FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'referenced_by', r_name, n_name FROM nation JOIN region ON r_regionkey = n_regionkey""")
def fk_edges(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return both.selectExpr("'references' AS relation", "n_name AS child", "r_name AS parent").unionByName(both.selectExpr("'referenced_by' AS relation", "r_name AS child", "n_name AS parent"))


@_proof("""WITH a AS (SELECT DISTINCT lower(p_name || p_size) AS name FROM part WHERE p_partkey % 3 = 0), b AS (SELECT DISTINCT lower(p_name || p_size) AS name FROM part WHERE p_partkey % 3 = 1)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'missing-live' ELSE 'missing-declared' END AS status FROM a FULL JOIN b ON a.name = b.name WHERE a.name IS NULL OR b.name IS NULL""")
def plane_drift(spark, d):
    part = table(spark, d, "part").withColumn("name", F.concat("p_name", F.col("p_size").cast("string")))
    return diff.table_drift(part.where("p_partkey % 3 = 0"), part.where("p_partkey % 3 = 1"))


@_proof("""WITH n AS (SELECT c_nationkey AS k, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT s_suppkey, s_nationkey AS k, 'BUILDING' AS segment, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'bound' END AS status FROM supplier LEFT JOIN n ON k = s_nationkey AND segment = 'BUILDING'""")
def binding_status(spark, d):
    place = "struct({} AS k, {} AS segment) AS place".format
    rows = table(spark, d, "supplier").selectExpr("s_suppkey", place("s_nationkey", "'BUILDING'"))
    return diff.cardinality(rows, table(spark, d, "customer").selectExpr(place("c_nationkey", "c_mktsegment")), "place").select("s_suppkey", "place.*", "status")


@_proof("""WITH a AS (SELECT * FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN '' ELSE 'o_orderstatus' END AS attr
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""")
def surface_diff(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    after = orders.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END"))
    return diff.keyed(orders.where("o_orderkey % 5 <> 0"), after, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@_proof("""SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1""")
def impact_outbound(spark, d):
    changed = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    hit = table(spark, d, "customer").join(changed, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("n").alias("orders"))
    return table(spark, d, "nation").join(hit, F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "customers", "orders")


_WAIVE = f"""e AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'never' WHEN event_id % 4 = 2 THEN '2024-01-01 00:00:00' ELSE '2030-01-01 00:00:00' END AS expires FROM events)"""


@_proof(f"""WITH {_WAIVE} SELECT event_id, coalesce(TRY_CAST(expires AS TIMESTAMP) <= TIMESTAMP '{NOW}', false) AS expired,
CASE WHEN event_type = 'click' THEN coalesce(TRY_CAST(expires AS TIMESTAMP) > TIMESTAMP '{NOW}', false) ELSE true END AS active FROM e""")
def waiver_eval(spark, d):
    e = table(spark, d, "events").withColumn("expires", F.expr("CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'never' WHEN event_id % 4 = 2 THEN '2024-01-01 00:00:00' ELSE '2030-01-01 00:00:00' END"))
    now, mode = F.lit(NOW).cast("timestamp"), F.when(F.col("event_type") == "click", "waive").otherwise("migrate")
    return e.select("event_id", C.waiver_expired(F.col("expires"), now).alias("expired"), C.disposition_active(mode, F.col("expires"), now).alias("active"))


@_proof("""WITH f AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_quantity > 45), w AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_linenumber = 7)
SELECT *, 'open' AS state FROM (SELECT * FROM f EXCEPT SELECT * FROM w) UNION ALL SELECT *, 'waived' FROM (SELECT * FROM f INTERSECT SELECT * FROM w) UNION ALL SELECT *, 'stale' FROM (SELECT * FROM w EXCEPT SELECT * FROM f)""")
def waiver_apply(spark, d):
    rows, keys = table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"]
    found, given = rows.where("l_quantity > 45").select(*keys).distinct(), rows.where("l_linenumber = 7").select(*keys).distinct()
    a, b, c = (x.withColumn("state", F.lit(s)) for x, s in zip(diff.waivers(found, given, keys), ("open", "waived", "stale"), strict=True))
    return a.unionByName(b).unionByName(c)


@_proof("SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'view' AND value > 50")
def set_delta(spark, d):
    e = table(spark, d, "events")
    return diff.set_delta(e.where("event_type = 'view' AND value > 50").select("user_id"), e.where("event_type = 'purchase'").select("user_id"))


@_proof("""SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def gate_latest(spark, d):
    return logs.latest(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_id")


@_proof(f"""WITH l AS (SELECT user_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value > 20) WHERE r = 1)
SELECT c_custkey, CASE WHEN ts IS NULL THEN 'not_run' WHEN event_type = 'click' THEN 'awaiting' WHEN event_type = 'purchase' THEN 'revoked'
WHEN greatest(0, floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(ts))) > 86400 * 30 THEN 'stale' ELSE 'pass' END AS status FROM customer LEFT JOIN l ON user_id = c_custkey""")
def gate_eval(spark, d):
    last = logs.latest(table(spark, d, "events").where("value > 20").select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_id")
    event = F.when(F.col("event_type") == "click", "awaiting").when(F.col("event_type") == "purchase", "revoke").when(F.col("event_type").isNotNull(), "pass")
    joined = table(spark, d, "customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("user_id"), "left")
    return joined.select("c_custkey", logs.gate_status(F.lit(NOW).cast("timestamp"), F.col("ts"), event, 30 * 24 * 60).alias("status"))


@_proof("""WITH h AS (SELECT conv_id, turn, sha256(coalesce(text, '')) AS digest FROM conversations), p AS (SELECT *, CASE WHEN turn % 5 = 4 THEN 'x' ELSE lag(digest) OVER (PARTITION BY conv_id ORDER BY turn) END AS prev FROM h)
SELECT conv_id, turn, prev IS NOT DISTINCT FROM lag(digest) OVER w AS linked, coalesce(turn - lag(turn) OVER w = 1, true) AS contiguous FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def chain_verify(spark, d):
    h = table(spark, d, "conversations").select("conv_id", "turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    before = F.lag("digest").over(Window.partitionBy("conv_id").orderBy("turn"))
    log = h.withColumn("prev", F.when(F.col("turn") % 5 == 4, "x").otherwise(before))
    return logs.chain_breaks(log, "conv_id", "turn", "digest", "prev").select("conv_id", "turn", "linked", "contiguous")


@_proof("""SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM orders) WHERE o_totalprice <= highest""")
def fencing_faults(spark, d):
    return logs.fencing_faults(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey", "o_totalprice")


@_proof("""WITH r AS (SELECT *, lead(p_retailprice) OVER w AS second, row_number() OVER w AS r FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey))
SELECT p_brand, p_partkey, p_retailprice, p_retailprice - second AS gap, coalesce(p_retailprice - second < 5, false) AS ambiguous FROM r WHERE r = 1""")
def topk_gap(spark, d):
    return evidence.score_gap(table(spark, d, "part"), "p_brand", "p_retailprice", "p_partkey", 5)


@_proof("""SELECT source, doc_id, n_chars, used FROM (SELECT source, doc_id, n_chars, CAST(sum(CASE WHEN n_chars <= 5000 THEN n_chars ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS used FROM documents) WHERE n_chars <= 5000 AND used <= 40000""")
def prefix_budget(spark, d):
    return logs.prefix_budget(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 40000, 5000)


_LINES = "(SELECT l_suppkey, l_partkey, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS next_supp FROM lineitem)"
_DEPENDENTS = f"""d AS (SELECT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst FROM {_LINES}
  UNION SELECT 'part:' || l_partkey, 'supplier:' || next_supp FROM {_LINES} WHERE next_supp IS NOT NULL)"""
_FIRST = "SELECT 'supplier:' || min(l_suppkey) AS node, CAST(0 AS BIGINT) AS dist FROM lineitem HAVING count(*) > 0"


def _dependents(spark, d) -> DataFrame:
    """Edges of every row of lineitem, each once: a supplier to its part, the part to the supplier of the order's next line."""
    return _dependencies(spark, d).distinct()


def _dependencies(spark, d) -> DataFrame:
    """The edges of _dependents from one pass over the lines, repeated ones too."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    lines = table(spark, d, "lineitem").withColumn("next_supp", F.lead("l_suppkey").over(order))
    supplier, part, following = (F.concat(F.lit(kind), F.col(c).cast("string")) for kind, c in (("supplier:", "l_suppkey"), ("part:", "l_partkey"), ("supplier:", "next_supp")))
    edge = lambda src, dst: F.struct(src.alias("src"), dst.alias("dst"))
    return lines.select(F.inline(F.when(F.col("next_supp").isNull(), F.array(edge(supplier, part))).otherwise(F.array(edge(supplier, part), edge(part, following)))))


def _first_supplier(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.min("l_suppkey").alias("k")).where("k IS NOT NULL").select(F.concat(F.lit("supplier:"), F.col("k").cast("string")).alias("node"))


@_proof(f"""WITH RECURSIVE {_DEPENDENTS}, r(node, dist) USING KEY (node) AS ({_FIRST}
  UNION SELECT d.dst, min(r.dist) + 1 FROM r JOIN d ON d.src = r.node WHERE d.dst NOT IN (SELECT node FROM recurring.r) GROUP BY 1)
SELECT node, dist FROM r""")
def dependency_closure(spark, d):
    return graph.hops(_dependents(spark, d), _first_supplier(spark, d))


@_proof(f"""WITH RECURSIVE {_DEPENDENTS}, r(node, dist) USING KEY (node) AS (SELECT DISTINCT 'supplier:' || s_suppkey, CAST(0 AS BIGINT) FROM supplier WHERE s_acctbal < 0
  UNION SELECT d.dst, min(r.dist) + 1 FROM r JOIN d ON d.src = r.node WHERE d.dst NOT IN (SELECT node FROM recurring.r) GROUP BY 1)
SELECT node, dist FROM r""")
def invalidation_closure(spark, d):
    edges = _dependents(spark, d)
    nodes = edges.selectExpr("explode(array(src, dst)) AS node")
    return graph.invalidated(edges, nodes, table(spark, d, "supplier").where("s_acctbal < 0").selectExpr("'supplier:' || s_suppkey AS node"))


@_proof(f"""WITH {_DEPENDENTS}, b AS (SELECT src, dst FROM d UNION SELECT dst, src FROM d), s AS (SELECT node FROM ({_FIRST})), one AS (SELECT DISTINCT dst AS node FROM b WHERE src IN (FROM s) AND dst NOT IN (FROM s)),
two AS (SELECT DISTINCT dst AS node FROM b WHERE src IN (FROM one) AND dst NOT IN (FROM one) AND dst NOT IN (FROM s)) SELECT * FROM (SELECT CAST(0 AS BIGINT) AS ring, count(*) AS nodes FROM s UNION ALL SELECT 1, count(*) FROM one UNION ALL SELECT 2, count(*) FROM two) WHERE nodes > 0""")
def bfs_rings(spark, d):
    return graph.hops(graph.undirected(_dependencies(spark, d)), _first_supplier(spark, d), 2).groupBy(F.col("dist").alias("ring")).agg(F.count("*").alias("nodes"))


@_proof(f"""WITH RECURSIVE {_DEPENDENTS}, b AS (SELECT src, dst FROM d UNION SELECT dst, src FROM d), r(node, dist) USING KEY (node) AS ({_FIRST}
  UNION SELECT b.dst, min(r.dist) + 1 FROM r JOIN b ON b.src = r.node WHERE b.dst NOT IN (SELECT node FROM recurring.r) GROUP BY 1)
SELECT dist AS ring, count(*) AS nodes FROM r GROUP BY 1""")
def dependency_rings(spark, d):
    return graph.hops(graph.undirected(_dependencies(spark, d)), _first_supplier(spark, d)).groupBy(F.col("dist").alias("ring")).agg(F.count("*").alias("nodes"))


@_proof("""SELECT s_suppkey, s_nationkey AS k, CASE count(c_custkey) WHEN 0 THEN 'missing' WHEN 1 THEN 'bound' ELSE 'ambiguous' END AS status
FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey GROUP BY s_suppkey, s_nationkey""")
def binding_status_whole(spark, d):
    rows = table(spark, d, "supplier").selectExpr("s_suppkey", "s_nationkey AS k")
    return diff.cardinality(rows, table(spark, d, "customer").selectExpr("c_nationkey AS k"), "k")


@_proof("""SELECT n_name, max(CASE WHEN c_mktsegment = 'BUILDING' THEN s END) AS building, max(CASE WHEN c_mktsegment = 'MACHINERY' THEN s END) AS machinery FROM (
SELECT n_name, c_mktsegment, CASE WHEN bool_or(c_acctbal < 0) AND bool_or(c_acctbal >= 0) THEN 'conflict' WHEN bool_or(c_acctbal >= 0) THEN 'supported' ELSE 'unsupported' END AS s
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2) GROUP BY 1""")
def support_pivot(spark, d):
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    state = F.when(F.bool_or(F.col("c_acctbal") < 0) & F.bool_or(F.col("c_acctbal") >= 0), "conflict").when(F.bool_or(F.col("c_acctbal") >= 0), "supported").otherwise("unsupported")
    states = rows.groupBy("n_name", "c_mktsegment").agg(state.alias("state"))  # an absent pair stays null
    return states.groupBy("n_name").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.max("state")).select("n_name", *(F.col(a).alias(a.lower()) for a in ("BUILDING", "MACHINERY")))


@_proof("""SELECT l_orderkey, l_linenumber, l_quantity % 2 = 0 AS even, l_discount <= 0.05 AS small, l_tax < l_discount AS below, l_returnflag IN ('A', 'N') AS known FROM lineitem""")
def rules_check(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rules.field("l_quantity", "multipleOf", 2).alias("even"), rules.field("l_discount", "maximum", 0.05).alias("small"),
                                              rules.cross("l_tax", "lt", "l_discount").alias("below"), rules.field("l_returnflag", "enum", ["A", "N"]).alias("known"))


@_proof("""SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) / nullif(l_quantity - 1, 0) AS unit FROM lineitem""")
def derived_cols(spark, d):
    tree = ["div", ["mul", {"ref": "l_extendedprice"}, ["sub", {"const": 1}, {"ref": "l_discount"}]], ["sub", {"ref": "l_quantity"}, {"const": 1}]]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rules.derived(tree).alias("unit"))


@_proof("""SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END) = 2""")
def promotable_keys(spark, d):
    wanted = F.count_distinct(F.when(F.col("o_orderstatus").isin("F", "O"), F.col("o_orderstatus")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(wanted.alias("n")).where("n = 2").select("o_custkey")


@_proof("""SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) > 1 AS duplicate FROM part""")
def first_wins(spark, d):
    return diff.first_wins(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@_proof("""SELECT event_type AS contract, count(*) AS receipts, count(*) FILTER (value > 50) AS matched, count(*) FILTER (NOT value > 50) AS stale, count(DISTINCT user_id) FILTER (value > 50) AS operations FROM events GROUP BY 1""")
def receipt_conformance(spark, d):
    hit = F.col("value") > 50
    return table(spark, d, "events").groupBy(F.col("event_type").alias("contract")).agg(F.count("*").alias("receipts"), F.count_if(hit).alias("matched"), F.count_if(~hit).alias("stale"), F.count_distinct(F.when(hit, F.col("user_id"))).alias("operations"))


@_proof("""SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, '["\\n\\r,-]') THEN '"' || replace(o_orderpriority, '"', '""') || '"' ELSE coalesce(o_orderpriority, '') END AS field FROM orders""")
def csv_projection(spark, d):
    c = F.col("o_orderpriority")
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return table(spark, d, "orders").select("o_orderkey", F.when(c.rlike('["\n\r,-]'), quoted).otherwise(F.coalesce(c, F.lit(""))).alias("field"))


@_proof("""WITH a AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 7 <> 0)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'deleted' ELSE 'modified' END AS status
FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_name IS DISTINCT FROM b.p_name OR a.p_size IS DISTINCT FROM b.p_size""")
def file_delta(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    after = part.where("p_partkey % 7 <> 0").withColumn("p_size", F.expr("IF(p_partkey % 3 = 0, p_size + 1, p_size)"))
    return diff.file_delta(part.where("p_partkey % 5 <> 0"), after, "p_partkey", ["p_name", "p_size"])


@_proof("""WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 2),
n AS (SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS matched, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_right)
SELECT *, matched / nullif(matched + only_left, 0) AS "precision", matched / nullif(matched + only_right, 0) AS recall FROM n""")
def route_agreement(spark, d):
    rows = table(spark, d, "lineitem")
    return diff.agreement(rows.where("l_linenumber = 1"), rows.where("l_linenumber = 2"), ["l_partkey", "l_suppkey"])


@_proof(f"""SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '{NOW}' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def unreachable_items(spark, d):
    reached = table(spark, d, "lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey AS o_orderkey")
    return diff.unreachable(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), reached, "o_orderkey", "o_orderdate", NOW)


_PATHS = "p AS (SELECT p_partkey, p_brand || '/' || p_size || '/' || p_partkey AS path FROM part), r AS (SELECT DISTINCT p_brand || '/' || p_size AS root FROM part WHERE p_size % 2 = 0 UNION SELECT DISTINCT p_brand FROM part WHERE p_size > 40)"


def _roots(spark, d) -> DataFrame:
    part = table(spark, d, "part")
    return part.where("p_size % 2 = 0").selectExpr("p_brand || '/' || p_size AS root").unionByName(part.where("p_size > 40").selectExpr("p_brand AS root"))


@_proof(f"WITH {_PATHS} SELECT p_partkey, path, arg_max(root, length(root)) AS root FROM p LEFT JOIN r ON starts_with(path, root || '/') GROUP BY 1, 2")
def nearest_root(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", "p_brand || '/' || p_size || '/' || p_partkey AS path")
    return paths.nearest_root(rows, "path", _roots(spark, d), "root")


@_proof(f"WITH {_PATHS} SELECT root FROM r WHERE NOT EXISTS (SELECT 1 FROM r s WHERE starts_with(r.root, s.root || '/'))")
def scope_cover(spark, d):
    return paths.uncovered(_roots(spark, d), "root")


@_proof("""SELECT p_brand AS prefix, bool_or(NOT (p = p_brand OR starts_with(p, p_brand || '/'))) AS unreflected FROM (SELECT p_brand, CASE WHEN p_partkey % 50 = 0 THEN p_brand || 'x/' ELSE p_brand || '/' END || p_partkey AS p FROM part) GROUP BY 1""")
def prefix_reflected(spark, d):
    rows = table(spark, d, "part").selectExpr("p_brand AS prefix", "IF(p_partkey % 50 = 0, p_brand || 'x/', p_brand || '/') || p_partkey AS path")
    return paths.unreflected(rows, "prefix", "path")


@_proof("""WITH p AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS path FROM part) SELECT lower(path) AS folded, count(DISTINCT path) AS spellings FROM p GROUP BY 1 HAVING count(DISTINCT path) > 1""")
def case_collisions(spark, d):
    return paths.case_collisions(table(spark, d, "part").select(F.expr("IF(p_partkey % 2 = 0, upper(p_name), p_name)").alias("path")), "path")


@_proof("""SELECT k.event_type, count(e.event_id) AS n FROM (VALUES ('view'), ('click'), ('purchase'), ('never')) AS k(event_type) LEFT JOIN events e ON e.event_type = k.event_type GROUP BY 1""")
def kind_counts(spark, d):
    return logs.kind_counts(table(spark, d, "events"), "event_type", ["view", "click", "purchase", "never"])


@_proof("""SELECT user_id, event_id, was, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was <> event_type AND was || '>' || event_type NOT IN ('view>click', 'click>purchase')""")
def transition_rule(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return logs.forbidden_moves(e, "user_id", ["ts", "event_id"], "event_type", [("view", "click"), ("click", "purchase")]).select("user_id", "event_id", "was", "event_type")


@_proof("""SELECT user_id, event_id, event_type, bound FROM (SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bound FROM events) WHERE event_type <> bound""")
def mode_binding(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return logs.mode_faults(e, "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "bound")


@_proof("""SELECT l_orderkey, arg_min(l_returnflag, l_linenumber * 1000 + ascii(l_returnflag)) FILTER (l_quantity > 40) AS l_returnflag FROM lineitem GROUP BY 1""")
def first_blocking(spark, d):
    return logs.first_blocking(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_linenumber", F.col("l_quantity") > 40)


@_proof("""SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'blocked' WHEN bool_or(o_orderstatus = 'P') THEN 'partial' ELSE 'complete' END AS class FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def contract_class(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return logs.contract_class(table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left"), "c_custkey", F.col("o_orderstatus") == "P")


@_proof(f"""WITH {_MATCHED}, g AS (SELECT module, CAST(sum(weight) AS BIGINT) AS score FROM k WHERE r <= 5 GROUP BY module)
SELECT module, score FROM g WHERE score >= 25 ORDER BY score DESC, module LIMIT 4""")
def top_sources(spark, d):
    return evidence.top_sources(evidence.scores(_part_facts(spark, d), TERMS).select("module", "score"), "score", "module")


_STATE = "CASE WHEN c_acctbal < 0 THEN 'unsupported' WHEN c_acctbal < 2500 THEN 'partial' WHEN c_acctbal < 4000 THEN 'not-applicable' ELSE 'supported' END"
_SEGMENTS = ["BUILDING", "MACHINERY"]


def _cell(segment: str) -> str:
    n = lambda s: f"count(*) FILTER (c_mktsegment = '{segment}' AND s = '{s}')"
    kinds = f"count(DISTINCT s) FILTER (c_mktsegment = '{segment}')"
    return f"""CASE {kinds} WHEN 0 THEN 'unknown' WHEN 1 THEN max(s) FILTER (c_mktsegment = '{segment}') ELSE
CASE WHEN {n("supported")} > 0 AND {n("unsupported")} > 0 THEN 'conflict' WHEN {n("partial")} + {n("supported")} > 0 THEN 'partial' ELSE 'unsupported' END END AS "{segment}\""""


@_proof(f"SELECT n_name, {', '.join(map(_cell, _SEGMENTS))} FROM (SELECT *, {_STATE} AS s FROM customer) JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def support_matrix(spark, d):
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return evidence.support_matrix(rows.withColumn("s", F.expr(_STATE)), "n_name", "c_mktsegment", "s", _SEGMENTS)


_FIELDS = {"documents": ["doc_id", "lang", "source", "n_chars", "text"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]}


def _csv_sql(name: str, key: str) -> str:
    texts = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in _FIELDS[name])
    special = " OR ".join(f"contains(x, {c})" for c in ("chr(34)", "chr(44)", "chr(13)", "chr(10)"))
    return f"SELECT {key}, array_to_string(list_transform([{texts}], lambda x: CASE WHEN {special} THEN chr(34) || replace(x, chr(34), repeat(chr(34), 2)) || chr(34) ELSE x END), ',') AS record FROM {name}"


@_proof(_csv_sql("documents", "doc_id"))
def csv_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", C.csv_record(*map(F.col, _FIELDS["documents"])).alias("record"))


@_proof(_csv_sql("orders", "o_orderkey"))
def csv_orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.csv_record(*map(F.col, _FIELDS["orders"])).alias("record"))


@_proof(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (length(CAST({c} AS VARCHAR)) > 0) AS populated FROM documents" for c in _FIELDS["documents"]))
def csv_populated(spark, d):
    return evidence.populated(table(spark, d, "documents"), _FIELDS["documents"])
