"""Work that must not grow faster than the input: rows that joins make, partitions that hold the work, tables sent to every task."""

from pyspark.sql import functions as F

from factloom.operators import context, decisions, graph, ownership, routes
from factloom.plans import frameworks, structures
from factloom.sources import delimiters, protocols
from factloom.sources.tables import tasks_for


def nodes(plan):
    """Every node of a plan that has run, those of its finished stages too."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
        return
    yield plan
    if name.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def most_joined(df):
    """df's rows, and the most rows that one of its joins made."""
    got = df.collect()
    joins = [n for n in nodes(df._jdf.queryExecution().executedPlan()) if "Join" in n.getClass().getSimpleName()]
    return got, max(n.metrics().apply("numOutputRows").value() for n in joins)


def test_reconciliation_of_one_route_that_all_share(spark):
    n = 400
    ends = spark.range(n).selectExpr("id AS key", "'GET' AS verb", "'/w/{id}' AS path", "CAST(NULL AS STRING) AS operation_id")
    ops = spark.range(n).selectExpr("'GET' AS verb", "'/api/w/:id' AS path", "'op' || id AS operation_id")
    got, most = most_joined(routes.reconcile(ends, ops, spark.createDataFrame([("/api",)], "value string")))
    assert len(got) == n and {(r["kind"], r["reason"], r["operation"]) for r in got} == {("ambiguous", "", None)}
    assert most <= 4 * n


def test_owners_of_a_scope_given_many_times(spark):
    n = 400
    paths = spark.range(n).selectExpr("IF(id % 2 = 0, 'A', 'a') || '/1/f' || id AS path")
    owners = spark.range(n).selectExpr("'A/1' AS scope", "'o' || id % 3 AS owner")
    got, most = most_joined(ownership.classified(paths, "path", paths.limit(0).select(F.col("path").alias("scope")), owners))
    assert {(r["path"][0], r["class"], r["owners"]) for r in got} == {("A", "multiple", "o0,o1,o2"), ("a", "case-fold", "o0,o1,o2")}
    assert most <= 4 * n


def kinds(df):
    df.collect()
    return [n.getClass().getSimpleName() for n in nodes(df._jdf.queryExecution().executedPlan())]


def test_texts_are_not_sent_to_every_task(spark):
    operations = spark.createDataFrame([("r", "loadWidget", "GET", "/api/widget")], "repo string, operation_id string, verb string, path string")
    files = spark.createDataFrame([("r", "src/widget.py", "def loadWidget(a):")], "repo string, path string, text string")
    got = context.scored(operations, files)
    assert "SortMergeJoinExec" in kinds(got) and got.count() == 1


def test_aliases_are_not_sent_to_every_task(spark):
    got = graph.alias_targets(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "x")], "name string, next string"))
    assert "BroadcastExchangeExec" not in kinds(got) and {tuple(r) for r in got.collect()} == {("a", "c"), ("b", "c"), ("x", None)}


def test_texts_of_one_partition_are_dealt_before_their_tokens(spark):
    texts = spark.range(40).selectExpr("id AS k", "'a(b,c){x; y}' AS t").coalesce(1)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = delimiters.delimiters(texts, ["k"], F.col("t"))
    assert rows.rdd.getNumPartitions() == n and rows.count() == 40 * 7
    opens, pieces = delimiters.scopes(texts, ["k"], F.col("t"))
    assert opens.where("closed AND head = 'a(b,c)'").count() == 40 and pieces.where("scope IS NOT NULL").count() == 80


def test_rows_of_one_small_file_are_dealt_before_their_texts(spark):
    assert frameworks._texts(spark, "/root/testdata/sf0.001", "p_name").rdd.getNumPartitions() > 1


def test_decisions_are_not_dealt_by_their_values(spark):
    made = frameworks._decided(spark, "/root/testdata/sf0.001", dealt=True)[1]
    known = spark.createDataFrame([], "id string, security_state string, security_reason string, request_state string, request_reason string, response_state string, response_reason string, error_state string, error_reason string")
    root = F.struct(F.lit("unknown").alias("state"), F.lit(None).cast("string").alias("value"), F.lit("r").alias("reason"))
    got = decisions.with_context(made, "id", spark.createDataFrame([("op1",), ("GET",)], "operation_id string"), known, F.lit("o1"), root).where("id IS NOT NULL")
    n = made.count()
    assert got.count() == n and got.where("reason = 'duplicate-openapi-operation-id' AND field <> 'operation.identity'").isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" in plan and not any("value#" in x and "LeftOuter" in x for x in plan.split("\n"))


def test_cases_of_decisions_are_made_once(spark):
    rows, made = frameworks._decided(spark, "/root/testdata/sf0.001")
    assert made.count() == 7 * rows.count()
    plan = made._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert any("Generate" in x for x in plan) and not any("array(struct" in x for x in plan if "Generate" in x or "Filter" in x)


def test_lines_of_contracts_are_made_distinct_once(spark):
    read = structures._built(spark, "/root/testdata/sf0.001")[2]._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in "".join(x for x in read.split("\n") if "Aggregate" in x) and read.count("l_linenumber") <= 2


def test_edges_both_ways_are_one_before_they_are_turned(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), (None, "a"), ("a", None)], "src string, dst string")
    got = graph.undirected(edges)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [("a", "b"), ("b", "a"), ("c", "c"), (None, "a"), ("a", None)]))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")


def test_short_aliases_end_their_doubling(spark, monkeypatch):
    written, write = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df, **k: written.append(1) or write(df, **k))
    chains = spark.range(64).selectExpr("'a' || id AS name", "'b' || id AS next")
    assert graph.alias_targets(chains).where("target = 'b' || substr(name, 2)").count() == 64 and len(written) == 1


def test_calls_of_several_kinds_come_from_one_pass(spark):
    texts = spark.createDataFrame([(1, "f(a, g(b), (c)) h(x f(y)"), (2, "g(1) f(")], "id long, t string")
    kinds_ = {"f": r"\bf", "g": r"\bg", "h": r"\bh"}
    got = delimiters.calls_of(texts, ["id"], F.col("t"), kinds_)
    one = [(kind, *map(str, r)) for kind, header in kinds_.items() for r in delimiters.calls(texts, ["id"], F.col("t"), header).select("id", "at", "head", "args").collect()]
    assert sorted((r["kind"], *map(str, (r["id"], r["at"], r["head"], r["args"]))) for r in got.collect()) == sorted(one)
    assert {(x[0], x[1], x[4]) for x in one} == {("f", "1", "['a', 'g(b)', '(c)']"), ("f", "1", "['y']"), ("g", "1", "['b']"), ("g", "2", "['1']")}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1


def in_their_rows(df):
    """Whether texts are dealt and grouped by file alone: one sort, no window, no join, nothing shuffled after the texts."""
    made = kinds(df)
    return made.count("SortExec") <= 1 and made.count("ShuffleExchangeExec") <= 1 and not any("Window" in x or "Join" in x for x in made)


def test_declarations_of_protobuf_are_found_in_their_texts_rows(spark, monkeypatch):
    for module in (delimiters, protocols):
        monkeypatch.setattr(module, "durable", lambda df, **k: df)
    texts = spark.range(20).selectExpr("'f' || id AS path", "'message A { oneof o { int32 b = 1; } message C { int32 d = 2; } } service S { rpc Do (A) returns (A); }' AS text")
    out = protocols.protobuf(texts, "path", "text")
    assert [out[x].count() for x in ("fields", "methods", "warnings")] == [40, 20, 40]
    assert all(in_their_rows(out[x]) for x in ("files", "messages", "fields", "values", "methods"))
    assert not any("Window" in x or "Join" in x for x in kinds(out["warnings"]))


def test_declarations_of_graphql_are_found_in_their_texts_rows(spark, monkeypatch):
    for module in (delimiters, protocols):
        monkeypatch.setattr(module, "durable", lambda df, **k: df)
    texts = spark.range(20).selectExpr("'g' || id AS path", "'schema { query: R } type R { a(x: I = {b: 1}): Int c: D } type R { d: R } scalar D scalar D type O {' AS text")
    out = protocols.graphql(texts, "path", "text")
    assert [out[x].count() for x in ("types", "fields", "operations", "warnings")] == [60, 60, 60, 20]
    assert all(in_their_rows(df) for df in out.values())


def test_long_and_deep_texts_are_folded_whole(spark):
    n = 4 * delimiters._STRETCH
    texts = spark.createDataFrame([(1, "a{b;" * n + "}" * n), (2, "a{b;}" * n), (3, "}" * n + "{" * n)], "id long, t string")
    opens, pieces = delimiters.scopes(texts, ["id"], F.col("t"))
    deep = opens.where("id = 1 AND closed AND parent <=> IF(depth = 0, NULL, pos - 4) AND pos = 4 * depth + 1")
    assert [deep.count(), opens.where("id = 2 AND closed AND parent IS NULL").count(), opens.where(f"id = 3 AND NOT closed AND depth = pos - {n}").count()] == [n, n, n]
    assert [pieces.where("id = 1 AND text = 'b' AND scope = pos - 1").count(), pieces.where("id = 2 AND at % 5 IN (0, 2)").count(), pieces.where("id = 3").count()] == [n, 2 * n, 0]


def below(plan):
    """The names of the nodes under a node of a plan that has run."""
    return [n.getClass().getSimpleName() for n in list(nodes(plan))[1:]]


def test_decisions_in_context_are_neither_dealt_nor_sorted(spark):
    got = frameworks.context_decisions(spark, "/root/testdata/sf0.001")
    assert got.count() == 7 * spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    got.collect()
    moved = [n for n in nodes(got._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName() in ("ShuffleExchangeExec", "SortExec", "SortMergeJoinExec", "SortAggregateExec")]
    assert moved and not any("GenerateExec" in below(n) for n in moved)


def test_tasks_grow_with_the_rows(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [tasks_for(spark.range(r), 10) for r in (0, 10 * n, 10 * n + 1, 30 * n)] == [n, n, n + 1, 3 * n] and tasks_for(spark.range(99 * n)) == n


def test_results_in_context_are_as_their_decisions_are(spark):
    row = "id string, kind string, drift string, operation_id string, synthesized boolean, verb string, path string, scan_verb string, scan_path string, cause string, request string, response string, error string, request_cause string, response_cause string, error_cause string, security array<string>, security_cause string, source_ref string, openapi_ref string, candidates array<struct<operation_id:string,path:string>>"
    made = lambda id_, kind, op, drift=None, security=None, path="/a": (id_, kind, drift, op, False, "GET", path, "GET", "/a", None, None, None, None, None, None, None, security, None, "s", "o", None)
    results = spark.createDataFrame([
        made("1", "matched", "twice"), made("1", "adopted", "once"), made("1", "matched", "twice", security=[]), made("2", "drift", "twice", "path", path="/b"), made("3", "missing", "twice"),
        made(None, "matched", "twice"), made("4", "matched", None), made("5", "unresolved", ""), made("6", "ambiguous", "twice")], row)
    duplicates = spark.createDataFrame([("twice",), ("twice",), (None,)], "operation_id string")
    known = spark.createDataFrame([
        ("1", "operation", None, "absent", "a", "present", None, "skipped", "c"), ("1", "inherit", None, "unknown", None, "present", None, None, None), ("4", "inherit", None, "unknown", None, None, "x", "unknown", "y"),
        ("2", "unknown", "bad", "absent", "a", None, None, None, None), (None, "unknown", "no", "absent", "no", "absent", "no", "absent", "no")],
        "id string, security_state string, security_reason string, request_state string, request_reason string, response_state string, response_reason string, error_state string, error_reason string")
    ref, root = F.lit("o1"), F.struct(F.lit("absent").alias("state"), F.lit(None).cast("string").alias("value"), F.lit("r").alias("reason"))
    made_of = lambda rows, **more: decisions.decided(rows, "id", F.lit(""), F.lit(True), **more)
    one = decisions.with_context(made_of(results), "id", duplicates, known, ref, root)
    for tasks in (None, 3):
        rows = decisions.attached(results, "id", decisions.identities(results, "id"), duplicates, known, tasks)
        two = decisions.narrowed(made_of(rows, documented=True), "id", ref, root)
        assert sorted(map(str, two.collect())) == sorted(map(str, one.collect())) and two.columns == one.columns and two.count() == 7 * 9
    told = {(r["id"], r["field"]): (r["state"], r["reason"]) for r in one.where("id <> '1'").collect()}
    assert told["2", "operation.identity"] == ("conflict", "duplicate-openapi-operation-id") and told["2", "api.security.declared"] == ("unknown", "bad")
    assert told["4", "api.security.declared"] == ("absent", "no-operation-or-document-security-declaration") and told["4", "api.error.schema"] == ("unknown", "y") and told["4", "operation.identity"][0] == "resolved"
    first = one.where("id = '1' AND field IN ('operation.identity', 'api.request.schema')").groupBy("field", "state", "reason").count().collect()
    assert {(r["state"], r["reason"], r["count"]) for r in first} == {("conflict", "duplicate-openapi-operation-id", 2), ("resolved", "single-route-adoption", 1), ("unknown", "openapi-schema-presence-unknown", 3)}
    assert one.where("id IS NULL AND reason LIKE 'duplicate%' OR reason = 'no'").isEmpty()
