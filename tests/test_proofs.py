"""Every proof query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from factloom.functions import columns
from factloom.operators import evidence, graph, logs, routes, rules
from factloom.plans import proofs

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(tuple, df.where(df.notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(proofs.queries()))
def test_matches_sql(spark, duck, name):
    got, want = proofs.queries()[name](spark, str(DATA)).toPandas(), duck.sql(proofs.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_cycles_are_what_peeling_leaves(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4)], "src long, dst long")
    assert {r["node"] for r in graph.on_cycles(edges).collect()} >= {2, 3}
    assert graph.on_cycles(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")).count() == 0


def test_prefix_budget_stops_at_the_first_misfit(spark):
    files = spark.createDataFrame([("k", 1, 40), ("k", 2, 900), ("k", 3, 70), ("k", 4, 20)], "k string, o long, s long")
    assert [r["o"] for r in logs.prefix_budget(files, "k", "o", "s", 100, 500).orderBy("o").collect()] == [1]


def test_literal_zero_divisor_is_refused():
    with pytest.raises(ValueError):
        rules.derived(["div", {"ref": "a"}, {"const": 0}])


def test_dependency_queries_reach_past_twenty_edges_and_keep_every_id(spark, tmp_path):
    lines = [(1, i, 1000 + i, 200 + i) for i in range(1, 16)] + [(2, 3, 5000, 300)]  # one order of 15 lines: 29 edges in a row
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {f"supplier:{200 + i}": 2 * i - 2 for i in range(1, 16)} | {f"part:{1000 + i}": 2 * i - 1 for i in range(1, 16)}
    assert {r["node"]: r["dist"] for r in proofs.queries()["dependency_closure"](spark, str(tmp_path)).collect()} == want
    assert {r["ring"]: r["nodes"] for r in proofs.queries()["dependency_rings"](spark, str(tmp_path)).collect()} == {k: 1 for k in range(30)}


def test_binding_sees_the_whole_catalog(spark, tmp_path):
    spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, 10), (2, 11), (3, 11)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = proofs.queries()["binding_status_whole"](spark, str(tmp_path)).collect()
    assert {r["s_suppkey"]: r["status"] for r in got} == {1: "bound", 2: "ambiguous", 3: "missing"}


def test_tokens_split_camel_case(spark):
    rows = spark.createDataFrame([(1, "APIController orgId2Name"), (2, None), (3, "cold_BOLT")], "i int, s string").select("i", columns.tokens("s").alias("t"))
    assert [r["t"] for r in rows.orderBy("i").collect()] == [["api", "controller", "org", "id2", "name"], [], ["cold", "bolt"]]
    facts = spark.createDataFrame([("m", "name", 10, 1, "APIController")], "module string, signal string, weight int, ordinal long, value string")
    assert evidence.matches(facts, ["controller"]).count() == 1


def test_top_sources_has_a_threshold_and_four_places(spark):
    scored = spark.createDataFrame([("a", 24), ("b", 25), ("e", 30), ("d", 30), ("c", 99), ("f", 26)], "path string, score int")
    assert [r["path"] for r in evidence.top_sources(scored, "score", "path").collect()] == ["c", "d", "e", "f"]


def test_combined_states(spark):
    cases = [
        ([], "unknown"), (["conflict"], "conflict"), (["partial", "unknown"], "unknown"), (["unknown", "conflict"], "conflict"), (["supported", "unsupported", "partial"], "conflict"),
        (["supported", "not-applicable"], "partial"), (["unsupported", "partial"], "partial"), (["unsupported", "not-applicable"], "unsupported"), (["supported"], "supported"),
    ]
    rows = [("r", f"c{i}", s) for i, (states, _) in enumerate(cases) for s in states]
    got = evidence.support_matrix(spark.createDataFrame(rows, "k string, c string, s string"), "k", "c", "s", [f"c{i}" for i in range(len(cases))]).first()
    assert list(got)[1:] == [want for _, want in cases]


def test_invalidation_starts_from_every_changed_node(spark):
    edges = spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long")
    nodes, changed = spark.range(1, 7).toDF("node"), spark.createDataFrame([(1,), (3,)], "node long")
    assert {r["node"] for r in graph.invalidated(edges, nodes, changed).collect()} == {1, 2, 3, 4}
    assert {r["node"] for r in graph.invalidated(edges, nodes, changed.where("false"), True).collect()} == set(range(1, 7))


def test_csv_quotes_no_more_than_it_must(spark):
    rows = [(1, "5-LOW", "a,b"), (2, 'say "x"', "two\nlines"), (3, None, "cr\rhere"), (4, "", "plain")]
    made = spark.createDataFrame(rows, "k int, a string, b string")
    got = [r["line"] for r in made.select("k", columns.csv_record(*(made[c] for c in "kab")).alias("line")).orderBy("k").collect()]
    assert got == ['1,5-LOW,"a,b"', '2,"say ""x""","two\nlines"', '3,,"cr\rhere"', "4,,plain"]
    assert {r["field"]: r["populated"] for r in evidence.populated(made, ["k", "a", "b"]).collect()} == {"k": 4, "a": 2, "b": 4}


def test_endpoints_against_a_document(spark):
    """Each kind of outcome, with the prefix inferred or not."""
    e = lambda *rows: spark.createDataFrame(rows, "key string, verb string, path string, operation_id string")
    o = lambda *rows: spark.createDataFrame(rows, "verb string, path string, operation_id string")
    ends = e(("matched", "GET", "/organizations/{id}", "findOrganization"), ("verb", "GET", "/widgets/{id}", "findWidget"), ("path", "GET", "/gizmos", "findGizmo"), ("missing", "GET", "/ghosts", "findGhost"),
             ("adopted", "POST", "/w/:id([0-9]+)", None), ("nameless", "POST", "/gadgets", None), ("nothing", "GET", "/nothing", None), ("ambiguous", "GET", "/reports", None))
    ops = o(("GET", "/api/v0/organizations/{id}", "findOrganization"), ("POST", "/api/v0/widgets/{id}", "findWidget"), ("GET", "/totally/unrelated", "findGizmo"), ("POST", "/api/v0/w/{key}", "createW"),
            ("POST", "/api/v0/gadgets", None), ("GET", "/api/v0/reports", "a"), ("GET", "/reports", "b"))
    prefix = routes.inferred_prefix(routes.prefix_deltas(ends, ops))
    assert tuple(prefix.first()) == ("/api/v0", "inferred", "")
    got = {r["key"]: (r["kind"], r["reason"], r["operation"]) for r in routes.reconcile(ends, ops, prefix).collect()}
    assert got == {
        "matched": ("matched", "", "findOrganization"), "verb": ("drift", "verb", None), "path": ("drift", "path", None), "missing": ("missing", "", None), "adopted": ("adopted", "", "createW"),
        "nameless": ("unresolved", "document-missing-operation-id", None), "nothing": ("unresolved", "no-candidate", None), "ambiguous": ("ambiguous", "", None),
    }
    none = routes.inferred_prefix(routes.prefix_deltas(ends.where("false"), ops))
    got = {r["key"]: r["reason"] for r in routes.reconcile(e(("k", "GET", "/nothing", None)), ops, none).collect()}
    assert got == {"k": "prefix-inconclusive"}


def test_overall_verdict_is_greenfield_without_a_match(spark):
    facts = spark.createDataFrame([("m", "name", 10, 1, "APIController"), ("n", "name", 5, 1, "other")], "module string, signal string, weight int, ordinal long, value string")
    scored = evidence.scores(facts, ["nothing"])
    assert evidence.overall_verdict(scored).first()["verdict"] == "greenfield"
    assert [tuple(r) for r in evidence.module_verdicts(scored, facts).collect()] == [("m", 0, "greenfield"), ("n", 0, "greenfield")]
    assert evidence.overall_verdict(evidence.scores(facts, ["other"])).first()["verdict"] == "adjacent"
