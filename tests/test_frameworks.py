"""Framework extractors and field decisions on null, empty and odd texts."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import decisions, logs, trust
from factloom.sources import frameworks

EXTRACTORS = [frameworks.spring_endpoints, frameworks.spring_entities, frameworks.spring_enums, frameworks.prefix_signals, frameworks.fastapi_endpoints, frameworks.fastapi_classes, frameworks.rails_actions]


@pytest.mark.parametrize("extract", EXTRACTORS, ids=lambda f: f.__name__)
def test_null_and_empty_texts_give_no_rows(spark, extract):
    files = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 20000)], "id long, text string")
    assert extract(files, "text").count() == 0
    assert extract(files.where("false"), "text").count() == 0


def test_a_controller_without_operations_or_base(spark):
    files = spark.createDataFrame([(1, '@RestController class A { @PutMapping void a() {} @GetMapping({"/b", "/c"}) void b() {} }')], "id long, text string")
    got = sorted((r["class"], r["verb"], r["path"], r["operation_id"]) for r in frameworks.spring_endpoints(files, "text").collect())
    assert got == [("A", "GET", "/b", None), ("A", "PUT", "/", None)]


def test_the_last_router_of_a_name_counts(spark):
    files = spark.createDataFrame([(1, 'r = APIRouter(prefix="/a")\nr = APIRouter()\n@r.get("x")\ndef f(): pass')], "id long, text string")
    assert [r["path"] for r in frameworks.fastapi_endpoints(files, "text").collect()] == ["/x"]


def test_a_verb_drift_with_an_unexplained_path_stays_in_conflict(spark):
    row = ("e", "drift", "verb", None, False, "GET", "/v1/a", "PUT", "/b", None, None, None, None, None, None, None, None, None, None, "s", "o")
    cols = ("id string, kind string, drift string, operation_id string, synthesized boolean, verb string, path string, scan_verb string, scan_path string, candidates array<struct<operation_id:string,path:string>>, cause string, request string, "
            "request_cause string, response string, response_cause string, error string, error_cause string, security array<string>, security_cause string, source_ref string, openapi_ref string")
    got = {r["field"]: (r["state"], r["value"], r["authority"], r["reason"]) for r in decisions.decided(spark.createDataFrame([row], cols), "id", F.lit(""), F.lit(True)).collect()}
    assert got["http.path"] == ("conflict", None, "conflict", "path-not-proven") and got["operation.identity"] == ("unknown", None, "none", "operation-id-not-retained-in-reconciliation-result")
    assert got["api.security.declared"] == ("unknown", None, "none", "endpoint-not-safely-reconciled") and len(got) == 7


def test_closeout_counts_nulls_against_readiness(spark):
    s = spark.range(1).select(decisions.closeout({"leaks": F.lit(None).cast("int"), "orphans": F.lit(0)}, {"denied": F.lit(True)}).alias("s")).first()["s"]
    assert (s["ready"], s["blockers"]) == (False, "leaks")


def test_trust_fails_closed(spark):
    """A repeated check with one FAIL, a repeated capability, and every reason against a waiver."""
    required = spark.createDataFrame([("r", "a", "PASS"), ("r2", "b", "PASS"), ("r3", "c", "PASS")], "release string, check_id string, required string")
    observed = spark.createDataFrame([("a", "PASS", "e"), ("a", "FAIL", "e"), ("b", "PASS", "e"), ("b", "PASS", "gone"), ("c", "PASS", "e"), ("c", "PASS", "e")], "check_id string, result string, ref string")
    got = {r["release"]: r["blockers"] for r in trust.checks_pass(required, observed, spark.createDataFrame([("e",)], "ref string")).collect()}
    assert got == {"r": "check-not-passed", "r2": "evidence-missing", "r3": ""}
    have = spark.createDataFrame([("a", "x", "conflict"), ("a", "x", "supported"), ("a", "y", "supported"), ("a", "z", "unknown")], "adapter string, capability string, status string")
    needs = spark.createDataFrame([("a", c) for c in "xyzw"], "adapter string, capability string")
    told = {r["capability"]: (r["status"], r["allowed"], r["reason"]) for r in trust.capability_allowed(needs, have, F.array(F.lit("supported"), F.lit("unknown"))).collect()}
    assert told == {"x": ("unknown", False, "capability records conflict"), "y": ("supported", True, None), "z": ("unknown", False, "status unknown is not accepted by this policy"), "w": ("unknown", False, "capability record is missing")}
    cases = [("trust.secret-leak", "s", ["trust.secret-leak"], "2030-01-01 00:00:00", "trust.secret-leak is non-waivable"), ("c", None, None, None, "no waiver supplied"), ("c", "t", ["c"], "2030-01-01 00:00:00", "waiver scope t does not match subject s"),
             ("c", "s", ["d"], "2030-01-01 00:00:00", "waiver does not cover c"), ("c", "s", ["c", "evidence.replay"], "2030-01-01 00:00:00", "waiver attempts to cover a non-waivable failure code"), ("c", "s", None, "2030-01-01 00:00:00", "waiver does not cover c"),
             ("c", "s", ["c"], "soon", "waiver.expiresAt must be a valid date-time"), ("c", "s", ["c"], "2024-06-01 00:00:00", "waiver is expired"), ("c", "s", ["c"], "2030-01-01 00:00:00", None)]
    rows = spark.createDataFrame(cases, "code string, scope string, codes array<string>, x string, want string")
    why = trust.waiver_reason(F.col("code"), F.lit("s"), F.col("scope"), F.col("codes"), F.col("x"), F.lit("2024-06-01 00:00:00").cast("timestamp"))
    assert rows.where(~why.eqNullSafe(F.col("want"))).collect() == []


def test_a_request_of_too_many_sources_is_refused(spark):
    rows = [("big", i, 1) for i in range(101)] + [("fits", i, 40) for i in range(100)]
    got = logs.skip_budget(spark.createDataFrame(rows, "k string, o long, z long"), "k", "o", "z", 100).collect()
    assert [r for r in got if r["k"] == "big"] == [("big", None, False, True)]
    assert sorted((r["o"], r["included"]) for r in got if r["k"] == "fits") == [(i, i < 2) for i in range(100)]
