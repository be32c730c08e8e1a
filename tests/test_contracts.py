"""JSON functions, contract tables and readiness on fixtures: nulls, empty tables, ties, and what the reference tables lack."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import json as J
from factloom.operators import contracts, readiness


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.try_parse_json("t")).alias("x")).first()["x"]


def test_canonical_json_orders_keys_and_refuses_what_is_no_json(spark):
    rows = spark.createDataFrame([('{"b": [1, {"d":null,"c":"\\u00e9"}], "a": 2.50}',), ("[",), (None,), ('{"a":1,"a":2}',)], "t string")
    assert [r[0] for r in rows.select(J.canonical_json(F.col("t"))).collect()] == ['{"a":2.5,"b":[1,{"c":"é","d":null}]}', None, None, None]


def test_pointers_escape_and_tell_arrays_from_objects(spark):
    text = '{"a/b": {"~": [10, {"0": "z"}]}, "": 5}'
    for pointer, want in (("/a~1b/~0/0", "10"), ("/a~1b/~0/1/0", '"z"'), ("/a~1b/~0/7", None), ("/", "5"), ("/nope/x", None), ("", '{"":5,"a/b":{"~":[10,{"0":"z"}]}}')):
        assert one(spark, text, lambda v, p=pointer: F.to_json(J.pointer_value(v, p))) == want
    with pytest.raises(ValueError):
        J.pointer_value(F.lit(1), "a")


def test_schema_leaves_of_odd_roots(spark):
    leaves = lambda v: J.schema_leaves(v)
    assert one(spark, '{"anyOf": []}', leaves)["unsupported"] == [""]
    assert one(spark, "3", leaves) is None
    got = one(spark, '{"type": "object"}', leaves)
    assert (got["required"], got["properties"], got["unsupported"]) == ([], {}, [])


def test_cache_key_needs_every_digest(spark):
    with pytest.raises(ValueError):
        J.cache_key(F.lit("n"), {"source": F.lit("x")}, F.lit("r"))


def test_deep_differences_of_equal_empty_and_unreadable(spark):
    rows = [(1, '{"a": 1}', '{ "a":1}'), (2, None, "[]"), (3, "{", "null"), (4, '[[1, 2], {"x": {"y": 1}}]', '[[1, 3], {"x": {"y": 1, "z": 0}}]'), (5, "[1]", '{"0": 1}')]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    got = sorted(tuple(r) for r in contracts.deep_differences(df, "id", "a", "b").collect())
    assert got == [(2, "", "type"), (4, "[0][1]", "value"), (4, "[1].x.z", "unexpected"), (5, "", "type")]
    assert contracts.deep_differences(df.where("id = 1"), "id", "a", "b").count() == 0
    assert contracts.deep_differences(df.where("false"), "id", "a", "b").count() == 0


def test_bindings_without_a_name_or_with_empty_keys(spark):
    b = spark.createDataFrame([(1, None, None, ["id"], None), (2, None, "t", [], "uuid"), (3, None, "t", ["id"], "uuid")], "i long, schema string, name string, pk array<string>, key_type string")
    live = spark.createDataFrame([(None, "t", ["id"], "live", "bigint")], "schema string, name string, pk array<string>, pk_source string, pk_type string")
    got = {r["i"]: (r["table_status"], r["key_status"], r["key_type_status"], r["verified"]) for r in readiness.verified_bindings(b, live, "public").collect()}
    assert got == {1: ("unknown", "unknown", "unknown", False), 2: ("verified", "mismatch", "unknown", False), 3: ("verified", "verified", "mismatch", False)}


def test_annotation_paths_prefer_cycles_and_stop_at_the_depth(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 13)], "node long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 11)] + [(12, 12), (12, 99)], "src long, dst long")
    got = {r["node"]: (r["status"], r["edges"], r["cycles"]) for r in readiness.annotation_paths(nodes, edges).collect()}
    assert got[1] == ("partial", 8, 0) and got[3] == ("resolved", 8, 0) and got[11] == ("resolved", 0, 0) and got[12] == ("cycle", 2, 1)


def test_conformance_takes_nulls_for_values(spark):
    a = spark.createDataFrame([("E", "f", None), ("G", "f", "int")], "entity string, name string, type string")
    b = spark.createDataFrame([("E", "f", None), ("E", "g", None)], "entity string, name string, type string")
    got = sorted((r["entity"], r["name"] or "", r["code"]) for r in readiness.conformance(a, b, a.select("entity"), ["name", "type"]).collect())
    assert got == [("E", "g", "unexpected"), ("G", "", "entity-missing")]


def test_consumers_miss_cases_and_repeat_them(spark):
    cases = spark.createDataFrame([("p", "positive", "a", "1"), ("p", "negative", "b", "no .*")], "pack string, kind string, name string, want string")
    rows = spark.createDataFrame([("c", "p", "positive", "a", "pass", "1"), ("c", "p", "positive", "a", "pass", "1"), ("d", "p", "negative", "b", "pass", None), ("d", "p", "artifact", "a", "pass", "1")], "who string, pack string, kind string, name string, outcome string, observed string")
    got = sorted((r["who"], r["name"], r["fault"]) for r in readiness.case_faults(cases, rows, "who").collect())
    assert got == [("c", "a", "duplicate"), ("c", "b", "missing"), ("d", "a", "missing"), ("d", "a", "unexpected"), ("d", "b", "mismatch")]
