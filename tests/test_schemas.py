"""Inlined schemas: references, cycles, budgets and what is refused."""

import json

import pytest

from factloom.operators import schemas

REF = lambda n: {"$ref": f"#/components/schemas/{n}"}
FILTER = {"type": "object", "required": ["conjunction", "clauses"], "properties": {"conjunction": {"type": "string", "enum": ["and", "or"]}, "clauses": {"type": "array", "items": {"anyOf": [{"type": "object", "properties": {"field": {"type": "string"}}}, REF("Filter")]}}}}
PARTS = {
    "Widget": {"type": "object", "properties": {"name": {"type": "string"}}}, "Wrapper": {"type": "object", "properties": {"inner": REF("Inner")}}, "Inner": {"type": "string"}, "Filter": FILTER,
    "A": {"type": "object", "properties": {"b": REF("B")}}, "B": {"type": "object", "properties": {"a": REF("A")}}, "Self": REF("Self"), "P": REF("Q"), "Q": REF("P"), "Bare": REF("Widget"),
    "Meter": {"properties": {"subscription": REF("Subscription")}}, "Subscription": {"properties": {"meters": {"type": "array", "items": REF("SubscriptionMeter")}}}, "SubscriptionMeter": {"properties": {"meter": REF("Meter")}},
}
WIDGET, OBJECT = PARTS["Widget"], lambda **p: {"type": "object", "properties": p}
CUT_FILTER = json.loads(json.dumps(FILTER).replace("#/components/schemas/", "#/$defs/"))
CUT_A = OBJECT(b=OBJECT(a={"$ref": "#/$defs/A"}))


def nested(n):
    s = {"type": "string"}
    for _ in range(n):
        s = OBJECT(next=s)
    return s


GOOD = [
    (REF("Widget"), WIDGET), (REF("Bare"), WIDGET), ({"oneOf": [REF("Widget"), {"type": "null"}]}, {"oneOf": [WIDGET, {"type": "null"}]}), ({"additionalProperties": REF("Widget")}, {"additionalProperties": WIDGET}),
    ({"additionalProperties": False}, {"additionalProperties": False}), ({"type": "array", "minItems": 1, "items": REF("Widget")}, {"type": "array", "minItems": 1, "items": WIDGET}),
    (OBJECT(a=REF("Widget"), b=REF("Widget")), OBJECT(a=WIDGET, b=WIDGET)), (REF("Wrapper"), OBJECT(inner={"type": "string"})), (REF("A"), {**CUT_A, "$defs": {"A": CUT_A}}),
    (REF("Filter"), {**CUT_FILTER, "$defs": {"Filter": CUT_FILTER}}), (OBJECT(f=REF("Filter")), {**OBJECT(f=CUT_FILTER), "$defs": {"Filter": CUT_FILTER}}),
    ({"type": "string", "format": "uuid"}, {"type": "string", "pattern": schemas.UUID_PATTERN}), ({"type": "string", "format": "color"}, {"type": "string", "format": "color"}), (OBJECT(_cost={}), OBJECT(_cost={})), (nested(31), nested(31)),
]
BAD = [
    (REF("Self"), "cycle-without-base-schema"), (REF("P"), "cycle-without-base-schema"), (nested(40), "max-depth-exceeded"), ({"enum": list(range(30))}, "too-many-nodes"), (OBJECT(**{f"p{i}": {} for i in range(30)}), "too-many-nodes"),
    ({"pattern": "a" * 1001}, "pattern-too-long"), ({"pattern": "("}, "invalid-pattern"), ({"not": {}}, "unsupported-keyword:not"), ({"$id": "x"}, "unsupported-keyword:$id"), ({"$ref": "https://x/y.json"}, "unsupported-ref"),
    ({"$ref": "#/components/requestBodies/X"}, "unsupported-ref"), (REF("Ghost"), "component-not-found"), ({**REF("Widget"), "type": "x"}, "ref-with-siblings"), (OBJECT(__proto__={}), "unsupported-property-name"),
    ({"required": ["__proto__"]}, "unsupported-property-name"), ({"format": "uuid", "pattern": "a"}, "uuid-format-with-pattern"), ({"format": "ipv4"}, "unsupported-format:ipv4"),
]


@pytest.fixture(scope="module")
def told(spark):
    texts = [json.dumps(s) for s, _ in GOOD + BAD] + [None, "", "[]", "{"]
    roots = spark.createDataFrame([(d, i, t) for d in ("x", "empty") for i, t in enumerate(texts)], "doc string, key long, schema string")
    parts = spark.createDataFrame([("x", n, json.dumps(s)) for n, s in PARTS.items()] * 2, "doc string, name string, schema string")
    limits = {"most_nodes": 40, "most_depth": 32}
    small = schemas.inlined(roots, parts, most_nodes=29)
    return {(r["doc"], r["key"]): (r["schema"], r["reason"]) for r in schemas.inlined(roots, parts, **limits).collect()}, {(r["doc"], r["key"]): r["reason"] for r in small.collect()}


@pytest.mark.parametrize("i", range(len(GOOD)))
def test_components_stand_in_place_of_references(told, i):
    text, reason = told[0]["x", i]
    assert reason is None and json.loads(text) == GOOD[i][1]


@pytest.mark.parametrize("i", range(len(BAD)))
def test_what_cannot_be_inlined_is_refused(told, i):
    at = told[1] if BAD[i][1] == "too-many-nodes" else {k: v[1] for k, v in told[0].items()}
    assert at["x", len(GOOD) + i] == BAD[i][1]


def test_malformed_and_foreign_documents(told):
    n = len(GOOD) + len(BAD)
    assert {told[0]["x", n + k] for k in range(4)} == {(None, "malformed-schema")}
    assert told[0]["empty", 0] == (None, "component-not-found") and len(told[0]) == 2 * (n + 4)


def test_a_cycle_of_three_is_cut_once(told, spark):
    roots = spark.createDataFrame([("x", 1, json.dumps(REF("Meter")))], "doc string, key long, schema string")
    parts = spark.createDataFrame([("x", n, json.dumps(s)) for n, s in PARTS.items()], "doc string, name string, schema string")
    got = json.loads(schemas.inlined(roots, parts).first()["schema"])
    assert list(got["$defs"]) == ["Meter"] and got["properties"]["subscription"]["properties"]["meters"]["items"]["properties"]["meter"] == {"$ref": "#/$defs/Meter"}
