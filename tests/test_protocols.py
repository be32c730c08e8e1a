"""Nested scopes against a plain reader; Protobuf and GraphQL texts of many shapes."""

import random
import re

from pyspark.sql import functions as F

from factloom.sources import delimiters, protocols


def plain_scopes(text):
    opens, pieces, stack, start = {}, [], [], 0
    tokens = [(m[0], m.start()) for m in re.finditer(r"[{};]|[^{};]+", text)]
    for i, (t, at) in enumerate(tokens):
        if t == "{":
            head = tokens[i - 1][0].strip() if i else ""
            opens[i] = [at, head, len(stack), stack[-1] if stack else None, False]
            stack.append(i)
        elif t == "}" and stack:
            opens[stack.pop()][4] = True
        elif t not in "{};" and t.strip():
            pieces.append((i, at, t.strip(), stack[-1] if stack else None))
    return sorted((i, *o) for i, o in opens.items()), sorted(pieces)


def test_scopes_match_a_plain_reader(spark):
    r = random.Random(8)
    texts = ["", "}", "{", "a{b{c;d}e;}f", *("".join(r.choices(["a", " b ", "{", "{", "}", ";", "\n"], k=r.randrange(40))) for _ in range(60)), "x{" * 40 + "y" + "}" * 40]
    opens, pieces = delimiters.scopes(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), ["id"], F.col("t"))
    o, p = opens.collect(), pieces.collect()
    for i, t in enumerate(texts):
        got = sorted((x["pos"], x["at"], x["head"].strip("{};"), x["depth"], x["parent"], x["closed"]) for x in o if x["id"] == i), sorted((x["pos"], x["at"], x["text"], x["scope"]) for x in p if x["id"] == i)
        want = plain_scopes(t)
        assert got == ([(a, b, c.strip("{};"), d, e, f) for a, b, c, d, e, f in want[0]], want[1]), t


PROTO = '''syntax = "proto3"; // message No { string a = 1; }
package shop.v1;
/* service Gone { } */
message Order {
  string id = 1;
  repeated Line lines = 2 [(opt) = { a: 1 }, deprecated = true];
  map<string, Item> items = 3;
  message Line { int32 n = 1; enum Kind { NONE = 0; NEG = -1; } Kind kind = 2; message Deep { bytes b = 7; } }
  oneof pay { string card = 4; .shop.v1.Cash cash = 5; }
  string note = 6; string s = 8 [default = "message X { int32 q = 1; }"];
}
enum Top { A = 0; }
service Orders {
  rpc Get (GetRequest) returns (Order);
  rpc Watch(stream GetRequest) returns ( stream Order ) { option (x) = { get: "/v1" }; }
  rpc Put(stream .a.B) returns (Order) {}
}
'''


def test_protobuf(spark):
    files = [("a", PROTO), ("b", "message Open { int32 a = 1;"), ("c", "// nothing"), ("d", None), ("a", PROTO), ("e", 'syntax = "proto2"; message M { required int32 a = 1; optional string b = 2; }')]
    out = {n: [tuple(r) for r in df.collect()] for n, df in protocols.protobuf(spark.createDataFrame(files, "path string, text string"), "path", "text").items()}
    assert sorted(out["files"]) == [("a", "proto3", "shop.v1", 1, 3, 3, "partial"), ("b", None, None, 0, 0, 0, "blocked"), ("c", None, None, 0, 0, 0, "blocked"), ("e", "proto2", None, 0, 0, 1, "partial")]
    assert sorted(out["messages"]) == [("a", "Order", 0), ("a", "Order.Line", 1), ("a", "Order.Line.Deep", 2), ("e", "M", 0)]
    assert sorted(out["fields"], key=str) == sorted([
        ("a", "Order", "id", "string", None, 1, None), ("a", "Order", "lines", "Line", "repeated", 2, None), ("a", "Order", "items", "map<string,Item>", None, 3, None), ("a", "Order.Line", "n", "int32", None, 1, None),
        ("a", "Order.Line", "kind", "Kind", None, 2, None), ("a", "Order.Line.Deep", "b", "bytes", None, 7, None), ("a", "Order", "card", "string", None, 4, "pay"), ("a", "Order", "cash", ".shop.v1.Cash", None, 5, "pay"),
        ("a", "Order", "note", "string", None, 6, None), ("a", "Order", "s", "string", None, 8, None), ("e", "M", "a", "int32", "required", 1, None), ("e", "M", "b", "string", "optional", 2, None)], key=str)
    assert sorted(out["values"]) == [("a", "Order.Line.Kind", "NEG", -1), ("a", "Order.Line.Kind", "NONE", 0), ("a", "Top", "A", 0)]
    assert sorted(out["methods"]) == [("a", "Orders", "Get", "GetRequest", "Order", False, False), ("a", "Orders", "Put", ".a.B", "Order", True, False), ("a", "Orders", "Watch", "GetRequest", "Order", True, True)]
    assert sorted(out["warnings"], key=str) == sorted([
        ("a", "PROTO_NESTED_DECLARATION_NOT_EXPANDED", "message Line"), ("a", "PROTO_NESTED_DECLARATION_NOT_EXPANDED", "message Deep"), ("b", "PROTO_UNCLOSED_BLOCK", "message Open"), ("b", "PROTO_SYNTAX_UNRESOLVED", None),
        ("b", "PROTO_DECLARATIONS_NOT_FOUND", None), ("c", "PROTO_SYNTAX_UNRESOLVED", None), ("c", "PROTO_DECLARATIONS_NOT_FOUND", None)], key=str)


GRAPH = '''"""type No { a: Int }"""
schema { query: Root, mutation: Change }
# type Gone { a: Int }
type Root implements Node & Other @d(a: 1) {
  "says: nothing"
  item(id: ID!, filter: Filter = {a: 1}, at: At @x(y: 2)): Item!
  items(
    first: Int
  ): [Item!]!
  deep: [[Int]]
}
type Change { set(a: Int): Boolean }
input Filter { a: Int = 1 }
enum Kind { A B }
scalar Date
union Any = Root | Change
interface Node { id: ID! }
'''


def test_graphql(spark):
    files = [("a", GRAPH), ("b", "type Query { q: Int }\ntype Open { a: Int"), ("c", None), ("d", "")]
    out = {n: [tuple(r) for r in df.collect()] for n, df in protocols.graphql(spark.createDataFrame(files, "path string, text string"), "path", "text").items()}
    assert sorted(out["types"]) == sorted([("a", k, n) for k, n in (("type", "Root"), ("type", "Change"), ("input", "Filter"), ("enum", "Kind"), ("scalar", "Date"), ("union", "Any"), ("interface", "Node"))] + [("b", "type", "Query"), ("b", "type", "Open")])
    assert sorted(out["fields"]) == sorted([("a", "Root", "item", "Item!"), ("a", "Root", "items", "[Item!]!"), ("a", "Root", "deep", "[[Int]]"), ("a", "Change", "set", "Boolean"), ("a", "Filter", "a", "Int"), ("a", "Node", "id", "ID!"), ("b", "Query", "q", "Int")])
    assert sorted(out["operations"]) == [("a", "mutation", "set", "Boolean"), ("a", "query", "deep", "[[Int]]"), ("a", "query", "item", "Item!"), ("a", "query", "items", "[Item!]!"), ("b", "query", "q", "Int")]
    assert out["warnings"] == [("b", "GRAPHQL_UNCLOSED_TYPE", "type Open")]
