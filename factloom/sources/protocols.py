"""Declarations of Protobuf sources and GraphQL schemas, a row of a table for each, scopes nested to any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.delimiters import left_open, let, masked, nested, shielded
from factloom.sources.tables import durable, spread

_DECLARED = r"\b(service|message|enum|oneof|extend)\s+([A-Za-z_][\w.]*)\s*\z"
_RPC = r"\brpc\s+([A-Za-z_]\w*)\s*\(\s*(stream\s+)?([A-Za-z_.][\w.]*)\s*\)\s*returns\s*\(\s*(stream\s+)?([A-Za-z_.][\w.]*)\s*\)"
_FIELD = r"^(?:(repeated|optional|required)\s+)?((?:map\s*<[^>]*>)|[A-Za-z_.][\w.]*)\s+([A-Za-z_]\w*)\s*=\s*(\d+)\b"
_VALUE = r"^([A-Za-z_]\w*)\s*=\s*(-?\d+)\b"


def _keyed(files: DataFrame, key: str, text: str, code: Column) -> DataFrame:
    """One row a file with its code; of a file that occurs twice the least text counts."""
    dealt = spread(files.select(F.col(key).alias("file"), F.col(text).alias("text")), "file")
    return dealt.groupBy("file").agg(F.min("text").alias("text")).where("text IS NOT NULL").select("file", "text", code.alias("code"))


_ABOUT = "pos:int,depth:int,kind:string,name:string,full:string,owner:int,owner_kind:string,owner_depth:int"


def _declared(head: Column, around: Column, pos: Column, depth: Column) -> Column:
    """What a scope tells: kind, name, full, the names of the scopes around and its own, joined by points, and owner, the nearest scope
    from it outwards that is no oneof; scopes without a name leave no trace in it."""
    part = lambda n: F.nullif(F.regexp_extract(head, _DECLARED, n), F.lit(""))

    def told(own: Column) -> Column:
        kind, name = own["kind"], own["name"]
        passed = around.isNotNull() & ((kind == "oneof") | name.isNull())
        mine = lambda theirs, c: F.when(passed, around[theirs]).otherwise(c).alias(theirs)
        full = F.when(around["full"].isNull(), name).otherwise(F.concat_ws(".", around["full"], name))
        return F.struct(pos.alias("pos"), depth.alias("depth"), kind.alias("kind"), name.alias("name"), mine("full", full), mine("owner", pos), mine("owner_kind", kind), mine("owner_depth", depth))

    return let(F.struct(part(1).alias("kind"), part(2).alias("name")), told)


def protobuf(files: DataFrame, key: str, text: str) -> dict[str, DataFrame]:
    """Tables of .proto texts: files (file, syntax, package, services, methods, messages, status), messages (name with those around
    it, depth), fields (message, name, type, label, number, oneof), values (enum, name, number), methods (service, name, request_type,
    response_type, client_streaming, server_streaming) and warnings (code, subject).

    Comments and strings hold no declarations.  Declarations inside others are given by their full names, with the warning that a
    plain reading leaves them out; a block that is not closed has a warning and no contents; a null text is no file."""
    read = lambda pattern: F.nullif(F.regexp_extract(shielded(F.col("text"), "c"), pattern, 1), F.lit(""))
    source = nested(_keyed(files, key, text, masked(F.col("text"), "c")), F.col("code"), _ABOUT, _declared)
    source = source.select("file", read(r"\bsyntax\s*=\s*[\"'](proto2|proto3)[\"']\s*;").alias("syntax"), read(r"\bpackage\s+([A-Za-z_][\w.]*)\s*;").alias("package"), "events", "unclosed")
    source = durable(source, broadcast=False)  # one pass, all outputs
    whole = lambda e: ~left_open(e["scope"]["pos"], e["scope"]["depth"])
    each = source.select("file", "unclosed", F.explode("events").alias("e"))
    known = each.where("e.opens").select("file", "e.scope.*", whole(F.col("e")).alias("closed"))
    lines = each.where("NOT e.opens AND e.scope IS NOT NULL").where(whole(F.col("e"))).select("file", "unclosed", F.col("e.text").alias("text"), "e.scope")
    part = lambda pattern, n: F.nullif(F.regexp_extract("text", pattern, n), F.lit(""))
    fields = lines.where("scope.kind IN ('message', 'oneof') AND scope.owner_kind = 'message'").where(F.col("text").rlike(_FIELD) & ~left_open(F.col("scope.owner"), F.col("scope.owner_depth")))
    fields = fields.select("file", F.col("scope.full").alias("message"), part(_FIELD, 3).alias("name"), F.regexp_replace(part(_FIELD, 2), r"\s+", "").alias("type"), part(_FIELD, 1).alias("label"), part(_FIELD, 4).cast("long").alias("number"), F.when(F.col("scope.kind") == "oneof", F.col("scope.name")).alias("oneof"))
    values = lines.where((F.col("scope.kind") == "enum") & F.col("text").rlike(_VALUE)).select("file", F.col("scope.full").alias("enum"), part(_VALUE, 1).alias("name"), part(_VALUE, 2).cast("long").alias("number"))
    methods = lines.where((F.col("scope.kind") == "service") & F.col("text").rlike(_RPC)).select(
        "file", F.col("scope.full").alias("service"), part(_RPC, 1).alias("name"), part(_RPC, 3).alias("request_type"), part(_RPC, 5).alias("response_type"), part(_RPC, 2).isNotNull().alias("client_streaming"), part(_RPC, 4).isNotNull().alias("server_streaming"))
    messages = known.where("kind = 'message' AND closed").select("file", F.col("full").alias("name"), F.col("depth").cast("long").alias("depth"))
    held = lambda test: F.filter("events", lambda e: whole(e) & test(e))
    services = held(lambda e: e["opens"] & (e["scope"]["kind"] == "service") & (e["depth"] == 0))
    whole_files = source.withColumn("_names", F.transform(services, lambda e: e["scope"]["full"])).select(
        "file", "syntax", "package", F.size("_names").cast("long").alias("services"),
        F.size(held(lambda e: ~e["opens"] & (e["scope"]["kind"] == "service") & e["text"].rlike(_RPC) & F.array_contains("_names", e["scope"]["full"]))).cast("long").alias("methods"),
        F.size(held(lambda e: e["opens"] & (e["scope"]["kind"] == "message"))).cast("long").alias("messages"))
    whole_files = whole_files.withColumn("status", F.when((F.col("services") + F.col("messages")) > 0, "partial").otherwise("blocked"))
    declared = known.where(F.col("kind").isin("message", "service"))
    subject = F.concat_ws(" ", "kind", "name").alias("subject")
    warnings = declared.where("depth > 0").select("file", F.lit("PROTO_NESTED_DECLARATION_NOT_EXPANDED").alias("code"), subject).unionByName(
        declared.where("depth = 0 AND NOT closed").select("file", F.lit("PROTO_UNCLOSED_BLOCK").alias("code"), subject)).unionByName(
        whole_files.where("syntax IS NULL").select("file", F.lit("PROTO_SYNTAX_UNRESOLVED").alias("code"), F.lit(None).cast("string").alias("subject"))).unionByName(
        whole_files.where("status = 'blocked'").select("file", F.lit("PROTO_DECLARATIONS_NOT_FOUND").alias("code"), F.lit(None).cast("string").alias("subject")))
    return {"files": whole_files, "messages": messages, "fields": fields, "values": values, "methods": methods, "warnings": warnings}


_TYPE = r"(?:^|\s)(?:extend\s+)?(type|input|interface|enum)\s+([_A-Za-z]\w*)[^{}]*\z"
_PLAIN = r"(?:^|\s)(scalar|union)\s+([_A-Za-z]\w*)"
_ENTRY = r"([_A-Za-z]\w*)\s*:\s*((?:\[\s*)*[_A-Za-z]\w*(?:\s*[\]!])*)"
#: The roots where no schema names others.
ROOTS = {"Query": "query", "Mutation": "mutation", "Subscription": "subscription"}


def graphql(files: DataFrame, key: str, text: str) -> dict[str, DataFrame]:
    """Tables of GraphQL schema texts: types (kind, name), fields (parent, name, type), operations (kind, name, type; the fields of
    the root types) and warnings (code, subject).

    Descriptions, comments and strings hold no declarations; arguments are no fields.  Roots are those of the text's schema block, the
    usual names where it has none.  A type that is not closed has a warning and no fields; a null text is no file."""
    source = nested(_keyed(files, key, text, masked(F.col("text"), "hash")), F.col("code"), parting="")
    # a scope outside all others and the pieces that stand in it itself, which follow it up to the next one
    source = source.select("file", "unclosed", F.filter("events", lambda e: F.when(e["opens"], e["depth"] == 0).otherwise(e["depth"] == 1)).alias("kept"), F.filter("events", lambda e: ~e["opens"] & (e["depth"] == 0))["text"].alias("loose"))
    source = source.withColumn("starts", F.filter(F.transform("kept", lambda e, i: F.when(e["opens"], i)), lambda i: i.isNotNull()))
    body = lambda i, k: F.array_join(F.slice("kept", i + 2, F.coalesce(F.get("starts", k + 1), F.size("kept")) - i - 1)["text"], "\n")
    own = lambda i, k: F.struct(F.get("kept", i)["text"].alias("head"), (~left_open(F.get("kept", i)["pos"], F.lit(0))).alias("closed"), body(i, k).alias("body"))
    source = durable(source.select("file", F.transform("starts", own).alias("opens"), "loose"), broadcast=False)  # one pass, all outputs
    flat = lambda c: F.regexp_replace(c, r"\([^()]*\)", " ")
    part = lambda c, pattern, n: F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))
    entries = lambda body: F.transform(F.regexp_extract_all(flat(flat(flat(body))), F.lit(f"({_ENTRY})"), F.lit(1)), lambda e: F.struct(part(e, _ENTRY, 1).alias("name"), part(e, _ENTRY, 2).alias("type")))
    opens = source.select("file", F.inline("opens"))
    held = opens.select("file", "closed", part("head", _TYPE, 1).alias("kind"), part("head", _TYPE, 2).alias("name")).where("name IS NOT NULL")
    typed = F.transform("opens", lambda o: F.struct(part(o["head"], _TYPE, 1).alias("kind"), part(o["head"], _TYPE, 2).alias("name")))
    loose = F.transform(F.flatten(F.transform("loose", lambda t: F.regexp_extract_all(t, F.lit(f"({_PLAIN})"), F.lit(1)))), lambda t: F.struct(part(t, _PLAIN, 1).alias("kind"), part(t, _PLAIN, 2).alias("name")))
    types = source.select("file", F.inline(F.array_distinct(F.concat(F.filter(typed, lambda t: t["name"].isNotNull()), loose))))
    schema = F.filter("opens", lambda o: o["head"].rlike(r"\bschema\b[^{}]*\z"))
    told = F.flatten(F.transform(F.filter(schema, lambda o: o["closed"]), lambda o: entries(o["body"])))
    roots = F.filter(F.transform(told, lambda e: F.struct(e["type"].alias("parent"), e["name"].alias("kind"))), lambda r: r["kind"].isin(list(ROOTS.values())))
    usual = F.array(*(F.struct(F.lit(parent).alias("parent"), F.lit(kind).alias("kind")) for parent, kind in ROOTS.items()))
    rooted = source.select("file", "opens", F.when(F.size(schema) > 0, F.array_distinct(roots)).otherwise(usual).alias("roots"))
    fields = rooted.select("file", "roots", F.inline("opens")).where("closed").select("file", "roots", "body", part("head", _TYPE, 1).alias("kind"), part("head", _TYPE, 2).alias("parent")).where("parent IS NOT NULL AND kind <> 'enum'")
    fields = fields.select("file", "roots", "parent", F.inline(entries(F.col("body")))).withColumn("type", F.regexp_replace("type", r"\s+", ""))
    operations = fields.select("file", "name", "type", F.inline(F.filter("roots", lambda r: r["parent"] == F.col("parent")))).select("file", "kind", "name", "type")
    warnings = held.where("NOT closed").select("file", F.lit("GRAPHQL_UNCLOSED_TYPE").alias("code"), F.concat_ws(" ", "kind", "name").alias("subject"))
    return {"types": types, "fields": fields.drop("roots"), "operations": operations, "warnings": warnings}
