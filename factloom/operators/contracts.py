"""Contract tables: projections of operations, schema measurements, document and route imports, structural differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import json as J
from factloom.functions.text import security_names
from factloom.sources.tables import durable

# Fixed values.
COLUMNS = ["operation_id", "verb", "path", "path_params", "path_params_unverified", "body", "request_body_required", "request_body_fields", "response_fields", "error_fields", "provenance", "summary", "tags", "security"]
VERBS = ["get", "post", "put", "patch", "delete", "head", "options", "trace"]
DIFF_KINDS = ["type", "array-length", "missing", "unexpected", "value"]


def projection(ops: DataFrame) -> DataFrame:
    """The fourteen columns of a contract.  ops: operation_id, verb, path, body, provenance, summary; maps path_params,
    request_body, response, error; arrays path_params_unverified, tags; request_body_required; security (array of maps)."""
    names = lambda c: F.coalesce(F.array_join(F.array_sort(F.map_keys(c)), ", "), F.lit(""))
    listed = lambda c: F.coalesce(F.array_join(c, ", "), F.lit(""))
    return ops.select(
        "operation_id", "verb", "path", names("path_params").alias("path_params"), listed("path_params_unverified").alias("path_params_unverified"), F.col("body").cast("string").alias("body"),
        F.coalesce(F.col("request_body_required").cast("string"), F.lit("")).alias("request_body_required"), names("request_body").alias("request_body_fields"), names("response").alias("response_fields"),
        names("error").alias("error_fields"), "provenance", F.coalesce("summary", F.lit("")).alias("summary"), listed("tags").alias("tags"), security_names(F.col("security")).alias("security"),
    )


def surface(ops: DataFrame) -> DataFrame:
    """(operation_id, verb, path) with a digest of the request, response and error schema texts; no schema: null."""
    return ops.select("operation_id", "verb", "path", *(J.shape_digest(F.col(c)).alias(f"{c}_shape") for c in ("request", "response", "error")))


def measured(ops: DataFrame, key: str, sizes: list[str]) -> DataFrame:
    """(measure, size, operations, example) histogram of each size column, with the least key of each bar; null sizes left out."""
    long = ops.select(key, F.explode(F.create_map(*(x for s in sizes for x in (F.lit(s), F.col(s).cast("long"))))).alias("measure", "size")).where("size IS NOT NULL")
    return long.groupBy("measure", "size").agg(F.count("*").alias("operations"), F.min(key).alias("example"))


def largest(bars: DataFrame) -> DataFrame:
    """The highest bar position of each measure of a histogram."""
    return bars.groupBy("measure").agg(F.max("size").alias("size"), F.max_by("example", "size").alias("example"))


def openapi_operations(docs: DataFrame, key: str, text: str, max_chars: int) -> DataFrame:
    """(key, code, path, verb, operation_id), a row an operation of a document; a document that is too long, not JSON or
    without paths gives one row with its code and nulls."""
    doc = F.try_parse_json(text)
    paths = J.members(J.member(F.col("_doc"), "paths"))
    code = F.when(F.length(text) > max_chars, "too-large").when(F.col("_doc").isNull(), "unreadable").when(paths.isNull(), "no-paths").otherwise("ok")
    read = docs.select(key, text).withColumn("_doc", F.when(F.length(text) <= max_chars, doc)).select(key, code.alias("code"), paths.alias("_paths"))
    by_path = read.select(key, "code", F.explode_outer(F.map_filter("_paths", lambda k, v: J.kind(v) == "object")).alias("path", "_item"))
    verbs = F.map_filter(J.members(F.col("_item")), lambda k, v: k.isin(VERBS) & (J.kind(v) == "object"))
    ops = by_path.select(key, "code", "path", F.explode_outer(verbs).alias("verb", "_op")).where("verb IS NOT NULL OR code <> 'ok'")
    return ops.select(key, "code", "path", "verb", J.string_value(J.member(F.col("_op"), "operationId")).alias("operation_id"))


def laravel_routes(snapshots: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code, name, method, path, action) of route lists in JSON: one row a method, or a row with the code of what is
    unknown (no array, no object, no literal uri or method)."""
    rows = snapshots.select(key, F.explode_outer(J.elements(F.try_parse_json(text))).alias("_r"))
    value = lambda n: J.string_value(J.member(F.col("_r"), n))
    methods = F.filter(F.transform(F.split(F.coalesce(value("method"), F.lit("")), r"\|"), lambda m: F.upper(F.trim(m))), lambda m: m != "")
    uri = F.when(value("uri") != "", F.concat(F.lit("/"), F.regexp_replace(value("uri"), "^/+", "")))
    code = F.when(F.col("_r").isNull(), "unreadable").when(J.kind(F.col("_r")) != "object", "invalid-row").when(uri.isNull() | (F.size(methods) == 0), "incomplete").otherwise("route")
    rows = rows.select(key, code.alias("code"), value("name").alias("name"), methods.alias("_m"), uri.alias("path"), value("action").alias("action"))
    one = F.when(F.col("code") == "route", F.col("_m"))
    seen = lambda c: F.when(F.col("code") == "route", F.col(c)).alias(c)
    return rows.withColumn("method", F.explode_outer(one)).select(key, "code", "name", "method", seen("path"), seen("action"))


def rails_routes(snapshots: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code, name, method, path, controller, action) of expanded route listings, a row a method of a block."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)(--\[ Route \d+ \]-+.*?)(?=--\[ Route \d+ \]-|\z)"), F.lit(1))
    rows = snapshots.select(key, F.explode(blocks).alias("_b"))
    field = lambda name: F.nullif(F.trim(F.regexp_extract("_b", rf"(?m)^[ \t]*{name}[ \t]*\|[ \t]*(.*)$", 1)), F.lit(""))
    path = F.regexp_replace(F.regexp_replace(field("URI"), r"\(\.:format\)$", ""), r":([A-Za-z_]\w*)", r"{$1}")
    target = lambda i: F.nullif(F.regexp_extract(F.coalesce(field("Controller#Action"), F.lit("")), r"^([^\s#]+)#([A-Za-z_]\w*)", i), F.lit(""))
    code = F.when(path.isNull() | field("Verb").isNull(), "incomplete").when(target(1).isNull(), "target-unresolved").otherwise("route")
    whole = lambda i: F.when(code == "route", target(i))
    rows = rows.select(key, code.alias("code"), field("Prefix").alias("name"), path.alias("path"), field("Verb").alias("_v"), whole(1).alias("controller"), whole(2).alias("action"))
    methods = F.filter(F.transform(F.split("_v", r"\|"), lambda m: F.upper(F.trim(m))), lambda m: m != "")
    return rows.withColumn("method", F.explode_outer(F.when(F.col("code") != "incomplete", methods))).select(key, "code", "name", "method", "path", "controller", "action")


def deep_differences(pairs: DataFrame, key: str, expected: str, actual: str) -> DataFrame:
    """(key, path, kind) of every place where two JSON texts of a row differ; texts that are not JSON are compared as nulls.

    One pass a nesting level, all rows at once, so the number of passes is the depth of the deepest document.
    """
    null = F.parse_json(F.lit("null"))
    level = pairs.select(key, F.lit("").alias("path"), F.coalesce(F.try_parse_json(expected), null).alias("e"), F.coalesce(F.try_parse_json(actual), null).alias("a"))
    found = None
    while True:
        ek, ak = J.kind(F.col("e")), J.kind(F.col("a"))
        nested = F.col("ek").isin("object", "array")
        differs = (F.to_json("e") != F.to_json("a")) | F.col("e").isNull() | F.col("a").isNull()
        level = durable(level.where(differs).withColumn("ek", ek).withColumn("ak", ak))
        if level.isEmpty():
            break
        lengths = F.size(J.elements(F.col("e"))) != F.size(J.elements(F.col("a")))
        what = (
            F.when(F.col("e").isNull(), "unexpected").when(F.col("a").isNull(), "missing")
            .when((F.col("ek") != F.col("ak")) & (nested | F.col("ak").isin("object", "array")), "type")
            .when((F.col("ek") == "array") & lengths, "array-length").when(~nested, "value")
        )
        here = level.select(key, "path", what.alias("kind")).where("kind IS NOT NULL")
        found = here if found is None else found.unionByName(here)
        both = level.where(nested & (F.col("ek") == F.col("ak")))
        names = F.array_union(F.map_keys(J.members(F.col("e"))), F.map_keys(J.members(F.col("a"))))
        dotted = lambda k: F.when(k.rlike("^[0-9]+$"), F.concat(F.col("path"), F.lit("["), k, F.lit("]"))).when(F.col("path") != "", F.concat(F.col("path"), F.lit("."), k)).otherwise(k)
        objects = both.where("ek = 'object'").select(key, "path", "e", "a", F.explode(names).alias("k")).select(key, dotted(F.col("k")).alias("path"), F.try_element_at(J.members(F.col("e")), F.col("k")).alias("e"), F.try_element_at(J.members(F.col("a")), F.col("k")).alias("a"))
        arrays = both.where("ek = 'array'").select(key, "path", F.posexplode(F.arrays_zip(F.slice(J.elements(F.col("e")), F.lit(1), _shared()).alias("e"), F.slice(J.elements(F.col("a")), F.lit(1), _shared()).alias("a"))).alias("i", "z"))
        arrays = arrays.select(key, F.concat("path", F.lit("["), F.col("i").cast("string"), F.lit("]")).alias("path"), "z.e", "z.a")
        level = objects.unionByName(arrays)
    return level.select(key, "path", F.lit("").alias("kind")) if found is None else found


def _shared() -> Column:
    return F.least(F.size(J.elements(F.col("e"))), F.size(J.elements(F.col("a"))))


def first_differences(found: DataFrame, key: str, limit: int) -> DataFrame:
    """The first differences of each key by path, at most `limit` of them: the report's own limit."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("path", "kind"))
    return found.withColumn("_n", nth).where(F.col("_n") <= limit).drop("_n")


def field_wires(wires: DataFrame, classes: DataFrame, stale: DataFrame) -> DataFrame:
    """wires (feature, target, source_feature, source: classes) with resolution and side: unresolved where a class has no
    file, the target's side first; stale where a changed input of the feature (feature, input) is one of its two, else synced."""
    c = classes.groupBy("feature", "class").agg(F.min("file").alias("file"))
    target = c.select("feature", F.col("class").alias("target"), F.col("file").alias("_t"))
    source = c.select(F.col("feature").alias("source_feature"), F.col("class").alias("source"), F.col("file").alias("_s"))
    rows = wires.join(target, ["feature", "target"], "left").join(source, ["source_feature", "source"], "left")
    changed = stale.select("feature", "input").distinct()
    of = lambda flag: changed.select("feature", "input", F.lit(True).alias(flag))
    own = F.concat(F.lit("target:"), "target")
    far = F.concat(F.lit("source:"), F.col("source_feature").cast("string"), F.lit(":"), "source")
    rows = rows.withColumn("input", own).join(of("_tc"), ["feature", "input"], "left").withColumn("input", far).join(of("_sc"), ["feature", "input"], "left")
    side = F.when(F.col("_t").isNull(), "target").when(F.col("_s").isNull(), "source")
    state = F.when(side.isNotNull(), "unresolved").when(F.coalesce("_tc", "_sc", F.lit(False)), "stale").otherwise("synced")
    return rows.select(*wires.columns, state.alias("resolution"), side.alias("side"))


def nearest_before(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with `nearest`: the last value set on an earlier row of the key."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("nearest", F.last(value, ignorenulls=True).over(before))


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, line) of a graph drawing: nodes (id, label) before edges (source, target, relation, confidence)."""
    safe = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    box = nodes.select(F.lit(1).alias("section"), F.concat(F.lit("  "), safe("id"), F.lit('["'), F.replace("label", F.lit('"'), F.lit("'")), F.lit('"]')).alias("line"))
    arrow = F.when(F.col("confidence") == "proven", "-->").otherwise("-.->")
    link = edges.select(F.lit(2).alias("section"), F.concat(F.lit("  "), safe("source"), F.lit(" "), arrow, F.lit("|"), "relation", F.lit("| "), safe("target")).alias("line"))
    return box.unionByName(link)
