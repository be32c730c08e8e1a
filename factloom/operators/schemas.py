"""JSON Schemas with the components they refer to put in their place."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from factloom.sources.tables import durable, reach_workers

# Keywords, formats, reasons, bounds and the pattern that stands for a uuid.
MOST_NODES, MOST_DEPTH, MOST_PATTERN = 250_000, 32, 1000
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ONE_SCHEMA = ("items", "additionalProperties", "propertyNames")
SCHEMA_LISTS = ("oneOf", "anyOf", "allOf", "prefixItems")
PLAIN = ("type", "enum", "const", "format", "pattern", "minLength", "maxLength", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minItems", "maxItems", "uniqueItems",
         "minProperties", "maxProperties", "required", "discriminator", "default", "title", "description", "example", "examples", "deprecated", "readOnly", "writeOnly")
FORMATS = ("int32", "int64", "float", "double", "date", "date-time", "time", "email", "uri", "binary", "byte", "password", "ipvanyaddress", "duration", "color")
_COMPONENT = re.compile(r"#/components/schemas/([^/#]+)\Z")
_PROPERTY = re.compile(r"_?[A-Za-z0-9][\w.-]*\Z")


class _Refused(Exception):
    """A schema that can't be inlined; its argument is the reason."""


class _Inliner:
    """One schema with its components; counts nodes and collects the components at which a cycle is cut."""

    def __init__(self, components: dict[str, dict], most_nodes: int, most_depth: int):
        self.components, self.most_nodes, self.most_depth, self.nodes, self.cut = components, most_nodes, most_depth, 0, []

    def count(self, n: int) -> None:
        self.nodes += n
        if self.nodes > self.most_nodes:
            raise _Refused("too-many-nodes")

    def component(self, schema: dict) -> str:
        m = _COMPONENT.match(schema["$ref"]) if isinstance(schema["$ref"], str) else None
        if m is None:
            raise _Refused("unsupported-ref")
        if len(schema) > 1:
            raise _Refused("ref-with-siblings")
        if m[1] not in self.components:
            raise _Refused("component-not-found")
        return m[1]

    def inline(self, schema, path: tuple[str, ...] = (), depth: int = 0):
        begun = len(path)
        while isinstance(schema, dict) and "$ref" in schema:
            name = self.component(schema)
            if name in path[begun:]:
                raise _Refused("cycle-without-base-schema")
            if name in path:
                self.cut.append(name)
                return {"$ref": f"#/$defs/{name}"}
            path, schema = (*path, name), self.components[name]
        if isinstance(schema, bool):
            return schema
        if not isinstance(schema, dict):
            raise _Refused("malformed-schema")
        if depth > self.most_depth:
            raise _Refused("max-depth-exceeded")
        self.count(1)
        out: dict = {}
        for keyword, value in schema.items():
            out.update(self.keyword(keyword, value, schema, path, depth + 1))
        return out

    def keyword(self, keyword: str, value, schema: dict, path: tuple[str, ...], depth: int) -> dict:
        if keyword == "properties" and isinstance(value, dict):
            self.names(value)
            return {keyword: {k: self.inline(v, path, depth) for k, v in value.items()}}
        if keyword in ONE_SCHEMA:
            return {keyword: self.inline(value, path, depth)}
        if keyword in SCHEMA_LISTS and isinstance(value, list):
            return {keyword: [self.inline(v, path, depth) for v in value]}
        if keyword not in PLAIN:
            raise _Refused(f"unsupported-keyword:{keyword}")
        if keyword == "required":
            self.names(value)
        if keyword == "enum":
            self.count(len(value))
        if keyword == "pattern":
            if len(value) > MOST_PATTERN:
                raise _Refused("pattern-too-long")
            try:
                re.compile(value)
            except re.error:
                raise _Refused("invalid-pattern") from None
        if keyword == "format" and value in ("uuid", "uuid4"):
            if "pattern" in schema:
                raise _Refused("uuid-format-with-pattern")
            return {"pattern": UUID_PATTERN}
        if keyword == "format" and value not in FORMATS:
            raise _Refused(f"unsupported-format:{value}")
        return {keyword: value}

    def names(self, names) -> None:
        if not all(isinstance(n, str) and _PROPERTY.match(n) for n in names):
            raise _Refused("unsupported-property-name")

    def whole(self, schema) -> dict:
        out, defs = self.inline(schema), {}
        while left := [n for n in self.cut if n not in defs]:
            defs[left[0]] = {}
            defs[left[0]] = self.inline(self.components[left[0]], (left[0],), 1)
        return {**out, "$defs": defs} if defs else out


def _told(schema: str | None, names, texts, most_nodes: int, most_depth: int) -> tuple[str | None, str | None]:
    try:
        parts = {n: json.loads(t) for n, t in zip(names, texts) if t is not None}
        return json.dumps(_Inliner(parts, most_nodes, most_depth).whole(json.loads(schema)), separators=(",", ":")), None
    except _Refused as why:
        return None, str(why)
    except (TypeError, ValueError, AttributeError):
        return None, "malformed-schema"
    except RecursionError:
        return None, "max-depth-exceeded"


def reached(roots: DataFrame, components: DataFrame) -> DataFrame:
    """(doc, key, name) of the components that each schema of roots needs, by the references of both, hop by hop."""
    refs = F.array_distinct(F.regexp_extract_all("schema", F.lit(r'"\$ref"\s*:\s*"#/components/schemas/([^"/#]+)"'), F.lit(1)))
    edges = durable(components.select("doc", F.col("name").alias("src"), F.explode(refs).alias("dst")).distinct())
    new = durable(roots.select("doc", "key", F.explode(refs).alias("name")).distinct())
    seen = new
    while not new.isEmpty():
        step = new.join(edges, (new["doc"] == edges["doc"]) & (new["name"] == edges["src"])).select(new["doc"], "key", F.col("dst").alias("name")).distinct()
        new = durable(step.join(seen, ["doc", "key", "name"], "left_anti"))
        seen = seen.unionByName(new)
    return seen


def inlined(roots: DataFrame, components: DataFrame, most_nodes: int = MOST_NODES, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(doc, key, schema, reason): each schema of roots (doc, key, schema) with the components (doc, name, schema) of its document
    in place of the references to them, or the reason why not.

    A reference to a component inside itself stays one, to $defs, which then has that component; a chain of bare references that
    closes has no schema.  Schemas and values of an enum count as nodes.  Each schema gets just the components it needs; one that
    needs more than it may have nodes is refused before they are gathered.  Null and malformed texts are refused; of a component
    that is declared twice the least text counts; rows that repeat a key give one row."""

    @F.pandas_udf(StructType().add("schema", StringType()).add("reason", StringType()))
    def put(schema: pd.Series, names: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_told(s, n, t, most_nodes, most_depth) for s, n, t in zip(schema, names, texts)], columns=["schema", "reason"])

    reach_workers(roots.sparkSession)
    roots, parts = roots.groupBy("doc", "key").agg(F.min("schema").alias("schema")), components.groupBy("doc", "name").agg(F.min("schema").alias("schema"))
    need = reached(roots, parts).join(parts.withColumnRenamed("schema", "text"), ["doc", "name"])
    many = need.groupBy("doc", "key").agg(F.count("*").alias("n"))
    few = need.join(many.where(F.col("n") <= most_nodes).select("doc", "key"), ["doc", "key"], "left_semi")
    lists = few.groupBy("doc", "key").agg(F.array_sort(F.collect_list(F.struct("name", "text"))).alias("c"))
    rows = roots.join(many, ["doc", "key"], "left").join(lists, ["doc", "key"], "left").withColumn("c", F.coalesce("c", F.array().cast("array<struct<name:string,text:string>>")))
    fits = F.coalesce(F.col("n") <= most_nodes, F.lit(True))
    done = rows.where(fits).select("doc", "key", put("schema", "c.name", "c.text").alias("x")).select("doc", "key", "x.*")
    return done.unionByName(rows.where(~fits).select("doc", "key", F.lit(None).cast("string").alias("schema"), F.lit("too-many-nodes").alias("reason")))
