"""JSON documents as column expressions on variants: canonical text, pointers, schema leaves, digests of labelled parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SCALAR_TYPES = ["string", "number", "integer", "boolean"]
NUMERIC_TYPES = ["number", "integer"]
COMPOSITE_KEYWORDS = ["properties", "items", "$ref", "anyOf", "allOf", "oneOf"]
ROOT_KEYWORDS = ["$ref", "anyOf", "allOf", "oneOf"]
CACHE_DIGESTS = ["source", "resolver", "config", "parser", "adapter", "schema", "policy"]

LEAVES = "struct<required:array<string>,properties:map<string,struct<type:string,pattern:string>>,unsupported:array<string>>"


def canonical_json(c: Column) -> Column:
    """A JSON text with its keys in byte order at every depth and no white space; null for what is not JSON or repeats a key.

    Numbers with an exponent are printed as doubles (1e3 as 1000.0).
    """
    return F.to_json(F.try_parse_json(c))


def members(v: Column) -> Column:
    """The members of a variant object as a map; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def member(v: Column, name: str) -> Column:
    return F.try_element_at(members(v), F.lit(name))


def kind(v: Column) -> Column:
    """object, array, null or scalar; null where there is no value at all."""
    s = F.schema_of_variant(v)
    return F.when(F.startswith(s, F.lit("OBJECT<")), "object").when(F.startswith(s, F.lit("ARRAY<")), "array").when(s == "VOID", "null").when(s.isNotNull(), "scalar")


def string_value(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))


def pointer_value(doc: Column, pointer: str | None) -> Column:
    """What a JSON pointer finds in a variant: null where nothing is there, a variant null where a null is."""
    if not pointer:
        return doc
    if not pointer.startswith("/"):
        raise ValueError(f"a pointer starts with /: {pointer}")
    for part in pointer[1:].split("/"):
        name = part.replace("~1", "/").replace("~0", "~")
        inner = member(doc, name)
        doc = F.coalesce(inner, F.get(elements(doc), F.lit(int(name)))) if name.isdecimal() else inner
    return doc


def _has_any(v: Column, names: list[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.coalesce(~kind(member(v, n)).isin("null"), F.lit(False))
    return out


def scalar_leaf(schema: Column) -> Column:
    """Is a schema a plain string, number, integer or boolean, with nothing below it?"""
    return F.coalesce(string_value(member(schema, "type")).isin(SCALAR_TYPES), F.lit(False)) & ~_has_any(schema, COMPOSITE_KEYWORDS)


def schema_leaves(schema: Column) -> Column:
    """(required, properties, unsupported) of an object schema: its scalar leaves by name with type and pattern, and pointers
    to the rest; a root that is no plain object is unsupported as a whole, and what is no schema gives null."""
    plain = F.coalesce(string_value(member(schema, "type")) == "object", F.lit(False)) & ~_has_any(schema, ROOT_KEYWORDS)
    none = F.struct(F.array().cast("array<string>").alias("required"), F.create_map().cast("map<string,struct<type:string,pattern:string>>").alias("properties"), F.array(F.lit("")).alias("unsupported"))
    props = F.coalesce(members(member(schema, "properties")), F.create_map().cast("map<string,variant>"))
    leaf = lambda k, v: scalar_leaf(v)
    shaped = F.transform_values(F.map_filter(props, leaf), lambda k, v: F.struct(string_value(member(v, "type")).alias("type"), string_value(member(v, "pattern")).alias("pattern")))
    required = F.coalesce(F.filter(F.transform(elements(member(schema, "required")), string_value), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    rest = F.transform(F.map_keys(F.map_filter(props, lambda k, v: ~leaf(k, v))), lambda k: F.concat(F.lit("/"), k))
    return F.when(kind(schema) == "object", F.when(plain, F.struct(required.alias("required"), shaped.alias("properties"), rest.alias("unsupported"))).otherwise(none).cast(LEAVES))


def rule_pointer(schema: Column, pointer: Column) -> Column:
    """(code, type) of a rule's pointer: ok with the type of a scalar top-level property, else why it finds none."""
    props = members(member(schema, "properties"))
    usable = F.coalesce((string_value(member(schema, "type")) == "object") & props.isNotNull(), F.lit(False))
    found = F.try_element_at(props, F.when(F.coalesce(pointer.rlike("^/[^/]+$"), F.lit(False)), F.substr(pointer, F.lit(2))).otherwise(F.lit("")))
    named = F.coalesce(pointer.rlike("^/[^/]+$"), F.lit(False))
    type_ = F.when(named, string_value(member(found, "type")))
    good = F.coalesce(type_.isin(SCALAR_TYPES), F.lit(False))
    code = F.when(~usable, "no-schema").when(good, "ok").otherwise("unknown-pointer")
    return F.struct(code.alias("code"), F.when(usable & good, type_).alias("type"))


def comparable(a: Column, b: Column) -> Column:
    """May two scalar types be ordered against each other?  Numbers with numbers, strings with strings, booleans never."""
    both = lambda names: a.isin(names) & b.isin(names)
    return F.coalesce(both(NUMERIC_TYPES) | both(["string"]), F.lit(False))


def cache_key(namespace: Column, digests: dict[str, Column], runtime: Column) -> Column:
    """sha256 of the labelled parts of a scan's identity; null where a digest is no lower-case sha256 or a text is blank."""
    if sorted(digests) != sorted(CACHE_DIGESTS):
        raise ValueError(f"digests are those of {', '.join(CACHE_DIGESTS)}")
    parts = {"namespace": namespace, "runtime_fingerprint": runtime} | {f"{n}_digest": c for n, c in digests.items()}
    fine = F.coalesce((F.trim(namespace) != "") & (F.trim(runtime) != ""), F.lit(False))
    for c in digests.values():
        fine = fine & F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))
    return F.when(fine, F.sha2(F.to_json(F.struct(*(parts[n].alias(n) for n in sorted(parts)))), 256))


def entity_id(provider: Column, name: Column, file: Column, table: Column) -> Column:
    """entity:<provider>:<name>:<place>, each part percent-encoded; the place is the file, else the table, else the name."""
    empty = lambda c: F.nullif(c, F.lit(""))
    part = lambda c: F.replace(F.url_encode(F.replace(c, F.lit("\\"), F.lit("/"))), F.lit("+"), F.lit("%20"))
    return F.concat_ws(":", F.lit("entity"), part(provider), part(name), part(F.coalesce(empty(file), empty(table), name)))


def item_id(prefix: Column, item: Column) -> Column:
    """<prefix>:<20 hex digits> of the canonical JSON of an item."""
    return F.concat(prefix, F.lit(":"), F.substring(F.sha2(canonical_json(item), 256), 1, 20))


def shape_digest(schema: Column) -> Column:
    """sha256 of a schema's canonical JSON; null where there is none, or null or false in its place."""
    text = canonical_json(schema)
    return F.when(~text.isin("null", "false"), F.sha2(text, 256))
