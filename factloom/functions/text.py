"""Names, routes, paths, digests and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOP_WORDS = [
    "get", "post", "put", "patch", "delete", "read", "list", "find", "create", "update", "the", "with", "from", "that", "into", "this", "api", "v1", "v2",
    "by", "to", "all", "and", "for", "id", "route", "endpoint", "controller", "handler",
]
DTO_SUFFIXES = ["Base", "Create", "Update", "Public", "Read", "Response", "Request", "In", "Out"]
SOURCE_FILE = r"(?i)\.(py|js|mjs|ts|tsx|jsx|java|kt|rb|go|rs|cs|php)$"
HIDDEN_PATH = r"(^|/)\."
SUPPORT_FOLDER = r"(?i)(^|/)(test|tests|__tests__|evals|fixtures|migrations|generated|docs?|benchmarks?)(/|$)"
TEST_FILE = r"(?i)(\.test\.|\.spec\.|_test\.|\.min\.)"
SECRET_FILE = r"(?i)(^|/)(\.env(\..*)?|secrets?(\..*)?|credentials(\..*)?|id_rsa|id_ed25519|[^/]*\.(pem|key|p12|pfx))$"
DOCUMENT_FILES = ["README.md", "SKILL.md", "DECISIONS.md", "ROADMAP.md", "CATALOG.md", "LICENSE", "COMMERCIAL-LICENSE.md", "COMMERCIAL-LICENSE-AGREEMENT.md"]
FEATURE_ID = r"^[0-9]{3}-[a-z0-9]+(-[a-z0-9]+)*$"


def search_tokens(c: Column) -> Column:
    """Distinct lower-case words of three letters or digits and more, camel case split, without stop words."""
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2"), "[^a-zA-Z0-9]+")
    return F.array_distinct(F.filter(F.transform(parts, F.lower), lambda x: (F.length(x) >= 3) & ~x.isin(STOP_WORDS)))


def pascal_case(c: Column) -> Column:
    """Each run of letters and digits with a capital first letter, put together."""
    parts = F.filter(F.split(c, "[^a-zA-Z0-9]+"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "")


def snake_case(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"), r"[-\s]+", "_"))


def dto_base(c: Column) -> Column:
    """The name without the first suffix of the list that it ends in and is longer than."""
    out = None
    for s in DTO_SUFFIXES:
        hit = F.endswith(c, F.lit(s)) & (F.length(c) > len(s))
        cut = F.substring(c, F.lit(1), F.length(c) - len(s))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(c)


def singular(c: Column) -> Column:
    """The regular singular of a plural; null where there is none."""
    cut = lambda n: F.substring(c, F.lit(1), F.length(c) - n)
    return (
        F.when(c.rlike("[^a-zA-Z0-9_]"), None).when(c.rlike("ies$"), F.concat(cut(3), F.lit("y")))
        .when(c.rlike("(ches|shes|xes|zes|sses)$"), cut(2)).when(c.rlike("s$") & ~c.rlike("ss$"), cut(1))
    )


def markdown_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "\\|"), ("\r\n", "\n"), ("\r", "\n"), ("\n", "<br>")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def regex_escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"[.*+?^$()|\[\]{}\\]", r"\\$0")


def joined_route(base: Column, segment: Column) -> Column:
    """A base path and a segment with one slash between them; neither: the root."""
    b, s = F.regexp_replace(F.coalesce(base, F.lit("")), "/$", ""), F.regexp_replace(F.coalesce(segment, F.lit("")), "^/", "")
    return F.when(s != "", F.concat(b, F.lit("/"), s)).when(b != "", b).otherwise("/")


def normal_route(c: Column) -> Column:
    """Repeated slashes made one, and none at the end but for the root."""
    out = F.regexp_replace(c, "/+", "/")
    return F.when(F.length(out) > 1, F.regexp_replace(out, "/$", "")).otherwise(out)


def route_shape(c: Column) -> Column:
    """A normal route whose {x} and :x(...) segments are all :param."""
    return F.regexp_replace(normal_route(c), r"\{[^/{}]+\}|:[A-Za-z_][A-Za-z0-9_]*(\([^/]*\))?", ":param")


def id_params(names: Column) -> Column:
    """Those path parameters whose names end in id, whatever the case: they are taken for UUIDs."""
    return F.filter(names, lambda x: x.rlike("(?i)id$"))


def repo_path(c: Column) -> Column:
    """A path relative to its root, '.' segments left out; null where it is absolute, empty or leads out of the root."""
    parts = F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    bad = F.startswith(c, F.lit("/")) | c.rlike("^[A-Za-z]:") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def common_prefix(paths: Column) -> Column:
    """The longest run of leading segments that all paths of an array share."""
    split = F.transform(paths, lambda p: F.filter(F.split(p, "/"), lambda x: x != ""))
    same = F.aggregate(F.slice(split, F.lit(2), F.greatest(F.size(split) - 1, F.lit(0))), F.get(split, F.lit(0)), lambda acc, p: F.slice(acc, F.lit(1), _agree(acc, p)))
    return F.concat(F.lit("/"), F.array_join(F.coalesce(same, F.array().cast("array<string>")), "/"))


def _agree(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    zipped = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    at = F.array_position(zipped, False)
    return F.when(F.size(zipped) == 0, 0).when(at == 0, F.size(zipped)).otherwise(at - 1).cast("int")


def line_at(text: Column, offset: Column) -> Column:
    """The line, from 1, on which the character at an offset from 0 stands."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1


def change_key(kind: Column, subject: Column, digest: Column) -> Column:
    return F.concat_ws(":", kind, subject, F.substring(F.sha2(digest, 256), 1, 12))


def gate_token(inputs: Column) -> Column:
    """sha256:<hex> of the JSON of a map of strings with its keys in order."""
    pairs = F.transform(F.array_sort(F.map_entries(inputs)), lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit(":"), F.coalesce(F.to_json(F.array(e["value"])), F.lit("null"))))
    bare = F.transform(pairs, lambda p: F.regexp_replace(F.regexp_replace(F.replace(p, F.lit(']:['), F.lit(":")), r"^\[", ""), r"\]$", ""))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("{"), F.array_join(bare, ","), F.lit("}")), 256))


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID of a name within a namespace UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("long")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def handle_encoded(c: Column) -> Column:
    """base64url without padding."""
    return F.regexp_replace(F.translate(F.replace(F.base64(F.encode(c, "UTF-8")), F.lit("\r\n")), "+/", "-_"), "=+$", "")


def handle_decoded(c: Column) -> Column:
    """The text of a handle; null for other characters, more than 2048 of them, or an impossible length."""
    fine = c.rlike("^[A-Za-z0-9_-]+$") & (F.length(c) <= 2048) & (F.length(c) % 4 != 1)
    padded = F.rpad(F.translate(c, "-_", "+/"), (F.ceil(F.length(c) / 4) * 4).cast("int"), "=")
    return F.when(fine, F.try_to_binary(padded, F.lit("base64")).cast("string"))


def strict_instant(c: Column) -> Column:
    """A moment written as YYYY-MM-DDTHH:MM:SSZ; null for any other form and for days that do not exist."""
    shaped = c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    return F.when(shaped, F.try_to_timestamp(F.regexp_replace(c, "[TZ]", " "), F.lit("yyyy-MM-dd HH:mm:ss ")))


def js_round(c: Column) -> Column:
    """Half goes up, also below zero."""
    return F.floor(c + 0.5)


def pct_delta(now: Column, before: Column) -> Column:
    """Change in percent; null without a base."""
    return F.try_divide((now - before) * 100, before)


def semver_key(c: Column) -> Column:
    """A struct that sorts release versions a.b.c; null for anything else."""
    part = lambda i: F.regexp_extract(c, r"^(\d+)\.(\d+)\.(\d+)$", i).cast("long")
    return F.when(c.rlike(r"^\d+\.\d+\.\d+$"), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def key_type(c: Column) -> Column:
    """A key's type by name: uuid however it is spelled, unknown where nothing is said."""
    trimmed = F.trim(F.coalesce(c, F.lit("unknown")))
    low = F.lower(trimmed)
    return F.when(low.isin("uuid", "java.util.uuid"), "uuid").when(low == "non-uuid", "non-uuid").when((trimmed == "") | (low == "unknown"), "unknown").otherwise(trimmed)


def fk_parts(c: Column) -> Column:
    """(table, column, references_table, references_column) of a.b -> c.d, tables as long as they can be; null otherwise."""
    form = r"^(.+)\.([^.]+) -> (.+)\.([^.]+)$"
    return F.when(c.rlike(form), F.struct(*(F.regexp_extract(c, form, i + 1).alias(n) for i, n in enumerate(("table", "column", "references_table", "references_column")))))


def valid_feature_id(c: Column) -> Column:
    return F.coalesce(c.rlike(FEATURE_ID), F.lit(False))


def candidate_source(path: Column) -> Column:
    """Is this a source file that is neither hidden, nor support, test or secret material?"""
    return path.rlike(SOURCE_FILE) & ~path.rlike(HIDDEN_PATH) & ~path.rlike(SUPPORT_FOLDER) & ~path.rlike(TEST_FILE) & ~path.rlike(SECRET_FILE)


def documentation_path(path: Column) -> Column:
    return path.isin(DOCUMENT_FILES) | F.startswith(path, F.lit("docs/"))


def feature_of_path(path: Column) -> Column:
    """The feature a path under specs/ belongs to, null elsewhere."""
    return F.nullif(F.regexp_extract(path, "^specs/([^/]+)/", 1), F.lit(""))


def source_role(path: Column, manifests: list[str]) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return (
        F.when(name.isin("AGENTS.md", "CLAUDE.md"), "instructions")
        .when(path.rlike("(?i)(^|/)(test|tests|__tests__)(/|$)") | name.rlike(r"(?i)\.(test|spec)\.[^.]+$"), "test")
        .when(name.isin(manifests) & (name != "README.md"), "manifest")
        .when(path.rlike("(?i)(^|/)(docs?|documentation)(/|$)") | name.rlike(r"(?i)\.(md|mdx|rst|txt)$"), "documentation").otherwise("source")
    )


def security_names(requirements: Column) -> Column:
    """Scheme names of an array of maps: null is '', none is said to be declared so, else sorted and distinct."""
    names = F.array_sort(F.array_distinct(F.flatten(F.transform(requirements, F.map_keys))))
    return F.when(requirements.isNull(), "").when(F.size(names) == 0, "(source-declared: none)").otherwise(F.array_join(names, ", "))


def address_class(c: Column) -> Column:
    """The kind of a dotted IPv4 address; invalid for anything else."""
    octet = lambda i: F.get(F.split(c, r"\."), F.lit(i)).try_cast("int")
    a, b, d = octet(0), octet(1), octet(2)
    form = c.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$") & (F.greatest(a, b, d, octet(3)) <= 255)
    private = (a == 10) | ((a == 100) & b.between(64, 127)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    reserved = ((a == 192) & (b == 0) & d.isin(0, 2)) | ((a == 192) & (b == 88) & (d == 99)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (d == 100)) | ((a == 203) & (b == 0) & (d == 113))
    return (
        F.when(~F.coalesce(form, F.lit(False)), "invalid").when(a == 0, "unspecified").when(private, "private").when(a == 127, "loopback").when((a == 169) & (b == 254), "link-local")
        .when(reserved | (a >= 240), "reserved").when(a >= 224, "multicast").otherwise("public")
    )


def blocks(policy: Column, status: Column) -> Column:
    """Does a gate's result block?  A required gate unless it passes; one required when present only once it has run."""
    return F.when(status == "pass", False).when(policy == "required", True).otherwise(status != "not_run")
