"""Routes of FastAPI projects: routers, imports, aliases and mounts over the files of a repository, resolved together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.graph import alias_targets, mounted_routes
from factloom.sources.delimiters import calls_of, shielded, unshielded
from factloom.sources.tables import durable

_ROUTER = r"(?:\A|\n)[ \t]*(\w+)[ \t]*(?::[^=\n]+)?=[ \t]*(?:\w+\.)?(APIRouter|FastAPI)\s*"
_MOUNT = r"\b(\w+)\s*\.\s*include_router\s*"
_VERB = r"@[ \t]*(\w+)\s*\.\s*(get|post|put|patch|delete)\s*"
_DEF = r"\bdef[ \t]+(\w+)\s*"
_FROM = r"(?m)^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]+(\([^)]*\)|[^\n(]+)"
_IMPORT = r"(?m)^[ \t]*import[ \t]+([^\n]+)"
_LITERAL = r"^[rRuU]?(?:\"([^\"\\]*)\"|'([^'\\]*)')$"


def module_name(path: Column) -> Column:
    """The dotted name of a Python file."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), "/", ".")


def _literal(c: Column) -> Column:
    """The value of a string literal; null for anything else."""
    return F.when(c.rlike(_LITERAL), unshielded(F.concat(F.regexp_extract(c, _LITERAL, 1), F.regexp_extract(c, _LITERAL, 2))))


def _keyword(name: str) -> Column:
    found = F.get(F.filter("args", lambda a: a.rlike(rf"^{name}\s*=[^=]")), F.lit(0))
    return F.regexp_replace(found, rf"^{name}\s*=\s*", "")


def _first(keyword: str) -> Column:
    """The first argument, by place or by keyword."""
    at = F.get("args", F.lit(0))
    return F.when(~at.rlike(r"^\w+\s*=[^=]"), at).otherwise(_keyword(keyword))


def _key(module: Column, name: Column) -> Column:
    return F.concat_ws("#", module, name)


def imports(files: DataFrame) -> DataFrame:
    """(repo, module, local, source, name) of files (repo, module, package, code): what each imported name stands for; name is
    null for modules."""
    statement = lambda pattern: F.explode(F.regexp_extract_all("code", F.lit(f"({pattern})"), F.lit(1)))
    line = files.select("repo", "module", "package", statement(_FROM).alias("s"))
    listed = F.split(F.regexp_replace(F.regexp_extract("s", _FROM, 2), r"[()\\\s]+", " "), ",")
    item = line.select("repo", "module", "package", F.regexp_extract("s", _FROM, 1).alias("of"), F.explode(F.transform(listed, lambda x: F.trim(x))).alias("i")).where("i <> ''")
    dots = F.length(F.regexp_extract("of", r"^(\.*)", 1))
    parts = F.filter(F.split("package", r"\."), lambda x: x != "")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - dots + 1)), ".")
    rest = F.regexp_replace("of", r"^\.+", "")
    source = F.when(dots == 0, F.col("of")).otherwise(F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(rest, F.lit(""))))
    name, local = F.regexp_extract("i", r"^(\w+)", 1), F.regexp_extract("i", r"(\w+)$", 1)
    froms = item.select("repo", "module", local.alias("local"), source.alias("source"), name.alias("name"))
    whole = files.select("repo", "module", statement(_IMPORT).alias("s")).select("repo", "module", F.explode(F.split(F.regexp_extract("s", _IMPORT, 1), ",")).alias("i")).withColumn("i", F.trim("i"))
    named = F.regexp_extract("i", r"\bas\s+(\w+)$", 1)
    plain = F.regexp_extract("i", r"^([.\w]+)", 1)
    wholes = whole.where(plain != "").select("repo", "module", F.when(named != "", named).otherwise(plain).alias("local"), plain.alias("source"), F.lit(None).cast("string").alias("name"))
    return froms.unionByName(wholes).distinct()


def fastapi_routes(files: DataFrame, repo: str, path: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(endpoints, unknowns).  endpoints: repo, root and module#router that has the route, verb, path with the prefixes of all
    mounts on the way, function.  unknowns: repo, module, at, reason, for what source text does not prove.

    A router is told by its assignment; one that is assigned twice in a module is ambiguous, and a prefix that is no literal is
    unknown: their routes and mounts are not given.  include_router is followed through imports, relative ones, aliases and names
    that a package passes on; of a router in the same file it has what stands before it.  Comments and strings hold no code; of
    a path that occurs twice the least text counts; null texts hold nothing."""
    rows = files.where(F.col(path).rlike(r"\.py$")).groupBy(F.col(repo).alias("repo"), F.col(path).alias("file")).agg(F.min(text).alias("text"))
    package = F.when(F.col("file").rlike(r"(^|/)__init__\.py$"), module_name(F.col("file"))).otherwise(F.regexp_replace(module_name(F.col("file")), r"\.?[^.]*$", ""))
    code = durable(rows.select("repo", module_name(F.col("file")).alias("module"), package.alias("package"), shielded(F.col("text"), "hash").alias("code")), broadcast=False)
    keys, head = ["repo", "module"], lambda pattern, n: F.regexp_extract("head", rf"(?is){pattern}", n)
    called = durable(calls_of(code, keys, F.col("code"), {"router": _ROUTER, "mount": _MOUNT, "verb": _VERB, "def": _DEF}), broadcast=False)
    own = lambda kind: called.where(F.col("kind") == kind)

    prefix = lambda: F.when(_keyword("prefix").isNull(), "").otherwise(_literal(_keyword("prefix")))
    made = own("router").select(*keys, "at", head(_ROUTER, 1).alias("var"), prefix().alias("prefix"))
    routers = made.groupBy(*keys, "var").agg(F.count("*").alias("n"), F.min("prefix").alias("prefix"), F.min("at").alias("at"))
    routers = durable(routers.withColumn("node", F.concat_ws("|", "repo", _key(F.col("module"), F.col("var")))), broadcast=False)

    used = imports(code)
    modules = code.select("repo", "module").distinct()
    known = used.join(modules.withColumnRenamed("module", "source"), ["repo", "source"], "left_semi")
    target = F.concat_ws("|", "repo", _key(F.col("source"), F.col("name")))
    aliases = known.where("name IS NOT NULL").groupBy(F.concat_ws("|", "repo", _key(F.col("module"), F.col("local"))).alias("name")).agg(F.min(target).alias("next"), F.count_distinct(target).alias("n"))
    aliases = aliases.where("n = 1 AND name <> next").drop("n").join(routers.select(F.col("node").alias("name")), "name", "left_anti")
    sub_ = used.where("name IS NOT NULL").select("repo", "module", "local", F.concat_ws(".", "source", "name").alias("source"))
    as_module = sub_.unionByName(used.where("name IS NULL").select("repo", "module", "local", "source")).join(modules.withColumnRenamed("module", "source"), ["repo", "source"], "left_semi")

    mounts = own("mount").select(*keys, "at", head(_MOUNT, 1).alias("var"), _first("router").alias("child"), prefix().alias("path"))
    outer, last = F.regexp_extract("child", r"^([\w.]+)\.\w+$", 1), F.regexp_extract("child", r"^(?:[\w.]+\.)?(\w+)$", 1)
    mounts = mounts.withColumns({"local": outer, "last": last}).join(as_module.groupBy("repo", "module", "local").agg(F.min("source").alias("source"), F.count("*").alias("n")).where("n = 1"), ["repo", "module", "local"], "left")
    meant = F.when((F.col("local") == "") & (F.col("last") != ""), _key(F.col("module"), F.col("last"))).when(F.col("source").isNotNull(), _key(F.col("source"), F.col("last")))
    mounts = mounts.withColumn("meant", F.when(meant.isNotNull(), F.concat_ws("|", "repo", meant)))
    ends = alias_targets(aliases).select(F.col("name").alias("meant"), "target", F.lit(True).alias("_alias"))
    mounts = durable(mounts.join(ends, "meant", "left").withColumn("node", F.concat_ws("|", "repo", _key(F.col("module"), F.col("var")))).withColumn("child", F.when(F.col("_alias"), F.col("target")).otherwise(F.col("meant"))), broadcast=False)

    verbs = own("verb").select(*keys, "at", head(_VERB, 1).alias("var"), F.upper(head(_VERB, 2)).alias("verb"), _first("path").alias("arg"))
    defs = own("def").select(*keys, "at", head(_DEF, 1).alias("function"))
    events = verbs.unionByName(defs, allowMissingColumns=True)
    after = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    routes = events.withColumn("function", F.first("function", ignorenulls=True).over(after)).where("verb IS NOT NULL")
    routes = durable(routes.withColumns({"path": _literal(F.col("arg")), "node": F.concat_ws("|", "repo", _key(F.col("module"), F.col("var")))}), broadcast=False)

    nodes = routers.select("node", F.col("module").alias("file"), F.col("prefix").alias("base"), ((F.col("n") == 1) & F.col("prefix").isNotNull()).alias("literal"))
    lines = mounts.select("node", "at", F.coalesce("path", F.lit("")).alias("path"), F.when(F.col("path").isNotNull(), F.col("child")).alias("child"))
    endpoints, notes = mounted_routes(nodes, routes.where("path IS NOT NULL").select("node", "at", "verb", "path"), lines)
    named = endpoints.withColumn("at", F.element_at("ats", -1)).join(routes.select("node", "at", "verb", "repo", "function"), ["node", "at", "verb"])
    bare = lambda c: F.regexp_replace(c, r"^[^|]*\|", "")
    endpoints = named.select("repo", bare(F.col("root")).alias("root"), bare(F.col("node")).alias("router"), "verb", "path", "function")

    there = routers.select("node", "n", "prefix")
    reason = F.when(F.col("path").isNull(), "route-path-not-literal").when(F.col("n").isNull(), "router-variable-not-locally-declared").when(F.col("n") > 1, "router-ambiguous").when(F.col("prefix").isNull(), "router-prefix-not-literal")
    unknown = routes.join(there, "node", "left").select("repo", "module", "at", reason.alias("reason"))
    seen = mounts.select("repo", "module", "at", "node", "path").join(there.select("node", F.lit(True).alias("_there")), "node", "left")
    dynamic = seen.where("path IS NULL").select("repo", "module", "at", F.lit("mount-prefix-not-literal").alias("reason"))
    strange = seen.where("_there IS NULL").select("repo", "module", "at", F.lit("mount-receiver-not-a-router").alias("reason"))
    lost = notes.where("note <> 'base-not-literal'").join(mounts.where("path IS NOT NULL").select("repo", "module", "node", "at"), ["node", "at"]).select(
        "repo", "module", "at", F.when(F.col("note") == "cycle", "mount-cycle").otherwise("mount-child-not-resolved").alias("reason"))
    return endpoints, unknown.where("reason IS NOT NULL").unionByName(dynamic).unionByName(strange).unionByName(lost).distinct()
