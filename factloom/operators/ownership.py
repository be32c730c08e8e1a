"""Who owns a path: scopes, leases, package edges and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.paths import ancestors


def overlapping(scopes: DataFrame, repo: str, track: str, scope: str) -> DataFrame:
    """(repo, track, scope, other_track, other_scope), once a pair: scopes of two tracks of one repository where one contains
    the other or both are equal, whatever the case.  Each scope meets its own ancestors, not all other scopes."""
    rows = scopes.select(repo, track, scope, F.lower(scope).alias("low")).distinct()
    up = rows.select(repo, F.col(track).alias("other_track"), F.col(scope).alias("other_scope"), F.explode(F.array_append(ancestors(F.col("low")), F.col("low"))).alias("low"))
    pairs = rows.join(up, [repo, "low"]).where(F.col(track) != F.col("other_track"))
    first = F.struct(track, scope) < F.struct("other_track", "other_scope")
    one = lambda c, d: F.when(first, F.col(c)).otherwise(F.col(d)).alias(c)
    two = lambda c, d: F.when(first, F.col(d)).otherwise(F.col(c)).alias(d)
    return pairs.select(repo, one(track, "other_track"), one(scope, "other_scope"), two(track, "other_track"), two(scope, "other_scope")).distinct()


def lease_conflicts(leases: DataFrame, repo: str, track: str, scope: str, at: Column) -> DataFrame:
    """overlapping() of the leases that are active at a moment: issued <= at < expires."""
    return overlapping(leases.where((F.col("issued") <= at) & (at < F.col("expires"))), repo, track, scope)


def classified(paths: DataFrame, path: str, hot: DataFrame, owners: DataFrame) -> DataFrame:
    """(path, class, owners): hot before owned (by one or several whose scope (scope, owner) contains the path) before
    case-fold (only without regard to case) before unowned."""
    up = paths.select(path).distinct().withColumn("scope", F.explode(F.array_append(ancestors(F.col(path)), F.col(path))))
    # a scope is one row with its owners, so a path meets it once, however often it is given
    met = lambda ups, given: ups.join(given.where("scope IS NOT NULL").groupBy("scope").agg(F.collect_set("owner").alias("_owners")), "scope").groupBy(path)
    each = lambda name: F.array_sort(F.array_distinct(F.flatten(F.collect_list("_owners")))).alias(name)
    exact = met(up, owners).agg(each("exact"))
    fold = met(up.withColumn("scope", F.lower("scope")), owners.select(F.lower("scope").alias("scope"), "owner")).agg(each("fold"))
    is_hot = up.join(hot.select("scope").distinct(), "scope", "left_semi").select(path).distinct().withColumn("hot", F.lit(True))
    rows = paths.join(is_hot, path, "left").join(exact, path, "left").join(fold, path, "left")
    kind = F.when(F.col("hot"), "hot").when(F.size("exact") > 1, "multiple").when(F.size("exact") == 1, "owned").when(F.size("fold") > 0, "case-fold").otherwise("unowned")
    return rows.select(path, kind.alias("class"), F.array_join(F.coalesce("exact", "fold", F.array().cast("array<string>")), ",").alias("owners"))


def package_edges(dependencies: DataFrame, packages: DataFrame) -> DataFrame:
    """(project, name, target, status) of dependencies (project, name) on local packages (name, project): external ones and
    a project's own go, several owners are ambiguous."""
    owners = packages.groupBy("name").agg(F.count_distinct("project").alias("n"), F.min("project").alias("target"))
    rows = dependencies.join(owners, "name").where((F.col("n") > 1) | (F.col("target") != F.col("project")))
    return rows.select("project", "name", F.when(F.col("n") == 1, F.col("target")).alias("target"), F.when(F.col("n") == 1, "local").otherwise("ambiguous").alias("status"))


def resolved_imports(imports: DataFrame, inventory: DataFrame, extensions: list[str]) -> DataFrame:
    """(path, specifier, status, target) of imports (path, specifier): bare without a leading dot, blocked outside the root,
    else resolved, ambiguous or missing by how many of its candidate files the inventory (file) holds."""
    folder = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    # parts of the folder and the specifier; '..' takes one away, and a null marks the way out of the root
    steps = F.filter(F.split("specifier", "/"), lambda x: (x != ".") & (x != ""))
    walked = F.aggregate(steps, folder, lambda acc, x: F.when(x != "..", F.array_append(acc, x)).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.lit(None).cast("array<string>")))
    base = F.array_join(walked, "/")
    rows = imports.select("path", "specifier", F.startswith("specifier", F.lit(".")).alias("local"), base.alias("base")).distinct()
    tries = F.array(F.col("base"), *(F.concat("base", F.lit(e)) for e in extensions), *(F.concat("base", F.lit(f"/index{e}")) for e in extensions))
    hits = rows.where("local AND base IS NOT NULL").select("path", "specifier", F.explode(tries).alias("file")).join(inventory.select("file").distinct(), "file")
    found = hits.groupBy("path", "specifier").agg(F.count("*").alias("n"), F.min("file").alias("target"))
    status = F.when(~F.col("local"), "bare").when(F.col("base").isNull(), "blocked").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return rows.join(found, ["path", "specifier"], "left").select("path", "specifier", status.alias("status"), F.when(status == "resolved", F.col("target")).alias("target"))
