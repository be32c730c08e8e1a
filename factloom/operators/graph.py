"""Bounded graph iterations over edge tables; each level is written down, so lost executors cost one level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import joined_route
from factloom.sources.tables import durable


#: Tables of levels that are put together into one.
_LEVELS = 16


def hops(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(node, dist) for every node that edges (src, dst) reach from seeds (node); seeds are at 0."""
    front = durable(seeds.select("node").distinct().withColumn("dist", F.lit(0).cast("long")))
    edges = durable(edges.select("src", "dst"))  # repeated ones do no harm: a level is distinct
    seen, level = front, 0
    while most is None or level < most:
        front = durable(edges.join(front, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("dist", F.lit(level + 1).cast("long")))
        if front.isEmpty():
            break
        seen, level = seen.unionByName(front), level + 1  # a level is written once; the many small tables of a deep graph are put together
        if level % _LEVELS == 0:
            seen = durable(seen)
    return seen


def invalidated(edges: DataFrame, nodes: DataFrame, changed: DataFrame, everything: bool = False) -> DataFrame:
    """hops from the changed nodes over edges dependency to dependent; from all nodes (node) too where everything is set."""
    seeds = changed.select("node").unionByName(nodes.select("node")) if everything else changed
    return hops(edges, seeds)


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge (src, dst) once in either direction; repeated ones, and those given both ways, are one before they are turned."""
    turned = F.coalesce(F.col("src") > F.col("dst"), F.col("src").isNull())
    pairs = edges.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("b")).distinct()
    way = lambda src, dst: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"))
    both = F.when(F.col("a").eqNullSafe(F.col("b")), F.array(way("a", "b"))).otherwise(F.array(way("a", "b"), way("b", "a")))
    return pairs.select(F.inline(both))


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes left when those without incoming edges have been peeled off again and again."""
    left = durable(edges.select("src", "dst").distinct())
    while True:
        has_in = left.select(F.col("dst").alias("src")).distinct()
        kept = durable(left.join(has_in, "src", "left_semi"))
        if kept.count() == left.count():
            break
        left = kept
    return kept.select(F.col("src").alias("node")).unionByName(kept.select(F.col("dst").alias("node"))).distinct()


def impact_graph(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): of several definitions (id, type, label) of a node the first counts, in the order of the tables and of
    `ordinal` within one; edges (source, target, relation) keep their duplicates, and stay only between known nodes."""
    all_ = reduce(DataFrame.unionByName, (n.withColumn("_t", F.lit(i)) for i, n in enumerate(nodes)))
    rest = [c for c in all_.columns if c not in ("id", "ordinal", "_t")]
    known = all_.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("_t", "ordinal")).alias("r")).select("id", "r.*")
    ids = known.select("id")
    kept = reduce(DataFrame.unionByName, edges).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return known, kept


def collapsed(edges: DataFrame, dist: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with every node farther than `most` made one, 'beyond'; edges are led there, the first of each pair
    stays, and none leads from it to itself."""
    name = F.when(F.col("dist") <= most, F.col("node")).otherwise("beyond")
    nodes = dist.select(name.alias("node"), F.least("dist", F.lit(most + 1).cast("long")).alias("ring")).distinct()
    at = dist.select("node", name.alias("as"))
    led = edges.join(at.select(F.col("node").alias("src"), F.col("as").alias("a")), "src").join(at.select(F.col("node").alias("dst"), F.col("as").alias("b")), "dst")
    return nodes, led.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def prefix_chains(mounts: DataFrame) -> DataFrame:
    """(node, prefix): every concatenation of prefixes from a root to a node over mounts (parent, child, prefix), distinct.

    Roots are parents that nothing mounts; a path that comes back to a node on it adds nothing.
    """
    roots = mounts.select(F.col("parent").alias("node")).distinct().join(mounts.select(F.col("child").alias("node")), "node", "left_anti")
    front = durable(roots.select("node", F.lit("").alias("prefix"), F.array("node").alias("seen")))
    out = front
    while front.limit(1).count():
        step = front.join(mounts, F.col("node") == F.col("parent")).where(~F.array_contains("seen", F.col("child")))
        front = durable(step.select(F.col("child").alias("node"), F.concat(front["prefix"], mounts["prefix"]).alias("prefix"), F.array_append("seen", F.col("child")).alias("seen")).distinct())
        out = out.unionByName(front)
    return out.select("node", "prefix").distinct()


def _below(path: str):
    """A path under the prefix and base of a node."""
    return F.regexp_replace(joined_route(joined_route(F.col("prefix"), F.col("base")), F.col(path)), "/+", "/")


def mounted_routes(nodes: DataFrame, routes: DataFrame, mounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(endpoints, notes) of applications (node, file, base, literal) with routes (node, at, verb, path) and mounts (node, at, path,
    child), at being the place in the source.

    A mount has of its child in the same file just what stands before the mount there, and of one in another file all.  Roots are
    the nodes that nothing mounts, or all where there are none.  endpoints: root, node, verb, path, and ats, the places of the
    mounts and the route, in whose order they come.  notes: node, at, note; a base that is no literal gives neither routes nor
    mounts, an unresolved child and a mount that leads back to a node above it give nothing.
    """
    apps = durable(nodes.select("node", "file", "base", "literal"))
    lines = mounts.select("node", "at", "path", "child").join(apps.select(F.col("node").alias("child"), F.col("file").alias("_child_file")), "child", "left")
    lines = durable(lines)
    taken = lines.where("_child_file IS NOT NULL").select(F.col("child").alias("node"))
    roots = apps.join(taken, "node", "left_anti")
    roots = roots if not roots.isEmpty() else apps
    end = F.lit(None).cast(lines.schema["at"].dataType)
    front = durable(roots.select(F.col("node").alias("root"), "node", F.lit("").alias("prefix"), end.alias("upto"), F.array().cast(f"array<{lines.schema['at'].dataType.simpleString()}>").alias("ats"), F.array("node").alias("above")))
    found, notes = [], []
    while not front.isEmpty():
        here = front.join(apps, "node")
        before = lambda df: (df["node"] == here["node"]) & (here["upto"].isNull() | (df["at"] < here["upto"]))  # noqa: E731, B023
        own = routes.select("node", "at", "verb", F.col("path").alias("_path"))
        own = here.join(own, before(own)).select("root", here["node"], "literal", "verb", "at", _below("_path").alias("path"), F.array_append("ats", F.col("at")).alias("ats"))
        found.append(own.where("literal").select("root", "node", "verb", "path", "ats"))
        down = here.join(lines, before(lines)).select("root", here["node"], "file", "literal", "at", "child", "_child_file", "above", "ats", _below("path").alias("prefix"))
        note = F.when(~F.col("literal"), "base-not-literal").when(F.col("_child_file").isNull(), "child-unresolved").when(F.array_contains("above", F.col("child")), "cycle")
        down = durable(down.withColumn("note", note))
        notes += [down.where("note IS NOT NULL").select("node", "at", "note"), own.where("NOT literal").select("node", "at", F.lit("base-not-literal").alias("note"))]
        cut = F.when(F.col("file") == F.col("_child_file"), F.col("at"))
        front = durable(down.where("note IS NULL").select("root", F.col("child").alias("node"), "prefix", cut.alias("upto"), F.array_append("ats", F.col("at")).alias("ats"), F.array_append("above", F.col("child")).alias("above")))
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, notes).distinct()


def alias_targets(aliases: DataFrame) -> DataFrame:
    """(name, target) of aliases (name, next), followed to the end by doubling the step; target is null on a cycle."""
    way = durable(aliases.select("name", F.col("next").alias("at")), broadcast=False)
    known = way.select(F.col("name").alias("at"), F.lit(True).alias("_more")).distinct()
    names, reach = way.count(), 1
    # after as many doublings every chain has ended but the endless ones; most are short, and all have ended long before
    while reach <= names and not way.join(known, "at", "left_semi").isEmpty():
        way = durable(way.join(way.select(F.col("name").alias("at"), F.col("at").alias("far")), "at", "left").select("name", F.coalesce("far", "at").alias("at")), broadcast=False)
        reach *= 2
    return way.join(known, "at", "left").select("name", F.when(F.col("_more").isNull(), F.col("at")).alias("target"))
