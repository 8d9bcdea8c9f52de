"""Directed graphs as edge tables (src, dst): degrees, bounded traversal, chains.

Traversal is level by level: a frontier is joined with the edges, nodes seen before
are anti-joined away, and each level is written to the shared folder, so plans stay
flat and a lost executor repeats one level at most. Many start nodes run together,
each under its own query_id.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.paths import dotted_prefixes
from corpusloom.sources.scratch import Scratch

MAX_NODES = 5000


def edge_table(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) without self edges and nulls."""
    return edges.select("src", "dst").where("src <> dst").distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) in one shuffle."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return edges.select(ends.alias("x")).groupBy("x.node").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))


def neighbours(edges: DataFrame, node, outgoing: bool = True) -> DataFrame:
    """One hop; an unknown node is an error."""
    if edges.where((F.col("src") == node) | (F.col("dst") == node)).isEmpty():
        raise ValueError(f"unknown node: {node}")
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("node")) if outgoing else edges.where(F.col("dst") == node).select(F.col("src").alias("node"))
    return out.distinct().orderBy("node")


def reach(edges: DataFrame, starts: DataFrame, max_depth: int, max_nodes: int | None = None, cycles: bool = False) -> DataFrame:
    """(query_id, node, depth) for nodes within max_depth steps.

    starts: (query_id, node). They are left out; with cycles, one that a step leads back to
    is a node like others. With max_nodes, the nodes of a query are kept in the order of
    depth and name.
    """
    if max_depth < 0:
        raise ValueError("max_depth must not be negative")
    spark = edges.sparkSession
    scratch = Scratch(spark, "reach")
    seen = scratch.save(starts.select("query_id", "node", F.lit(0).alias("depth")).distinct())
    frontier, levels = seen, [seen]
    for depth in range(1, max_depth + 1):
        step = frontier.select("query_id", F.col("node").alias("src")).join(edges, "src").select("query_id", F.col("dst").alias("node")).distinct()
        for level in levels[1:] if cycles else levels:
            step = step.join(level.select("query_id", "node"), ["query_id", "node"], "left_anti")
        frontier = scratch.save(step.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        levels.append(frontier)
    found = reduce(DataFrame.unionByName, levels).where("depth > 0")
    if max_nodes is None:
        return found
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("depth", "node"))
    return found.withColumn("_n", order).where(F.col("_n") <= max_nodes).drop("_n")


def expand(edges: DataFrame, seeds: DataFrame, max_depth: int = 1, max_expanded: int = 12, direction: str = "both") -> DataFrame:
    """(query_id, node, distance, role): files around the seeds.

    A node takes the role of its first reach: along an edge a dependency, against it
    a dependent; within a level the seeds' order decides, edges along before against,
    then names. The first max_expanded stay.
    """
    scratch = Scratch(edges.sparkSession, "expand")
    roles = {"dependency": edges, "dependent": reverse(edges)}
    used = [r for r in roles if direction in ("both", {"dependency": "dependencies", "dependent": "dependents"}[r])]
    by_node = Window.partitionBy("query_id").orderBy("node")
    start = scratch.save(seeds.select("query_id", "node").distinct().withColumn("seq", F.row_number().over(by_node)))
    frontier, levels = start, [start.select("query_id", "node")]
    found = []
    for depth in range(1, max_depth + 1):
        parts = []
        for at, role in enumerate(used):
            hop = frontier.select("query_id", F.col("node").alias("src"), "seq").join(roles[role], "src")
            parts.append(hop.select("query_id", F.col("dst").alias("node"), F.struct("seq", F.lit(at).alias("way"), F.col("dst").alias("name")).alias("order"), F.lit(role).alias("role")))
        step = reduce(DataFrame.unionByName, parts).groupBy("query_id", "node").agg(F.min(F.struct("order", "role")).alias("first"))
        for level in levels:
            step = step.join(level, ["query_id", "node"], "left_anti")
        step = step.select("query_id", "node", F.col("first.role").alias("role"), F.row_number().over(Window.partitionBy("query_id").orderBy("first.order")).alias("seq"))
        frontier = scratch.save(step.withColumn("distance", F.lit(depth)))
        if frontier.isEmpty():
            break
        levels.append(frontier.select("query_id", "node"))
        found.append(frontier)
    if not found:
        return start.limit(0).select("query_id", "node", F.lit(0).alias("distance"), F.lit("").alias("role"))
    every = reduce(DataFrame.unionByName, found)
    kept = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "seq"))
    return every.withColumn("_n", kept).where(F.col("_n") <= max_expanded).select("query_id", "node", "distance", "role")


def shortest_chain(edges: DataFrame, starts: DataFrame, max_depth: int = 6) -> DataFrame:
    """(query_id, node, chain): one shortest path from the start, least by name."""
    scratch = Scratch(edges.sparkSession, "chain")
    first = scratch.save(starts.select("query_id", "node", F.array(F.col("node")).alias("chain")))
    frontier, levels = first, [first]
    for _ in range(max_depth):
        step = frontier.select("query_id", F.col("node").alias("src"), "chain").join(edges, "src")
        step = step.groupBy("query_id", F.col("dst").alias("node")).agg(F.min(F.concat("chain", F.array("dst"))).alias("chain"))
        for level in levels:
            step = step.join(level.select("query_id", "node"), ["query_id", "node"], "left_anti")
        frontier = scratch.save(step)
        if frontier.isEmpty():
            break
        levels.append(frontier)
    return reduce(DataFrame.unionByName, levels)


def longest_prefix(names: DataFrame, table: DataFrame) -> DataFrame:
    """(name, target, value): the deepest dotted prefix of each name that table has.

    names: (name); table: (key, value). Prefixes are joined by equality.
    """
    parts = names.select("name").distinct().select("name", F.posexplode(dotted_prefixes(F.col("name"))).alias("depth", "key"))
    hit = parts.join(table, "key")
    return hit.groupBy("name").agg(F.max(F.struct("depth", "key", "value")).alias("x")).select("name", F.col("x.key").alias("target"), F.col("x.value").alias("value"))


def direct_dependents(uses: DataFrame, imports: DataFrame) -> DataFrame:
    """Users of a target that import it as well: a semi-join of edges on edges."""
    return uses.select("src", "dst").distinct().join(imports.select("src", "dst").distinct(), ["src", "dst"], "left_semi")


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(group, node, layer): longest-path layers of each group's own small graph.

    nodes: (group, node); edges: (group, src, dst), src depending on dst. A node lies
    above all that it depends on; passes are bounded by the group's size, which ends
    cycles. A group is a subsystem's packages, so it is small.
    """

    def run(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        level = dict.fromkeys(sorted(n["node"]), 0)
        pairs = sorted((a, b) for a, b in zip(e["src"], e["dst"], strict=True) if a in level and b in level and a != b)
        for _ in range(len(level)):
            moved = False
            for a, b in pairs:
                if level[a] < level[b] + 1 <= len(level):
                    level[a], moved = level[b] + 1, True
            if not moved:
                break
        return pd.DataFrame({"group": [key[0]] * len(level), "node": list(level), "layer": list(level.values())})

    return nodes.groupBy("group").cogroup(edges.groupBy("group")).applyInPandas(run, f"group {nodes.schema['group'].dataType.simpleString()}, node {nodes.schema['node'].dataType.simpleString()}, layer int")
