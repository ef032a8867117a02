"""Components of undirected graphs, and walks down a hierarchy."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.operators.running import in_ranges, running
from sievemark.session import written


#: A graph of so few edges is one task's work.
SMALL = 100_000


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    """label, to: each node of the edges and one that stands for all that it reaches."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(rows["a"], rows["b"], strict=True):
        a, b = top(a), top(b)
        if a != b:
            up[b] = a
    return pd.DataFrame({"label": list(up), "to": [top(x) for x in list(up)]})


def components(edges: DataFrame, name: str = "components", small: int = SMALL) -> DataFrame:
    """node, root (the smallest node reachable): of every node of the undirected edges a, b.

    Each round points every node at the first, in a hashed order, of its neighbours' neighbours, follows these
    pointers once more and contracts the graph, which shrinks it by a factor; what a hub receives is combined before
    it is shuffled, and the joins' skewed sides can be split. Every round is written to the shared folder; when no more than
    `small` edges are left, a task joins what is left of the graph."""
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("n"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), name)
    labels = nodes.select("node", F.col("node").alias("label"))
    while edges.count() > small:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = both.groupBy("u").agg(F.min(order(F.col("v"))).alias("m")).select("u", F.least("m", order(F.col("u"))).alias("m"))
        near = written(near, name)  # a join with a plain table can split a hub's side
        far = both.join(near, "u").groupBy("v").agg(F.min("m").alias("m"))
        points = written(far.select(F.col("v").alias("u"), F.least("m", order(F.col("v")))["n"].alias("p")), name)
        again = points.select(F.col("u").alias("p"), F.col("p").alias("q"))
        jump = written(points.join(again, "p").select(F.col("u").alias("label"), F.col("q").alias("to")), name)
        labels = labels.join(jump, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        left, right = jump.select(F.col("label").alias("a"), F.col("to").alias("x")), jump.select(F.col("label").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), name)
    kind = edges.schema["a"].dataType.simpleString()
    rest = edges.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(_joined, f"label {kind}, to {kind}")
    labels = written(labels.join(rest, "label", "left").select("node", F.coalesce("to", "label").alias("label")), name)
    smallest = written(labels.groupBy("label").agg(F.min("node").alias("root")), name)
    return labels.join(smallest, "label").select("node", "root")


#: Fixed value: what the names of components begin with.
PREFIX = "phashcc_"


def component_ids(members: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """root, component_id (a hash of all members, sorted), members: of the components node, root."""
    names = F.array_sort(F.collect_set(F.col("node").cast("string")))
    grouped = members.groupBy("root").agg(names.alias("names"))
    return grouped.select("root", F.concat(F.lit(prefix), F.substring(F.sha2(F.array_join("names", "\n"), 256), 1, 16)).alias("component_id"), F.size("names").alias("members"))


def walk_down(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """node, depth (the first at which it is met): breadth first from roots (node) over parent, child, `depth` steps at most."""
    seen = roots.select("node", F.lit(0).alias("depth")).distinct()
    front = seen
    for step in range(1, depth + 1):
        front = front.join(edges, front["node"] == edges["parent"]).select(F.col("child").alias("node"), F.lit(step).alias("depth")).distinct()
        front = written(front.join(seen.select("node"), "node", "left_anti"), "walk")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def walk_files(members: DataFrame, root: str, depth: int, most: int) -> DataFrame:
    """file, place (from 1): the first `most` files below a root as a queue meets them, down to `depth` categories.

    members: parent, position (unique within a parent), child, is_file. A queue visits categories level by level, each once,
    in the order of their first mention: by the place of the category that names them, then by position. Files are met in the
    same order, and the first mention counts. So each level's categories are numbered behind those before, a level's files
    are told from those met already, and the walk ends where there are enough of them; a running count cuts the last level."""
    spark = members.sparkSession
    if most < 1:
        return spark.createDataFrame([], "file string, place long")
    members = members.select("parent", F.col("position").cast("long").alias("position"), "child", "is_file")
    front = spark.createDataFrame([(root, 1)], "node string, place long")
    seen, files, visited, met = front, None, 1, 0
    first = F.min(F.struct("place", "position")).alias("at")
    order = [("by", True), ("position", True)]
    for level in range(depth + 1):
        named = members.join(front.withColumnRenamed("node", "parent"), "parent")
        new = named.where("is_file").groupBy(F.col("child").alias("file")).agg(first).select("file", F.lit(level).alias("level"), F.col("at.place").alias("by"), F.col("at.position").alias("position"))
        new = written(new if files is None else new.join(files.select("file"), "file", "left_anti"), "files")
        files = new if files is None else files.unionByName(new)
        met += new.count()
        if met >= most or level == depth:
            break
        below = named.where("NOT is_file").groupBy(F.col("child").alias("node")).agg(first).select("node", F.col("at.place").alias("by"), F.col("at.position").alias("position"))
        below = below.join(seen.select("node"), "node", "left_anti")
        numbered = running(in_ranges(below, [], order), [], order, {"place": F.lit(1).cast("long")})
        front = written(numbered.select("node", (F.col("place") + visited).alias("place")), "front")
        more = front.count()
        if not more:
            break
        visited += more
        seen = seen.unionByName(front)
    order = [("by", True), ("position", True)]  # categories' places rise over the levels
    counted = running(in_ranges(files, [], order), [], order, {"place": F.lit(1).cast("long")})
    return counted.where(F.col("place") <= most).select("file", "place")
