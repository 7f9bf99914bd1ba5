"""Graph traversal by frontier joins; each round is written to the shared folder, so lineage stays short and executors may be lost."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.cuts import cut as _cut
from lodestar.operators.cuts import tasks

LARGE = 10_000  # vertices of a component from which its size is sent to all tasks


def bfs_levels(edges: DataFrame, source: int) -> DataFrame:
    """(vertex, level): fewest edges from the source."""
    frontier = edges.sparkSession.createDataFrame([(source, 0)], f"vertex {edges.schema['dst'].dataType.simpleString()}, level int")
    seen = frontier
    while True:
        reached = edges.join(frontier, edges["src"] == frontier["vertex"]).select(F.col("dst").alias("vertex"), (F.col("level") + 1).alias("level")).distinct()
        frontier = _cut(reached.join(seen, "vertex", "left_anti").select("vertex", "level"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def topological_levels(edges: DataFrame) -> tuple[DataFrame, bool]:
    """((vertex, level), whether there is a cycle): the longest path to each vertex, by taking away edges whose source has no predecessor.

    A vertex has the level of the last round in which an edge still leads to it. Edges may occur more than once.
    """
    left, n = edges.select("src", "dst").where("src is not null or dst is not null"), tasks(edges)
    reached, before, level = [], None, 0
    while True:
        level += 1
        targets = _cut(left.where("dst is not null").select(F.col("dst").alias("vertex")).repartition(n, "vertex").distinct())
        count = targets.count()
        if not count or count == before:
            break
        reached.append(targets.withColumn("level", F.lit(level)))
        rest = left.repartition(n, "src").join(targets, F.col("src") == F.col("vertex"))  # a semi join would go below the repartition
        left, before = _cut(rest.select("src", "dst")), count
        n = tasks(left)
    starts = edges.select(F.col("src").alias("vertex")).where("vertex is not null").withColumn("level", F.lit(0))
    levels = functools.reduce(DataFrame.unionByName, reached, starts).repartition(tasks(edges), "vertex").groupBy("vertex").agg(F.max("level").alias("level"))
    if count:  # these are on a cycle or behind one
        levels = levels.join(targets, "vertex", "left_anti")
    return levels, count > 0


def reaches(edges: DataFrame, start: int, end: int) -> bool:
    """Whether a path of one edge or more leads from start to end."""
    found, seen = edges.where(F.col("src") == start), None
    while True:
        found = found.select(F.col("dst").alias("vertex")).where("vertex is not null").distinct()
        frontier = _cut(found if seen is None else found.join(seen, "vertex", "left_anti"))
        if frontier.where(F.col("vertex") == end).limit(1).count():
            return True
        if frontier.isEmpty():
            return False
        seen = frontier if seen is None else seen.unionByName(frontier)
        found = edges.repartition(tasks(edges), "src").join(frontier, F.col("src") == F.col("vertex")).select("dst")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex, component, size): the smallest id reachable over undirected edges.

    Every vertex goes to its smallest neighbour if that is smaller, and on to where that goes; then the edges are contracted. A
    vertex that has moved is gone, so each round has fewer. Edges may occur more than once.
    """
    n = tasks(edges)
    left, moves = edges.select("src", "dst").where("src <> dst"), []
    while True:
        ends = left.union(left.select("dst", "src")).groupBy("src").agg(F.min("dst").alias("near"))
        to = _cut(ends.select(F.col("src").alias("v"), F.least("src", "near").alias("to")))
        if to.isEmpty():
            break
        moving, m = True, tasks(to)
        while moving:  # to the end, so that none of those that stay has moved
            after = to.select(F.col("v").alias("by"), F.col("to").alias("far"))
            step = _cut(to.repartition(m, "to").join(after.repartition(m, "by"), F.col("to") == F.col("by")).select("v", F.col("far").alias("to"), (F.col("far") < F.col("to")).alias("moving")))
            to, moving = step.drop("moving"), not step.where("moving").isEmpty()
        moves.append(to.where("v <> to"))
        a, b = to.select(F.col("v").alias("src"), F.col("to").alias("a")), to.select(F.col("v").alias("dst"), F.col("to").alias("b"))
        met = left.repartition(n, "src").join(a, "src").select("a", "dst").repartition(n, "dst").join(b, "dst").where("a <> b")
        left = _cut(met.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        n = tasks(left)
    labels = vertices.select(F.col("id").alias("vertex"))
    roots = None
    for move in reversed(moves):  # a vertex moves in one round only
        if roots is not None:
            later = roots.select(F.col("v").alias("to"), F.col("to").alias("root"))
            move = _cut(move.join(later, "to", "left").select("v", F.coalesce("root", "to").alias("to")))
            roots = roots.unionByName(move)
        else:
            roots = move
    if roots is None:
        return labels.select("vertex", F.col("vertex").alias("component"), F.lit(1).cast("long").alias("size"))
    n = tasks(labels)
    labels = _cut(labels.repartition(n, "vertex").join(roots.repartition(n, "v"), F.col("vertex") == F.col("v"), "left").select("vertex", F.coalesce("to", "vertex").alias("component")))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    large = labels.join(F.broadcast(sizes.where(F.col("size") > LARGE)), "component", "left")  # so that no task gets all rows of one
    small = large.where("size is null").drop("size").join(sizes, "component")
    return large.where("size is not null").unionByName(small).select("vertex", "component", "size")
