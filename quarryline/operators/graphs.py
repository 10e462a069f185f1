"""Graphs as edges (src, dst) of names and nodes (name, ...): level by level, without paths on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.sources.tables import cut, together

#: Edges that one task may hold to find strong components in linear time; larger graphs are coloured level by level.
ONE_TASK_EDGES = 2_000_000


def callers(edges: DataFrame) -> DataFrame:
    """(name, callers): sorted different sources of each target."""
    return edges.groupBy(F.col("dst").alias("name")).agg(F.sort_array(F.collect_set("src")).alias("callers"))


def callees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("name")).agg(F.sort_array(F.collect_set("dst")).alias("callees"))


def uncalled(nodes: DataFrame, edges: DataFrame, exempt: tuple[str, ...] = ("OB", "DB", "IDB")) -> DataFrame:
    """Nodes that nothing calls, but for those types; user types and structures are not exempt."""
    return nodes.where(~F.col("type").isin(*exempt)).join(edges.select(F.col("dst").alias("name")).distinct(), "name", "left_anti")


def orphans(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes without an incoming link; a link to itself counts as one."""
    return nodes.join(links.select(F.col("dst").alias("name")).distinct(), "name", "left_anti")


def levels(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(name, level, parent): breadth-first from ``starts`` (name); the parent is the smallest name one level up.
    ``most`` stops before the level at which more nodes would be reached."""
    e = edges.select("src", "dst").distinct()
    seen = cut(starts.select("name").distinct().select("name", F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent")))
    level, total, step = 0, seen.count(), seen
    while True:
        front = step.select(F.col("name").alias("src"))
        new = e.join(front, "src").groupBy(F.col("dst").alias("name")).agg(F.min("src").alias("parent")).join(seen.select("name"), "name", "left_anti")
        step = cut(new.select("name", F.lit(level + 1).alias("level"), "parent"))
        n = step.count()
        if not n or most is not None and total + n > most:
            return seen
        seen, total, level = together(seen, step), total + n, level + 1


def entry_distance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, level): calls on the shortest way from a node that nothing calls; nodes that only cycles lead to are absent."""
    return levels(edges, orphans(nodes, edges)).select("name", "level")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst").select(F.col("src").alias("name")).distinct()


def cycles(edges: DataFrame, nodes: DataFrame | None = None, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(name, component): nodes of strong components of two nodes at least, with the component's smallest name.
    With ``nodes``, edges to or from others are ignored.

    Up to ``one_task_edges`` edges one task finds them in linear time; beyond, nodes that lie on no cycle are trimmed and
    the rest is coloured by the smallest name that reaches them, forwards, then collected backwards within a colour.
    """
    e = edges.where("src <> dst").select("src", "dst").distinct()
    if nodes is not None:
        known = nodes.select("name").distinct()
        e = e.join(known.withColumnRenamed("name", "src"), "src", "left_semi").join(known.withColumnRenamed("name", "dst"), "dst", "left_semi")
    e = cut(e)
    if e.count() <= one_task_edges:
        return e.coalesce(1).mapInArrow(_strong, "name string, component string")
    found = None
    while True:
        e = _trimmed(e)
        if not e.take(1):
            return found if found is not None else e.select(F.col("src").alias("name"), F.col("dst").alias("component"))
        colour = _spread(e, e.select(F.col("src").alias("name"), F.col("src").alias("colour")).distinct())
        inside = e.join(colour.select(F.col("name").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("name").alias("dst"), F.col("colour").alias("c2")), "dst")
        inside = cut(inside.where("c = c2").select("src", "dst", "c"))
        reached = cut(colour.where("name = colour"))
        while True:  # backwards from each colour's root
            back = inside.join(reached.select(F.col("name").alias("dst"), F.col("colour").alias("c")), ["dst", "c"]).select(F.col("src").alias("name"), F.col("c").alias("colour"))
            new = cut(back.distinct().join(reached, ["name", "colour"], "left_anti"))
            if not new.take(1):
                break
            reached = together(reached, new)
        size = reached.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1")
        group = cut(reached.join(size, "colour", "left_semi").select("name", F.col("colour").alias("component")))
        found = group if found is None else cut(found.unionByName(group))
        gone = reached.select("name")
        e = cut(e.join(gone.withColumnRenamed("name", "src"), "src", "left_anti").join(gone.withColumnRenamed("name", "dst"), "dst", "left_anti"))


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges whose nodes have both a way in and a way out."""
    n = e.count()
    while True:
        e = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        if (m := e.count()) == n:
            return e
        n = m


def _spread(e: DataFrame, colour: DataFrame) -> DataFrame:
    """Each node with the smallest colour of those that reach it."""
    colour = cut(e.select(F.col("dst").alias("name")).union(e.select("src")).distinct().join(colour, "name", "left").withColumn("colour", F.coalesce("colour", "name")))
    while True:
        sent = e.join(colour.withColumnRenamed("name", "src"), "src").groupBy(F.col("dst").alias("name")).agg(F.min("colour").alias("_c"))
        new = cut(colour.join(sent, "name", "left").select("name", F.least("colour", F.coalesce("_c", "colour")).alias("colour"), (F.col("_c") < F.col("colour")).alias("_m")))
        if not new.where("_m").take(1):
            return new.select("name", "colour")
        colour = new.select("name", "colour")


def _strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strong components by two depth-first passes, without recursion."""
    src, dst = [], []
    for b in batches:
        src += b.column(0).to_pylist()
        dst += b.column(1).to_pylist()
    names = sorted({*src, *dst})
    number = {x: i for i, x in enumerate(names)}
    a, b = np.array([number[x] for x in src], np.int64), np.array([number[x] for x in dst], np.int64)
    n = len(names)

    def lists(s: np.ndarray, t: np.ndarray):
        order = np.argsort(s, kind="stable")
        return t[order].tolist(), np.searchsorted(s[order], np.arange(n + 1)).tolist()

    to, first = lists(a, b)
    done, seen = [], [False] * n
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        stack = [(root, first[root])]
        while stack:
            v, k = stack.pop()
            while k < first[v + 1] and seen[to[k]]:
                k += 1
            if k < first[v + 1]:
                stack.append((v, k + 1))
                seen[to[k]] = True
                stack.append((to[k], first[to[k]]))
            else:
                done.append(v)
    to, first = lists(b, a)
    group = [-1] * n
    for root in reversed(done):
        if group[root] >= 0:
            continue
        group[root], stack = root, [root]
        while stack:
            v = stack.pop()
            for w in to[first[v] : first[v + 1]]:
                if group[w] < 0:
                    group[w] = root
                    stack.append(w)
    low: dict[int, int] = {}
    size: dict[int, int] = {}
    for i, g in enumerate(group):
        low.setdefault(g, i)  # names are sorted
        size[g] = size.get(g, 0) + 1
    some = [i for i in range(n) if size[group[i]] > 1]
    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in some], pa.string()), pa.array([names[low[group[i]]] for i in some], pa.string())], ["name", "component"])


def subgraph(edges: DataFrame, roots: DataFrame, most: int = 60) -> DataFrame:
    """Edges among the nodes that can be reached from the roots, level by level, before there are more than ``most``."""
    inside = levels(edges, roots, most).select("name")
    e = edges.select("src", "dst").distinct()
    return e.join(inside.withColumnRenamed("name", "src"), "src", "left_semi").join(inside.withColumnRenamed("name", "dst"), "dst", "left_semi")


def mermaid(edges: DataFrame) -> DataFrame:
    """Edges as lines of a diagram, in order of their names."""
    return edges.select("src", "dst", F.concat(F.lit("    "), "src", F.lit(" --> "), "dst").alias("line"))
