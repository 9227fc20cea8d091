"""Consolidating pairwise matches into groups (problem 3).

Method: union-find runs within partitions of the edges and keeps only a spanning forest of each; forests
are merged level by level in partitions whose number is divided at each level, as long as a partition
stays below a bound. If the forest is larger than one bounded partition, the rest is contracted by
rounds of the same union-find, until no edge is left between two trees.

Edges are made distinct, aggregated before the shuffle, and partitioned by a hash of both ends, so that neither a hub nor
the one root of a large group fills a partition. What a task holds is bounded whatever it gets: union-find gives
its forest out and begins anew when it has MAX_NODES nodes, which costs edges in the next level but no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quirelake.session import spool

#: Edges that one task may hold, and by how much the number of partitions falls at each level.
MAX_EDGES = 2_000_000
FAN_IN = 8


def _forest(batches: Iterator[pa.RecordBatch], most_nodes: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the partition's edges: each node with the smallest node of its tree. None has many more than most_nodes nodes."""
    code: dict[str, int] = {}
    parent: list[int] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    names: list[str] = []

    def drain() -> Iterator[pa.RecordBatch]:
        roots = [names[find(i)] for i in range(len(names))]
        keep = [i for i, r in enumerate(roots) if r != names[i]]
        for at in range(0, len(keep), 100_000):
            part = keep[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in part], pa.string()), pa.array([roots[i] for i in part], pa.string())], names=["a", "b"])
        for held in (code, parent, names):
            held.clear()

    for batch in batches:
        if len(names) > most_nodes:
            yield from drain()
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            for n in (a, b):
                if n not in code:
                    code[n] = len(names)
                    names.append(n)
                    parent.append(code[n])
            x, y = find(code[a]), find(code[b])
            if x != y:
                if names[x] < names[y]:
                    parent[y] = x
                else:
                    parent[x] = y
    yield from drain()


def _local(edges: DataFrame, parts: int, max_edges: int) -> DataFrame:
    """Forests of parts partitions of the distinct edges, which a hash of both ends makes of equal size."""
    return edges.repartition(parts, "a", "b").mapInArrow(lambda batches: _forest(batches, 2 * max_edges), "a string, b string")


def components(edges: DataFrame, left: str, right: str, max_edges: int = MAX_EDGES) -> DataFrame:
    """entity_id and group_id of every id linked with at least one other id.

    Ids are compared in lower case without blanks around; group_id is the smallest id of the group.
    Rows with a null or blank id and ids matched with themselves make no link; repeated and reversed
    rows change nothing; an empty table gives no rows.
    """
    low = lambda c: F.lower(F.trim(F.regexp_replace(F.col(c), r"^\s+|\s+$", "")))
    e = edges.select(low(left).alias("a"), low(right).alias("b")).where("a <> '' AND b <> '' AND a <> b")
    e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    parts = max(FAN_IN, int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-e.count() // max_edges))
    forest = spool(_local(e, parts, max_edges), "forest")
    n = forest.count()
    while parts > 1:
        fewer = max(1, -(-parts // FAN_IN))
        if n > max_edges * fewer:
            return _contract(forest, n, max_edges)
        parts = fewer
        forest = spool(_local(forest.distinct(), parts, max_edges), "forest")
        n = forest.count()
    roots = forest.select(F.col("b").alias("entity_id"), F.col("b").alias("group_id")).distinct()
    return forest.select(F.col("a").alias("entity_id"), F.col("b").alias("group_id")).unionAll(roots)


def _contract(forest: DataFrame, n: int, max_edges: int) -> DataFrame:
    """Components of a forest that no single partition may hold.

    In each round union-find runs in bounded partitions; a node points to the smallest of the roots it got (min,
    aggregated before the shuffle), pointers, which always go to a smaller node, are followed to their ends by
    doubling, and the node's other roots become links between ends. As the larger end of each link moves, a
    later round has fewer nodes, until there is no link.
    """
    label, links = None, forest.distinct()
    while n > 0:
        moved = spool(_local(links, -(-n // max_edges), max_edges), "forest")
        to = moved.groupBy("a").agg(F.min("b").alias("b"))
        ends = _ends(to)
        pairs = moved.join(to.withColumnRenamed("b", "least"), "a").where("b <> least").select("least", "b").distinct()
        x = pairs.join(ends.select(F.col("a").alias("least"), F.col("b").alias("x")), "least", "left").select(F.coalesce("x", "least").alias("x"), "b")
        y = x.join(ends.select(F.col("a").alias("b"), F.col("b").alias("y")), "b", "left").select("x", F.coalesce("y", "b").alias("y")).where("x <> y")
        links = spool(y.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if label is None:
            label = ends
        else:
            now = label.join(ends.select(F.col("a").alias("b"), F.col("b").alias("end")), "b", "left").select("a", F.coalesce("end", "b").alias("b"))
            label = spool(now.unionAll(ends.join(label.select("a"), "a", "left_anti")), "labels")
        n = links.count()
    roots = label.select(F.col("b").alias("entity_id"), F.col("b").alias("group_id")).distinct()
    return label.select(F.col("a").alias("entity_id"), F.col("b").alias("group_id")).unionAll(roots)


def _ends(to: DataFrame) -> DataFrame:
    """Each node a with the end of its chain of pointers a to b."""
    to = spool(to, "pointers")
    while True:
        next_ = to.select(F.col("a").alias("b"), F.col("b").alias("c"))
        step = spool(to.join(next_, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("went")), "pointers")
        if step.where("went").isEmpty():
            return step.select("a", "b")
        to = step.select("a", "b")
