"""Connected components by star contraction, and chains of aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quirelake.session import spool


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the smallest of its neighbourhood."""
    e = _both(edges)
    least = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return e.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours link to the smallest of them."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node) of every node of edges (a, b); nulls and loops are left out.

    Large-star and small-star alternate until nothing moves, about log(n) rounds; the neighbourhoods are
    reduced by min, aggregated before the shuffle, so that a node of any degree is one row per task.
    """
    e = spool(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct(), "edges")
    before = None
    while True:
        e = spool(_small_star(_large_star(e)), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def followed_aliases(aliases: DataFrame, old: str, new: str) -> DataFrame:
    """old and current of each alias, chains followed to their end by doubling; in_cycle where a chain has no end.

    Of several targets of one id the smallest holds. Null ids and ids that are their own alias are left out.
    """
    a = aliases.select(F.col(old).alias("old"), F.col(new).alias("current")).where("old IS NOT NULL AND current IS NOT NULL AND old <> current")
    a = spool(a.groupBy("old").agg(F.min("current").alias("current")), "aliases")
    # a chain has no more links than there are aliases; what still moves after so many steps is a cycle
    steps, most = 1, a.count()
    while steps <= most:
        step = a.alias("x").join(a.alias("y"), F.col("x.current") == F.col("y.old"), "left")
        nxt = step.select(F.col("x.old").alias("old"), F.coalesce("y.current", "x.current").alias("current"), F.col("y.current").isNotNull().alias("moved"))
        nxt = spool(nxt, "aliases")
        if nxt.where("moved").isEmpty():
            break
        a, steps = nxt.select("old", "current"), steps * 2
    ends = a.alias("x").join(a.alias("y"), F.col("x.current") == F.col("y.old"), "left")
    return ends.select(F.col("x.old").alias("old"), F.col("x.current").alias("current"), F.col("y.old").isNotNull().alias("in_cycle"))
