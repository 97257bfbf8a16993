"""Connected components of an edge table, by alternating stars."""

from pyspark.sql import DataFrame, functions as F

from newstide.sources.layout import written


def _minimum(edges: DataFrame) -> DataFrame:
    """Smallest of a node and its neighbours. Written, so the join with it can be split."""
    return written(edges.groupBy("u").agg(F.min("v").alias("m"))
                   .select("u", F.least("u", "m").alias("m")), "star")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.where("v > u").join(_minimum(both), "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller node here."""
    least = _minimum(edges)
    return (edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Large star and small star take turns until nothing changes, a number of rounds that grows with
    the logarithm of the longest chain. Only node numbers move; each round is a written table.
    """
    edges = written(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
                    .where("u <> v").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        edges = written(_small_star(written(_large_star(edges), "edges")), "edges")
        before, state = state, _state(edges)
        if before == state:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
                       .distinct())
