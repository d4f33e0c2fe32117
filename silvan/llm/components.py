"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spool import discard, spool


#: Parts that the edges of a node with very many are dealt out to where they meet its least neighbour.
SALTS = 16
#: A node with more edges than this, and than a thousandth of all, has very many: no more than two thousand can.
MANY = 1 << 14


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _with_least(edges: DataFrame, least: DataFrame, m, total: int) -> DataFrame:
    """``edges`` with ``m`` of their u; a node with very many edges is spread over ``SALTS`` tasks."""
    hot = F.broadcast(least.filter(F.col("n") > max(MANY, total // 1000)).select("u", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = least.join(hot, "u", "left").select("u", m.alias("m"), F.explode(salts).alias("salt"))
    return edges.join(hot, "u", "left").select("u", "v", salt.alias("salt")).join(copies, ["u", "salt"])


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of u is linked to u's smallest neighbour (or u itself)."""
    both = edges.union(edges.select("v", "u"))
    return _with_least(both, _least(both), F.least("u", "m"), 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    least = _least(edges)
    moved = _with_least(edges, least, F.col("m"), total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(moved).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node of its component.

    Rounds follow the logarithm of the longest chain. Each round groups with
    partial sums first, so that a node with very many edges is one row a task.
    An empty edge table gives an empty result; self-loops are ignored.
    """
    pairs = edges.filter(F.col(a) != F.col(b))
    now = spool(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = _signature(now)
    while mark[0]:
        new = spool(_small_star(_large_star(now, mark[0]), mark[0]), "stars")
        discard(now)
        now, before, mark = new, mark, _signature(new)
        if mark == before:
            break
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )
