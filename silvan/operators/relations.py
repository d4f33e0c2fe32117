"""Relational operators: folds, labels, samples, band and neighbour joins, ordered means."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import dropped, stored
from .nearest import PART, nearest_lists


def digest(seed: str, *parts: Column | str) -> Column:
    """A reproducible sort key in place of a random draw."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def one_vs_rest(items: DataFrame, classes: DataFrame) -> DataFrame:
    """(video_id, class_id, y): +1 for the item's class, -1 for each other; a small broadcast side."""
    return items.crossJoin(F.broadcast(classes)).select("video_id", "class_id", F.when(F.col("label") == F.col("class_id"), 1).otherwise(-1).alias("y"))


def without_negatives(labels: DataFrame) -> DataFrame:
    """Items that are positive for some class; training keeps the others, scoring does not."""
    return labels.groupBy("video_id").agg(F.max("y").alias("most")).filter("most > 0").select("video_id")


def strat_id(labels: DataFrame) -> DataFrame:
    """Sum of y * 10^class over the classes."""
    return labels.groupBy("video_id").agg(F.sum(F.col("y") * F.pow(F.lit(10.0), F.col("class_id"))).alias("strat"))


def stratified_folds(rows: DataFrame, strat: str, key: str, n: int, seed: str) -> DataFrame:
    """``fold`` in 0..n-1: each stratum is dealt out evenly in the order of a digest."""
    order = Window.partitionBy(strat).orderBy(digest(seed, key), key)
    return rows.withColumn("fold", (F.row_number().over(order) - 1) % n)


def capped_sample(rows: DataFrame, group: str, key: str, cap: int, seed: str) -> DataFrame:
    """At most ``cap`` rows of each group, without replacement."""
    order = Window.partitionBy(group).orderBy(digest(seed, key), key)
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap).drop("_n")


def grid_sample(rows: DataFrame, group: str, key: str, rate: float, cells: int, seed: str, max_tries: int = 3) -> DataFrame:
    """``in_sample`` by grid cell of (x, y) in [0, 1): ceil(m * rate / cells^2) of each cell.

    The rate grows tenfold until a group has more than two sampled rows, at most
    ``max_tries`` times. Points outside the unit square are dropped.
    """
    inside = rows.filter("x >= 0 and x < 1 and y >= 0 and y < 1").withColumn("cell", F.floor(F.col("y") * cells) * cells + F.floor(F.col("x") * cells))
    per_cell = Window.partitionBy(group, "cell")
    counted = inside.withColumns({"_n": F.count("*").over(per_cell), "_k": F.row_number().over(per_cell.orderBy(digest(seed, key), key))})
    rates = [min(1.0, rate * 10**k) for k in range(max_tries)]
    quota = lambda r: F.ceil(F.col("_n") * r / (cells * cells))
    sizes = [F.sum((F.col("_k") <= quota(r)).cast("int")).over(Window.partitionBy(group)) for r in rates]
    chosen = F.col("_k") <= quota(rates[-1])
    for r, size in list(zip(rates, sizes, strict=True))[-2::-1]:
        chosen = F.when(size > 2, F.col("_k") <= quota(r)).otherwise(chosen)
    return counted.withColumn("in_sample", chosen).drop("_n", "_k")


#: Frames of one block of the band search.
BAND_BLOCK = 16


def band_neighbours(rows: DataFrame, group: str, key: str, radius: int = 5, k: int = 30, part: int = PART) -> DataFrame:
    """(group, key, near): the k nearest rows in (x, y) among those of the group at most ``radius`` frames apart.

    ``near`` has (d, other) structs, squared distances with ties by key. Blocks
    are runs of ``BAND_BLOCK`` frames with the frames around them, so that a row
    goes to two blocks at most where the radius is no larger than a block.
    """
    p = F.array(F.col("frame").cast("double"), F.col("x").cast("double"), F.col("y").cast("double")).alias("p")
    block = lambda c: F.floor(c / F.lit(BAND_BLOCK)).alias("_block")
    queries = rows.select(group, key, block(F.col("frame")), p)
    around = F.explode(F.sequence(F.floor((F.col("frame") - radius) / F.lit(BAND_BLOCK)), F.floor((F.col("frame") + radius) / F.lit(BAND_BLOCK)))).alias("_block")
    candidates = rows.select(group, key, around, p)

    def distances(a, b):
        d = (a[:, None, 1] - b[None, :, 1]) ** 2 + (a[:, None, 2] - b[None, :, 2]) ** 2
        d[np.abs(a[:, None, 0] - b[None, :, 0]) > radius] = np.inf
        return d

    return nearest_lists(queries, candidates, [group, "_block"], key, k, distances, part).drop("_block")


def density_inliers(rows: DataFrame, group: str, key: str, radius: int = 5, k: int = 30) -> DataFrame:
    """Rows whose mean neighbour distance is at most the mean plus one population deviation of all.

    Rows alone in their band have no distance and are dropped.
    """
    near = F.transform("near", lambda x: F.sqrt(x["d"]))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    sums = band_neighbours(rows, group, key, radius, k).select(
        group, key, total(near).alias("s"), total(F.transform("near", lambda x: x["d"])).alias("q"), F.size("near").alias("n")
    )
    whole = sums.groupBy(group).agg((F.sum("s") / F.sum("n")).alias("mu"), (F.sum("q") / F.sum("n")).alias("q2"))
    limit = F.col("mu") + F.sqrt(F.col("q2") - F.col("mu") * F.col("mu"))
    # one row a group: adaptive execution sends it to all tasks if it is small
    return sums.join(whole, group).withColumn("sparsity", F.col("s") / F.col("n")).filter(F.col("sparsity") <= limit).select(group, key, "sparsity")


def knn_edges(rows: DataFrame, group: str, key: str, vector: str, k: int, part: int = PART) -> DataFrame:
    """Exact k nearest rows within a group by squared distance of ``vector``, made symmetric: distinct (group, src, dst).

    Distances are compared to twelve digits, ties go to the lower key.
    """
    points = rows.select(group, key, F.col(vector).cast("array<double>").alias("p"))

    def distances(a, b):
        d = np.zeros((len(a), len(b)))
        for x, y in zip(a.T, b.T, strict=True):
            d += (x[:, None] - y[None, :]) ** 2
        return np.round(d, 12)

    near = nearest_lists(points, points, [group], key, k, distances, part)
    return symmetric(near.select(group, F.col(key).alias("src"), F.explode("near.other").alias("dst")), group)


def symmetric(edges: DataFrame, *group: str) -> DataFrame:
    return edges.union(edges.select(*group, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def running_mean(rows: DataFrame, group: list[str], order: list[str], value: str, reverse: bool = False) -> Column:
    keys = [F.col(c).desc() if reverse else F.col(c) for c in order]
    w = Window.partitionBy(*group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(value).over(w) / F.count(value).over(w)


def temporal_halves(rows: DataFrame, group: str, frame: str, key: str) -> DataFrame:
    """``path`` 2 for the first n rows in file order, n the rows at or before the median frame; else 3."""
    median = F.percentile(frame, F.lit(0.5)).over(Window.partitionBy(group))
    first = F.sum((F.col(frame) <= F.col("_median")).cast("int")).over(Window.partitionBy(group))
    place = F.row_number().over(Window.partitionBy(group).orderBy(key))
    return rows.withColumn("_median", median).withColumn("path", F.when(place <= first, 2).otherwise(3)).drop("_median")


def equal_halves(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``half`` 0 for the first floor(n / 2) rows of a group, else 1."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    size = F.count("*").over(Window.partitionBy(group))
    return rows.withColumn("half", F.when(place <= F.floor(size / 2), 0).otherwise(1))


def threshold_picks(rows: DataFrame, group: str, value: str, key: str, n: int = 10, low: float = 0.1, high: float = 0.9, min_gap: float = 0.01) -> DataFrame:
    """Candidate thresholds of a group: evenly spaced order statistics, less those too near the last kept."""
    picks = [low + (high - low) * k / (n - 1) for k in range(n)]
    place = F.row_number().over(Window.partitionBy(group).orderBy(value, key)) - 1
    size = F.count("*").over(Window.partitionBy(group))
    at = F.array(*[F.floor(F.lit(p) * (F.col("_n") - 1)) for p in picks])
    chosen = rows.withColumns({"_k": place, "_n": size}).filter(F.array_contains(at, F.col("_k")))
    lists = chosen.groupBy(group).agg(F.sort_array(F.collect_list(value)).alias("values"))
    keep = lambda out, x: F.when((F.size(out) == 0) | (x - F.element_at(out, -1) > min_gap), F.concat(out, F.array(x))).otherwise(out)
    return lists.select(group, F.explode(F.aggregate("values", F.expr("cast(array() as array<double>)"), keep)).alias("threshold"))


def simplex_grid(spark, parts: int, steps: int = 10) -> DataFrame:
    """All weight vectors of ``parts`` shares in steps of 1/steps that sum to one, on whole numbers."""
    grid = spark.range(1).select(F.lit(0).alias("_used"))
    for k in range(parts - 1):
        grid = grid.withColumn(f"w{k + 1}", F.explode(F.sequence(F.lit(0), F.lit(steps) - F.col("_used")))).withColumn("_used", F.col("_used") + F.col(f"w{k + 1}"))
    grid = grid.withColumn(f"w{parts}", F.lit(steps) - F.col("_used")).drop("_used")
    return grid.select(*[(F.col(c) / steps).alias(c) for c in grid.columns])


def argmax(scores: DataFrame, by: str, score: str, *order: str) -> DataFrame:
    """The best row of each group; among equals the first in grid order."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), *order)
    return scores.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def merge_tagged(**frames: DataFrame) -> DataFrame:
    """One table of several methods' rows, each with its method's name."""
    out = None
    for method, df in frames.items():
        df = df.withColumn("method", F.lit(method))
        out = df if out is None else out.unionByName(df)
    return out


def merge_lists(frames: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """(*keys, value): the sorted list of the values that all tables have under a key; colliding ones are kept side by side."""
    out = None
    for df in frames:
        df = df.select(*keys, value)
        out = df if out is None else out.unionByName(df)
    return out.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(value))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached, by repeated least-neighbour steps and jumps."""
    both = stored(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = stored(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component")))
    while True:
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("component").alias("near"))
        met = labels.join(near, labels.node == near.src).select("node", F.least("component", "near").alias("component"))
        far = met.select(F.col("node").alias("j"), F.col("component").alias("jump"))
        new = stored(met.join(far, met.component == far.j).select("node", F.least("component", "jump").alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "old"), "node").filter("component <> old").limit(1).count()
        dropped(labels)
        labels = new
        if not changed:
            dropped(both)
            return labels
