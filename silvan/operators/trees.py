"""Heap-coded binary trees over descriptors, and what is rolled up along them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def ancestor_pairs(rows: DataFrame, leaf: str = "leaf") -> DataFrame:
    """A row for each ancestor of the leaf, itself included (``node_id``)."""
    return rows.withColumn("node_id", F.explode(V.ancestors(F.col(leaf))))


def expand(leaves: DataFrame) -> DataFrame:
    """(video_id, node_id, descendant): proper descendants in the tree of the leaves; a leaf has itself.

    Leaf 0 holds outliers and stands by itself.
    """
    nodes = ancestor_pairs(leaves.select("video_id", "leaf").distinct()).select("video_id", "node_id").distinct()
    below = nodes.withColumnRenamed("node_id", "descendant").withColumn("node_id", F.explode(V.ancestors(F.col("descendant"))))
    leaf = leaves.select("video_id", F.col("leaf").alias("node_id")).distinct()
    return below.filter("node_id <> descendant").select("video_id", "node_id", "descendant").union(
        leaf.select("video_id", "node_id", F.col("node_id").alias("descendant"))
    )


def nearest_words(rows: DataFrame, codebook: DataFrame) -> DataFrame:
    """``word_id`` of the nearest word (squared distance; the lowest id among equals) for each row.

    The codebook is a model of fixed size and is broadcast as one row of arrays,
    so that a row meets all words inside one expression and nothing is multiplied.
    """
    words = codebook.agg(F.sort_array(F.collect_list(F.struct("word_id", "c"))).alias("words"))
    scored = F.transform("words", lambda w: F.struct(V.squared_distance(F.col("v"), w["c"]).alias("d"), w["word_id"].alias("word_id")))
    return rows.crossJoin(F.broadcast(words)).withColumn("word_id", F.array_min(scored)["word_id"]).drop("words")


def bovw(rows: DataFrame) -> DataFrame:
    """(video_id, word_id, n): the words of a whole bag."""
    return rows.groupBy("video_id", "word_id").agg(F.count("*").alias("n"))


def bovw_tree(rows: DataFrame) -> DataFrame:
    """(video_id, node_id, word_id, n): words counted at the leaves once, then summed up to every ancestor."""
    leaf = rows.groupBy("video_id", "leaf", "word_id").agg(F.count("*").alias("n"))
    return ancestor_pairs(leaf).groupBy("video_id", "node_id", "word_id").agg(F.sum("n").alias("n"))


def dense_histogram(counts: DataFrame, words: int) -> DataFrame:
    """Counts with a zero for every word that does not occur."""
    spark = counts.sparkSession
    grid = counts.select("video_id").distinct().crossJoin(F.broadcast(spark.range(words).withColumnRenamed("id", "word_id")))
    return grid.join(counts, ["video_id", "word_id"], "left").na.fill(0, ["n"])


def edges(nodes: DataFrame, norm: str = "l1", power: bool = False) -> DataFrame:
    """(video_id, node_id, word_id, x): child and parent histograms side by side, normalised together.

    ``nodes`` has (video_id, node_id, word_id, n). Parent words come as -1 - word,
    so that the edge vector stays sparse. ``power`` takes signed square roots
    first, ``norm`` is l1 or l2. Root and outliers (ids to 1) have no edge.
    """
    value = V.signed_sqrt(F.col("n").cast("double")) if power else F.col("n").cast("double")
    valued = nodes.select("video_id", "node_id", "word_id", value.alias("n"))
    child = valued.filter("node_id > 1")
    ids = child.select("video_id", "node_id").distinct().withColumn("parent", V.parent(F.col("node_id")))
    above = valued.select(F.col("video_id").alias("v"), F.col("node_id").alias("p"), (-1 - F.col("word_id")).alias("word_id"), "n")
    up = ids.join(above, (F.col("video_id") == F.col("v")) & (F.col("parent") == F.col("p"))).select("video_id", "node_id", "word_id", "n")
    both = child.union(up)
    size = F.sum(F.abs("n")) if norm == "l1" else F.sqrt(F.sum(F.col("n") * F.col("n")))
    sizes = both.groupBy("video_id", "node_id").agg(size.alias("size"))
    return both.join(sizes, ["video_id", "node_id"]).select("video_id", "node_id", "word_id", (F.col("n") / F.col("size")).alias("x"))


def root_vectors(rows: DataFrame) -> DataFrame:
    """(video_id, v): the mean descriptor of each whole bag, from sums that are merged before the shuffle."""
    means = rows.select("video_id", F.posexplode("v").alias("dim", "x")).groupBy("video_id", "dim").agg(F.avg("x").alias("x"))
    return means.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("dim", "x")))["x"].alias("v"))


def mean_vectors(rows: DataFrame) -> DataFrame:
    """(video_id, node_id, dim, x): the mean descriptor of each tree node, from sums at the leaves."""
    parts = rows.select("video_id", "leaf", F.posexplode("v").alias("dim", "x"))
    leaf = parts.groupBy("video_id", "leaf", "dim").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return ancestor_pairs(leaf).groupBy("video_id", "node_id", "dim").agg((F.sum("s") / F.sum("n")).alias("x"))
