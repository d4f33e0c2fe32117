"""Kernels between videos: all pairs once, mirrored; linear in factored form, sparse ones by joins on the word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from .trees import edges as tree_edges


def pairs(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """Pairs i <= j of (video_id, v) rows, or all pairs with a second table; the kernel's own size."""
    a = left.select(F.col("video_id").alias("i"), F.col("v").alias("a"))
    if right is None:
        return a.join(left.select(F.col("video_id").alias("j"), F.col("v").alias("b")), F.col("i") <= F.col("j"))
    return a.join(right.select(F.col("video_id").alias("j"), F.col("v").alias("b")))


def kernel(left: DataFrame, function, right: DataFrame | None = None) -> DataFrame:
    """(i, j, k) by a vector function over array columns."""
    return pairs(left, right).select("i", "j", function(F.col("a"), F.col("b")).alias("k"))


def mirror(half: DataFrame) -> DataFrame:
    return half.unionByName(half.filter("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "k"))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.select("video_id", "node_id").distinct().groupBy("video_id").agg(F.count("*").alias("e"))


#: Videos of one side of a block of pairs, about.
VIDEO_BLOCK = 64


def sparse_intersection(edges: DataFrame, block: int = VIDEO_BLOCK) -> DataFrame:
    """(i, j, k), i <= j: mean over edge pairs of sum min(x, y), on the shared words only.

    For a word, the sum over all edge pairs of min(x, y) needs only the values,
    so edges of one video with equal value are counted together first, and all
    sums come from sorted values and prefix sums.
    """

    def least(xs, x, m):
        below, count = np.append(0, np.cumsum(x * m)), np.append(0, np.cumsum(m))
        k = np.searchsorted(x, xs)
        return below[k] + xs * (count[-1] - count[k])

    return _over_blocks(edges, least, block).select("i", "j", (F.col("s") / (F.col("ei") * F.col("ej"))).alias("k"))


def sparse_chi_square(edges: DataFrame, block: int = VIDEO_BLOCK) -> DataFrame:
    """(i, j, k), i <= j: mean over edge pairs of sum (x - y)^2 / (x + y), for values that are not negative.

    A word that only one edge has adds its value, one that both have takes
    4 x y / (x + y) off the sum of both, so shared words are enough.
    """

    def shared(xs, x, m):
        both = xs[:, None] + x[None, :]
        return (4 * xs[:, None] * x[None, :] / np.where(both > 0, both, 1)) @ m

    sums = edges.groupBy("video_id").agg(F.sum("x").alias("t"))
    a, b = (sums.select(F.col("video_id").alias(n), F.col("t").alias(f"t{n}")) for n in ("i", "j"))
    met = _over_blocks(edges, shared, block).join(a, "i").join(b, "j")
    return met.select("i", "j", ((F.col("ti") * F.col("ej") + F.col("tj") * F.col("ei") - F.col("s")) / (F.col("ei") * F.col("ej"))).alias("k"))


def edge_kernel(nodes: DataFrame, kind: str = "intersection", norm: str = "l1", power: bool = False) -> DataFrame:
    """(i, j, k), i <= j, over all edge pairs of histogram trees: kind linear, intersection or chi2; see ``trees.edges`` for the rest."""
    kinds = {"linear": factored_linear, "intersection": sparse_intersection, "chi2": sparse_chi_square}
    if kind not in kinds:
        raise ValueError(f"unknown kind {kind!r}; known: {sorted(kinds)}")
    return kinds[kind](tree_edges(nodes, norm, power))


def _over_blocks(edges: DataFrame, function, block: int) -> DataFrame:
    """(i, j, s, ei, ej), i <= j: sums over words and edge pairs of a function of two values, and the numbers of edges.

    ``function(xs, x, m)`` sums, for each of ``xs``, over the sorted values x
    that occur m times. Videos are dealt to blocks by hash; a task takes a pair
    of blocks, so tasks grow with the pairs of videos, not with the words.
    """
    edges = stored(edges)  # read three times below
    values = edges.groupBy("video_id", "word_id", "x").agg(F.count("*").alias("m"))
    nodes = edges.groupBy("video_id", "node_id").agg(F.lit(1).alias("one")).groupBy("video_id").agg(F.count("*").alias("e"))
    videos = edges.agg(F.approx_count_distinct("video_id").alias("n")).head()["n"]
    blocks = max(4, -(-videos // block))
    rows = values.join(nodes, "video_id").withColumn("own", F.pmod(F.xxhash64("video_id"), F.lit(blocks)).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = met.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low, high = key[0].as_py(), key[1].as_py()
        video, word, x, m, e, own = (table[c].to_numpy() for c in ("video_id", "word_id", "x", "m", "e", "own"))
        left, right = np.unique(video[own == low]), np.unique(video[own == high])
        sizes = dict(zip(video.tolist(), e.tolist(), strict=True))
        total = np.zeros((len(left), len(right)))
        order = np.lexsort((x, video, word))
        video, word, x, m, own = video[order], word[order], x[order], m[order], own[order]
        cuts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1], [True]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = own[a:b] == low
            at, xs, ms = np.searchsorted(left, video[a:b][part]), x[a:b][part], m[a:b][part]
            other = np.flatnonzero(own[a:b] == high) + a
            if not len(at) or not len(other):
                continue
            ends = np.flatnonzero(np.concatenate([[True], video[other][1:] != video[other][:-1], [True]]))
            for s, t in zip(ends[:-1], ends[1:], strict=True):
                mine = other[s:t]
                total[:, np.searchsorted(right, video[mine[0]])] += np.bincount(at, function(xs, x[mine], m[mine]) * ms, len(left))
        i, j = np.meshgrid(left, right, indexing="ij")
        stay = i <= j if low == high else np.ones(i.shape, bool)
        ei, ej = np.array([sizes[v] for v in left.tolist()], np.int64), np.array([sizes[v] for v in right.tolist()], np.int64)
        ei, ej = np.broadcast_to(ei[:, None], i.shape)[stay], np.broadcast_to(ej[None, :], i.shape)[stay]
        i, j, found = i[stay], j[stay], total[stay]
        turned = i > j
        low_e, high_e = np.where(turned, ej, ei), np.where(turned, ei, ej)
        return pa.table({"i": np.minimum(i, j), "j": np.maximum(i, j), "s": found, "ei": low_e, "ej": high_e})

    kind = edges.schema["video_id"].dataType.simpleString()
    return dealt.select("low", "high", "video_id", "word_id", "x", "m", "e", "own").groupBy("low", "high").applyInArrow(run, f"i {kind}, j {kind}, s double, ei long, ej long")


def factored_linear(edges: DataFrame) -> DataFrame:
    """(i, j, k), i <= j: the mean over edge pairs of dot products is the dot product of the mean edges."""
    edges = stored(edges)  # read twice below
    n = edge_counts(edges)
    mean = edges.groupBy("video_id", "word_id").agg(F.sum("x").alias("s")).join(n, "video_id").select("video_id", "word_id", (F.col("s") / F.col("e")).alias("x"))
    a = mean.select(F.col("video_id").alias("i"), "word_id", F.col("x").alias("xa"))
    b = mean.select(F.col("video_id").alias("j"), "word_id", F.col("x").alias("xb"))
    met = a.join(b, "word_id").filter("i <= j").groupBy("i", "j").agg(F.sum(F.col("xa") * F.col("xb")).alias("s"))
    every = n.select(F.col("video_id").alias("i")).join(n.select(F.col("video_id").alias("j")), F.col("i") <= F.col("j"))
    return every.join(met, ["i", "j"], "left").select("i", "j", F.coalesce("s", F.lit(0.0)).alias("k"))


def median_normalised(k: DataFrame) -> DataFrame:
    """k / median of its nonzero entries; unchanged where all are zero."""
    scale = k.agg(F.percentile(F.when(F.col("k") != 0, F.col("k")), F.lit(0.5)).alias("m"))
    return k.crossJoin(F.broadcast(scale)).withColumn("k", F.when(F.col("m").isNull(), F.col("k")).otherwise(F.col("k") / F.col("m"))).drop("m")


def nonzero(k: DataFrame, by: str) -> DataFrame:
    """Kernels with an entry other than zero."""
    return k.join(k.groupBy(by).agg(F.max(F.abs(F.col("k"))).alias("most")).filter("most > 0").select(by), by)


def root_or_nodes(root: DataFrame, nodes: DataFrame) -> DataFrame:
    """The root kernel, or the node kernel where the root sums to nothing."""
    total = root.agg(F.sum("k").alias("total"))
    both = root.join(nodes.select("i", "j", F.col("k").alias("kn")), ["i", "j"]).crossJoin(F.broadcast(total))
    return both.select("i", "j", F.when(F.col("total") > 0, F.col("k")).otherwise(F.col("kn")).alias("k"))


def fuse(terms: list[tuple[Column | float, DataFrame]]) -> DataFrame:
    """Weighted sum of kernels over the same pairs, one shuffle for all."""
    out = None
    for w, k in terms:
        part = k.select("i", "j", (F.col("k") * w).alias("k"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("i", "j").agg(F.sum("k").alias("k"))
