"""The stages from raw rows to kernels: where their tables lie, and what each one writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kernels as K
from ..operators import learn as L
from ..operators import trees as T
from ..sources import tables as S

STAGES = ("tracklets", "clusters", "representations", "kernels", "results")


def layout(base: str) -> dict[str, str]:
    """The folder of each stage's tables."""
    return {stage: f"{base.rstrip('/')}/{stage}" for stage in STAGES}


def extract(spark: SparkSession, source: str, base: str, track_length: int = S.TRACK_LENGTH) -> DataFrame:
    """Parses the raw files that are not in the table of tracklets yet, adds them, and returns the table.

    Files without a row add nothing. All channels are columns of one table, so
    that readers prune those they do not need.
    """
    path = layout(base)["tracklets"]
    rows = S.read_tracklets(spark, source, track_length)
    done = _there(spark, path)
    todo = rows if done is None else S.remaining(rows, done, "file")
    todo.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.parquet(path) if found else None


def represent(rows: DataFrame, model: DataFrame, kind: str, treelike: bool = True, frame: str = "t") -> DataFrame:
    """(video_id, node_id, v) of (video_id, leaf, v, frame): bags of words (bovw), Fisher vectors (fv) or rank-pooled frames (vd).

    ``model`` is the codebook (word_id, c) or the mixture (k, w, mu, var).
    Without ``treelike`` there is node 1 only.
    """
    if kind == "bovw":
        words = model.count()  # a model of fixed size
        counts = T.bovw_tree(T.nearest_words(rows, model))
        lists = counts.groupBy("video_id", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("word_id", F.col("n").cast("double")))).alias("m"))
        dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(words - 1).cast("long")), lambda w: F.coalesce(F.element_at("m", w), F.lit(0.0)))
        out = lists.select("video_id", "node_id", dense.alias("v"))
    elif kind == "fv":
        parts = L.fisher(rows, model).groupBy("video_id", "node_id").agg(F.sort_array(F.collect_list(F.struct("k", "dim", "mu_part", "var_part"))).alias("p"))
        out = parts.select("video_id", "node_id", F.concat("p.mu_part", "p.var_part").alias("v"))
    elif kind == "vd":
        return L.fisher_darwin(rows, model, frame, treelike).withColumnRenamed("w", "v")
    else:
        raise ValueError(f"unknown kind {kind!r}; known: bovw, fv, vd")
    return out if treelike else out.filter("node_id = 1")


def kernels(nodes: DataFrame, kind: str = "intersection", norm: str = "l1", power: bool = False, fold: int = 0, feat: str = "all") -> DataFrame:
    """(fold_id, feat, i, j, k) of histogram trees (video_id, node_id, word_id, n), mirrored: one method's node kernel."""
    full = K.mirror(K.edge_kernel(nodes, kind, norm, power))
    return full.select(F.lit(fold).alias("fold_id"), F.lit(feat).alias("feat"), "i", "j", "k")
