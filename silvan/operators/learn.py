"""Codebooks, mixtures, Fisher vectors, rank pooling, trees and kernel classifiers over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from . import solvers as S
from .kernels import kernel, mirror
from .relations import argmax
from .trees import ancestor_pairs


def kmeans_codebook(rows: DataFrame, words: int, iterations: int = 100, seed: int = 0) -> DataFrame:
    """(word_id, c) by distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=words, maxIter=iterations, seed=seed).fit(rows.select(array_to_vector("v").alias("features")))
    return rows.sparkSession.createDataFrame([(k, c.tolist()) for k, c in enumerate(model.clusterCenters())], "word_id long, c array<double>")


def pca_half(rows: DataFrame, keep: str = "vec_id") -> DataFrame:
    """(key, v): centred rows on the first half of the principal axes; each axis points to its largest entry."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.select(keep, array_to_vector("v").alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="x").fit(data).transform(data)
    size = len(data.head()["raw"])
    model = PCA(k=max(1, size // 2), inputCol="x", outputCol="p").fit(centred)
    axes = model.pc.toArray()
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    flip = F.array(*[F.lit(float(s)) for s in signs])
    return model.transform(centred).select(keep, F.zip_with(vector_to_array("p"), flip, lambda x, s: x * s).alias("v"))


def diagonal_gmm(rows: DataFrame, start: DataFrame, iterations: int = 500, floor: float = 1e-6, tol: float = 1e-5) -> DataFrame:
    """(k, w, mu, var): diagonal mixture by EM from the given centres; a task sends one row of sums a round.

    Ends where the mean log-likelihood gains less than ``tol``, after
    ``iterations`` rounds at most.
    """
    mu = np.array([r.c for r in start.orderBy("word_id").collect()])  # a model of fixed size
    var, weights = np.full_like(mu, 0.05), np.full(len(mu), 1 / len(mu))
    data = rows.select("v").persist()
    before = -np.inf
    for _ in range(iterations):
        now = (weights, mu, var)

        def sums(batches, now=now):
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = S.diagonal_em(_matrix(batch.column(0)), *now)
                    total = part if total is None else tuple(x + y for x, y in zip(total, part, strict=True))
            if total is not None:
                flat = np.concatenate([np.ravel(x) for x in total])
                yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()])], names=["s"])

        flat = np.sum([r.s for r in data.mapInArrow(sums, "s array<double>").collect()], axis=0)
        k, d = mu.shape
        q, qx, qxx = flat[:k], flat[k : k + k * d].reshape(k, d), flat[k + k * d : k + 2 * k * d].reshape(k, d)
        weights, mu = q / q.sum(), qx / q[:, None]
        var = np.maximum(qxx / q[:, None] - mu * mu, floor)
        after = flat[-1] / q.sum()
        if after - before < tol:
            break
        before = after
    data.unpersist()
    return rows.sparkSession.createDataFrame([(k, float(weights[k]), mu[k].tolist(), var[k].tolist()) for k in range(len(mu))], "k int, w double, mu array<double>, var array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    """The lists of equal length of an Arrow column, without Python objects."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def posteriors(rows: DataFrame, gmm: DataFrame) -> DataFrame:
    """``q``: shares of the components for each row. The mixture is a model of fixed size and is broadcast."""
    model = gmm.agg(F.sort_array(F.collect_list(F.struct("k", "w", "mu", "var"))).alias("g"))
    distance = lambda g: V.total(F.zip_with(F.zip_with(F.col("v"), g["mu"], lambda x, m: (x - m) * (x - m)), g["var"], lambda d, s: d / s + F.log(s)))
    logs = F.transform("g", lambda g: F.log(g["w"]) - 0.5 * distance(g))
    out = rows.crossJoin(F.broadcast(model)).withColumn("_log", logs).withColumn("_p", F.transform("_log", lambda x: F.exp(x - F.array_max("_log"))))
    return out.withColumn("q", F.transform("_p", lambda x: x / V.total(F.col("_p")))).drop("_log", "_p", "g")


#: Leaves whose sums a task holds before it passes them on.
HELD_LEAVES = 1024


def fisher(rows: DataFrame, gmm: DataFrame, *extra: str) -> DataFrame:
    """(video_id, node_id, *extra, k, dim, mu_part, var_part): gradients at every tree node.

    A task sums its rows by leaf first, so that a leaf sends one set of sums,
    not one for each descriptor. ``extra`` are long columns that split the rows
    further (a frame). The mixture is a model of fixed size.
    """
    model = sorted(gmm.collect(), key=lambda r: r.k)
    names = [r.k for r in model]
    weights, mu, var = (np.array([r[c] for r in model], float) for c in ("w", "mu", "var"))
    components, size = mu.shape
    keys = ["video_id", "leaf", *extra]

    def run(batches):
        held: dict = {}

        def passed():
            lists = [pa.array([sums[c].ravel().tolist() for sums in held.values()], pa.list_(pa.float64())) for c in range(3)]
            columns = [pa.array([key[c] for key in held], pa.int64()) for c in range(len(keys))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([sums[3] for sums in held.values()], pa.int64()), *lists], names=[*keys, "n", "s0", "s1", "s2"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(len(keys)))
            q = S.shares(x, weights, mu, var)
            place, group = np.unique(np.stack([batch.column(c).to_numpy() for c in range(len(keys))]), axis=1, return_inverse=True)
            for g, key in enumerate(map(tuple, place.T.tolist())):
                own = group.ravel() == g
                part = [q[own].sum(axis=0), q[own].T @ x[own], q[own].T @ (x[own] ** 2), int(own.sum())]
                held[key] = [a + b for a, b in zip(held[key], part, strict=True)] if key in held else part
            if len(held) > HELD_LEAVES:
                yield passed()
                held.clear()
        yield passed()

    schema = ", ".join(f"{c} long" for c in keys) + ", n long, s0 array<double>, s1 array<double>, s2 array<double>"
    sums = rows.select(*[F.col(c).cast("long") for c in keys], F.col("v").cast("array<double>")).mapInArrow(run, schema)
    long = sums.select(*keys, "n", "s0", F.posexplode(F.arrays_zip("s1", "s2")).alias("at", "s"))
    component = F.floor(F.col("at") / size).cast("int")
    parts = long.select(*keys, "n", F.get("s0", component).alias("s0"), F.col("s.s1").alias("s1"), F.col("s.s2").alias("s2"), "at")
    total = [F.sum(c).alias(c) for c in ("s0", "s1", "s2", "n")]
    leaf = parts.groupBy(*keys, "at").agg(*total)
    node = ancestor_pairs(leaf).groupBy("video_id", "node_id", *extra, "at").agg(*total)
    spark = rows.sparkSession
    table = spark.createDataFrame([(n, int(names[n // size]), n % size, float(weights[n // size]), float(mu[n // size, n % size]), float(var[n // size, n % size])) for n in range(components * size)], "at int, k int, dim int, w double, m double, s double")
    got = node.join(F.broadcast(table), "at")
    mu_part = (F.col("s1") - F.col("m") * F.col("s0")) / (F.col("n") * F.sqrt("w") * F.sqrt("s"))
    var_part = (F.col("s2") - 2 * F.col("m") * F.col("s1") + (F.col("m") * F.col("m") - F.col("s")) * F.col("s0")) / (F.col("n") * F.sqrt(2 * F.col("w")) * F.col("s"))
    return got.select("video_id", "node_id", *extra, "k", "dim", mu_part.alias("mu_part"), var_part.alias("var_part"))


def fisher_darwin(rows: DataFrame, gmm: DataFrame, frame: str, treelike: bool = True) -> DataFrame:
    """(video_id, node_id, w): the frames' Fisher vectors of each tree node, in order, rank-pooled; else of node 1 only."""
    parts = fisher(rows, gmm, frame)
    if not treelike:
        parts = parts.filter("node_id = 1")
    order = F.sort_array(F.collect_list(F.struct("k", "dim", "mu_part", "var_part")))
    vectors = parts.groupBy("video_id", "node_id", frame).agg(order.alias("p")).select("video_id", "node_id", frame, F.concat("p.mu_part", "p.var_part").alias("v"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(frame)
        return pd.DataFrame({"video_id": [g.video_id.iloc[0]], "node_id": [g.node_id.iloc[0]], "w": [S.darwin(np.stack(g["v"])).tolist()]})

    return vectors.groupBy("video_id", "node_id").applyInPandas(run, "video_id long, node_id long, w array<double>")


def video_darwin(rows: DataFrame, group: str, order: str) -> DataFrame:
    """(group, w): rank pooling of each ordered sequence of vectors ``v``."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        return pd.DataFrame({group: [g[group].iloc[0]], "w": [S.darwin(np.stack(g["v"])).tolist()]})

    kind = rows.schema[group].dataType.simpleString()
    return rows.select(group, order, "v").groupBy(group).applyInPandas(run, f"{group} {kind}, w array<double>")


def branch_evolutions(nodes: DataFrame) -> DataFrame:
    """(video_id, node_id, fw, rv) for (video_id, node_id, v): each node's path to the root, rank-pooled."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(g.node_id, g["v"], strict=True))
        out = []
        for node in sorted(x for x in known if x > 1):
            path, at = [], node
            while at >= 1:
                path.append(known[at])
                at >>= 1
            w = S.darwin(np.stack(path))
            halves = [h / (np.sqrt(h @ h) or 1) for h in (w[: len(w) // 2], w[len(w) // 2 :])]
            out.append((int(g.video_id.iloc[0]), node, halves[0].tolist(), halves[1].tolist()))
        return pd.DataFrame(out, columns=["video_id", "node_id", "fw", "rv"])

    return nodes.groupBy("video_id").applyInPandas(run, "video_id long, node_id long, fw array<double>, rv array<double>")


def atnbep_kernel(branches: DataFrame) -> DataFrame:
    """(channel, i, j, k), i <= j: linear kernels of mean branch evolutions, which equal the mean over branch pairs."""
    parts = branches.select("video_id", "node_id", F.explode(F.array(F.struct(F.lit(0).alias("channel"), F.col("fw").alias("v")), F.struct(F.lit(1).alias("channel"), F.col("rv").alias("v")))).alias("c"))
    long = parts.select("video_id", "c.channel", F.posexplode("c.v").alias("dim", "x")).groupBy("video_id", "channel", "dim").agg(F.avg("x").alias("x"))
    vectors = long.groupBy("video_id", "channel").agg(F.sort_array(F.collect_list(F.struct("dim", "x")))["x"].alias("v"))
    a, b = (vectors.select("channel", F.col("video_id").alias(n), F.col("v").alias(f"v{n}")) for n in ("i", "j"))
    return a.join(b, "channel").filter("i <= j").select("channel", "i", "j", V.dot(F.col("vi"), F.col("vj")).alias("k"))


def spectral_trees(rows: DataFrame, group: str, key: str, geometry: list[str], frame: str, channels: list[tuple[int, int]], method: str = "threshold") -> DataFrame:
    """(group, key, int_path): Nystrom embedding of each group and its divisive tree; temporal halves where that fails.

    ``in_sample`` marks the sampled rows. The similarity is the product over
    ``channels`` (half-open column ranges of ``v``) of one RBF each, scaled by
    the median of its nonzero distances from the sample. The halves are the
    first rows in key order, as many as have a frame up to the median, and the rest.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key)
        x, n = np.stack(g["v"]), len(g)
        chosen = np.flatnonzero(g["in_sample"].to_numpy(bool))
        at = np.concatenate([chosen, np.setdiff1d(np.arange(n), chosen)])
        try:
            if len(chosen) < 3:
                raise S.SplitError("too few sampled rows")
            log = np.zeros((len(chosen), n))
            for low, high in channels:
                d = np.sqrt(np.maximum(0, ((x[chosen, None, low:high] - x[None, at, low:high]) ** 2).sum(axis=2)))
                if (d > 0).any():
                    log -= d**2 / (2 * np.median(d[d > 0]))
            embedding = np.empty((n, 2))
            embedding[at] = S.nystrom(np.exp(log))
            paths = S.spectral_tree(embedding, g[geometry].to_numpy(float), method=method)
        except (ArithmeticError, ValueError, np.linalg.LinAlgError):
            first = int((g[frame] <= g[frame].median()).sum())
            paths = np.where(np.arange(n) < first, 2, 3)
        return pd.DataFrame({group: g[group], key: g[key], "int_path": paths})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    columns = list(dict.fromkeys([group, key, "v", "in_sample", frame, *geometry]))
    return rows.select(*columns).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, int_path long")


def svm_scores(kernel: DataFrame, labels: DataFrame, cs: list[float], folds: int = 4, seed: str = "74") -> DataFrame:
    """(class_id, c, video_id, fold, decision, y): cross-validated decision values, a group for each class and C.

    ``kernel`` is the full (i, j, k) table of the training videos, ``labels``
    (video_id, class_id, y); it is one small dense matrix by the model's nature.
    """
    ids, dense = _dense(kernel)
    shared = kernel.sparkSession.sparkContext.broadcast((ids, dense))
    place = Window.partitionBy("class_id", "y").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "video_id")), "video_id")
    dealt = labels.withColumn("fold", (F.row_number().over(place) - 1) % folds)
    grid = dealt.withColumn("c", F.explode(F.array(*map(F.lit, cs))))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ids, dense = shared.value
        g = g.sort_values("video_id").reset_index(drop=True)
        at = np.searchsorted(ids, g.video_id)
        decision = np.zeros(len(g))
        for fold in range(folds):
            test = (g.fold == fold).to_numpy()
            if test.any() and not test.all():
                coef, bias = S.kernel_svm(dense[np.ix_(at[~test], at[~test])], g.y[~test].to_numpy(float), float(g.c.iloc[0]))
                decision[test] = dense[np.ix_(at[test], at[~test])] @ coef + bias
        return g.assign(decision=decision)[["class_id", "c", "video_id", "fold", "decision", "y"]]

    return grid.groupBy("class_id", "c").applyInPandas(run, "class_id int, c double, video_id long, fold int, decision double, y int")


#: Videos of a kernel that is solved in one place (a dense matrix of 8 bytes a pair).
MAX_VIDEOS = 4096


def _dense(kernel: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of a full (i, j, k) table. A precomputed-kernel machine needs all of it, so its size is checked."""
    n = kernel.agg(F.approx_count_distinct("i").alias("n")).head()["n"]
    if n > MAX_VIDEOS:
        raise ValueError(f"about {n} videos; a dense kernel of more than {MAX_VIDEOS} does not fit a task")
    table = kernel.toPandas()
    ids = np.sort(table.i.unique())
    out = np.zeros((len(ids), len(ids)))
    out[np.searchsorted(ids, table.i), np.searchsorted(ids, table.j)] = table.k
    return ids, out


@dataclass(frozen=True)
class Mixture:
    """One point of the fusion grid: share of the root kernels, weight and node-channel mix of each method."""

    alpha: float
    weights: tuple[float, ...] = (1.0,)
    mix: tuple[float, ...] = (1.0,)


def fused(kernels: list[list[dict[str, np.ndarray]]], mixture: Mixture, features: list[float], train: np.ndarray) -> np.ndarray:
    """The signed root of the weighted sum over features and methods of root and node kernels.

    ``kernels[feature][method]`` has ``root`` and ``n0``, perhaps ``n1``. Each
    kernel is scaled by the median of its training block's nonzero entries; a
    root kernel whose training block sums to nothing gives way to ``n0``; two
    node channels are mixed before scaling.
    """

    def scaled(k):
        block = k[np.ix_(train, train)]
        return k / np.median(block[block != 0]) if (block != 0).any() else k

    total = 0
    for feature, weight in zip(kernels, features, strict=True):
        for method, share, mix in zip(feature, mixture.weights, mixture.mix, strict=True):
            root = method["root"] if method["root"][np.ix_(train, train)].sum() > 0 else method["n0"]
            nodes = mix * method["n0"] + (1 - mix) * method["n1"] if "n1" in method else method["n0"]
            total = total + weight * share * (mixture.alpha * scaled(root) + (1 - mixture.alpha) * scaled(nodes))
    return np.sign(total) * np.sqrt(np.abs(total))


def fusion_search(
    features: list[list[dict[str, DataFrame]]], labels: DataFrame, grid: list[Mixture], cs: list[float], weights: list[float] | None = None, criterion: str = "acc", folds: int = 4, seed: str = "74"
) -> DataFrame:
    """(class_id, mixture, c, cv, acc, ap): the best mixture and C of each class by cross-validation, and its test metrics.

    ``features[f][m]`` holds full kernels of all videos (``root``, ``n0``,
    perhaps ``n1``); features weigh alike unless ``weights`` says otherwise.
    ``labels`` has (video_id, class_id, y, is_test). Videos of no class train,
    but are left out of validation and test. A (class, mixture) is one task; the
    first of equal scores in grid order wins. Test values use the scales of the
    training block.
    """
    read = [[{kind: _dense(k) for kind, k in method.items()} for method in feature] for feature in features]
    ids = read[0][0]["root"][0]
    dense = [[{kind: k for kind, (_, k) in method.items()} for method in feature] for feature in read]
    weights = weights or [1 / len(features)] * len(features)
    shared = labels.sparkSession.sparkContext.broadcast((ids, dense))
    some = Window.partitionBy("video_id")
    order = Window.partitionBy("class_id", "is_test", "y").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "video_id")), "video_id")
    dealt = labels.withColumn("fold", (F.row_number().over(order) - 1) % folds).withColumn("negative", F.max("y").over(some) <= 0)
    tasks = dealt.withColumn("mixture", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ids, dense = shared.value
        g = g.sort_values("video_id")
        at, y, test, fold, negative = np.searchsorted(ids, g.video_id), g.y.to_numpy(float), g.is_test.to_numpy(bool), g.fold.to_numpy(), g.negative.to_numpy(bool)
        train = np.zeros(len(ids), bool)
        train[at[~test]] = True
        number = int(g.mixture.iloc[0])
        k = fused(dense, grid[number], weights, train)

        def decide(fit, ask, c):
            coef, bias = S.kernel_svm(k[np.ix_(at[fit], at[fit])], y[fit], c)
            return k[np.ix_(at[ask], at[fit])] @ coef + bias

        def measures(ask, values):
            return S.balanced_accuracy(y[ask], np.where(values > 0, 1, -1)), S.average_precision(y[ask], values)

        out = []
        for n, c in enumerate(cs):
            found = []
            for f in range(folds):
                ask, fit = ~test & (fold == f) & ~negative, ~test & (fold != f)
                if ask.any() and fit.any():
                    found.append(measures(ask, decide(fit, ask, c))[criterion != "acc"])
            ask = test & ~negative
            acc, ap = measures(ask, decide(~test, ask, c)) if ask.any() and (~test).any() else (None, None)
            out.append((int(g.class_id.iloc[0]), number, n, float(c), float(np.mean(found)) if found else 0.0, acc, ap))
        return pd.DataFrame(out, columns=["class_id", "mixture", "n", "c", "cv", "acc", "ap"])

    tried = tasks.groupBy("class_id", "mixture").applyInPandas(run, "class_id int, mixture int, n int, c double, cv double, acc double, ap double")
    best = Window.partitionBy("class_id").orderBy(F.col("cv").desc(), "mixture", "n")
    return tried.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r", "n")


def classify(strategy: str, *args, **options) -> DataFrame:
    """Fusion by name: ``kernel_fusion``, ``simple_voting`` or ``learning_based_fusion``; another name is an error."""
    known = {"kernel_fusion": fusion_search, "simple_voting": voted_scores, "learning_based_fusion": stacked_scores}
    if strategy not in known:
        raise ValueError(f"unknown strategy {strategy!r}; known: {sorted(known)}")
    return known[strategy](*args, **options)


def voted_scores(scores: list[DataFrame]) -> DataFrame:
    """(video_id, class_id, vote) from the decision values of several kernels."""
    votes = None
    for one in scores:
        one = one.select("video_id", "class_id", F.when(F.col("decision") > 0, 1).otherwise(-1).alias("pred"))
        votes = one if votes is None else votes.unionByName(one)
    return majority(votes)


def rbf_kernel(rows: DataFrame, gamma: float) -> DataFrame:
    """(i, j, k), i <= j, of (video_id, v): exp(-gamma |a - b|^2); the kernel's own size."""
    return kernel(rows, lambda a, b: F.exp(-gamma * V.squared_distance(a, b)))


def flat_search(rows: DataFrame, labels: DataFrame, cs: list[float], gammas: list[float]) -> DataFrame:
    """(class_id, gamma, c, acc): the flat baseline, an RBF machine over whole-bag vectors, best of the grid by cross-validation."""
    tried = None
    for gamma in gammas:
        scores = svm_scores(mirror(rbf_kernel(rows, gamma)), labels, cs)
        fold = balanced_accuracy(scores.withColumn("pred", F.when(F.col("decision") > 0, 1).otherwise(-1)), "class_id", "c", "fold")
        one = fold.groupBy("class_id", "c").agg(F.avg("acc").alias("acc")).withColumn("gamma", F.lit(gamma))
        tried = one if tried is None else tried.unionByName(one)
    return argmax(tried, "class_id", "acc", "gamma", "c").select("class_id", "gamma", "c", "acc")


def stacked_scores(first: list[DataFrame], labels: DataFrame, c: float = 1.0) -> DataFrame:
    """Second-level decision values: the first levels' values of each video are the features of a linear SVM."""
    parts = None
    for n, scores in enumerate(first):
        part = scores.select("class_id", "video_id", F.lit(n).alias("dim"), F.col("decision").alias("x"))
        parts = part if parts is None else parts.union(part)
    a, b = (parts.select("class_id", "dim", F.col("video_id").alias(n), F.col("x").alias(f"x{n}")) for n in ("i", "j"))
    kernels = a.join(b, ["class_id", "dim"]).groupBy("i", "j").agg(F.sum(F.col("xi") * F.col("xj")).alias("k"))
    return svm_scores(kernels, labels, [c])


def majority(votes: DataFrame) -> DataFrame:
    """(video_id, class_id, vote): sign of the summed predictions, ties to -1."""
    return votes.groupBy("video_id", "class_id").agg(F.when(F.sum("pred") > 0, 1).otherwise(-1).alias("vote"))


def balanced_accuracy(rows: DataFrame, *by: str) -> DataFrame:
    """Mean of the true positive and true negative rate; null where a class is absent."""
    rate = lambda s: F.avg(F.when(F.col("y") == s, (F.col("pred") == s).cast("double")))
    return rows.groupBy(*by).agg(((rate(1) + rate(-1)) / 2).alias("acc"))


def average_precision(rows: DataFrame, by: str) -> DataFrame:
    """Step-wise average precision; equal scores share the last rank."""
    upto = Window.partitionBy(by).orderBy(F.col("score").desc())
    ranked = rows.withColumns({"rank": F.count("*").over(upto), "hits": F.sum("y").over(upto)})
    return ranked.groupBy(by).agg((F.sum(F.col("y") * F.col("hits") / F.col("rank")) / F.sum("y")).alias("ap"))
