"""Hand-computed cases and properties of the vector functions, trees and solvers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvan.functions import vectors as V
from silvan.operators import kernels as K
from silvan.operators import learn as L
from silvan.operators import relations as R
from silvan.operators import solvers as S
from silvan.operators import trees as T
from silvan.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def array(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_vector_functions(spark):
    assert one(spark, V.power_norm(array(-4, 0, 9))) == [-2, 0, 3]
    assert one(spark, V.l1(array(0, 0))) == [0, 0]
    assert one(spark, V.normalize(array(0, 0), "l2")) is None
    assert one(spark, V.chi_square(array(1, 0), array(0, 1))) == 2.0
    assert one(spark, V.intersection(array(0.5, 0.5), array(0.25, 0.75))) == 0.75
    assert one(spark, V.displacements(array(0, 0, 1, 5, 3, 6))) == [1, 5, 2, 1]
    assert one(spark, V.ancestors(F.lit(26).cast("long"))) == [26, 13, 6, 3, 1]
    assert one(spark, V.parse_path(F.lit("1101"))) == 13
    with pytest.raises(ValueError):
        V.normalize(array(1), "l3")


def test_deep_paths_stay_exact(spark):
    assert one(spark, F.size(V.ancestors(F.lit((1 << 62) - 1).cast("long")))) == 62


def test_tree_expansion(spark):
    leaves = spark.createDataFrame([(1, x) for x in (4, 5, 7, 12, 26, 27)], "video_id long, leaf long")
    got = {}
    for r in T.expand(leaves).collect():
        got.setdefault(r.node_id, set()).add(r.descendant)
    assert got[1] == {2, 3, 4, 5, 6, 7, 12, 13, 26, 27}
    assert got[2] == {4, 5} and got[3] == {6, 7, 12, 13, 26, 27}
    assert all(got[x] == {x} for x in (4, 5, 7, 12, 26, 27))


def test_temporal_halves(spark):
    rows = spark.createDataFrame([("v", k, f) for k, f in enumerate([1, 1, 2, 9])], "g string, k int, f int")
    assert [r.path for r in R.temporal_halves(rows, "g", "f", "k").orderBy("k").collect()] == [2, 2, 3, 3]


def test_median_normaliser(spark):
    k = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 2, 9.0), (1, 3, 0.0)], "i int, j int, k double")
    assert sorted(r.k for r in K.median_normalised(k).collect()) == [0.0, 0.5, 1.0, 4.5]
    zero = k.withColumn("k", F.lit(0.0))
    assert {r.k for r in K.median_normalised(zero).collect()} == {0.0}


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 1, 1), (1, 1, -1), (1, -1, -1), (1, -1, -1)], "c int, y int, pred int")
    assert L.balanced_accuracy(rows, "c").head().acc == 0.75
    y, score = np.array([1, -1, 1, -1]), np.array([0.9, 0.8, 0.8, 0.1])
    assert S.average_precision(y, score) == pytest.approx((1 * 1 + 1 * 2 / 3) / 2)


def test_simplex_grid(spark):
    grid = R.simplex_grid(spark, 3)
    assert grid.count() == 66
    assert grid.filter("abs(w1 + w2 + w3 - 1) > 1e-9").count() == 0


def test_datasets(spark):
    assert tables.channels() == {"obj": (0, 10), "trj": (10, 40), "hog": (40, 136), "hof": (136, 244), "mbh": (244, 436)}
    sports = tables.dataset("sports")(spark)
    assert (sports.count(), sports.filter("is_test").count()) == (150, 47)
    inter = tables.dataset("interactions")(spark)
    assert (inter.filter("is_test").count(), inter.filter("not is_test").count()) == (150, 150)
    assert inter.filter("class = 'hug' and number = 2").head().name == "hug_0002"
    with pytest.raises(KeyError):
        tables.dataset("unknown")


def test_readers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("\t".join(map(str, range(436))) + "\n\n")
    row = tables.read_tracklets(spark, str(tmp_path / "a.tsv")).collect()
    assert len(row) == 1 and row[0].trj[0] == 10 and len(row[0].mbh) == 192
    (tmp_path / "c.xml").write_text("<c><path key='p'>/x</path><option key='num_threads'>3</option><features_list><item>hog</item><item>hof</item></features_list></c>")
    assert tables.read_config(str(tmp_path / "c.xml")) == {"p": "/x", "num_threads": 3, "features_list": ["hog", "hof"]}


def test_empty_bags(spark):
    rows = spark.createDataFrame([], "video_id long, leaf long, word_id long")
    assert T.bovw_tree(rows).count() == 0
    assert K.sparse_intersection(T.edges(T.bovw_tree(rows))).count() == 0


def test_sparse_kernels_equal_all_edge_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(v, n, w, float(rng.integers(1, 4))) for v in range(3) for n in (2, 3) for w in range(4) if rng.random() < 0.7]
    edges = spark.createDataFrame(rows, "video_id long, node_id long, word_id long, x double")
    dense = {}
    for v, n, w, x in rows:
        dense.setdefault((v, n), np.zeros(4))[w] = x
    chi = lambda a, b: (a - b) ** 2 / np.where(a + b > 0, a + b, 1)
    for function, product in ((K.sparse_intersection, np.minimum), (K.factored_linear, np.multiply), (K.sparse_chi_square, chi)):
        for r in function(edges).collect():
            want = np.mean([product(a, b).sum() for (i, _), a in dense.items() if i == r.i for (j, _), b in dense.items() if j == r.j])
            assert r.k == pytest.approx(want)


def test_connected_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 31)], "src long, dst long")
    got = {r.node: r.component for r in R.connected_components(edges).collect()}
    assert got == {k: 0 for k in range(21)} | {30: 30, 31: 30}


def test_solvers():
    rng = np.random.default_rng(1)
    a = rng.random((6, 6))
    a = a @ a.T + np.eye(6)
    assert np.allclose(S.spd_power(a, -1) @ a, np.eye(6))
    z, y = rng.random((8, 5)), np.arange(1, 9.0)
    w = S.linear_svr(z, y)
    f = lambda w: 0.5 * w @ w + (np.maximum(0, np.abs(z @ w - y) - 0.1) ** 2).sum()
    assert all(f(w) <= f(w + 1e-3 * rng.standard_normal(5)) for _ in range(50))
    x = np.concatenate([rng.standard_normal((20, 2)) - 3, rng.standard_normal((20, 2)) + 3])
    y = np.repeat([-1.0, 1.0], 20)
    coef, bias = S.kernel_svm(x @ x.T, y, 1.0)
    assert (np.sign(x @ x.T @ coef + bias) == y).all()


def test_spectral_tree_is_a_partition_with_large_leaves():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((150, 2)), rng.standard_normal((150, 2)) + 20])
    paths = S.spectral_tree(x, x, min_leaf=50)
    leaves, sizes = np.unique(paths, return_counts=True)
    assert len(leaves) >= 2 and sizes.min() >= 50 and sizes.sum() == 300


def test_nystrom_separates_blocks():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((30, 2)), rng.standard_normal((30, 2)) + 6])
    order = rng.permutation(60)
    d = ((x[order][:20, None] - x[order][None]) ** 2).sum(axis=2)
    e = S.nystrom(np.exp(-d / 8))
    side = order < 30
    assert (e[side, 0].max() < e[~side, 0].min()) or (e[side, 0].min() > e[~side, 0].max())
    with pytest.raises(ValueError):
        S.nystrom(np.eye(2), 2)


@pytest.mark.parametrize("part", [7, 1 << 15])
def test_nearest_rows_by_brute_force(spark, part):
    """With blocks of any size, also where equal points and equal distances abound."""
    rng = np.random.default_rng(4)
    points = [(k, int(k % 3 == 0), int(rng.integers(0, 40)), float(rng.integers(0, 6)), float(rng.integers(0, 6))) for k in range(240)]
    rows = spark.createDataFrame(points, "id long, video int, frame int, x double, y double")
    got = {r.id: [(n.d, n.other) for n in r.near] for r in R.band_neighbours(rows, "video", "id", 5, 4, part).collect()}
    for i, v, f, x, y in points:
        want = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, w, g, a, b in points if w == v and j != i and abs(f - g) <= 5)[:4]
        assert got.get(i, []) == want
    vectors = spark.createDataFrame([(i, v, [x, y]) for i, v, _, x, y in points], "id long, video int, v array<double>")
    edges = {(r.src, r.dst) for r in R.knn_edges(vectors, "video", "id", "v", 3, part).collect()}
    near = {(i, j) for i, v, _, x, y in points for _, j in sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, w, _, a, b in points if w == v and j != i)[:3]}
    assert edges == near | {(j, i) for i, j in near}
    assert R.band_neighbours(rows.limit(0), "video", "id", 5, 4, part).count() == 0


def test_intersection_kernel_over_many_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(v, n, w, float(rng.integers(1, 4))) for v in range(30) for n in (2, 3) for w in range(6) if rng.random() < 0.6]
    edges = spark.createDataFrame(rows, "video_id long, node_id long, word_id long, x double")
    few = {(r.i, r.j): r.k for r in K.sparse_intersection(edges).collect()}
    many = {(r.i, r.j): r.k for r in K.sparse_intersection(edges, 2).collect()}
    assert len(few) == 30 * 31 / 2 and few.keys() == many.keys()
    assert all(few[x] == pytest.approx(many[x]) for x in few)


def test_fisher_equals_its_formula(spark):
    rng = np.random.default_rng(7)
    x, leaf = rng.standard_normal((40, 3)), rng.integers(2, 4, 40)
    mu, var, w = rng.standard_normal((2, 3)), rng.random((2, 3)) + 0.5, np.array([0.3, 0.7])
    rows = spark.createDataFrame([(1, int(n), v.tolist()) for n, v in zip(leaf, x)], "video_id long, leaf long, v array<double>")
    gmm = spark.createDataFrame([(k, float(w[k]), mu[k].tolist(), var[k].tolist()) for k in range(2)], "k int, w double, mu array<double>, var array<double>")
    q = S.shares(x, w, mu, var)
    density = w * np.exp(-0.5 * (((x[:, None] - mu) ** 2) / var).sum(axis=2)) / np.sqrt(var.prod(axis=1))
    assert np.allclose(q, density / density.sum(axis=1, keepdims=True))
    for r in L.fisher(rows, gmm).collect():
        own = np.ones(40, bool) if r.node_id == 1 else leaf == r.node_id
        z = (x[own, r.dim] - mu[r.k, r.dim]) / np.sqrt(var[r.k, r.dim])
        assert r.mu_part == pytest.approx((q[own, r.k] * z).sum() / (own.sum() * np.sqrt(w[r.k])))
        assert r.var_part == pytest.approx((q[own, r.k] * (z * z - 1)).sum() / (own.sum() * np.sqrt(2 * w[r.k])))


def test_mixture_reaches_a_fixed_point(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(-2, 0.5, (150, 2)), rng.normal(2, 0.5, (150, 2))])
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    start = spark.createDataFrame([(0, [-1.0, 0.0]), (1, [1.0, 0.0])], "word_id long, c array<double>")
    got = L.diagonal_gmm(rows, start).orderBy("k").collect()
    assert np.allclose([r.mu for r in got], [x[:150].mean(axis=0), x[150:].mean(axis=0)], atol=0.02)
    assert np.allclose([r.w for r in got], [0.5, 0.5], atol=0.01)


def test_rank_pooling_of_frames(spark):
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(1, 1, k // 4, rng.standard_normal(3).tolist()) for k in range(20)], "video_id long, leaf long, frame long, v array<double>")
    gmm = spark.createDataFrame([(0, 1.0, [0.0] * 3, [1.0] * 3)], "k int, w double, mu array<double>, var array<double>")
    got = L.fisher_darwin(rows, gmm, "frame").collect()
    frames = {}
    for r in L.fisher(rows, gmm, "frame").collect():
        frames.setdefault(r.frame, np.zeros((2, 3)))[:, r.dim] = r.mu_part, r.var_part
    assert len(got) == 1 and np.allclose(got[0].w, S.darwin(np.stack([frames[f].ravel() for f in sorted(frames)])))


def test_fusion_rules():
    rng = np.random.default_rng(10)
    a = rng.random((6, 6))
    train = np.array([True] * 4 + [False] * 2)
    median = lambda k: k / np.median(k[:4, :4])
    signed = lambda k: np.sign(k) * np.sqrt(np.abs(k))
    b, c = rng.random((2, 6, 6))
    one = [[{"root": a, "n0": b, "n1": c}]]
    got = L.fused(one, L.Mixture(0.25, (1.0,), (0.4,)), [1.0], train)
    assert np.allclose(got, signed(0.25 * median(a) + 0.75 * median(0.4 * b + 0.6 * c)))
    # a root kernel that sums to nothing gives way to the nodes
    assert np.allclose(L.fused([[{"root": 0 * a, "n0": b}]], L.Mixture(0.5), [1.0], train), signed(median(b)))
    two = [[{"root": a, "n0": b}, {"root": c, "n0": a}], [{"root": b, "n0": c}, {"root": a, "n0": c}]]
    got = L.fused(two, L.Mixture(1.0, (0.7, 0.3), (1.0, 1.0)), [0.5, 0.5], train)
    assert np.allclose(got, signed(0.5 * (0.7 * median(a) + 0.3 * median(c)) + 0.5 * (0.7 * median(b) + 0.3 * median(a))))


def test_fusion_leaves_negatives_out_of_validation_and_test(spark):
    rng = np.random.default_rng(11)
    side = np.array([1.0] * 16 + [-1.0] * 16 + [0.0] * 8)
    x = np.stack([side * 3 + rng.standard_normal(40) * 0.3, rng.standard_normal(40)], axis=1)
    k = spark.createDataFrame([(i, j, float(x[i] @ x[j] + 1)) for i in range(40) for j in range(40)], "i long, j long, k double")
    labels = [(v, c, 1 if side[v] == s else -1, v % 4 == 0) for v in range(40) for c, s in ((0, 1.0), (1, -1.0))]
    table = spark.createDataFrame(labels, "video_id long, class_id int, y int, is_test boolean")
    best = L.classify("kernel_fusion", [[{"root": k, "n0": k}]], table, [L.Mixture(0.0), L.Mixture(1.0)], [0.1, 1.0]).collect()
    # all that is asked is of one of the two sides, and these part cleanly
    assert {(r.class_id, r.mixture, r.c) for r in best} == {(0, 0, 0.1), (1, 0, 0.1)}
    assert all(r.cv == 1.0 and r.acc == 1.0 and r.ap == 1.0 for r in best)
    with pytest.raises(ValueError):
        L.classify("unknown")


def test_kmeans_split_peels_outliers():
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.standard_normal((120, 2)), rng.standard_normal((120, 2)) + 12, rng.standard_normal((3, 2)) + 400])
    paths = S.spectral_tree(x, x, min_leaf=40, method="kmeans")
    assert (paths[-3:] == 0).all() and set(paths[:240].tolist()) == {2, 3}
    assert len(set(paths[:120].tolist())) == len(set(paths[120:240].tolist())) == 1
    assert S.two_means(np.ones((5, 2))) is None
    with pytest.raises(ValueError):
        S.spectral_tree(x, x, method="other")


def test_thresholds_keep_their_distance():
    x = np.concatenate([np.zeros(50), np.linspace(0, 1, 50)])
    picks = S.candidate_thresholds(x)
    assert picks[0] == 0 and all(b - a > 0.01 for a, b in zip(picks, picks[1:]))


def test_edge_vectors_have_unit_length(spark):
    nodes = spark.createDataFrame([(1, 1, 0, 5), (1, 1, 1, 4), (1, 2, 0, 1), (1, 2, 1, 4), (1, 3, 0, 4)], "video_id long, node_id long, word_id long, n long")
    for norm, power in (("l1", False), ("l1", True), ("l2", False), ("l2", True)):
        sums = {}
        for r in T.edges(nodes, norm, power).collect():
            sums[r.node_id] = sums.get(r.node_id, 0) + abs(r.x) ** (1 if norm == "l1" else 2)
        assert sums == {2: pytest.approx(1), 3: pytest.approx(1)}


def test_trajectory_channels(spark):
    got = {name: one(spark, c) for name, c in V.trajectory_channels(array(*range(0, 60, 2)), F.lit(20)).items()}
    assert got["x"] == [4.0 * k for k in range(1, 15)] and got["y"] == [4.0 * k + 2 for k in range(1, 15)]
    assert got["v_x"] == got["v_y"] == [4.0] * 14 and got["t"] == [float(x) for x in range(6, 21)]


def test_numbered_listing(spark, tmp_path):
    for name in ("b.avi", "a.avi", "c.txt", "d.avi"):
        (tmp_path / name).write_text("x")
    assert [(r.video_id, r.name) for r in tables.listing(spark, str(tmp_path)).orderBy("video_id").collect()] == [(0, "a.avi"), (1, "b.avi"), (2, "d.avi")]
    assert {(r["name"], r["class"]) for r in tables.sports_listing(spark, str(tmp_path)).collect()} == {(n, "Diving") for n in ("a.avi", "b.avi", "d.avi")}
    rows = spark.range(1000).selectExpr("1000 - id AS x").repartition(7)
    assert [r.n for r in tables.numbered(rows, "n", "x").orderBy("x").collect()] == list(range(1000))


def test_stage_tables_and_lists(spark, tmp_path):
    df = spark.createDataFrame([(0, "hog", 1), (1, "hof", 2)], "fold_id int, feat string, x int")
    tables.write_stage(df, str(tmp_path / "stage"))
    assert spark.read.parquet(str(tmp_path / "stage")).filter("feat = 'hof'").head().x == 2
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "long_jump.txt").write_text("a_b \n\nc\n")
    got = tables.dataset("split_lists")(spark, str(tmp_path / "lists")).collect()
    assert {(r["name"], r["class"]) for r in got} == {("a b", "long_jump"), ("c", "long_jump")}
    spark.createDataFrame([(1, 0, 1)], "video_id long, class_id int, y int").write.parquet(str(tmp_path / "ids"))
    assert tables.dataset("indexed_split")(spark, str(tmp_path / "ids")).head().video_id == 0


def test_stages_resume_and_represent(spark, tmp_path):
    from silvan.plans import stages

    base, raw = str(tmp_path / "out"), tmp_path / "raw"
    raw.mkdir()
    (raw / "a.tsv").write_text("\t".join(map(str, range(436))) + "\n")
    assert stages.extract(spark, str(raw), base).count() == 1
    (raw / "b.tsv").write_text(("\t".join(map(str, range(436))) + "\n") * 2)
    (raw / "empty.tsv").write_text("")
    assert stages.extract(spark, str(raw), base).count() == 3
    assert stages.extract(spark, str(raw), base).count() == 3
    assert list(stages.layout(base)) == ["tracklets", "clusters", "representations", "kernels", "results"]
    rows = spark.createDataFrame([(1, 2, 1, [0.0, 1.0]), (1, 3, 2, [1.0, 0.0]), (1, 3, 3, [0.9, 0.0])], "video_id long, leaf long, t long, v array<double>")
    words = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [5.0, 5.0])], "word_id long, c array<double>")
    gmm = spark.createDataFrame([(0, 0.5, [0.0, 1.0], [1.0, 1.0]), (1, 0.5, [1.0, 0.0], [1.0, 1.0])], "k int, w double, mu array<double>, var array<double>")
    assert {r.node_id: r.v for r in stages.represent(rows, words, "bovw").collect()} == {1: [1.0, 2.0, 0.0], 2: [1.0, 0.0, 0.0], 3: [0.0, 2.0, 0.0]}
    for kind, size in (("fv", 8), ("vd", 16)):
        got = stages.represent(rows, gmm, kind).collect()
        assert {r.node_id for r in got} == {1, 2, 3} and all(len(r.v) == size for r in got)
        assert [r.node_id for r in stages.represent(rows, gmm, kind, treelike=False).collect()] == [1]
    with pytest.raises(ValueError):
        stages.represent(rows, gmm, "other")
    tree = T.bovw_tree(T.nearest_words(rows, words))
    assert stages.kernels(tree, "chi2", "l2", True).columns == ["fold_id", "feat", "i", "j", "k"]
    with pytest.raises(ValueError):
        K.edge_kernel(tree, "other")


def test_a_kernel_above_the_bound_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_VIDEOS", 3)
    k = spark.createDataFrame([(i, j, 1.0) for i in range(6) for j in range(6)], "i long, j long, k double")
    with pytest.raises(ValueError):
        L.svm_scores(k, spark.createDataFrame([(1, 0, 1)], "video_id long, class_id int, y int"), [1.0])
