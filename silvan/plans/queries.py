"""The registered queries over the driver tables, each beside its DuckDB twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..operators import kernels as K
from ..operators import learn as L
from ..operators import relations as R
from ..operators import trees as T
from ..sources import tables as S

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Bags of descriptors in DuckDB, as ``sources.tables.descriptors`` has them.
BAGS = """d0 AS (SELECT CAST(label * 5 + vec_id % 5 AS BIGINT) AS video_id, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT *, CAST(8 + (row_number() OVER (PARTITION BY video_id ORDER BY vec_id) - 1) % 8 AS BIGINT) AS leaf,
      CAST(row_number() OVER (PARTITION BY video_id ORDER BY vec_id) AS INTEGER) AS t, video_id % 5 = 0 AS is_test FROM d0),
c AS (SELECT video_id, vec_id, leaf, t, unnest(v) AS x, CAST(unnest(range(64)) AS INTEGER) AS dim FROM d)"""
WORDS = """w AS (SELECT vec_id AS word_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(64)) AS dim FROM embeddings WHERE vec_id < 16),
m AS (SELECT video_id, vec_id, leaf, word_id FROM (
  SELECT c.video_id, c.vec_id, c.leaf, w.word_id, row_number() OVER (PARTITION BY c.vec_id ORDER BY round(sum((c.x - w.x) * (c.x - w.x)), 12), w.word_id) AS r
  FROM c JOIN w ON c.dim = w.dim GROUP BY c.video_id, c.vec_id, c.leaf, w.word_id) WHERE r = 1)"""
NODES = """n AS (SELECT video_id, node_id, word_id, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT video_id, word_id, unnest([leaf, leaf // 2, leaf // 4, leaf // 8]) AS node_id FROM m) GROUP BY ALL)"""
EDGES = """b AS (SELECT video_id, node_id, word_id, n FROM n WHERE node_id > 1
  UNION ALL SELECT k.video_id, k.node_id, -1 - p.word_id, p.n FROM (SELECT DISTINCT video_id, node_id FROM n WHERE node_id > 1) k
  JOIN n p ON p.video_id = k.video_id AND p.node_id = k.node_id // 2),
e AS (SELECT video_id, node_id, word_id, n / sum(n) OVER (PARTITION BY video_id, node_id) AS x FROM b),
ne AS (SELECT video_id, count(DISTINCT node_id) AS e FROM e GROUP BY 1)"""
POINTS = """p AS (SELECT event_type AS video, event_id, user_id, (day(ts) - 1) * 24 + hour(ts) AS frame, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(column, digits: int = 6):
    return F.round(column, digits) + F.lit(0.0)


def _long(df, *keys):
    return df.select(*keys, F.posexplode("v").alias("dim", "x")).select(*keys, "dim", _r(F.col("x")).alias("x"))


def _assigned(spark, sf):
    return T.nearest_words(S.descriptors(spark, sf), S.codebook(spark, sf)).select("video_id", "vec_id", "leaf", "word_id")


def _edges(spark, sf):
    return T.edges(T.bovw_tree(_assigned(spark, sf)))


def _roots(spark, sf):
    return T.root_vectors(S.descriptors(spark, sf))


# --- vector functions -------------------------------------------------------------------------


@query(f"WITH {BAGS} SELECT vec_id, CAST(len(v[1:10]) AS INTEGER) AS n_obj, CAST(len(v[11:40]) AS INTEGER) AS n_trj, round(list_sum(v[11:40]), 6) + 0.0 AS trj_sum FROM d")
def channel_slice(spark, sf):
    d = S.descriptors(spark, sf).select("vec_id", *S.channel_slices(F.col("v"))[:2])
    return d.select("vec_id", F.size("obj").alias("n_obj"), F.size("trj").alias("n_trj"), _r(V.total(F.col("trj"))).alias("trj_sum"))


@query(f"WITH {BAGS} SELECT a.vec_id, a.dim, round(b.x - a.x, 6) + 0.0 AS x FROM c a JOIN c b ON a.vec_id = b.vec_id AND b.dim = a.dim + 2 WHERE a.dim < 28")
def displacements_lag2(spark, sf):
    d = S.descriptors(spark, sf).select("vec_id", V.displacements(F.slice("v", 1, 30)).alias("v"))
    return _long(d, "vec_id")


@query(f"WITH {BAGS} SELECT vec_id, dim, round(sign(x) * sqrt(abs(x)), 6) + 0.0 AS x FROM c")
def power_norm(spark, sf):
    return _long(S.descriptors(spark, sf).select("vec_id", V.power_norm(F.col("v")).alias("v")), "vec_id")


@query(f"WITH {BAGS} SELECT vec_id, dim, round(x / sum(abs(x)) OVER (PARTITION BY vec_id), 6) + 0.0 AS x FROM c")
def l1_normalize(spark, sf):
    return _long(S.descriptors(spark, sf).select("vec_id", V.l1(F.col("v")).alias("v")), "vec_id")


@query(f"WITH {BAGS} SELECT vec_id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) + 0.0 AS x FROM c")
def l2_normalize(spark, sf):
    return _long(S.descriptors(spark, sf).select("vec_id", V.normalize(F.col("v"), "l2").alias("v")), "vec_id")


@query(f"WITH {BAGS} SELECT vec_id, dim, round(x / sum(abs(x)) OVER (PARTITION BY vec_id, dim < 32), 6) + 0.0 AS x FROM c")
def split_l1_normalize(spark, sf):
    return _long(S.descriptors(spark, sf).select("vec_id", V.split_l1(F.col("v"), 64).alias("v")), "vec_id")


@query("""WITH h AS (SELECT event_id, (event_id % 97) / 97.0::DOUBLE AS h, (event_id % 11) / 11.0::DOUBLE AS s, (event_id % 7) / 7.0::DOUBLE AS v FROM events),
g AS (SELECT *, CAST(floor(h * 6) AS INTEGER) AS k, h * 6 - floor(h * 6) AS f FROM h),
x AS (SELECT *, v * (1 - s) AS p, v * (1 - f * s) AS q, v * (1 - (1 - f) * s) AS t FROM g)
SELECT event_id, CAST(floor(256 * CASE k WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END) AS INTEGER) AS r,
CAST(floor(256 * CASE k WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q ELSE p END) AS INTEGER) AS g,
CAST(floor(256 * CASE k WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END) AS INTEGER) AS b FROM x""")
def hsv_to_rgb(spark, sf):
    part = lambda n: F.col("event_id") % n / F.lit(float(n))
    r, g, b = V.hsv_to_rgb(part(97), part(11), part(7))
    return S.table(spark, sf, "events").select("event_id", r.alias("r"), g.alias("g"), b.alias("b"))


@query(f"""WITH {BAGS}, p AS (SELECT vec_id, dim // 2 AS i, dim % 2 AS odd, x FROM c WHERE dim < 30), m AS (
SELECT vec_id, CASE odd WHEN 0 THEN 'x' ELSE 'y' END AS channel, i - 1 AS place, x FROM p WHERE i > 0
UNION ALL SELECT b.vec_id, CASE b.odd WHEN 0 THEN 'v_x' ELSE 'v_y' END, b.i - 1, b.x - a.x FROM p a JOIN p b ON a.vec_id = b.vec_id AND a.odd = b.odd AND b.i = a.i + 1
UNION ALL SELECT vec_id, 't', i, CAST(t - 14 + i AS DOUBLE) FROM (SELECT vec_id, t, unnest(range(15)) AS i FROM d))
SELECT vec_id, channel, CAST(place AS INTEGER) AS place, round(x, 6) + 0.0 AS x FROM m""")
def trajectory_channels(spark, sf):
    channels = V.trajectory_channels(F.slice("v", 1, 30), F.col("t"))
    parts = F.array(*[F.struct(F.lit(name).alias("channel"), values.alias("v")) for name, values in channels.items()])
    rows = S.descriptors(spark, sf).select("vec_id", F.explode(parts).alias("c")).select("vec_id", "c.channel", F.posexplode("c.v").alias("place", "x"))
    return rows.select("vec_id", "channel", "place", _r(F.col("x")).alias("x"))


# --- relations ---------------------------------------------------------------------------------


@query(f"WITH {BAGS} SELECT is_test, label, count(*) AS n, count(DISTINCT video_id) AS videos FROM d GROUP BY ALL")
def train_test_filter(spark, sf):
    return S.descriptors(spark, sf).groupBy("is_test", "label").agg(F.count("*").alias("n"), F.countDistinct("video_id").alias("videos"))


VIDEOS = "v AS (SELECT DISTINCT CAST(label * 5 + vec_id % 5 AS BIGINT) AS video_id, label FROM embeddings), y AS (SELECT v.video_id, k.label AS class_id, CASE WHEN v.label = k.label THEN 1 ELSE -1 END AS y FROM v, (SELECT DISTINCT label FROM embeddings) k)"


def _labels(spark, sf):
    videos = S.descriptors(spark, sf).select("video_id", "label").distinct()
    return R.one_vs_rest(videos, videos.select(F.col("label").alias("class_id")).distinct())


@query(f"WITH {VIDEOS} SELECT video_id, class_id, y FROM y")
def onevsrest_labels(spark, sf):
    return _labels(spark, sf)


@query(f"WITH {VIDEOS} SELECT video_id FROM y WHERE class_id < 5 GROUP BY 1 HAVING max(y) > 0")
def negatives_excluded(spark, sf):
    return R.without_negatives(_labels(spark, sf).filter("class_id < 5"))


@query(f"WITH {VIDEOS} SELECT video_id, CAST(sum(y * pow(10.0, class_id)) AS DOUBLE) AS strat FROM y GROUP BY 1")
def strat_id(spark, sf):
    return R.strat_id(_labels(spark, sf))


@query("SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('74:' || vec_id), vec_id) - 1) % 4 AS INTEGER) AS fold FROM embeddings")
def stratified_folds_md5(spark, sf):
    return R.stratified_folds(S.table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id", 4, "74")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def resume_anti_join(spark, sf):
    done = S.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.remaining(S.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


@query("SELECT n_name, c_mktsegment, count(*) AS n, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def keyed_lookup_join(spark, sf):
    nation = S.table(spark, sf, "nation").select("n_nationkey", "n_name")
    rows = S.table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('7:' || event_id), event_id) AS r FROM events) WHERE r <= 3")
def capped_sample_md5(spark, sf):
    return R.capped_sample(S.table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id", 3, "7")


@query(f"""WITH {POINTS}, g AS (SELECT video, event_id, CAST(floor(y / 100 * 3) * 3 + floor(x / 500 * 3) AS BIGINT) AS cell FROM p WHERE x >= 0 AND x < 500 AND y >= 0 AND y < 100),
k AS (SELECT *, count(*) OVER (PARTITION BY video, cell) AS n, row_number() OVER (PARTITION BY video, cell ORDER BY md5('9:' || event_id), event_id) AS k FROM g),
s AS (SELECT *, sum(CAST(k <= ceil(n * 0.01::DOUBLE / 9) AS INTEGER)) OVER (PARTITION BY video) AS s1, sum(CAST(k <= ceil(n * 0.1::DOUBLE / 9) AS INTEGER)) OVER (PARTITION BY video) AS s2 FROM k)
SELECT video, event_id, cell, CASE WHEN s1 > 2 THEN k <= ceil(n * 0.01::DOUBLE / 9) WHEN s2 > 2 THEN k <= ceil(n * 0.1::DOUBLE / 9) ELSE k <= ceil(n * 1.0::DOUBLE / 9) END AS in_sample FROM s""")
def grid_stratified_sample(spark, sf):
    rows = S.points(spark, sf).select("video", "event_id", (F.col("x") / 500).alias("x"), (F.col("y") / 100).alias("y"))
    return R.grid_sample(rows, "video", "event_id", 0.01, 3, "9").select("video", "event_id", "cell", "in_sample")


@query(f"WITH {POINTS} SELECT video, event_id, count(*) OVER (PARTITION BY video ORDER BY frame RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM p")
def band_window_count(spark, sf):
    w = Window.partitionBy("video").orderBy("frame").rangeBetween(-5, 5)
    return S.points(spark, sf).select("video", "event_id", F.count("*").over(w).alias("n"))


NEAR = """a AS (SELECT l.video, l.event_id, sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2)) AS dist, row_number() OVER (PARTITION BY l.event_id ORDER BY pow(l.x - r.x, 2) + pow(l.y - r.y, 2), r.event_id) AS k
  FROM p l JOIN p r ON l.video = r.video AND abs(l.frame - r.frame) <= 5 AND l.event_id <> r.event_id),
s AS (SELECT video, event_id, avg(dist) AS sp FROM a WHERE k <= 30 GROUP BY ALL),
t AS (SELECT video, avg(dist) + stddev_pop(dist) AS lim FROM a WHERE k <= 30 GROUP BY 1)"""


@query(f"WITH {POINTS}, {NEAR} SELECT s.video, s.event_id, round(s.sp, 6) AS sparsity FROM s JOIN t USING (video) WHERE s.sp <= t.lim")
def density_filter(spark, sf):
    rows = R.density_inliers(S.points(spark, sf), "video", "event_id")
    return rows.select("video", "event_id", F.round("sparsity", 6).alias("sparsity"))


KNN = """k AS (SELECT video_id, src, dst FROM (SELECT x.video_id, x.vec_id AS src, y.vec_id AS dst, row_number() OVER (PARTITION BY x.vec_id ORDER BY round(sum((x.x - y.x) * (x.x - y.x)), 12), y.vec_id) AS r
  FROM c x JOIN c y ON x.video_id = y.video_id AND x.dim = y.dim AND x.vec_id <> y.vec_id GROUP BY x.video_id, x.vec_id, y.vec_id) WHERE r <= 2),
g AS (SELECT * FROM k UNION SELECT video_id, dst, src FROM k)"""


def _knn(spark, sf):
    rows = S.descriptors(spark, sf).select("video_id", "vec_id", "v")
    return R.knn_edges(rows, "video_id", "vec_id", "v", 2)


@query(f"WITH {BAGS}, {KNN} SELECT video_id, src, dst FROM g")
def knn_graph(spark, sf):
    return _knn(spark, sf)


@query(f"WITH RECURSIVE {BAGS}, {KNN}, z(node, seen) AS (SELECT src, src FROM g UNION SELECT g.dst, z.seen FROM z JOIN g ON g.src = z.node) SELECT node, min(seen) AS component FROM z GROUP BY 1")
def connected_components(spark, sf):
    return R.connected_components(_knn(spark, sf))


@query("SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem UNION SELECT l_suppkey, l_partkey FROM lineitem")
def graph_symmetrise(spark, sf):
    return R.symmetric(S.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


CENTS = "CAST(round(value * 100) AS BIGINT)"


@query(f"SELECT user_id, event_id, round(sum({CENTS}) OVER w / CAST(100 * count(*) OVER w AS DOUBLE) + 1e-9, 6) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_mean_fwd(spark, sf):
    return _running(spark, sf, False)


@query(f"SELECT user_id, event_id, round(sum({CENTS}) OVER w / CAST(100 * count(*) OVER w AS DOUBLE) + 1e-9, 6) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING)")
def running_mean_rev(spark, sf):
    return _running(spark, sf, True)


def _running(spark, sf, reverse):
    rows = S.table(spark, sf, "events").select("user_id", "event_id", "ts", F.round(F.col("value") * 100).cast("long").alias("c"))
    mean = R.running_mean(rows, ["user_id"], ["ts", "event_id"], "c", reverse)
    return rows.select("user_id", "event_id", F.round(mean / 100 + 1e-9, 6).alias("mean"))


@query(f"SELECT user_id, event_id, row_number() OVER w AS rank, {CENTS} - lag({CENTS}) OVER w AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def velocity_channels(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    c = F.round(F.col("value") * 100).cast("long")
    return S.table(spark, sf, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("rank"), (c - F.lag(c).over(w)).alias("step"))


@query(f"WITH {POINTS}, q AS (SELECT *, quantile_cont(frame, 0.5) OVER (PARTITION BY video) AS med FROM p), r AS (SELECT *, sum(CAST(frame <= med AS INTEGER)) OVER (PARTITION BY video) AS n, row_number() OVER (PARTITION BY video ORDER BY event_id) AS k FROM q) SELECT video, event_id, CASE WHEN k <= n THEN 2 ELSE 3 END AS path FROM r")
def temporal_median_split(spark, sf):
    return R.temporal_halves(S.points(spark, sf), "video", "frame", "event_id").select("video", "event_id", "path")


@query(f"WITH {BAGS} SELECT video_id, vec_id, CASE WHEN row_number() OVER (PARTITION BY video_id ORDER BY v[1], vec_id) <= count(*) OVER (PARTITION BY video_id) // 2 THEN 0 ELSE 1 END AS half FROM d")
def equal_halves_split(spark, sf):
    d = S.descriptors(spark, sf).withColumn("x", F.get("v", F.lit(0)))
    return R.equal_halves(d, "video_id", ["x", "vec_id"]).select("video_id", "vec_id", "half")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events),
s AS (SELECT event_type, list(value ORDER BY k) AS l FROM r WHERE list_contains(list_transform(range(10), lambda i: floor((0.1::DOUBLE + (0.9::DOUBLE - 0.1::DOUBLE) * i / 9) * (n - 1))), k) GROUP BY 1)
SELECT event_type, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[-1] > 20.0 THEN list_concat(a, b) ELSE a END)) AS threshold FROM s""")
def candidate_thresholds(spark, sf):
    rows = S.table(spark, sf, "events").select("event_type", "event_id", "value")
    return R.threshold_picks(rows, "event_type", "value", "event_id", min_gap=20.0)


@query("SELECT a / 10.0::DOUBLE AS w1, b / 10.0::DOUBLE AS w2, (10 - a - b) / 10.0::DOUBLE AS w3 FROM (SELECT unnest(range(11)) AS a), (SELECT unnest(range(11)) AS b) WHERE a + b <= 10")
def simplex_grid(spark, sf):
    return R.simplex_grid(spark, 3)


@query("SELECT user_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def merged_counts(spark, sf):
    """Tables of several methods merged by key; values that collide become a list."""
    events = S.table(spark, sf, "events")
    counts = [events.filter(F.col("event_type") == t).groupBy("user_id").agg(F.count("*").alias("n")) for t in sorted(r[0] for r in events.select("event_type").distinct().collect())]
    return R.merge_lists(counts, ["user_id"], "n").select("user_id", F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("counts"))


@query("SELECT event_type, method, user_id, n FROM (SELECT event_type, 'events' AS method, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS r FROM events GROUP BY event_type, user_id) WHERE r = 1")
def grid_argmax(spark, sf):
    counts = S.table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return R.argmax(R.merge_tagged(events=counts), "event_type", "n", "user_id")


@query(f"WITH {BAGS} SELECT video_id, dim, round(sum(x * x) - sum(x) * sum(x) / count(*), 6) + 0.0 AS inertia FROM c GROUP BY ALL")
def tube_inertia(spark, sf):
    rows = S.descriptors(spark, sf).select("video_id", F.posexplode("v").alias("dim", "x"))
    inertia = F.sum(F.col("x") * F.col("x")) - F.sum("x") * F.sum("x") / F.count("*")
    return rows.groupBy("video_id", "dim").agg(_r(inertia).alias("inertia"))


@query(f"WITH {BAGS}, {KNN} SELECT a.video_id, a.leaf, count(*) AS links, count(*) FILTER (WHERE a.leaf = b.leaf) AS inside FROM g JOIN d a ON a.vec_id = g.src JOIN d b ON b.vec_id = g.dst GROUP BY ALL")
def tube_density(spark, sf):
    leaf = S.descriptors(spark, sf).select("vec_id", "leaf")
    g = _knn(spark, sf).join(leaf.withColumnsRenamed({"vec_id": "src", "leaf": "leaf"}), "src").join(leaf.withColumnsRenamed({"vec_id": "dst", "leaf": "to"}), "dst")
    return g.groupBy("video_id", "leaf").agg(F.count("*").alias("links"), F.count(F.when(F.col("leaf") == F.col("to"), 1)).alias("inside"))


@query(f"WITH {BAGS} SELECT vec_id, dim, round((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w), 6) + 0.0 AS scaled, round(x - avg(x) OVER w, 6) + 0.0 AS centred FROM c WINDOW w AS (PARTITION BY video_id, dim)")
def rescale_and_centre(spark, sf):
    w = Window.partitionBy("video_id", "dim")
    rows = S.descriptors(spark, sf).select("video_id", "vec_id", F.posexplode("v").alias("dim", "x"))
    low, high = F.min("x").over(w), F.max("x").over(w)
    return rows.select("vec_id", "dim", _r((F.col("x") - low) / (high - low)).alias("scaled"), _r(F.col("x") - F.avg("x").over(w)).alias("centred"))


# --- datasets and reports ------------------------------------------------------------------------


TRAINING = ", ".join(f"('{c}', {n})" for c, ns in S.INTERACTION_TRAINING.items() for n in ns)
SPORTS = " ".join(f"WHEN video_id < {high} THEN '{name}'" for name, _, high in S.sports_ranges())


@query(f"""WITH k(class, number) AS (VALUES {TRAINING}), n AS (SELECT class, CAST(unnest(range(1, CASE WHEN class = 'negative' THEN 101 ELSE 51 END)) AS INTEGER) AS number FROM (SELECT DISTINCT class FROM k))
SELECT class, number, class || '_' || lpad(CAST(number AS VARCHAR), 4, '0') AS name, NOT EXISTS (SELECT 1 FROM k WHERE k.class = n.class AND k.number = n.number) AS is_test FROM n""")
def interaction_split(spark, sf):
    return S.dataset("interactions")(spark)


@query(f"SELECT CAST(video_id AS BIGINT) AS video_id, CASE {SPORTS} END AS class, video_id + 1 IN ({', '.join(map(str, S.SPORTS_TEST))}) AS is_test FROM range(150) AS r(video_id)")
def sports_split(spark, sf):
    return S.dataset("sports")(spark)


SCORED = "t AS (SELECT doc_id, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS y, CAST(n_chars AS DOUBLE) AS score, CASE WHEN n_chars > 1500 THEN 1 ELSE -1 END AS pred, lang FROM labels JOIN documents USING (doc_id))"


def _scored(spark, sf):
    rows = S.table(spark, sf, "labels").join(S.table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    sign = lambda c: F.when(c, 1).otherwise(-1)
    return rows.select("doc_id", "lang", sign(F.col("quality") == 1).alias("y"), F.col("n_chars").cast("double").alias("score"), sign(F.col("n_chars") > 1500).alias("pred"))


@query(f"WITH {SCORED} SELECT lang, round((avg(CAST(pred = 1 AS INTEGER)) FILTER (WHERE y = 1) + avg(CAST(pred = -1 AS INTEGER)) FILTER (WHERE y = -1)) / 2, 6) AS acc FROM t GROUP BY 1")
def balanced_accuracy(spark, sf):
    return L.balanced_accuracy(_scored(spark, sf), "lang").withColumn("acc", F.round("acc", 6))


@query(f"WITH {SCORED}, r AS (SELECT lang, CAST(y > 0 AS INTEGER) AS y, count(*) OVER w AS rank, sum(CAST(y > 0 AS INTEGER)) OVER w AS hits FROM t WINDOW w AS (PARTITION BY lang ORDER BY score DESC)) SELECT lang, round(sum(y * hits / rank) / sum(y), 6) AS ap FROM r GROUP BY 1")
def average_precision(spark, sf):
    rows = _scored(spark, sf).withColumn("y", (F.col("y") > 0).cast("int"))
    return L.average_precision(rows, "lang").withColumn("ap", F.round("ap", 6))


@query(f"WITH {SCORED} SELECT lang, doc_id % 4 AS fold, count(*) AS n, CAST(sum(CAST(pred = y AS INTEGER)) AS BIGINT) AS correct FROM t GROUP BY ROLLUP (doc_id % 4, lang)")
def report_rollup(spark, sf):
    rows = _scored(spark, sf).withColumn("fold", F.col("doc_id") % 4)
    return rows.rollup("fold", "lang").agg(F.count("*").alias("n"), F.sum((F.col("pred") == F.col("y")).cast("long")).alias("correct")).select("lang", "fold", "n", "correct")


@query("SELECT user_id AS video_id, CAST(event_id % 3 AS BIGINT) AS class_id, CASE WHEN sum(CASE WHEN value > 50 THEN 1 ELSE -1 END) > 0 THEN 1 ELSE -1 END AS vote FROM events GROUP BY ALL")
def majority_vote(spark, sf):
    rows = S.table(spark, sf, "events").select(F.col("user_id").alias("video_id"), (F.col("event_id") % 3).alias("class_id"), F.when(F.col("value") > 50, 1).otherwise(-1).alias("pred"))
    return L.majority(rows)


# --- trees and words -----------------------------------------------------------------------------


@query(f"WITH {BAGS} SELECT video_id, vec_id, unnest([leaf, leaf // 2, leaf // 4, leaf // 8]) AS node_id FROM d")
def tree_ancestors(spark, sf):
    return T.ancestor_pairs(S.descriptors(spark, sf)).select("video_id", "vec_id", "node_id")


@query(f"""WITH {BAGS}, l AS (SELECT DISTINCT video_id, leaf FROM d), a AS (SELECT DISTINCT video_id, unnest([leaf, leaf // 2, leaf // 4, leaf // 8]) AS node FROM l)
SELECT x.video_id, x.node AS node_id, y.node AS descendant FROM a x JOIN a y ON x.video_id = y.video_id AND y.node > x.node AND (y.node // 2 = x.node OR y.node // 4 = x.node OR y.node // 8 = x.node) UNION ALL SELECT video_id, leaf, leaf FROM l""")
def tree_descendants(spark, sf):
    return T.expand(S.descriptors(spark, sf))


@query(f"WITH {BAGS}, {WORDS} SELECT vec_id, word_id FROM m")
def nearest_codeword(spark, sf):
    return _assigned(spark, sf).select("vec_id", "word_id")


@query(f"WITH {BAGS}, {WORDS} SELECT v.video_id, CAST(w.word_id AS BIGINT) AS word_id, count(m.vec_id) AS n FROM (SELECT DISTINCT video_id FROM d) v CROSS JOIN (SELECT unnest(range(16)) AS word_id) w LEFT JOIN m ON m.video_id = v.video_id AND m.word_id = w.word_id GROUP BY ALL")
def bovw_histogram(spark, sf):
    return T.dense_histogram(T.bovw(_assigned(spark, sf)), 16)


@query(f"WITH {BAGS}, {WORDS}, {NODES} SELECT video_id, node_id, word_id, n FROM n")
def bovw_tree(spark, sf):
    return T.bovw_tree(_assigned(spark, sf))


@query(f"WITH {BAGS}, {WORDS}, {NODES}, {EDGES} SELECT video_id, node_id, word_id, round(x, 6) AS x FROM e")
def edge_vectors(spark, sf):
    return _edges(spark, sf).withColumn("x", F.round("x", 6))


@query(f"WITH {BAGS} SELECT video_id, node_id, dim, round(avg(x), 6) + 0.0 AS x FROM (SELECT video_id, dim, x, unnest([leaf, leaf // 2, leaf // 4, leaf // 8]) AS node_id FROM c) GROUP BY ALL")
def node_means(spark, sf):
    return T.mean_vectors(S.descriptors(spark, sf)).withColumn("x", _r(F.col("x")))


POWER = """b AS (SELECT video_id, node_id, word_id, n FROM n WHERE node_id > 1
  UNION ALL SELECT k.video_id, k.node_id, -1 - p.word_id, p.n FROM (SELECT DISTINCT video_id, node_id FROM n WHERE node_id > 1) k
  JOIN n p ON p.video_id = k.video_id AND p.node_id = k.node_id // 2)"""


@query(f"WITH {BAGS}, {WORDS}, {NODES}, {POWER} SELECT video_id, node_id, word_id, round(sqrt(n) / sqrt(sum(n) OVER (PARTITION BY video_id, node_id)), 6) AS x FROM b")
def power_l2_edges(spark, sf):
    """Edge vectors after signed square roots, of unit length."""
    return T.edges(T.bovw_tree(_assigned(spark, sf)), "l2", True).withColumn("x", F.round("x", 6))


# --- kernels -------------------------------------------------------------------------------------

ROOTS = "o AS (SELECT video_id, dim, avg(x) AS x FROM c GROUP BY ALL)"
MET = "FROM o a JOIN o b ON a.dim = b.dim AND a.video_id <= b.video_id GROUP BY ALL"


@query(f"WITH {BAGS}, {ROOTS} SELECT a.video_id AS i, b.video_id AS j, round(sum(a.x * b.x), 6) + 0.0 AS k {MET}")
def kernel_linear(spark, sf):
    return K.kernel(_roots(spark, sf), V.dot).withColumn("k", _r(F.col("k")))


@query(f"WITH {BAGS}, {ROOTS}, f AS (SELECT * FROM (VALUES ('all', 0, 64), ('none', 64, 64)) AS f(feat, low, high)), q AS (SELECT feat, a.video_id AS i, b.video_id AS j, sum(CASE WHEN a.dim >= low AND a.dim < high THEN a.x * b.x ELSE 0 END) AS k FROM f, o a JOIN o b ON a.dim = b.dim AND a.video_id <= b.video_id GROUP BY ALL) SELECT feat, i, j, round(k, 6) + 0.0 AS k FROM q WHERE feat IN (SELECT feat FROM q GROUP BY feat HAVING max(abs(k)) > 0)")
def nonzero_kernels(spark, sf):
    """Kernels of an empty channel are left out."""
    every = K.kernel(_roots(spark, sf), V.dot)
    both = every.withColumn("feat", F.lit("all")).unionByName(every.select("i", "j", F.lit(0.0).alias("k"), F.lit("none").alias("feat")))
    return K.nonzero(both, "feat").select("feat", "i", "j", _r(F.col("k")).alias("k"))


@query(f"WITH {BAGS}, {ROOTS} SELECT a.video_id AS i, b.video_id AS j, round(sum(least(abs(a.x), abs(b.x))), 6) AS k {MET}")
def kernel_intersection(spark, sf):
    return K.kernel(_roots(spark, sf), V.intersection).withColumn("k", _r(F.col("k")))


@query(f"WITH {BAGS}, {ROOTS} SELECT a.video_id AS i, b.video_id AS j, round(sum(pow(abs(a.x) - abs(b.x), 2) / CASE WHEN abs(a.x) + abs(b.x) < 1e-7 THEN 1 ELSE abs(a.x) + abs(b.x) END), 6) AS k {MET}")
def kernel_chi2(spark, sf):
    return K.kernel(_roots(spark, sf), V.chi_square).withColumn("k", _r(F.col("k")))


LINEAR = f"{ROOTS}, q AS (SELECT a.video_id AS i, b.video_id AS j, sum(a.x * b.x) AS k {MET})"


@query(f"WITH {BAGS}, {LINEAR} SELECT i, j, round(sign(k) * sqrt(abs(k)), 6) + 0.0 AS k FROM q UNION ALL SELECT j, i, round(sign(k) * sqrt(abs(k)), 6) + 0.0 FROM q WHERE i < j")
def signed_sqrt_kernel(spark, sf):
    return K.mirror(K.kernel(_roots(spark, sf), V.dot).withColumn("k", _r(V.signed_sqrt(F.col("k")))))


@query(f"WITH {BAGS}, {LINEAR} SELECT i, j, round(k / (SELECT quantile_cont(k, 0.5) FROM q WHERE k <> 0), 5) + 0.0 AS k FROM q")
def median_normalized_kernel(spark, sf):
    return K.median_normalised(K.kernel(_roots(spark, sf), V.dot)).withColumn("k", _r(F.col("k"), 5))


INTER = """i AS (SELECT x.i, x.j, coalesce(s, 0.0) / (x.ei * x.ej) AS k FROM (SELECT a.video_id AS i, b.video_id AS j, a.e AS ei, b.e AS ej FROM ne a JOIN ne b ON a.video_id <= b.video_id) x LEFT JOIN (
  SELECT a.video_id AS i, b.video_id AS j, sum(least(a.x, b.x)) AS s FROM e a JOIN e b ON a.word_id = b.word_id AND a.video_id <= b.video_id GROUP BY ALL) y ON x.i = y.i AND x.j = y.j)"""
FACTORED = """u AS (SELECT e.video_id, e.word_id, sum(e.x) / any_value(ne.e) AS x FROM e JOIN ne ON e.video_id = ne.video_id GROUP BY ALL),
f AS (SELECT x.i, x.j, coalesce(s, 0.0) AS k FROM (SELECT a.video_id AS i, b.video_id AS j FROM ne a JOIN ne b ON a.video_id <= b.video_id) x LEFT JOIN (
  SELECT a.video_id AS i, b.video_id AS j, sum(a.x * b.x) AS s FROM u a JOIN u b ON a.word_id = b.word_id AND a.video_id <= b.video_id GROUP BY ALL) y ON x.i = y.i AND x.j = y.j)"""


@query(f"WITH {BAGS}, {WORDS}, {NODES}, {EDGES}, {INTER} SELECT i, j, round(k, 6) AS k FROM i")
def atep_intersection(spark, sf):
    """Flagship: words, tree histograms, edges, and the intersection kernel over edge pairs."""
    return K.sparse_intersection(_edges(spark, sf)).withColumn("k", F.round("k", 6))


CHI = """x AS (SELECT x.i, x.j, 2.0 - coalesce(s, 0.0) / (x.ei * x.ej) AS k FROM (SELECT a.video_id AS i, b.video_id AS j, a.e AS ei, b.e AS ej FROM ne a JOIN ne b ON a.video_id <= b.video_id) x LEFT JOIN (
  SELECT a.video_id AS i, b.video_id AS j, sum(4 * a.x * b.x / (a.x + b.x)) AS s FROM e a JOIN e b ON a.word_id = b.word_id AND a.video_id <= b.video_id GROUP BY ALL) y ON x.i = y.i AND x.j = y.j)"""


@query(f"WITH {BAGS}, {WORDS}, {NODES}, {EDGES}, {CHI} SELECT i, j, round(k, 6) AS k FROM x")
def atep_chi_square(spark, sf):
    return K.edge_kernel(T.bovw_tree(_assigned(spark, sf)), "chi2").withColumn("k", F.round("k", 6))


@query(f"WITH {BAGS}, {WORDS}, {NODES}, {EDGES}, {FACTORED} SELECT i, j, round(k, 6) AS k FROM f")
def atep_linear_factored(spark, sf):
    return K.factored_linear(_edges(spark, sf)).withColumn("k", F.round("k", 6))


@query(f"WITH {BAGS}, {WORDS}, {NODES}, {EDGES}, {INTER}, {FACTORED} SELECT i.i, i.j, round(0.25 * i.k + 0.75 * f.k + 1e-9, 6) AS k FROM i JOIN f ON i.i = f.i AND i.j = f.j")
def kernel_fusion_weighted(spark, sf):
    edges = _edges(spark, sf)
    return K.fuse([(0.25, K.sparse_intersection(edges)), (0.75, K.factored_linear(edges))]).withColumn("k", F.round(F.col("k") + 1e-9, 6))


@query(f"WITH {BAGS}, {WORDS}, {NODES}, {EDGES}, {INTER}, {LINEAR} SELECT q.i, q.j, round(CASE WHEN (SELECT sum(k) FROM q) > 0 THEN q.k ELSE i.k END, 6) + 0.0 AS k FROM q JOIN i ON i.i = q.i AND i.j = q.j")
def root_substitution(spark, sf):
    root = K.kernel(_roots(spark, sf), V.dot)
    return K.root_or_nodes(root, K.sparse_intersection(_edges(spark, sf))).withColumn("k", _r(F.col("k")))


SAMPLED = """g AS (SELECT label, vec_id, CAST(floor((v[2] + 1) / 2 * 3) * 3 + floor((v[1] + 1) / 2 * 3) AS BIGINT) AS cell FROM d WHERE (v[1] + 1) / 2 >= 0 AND (v[1] + 1) / 2 < 1 AND (v[2] + 1) / 2 >= 0 AND (v[2] + 1) / 2 < 1),
k AS (SELECT *, count(*) OVER (PARTITION BY label, cell) AS n, row_number() OVER (PARTITION BY label, cell ORDER BY md5('9:' || vec_id), vec_id) AS k FROM g),
s AS (SELECT *, sum(CAST(k <= ceil(n * 0.01::DOUBLE / 9) AS INTEGER)) OVER (PARTITION BY label) AS s1, sum(CAST(k <= ceil(n * 0.1::DOUBLE / 9) AS INTEGER)) OVER (PARTITION BY label) AS s2 FROM k),
u AS (SELECT label, vec_id, CASE WHEN s1 > 2 THEN k <= ceil(n * 0.01::DOUBLE / 9) WHEN s2 > 2 THEN k <= ceil(n * 0.1::DOUBLE / 9) ELSE k <= ceil(n * 1.0::DOUBLE / 9) END AS in_sample FROM s)"""


def _sampled(spark, sf):
    """Descriptors of each class with their place in the unit square and the stratified sample marked."""
    unit = lambda k: (F.get("v", F.lit(k)) + 1) / 2
    rows = S.descriptors(spark, sf).withColumns({"x": unit(0), "y": unit(1)})
    return R.grid_sample(rows, "label", "vec_id", 0.01, 3, "9")


@query(f"""WITH {BAGS}, {SAMPLED}, q AS (SELECT x.label, c.vec_id, c.dim, c.x, x.in_sample FROM u x JOIN c USING (vec_id)),
z AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, CAST(a.dim >= 32 AS INTEGER) AS ch, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS dist FROM q a JOIN q b ON a.label = b.label AND a.dim = b.dim WHERE a.in_sample GROUP BY a.label, a.vec_id, b.vec_id, a.dim >= 32),
w AS (SELECT label, ch, quantile_cont(dist, 0.5) FILTER (WHERE dist > 0) AS med FROM z GROUP BY ALL) SELECT i, j, round(exp(sum(-dist * dist / (2 * med))), 6) AS k FROM z JOIN w USING (label, ch) GROUP BY ALL""")
def multimodal_product_kernel(spark, sf):
    """Similarity of each class's sampled rows to all its rows: a product of one RBF for each channel."""
    parts = F.array(*[F.struct(F.lit(n).alias("ch"), F.slice("v", 32 * n + 1, 32).alias("p")) for n in (0, 1)])
    d = _sampled(spark, sf).select("label", "vec_id", "in_sample", F.explode(parts).alias("c")).select("label", "vec_id", "in_sample", "c.ch", "c.p")
    a = d.filter("in_sample").select("label", "ch", F.col("vec_id").alias("i"), F.col("p").alias("a"))
    b = d.select("label", "ch", F.col("vec_id").alias("j"), F.col("p").alias("b"))
    rows = b.join(a, ["label", "ch"]).select("label", "ch", "i", "j", F.sqrt(V.squared_distance(F.col("a"), F.col("b"))).alias("d"))
    med = rows.filter("d > 0").groupBy("label", "ch").agg(F.percentile("d", F.lit(0.5)).alias("med"))
    return rows.join(med, ["label", "ch"]).groupBy("i", "j").agg(F.round(F.exp(F.sum(F.log(V.rbf(F.col("d"), F.col("med"))))), 6).alias("k"))


def _fixed_gmm(spark, sf):
    return S.codebook(spark, sf, 4).select(F.col("word_id").cast("int").alias("k"), F.lit(0.25).alias("w"), F.col("c").alias("mu"), F.transform("c", lambda x: F.lit(0.1)).alias("var"))


@query(f"""WITH {BAGS}, g AS (SELECT CAST(vec_id AS INTEGER) AS k, unnest(CAST(embedding AS DOUBLE[])) AS m, unnest(range(64)) AS dim FROM embeddings WHERE vec_id < 4),
l AS (SELECT vec_id, k, -0.5 * sum((x - m) * (x - m)) / 0.1 AS lp FROM c JOIN g USING (dim) GROUP BY ALL), q AS (SELECT vec_id, k, exp(lp - max(lp) OVER w) / sum(exp(lp)) OVER w * exp(max(lp) OVER w) AS q FROM l WINDOW w AS (PARTITION BY vec_id)),
s AS (SELECT video_id, node_id, k, dim, sum(q) AS s0, sum(q * x) AS s1, sum(q * x * x) AS s2, count(*) AS n FROM (SELECT vec_id, video_id, dim, x, unnest([leaf, leaf // 2, leaf // 4, leaf // 8]) AS node_id FROM c) JOIN q USING (vec_id) GROUP BY ALL)
SELECT video_id, node_id, k, CAST(dim AS INTEGER) AS dim, round((s1 - m * s0) / (n * 0.5 * sqrt(0.1)), 5) + 0.0 AS mu_part, round((s2 - 2 * m * s1 + (m * m - 0.1) * s0) / (n * sqrt(0.5) * 0.1), 5) + 0.0 AS var_part FROM s JOIN g USING (k, dim)""")
def fisher_fixed_gmm(spark, sf):
    f = L.fisher(S.descriptors(spark, sf), _fixed_gmm(spark, sf))
    return f.select("video_id", "node_id", "k", "dim", _r(F.col("mu_part"), 5).alias("mu_part"), _r(F.col("var_part"), 5).alias("var_part"))


#: The machines' C, and the shares of the root kernel.
CS = [1e-4, 1e-3, 1e-2, 1e-1, 1.0]
ALPHAS = [k / 20 for k in range(21)]


# --- solvers: rows only ----------------------------------------------------------------------------


@query()
def kmeans_codebook(spark, sf):
    return L.kmeans_codebook(S.descriptors(spark, sf), 8, 20)


@query()
def pca_half(spark, sf):
    return L.pca_half(S.descriptors(spark, sf))


@query()
def diagonal_gmm(spark, sf):
    return L.diagonal_gmm(S.descriptors(spark, sf), S.codebook(spark, sf, 4))


@query()
def video_darwin(spark, sf):
    return L.video_darwin(S.descriptors(spark, sf), "video_id", "t")


def _node_vectors(spark, sf):
    means = T.mean_vectors(S.descriptors(spark, sf))
    return means.groupBy("video_id", "node_id").agg(F.sort_array(F.collect_list(F.struct("dim", "x")))["x"].alias("v"))


@query()
def branch_evolution(spark, sf):
    return L.branch_evolutions(_node_vectors(spark, sf))


@query()
def atnbep_kernel(spark, sf):
    return L.atnbep_kernel(L.branch_evolutions(_node_vectors(spark, sf)))


@query()
def spectral_tree(spark, sf):
    return L.spectral_trees(_sampled(spark, sf), "label", "vec_id", ["x", "y", "t"], "t", [(0, 32), (32, 64)])


@query()
def kmeans_tree(spark, sf):
    """The tree whose clusters are split by two-means, with outliers under leaf 0."""
    return L.spectral_trees(_sampled(spark, sf), "label", "vec_id", ["x", "y", "t"], "t", [(0, 32), (32, 64)], "kmeans")


@query()
def fisher_video_darwin(spark, sf):
    """Fisher vectors of each tree node's frames, in order, rank-pooled."""
    frames = S.descriptors(spark, sf).withColumn("frame", F.floor((F.col("t") - 1) / 4))
    return L.fisher_darwin(frames, _fixed_gmm(spark, sf), "frame")


@query()
def svm_kernel_cv(spark, sf):
    k = K.mirror(K.sparse_intersection(_edges(spark, sf)))
    return L.svm_scores(k, _labels(spark, sf), [0.01, 1.0])


@query()
def svm_grid_search(spark, sf):
    """Cross-validated balanced accuracy of each C, and the best C of each class."""
    k = K.mirror(K.sparse_intersection(_edges(spark, sf)))
    scores = L.svm_scores(k, _labels(spark, sf), CS)
    fold = L.balanced_accuracy(scores.withColumn("pred", F.when(F.col("decision") > 0, 1).otherwise(-1)), "class_id", "c", "fold")
    return R.argmax(fold.groupBy("class_id", "c").agg(F.avg("acc").alias("acc")), "class_id", "acc", "c")


@query(f"WITH {BAGS}, {ROOTS} SELECT a.video_id AS i, b.video_id AS j, round(sum(a.x * b.x), 6) + 0.0 AS k FROM o a JOIN o b ON a.dim = b.dim AND a.video_id % 5 = 0 AND b.video_id % 5 <> 0 GROUP BY ALL")
def kernel_test_train(spark, sf):
    rows = _roots(spark, sf)
    return K.kernel(rows.filter("video_id % 5 = 0"), V.dot, rows.filter("video_id % 5 <> 0")).withColumn("k", _r(F.col("k")))


def _marked(spark, sf):
    return _labels(spark, sf).withColumn("is_test", F.col("video_id") % 5 == 0)


def _methods(spark, sf):
    """Root and node kernels of two methods: edge pairs, and branch evolutions in two channels."""
    edges = _edges(spark, sf)
    roots = K.mirror(K.kernel(_roots(spark, sf), V.dot))
    branches = L.atnbep_kernel(L.branch_evolutions(_node_vectors(spark, sf)))
    channel = lambda n: K.mirror(branches.filter(F.col("channel") == n).select("i", "j", "k"))
    return {"root": K.mirror(K.factored_linear(edges)), "n0": K.mirror(K.sparse_intersection(edges))}, {"root": roots, "n0": channel(0), "n1": channel(1)}


@query()
def fusion_grid_search(spark, sf):
    """One method: grid over the root's share and C, cross-validation, test metrics of the best."""
    edge_pairs, _ = _methods(spark, sf)
    return L.fusion_search([[edge_pairs]], _marked(spark, sf), [L.Mixture(a) for a in ALPHAS], CS)


@query()
def fusion_two_methods(spark, sf):
    """Two methods: grid over their weights, with node channels mixed evenly."""
    grid = [L.Mixture(a, (w / 10, 1 - w / 10), (1.0, 0.5)) for w in range(11) for a in (0.0, 0.5, 1.0)]
    return L.classify("kernel_fusion", [list(_methods(spark, sf))], _marked(spark, sf), grid, CS, criterion="map")


@query()
def simple_voting(spark, sf):
    """Majority of the machines of two kernels."""
    edge_pairs, evolutions = _methods(spark, sf)
    return L.classify("simple_voting", [L.svm_scores(k, _labels(spark, sf), [1.0]) for k in (edge_pairs["n0"], evolutions["n0"])])


@query()
def fusion_report(spark, sf):
    """Accuracy and average precision by class, and their means over all classes."""
    best = fusion_grid_search(spark, sf)
    return best.rollup("class_id").agg(F.avg("acc").alias("acc"), F.avg("ap").alias("ap"))


def _bags(spark, sf):
    counts = T.dense_histogram(T.bovw(_assigned(spark, sf)), 16)
    bags = counts.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("word_id", F.col("n").cast("double").alias("n"))))["n"].alias("v"))
    return bags.select("video_id", V.l2(F.col("v")).alias("v"))


@query()
def flat_bovw_svm(spark, sf):
    """The flat baseline: L2-normalised whole-bag histograms under a linear kernel SVM."""
    return L.svm_scores(K.mirror(K.kernel(_bags(spark, sf), V.dot)), _labels(spark, sf), [1.0])


@query()
def flat_bovw_search(spark, sf):
    """The flat baseline under an RBF machine, best C and gamma by cross-validation."""
    return L.flat_search(_bags(spark, sf), _labels(spark, sf), CS, [0.1, 1.0, 10.0])


@query()
def stacked_fusion(spark, sf):
    """Second-level SVM over the decision values of two kernels."""
    edges = _edges(spark, sf)
    first = [L.svm_scores(K.mirror(k), _labels(spark, sf), [1.0]) for k in (K.factored_linear(edges), K.sparse_intersection(edges))]
    return L.stacked_scores(first, _labels(spark, sf))
