"""Sources: the driver tables seen as descriptor, label and event relations, and readers for raw inputs."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Channel layout of a raw row for a track length: name and half-open offsets.
TRACK_LENGTH = 15


def channels(track_length: int = TRACK_LENGTH) -> dict[str, tuple[int, int]]:
    """Half-open offsets of each channel in a raw row."""
    sizes = {"obj": 10, "trj": 2 * track_length, "hog": 96, "hof": 108, "mbh": 192}
    out, at = {}, 0
    for name, size in sizes.items():
        out[name] = (at, at + size)
        at += size
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_tracklets(spark: SparkSession, path: str, track_length: int = TRACK_LENGTH) -> DataFrame:
    """(file, line, obj, trj, hog, hof, mbh) from tab-separated text; blank lines are dropped."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value"))
    parsed = lines.filter("value <> ''").withColumn("v", F.split("value", "\t").cast("array<float>"))
    return parsed.select("file", "line", *channel_slices(F.col("v"), track_length))


def channel_slices(v, track_length: int = TRACK_LENGTH):
    return [F.slice(v, low + 1, high - low).alias(name) for name, (low, high) in channels(track_length).items()]


def read_config(path: str) -> dict:
    """Settings of an XML file: paths and options by key, features as a list; ``num_threads`` as a number."""
    root = ET.parse(path).getroot()
    out: dict = {node.get("key"): (node.text or "").strip() for kind in ("path", "option") for node in root.iter(kind)}
    features = [(node.text or "").strip() for node in root.iter("item")]
    if features:
        out["features_list"] = features
    if "num_threads" in out:
        out["num_threads"] = int(out["num_threads"])
    return out


DATASETS: dict[str, Callable] = {}


def dataset(name: str):
    """The registered dataset reader; an unknown name is an error."""
    if name not in DATASETS:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(DATASETS)}")
    return DATASETS[name]


def register(name: str):
    return lambda f: DATASETS.setdefault(name, f)


# Training numbers of the interaction classes; the others of 1..50 are for
# testing. Negatives 1..50 train and 51..100 test.
INTERACTION_TRAINING = {
    "handShake": [2,14,15,16,18,19,20,21,24,25,26,27,28,32,40,41,42,43,44,45,46,47,48,49,50],
    "highFive": [1,6,7,8,9,10,11,12,13,23,24,25,27,28,29,30,31,32,33,34,35,44,45,47,48],
    "hug": [2,3,4,11,12,15,16,17,18,20,21,27,29,30,31,32,33,34,35,36,42,44,46,49,50],
    "kiss": [1,7,8,9,10,11,12,13,14,16,17,18,22,23,24,26,29,31,35,36,38,39,40,41,42],
    "negative": list(range(1, 51)),
}

# The sports classes with their sizes, and the test videos (from 1).
SPORTS_SIZES = {
    "Diving": 14, "Golf Swing": 18, "Kicking": 20, "Lifting": 6, "Riding Horse": 12,
    "Running": 13, "SkateBoarding": 12, "Swing-Bench": 20, "Swing-Side": 13, "Walking": 22,
}
SPORTS_TEST = [1,2,3,4,15,16,17,18,19,20,33,34,35,36,37,38,53,54,59,60,61,62,71,72,73,74,84,85,86,87,96,97,98,99,100,101,116,117,118,119,129,130,131,132,133,134,135]


@register("interactions")
def interactions(spark: SparkSession) -> DataFrame:
    """(class, number, name, is_test): the inline relation of four classes and the negatives."""
    known = spark.createDataFrame([(c, n) for c, ns in INTERACTION_TRAINING.items() for n in ns], "class string, number int")
    sizes = spark.createDataFrame([(c, 100 if c == "negative" else 50) for c in INTERACTION_TRAINING], "class string, n int")
    rows = sizes.select("class", F.explode(F.sequence(F.lit(1), "n")).alias("number"))
    marked = rows.join(F.broadcast(known.withColumn("train", F.lit(True))), ["class", "number"], "left")
    name = F.concat_ws("_", "class", F.lpad(F.col("number").cast("string"), 4, "0"))
    return marked.select("class", "number", name.alias("name"), F.col("train").isNull().alias("is_test"))


def sports_ranges() -> list[tuple[str, int, int]]:
    """(class, first video, video after the last) by running counts."""
    out, at = [], 0
    for name, size in sorted(SPORTS_SIZES.items()):
        out.append((name, at, at + size))
        at += size
    return out


@register("sports")
def sports(spark: SparkSession) -> DataFrame:
    """(video_id, class, is_test): sorted files fall into classes by running counts, a range join."""
    ranges = spark.createDataFrame(sports_ranges(), "class string, low int, high int")
    videos = spark.range(sum(SPORTS_SIZES.values())).withColumnRenamed("id", "video_id")
    inside = (F.col("video_id") >= F.col("low")) & (F.col("video_id") < F.col("high"))
    return videos.join(F.broadcast(ranges), inside).select("video_id", "class", F.expr("video_id + 1").isin(SPORTS_TEST).alias("is_test"))


@register("split_lists")
def split_lists(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, class) from text files that list names, a file per class."""
    return spark.read.text(path).select(
        F.input_file_name().alias("file"), F.regexp_replace(F.rtrim("value"), "_", " ").alias("name"),
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("class"),
    ).filter("name <> ''")


@register("indexed_split")
def indexed_split(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, class_id, y) from a table with 1-based ids."""
    return spark.read.parquet(path).withColumn("video_id", F.col("video_id") - 1)


def listing(spark: SparkSession, path: str, suffix: str = ".avi") -> DataFrame:
    """(video_id, name) of the files with a suffix, in order of their names; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    return numbered(files.filter(F.col("name").endswith(suffix)), "video_id", "name")


def sports_listing(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, name, class, is_test): the files of a folder with the classes and split of their places."""
    return listing(spark, path).join(sports(spark), "video_id").select("video_id", "name", "class", "is_test")


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` with their place in the order, from 0: a sort by range, and the counts of its parts (one row a task)."""
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = rows.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_k": within})
    at, offsets = 0, [(-1, 0)]
    for r in placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        offsets.append((r["_part"], at))
        at += r["n"]
    parts = rows.sparkSession.createDataFrame(offsets, "_part int, _at long")
    return placed.join(F.broadcast(parts), "_part").select((F.col("_at") + F.col("_k")).alias(name), *rows.columns)


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, vec_id, t, leaf, label, is_test, v) of ``embeddings`` rows as local descriptors."""
    rows = table(spark, sf_dir, "embeddings").select(
        (F.col("label") * 5 + F.col("vec_id") % 5).alias("video_id"), "vec_id", "label", F.col("embedding").cast("array<double>").alias("v")
    )
    t = F.row_number().over(Window.partitionBy("video_id").orderBy("vec_id"))
    return rows.withColumns({"t": t, "is_test": F.col("video_id") % 5 == 0}).withColumn("leaf", F.lit(8).cast("long") + (F.col("t") - 1) % 8)


def codebook(spark: SparkSession, sf_dir: str, words: int = 16) -> DataFrame:
    """(word_id, c): the first embeddings as fixed words."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") < words).select(F.col("vec_id").alias("word_id"), F.col("embedding").cast("array<double>").alias("c"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, event_id, frame, x, y) of ``events``: the hour as frame, value and props.k as place."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("video"), "event_id", "user_id", "ts",
        ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")).alias("frame"), F.col("value").alias("x"), k.alias("y"),
    )


def write_stage(df: DataFrame, path: str) -> None:
    """Stage table, laid out by fold and feature so that readers prune partitions."""
    df.write.partitionBy(*[c for c in ("fold_id", "feat") if c in df.columns]).parquet(path)


def remaining(todo: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What is still to do: rows of ``todo`` whose keys are not among the finished ones."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")
