"""Tables written to the folder that the cluster shares, to cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes that go to a Python worker at once while a table is written; texts are long, and memory is shared with the JVM.
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and all runs in one process (tests), a temporary one.

    On a cluster an unset folder is an error: other machines do not see a local one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_dir()


_OWN: list[str] = []
#: What this session has spooled and not deleted.
_WRITTEN: set[str] = set()


def _own_dir() -> str:
    if not _OWN:
        folder = tempfile.TemporaryDirectory(prefix="silvan-")
        atexit.register(folder.cleanup)
        _OWN.append(folder.name)
    return _OWN[0]


def spool(df: DataFrame, name: str, **settings: str) -> DataFrame:
    """``df``, written as Parquet into the shared folder and reread. Its path is in ``spooled_at``.

    ``settings`` of the session (dots as double underscores, after spark.sql) hold while it is written.

    The rows are fixed from then on: whatever was numbered before (places, ranks)
    stays so in every later job, however the input would be split by then.
    """
    conf = df.sparkSession.conf
    path = f"{shared_dir(df.sparkSession)}/silvan-{name}-{uuid.uuid4().hex}"
    held = {_BATCH: _BATCH_BYTES, **{"spark.sql." + k.replace("__", "."): v for k, v in settings.items()}}
    before = {k: conf.get(k) for k in held}
    try:
        for k, v in held.items():
            conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            conf.set(k, v)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.spooled_at = path
    _WRITTEN.add(path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete spooled tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.spooled_at)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this session has spooled, once the results that read them are saved."""
    for path in list(_WRITTEN):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _WRITTEN.discard(path)
