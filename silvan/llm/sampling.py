"""A bounded sample of each class of a labelled table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SLOTS = 1 << 30


def bounded_sample(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """At most ``n`` rows of each value of ``by``, chosen by the hash of ``key``; all where there are no more.

    A hash threshold that leaves about 2n rows of a class comes before the
    ranking, so a class of any size sends a bounded number of rows to one task.
    """
    # one row for each class that a model tells apart: a bounded side; the rows are thinned where they are
    sizes = F.broadcast(rows.groupBy(by).agg(F.count("*").alias("_size")))
    slot = F.pmod(F.xxhash64(key), F.lit(_SLOTS))
    few = rows.join(sizes, by).filter(slot.cast("double") * F.col("_size") < 2.0 * n * _SLOTS)
    order = Window.partitionBy(by).orderBy(slot, key)
    return few.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).select(*rows.columns)
