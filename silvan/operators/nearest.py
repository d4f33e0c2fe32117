"""Exact k nearest rows inside blocks, with bounded memory and no table of pairs.

Queries and candidates are dealt to blocks (a group, a frame band). A block with
too many candidates is cut into parts by the hash of the key; every part of the
queries meets every part of the candidates in a task of its own, which keeps k
candidates a query, and the parts' lists are merged.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Candidates (and queries) that one task holds.
PART = 1 << 15
#: Distances that are held at a time.
CELLS = 1 << 22


def nearest_lists(
    queries: DataFrame, candidates: DataFrame, block: list[str], key: str, k: int, distances: Callable, part: int = PART
) -> DataFrame:
    """(*block, key, near): the k nearest other candidates of each query as sorted structs (d, other); ties by key.

    Both tables have the block columns, the long ``key`` and an array<double>
    ``p``. ``distances(a, b)`` gives the matrix between two stacks of rows, inf
    where a pair does not count. Queries without a candidate give no row. Null
    keys or block values are not allowed.
    """
    sizes = candidates.groupBy(*block).agg(F.count("*").alias("_n")).unionByName(queries.groupBy(*block).agg(F.count("*").alias("_n")))
    over = sizes.filter(F.col("_n") > part).groupBy(*block).agg(F.ceil(F.max("_n") / part).cast("int").alias("_parts"))
    hot = not over.isEmpty()

    def dealt(rows: DataFrame, role: int) -> DataFrame:
        rows = rows.select(*block, key, "p", F.lit(role).alias("_role"))
        if not hot:
            return rows.withColumns({"_own": F.lit(0), "_met": F.lit(0)})
        rows = rows.join(over, block, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        own = F.pmod(F.xxhash64(key), F.col("_parts")).cast("int")
        rows = rows.withColumns({"_a": own, "_b": F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))})
        query = F.lit(role == 0)
        return rows.withColumns({"_own": F.when(query, F.col("_a")).otherwise(F.col("_b")), "_met": F.when(query, F.col("_b")).otherwise(F.col("_a"))}).drop("_a", "_b", "_parts")

    both = dealt(queries, 0).unionByName(dealt(candidates, 1))
    kinds = ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in [*block, key])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        role, keys = table["_role"].to_numpy(), table[key].to_numpy()
        flat = table["p"].combine_chunks()
        points = flat.flatten().to_numpy().reshape(len(keys), -1) if len(keys) else np.zeros((0, 0))
        asks, has = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        has = has[np.argsort(keys[has], kind="stable")]
        rows, ds, others = [], [], []
        step = max(1, CELLS // max(1, len(has)))
        for at in range(0, len(asks), step):
            own = asks[at : at + step]
            d = distances(points[own], points[has])
            d[keys[own][:, None] == keys[has][None, :]] = np.inf
            last = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.full((len(own), 1), np.inf)
            row, column = np.nonzero((d <= last) & np.isfinite(d))
            value = d[row, column]
            order = np.lexsort((column, value, row))  # columns rise with the keys
            row, column, value = row[order], column[order], value[order]
            first = np.searchsorted(row, np.arange(len(own)))
            stay = np.arange(len(row)) - first[row] < k
            rows.append(own[row[stay]])
            ds.append(value[stay])
            others.append(keys[has[column[stay]]])
        row = np.concatenate([np.zeros(0, np.int64), *rows])
        found, start = np.unique(row, return_index=True)
        # rows of one query stand together, queries in rising order
        near = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0), *ds])), pa.array(np.concatenate([np.zeros(0, np.int64), *others]))], names=["d", "other"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)).astype(np.int32)), near)
        at = pa.array(found)
        return pa.table({**{c: table[c].take(at) for c in block}, key: table[key].take(at), "near": lists})

    near = both.groupBy(*block, "_own", "_met").applyInArrow(run, f"{kinds}, near array<struct<d:double,other:long>>")
    if not hot:
        return near
    merged = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k)
    return near.groupBy(*block, key).agg(merged.alias("near"))
