"""Links inside buckets of a key, with bounded memory and no list of all pairs.

Rows (key, item) are dealt out by key and sorted; a task walks its buckets and
emits, for each, a spanning forest of the links that a bucket function finds.
A bucket above ``block`` rows is never held whole: its blocks come back as rows
and a second round compares every block with every other, two at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spool import spool

#: Rows of a bucket that one task compares at a time.
BLOCK = 1 << 16


def walk(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple]:
    """Yields (key, columns, block number) over batches sorted by key; number -1: the whole bucket.

    The whole buckets inside one batch come together, with key None and the keys
    as the first column, so that small ones are compared at once.
    """
    key, held, blocks = None, [], 0
    join = lambda parts: [np.concatenate(x) for x in zip(*parts, strict=True)]
    size = lambda: sum(len(x[0]) for x in held)

    def ended():
        if held and (blocks or size() > 1):
            yield key, join(held), blocks if blocks else -1

    for batch in batches:
        keys, *columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(keys):
            continue
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        first = cuts[0] if len(cuts) else len(keys)
        if keys[0] != key:
            yield from ended()
            key, held, blocks = keys[0], [], 0
        held.append([c[:first] for c in columns])
        if len(cuts):
            yield from ended()
            last = cuts[-1]
            if last > first:
                yield None, [keys[first:last], *(c[first:last] for c in columns)], -1
            key, held, blocks = keys[last], [[c[last:] for c in columns]], 0
        while size() > block:
            whole = join(held)
            yield key, [c[:block] for c in whole], blocks
            held, blocks = [[c[block:] for c in whole]], blocks + 1
    yield from ended()


def _rows(a, b, key=None, block=None, extra=None, with_extra=False) -> pa.RecordBatch:
    n = len(a)
    fixed = lambda x, kind: pa.nulls(n, kind) if x is None else pa.array(np.full(n, x), kind)
    columns = {"a": pa.array(a, pa.int64()), "b": pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64()), "key": fixed(key, pa.int64()), "block": fixed(block, pa.int32())}
    if with_extra:
        columns["extra"] = pa.nulls(n, pa.binary()) if extra is None else pa.array(extra, pa.binary())
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def link_buckets(rows: DataFrame, many: Callable, one: Callable, block: int = BLOCK) -> DataFrame:
    """(a, b) links of items, a spanning forest of each bucket.

    ``rows`` has two long columns, key and item, and perhaps a binary one that
    goes with the item; repeats are allowed. ``many(keys, items, ...)`` returns
    link arrays for the buckets of one sorted stretch, ``one(items, ...)`` those
    of a single bucket.
    """
    extra = len(rows.columns) > 2
    names = ["key", "item", "extra"][: len(rows.columns)]

    def run(batches, limit):
        for key, data, number in walk(batches, limit):
            if key is None:
                a, b = many(*data)
            elif number < 0:
                a, b = one(*data)
            else:
                yield _rows(data[0], None, key, number, data[1] if extra else None, extra)
                continue
            if len(a):
                yield _rows(a, b, with_extra=extra)

    def dealt(df, limit):
        return df.repartition("key").sortWithinPartitions("key").mapInArrow(
            lambda batches: run(batches, limit), "a long, b long, key long, block int" + ", extra binary" * extra
        )

    rows = rows.toDF(*names)
    found = spool(dealt(rows, block), "links")
    links = found.filter("key is null").select("a", "b")
    over = found.filter("key is not null").withColumnRenamed("a", "item").select("block", *names)
    if over.isEmpty():
        return links
    last = over.groupBy("key").agg(F.max("block").alias("last"))
    pairs = (
        over.join(last, "key")
        .select("block", *names, F.explode(F.sequence(F.lit(0), "last")).alias("other"))
        .withColumn("key", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
        .select(*names)
    )
    return links.union(dealt(pairs, 1 << 62).select("a", "b"))


def _shared(batches):
    """Distinct (key, item) rows whose key has another item, over batches sorted by both."""
    names = ["key", "item"]
    keys, items, matched = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        items = np.concatenate([items, batch.column(1).to_numpy()])
        if not len(keys):
            continue
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (items[1:] != items[:-1])])
        keys, items = keys[new], items[new]
        same = keys[1:] == keys[:-1]
        hit = np.concatenate([[matched], same]) | np.concatenate([same, [False]])
        yield pa.RecordBatch.from_arrays([pa.array(keys[:-1][hit[:-1]]), pa.array(items[:-1][hit[:-1]])], names=names)
        keys, items, matched = keys[-1:], items[-1:], bool(hit[-1])
    if matched:
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(items)], names=names)


def shared_keys(rows: DataFrame) -> DataFrame:
    """Distinct (key, item) rows, both longs, whose key occurs with another item too.

    One shuffle; a task reads its buckets as a sorted stream and holds one batch.
    """
    return rows.repartition("key").sortWithinPartitions("key", "item").mapInArrow(_shared, "key long, item long")
