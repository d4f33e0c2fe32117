"""Conflict-constrained best-fit packing of documents into fixed-size sequences.

Bins are ordered by residual room and carry bitmaps of their sources and
duplicate clusters. A piece goes to the tightest bin that has room and shares
neither its source nor its cluster: a successor search walks up the residuals
until a compatible bin turns up, and else a bin is opened. Pieces are dealt by
hash into shards of bounded size that pack on their own, so only lengths move.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .spool import spool
from .text import as_bytes, slices

CAPACITY = 2048
#: Pieces of a shard on average; a shard is one group in memory (about 100 bytes a piece).
SHARD = 8192


def best_fit(lengths, sources, clusters, capacity: int = CAPACITY) -> np.ndarray:
    """Bin number of each piece; pieces come longest first, equal lengths in the order given.

    Among the tightest compatible bins the oldest wins. A null source or
    cluster conflicts with nothing.
    """
    def bits(values):
        known: dict = {}
        return [0 if v is None or v != v else 1 << known.setdefault(v, len(known)) for v in values]

    shared = pd.Series(clusters).duplicated(keep=False) if len(lengths) else []
    source_bits = bits(sources)
    cluster_bits = bits([c if s else None for c, s in zip(clusters, shared, strict=True)])
    levels: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
    used, held, out = 0, [], np.zeros(len(lengths), np.int64)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        need, source, cluster = int(lengths[k]), source_bits[k], cluster_bits[k]
        room, best = need, -1
        while rest := used >> room:
            room += (rest & -rest).bit_length() - 1
            for mask, bins in levels[room].items():
                if not mask & source:
                    found = next((b for b in bins if not held[b] & cluster), -1)
                    if found >= 0 and (best < 0 or found < best):
                        best, from_mask = found, mask
            if best >= 0:
                break
            room += 1
        if best >= 0:
            level = levels[room]
            level[from_mask].remove(best)
            if not level[from_mask]:
                del level[from_mask]
                if not level:
                    used &= ~(1 << room)
            held[best] |= cluster
        else:
            best, room, from_mask = len(held), capacity, 0
            held.append(cluster)
        out[k] = best
        left = room - need
        if left:
            bins = levels[left].setdefault(from_mask | source, [])
            bins.append(best)
            used |= 1 << left
    return out


def lengths(docs: DataFrame, near: bool = False) -> DataFrame:
    """(place, doc_id, source, n_words, cluster) of every row, written once: places stay what they are.

    The cluster is a hash of the lower-cased words or, where ``near`` is set,
    the SimHash class, which holds all copies of a text and its near copies.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("place"), "doc_id", F.col("source").cast("string").alias("source"), as_bytes().alias("raw"))

    def run(batches):
        for batch in slices(batches):
            counts, clusters = [], []
            for raw in batch.column(3):
                raw = raw.as_py() or b""
                words = raw.lower().split()
                counts.append(len(words))
                own = simhash.fingerprint(raw) if near else xxhash.xxh64_intdigest(b" ".join(words))
                clusters.append(own - (1 << 64) if own >> 63 else own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(clusters, pa.int64())], names=["place", "doc_id", "source", "n_words", "cluster"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = spool(rows.mapInArrow(run, f"place long, doc_id {kind}, source string, n_words long, cluster long"), "lengths")
    if not near:
        return found
    roots = simhash.classes(found.select(F.col("cluster").alias("fp")))
    joined = found.join(roots, found.cluster == roots.fp).select("place", "doc_id", "source", "n_words", F.col("root").alias("cluster"))
    return spool(joined, "clusters")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, near: bool = False) -> DataFrame:
    """(doc_id, piece, n_words, bin_id, start): where each piece of each document goes.

    A document of more than ``capacity`` words is cut into pieces; every word is
    placed once. Bins hold at most ``capacity`` words, and no two pieces of one
    source or one duplicate cluster: exact copies or, where ``near`` is set,
    near-duplicate classes under SimHash. Null, empty and blank texts give one piece
    of no words with null bin and start. Repeated rows are duplicates of each
    other and never share a bin. Other columns are ignored.
    """
    rows = lengths(docs, near)
    pieces = rows.filter("n_words > 0").select(
        "place", "doc_id", "source", "cluster", "n_words",
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_words - 1) div {capacity}"))).alias("piece"),
    ).withColumn("n_words", F.least(F.lit(capacity), F.col("n_words") - F.col("piece") * capacity))
    total = rows.agg(F.sum(F.expr(f"(n_words + {capacity - 1}) div {capacity}"))).head()[0] or 0
    shards = max(1, -(-total // shard))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_words", "place", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins = best_fit(group.n_words.tolist(), group.source.tolist(), group.cluster.tolist(), capacity)
        start = group.n_words.groupby(bins).cumsum() - group.n_words
        return pd.DataFrame({"doc_id": group.doc_id, "piece": group.piece, "n_words": group.n_words, "bin_id": int(key[0]) << 32 | bins, "start": start})

    packed = (
        pieces.withColumn("shard", F.pmod(F.xxhash64("place", "piece"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(run, f"doc_id {kind}, piece long, n_words long, bin_id long, start long")
    )
    empty = rows.filter("n_words = 0").select("doc_id", F.lit(0).cast("long").alias("piece"), "n_words", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("start"))
    return packed.union(empty)


def bins(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row per bin: (bin_id, n_words, doc_ids, pieces, starts), the lists in order of start. Empty texts are in no bin."""
    placed = pack(docs, capacity, shard).filter("bin_id is not null")
    items = F.sort_array(F.collect_list(F.struct("start", "doc_id", "piece")))
    out = placed.groupBy("bin_id").agg(F.sum("n_words").alias("n_words"), items.alias("items"))
    return out.select("bin_id", "n_words", F.col("items.doc_id").alias("doc_ids"), F.col("items.piece").alias("pieces"), F.col("items.start").alias("starts"))
