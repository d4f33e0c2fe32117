"""SimHash near-duplicates, found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits. Among any
three errors or fewer, at most one segment can hold two, so two segments hold
one error each at most. The (23,12) Golay code is perfect: every 23-bit word
decodes to one codeword. A word u one error from v decodes to the same index as
some neighbour of v, so D(u) lies in K(v) = {D(v), D(v with one bit flipped)},
which holds six indices at most. For each pair of segments the keys are
K(i) x D(j) and D(i) x K(j): two fingerprints with at most one error in either
segment share a key. Shared keys are then verified on all 64 bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import link_buckets
from .components import components
from .spool import spool
from .text import as_bytes, slices

MAX_BITS = 3
SHINGLE = 3
SEED = 42
#: Width and position of the segments.
SEGMENTS = ((22, 42), (21, 21), (21, 0))
#: Generator polynomial of the (23,12) binary Golay code (a fixed value).
GOLAY = 0b110001110101


def fingerprint(raw: bytes | None) -> int:
    """The unsigned fingerprint of one text; null, empty and blank texts give zero."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    n = len(words) - SHINGLE + 1
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + SHINGLE - 1]
        hashes = b"".join([digest(s, SEED) for s in map(b" ".join, zip(part, part[1:], part[2:], strict=False))])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _syndrome_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and high 11 bits of a word, and the error pattern of each remainder."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << bit - 11
        return word

    low = np.array([remainder(x) for x in range(1 << 12)], np.int64)
    high = np.array([remainder(x << 12) for x in range(1 << 11)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            errors[remainder(sum(1 << b for b in bits))] = sum(1 << b for b in bits)
    return low, high, errors


class Golay:
    """Decoder of 23-bit words to 12-bit codeword indices."""

    def __init__(self):
        self.low, self.high, self.errors = _syndrome_tables()

    def decode(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.errors[self.low[words & 0xFFF] ^ self.high[words >> 12]]) >> 11

    def near(self, words: np.ndarray, width: int) -> np.ndarray:
        """Indices of each word and its one-bit neighbours, a row each; -1 stands for repeats."""
        flips = np.concatenate([[0], 1 << np.arange(width)])
        found = np.sort(self.decode(words[:, None] ^ flips[None, :]), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return found


def keys_of(prints: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of its fingerprint) for an array of unsigned fingerprints."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for width, at in SEGMENTS]
    exact = [golay.decode(p) for p in parts]
    near = [golay.near(p, width) for p, (width, _) in zip(parts, SEGMENTS, strict=True)]
    keys, owners = [], []
    for k, (i, j) in enumerate(combinations(range(3), 2)):
        left = np.where(near[i] < 0, -1, near[i] << 12 | exact[j][:, None])
        right = np.where((near[j] < 0) | (near[j] == exact[j][:, None]), -1, exact[i][:, None] << 12 | near[j])
        both = np.concatenate([left, right], axis=1)
        at, _ = np.nonzero(both >= 0)
        keys.append(both[both >= 0] | k << 24)
        owners.append(at)
    return np.concatenate(keys), np.concatenate(owners)


def forest(prints: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member) of the components of one bucket.

    A search from each print compares it with the prints not reached so far,
    so a crowd of near copies costs little more than one pass.
    """
    left = np.unique(prints)
    a, b = [], []
    while len(left) > 1:
        seed, left = left[0], left[1:]
        queue = [seed]
        while queue and len(left):
            hit = np.bitwise_count((left ^ queue.pop()).view(np.uint64)) <= bits
            if hit.any():
                new, left = left[hit], left[~hit]
                a.append(new)
                b.append(np.full(len(new), seed))
                queue.extend(new)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def forests(keys: np.ndarray, prints: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """``forest`` of every bucket of a sorted stretch; only buckets with a link are searched one by one."""
    linked, at, lag = np.zeros(len(keys), bool), np.arange(len(keys)), 1
    while len(at := at[at + lag < len(keys)]) and lag < 64:
        at = at[keys[at] == keys[at + lag]]
        hit = np.bitwise_count((prints[at] ^ prints[at + lag]).view(np.uint64)) <= bits
        linked[at[hit & (prints[at] != prints[at + lag])]] = True
        lag += 1
    if lag == 64:
        linked[at] = True
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for key in np.unique(keys[linked]):
        low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        x, y = forest(prints[low:high], bits)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def fingerprints(docs: DataFrame, *ids) -> DataFrame:
    """``ids`` and the fingerprint (long ``fp``) of every row; one pass, no shuffle."""
    rows = docs.select(*ids, as_bytes().alias("_text"))

    def run(batches):
        for batch in slices(batches):
            prints = np.array([fingerprint(x.as_py()) for x in batch.column(batch.num_columns - 1)], np.uint64)
            columns = [*batch.columns[:-1], pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, fp long")


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root): the class of every distinct fingerprint under links of at most three bits."""

    def keyed(batches):
        golay = Golay()
        for batch in slices(batches, 1 << 18):
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, owners = keys_of(fps, golay)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[owners].view(np.int64))], names=["key", "item"])

    distinct = prints.select("fp").distinct()
    rows = distinct.mapInArrow(keyed, "key long, item long")
    roots = components(link_buckets(rows, forests, forest), "a", "b")
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Null, empty and blank texts have fingerprint zero and link like any other.
    Repeated rows each give a row. A null doc_id keeps its row; a component_id
    is the least non-null doc_id of the class, null if it has none. Other
    columns are ignored.
    """
    prints = spool(fingerprints(docs, "doc_id"), "prints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = classes(prints).join(least, "fp")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(names, "root").select("fp", "component_id")
    return prints.join(of, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the least doc_id stays.

    Rows are numbered once, in a table that all later steps read, so repeated
    rows and null ids are safe: among equal ids the first place stays, a null
    id only where no other is. Null, empty and blank texts are one class.
    """
    rows = spool(docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.monotonically_increasing_id().alias("_place")), "rows")
    source = rows.select(F.col("_row.doc_id").alias("_id"), "_place", F.col("_row.text").alias("text"))
    prints = spool(fingerprints(source, "_id", "_place"), "prints")
    order = F.struct(F.col("_id").isNull().alias("x"), "_id", "_place")
    first = prints.groupBy("fp").agg(F.min(order).alias("least"))
    stay = classes(prints).join(first, "fp").groupBy("root").agg(F.min("least").alias("least")).select(F.col("least._place").alias("_place"))
    kept = rows.join(stay, "_place", "left_semi")
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
