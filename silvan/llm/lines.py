"""Line dedup by a segment-partition edit join.

An edit inserts, deletes or replaces one word. Two lines are near-duplicates at
so many edits as the shorter one's length allows (``EDITS``): one from 5 words,
two from 10. A line is cut into threshold-plus-one even segments; a line within
the threshold contains one of them unchanged, not far from its place. Every line
is indexed by its segments and probes, for each length it could match, the runs
of words that the lengths allow (multi-match-aware selection). Lines that share
a key are verified by a banded bit-parallel edit distance. Equal lines, of any
length, are one item throughout.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import link_buckets, shared_keys
from .components import components
from .spool import discard, spool
from .text import as_bytes, slices, to_batch

#: (words of the shorter line at least, edits allowed); shorter lines have no near-duplicates, only equal ones.
EDITS = ((10, 2), (5, 1))
#: Lines of a bucket that one task compares at a time.
BLOCK = 1 << 14
#: Line hashes that a task remembers, so as not to pass a repeated line's text on again.
REMEMBERED = 1 << 19


def normal(line: bytes) -> bytes:
    return b" ".join(line.split())


#: White space that a line may hold besides single spaces.
_ODD = (b"  ", b"\t", b"\r", b"\x0b", b"\x0c")


def normal_lines(raw: bytes) -> list[bytes]:
    """The normal form of every line of a text."""
    if any(x in raw for x in _ODD):
        return [normal(line) for line in raw.split(b"\n")]
    return [line.strip(b" ") for line in raw.split(b"\n")]


def line_hash(line: bytes) -> tuple[int, int]:
    """128-bit hash as two signed numbers."""
    h = xxhash.xxh3_128_intdigest(line)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def edits_of(words: int) -> int:
    """Edits that a line of so many words may differ by."""
    return next((edits for least, edits in EDITS if words >= least), 0)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of the even segments of a line; the last ones are longer."""
    size, more = divmod(length, edits + 1)
    out, at = [], 0
    for k in range(edits + 1):
        own = size + (k >= edits + 1 - more)
        out.append((at, own))
        at += own
    return out


@lru_cache(maxsize=1 << 14)
def probes(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, seeds) of a line's segments and of the runs of words that may be a shorter or equal line's segment."""
    out = []
    for length in range(max(1, n - edits_of(n)), n + 1):
        edits, more = edits_of(length), n - length
        if not edits or more > edits:
            continue
        for k, (at, size) in enumerate(segments(length, edits)):
            low = max(0, at - k, at + more - (edits - k))
            high = min(n - size, at + k, at + more + (edits - k))
            out += [(start, start + size, length * 64 + k) for start in range(low, high + 1)]
    found = np.array(out, np.int64).reshape(-1, 3).T
    return found[0], found[1], found[2].astype(np.uint64)


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240202).integers(0, 1 << 64, 256, dtype=np.uint64)


@lru_cache(maxsize=16)
def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of the base of the rolling hash, or of its inverse."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def keys_of(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys, numbers of their lines): hashes of the runs of ``probes`` of each line, from rolling sums of bytes and words.

    ``lines`` are normal and not empty: words with one space between. Those of
    one length are handled together. Unlike runs may share a key, which
    verification sorts out.
    """
    if not len(lines):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = lines.buffers()
    cuts = np.frombuffer(offsets, np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    size = 1 << len(data).bit_length()
    powers, back = _powers(_BASE, size), _powers(_BACK, size)

    def summed(values):
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[: len(values)], out=out[1:])
        return out

    spaces = np.flatnonzero(data == 32)
    starts, ends = np.sort(np.concatenate([cuts[:-1], spaces + 1])), np.sort(np.concatenate([cuts[1:], spaces]))
    bytes_ = summed(_TABLE[data])
    words = summed(_mixed((bytes_[ends] - bytes_[starts]) * back[starts]))
    first = np.searchsorted(starts, cuts)
    counts = first[1:] - first[:-1]
    keys, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    order = np.argsort(counts, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(counts[order])) + 1):
        low, high, seeds = probes(int(counts[own[0]]))
        if len(low):
            at = first[own][:, None]
            h = (words[at + high] - words[at + low]) * back[at + low]
            keys.append(_mixed(h ^ seeds * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64).ravel())
            owners.append(np.repeat(own, len(low)))
    return np.concatenate(keys), np.concatenate(owners)


def within(a: tuple, b: tuple, edits: int) -> bool:
    """Whether the edit distance of two sequences is ``edits`` at most."""
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    a, b = _trim(a, b)
    a, b = a[::-1], b[::-1]
    a, b = _trim(a, b)
    if len(a) < len(b):
        a, b = b, a
    return len(a) <= edits if not b else _banded(a, b, edits) <= edits


def near(a: tuple, b: tuple) -> bool:
    """Whether two lines, as words, are near-duplicates."""
    edits = edits_of(min(len(a), len(b)))
    return edits > 0 and within(a, b, edits)


def _trim(a: tuple, b: tuple) -> tuple[tuple, tuple]:
    """Both without their common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        half = (low + high + 1) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half - 1
    return a[low:], b[low:]


def _banded(a: tuple, b: tuple, edits: int) -> int:
    """Edit distance of a and the shorter b, if ``edits`` at most; else a larger number.

    One word holds the vertical differences of a band of 2 * edits + 1 diagonals
    and moves down a row with each item of b.
    """
    band = 2 * edits + 2
    full = (1 << band) - 1
    top, side = 1 << band - 1, 1 << band - 2
    places: dict = {}
    for k, item in enumerate(a):
        places[item] = places.get(item, 0) | 1 << k
    plus, minus, distance = full << band - edits - 1 & full, 0, edits
    shift = edits + 1 - band
    limit = edits + min(len(b), len(a) - edits) - len(a) + len(b) + edits
    for k, item in enumerate(b):
        at = places.get(item, 0)
        match = (at >> shift if shift >= 0 else at << -shift) & full
        diagonal = (((match & plus) + plus) ^ plus | match | minus) & full
        across = (minus | ~(diagonal | plus)) & full
        back = diagonal & plus
        if k < len(a) - edits:
            distance += not diagonal & top
        else:
            distance += bool(across & side) - bool(back & side)
            side >>= 1
        if distance > limit + edits:
            return distance
        plus = (back | ~(diagonal >> 1 | across)) & full
        minus = diagonal >> 1 & across
        shift += 1
    return distance


def forest(items: np.ndarray, raws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, first found) of the components of one bucket of lines.

    A search compares a line with those not reached so far. Word counts differ
    by two for each edit at most, which rules out almost all others at once.
    """
    items, at = np.unique(items, return_index=True)
    a, b = [], []
    if len(items) > 1:
        lines = [tuple(raws[k].split(b" ")) for k in at]
        if len(items) == 2:
            left, right = ([items[1]], [items[0]]) if near(*lines) else ([], [])
            return np.array(left, np.int64), np.array(right, np.int64)
        counts = np.stack([np.bincount([xxhash.xxh32_intdigest(w) & 63 for w in line], minlength=64) for line in lines]).astype(np.int32)
        most = 2 * max(edits for _, edits in EDITS)
        left = np.arange(len(items))
        while len(left) > 1:
            seed, left = left[0], left[1:]
            queue = [seed]
            while queue and len(left):
                x = queue.pop()
                like = np.abs(counts[left] - counts[x]).sum(axis=1) <= most
                new = [k for k in left[like] if near(lines[x], lines[k])]
                if new:
                    left = left[~np.isin(left, new)]
                    a.extend(items[new])
                    b.extend([items[seed]] * len(new))
                    queue.extend(new)
    return np.array(a, np.int64), np.array(b, np.int64)


def forests(keys: np.ndarray, items: np.ndarray, raws: np.ndarray):
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    found = [forest(items[x:y], raws[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y - x > 1]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(x for x, _ in found)]), np.concatenate([none, *(y for _, y in found)])


def _lines(rows: DataFrame) -> DataFrame:
    """(place, doc_id, line, h1, h2) of every line that is not blank, and for each row one with the count of its lines.

    In the latter ``line`` is -1 and ``h1`` the count. ``rows`` has place, doc_id and raw.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            rowsat, numbers, ones, twos = [], [], [], []
            for k, raw in enumerate(batch.column(2)):
                own = normal_lines(raw.as_py() or b"")
                found = [(-1, len(own), 0), *((number, *line_hash(line)) for number, line in enumerate(own) if line)]
                for have, new in zip((numbers, ones, twos), zip(*found, strict=True), strict=True):
                    have.extend(new)
                rowsat.extend([k] * len(found))
            at = pa.array(rowsat, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64())], names=["place", "doc_id", "line", "h1", "h2"])

    return rows.mapInArrow(run, f"place long, doc_id {kind}, line int, h1 long, h2 long")


def _distinct(raws: DataFrame) -> DataFrame:
    """(item, h1, h2, text): the distinct lines that may have near-duplicates, numbered once for all."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("text", pa.binary())])
    least = min(words for words, _ in EDITS)

    def run(batches):
        seen: set = set()
        for batch in slices(batches, 4 << 20):
            out = {f.name: [] for f in schema}
            for raw in batch.column(0):
                for line in normal_lines(raw.as_py() or b""):
                    if line.count(b" ") + 1 >= least:
                        h = line_hash(line)
                        if h not in seen:
                            if len(seen) >= REMEMBERED:
                                seen.clear()
                            seen.add(h)
                            for have, new in zip(out.values(), (*h, line), strict=True):
                                have.append(new)
            yield to_batch(out, schema)

    lines = raws.mapInArrow(run, "h1 long, h2 long, text binary").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    return spool(lines.select(F.monotonically_increasing_id().alias("item"), "h1", "h2", "text"), "lines")


def _keyed(batches):
    for batch in slices(batches, 2 << 20):
        keys, owners = keys_of(batch.column(1))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(batch.column(0).to_numpy()[owners])], names=["key", "item"])


def line_classes(raws: DataFrame) -> DataFrame:
    """(h1, h2, root) of every line of the texts ``raw`` that has a near-duplicate of other text."""
    lines = _distinct(raws)
    pairs = spool(shared_keys(lines.select("item", "text").mapInArrow(_keyed, "key long, item long")), "keys")
    # near lines share many keys: of the buckets that hold the same two lines one is enough
    sizes = pairs.groupBy("key").agg(F.count("*").alias("n"), F.min("item").alias("a"), F.max("item").alias("b"))
    enough = sizes.filter("n = 2").groupBy("a", "b").agg(F.min("key").alias("key")).select("key").union(sizes.filter("n > 2").select("key"))
    buckets = pairs.join(enough, "key", "left_semi")
    texts = buckets.join(lines.select("item", F.col("text").alias("extra")), "item").select("key", "item", "extra")
    roots = components(link_buckets(texts, forests, forest, BLOCK), "a", "b")
    out = spool(lines.join(roots, lines.item == roots.node).select("h1", "h2", "root"), "roots")
    discard(pairs, lines)
    return out


def _classed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Line table with each line's class (c1, c2, near), and the classes of more than one line: their size and first line."""
    lines = spool(_lines(rows), "places")  # from here on places are read, not made again
    roots = line_classes(rows.select("raw"))
    none = F.lit(0).cast("long")
    named = lines.join(roots, ["h1", "h2"], "left").select(
        "place", "doc_id", "line", F.coalesce("root", "h1").alias("c1"), F.when(F.col("root").isNull(), F.col("h2")).otherwise(none).alias("c2"), F.col("root").isNotNull().alias("near")
    )
    classed = spool(named, "classed")
    discard(lines, roots)
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "place", "line")
    first = classed.filter("line >= 0").groupBy("c1", "c2", "near").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")
    # written, so that the join after it reads both sides from their own shuffles and a hot class can be split
    return classed, spool(first, "classes")


def repeats(rows: DataFrame) -> DataFrame:
    """(place, doc_id, n_lines, n_links, class_id, dropped, kept_in) of every row of ``rows`` (place, doc_id, raw).

    Lines come in the order of doc_id (null ids last), place and line number;
    of each class the first one stays.
    """
    classed, classes = _classed(rows)
    again = (F.col("first.place") != F.col("place")) | (F.col("first.line") != F.col("line"))
    linked = classed.filter("line >= 0").join(classes, ["c1", "c2", "near"]).select(
        "place", (F.col("n") - 1).alias("links"), F.col("first.doc_id").alias("kept"), F.when(again, F.struct("line", F.col("first.doc_id").alias("kept"))).alias("gone"), F.lit(None).cast("long").alias("n_lines"), F.lit(None).alias("id")
    )
    heads = classed.filter("line < 0").select("place", F.lit(0).cast("long").alias("links"), F.lit(None).alias("kept"), F.lit(None).alias("gone"), F.col("c1").alias("n_lines"), F.col("doc_id").alias("id"))
    # a row's list is no longer than its lines
    per_row = linked.unionByName(heads).groupBy("place").agg(F.max("id").alias("doc_id"), F.max("n_lines").alias("n_lines"), F.sum("links").alias("n_links"), F.min("kept").alias("class_id"), F.sort_array(F.collect_list("gone")).alias("gone"))
    return per_row.select("place", "doc_id", "n_lines", "n_links", "class_id", F.col("gone.line").alias("dropped"), F.col("gone.kept").alias("kept_in"))


def _numbered(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("place"), "doc_id", as_bytes().alias("raw"), *more)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped, kept_in, n_links, class_id) of every row of ``docs``.

    ``n_lines`` counts lines between line feeds (one for a null or empty text),
    ``dropped`` lists those removed, from 0, and ``kept_in`` the documents that
    keep the first line of their classes. ``n_links`` counts, over all lines of
    the row, the other lines of their classes; ``class_id`` is the least
    document that keeps one of them, null without a link. Lines are compared
    with white space collapsed; blank ones stay, and those of fewer than five
    words go only where they equal an earlier one. Near classes are closed under
    links. A repeated row is a copy: the later one loses its lines. Rows are
    numbered once, in a table that all later steps read. Other columns are ignored.
    """
    return repeats(_numbered(docs)).select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped", "kept_in", "n_links", "class_id")


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines; every row stays, all columns of the input in order.

    ``n_chars``, where the input has it, is recomputed for changed texts. Nulls,
    ties and repeated rows are as in ``report``.
    """
    rows = spool(_numbered(docs, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")), "rows")
    gone = repeats(rows.select("place", "doc_id", "raw")).filter(F.size("dropped") > 0).select("place", "dropped")
    joined = rows.select("place", "_row").join(gone, "place", "left")
    text = F.col("_row.text")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, k: ~F.array_contains("dropped", k)), "\n")
    new = joined.withColumn("_new", F.when(F.col("dropped").isNull(), text).otherwise(kept))
    changed = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("dropped").isNull(), F.col("_row.n_chars")).otherwise(F.length("_new").cast("long"))
    return new.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
