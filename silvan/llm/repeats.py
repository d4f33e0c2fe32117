"""Removal of long repeated byte strings by prefix-free parsing.

Rolling-hash triggers cut every distinct text into phrases (see ``phrases``).
The dictionary of phrases is counted over the corpus: a string of 400 bytes that
occurs twice holds only phrases that occur twice, so all else is left out. The
parse is then put into order: the starts of phrases are sorted by the text that
follows (the suffix array of the parse), and neighbours tell, byte by byte, how
much of it occurs elsewhere. That settles every start that has its like at the
same place of an equal phrase. Equal strings may also start in unlike phrases
that end alike; only such starts are expanded, as suffixes of dictionary phrases:
the order of (phrase suffix, order of the parse after it) is the order of the
corpus, in which equal strings are neighbours.

Sorts are by range over unique keys, so no group of equal strings has to fit a
task; pairs of neighbours across the cuts are settled from the tables' edges,
two rows a task.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .phrases import LENGTH, SIDE, TRIGGER, hashes, inner_runs, parse
from .spool import discard, spool
from .text import as_bytes, slices, to_batch

#: Rows of each part that the driver looks at to cut a sort into ranges; their keys are texts.
SAMPLE = "20"
#: Bytes after an anchor that tell its group; strings that start LENGTH - GROUP bytes back or more always count as mixed.
GROUP = 64
#: Bytes before an anchor that tell its group too, for strings that start so far back at least.
BACK = (0, 8, 24, 64, 128)
#: Bytes of a string without a trigger that put it in order; its hash does the rest.
PREFIX = 64


def digest(raw: bytes) -> tuple[int, int]:
    """128-bit hash of a text, as two signed numbers."""
    h = xxhash.xxh3_128_intdigest(raw)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, d1, d2, whole) of every row: what identifies its text, and the digest of all of it."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            raws = [raw.as_py() or b"" for raw in batch.column(1)]
            ones, twos = zip(*map(digest, raws), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, raws), pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array([hashlib.sha256(raw).hexdigest() for raw in raws], pa.string())],
                names=["doc_id", "n_bytes", "d1", "d2", "whole"],
            )

    return docs.select("doc_id", as_bytes().alias("raw")).mapInArrow(run, f"doc_id {kind}, n_bytes long, d1 long, d2 long, whole string")


def _texts(docs: DataFrame) -> DataFrame:
    """(tid, d1, d2, copies, raw): the distinct texts of LENGTH bytes or more, numbered."""

    def run(batches):
        for batch in slices(batches):
            ones, twos = zip(*(digest(raw.as_py()) for raw in batch.column(0)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), batch.column(0)], names=["d1", "d2", "raw"])

    raws = docs.select(as_bytes().alias("raw")).filter(F.octet_length("raw") >= LENGTH)
    distinct = raws.mapInArrow(run, "d1 long, d2 long, raw binary").groupBy("d1", "d2").agg(F.count("*").alias("copies"), F.first("raw").alias("raw"))
    return spool(distinct.select(F.monotonically_increasing_id().alias("tid"), "d1", "d2", "copies", "raw"), "texts")


def _live(texts: DataFrame) -> DataFrame:
    """(tid, live): numbers of the inner phrases that occur more than once in the distinct texts.

    Negative numbers, from -1 down, are runs of starts inside long phrases
    whose surroundings occur more than once (see ``inner_runs``).
    """

    def run(batches):
        for batch in slices(batches, 2 << 20):
            tids, numbers, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
            for tid, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_py()
                starts, ends = parse(raw)
                inner = np.arange(1, len(starts) - 1)
                _, _, places = inner_runs(raw, starts, ends)
                numbers += [inner, -1 - np.arange(len(places))]
                tids.append(np.full(len(inner) + len(places), tid))
                found += [hashes(raw, starts[inner], ends[inner]), hashes(raw, places - SIDE, places + SIDE)]
            both = np.ascontiguousarray(np.concatenate(found).T)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(np.concatenate(tids)), pa.array(np.concatenate(numbers).astype(np.int32))], names=["h1", "h2", "tid", "k"])

    phrases = texts.select("tid", "raw").mapInArrow(run, "h1 long, h2 long, tid long, k int")
    repeated = spool(phrases.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"), "dictionary")
    # texts are long: the other side of a join is the one that is hashed, so that they need no sort
    live = spool(phrases.join(repeated.hint("shuffle_hash"), ["h1", "h2"]).groupBy("tid").agg(F.collect_list("k").alias("live")), "live")
    discard(repeated)
    return live


def candidates(size: int, starts: np.ndarray, ends: np.ndarray, live: np.ndarray, runs: tuple) -> np.ndarray:
    """Whether the string at each start may repeat: it holds no phrase, and its run has no surroundings, that occur once.

    ``live`` has the numbers of the others, ``runs`` the text's ``inner_runs``.
    """
    dead = np.ones(len(starts), bool)
    dead[live[live >= 0]] = False
    dead[[0, -1]] = False  # the text's edges are parts of phrases
    dead &= ends - starts <= LENGTH
    lone = np.ones(len(runs[0]), bool)
    lone[-1 - live[live < 0]] = False
    n = size - LENGTH + 1
    change = np.zeros(n + 1, np.int64)
    low, high = np.append(ends[dead] - LENGTH, runs[0][lone]), np.append(starts[dead], runs[1][lone]) + 1
    low, high = np.maximum(low, 0), np.minimum(high, n)
    some = low < high
    np.add.at(change, low[some], 1)
    np.add.at(change, high[some], -1)
    return np.cumsum(change[:-1]) == 0


def _anchors(texts: DataFrame, live: DataFrame, every: bool = False) -> DataFrame:
    """(tid, k, context, groups, before): phrase starts near strings that may repeat.

    ``context`` is the text from the phrase's start to LENGTH bytes past its
    end's trigger, ``groups`` has a hash for each entry of ``BACK`` of the bytes
    around the start, ``before`` is a hash of the phrase before.
    """
    schema = pa.schema([("tid", pa.int64()), ("k", pa.int32()), ("context", pa.binary()), ("groups", pa.list_(pa.int64())), ("before", pa.int64())])
    number = lambda raw, seed=0: xxhash.xxh3_64_intdigest(raw, seed) - (1 << 63)

    def run(batches):
        for batch in slices(batches, 1 << 20):
            out = {f.name: [] for f in schema}
            for tid, raw, known in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = raw.as_py()
                starts, ends = parse(raw)
                runs = inner_runs(raw, starts, ends)
                if every:
                    known = np.arange(-len(runs[0]), len(starts))
                fits = candidates(len(raw), starts, ends, np.array([] if known is None else known, np.int64), runs)
                sums = np.concatenate([[0], np.cumsum(fits)])
                cuts = np.minimum(np.concatenate([starts[:1], starts, [len(raw)]]), len(fits))
                for k in np.flatnonzero(sums[cuts[2:]] > sums[cuts[:-2]]).tolist():
                    start = int(starts[k])
                    end = int(starts[k + 1]) + LENGTH if k + 1 < len(starts) else len(raw)
                    out["tid"].append(tid)
                    out["k"].append(k)
                    out["context"].append(raw[start:end])
                    out["groups"].append([number(raw[max(0, start - back) : start + GROUP], back) for back in BACK])
                    out["before"].append(number(raw[starts[k - 1] : ends[k - 1]]) if k else None)
            yield to_batch(out, schema)

    # a text without a repeated phrase or run has candidates only where neighbouring phrases are long
    return texts.select("tid", "raw").join(live.hint("shuffle_hash"), "tid", "left").select("tid", "raw", "live").mapInArrow(run, "tid long, k int, context binary, groups array<long>, before long")


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    unlike = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (unlike.bit_length() + 7) // 8


def _parse_order(anchors: DataFrame) -> tuple[DataFrame, dict]:
    """(tid, k, rank, up, down, edge) in the order of the text that follows, and the edges between tasks.

    ``up`` and ``down`` are the bytes in common with the neighbours in that
    order; a task does not know those beyond its own rows, so the second value
    has them by rank.
    """
    schema = pa.schema([("tid", pa.int64()), ("k", pa.int32()), ("rank", pa.int64()), ("up", pa.int32()), ("down", pa.int32()), ("edge", pa.binary())])

    def run(batches):
        held = None  # the last row so far and what it has in common with the one before

        def row(r, up, down, edge):
            return dict(zip(schema.names, (r[0], r[1], r[3], up, down, edge), strict=True))

        for batch in batches:
            out = []
            for r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held is None:
                    held = (r, 0, True)
                    continue
                last, up, first = held
                same = common(last[2], r[2])
                out.append(row(last, up, same, last[2] if first else None))
                held = (r, same, False)
            yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([row(held[0], held[1], 0, held[0][2])], schema)

    rows = anchors.select("tid", "k", "context").orderBy("context", "tid", "k").withColumn("rank", F.monotonically_increasing_id())
    ordered = spool(rows.mapInArrow(run, "tid long, k int, rank long, up int, down int, edge binary"), "parse", execution__rangeExchange__sampleSizePerPartition=SAMPLE)
    edges = ordered.filter("edge is not null").select("rank", "edge").orderBy("rank").collect()  # two rows a task at most
    known: dict[int, list[int]] = {}
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a.rank >> 33 != b.rank >> 33:
            same = common(bytes(a.edge), bytes(b.edge))
            known.setdefault(a.rank, [0, 0])[1] = same
            known.setdefault(b.rank, [0, 0])[0] = same
    return ordered, known


_FOUND = pa.schema([("tid", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("tail", pa.binary()), ("rank", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("ask", pa.bool_())])


class Found:
    """Rows of ``_FOUND`` in the making: runs of starts that are sure, and starts that wait for the order of the corpus."""

    def __init__(self):
        self.runs: list[tuple[int, int, int]] = []
        self.counts: list[int] = []
        self.heads: list[tuple[int, int]] = []
        self.starts: list[np.ndarray] = []
        self.asks: list[np.ndarray] = []
        self.tails: list[bytes] = []
        self.strings: list[bytes] = []

    def sure(self, tid: int, starts: np.ndarray) -> None:
        """Adds the runs of neighbouring ``starts``, which rise."""
        cuts = np.flatnonzero(starts[1:] > starts[:-1] + 1)
        self.runs += zip([tid] * (len(cuts) + 1), starts[np.append(0, cuts + 1)].tolist(), starts[np.append(cuts, len(starts) - 1)].tolist(), strict=True)

    def wait(self, tid: int, rank: int, starts: np.ndarray, asks: np.ndarray, tails: list[bytes], strings: list[bytes]) -> None:
        self.counts.append(len(starts))
        self.heads.append((tid, rank))
        self.starts.append(starts)
        self.asks.append(asks)
        self.tails += tails
        self.strings += strings

    def __len__(self):
        return len(self.runs) + len(self.tails)

    def batch(self) -> pa.RecordBatch:
        n, m = len(self.runs), len(self.tails)
        runs = np.array(self.runs, np.int64).reshape(-1, 3).T
        heads = np.repeat(np.array(self.heads, np.int64).reshape(-1, 2), self.counts, axis=0).T
        starts = np.concatenate([np.zeros(0, np.int64), *self.starts])
        digests = np.frombuffer(b"".join(self.strings), ">i8").reshape(-1, 2).astype(np.int64).T
        after = lambda values, kind: pa.concat_arrays([pa.nulls(n, kind), pa.array(values, kind)])
        columns = [
            pa.array(np.append(runs[0], heads[0])), pa.array(np.append(runs[1], starts)), pa.array(np.append(runs[2], starts)), after(self.tails, pa.binary()),
            after(heads[1], pa.int64()), after(digests[0], pa.int64()), after(digests[1], pa.int64()), after(np.concatenate([np.zeros(0, bool), *self.asks]), pa.bool_()),
        ]
        assert len(starts) == m
        return pa.RecordBatch.from_arrays(columns, schema=_FOUND)


def settle(tid: int, raw: bytes, known: tuple[np.ndarray, ...], edges: dict, out: Found, every: bool = False) -> None:
    """Adds the runs of one text that are sure, and the starts that wait for the order of the corpus, to ``out``."""
    starts, ends = parse(raw)
    m, latest = len(starts), len(raw) - LENGTH
    rank, up, down, mixed = np.full(m, -1), np.zeros(m, np.int64), np.zeros(m, np.int64), np.full((m, len(BACK)), every)
    firsts, lasts, _ = inner_runs(raw, starts, ends)
    shown = np.full(len(firsts), every)
    # rows of the parse order, else bytes before an anchor that occur elsewhere too, else runs inside long phrases
    k, ranks, ups, downs = known
    shown[-1 - k[k < 0]] = True
    own = (k >= 0) & (ranks < 0)
    mixed[k[own], np.searchsorted(BACK, ups[own])] = True
    own = ranks >= 0
    rank[k[own]], up[k[own]], down[k[own]] = ranks[own], ups[own], downs[own]
    for place in np.flatnonzero(np.isin(rank, edges["ranks"])).tolist():
        more = edges["common"][int(rank[place])]
        up[place], down[place] = max(up[place], more[0]), max(down[place], more[1])
    most = np.maximum(up, down)
    next_ = np.append(starts[1:], len(raw))
    # the last start of each phrase that its like in another place settles, and the last that a row before it in order shows
    done = np.where(rank >= 0, np.minimum(np.minimum(next_ - 1, starts + most - LENGTH), latest), -1)
    shows = starts + up - LENGTH
    digest = xxhash.xxh3_128_digest
    for k in np.flatnonzero(done >= starts).tolist():
        if not every:
            out.runs.append((tid, int(starts[k]), int(done[k])))

    # strings that hold no trigger past their first byte lie inside a phrase
    owner = np.searchsorted(starts, firsts, "right") - 1
    for k in np.unique(owner[shown]).tolist():
        if rank[k] < 0:
            continue
        own = np.concatenate([np.arange(firsts[r], lasts[r] + 1) for r in np.flatnonzero(shown & (owner == k))])
        if not every:
            own = own[(own > done[k]) | (own > shows[k])]
        if not len(own):
            continue
        strings = [digest(raw[i : i + LENGTH]) for i in own.tolist()]
        asked = own > done[k]
        if every:
            out.wait(tid, 0, own, asked, [raw[i : i + LENGTH] for i in own.tolist()], strings)
            continue
        _, first, inverse, count = np.unique(np.array(strings, "V16"), return_index=True, return_inverse=True, return_counts=True)
        again = own[asked & (count[inverse] > 1)]
        if len(again):
            out.sure(tid, again)
        first.sort()
        out.wait(tid, 0, own[first], (asked & (count[inverse] == 1))[first], [raw[i : i + PREFIX] for i in own[first].tolist()], [strings[i] for i in first.tolist()])

    # strings whose next trigger starts a phrase: by distance from it, the further back, the more bytes before it must occur elsewhere too
    after = np.flatnonzero(rank[1:] >= 0) + 1
    anchors, before = starts[after], after - 1
    low = np.maximum(np.maximum(starts[before], anchors + TRIGGER - LENGTH), 0)
    high = np.minimum(anchors - 1, latest)
    asks = np.maximum(low, done[before] + 1) <= np.minimum(high, anchors + most[after] - LENGTH)
    shown = np.maximum(low, shows[before] + 1) <= np.minimum(high, done[before])
    open_ = mixed[after].any(axis=1) | (low <= anchors - (LENGTH - GROUP))
    for n in np.flatnonzero((asks | shown) & open_ | every).tolist():
        k, anchor, first, last = int(after[n]), int(anchors[n]), int(low[n]), int(high[n])
        bounds = [anchor - back for back in BACK] + [anchor - (LENGTH - GROUP)]
        places = [i for far, near, some in zip(bounds[:-1], bounds[1:], mixed[k].tolist(), strict=True) if some for i in range(max(first, near + 1), min(last, far) + 1)]
        places += range(first, min(last, bounds[-1]) + 1)
        settled, shows_to, asks_to = int(done[k - 1]), int(shows[k - 1]), anchor + int(most[k]) - LENGTH
        if not every:
            places = [i for i in places if (i <= asks_to if i > settled else i > shows_to)]
        if places:
            own = np.array(places, np.int64)
            out.wait(tid, int(rank[k]), own, own > settled, [raw[i : anchor + TRIGGER] for i in places], [digest(raw[i : i + LENGTH]) for i in places])


def _settled(texts: DataFrame, every: bool = False) -> DataFrame:
    """The rows of ``_FOUND``: sure runs (no tail) and starts to be put in the order of the corpus."""
    live = _live(texts)
    anchors = spool(_anchors(texts, live, every), "anchors")
    # phrases that begin alike, also with some bytes before, but follow unlike phrases: one row a group and task reaches the shuffle
    around = anchors.filter("before is not null").select("tid", "k", "before", F.posexplode("groups").alias("level", "group"))
    groups = spool(around.groupBy("group").agg(F.min("before").alias("low"), F.max("before").alias("high")).filter("low < high").select("group"), "groups")
    mixed = spool(around.join(groups, "group", "left_semi").select("tid", "k", F.element_at(F.array(*map(F.lit, BACK)), F.col("level") + 1).alias("back")), "mixed")
    ordered, common_ = _parse_order(anchors)
    edges = {"ranks": np.array(sorted(common_), np.int64), "common": common_}
    discard(anchors)
    none = F.lit(None)
    runs = live.select("tid", F.explode(F.filter("live", lambda k: k < 0)).alias("k"), none.cast("long"), none.cast("int"), none.cast("int"))
    info = ordered.select("tid", "k", "rank", "up", "down").union(mixed.select("tid", "k", none.cast("long"), "back", none.cast("int"))).union(runs)
    lists = info.groupBy("tid").agg(F.collect_list(F.struct("k", "rank", "up", "down")).alias("known"))

    def run(batches):
        for batch in slices(batches, 1 << 20):
            out = Found()
            for tid, raw, known in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                columns = tuple(c.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in known.values.flatten())
                settle(tid, raw.as_py(), columns, edges, out, every)
                if len(out) > 1 << 15:
                    yield out.batch()
                    out = Found()
            yield out.batch()

    rows = texts.select("tid", "raw").join(lists.hint("shuffle_hash"), "tid").select("tid", "raw", "known")
    found = spool(rows.mapInArrow(run, "tid long, first long, last long, tail binary, rank long, s1 long, s2 long, ask boolean"), "settled")
    discard(ordered, mixed, groups, live)
    return found


def _corpus_order(found: DataFrame) -> DataFrame:
    """The starts that wait, in the order of the corpus: by phrase suffix, then by the parse after it.

    Strings without a trigger are no phrase suffixes; past their first bytes
    their order is that of their hashes, so that equal ones meet.
    """
    return found.filter("tail is not null").select("tail", "rank", "tid", "first", "s1", "s2", "ask").orderBy("tail", "rank", "s1", "s2", "tid", "first")


def _neighbours(found: DataFrame) -> DataFrame:
    """(tid, first, last): starts that were asked for and whose string is a neighbour's in the order of the corpus."""
    schema = pa.schema([("place", pa.int64()), ("tid", pa.int64()), ("start", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("hit", pa.bool_()), ("ask", pa.bool_()), ("edge", pa.bool_())])

    def run(batches):
        held, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is None:
                held = [c[:1] for c in part] + [np.zeros(1, bool)]
                part = [c[1:] for c in part]
            place, tid, start, s1, s2, ask, hit = (np.concatenate([a, b]) for a, b in zip(held, [*part, np.zeros(len(part[0]), bool)], strict=True))
            same = (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])
            hit[1:] |= same
            hit[:-1] |= same
            edge = np.zeros(len(hit), bool)
            edge[0] = first and len(hit) > 1
            first = first and len(hit) == 1
            out = np.flatnonzero(((hit & ask) | edge)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (place, tid, start, s1, s2, hit, ask, edge)], schema=schema)
            held = [c[-1:] for c in (place, tid, start, s1, s2, ask, hit)]
        if held is not None:
            place, tid, start, s1, s2, ask, hit = held
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (place, tid, start, s1, s2, hit, ask, np.ones(1, bool))], schema=schema)

    rows = _corpus_order(found).withColumn("place", F.monotonically_increasing_id()).select("place", "tid", F.col("first").alias("start"), "s1", "s2", "ask")
    near = spool(rows.mapInArrow(run, "place long, tid long, start long, s1 long, s2 long, hit boolean, ask boolean, edge boolean"), "order", execution__rangeExchange__sampleSizePerPartition=SAMPLE)
    edges = near.filter("edge").orderBy("place").collect()  # two rows a task at most
    more = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a.place >> 33 != b.place >> 33 and (a.s1, a.s2) == (b.s1, b.s2):
            more += [(r.tid, r.start, r.start) for r in (a, b) if r.ask]
    hits = near.filter("hit and ask").select("tid", F.col("start").alias("first"), F.col("start").alias("last"))
    return hits.union(near.sparkSession.createDataFrame(more, "tid long, first long, last long"))


def covered(firsts: np.ndarray, lasts: np.ndarray, size: int = LENGTH) -> list[tuple[int, int]]:
    """Merged [start, end) of the bytes under strings that start at first to last; touching spans are one."""
    order = np.argsort(firsts, kind="stable")
    firsts, ends = firsts[order], np.maximum.accumulate(lasts[order] + size) if len(order) else lasts
    fresh = np.concatenate([[True], firsts[1:] > ends[:-1]])[: len(firsts)]
    return list(zip(firsts[fresh].tolist(), ends[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [-1]])].tolist() if len(firsts) else [], strict=True))


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of ``docs``.

    ``spans`` are the removed [start, end) byte ranges. A null text counts as
    empty; texts under 400 bytes lose nothing. A repeated row is a copy, so
    both lose all they share. Rows are told apart by nothing but their text
    (a 128-bit hash), so ids may be null or repeat, in any input, and a
    changed split of it changes nothing. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = spool(_digests(docs), "digests")
    texts = _texts(docs)
    found = _settled(texts)
    gc.collect()
    spark._jvm.System.gc()  # the tables above are written: their shuffle files may go
    runs = found.filter("tail is null").select("tid", "first", "last").union(_neighbours(found))
    lists = runs.groupBy("tid").agg(F.collect_list(F.struct("first", "last")).alias("runs"))

    def cut(batches):
        for batch in slices(batches):
            out = [[], [], [], []]
            for raw, runs in zip(batch.column(2), batch.column(3), strict=True):
                raw, runs = raw.as_py(), runs.values.flatten()
                spans = covered(runs[0].to_numpy(), runs[1].to_numpy())
                kept, at = hashlib.sha256(), 0
                for start, end in spans:
                    kept.update(raw[at:start])
                    at = end
                kept.update(raw[at:])
                for have, new in zip(out, (sum(e - s for s, e in spans), len(spans), kept.hexdigest(), [list(x) for x in spans]), strict=True):
                    have.append(new)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["d1", "d2", "n_removed", "n_spans", "rest", "spans"])

    alone = texts.filter("copies = 1").join(lists.hint("shuffle_hash"), "tid").select("d1", "d2", "raw", "runs").mapInArrow(cut, "d1 long, d2 long, n_removed long, n_spans long, rest string, spans array<array<long>>")
    size = F.octet_length("raw").cast("long")
    copied = texts.filter("copies > 1").select("d1", "d2", size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256().hexdigest()).alias("rest"), F.array(F.array(F.lit(0).cast("long"), size)).alias("spans"))
    return rows.join(alone.union(copied), ["d1", "d2"], "left").select(
        "doc_id", "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("rest", "whole").alias("kept_sha256"),
        F.coalesce("spans", F.expr("cast(array() as array<array<bigint>>)")).alias("spans"),
    )


def corpus_order(docs: DataFrame) -> DataFrame:
    """(d1, d2, start, place): every start of a LENGTH-byte string of every distinct text, in the order of the corpus.

    One row a byte: for small corpora and for tests of the order.
    """
    texts = _texts(docs)
    rows = _corpus_order(_settled(texts, every=True)).withColumn("place", F.monotonically_increasing_id())
    return rows.select("tid", F.col("first").alias("start"), "place").join(texts.select("tid", "d1", "d2"), "tid").select("d1", "d2", "start", "place")
