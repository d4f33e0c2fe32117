"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled texts is indexed over all of their terms. A few
words make a text toxic, and whole texts resemble others by all the rest, so a
text is scored by its passages: each one, of ``PASSAGE`` words, looks for its
nearest examples. Terms of many examples make up an inverted index cut into
blocks of examples, with the largest weight of each term in each block; those of
few examples keep short lists, which are added up first. A passage's cosines
with a block are bounded by the sum of these maxima and the largest sum of its
lists; the block with the best bound gives a threshold, and of the others only
those whose bound reaches it are looked at, so the neighbours are exact (weights
are single precision; products that differ by rounding tie). They
vote with their cosines; a text's vote is that of its most toxic passage,
calibrated by isotonic regression on leave-one-out votes of the examples.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .langid import held_out
from .sampling import bounded_sample
from .text import alnum_words, as_bytes, slices

#: Labelled examples of each class that are indexed at most (chosen by id hash).
EXAMPLES_PER_CLASS = 1000
#: A term of fewer than one in so many examples keeps a list instead of a row in every block.
RARE = 6
#: Words that a task counts before it passes them on.
COUNTED = 1 << 20
#: Words of a passage; the last one of a text may be shorter.
PASSAGE = 24
NEIGHBOURS = 60
BLOCK = 256
#: Products that differ by less, as a share, are equal.
ROUNDING = 1e-5
#: Digits of a vote; sums of single-precision products differ in later ones.
DIGITS = 4
#: Passages that are looked up at a time.
BATCH = 256
#: Neighbours that the evidence of a text lists at most.
SHOWN = 10
THRESHOLD = 0.7


@dataclass
class Passages:
    """Sparse vectors: rows sorted, a term and its weight each; ``norms`` of whole passages, unknown words included."""

    rows: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    norms: np.ndarray

    def part(self, low: int, high: int) -> Passages:
        a, b = np.searchsorted(self.rows, [low, high])
        return Passages(self.rows[a:b] - low, self.terms[a:b], self.weights[a:b], self.norms[low:high])

    def take(self, picked: np.ndarray) -> Passages:
        """The passages ``picked``, in that order (rising)."""
        place = np.full(len(self.norms), -1)
        place[picked] = np.arange(len(picked))
        own = place[self.rows]
        return Passages(own[own >= 0], self.terms[own >= 0], self.weights[own >= 0], self.norms[picked])


@dataclass
class Index:
    """Block-max inverted index of unit vectors, with the labels of the examples."""

    terms: dict[bytes, int]
    idf: np.ndarray
    #: weight of a word that no example has, for the length of a passage
    unknown: float
    #: ids and labels by place in the index, and the place of each example as given
    ids: np.ndarray
    labels: np.ndarray
    places: np.ndarray
    #: postings by block: weights of the block's examples, a row each dense term
    postings: np.ndarray
    #: largest weight of each term in each block of examples
    block_max: np.ndarray
    #: terms from number ``len(block_max)`` on: start of each list, its examples and weights
    starts: np.ndarray
    listed: np.ndarray
    listed_weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(1), np.zeros(1)))
    #: score of a text without a term
    bare: float = 0.0

    def passages(self, texts: list[list[bytes]], size: int = PASSAGE) -> tuple[Passages, np.ndarray]:
        """TF-IDF vectors of the passages of all texts, and the number of passages of each text."""
        known, new = self.terms, {}
        v = len(self.idf)
        numbers = np.fromiter((known[w] if w in known else new.setdefault(w, v + len(new)) for words in texts for w in words), np.int64)
        sizes = np.array([len(words) for words in texts], np.int64)
        counts = -(-sizes // size)
        within = np.arange(len(numbers)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rows = within // size + np.repeat(np.cumsum(counts) - counts, sizes)
        width = v + len(new) + 1
        pairs, n = np.unique(rows * width + numbers, return_counts=True)
        rows, numbers = pairs // width, pairs % width
        old = numbers < v
        weights = (1 + np.log(n)) * np.where(old, self.idf[np.minimum(numbers, v - 1)] if v else 0.0, self.unknown)
        norms = np.sqrt(np.bincount(rows, weights * weights, minlength=int(counts.sum())).astype(float))
        return Passages(rows[old], numbers[old], weights[old], norms), counts

    def products(self, p: Passages, k: int = NEIGHBOURS, skip: np.ndarray | None = None) -> np.ndarray:
        """Products of each passage with the examples: exact wherever an example may be among the k nearest, else 0."""
        n, blocks, dense = len(p.norms), len(self.postings), len(self.block_max)
        width = blocks * BLOCK
        rare = p.terms >= dense
        lists = p.terms[rare] - dense
        length = self.starts[lists + 1] - self.starts[lists]
        ends = np.cumsum(length)
        places = np.arange(int(length.sum())) + np.repeat(self.starts[lists] - ends + length, length)
        base = np.bincount(np.repeat(p.rows[rare] * width, length) + self.listed[places], np.repeat(p.weights[rare], length) * self.listed_weights[places], n * width)
        base = base.astype(np.float32).reshape(n, blocks, BLOCK)
        common = np.zeros((n, dense), np.float32)
        common[p.rows[~rare], p.terms[~rare]] = p.weights[~rare]
        bounds = base.max(axis=2) + common @ self.block_max
        first, everyone = np.argmax(bounds, axis=1), np.arange(n)
        out = np.zeros((n, blocks, BLOCK), np.float32)

        def look(wanted):
            for block in np.flatnonzero(wanted.any(axis=0)):
                own = np.flatnonzero(wanted[:, block])
                out[own, block] = base[own, block] + common[own] @ self.postings[block]
            if skip is not None:
                out[everyone[skip >= 0], skip[skip >= 0] // BLOCK, skip[skip >= 0] % BLOCK] = 0

        best = first[:, None] == np.arange(blocks)[None, :]
        look(best)
        least = np.partition(out[everyone, first], -k, axis=1)[:, -k] if BLOCK > k else np.zeros(n)
        look(~best & (bounds > 0) & (bounds >= least[:, None] * (1 - 2 * ROUNDING)))
        return out.reshape(n, width)

    def nearest(self, products: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Which examples are among the k nearest of each passage; all that tie with the k-th, none without a common term."""
        if products.shape[1] <= k:
            return products > 0
        least = np.partition(products, -k, axis=1)[:, -k] * np.float32(1 - ROUNDING)
        return products >= np.maximum(least, np.float32(1e-30))[:, None]

    def votes(self, p: Passages, k: int = NEIGHBOURS, skip: np.ndarray | None = None) -> np.ndarray:
        """Share of toxic examples among the neighbours of each passage, by cosine; missing neighbours count as not toxic, -1: no neighbour."""
        out = np.full(len(p.norms), -1.0)
        need = max(1, min(k, len(self.ids)))
        for at in range(0, len(out), BATCH):
            part = p.part(at, min(at + BATCH, len(out)))
            products = self.products(part, k, None if skip is None else skip[at : at + BATCH])
            near = self.nearest(products, k)
            products[~near] = 0
            total, count = products.sum(axis=1), near.sum(axis=1)
            vote = products @ self.labels / np.maximum(total, np.float32(1e-30)) * np.minimum(1, count / need)
            out[at : at + BATCH] = np.where(count > 0, np.round(vote.astype(float), DIGITS), -1.0)
        return out

    def text_votes(self, texts: list[list[bytes]], skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, Passages]:
        """Vote of each text (-1: no neighbour), and which of the passages cast it (-1: there is none)."""
        p, counts = self.passages(texts)
        votes = self.votes(p, skip=None if skip is None else np.repeat(skip, counts))
        ends = np.cumsum(counts)
        best = np.array([e - c + int(np.argmax(votes[e - c : e])) if c else -1 for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], np.int64)
        return np.where(best >= 0, votes[best] if len(votes) else -1.0, -1.0), best, p

    def scores(self, votes: np.ndarray) -> np.ndarray:
        return np.clip(np.where(votes >= 0, np.interp(votes, *self.steps), self.bare), 0.0, 1.0)

    def evidence(self, p: Passages, best: np.ndarray) -> list[list[dict]]:
        """The nearest examples of the passages ``best`` with their cosines."""
        out: list[list[dict]] = [[] for _ in best]
        have = np.flatnonzero(best >= 0)
        for at in range(0, len(have), BATCH):
            own = have[at : at + BATCH]
            part = p.take(best[own])
            cosines = self.products(part) / np.maximum(part.norms, 1e-30)[:, None]
            top = np.sort(np.argpartition(-cosines, SHOWN - 1, axis=1)[:, :SHOWN], axis=1)
            values = np.take_along_axis(cosines, top, axis=1)
            order = np.argsort(-values, axis=1, kind="stable")
            top, values = np.take_along_axis(top, order, axis=1), np.take_along_axis(values, order, axis=1)
            for k, places, found in zip(own.tolist(), top.tolist(), values.tolist(), strict=True):
                out[k] = [{"id": str(self.ids[x]), "cosine": c, "toxic": int(self.labels[x])} for x, c in zip(places, found, strict=True) if c > 0]
        return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Increasing fit of y by x (pool adjacent violators), as points to interpolate between."""
    if not len(x):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    pools: list[list[float]] = []
    for value in np.unique(x):
        at = x == value
        pools.append([float(y[at] @ w[at]), float(w[at].sum()), value, value])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [pools[-1][0] + top[0], pools[-1][1] + top[1], pools[-1][2], top[3]]
    xs, ys = [], []
    for total, size, low, high in pools:
        for at in sorted({low, high}):
            xs.append(at)
            ys.append(total / size)
    return np.array(xs), np.array(ys)


def build(examples: list[tuple[object, int, list[bytes]]], idf: dict[bytes, float], unknown: float) -> Index:
    """Index of (id, label, words) over all terms of ``idf``; those of many examples have the first numbers."""
    counts = [Counter(words) for _, _, words in examples]
    have = Counter(w for c in counts for w in c)
    many = len(examples) / RARE
    order = sorted(have, key=lambda w: (have[w] < many, -have[w], w))
    dense = sum(n >= many for n in have.values())
    numbers = {w: k for k, w in enumerate(order)}
    weights = np.array([idf[w] for w in order])
    # examples with like terms stand together, so that block maxima are tight: the commonest terms tell the languages apart
    sign = [(tuple(w not in c for w in order[: min(dense, 48)]), str(examples[k][0])) for k, c in enumerate(counts)]
    ranks = sorted(range(len(examples)), key=sign.__getitem__)
    blocks = -(-max(1, len(examples)) // BLOCK)
    postings = np.zeros((blocks, dense, BLOCK), np.float32)
    lists, listed, listed_weights = [], [], []
    for place, k in enumerate(ranks):
        if counts[k]:
            at = np.array([numbers[w] for w in counts[k]])
            own = (1 + np.log(np.array(list(counts[k].values())))) * weights[at]
            own /= np.sqrt(own @ own) or 1
            rare = at >= dense
            postings[place // BLOCK, at[~rare], place % BLOCK] = own[~rare]
            lists.append(at[rare] - dense)
            listed.append(np.full(int(rare.sum()), place))
            listed_weights.append(own[rare])
    whole = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    at = whole(lists, np.int64)
    by_term = np.argsort(at, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(order) - dense))]).astype(np.int64)
    labels = np.zeros(blocks * BLOCK, np.float32)
    labels[: len(ranks)] = [examples[k][1] for k in ranks]
    ids = np.array([examples[k][0] for k in ranks] or [None], object)[: len(ranks)]
    return Index(numbers, weights, unknown, ids, labels, np.argsort(ranks), postings, postings.max(axis=2).T, starts, whole(listed, np.int64)[by_term], whole(listed_weights, float)[by_term])


def _document_counts(rows: DataFrame, terms) -> dict[bytes, int]:
    """Documents that hold each of the broadcast ``terms``; summed within each task first."""

    def run(batches):
        known = terms.value
        totals: Counter = Counter()
        for batch in slices(batches):
            for raw in batch.column(0):
                totals.update(known.intersection(alnum_words(raw.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(totals, pa.binary()), pa.array(totals.values(), pa.int64())], names=["term", "n"])

    # one row a term of the bounded sample
    return {bytes(r.term): r.n for r in rows.mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = EXAMPLES_PER_CLASS) -> Index:
    """Calibrated index of at most ``per_class`` examples of each label; document counts come from all documents."""
    context = docs.sparkSession.sparkContext
    known = labels.filter(train & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = bounded_sample(known, "toxic", "doc_id", per_class).distinct()
    # two classes of at most `per_class` ids: a bounded side
    sample = docs.select("doc_id", as_bytes().alias("raw")).join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "raw")
    # copies of one text are one example, else they would crowd out the other neighbours
    sample = sample.withColumn("raw", F.coalesce("raw", F.lit(b""))).groupBy("raw", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic", "raw")
    examples = [(r.doc_id, r.toxic, alnum_words(bytes(r.raw))) for r in sample.orderBy("doc_id", "toxic", "raw").collect()]  # two classes of `per_class` at most
    have = _document_counts(docs.select(as_bytes().alias("raw")), context.broadcast({w for *_, words in examples for w in words}))
    total = docs.count()
    idf = {w: float(np.log((total + 1) / (have.get(w, 0) + 1))) for *_, words in examples for w in words}
    index = build(examples, idf, float(np.log(total + 1)))
    return calibrate(index, docs, examples, totals)


def calibrate(index: Index, docs: DataFrame, examples: list, totals: dict[int, int]) -> Index:
    """Isotonic steps from leave-one-out votes, each class weighed by how many rows an example stands for."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(index)
    rows = [(int(place), t, b" ".join(words)) for place, (_, t, words) in zip(index.places, examples, strict=True)]

    def run(batches):
        index = shared.value
        for batch in slices(batches):
            votes, _, _ = index.text_votes([x.as_py().split() for x in batch.column(2)], batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(votes)], names=["toxic", "vote"])

    table = spark.createDataFrame(rows, "place long, toxic int, words binary").repartition(max(1, min(64, len(rows) // 32)))
    found = table.mapInArrow(run, "toxic int, vote double").collect()
    truth, votes = np.array([r.toxic for r in found], float), np.array([r.vote for r in found], float)
    size = {c: max(1, int((truth == c).sum())) for c in (0, 1)}
    weight = np.array([totals.get(int(c), 0) / size[int(c)] for c in truth])
    prior = float(np.average(truth, weights=weight)) if len(truth) else 0.0
    bare = votes < 0
    index.bare = float(np.average(truth[bare], weights=weight[bare])) if bare.any() else prior
    index.steps = isotonic(votes[~bare], truth[~bare], weight[~bare])
    return index


def score(docs: DataFrame, labels: DataFrame, per_class: int = EXAMPLES_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row of ``docs``.

    ``evidence`` lists the nearest examples of the text's most toxic passage (id
    as text, cosine, label). A word that no example has lengthens a passage as
    one of no document would, one that all documents have counts nothing. Null, empty and other texts without a word of any
    example score the rate of toxic ones among such examples (all examples if
    there are none). Without any labelled row all scores are 0. Labelled rows
    whose id's crc32 leaves 1 on division by 3 are never learned from. Repeated
    rows each give a row; examples that tie with the last neighbour all vote;
    an id labelled both ways is an example of both; null labels and ids are not
    learned from. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, ~held_out(3, 1), per_class))

    def run(batches):
        index = shared.value
        kind = pa.list_(pa.struct([("id", pa.string()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for batch in slices(batches, 1 << 20):
            votes, best, p = index.text_votes([alnum_words(raw.as_py()) for raw in batch.column(2)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(index.scores(votes)), pa.array(index.evidence(p, best), kind)], names=["doc_id", "held_out", "score", "evidence"])

    rows = docs.select("doc_id", held_out(3, 1).alias("held_out"), as_bytes().alias("raw"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, evidence array<struct<id:string,cosine:double,toxic:int>>")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
