"""Language identification as a multilingual mixture.

A document is a mixture of languages: each n-gram is drawn from language l with
probability w_l times its likelihood there. Expectation-maximisation estimates
the proportions w, and the set of languages is the one with the best penalised
likelihood, found by dropping the weakest language while that pays. Languages
whose joint loss, with the other proportions as they are, is below the penalty
of a single one go together first: fitting the others anew can only lower it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_sample
from .text import as_bytes, slices

#: Labelled documents of each language that the likelihoods are learned from (chosen by id hash).
SAMPLE_PER_LANGUAGE = 1000
BUCKETS = 1 << 16
#: Penalty of one more language in the set, as a factor of log(n-grams); n-grams overlap, hence more than a half.
PENALTY = 2.0
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def grams(raw: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased letters, words set off by single spaces."""
    a = np.frombuffer(b" " + b" ".join(raw.translate(_LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.uint32)
    return ((a[:-2] | a[1:-1] << np.uint32(8) | a[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    #: likelihoods of the buckets, a column each language
    likelihood: np.ndarray

    def mixture(self, p: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions and log-likelihood for n-gram likelihoods ``p`` that occur ``counts`` times."""
        n, w = counts.sum(), np.full(p.shape[1], 1 / p.shape[1])
        if p.shape[1] == 1:
            return w, float(counts @ np.log(p[:, 0]))
        for _ in range(50):
            total = p @ w
            new = w * (p.T @ (counts / total)) / n
            done = np.abs(new - w).max() < 1e-4
            w = new
            if done:
                break
        return w, float(counts @ np.log(p @ w))

    def proportions(self, raw: bytes) -> dict[str, float]:
        """The chosen languages and their shares; empty if the text has no n-gram."""
        buckets, counts = np.unique(grams(raw), return_counts=True)
        if not len(buckets) or not self.languages:
            return {}
        return self.shares(self.likelihood[buckets], counts.astype(np.float64))

    def shares(self, p: np.ndarray, counts: np.ndarray) -> dict[str, float]:
        """The chosen languages and their shares, for n-gram likelihoods ``p`` that occur ``counts`` times."""
        chosen = np.arange(len(self.languages))
        w, fit = self.mixture(p, counts)
        cost = PENALTY * np.log(counts.sum() + 1)
        order, low, high = np.argsort(w, kind="stable"), 0, len(w) - 1
        while low < high:
            half = (low + high + 1) // 2
            rest = order[half:]
            loss = fit - float(counts @ np.log(p[:, rest] @ (w[rest] / w[rest].sum())))
            low, high = (half, high) if loss < cost else (low, half - 1)
        if low:
            chosen = np.sort(order[low:])
            w, fit = self.mixture(p[:, chosen], counts)
        while len(chosen) > 1:
            stay = np.arange(len(chosen)) != np.argmin(w)
            new_w, new_fit = self.mixture(p[:, chosen[stay]], counts)
            if new_fit + cost < fit:
                break
            chosen, w, fit = chosen[stay], new_w, new_fit
        return {self.languages[k]: float(x) for k, x in zip(chosen, w, strict=True)}


def fit(docs: DataFrame, train: Column, sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn the n-gram likelihoods from ``sample`` documents of each language at most.

    Rows where ``train`` does not hold, or without a language, id or text, are
    not used. The counts are taken on the executors; a bucket and language is
    one number on the driver.
    """
    ids = docs.filter(train & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    picked = bounded_sample(ids, "lang", "doc_id", sample).distinct()
    # at most `sample` ids of each language: a bounded side
    texts = docs.select("doc_id", "lang", as_bytes().alias("raw")).join(F.broadcast(picked), ["doc_id", "lang"])

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if raw.is_valid:
                    have = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    have += np.bincount(grams(raw.as_py()), minlength=BUCKETS)
        for lang, have in totals.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(have[at])], names=["lang", "bucket", "n"])

    table = texts.select("lang", "raw").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    languages = sorted(table.lang.unique())
    counts = np.full((BUCKETS, len(languages)), 0.5)
    for k, lang in enumerate(languages):
        rows = table[table.lang == lang]
        counts[rows.bucket.to_numpy(), k] += rows.n.to_numpy()
    return Model(languages, counts / counts.sum(axis=0, keepdims=True) if languages else counts)


def held_out(divisor: int, remainder: int) -> Column:
    """Whether the crc32 of the id's text leaves ``remainder``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor == remainder


def identify(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages) of every row of ``docs``.

    ``languages`` maps the chosen languages to their shares; ``lang_pred`` is
    the largest (ties: the first in order) and ``score`` its share. A null text
    and one without a letter give ``und``, score 0 and no languages; so does
    every text where no labelled row could be learned from. Letters that make
    no n-gram cannot be: a letter always does. Repeated rows each give a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, ~held_out(4, 2), sample))

    def run(batches):
        model = shared.value
        for batch in slices(batches):
            best, scores, shares = [], [], []
            for raw in batch.column(2):
                raw = raw.as_py()
                found = model.proportions(raw) if raw and has_letter(raw.decode("utf-8", "replace")) else {}
                lang = min(found, key=lambda x: (-found[x], x), default="und")
                best.append(lang)
                scores.append(min(1.0, found.get(lang, 0.0)))
                shares.append(list(found.items()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(best, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "held_out", "lang_pred", "score", "languages"])

    rows = docs.select("doc_id", held_out(4, 2).alias("held_out"), as_bytes().alias("raw"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages map<string,double>")
