"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton holds every word substring of the items. Document words stream
through it; after each word the state stands for the longest suffix of the text
so far that some item contains, and its length. A window (``window``
consecutive item words, or a whole shorter item) ends at a word exactly if the
state, or a suffix of it, holds that window.

Items are cut into blocks of bounded size. Each block is one automaton, shipped
to the executors, and one pass over the documents, written before the next one
begins, so that one automaton is held at a time; there is no shuffle.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spool import discard, spool
from .text import ALNUM, ALNUM_WORD, LOWER, UPPER, alnum_words, as_bytes, quoted, slices

WINDOW = 10
#: Words of test items in one automaton (a state holds a few hundred bytes).
BLOCK_WORDS = 500_000


@dataclass
class Automaton:
    """Generalised suffix automaton over word tuples, with the items of each window."""

    window: int = WINDOW
    step: list[dict] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: window state -> items that hold the window; short state -> (length, items)
    found: dict[int, list[tuple[int, set]]] = field(default_factory=dict)
    #: state -> the longest of its suffixes, itself included, with windows
    near: dict[int, int] = field(default_factory=dict)
    least: int = 1 << 62

    def _extend(self, last: int, word: bytes) -> int:
        step, link, length = self.step, self.link, self.length
        if word in step[last]:
            old = step[last][word]
            return old if length[old] == length[last] + 1 else self._split(last, word, old)
        new = self._state(length[last] + 1, {})
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at < 0:
            link[new] = 0
        else:
            old = step[at][word]
            link[new] = old if length[old] == length[at] + 1 else self._split(at, word, old)
        return new

    def _state(self, length: int, step: dict) -> int:
        self.step.append(step)
        self.link.append(0)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, at: int, word: bytes, old: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.step[old]))
        self.link[copy] = self.link[old]
        self.link[old] = copy
        while at >= 0 and self.step[at].get(word) == old:
            self.step[at][word] = copy
            at = self.link[at]
        return copy

    def states(self, words):
        """(state, matched length) after each word; the longest match that ends there."""
        step, link, length = self.step, self.link, self.length
        at = size = 0
        for word in words:
            new = step[at].get(word)
            if new is None:
                while new is None and at:
                    at = link[at]
                    new = step[at].get(word)
                size = length[at] + 1 if new is not None else 0
                at = new or 0
            else:
                at = new
                size += 1
            yield at, size

    @classmethod
    def of(cls, items: list[tuple[object, list[bytes]]], window: int = WINDOW) -> Automaton:
        out = cls(window)
        for _, words in items:
            last = 0
            for word in words:
                last = out._extend(last, word)
        for name, words in items:
            need = min(window, len(words))
            out.least = min(out.least, need)
            for at, size in out.states(words):
                if size >= need:
                    while out.length[out.link[at]] >= need:
                        at = out.link[at]
                    for known, names in out.found.setdefault(at, []):
                        if known == need:
                            names.add(name)
                            break
                    else:
                        out.found[at].append((need, {name}))
        for at in sorted(range(1, len(out.step)), key=out.length.__getitem__):
            own = at if at in out.found else out.near.get(out.link[at])
            if own is not None:
                out.near[at] = own
        return out

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged [start, end) spans of the words inside windows, and the items found."""
        spans: list[tuple[int, int]] = []
        names: set = set()
        step, link, length, found, near, least = self.step, self.link, self.length, self.found, self.near, self.least
        at = size = 0
        for i, word in enumerate(words):
            new = step[at].get(word)
            if new is None:
                while new is None and at:
                    at = link[at]
                    new = step[at].get(word)
                if new is None:
                    size = 0
                    continue
                size = length[at] + 1
            else:
                size += 1
            at = new
            if size >= least:
                most, suffix = 0, near.get(at)
                while suffix is not None:
                    for need, of in found[suffix]:
                        if need <= size:
                            names |= of
                            most = max(most, need)
                    suffix = near.get(link[suffix])
                if most:
                    start = i + 1 - most
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, names


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS):
    """Lists of (item, words), each of about ``block_words`` at most, streamed from the benchmark table.

    Only one block is on the driver at a time. Rows without an id or words are no items.
    """
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), as_bytes().alias("raw")).filter("item is not null and raw is not null")
    block, size = [], 0
    for row in rows.toLocalIterator():
        words = alnum_words(bytes(row.raw))
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row.item, words))
        size += len(words)
    if block:
        yield block


def _merge(spans):
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


_FOUND = [
    T.StructField("_words", T.LongType()),
    T.StructField("_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("_items", T.ArrayType(T.StringType())),
    T.StructField("_new", T.StringType()),
]
_TYPES = [pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string()), pa.string()]


def matches(docs: DataFrame, benchmark: DataFrame, text: str | Column = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``_words`` (count), ``_spans`` ([start, end) of words hit, merged), ``_items`` (found, sorted) and ``_new`` (the text without the spans; null if there are none).

    ``docs`` must not have columns of these names. Null texts have no words.
    """
    start = docs.select("*", as_bytes(text).alias("_raw"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in _FOUND])
    old = start.schema.fields[: -len(_FOUND)]
    schema = T.StructType([*old, *_FOUND])

    def one_pass(df: DataFrame, automaton: Automaton) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(automaton)
        n, names = len(old), schema.names

        def run(batches):
            search = shared.value.match
            for batch in slices(batches):
                out = [[], [], [], []]
                raws, old_spans, old_items = (batch.column(k) for k in (n - 1, n + 1, n + 2))
                for raw, spans, items in zip(raws, old_spans, old_items, strict=True):
                    raw = raw.as_py()
                    words = alnum_words(raw)
                    hit, who = search(words)
                    if spans.is_valid:
                        hit = _merge([*hit, *map(tuple, spans.as_py())])
                        who = who.union(items.as_py())
                    hit = [list(x) for x in hit]
                    for have, new in zip(out, (len(words), hit, sorted(who), cut(raw, hit).decode("utf-8", "replace") if hit else None), strict=True):
                        have.append(new)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(x, kind) for x, kind in zip(out, _TYPES, strict=True))], names=names)

        return df.mapInArrow(run, schema)

    found, waiting = start, None
    for block in item_blocks(benchmark, block_words):
        if waiting is not None:
            written = spool(one_pass(found, waiting), "matches")
            if found is not start:
                discard(found)
            found = written
        waiting = Automaton.of(block, window)
    return one_pass(found, waiting or Automaton.of([], window)).drop("_raw")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``.

    Null and wordless texts have zero words and are clean. Repeated rows each
    give a row; repeated items count once by id. Item ids are compared and
    sorted as strings; no item gives the digest of the empty string. An empty
    benchmark leaves every document clean.
    """
    found = matches(docs.select("doc_id", F.col("text").alias("_text")), benchmark, "_text", window, block_words)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + (F.get(s, 1) - F.get(s, 0)))
    return found.select(
        "doc_id",
        F.col("_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def cut(raw: bytes, spans: list[list[int]]) -> bytes:
    """The text without the words of ``spans`` and what stands between them."""
    flat = raw.translate(ALNUM)
    out, at, word, kept = [], 0, 0, 0
    for start, end in spans:
        while word < start:
            at = _next_word(flat, at)[1]
            word += 1
        first = _next_word(flat, at)[0]
        while word < end:
            at = _next_word(flat, at)[1]
            word += 1
        out.append(raw[kept:first])
        kept = at
    return b"".join([*out, raw[kept:]])


def _next_word(flat: bytes, at: int) -> tuple[int, int]:
    while flat[at] == 32:
        at += 1
    end = flat.find(b" ", at)
    return at, len(flat) if end < 0 else end


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the spans that test items hold; all columns of the input, in order.

    A document with more than ``max_coverage`` of its words hit goes whole.
    ``n_chars``, where the input has it, is recomputed. Null texts stay null.
    """
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))
    found = matches(packed, benchmark, F.col("_row.text"), window, block_words)

    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + (F.get(s, 1) - F.get(s, 0)))
    stay = found.filter(hit <= max_coverage * F.col("_words")).withColumn("_new", F.when(F.size("_spans") > 0, F.col("_new")).otherwise(F.col("_row.text")))
    changed = {"text": F.col("_new"), "n_chars": F.when(F.size("_spans") > 0, F.length("_new").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    return stay.select(*[changed[c].alias(c) if changed.get(c) is not None else F.col("_row")[c].alias(c) for c in docs.columns])


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def duckdb_sql(window: int = WINDOW) -> str:
    """``report`` in DuckDB SQL: every window of the items joined to the documents' windows of the same length."""
    words = lambda text: f"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), {quoted(ALNUM_WORD)})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words('text')} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS key FROM (
  SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM (SELECT item, w, least(len(w), {window}) AS n FROM b WHERE len(w) > 0))),
k AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS key FROM (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
m AS (SELECT r, n, p, item FROM k JOIN i USING (n, key)),
h AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS place FROM (SELECT DISTINCT r, n, p FROM m)) GROUP BY r),
x AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN x USING (r)"""
