"""Quality rules by line-first cleaning, in DataFrame functions only.

Each line is judged on its own by punctuation, symbol, navigation and
boilerplate rules; failing lines are removed, and a document that loses too
much of its text that way (or fails the base rules) is rejected. All work is
done inside the row: there is no shuffle, so no key can be hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, WORD, quoted


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules; every one applies to a single line or document."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: share of a line's characters that may be symbols ``#*$%&|<>``
    max_symbols: float = 0.02
    #: share of a line's characters that may stand in runs of exclamation and question marks
    max_shouts: float = 0.05
    #: separators ``|``, ``>>`` or ``»`` from which a line counts as navigation
    min_separators: int = 4
    #: share of its characters that a document may lose to the line rules
    max_lost: float = 0.3


#: A line that holds one of these, in any case, is boilerplate.
BOILERPLATE = (
    r"(?i)(?:enable javascript|javascript is (?:disabled|required)|cookie policy|privacy policy|terms of (?:use|service)"
    r"|we use cookies|accept all cookies|sign in to|log in to continue|subscribe to our|click here to|lorem ipsum"
    r"|all rights reserved)"
)


def _chars(text: Column, cls: str) -> Column:
    """Number of characters of ``text`` that matches of ``cls`` hold."""
    return F.length(text) - F.length(F.regexp_replace(text, cls, ""))


_SEPARATOR = r"(\||>>|»)"
#: End of a sentence: a stop before white space, a closing mark or the line's end, or one of a script without spaces there.
_END = r"""[.!?…]["'»”’)\]]*(?:[\x20\x09-\x0D]|$)|[。！？｡।॥؟۔։።]"""
#: What a line must hold to fail a rule; a text without it needs no look at its lines.
_HINTS = {"_symbol": r"[#*$%&|<>]", "_shout": r"[!?]{2}", "_nav": _SEPARATOR, "_boiler": BOILERPLATE}


def line_passes(line: Column, rules: LineRules) -> Column:
    """Whether a line survives. Lines without a word pass (they are only layout).

    The columns of ``_HINTS`` say what the whole text holds, so
    that the dearer patterns run only where they can match.
    """
    unfinished = ~line.rlike(_END)
    symbols = F.col("_symbol") & (_chars(line, r"[#*$%&|<>]+") > rules.max_symbols * F.length(line))
    shouts = F.col("_shout") & (_chars(line, r"[!?]{2,}") > rules.max_shouts * F.length(line))
    navigation = F.col("_nav") & line.rlike(_SEPARATOR + f"(.*?{_SEPARATOR})" + f"{{{rules.min_separators - 1}}}")
    boilerplate = F.col("_boiler") & line.rlike(BOILERPLATE)
    return ~line.rlike(WORD) | ~(unfinished | symbols | shouts | navigation | boilerplate)


def _steps(df: DataFrame, rules: LineRules) -> DataFrame:
    """Adds the measures step by step, so that each array is built once.

    A 3-word window is a 64-bit hash chained over its words. Where a document
    has equal hashes, sorting (hash, index) pairs puts equal windows side by
    side; the starts of windows with an equal neighbour, in order, give the
    words they cover, the first included.
    """
    df = df.withColumns({"_t": F.coalesce(F.col("_text"), F.lit(""))})
    df = df.withColumns(
        {
            "_words": F.array_remove(F.split("_t", SPACE + "+"), ""),
            "_lines": F.split("_t", "\n"),
            **{name: F.col("_t").rlike(pattern) for name, pattern in _HINTS.items()},
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": _chars(F.col("_t"), r"[#*$%&|<>]+").cast("long"),
            "_hashes": F.when(
                F.size("_words") >= 3,
                F.transform(
                    F.sequence(F.lit(0), F.size("_words") - 3),
                    lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
                ),
            ),
            "_full_lines": F.filter("_lines", lambda x: x.rlike(WORD)),
            "_kept_text": F.array_join(F.filter("_lines", lambda x: line_passes(x, rules)), "\n"),
        }
    )
    df = df.withColumns(
        {
            "n_dup_lines": (F.size("_full_lines") - F.size(F.array_distinct("_full_lines"))).cast("long"),
            "_windows": F.when(
                F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
                F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        }
    )
    same = lambda x, j: (F.get("_windows", j - 1)["h"] == x["h"]) | (F.get("_windows", j + 1)["h"] == x["h"])
    df = df.withColumns({"_starts": F.sort_array(F.transform(F.filter("_windows", same), lambda x: x["i"]))})
    gaps = F.transform("_starts", lambda v, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), v - F.get("_starts", k - 1))))
    df = df.withColumns(
        {"n_repeat_words": F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long")}
    )
    base = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    lost = F.length("_t") - F.length("_kept_text") > rules.max_lost * F.length("_t")
    df = df.withColumns({"base_failed": base}).withColumns({"kept": ~F.col("base_failed") & ~lost, "n_kept_chars": F.length("_kept_text").cast("long")})
    # a filter on a measure must not be pushed below: it would repeat the arrays once for each use of them.
    # The row's place is not deterministic to the optimizer and so stops it.
    whole = F.struct(*MEASURES, "n_kept_chars", "_kept_text")
    return df.withColumn("_place", F.monotonically_increasing_id()).withColumn("_all", F.when(F.col("_place") >= 0, whole))


def duckdb_sql(rules: LineRules = LineRules()) -> str:
    """``judge`` in DuckDB SQL, without ``n_kept_chars``: windows as text, lines one by one."""
    held = lambda text, cls: f"(length({text}) - length(regexp_replace({text}, {quoted(cls)}, '', 'g')))"
    navigation = _SEPARATOR + f"(.*?{_SEPARATOR})" + f"{{{rules.min_separators - 1}}}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, regexp_extract_all(t, {quoted(WORD)}) AS w, string_split(t, chr(10)) AS lines FROM d),
g AS (SELECT r, p, array_to_string(w[p:p + 2], ' ') AS key FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM s)),
q AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(p, p + 3)) AS place FROM (
  SELECT r, p, count(*) OVER (PARTITION BY r, key) AS k FROM g) WHERE k > 1) GROUP BY r),
l AS (SELECT r, unnest(lines) AS line FROM s),
p AS (SELECT r, line, NOT regexp_matches(line, {quoted(WORD)}) OR (regexp_matches(line, {quoted(_END)}) AND {held('line', '[#*$%&|<>]+')} <= {rules.max_symbols} * length(line)
  AND {held('line', '[!?]{2,}')} <= {rules.max_shouts} * length(line) AND NOT regexp_matches(line, {quoted(navigation)}) AND NOT regexp_matches(line, {quoted(BOILERPLATE)})) AS passes FROM l),
k AS (SELECT r, coalesce(sum(length(line)) FILTER (WHERE passes), 0) + greatest(count(*) FILTER (WHERE passes) - 1, 0) AS chars FROM p GROUP BY r),
f AS (SELECT r, list_filter(lines, lambda x: regexp_matches(x, {quoted(WORD)})) AS own FROM s),
v AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({held('t', '[#*$%&|<>]+')} AS BIGINT) AS n_symbols,
  CAST(len(own) - len(list_distinct(own)) AS BIGINT) AS n_dup_lines, CAST(coalesce(q.n, 0) AS BIGINT) AS n_repeat_words, length(t) - k.chars > {rules.max_lost} * length(t) AS lost
  FROM s JOIN f USING (r) JOIN k USING (r) LEFT JOIN q USING (r)),
z AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT lost AS kept FROM z"""


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judge(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """``doc_id`` and the measures and verdict of every row, plus ``n_kept_chars``.

    A null text counts as empty: no words, all counts zero, ``base_failed``.
    Every input row gives one row, repeated rows and null ids included; other
    columns of the input are ignored, whatever their names.
    """
    df = docs.select("doc_id", F.col("text").cast("string").alias("_text"))
    return _steps(df, rules).select("doc_id", *[F.col("_all")[c].alias(c) for c in (*MEASURES, "n_kept_chars")])


def clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The kept documents without their failing lines; all columns of the input, in order.

    ``n_chars``, where the input has it, is recomputed. A null text is rejected
    like an empty one. Columns that clash with the working names are safe: the
    input's columns travel in one struct.
    """
    df = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.col("text").cast("string").alias("_text"))
    df = _steps(df, rules).filter(F.col("_all.kept"))
    changed = {"text": F.col("_all._kept_text"), "n_chars": F.col("_all.n_kept_chars")}
    return df.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
