"""License scans by diagonal voting.

All rolling word pairs of all documents are joined, by hash, to their places in
the templates. A match votes for the diagonal (document place minus template
place). An exact phrase fills its diagonal; a longer template may be edited, so
neighbouring diagonals are merged into bands of bounded width, which bounds the
span too. A band is verified by its longest chain of matches that rise in both
the document and the template: the share of the template's pairs it holds.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import alnum_words, as_bytes, slices

#: Phrase and label: fixed values.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Longer notices and their labels, matched with edits (texts of public licences: fixed values).
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
)

#: Diagonals this far apart at most make up a band (words added or left out in between).
MAX_SHIFT = 3
#: Share of a template's pairs that a span must hold.
MIN_COVERAGE = 0.7
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def pair_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each pair of neighbouring words."""
    if len(words) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    mixed = one ^ (one >> np.uint64(29))
    first = one[:-1] * _ODD[0] + one[1:]
    second = mixed[:-1] * _ODD[1] ^ (mixed[1:] + _ODD[0])
    return first.view(np.int64), second.view(np.int64)


def _template_rows(spark, phrases, templates) -> DataFrame:
    """(h, check, tid, tpos) for each pair of each template, a stated, small set, and one row that rows' heads meet."""
    rows = [(0, 0, -1, 0)]
    for tid, (text, _, _) in enumerate(_numbered(phrases, templates)):
        first, second = pair_hashes(alnum_words(text.encode()))
        rows += [(int(h), int(c), tid, k) for k, (h, c) in enumerate(zip(first, second, strict=True))]
    return spark.createDataFrame(rows, "h long, check long, tid int, tpos int")


def _numbered(phrases, templates) -> list[tuple[str, str, bool]]:
    """(text, label, whether it must stand there word by word) of each template."""
    return [(text, label, True) for text, label in phrases] + [(text, label, False) for label, text in templates]


def chain(matches: list[tuple[int, int]]) -> int:
    """Length of the longest chain of (document place, template place) that rises in both."""
    least: list[int] = []
    for _, place in sorted(matches, key=lambda m: (m[0], -m[1])):
        at = bisect_left(least, place)
        least[at : at + 1] = [place]
    return len(least)


def bands(diagonals: dict[int, list[int]], pairs: int) -> list[tuple[int, int, float]]:
    """(first, last, coverage) of the verified spans of one template; ``diagonals`` has the template places matched on each.

    Every diagonal starts a band of it and the next ``MAX_SHIFT``. Of bands
    that share a diagonal the one with the best coverage stays, then the first.
    """
    found = []
    for low in diagonals:
        own = [(d + t, t) for d in range(low, low + MAX_SHIFT + 1) for t in diagonals.get(d, ())]
        if len(own) >= MIN_COVERAGE * pairs:
            coverage = chain(own) / pairs
            if coverage >= MIN_COVERAGE:
                found.append((-coverage, low, min(own)[0], max(own)[0]))
    out, taken = [], []
    for less, low, first, last in sorted(found):
        if all(abs(low - other) > MAX_SHIFT for other in taken):
            taken.append(low)
            out.append((first, last, -less))
    return sorted(out)


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row of ``docs``.

    ``spans`` lists (label, base, first, last, coverage): the words where a
    span's first and last pairs start. A null text counts as empty. Without a
    base place, ``n_base`` is 0, the words null and ``base_labels`` the empty
    string. ``labels`` adds those of the templates; ``score`` is the best
    coverage, 0 without any span. Repeated rows each give a row; other columns
    are ignored. Rows are numbered in the one pass that reads them.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("place"), "doc_id", as_bytes().alias("raw"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    every = _numbered(phrases, templates)
    sizes = [len(alnum_words(text.encode())) - 1 for text, _, _ in every]

    def hashed(batches):
        """Rows of pair hashes, for long texts several; before them each text's head, with pair 0 at place -1."""
        for batch in slices(batches, 2 << 20):
            owners, words, starts, firsts, seconds = [], [], [], [], []
            for k, raw in enumerate(batch.column(2)):
                found = alnum_words(raw.as_py())
                first, second = pair_hashes(found)
                zero = np.zeros(1, np.int64)
                parts = [(-1, zero, zero)] + [(at, first[at : at + (1 << 16)], second[at : at + (1 << 16)]) for at in range(0, len(first), 1 << 16)]
                for at, one, two in parts:
                    owners.append(k)
                    words.append(len(found) if at < 0 else None)
                    starts.append(at)
                    firsts.append(one)
                    seconds.append(two)
            lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *x])) for x in (firsts, seconds)]
            at = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(words, pa.int64()), pa.array(starts, pa.int64()), *lists], names=["place", "doc_id", "n_words", "at", "h", "c"])

    arrays = rows.mapInArrow(hashed, f"place long, doc_id {kind}, n_words long, at long, h array<long>, c array<long>")
    grams = arrays.select("place", "doc_id", "n_words", "at", F.posexplode(F.arrays_zip("h", "c")).alias("k", "g")).select("place", "doc_id", "n_words", (F.col("at") + F.col("k")).alias("pos"), F.col("g.h").alias("h"), F.col("g.c").alias("c"))
    known = F.broadcast(_template_rows(docs.sparkSession, phrases, templates))
    votes = (
        grams.join(known, "h")
        .filter("c = check")
        .groupBy("place", "tid", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .agg(F.collect_set("tpos").alias("held"), F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"))
    )
    # a row's votes are no more than its words
    per_row = votes.groupBy("place").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list(F.when(F.col("tid") >= 0, F.struct("tid", "diagonal", "held"))).alias("votes")
    )

    def verified(batches):
        span = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())])
        for batch in slices(batches):
            out = [[] for _ in range(7)]
            for votes in batch.column(3).to_pylist():
                by_template: dict[int, dict[int, list[int]]] = {}
                for v in votes:
                    by_template.setdefault(v["tid"], {})[v["diagonal"]] = v["held"]
                spans = []
                for tid, diagonals in sorted(by_template.items()):
                    _, label, base = every[tid]
                    if base:
                        found = [(d, d + sizes[tid] - 1, 1.0) for d, held in sorted(diagonals.items()) if len(held) == sizes[tid]]
                    else:
                        found = bands(diagonals, sizes[tid])
                    spans += [{"label": label, "base": base, "first": x, "last": y, "coverage": c} for x, y, c in found]
                places = [s["first"] for s in spans if s["base"]]
                names = lambda own: ",".join(sorted({s["label"] for s in own}))
                values = (len(places), min(places, default=None), max(places, default=None), names(s for s in spans if s["base"]), names(spans), max((s["coverage"] for s in spans), default=0.0), spans)
                for have, new in zip(out, values, strict=True):
                    have.append(new)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return per_row.mapInArrow(verified, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,base:boolean,first:long,last:long,coverage:double>>")
