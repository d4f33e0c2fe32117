"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, decontamination, packing.

Every stage takes tables with null ids and texts, empty and very long texts,
repeated rows, other columns of any name, and no rows at all; what it makes of
them is said at each.
"""

from __future__ import annotations

from silvan.llm import decontam, lines, packing, quality, simhash
from silvan.llm.spool import discard, spool
from silvan.llm.text import table


def quality_rules(spark, docs, sf_dir):
    """Rejected documents go; the others lose their failing lines.

    Null, empty and other texts of fewer than 50 words are rejected. Rows are
    judged one by one: repeated ones share their fate, and there are no ties.
    """
    return quality.clean(docs)


def line_dedup(spark, docs, sf_dir):
    """Lines that repeat an earlier one, exactly or within the edits their length allows, go; every document stays.

    Earlier is by doc_id (null last), then place in the table, then line, so a
    repeated row keeps its lines once. Null texts stay null, blank lines stay.
    """
    return lines.clean(docs)


def simhash_near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate class stays, that with the least doc_id.

    Among equal ids the first place in the table stays, a null id only where no
    other is. Null, empty and blank texts are one class.
    """
    return simhash.one_of_each(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Benchmark passages are cut out; documents that consist mostly of them go.

    Null and empty texts stay as they are. Repeated items count once; an empty
    benchmark changes nothing. Rows are judged one by one.
    """
    return decontam.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark, docs, sf_dir):
    """One row per packed sequence: its documents, pieces and offsets.

    Null, empty and blank texts are in no sequence; repeated rows are never in
    the same one. Pieces of equal length come in the order of their places, and
    of equally tight bins the oldest is taken.
    """
    return packing.bins(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The stages cannot be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each but the last is written as Parquet and reread by the next.

    A stage's table is deleted once the next one is written.
    """
    docs, written = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = spool(docs, name)
            if written is not None:
                discard(written)
            written = docs
    return docs
