"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from .text import table


def op9_quality_rules(spark, sf_dir):
    """Base measures and verdict of every document. Null texts have no words; repeated rows each give a row; an empty table gives none."""
    from . import quality

    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", *quality.MEASURES)


def op1_line_dedup(spark, sf_dir):
    """Lines of every document that repeat an earlier one, with their classes. Null texts have one blank line; the later of repeated rows loses its lines."""
    from . import lines

    return lines.report(table(spark, sf_dir, "documents"))


def op2_simhash(spark, sf_dir):
    """Fingerprint and class of every document. Null, empty and blank texts have fingerprint zero; repeated rows each give a row."""
    from . import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    """Words of every document inside windows of benchmark items. Null texts have no words; repeated items count once by id."""
    from . import decontam

    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_best_fit_packing(spark, sf_dir):
    """Bin and offset of every piece of every document; near copies never share a bin. Null and empty texts give a piece of no words in no bin."""
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"), near=True)


def op8_url_filters(spark, sf_dir):
    """Host, path, rule and verdict of every page. Null urls and those without a scheme have empty parts and are blocked."""
    from . import urls

    return urls.judge(table(spark, sf_dir, "pages"))


def op7_license_scans(spark, sf_dir):
    """License phrases and notices in every document. Null texts have no words; without a place the first and last word are null."""
    from . import licenses

    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op10_language_id(spark, sf_dir):
    """Language of every document by its mixture. Null texts and those without a letter are und with score 0; of equal shares the first language wins."""
    from . import langid

    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op4_toxicity(spark, sf_dir):
    """Toxicity score of every document. Texts without a known word, null and empty ones too, score the rate of such examples."""
    from . import toxicity

    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_repeated_strings(spark, sf_dir):
    """Bytes of every document in 400-byte strings that also start elsewhere. Null texts are empty; the strings of repeated rows all go."""
    from . import repeats

    found = repeats.removals(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql():
    from . import decontam, quality, urls

    return {"op3_decontamination": decontam.duckdb_sql(), "op8_url_filters": urls.duckdb_sql(), "op9_quality_rules": quality.duckdb_sql()}
