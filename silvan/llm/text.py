"""Byte-level text helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z; every ASCII byte that is neither a digit nor a letter to a space.
#: Bytes of non-ASCII characters stay, so splitting at spaces gives the maximal
#: runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

#: ASCII white space, as the character class of the word definitions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The words of ``alnum_words``, as a pattern over the lower-cased text.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(value: str) -> str:
    """``value`` as a SQL string."""
    return "'" + value.replace("'", "''") + "'"


def alnum_words(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the A-Z lower-cased text; null has none."""
    return raw.translate(ALNUM).split() if raw else []


def as_bytes(column: str | Column = "text") -> Column:
    """The column's text as UTF-8 bytes, for Arrow transfer without decoding."""
    return (F.col(column) if isinstance(column, str) else column).cast("string").cast("binary")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, max_bytes: int = 8 << 20):
    """Cut record batches so that none holds more than about ``max_bytes`` (single rows aside)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * max_bytes / max(batch.nbytes, max_bytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
