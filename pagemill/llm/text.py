"""Shared expressions over document text, and a carrier for rows with columns of any name."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def boxed(frame: DataFrame, **columns: Column) -> DataFrame:
    """All columns of a row in one struct ``row``, beside computed columns that may bear any name."""
    return frame.select(F.struct(*(F.col(quoted(c)) for c in frame.columns)).alias("row"), *(c.alias(n) for n, c in columns.items()))


def unboxed(frame: DataFrame, columns: list[str]) -> DataFrame:
    return frame.select(*(F.col("row")[c].alias(c) for c in columns))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(quoted(name)), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def count_of(text: Column, kept: str) -> Column:
    """Code points left when every run outside the class ``kept`` is taken away."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", ""))


def chunks(batches: Iterable[pa.RecordBatch], key: str, text: str, size: int = 2_000_000) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and UTF-8 texts (null: empty) in runs of about ``size`` bytes, never less than a row."""
    keys, texts, total = [], [], 0
    for batch in batches:
        ids, column = batch.column(batch.schema.get_field_index(key)), batch.column(batch.schema.get_field_index(text))
        for at in range(batch.num_rows):
            value = column[at].as_py() or ""
            data = value.encode()
            keys.append(ids[at].as_py())
            texts.append(data)
            total += len(data)
            if total >= size:
                yield keys, texts
                keys, texts, total = [], [], 0
    if keys:
        yield keys, texts
