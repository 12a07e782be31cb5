"""Helpers that several training-data operators share."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shared import fresh_dir, remove, small_batches, written  # noqa: F401

#: Word separators of the contracts: space and the five ASCII control blanks.
BLANKS = "\t\n\x0b\x0c\r"


#: Writes a table and reads it back; it stays until the driver ends.
materialise = written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The ``[^\\x20\\x09-\\x0D]+`` words of a text; null gives an empty array.

    Blanks are mapped to one character first, so that the split has a
    one-character pattern, for which the JVM needs no regular expression.
    """
    flat = text
    for blank in BLANKS:
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    return F.coalesce(F.array_remove(F.split(flat, " "), ""), F.array().cast("array<string>"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def window_hash(w: Column, i: Column, size: int) -> Column:
    """The 64-bit hash of ``size`` array elements from ``i`` (from 0) on.

    Elements are read one by one: ``slice`` would copy the whole array each time.
    """
    return F.xxhash64(*(F.get(w, i + k) for k in range(size)))


class Scratch:
    """Intermediate tables of one computation, deleted once its result is written."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, []

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """``written``, until ``clear``."""
        self.paths.append(fresh_dir(self.spark, f"{self.label}-{label}"))
        return written(df, label, self.paths[-1])

    def clear(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths.clear()


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or plain path; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if os.path.isabs(uri) else None


def text_runs(texts: pa.Array, most_rows: int = 256, most_bytes: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """A text column as runs of rows: the first row's place and the texts.

    A run ends at ``most_rows`` or before ``most_bytes``, unless one text is longer.
    """
    ends = np.cumsum(np.nan_to_num(np.asarray(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), float)))
    row, before = 0, 0.0
    while row < len(texts):
        stop = min(row + most_rows, max(row + 1, int(np.searchsorted(ends, before + most_bytes, "right"))))
        yield row, texts.slice(row, stop - row).to_pylist()
        row, before = stop, ends[stop - 1]
