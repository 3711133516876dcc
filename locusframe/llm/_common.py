"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.session import fresh_path, importable

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Rows of a file of small rows.
ROWS_A_FILE = 250_000


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut and a lost executor loses nothing.

    If it has some ``rows`` at most, of few bytes each, it is written in no more files than these need.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    spark = df.sparkSession
    importable(spark)
    path = fresh_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is (``lower`` alone follows Unicode)."""
    only_ascii = F.octet_length(text) == F.length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; looks at no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is (a shuffle join follows)."""
    return F.broadcast(df) if small_enough(df, rows) else df


def drawn(wanted: int, of: int, salt: str, *key: str | Column) -> Column:
    """Whether a row is in a sample of about ``wanted`` of ``of`` rows: its key's 64-bit hash is below that share of all hashes."""
    if wanted >= of:
        return F.lit(True)
    return F.xxhash64(*key, F.lit(salt)) < F.lit((wanted << 64) // of - (1 << 63))


def sampled(df: DataFrame, wanted: int, of: int, salt: str, *key: str) -> DataFrame:
    """At most ``wanted`` distinct rows of ``df``, which has ``of``: those of the least hashes of ``key``, whatever the file layout.

    Equal rows are drawn together and count once, so no repeated row fills the sample.
    """
    some = df.where(drawn(wanted + 6 * int(wanted**0.5) + 6, of, salt, *key)).distinct()
    return some.orderBy(F.xxhash64(*key, F.lit(salt)), *key).limit(wanted)


def in_parts(batch: pa.RecordBatch, text: int, most_bytes: int = 8 << 20, most_rows: int = 4_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts (column ``text``) have ``most_bytes`` together, or of a single longer one."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    i = 0
    while i < len(size):
        n = int(np.searchsorted(np.cumsum(size[i : i + most_rows]), most_bytes, side="right"))
        yield batch.slice(i, max(1, n))
        i += max(1, n)
