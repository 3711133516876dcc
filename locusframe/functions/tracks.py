"""Tracks of values by position: merging, tiles, both strands."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.session import importable

#: What a position without any larger value has in the older format.
FLOOR = math.log(1e-3)
#: Tiles that a task paints at once.
TILES_AT_ONCE = 64


def largest(track: DataFrame, keys: Sequence[str], value: str, floor: float = FLOOR) -> DataFrame:
    """The largest value at each place, ``floor`` at least."""
    return track.groupBy(*keys).agg(F.greatest(F.lit(floor), F.max(value)).alias(value))


def painted(rows: DataFrame, keys: Sequence[str], size: int, values: Sequence[str], empty: Sequence[float]) -> DataFrame:
    """(keys, values): arrays of ``size`` doubles for each tile (keys), in which rows (keys, low, high, values) fill the places from ``low`` to
    ``high`` (from 0); ``empty`` elsewhere and for nulls. Rows of a tile should not overlap, so that a tile has ``size`` of them at most."""
    own = rows.groupBy(*keys).agg(F.collect_list(F.struct(F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), *(F.col(v).cast("double").alias(v) for v in values))).alias("own"))

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, TILES_AT_ONCE):
                batch = whole.slice(i, TILES_AT_ONCE)
                row = batch["own"].value_parent_indices().to_numpy()
                low, high, *held = batch["own"].flatten().flatten()
                low, high = low.to_numpy(), high.to_numpy()
                count = high - low + 1
                at = np.repeat(np.arange(len(row)), count)
                place = row[at] * size + np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
                arrays = []
                for column, e in zip(held, empty, strict=True):
                    flat = np.full(batch.num_rows * size, float(e))
                    flat[place] = pc.fill_null(column, float(e)).to_numpy(zero_copy_only=False)[at]
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32)), pa.array(flat)))
                yield pa.record_batch([*(batch[k] for k in keys), *arrays], [*keys, *values])

    importable(rows.sparkSession)
    kinds = dict(own.dtypes)
    return own.mapInArrow(paint, ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"`{v}` array<double>" for v in values]))


def track_tiles(track: DataFrame, lengths: DataFrame, keys: Sequence[str], values: Sequence[str], size: int, empty: Sequence[float]) -> DataFrame:
    """(keys, tile, values): arrays of ``size`` for each whole tile of sequences (keys, length); ``empty`` where no value is.

    Positions count from 0; each has one row of ``track`` at most. A sequence's last, shorter tile is left out.
    """
    tiles = lengths.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / size) - 1))) if size else lengths
    tiles = tiles.where(F.col("length") >= size).select(*keys, "tile")
    place = F.pmod("pos", F.lit(size))
    rows = track.select(*keys, F.floor(F.col("pos") / size).alias("tile"), place.alias("low"), place.alias("high"), *values)
    full = tiles.join(painted(rows, [*keys, "tile"], size, values, empty), [*keys, "tile"], "left")
    none = {v: F.coalesce(v, F.array_repeat(F.lit(float(e)), size)) for v, e in zip(values, empty, strict=True)}
    return full.withColumns(none).select(*keys, "tile", *values)


def both_strands(tiles: DataFrame, swaps: Sequence[tuple[str, str]], last: int) -> DataFrame:
    """Tiles as they are (strand +), and read backwards (-): tiles numbered from the end, ``last`` being the highest number,
    positions reversed, and each pair of columns exchanged."""
    other = {a: b for a, b in swaps} | {b: a for a, b in swaps}
    kinds = dict(tiles.dtypes)
    turned = [F.reverse(other.get(c, c)).alias(c) if kinds[c].startswith("array") else (F.lit(last) - F.col(c)).alias(c) if c == "tile" else F.col(c) for c in tiles.columns]
    return tiles.withColumn("strand", F.lit("+")).unionByName(tiles.select(*turned).withColumn("strand", F.lit("-")))
