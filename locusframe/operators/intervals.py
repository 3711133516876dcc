"""Interval algebra on inclusive coordinates. Every operator works by coordinate bins, so that one long
sequence with a large share of the rows is many tasks, not one."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.session import stored

BIN = 1 << 14


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, value: Column, out: str, how: str, width: int = BIN) -> DataFrame:
    """Adds a running aggregate in coordinate order: ``how`` is "max" (of all earlier rows) or "sum" (up to this row).

    The window runs inside bins of ``width``; what earlier bins hold comes from one row a bin. The rows are stored once,
    as they are read for both.
    """
    return running_all(df, keys, order, start, {out: value}, how, width)


def running_all(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, values: Mapping[str, Column], how: str, width: int = BIN) -> DataFrame:
    """``running`` for several values (by the columns' names) at once."""
    return _carried(stored(df.withColumn("_bin", F.floor(F.col(start) / width))), keys, order, values, how).drop("_bin")


def _carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column], how: str) -> DataFrame:
    """``running_all`` on a stored table with its bins."""
    fn = F.max if how == "max" else F.sum
    all_, before_, inside_ = ([f"_{x}_{i}" for i in range(len(values))] for x in ("all", "before", "inside"))
    bins = df.groupBy(*keys, "_bin").agg(*(fn(v).alias(a) for v, a in zip(values.values(), all_, strict=True)))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*keys, "_bin", *(fn(a).over(before).alias(b) for a, b in zip(all_, before_, strict=True)))
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if how == "max" else 0)
    both = df.withColumns({i: fn(v).over(inside) for v, i in zip(values.values(), inside_, strict=True)}).join(bins, [*keys, "_bin"])
    merged = (lambda i, b: F.greatest(i, b)) if how == "max" else (lambda i, b: F.col(i) + F.coalesce(b, F.lit(0)))
    return both.withColumns({out: merged(i, b) for out, i, b in zip(values, inside_, before_, strict=True)}).drop(*inside_, *before_)


def with_cluster(df: DataFrame, keys: Sequence[str], order: Sequence[str], gap: int = 0, width: int = BIN, out: str = "cluster") -> DataFrame:
    """Numbers groups of overlapping rows from 1 in each key; rows up to ``gap`` apart join too (1: adjacent ones).

    The rows are stored once. What earlier bins reach, and how many groups begin in them, comes from one row a bin, found from the keys
    and ends alone; then one shuffle and sort of whole rows serves both windows.
    """
    table = stored(df.withColumn("_bin", F.floor(F.col("start") / width)))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order)
    reach = stored(table.groupBy(*keys, "_bin").agg(F.max("stop").alias("_all")).select(*keys, "_bin", F.max("_all").over(earlier).alias("_before")))

    def flagged(rows: DataFrame) -> DataFrame:
        upto = F.greatest(F.max("stop").over(inside.rowsBetween(Window.unboundedPreceding, -1)), "_before")
        new = F.when(F.col("_upto").isNull() | (F.col("start") > F.col("_upto") + gap), 1).otherwise(0).cast("long")
        return rows.withColumn("_upto", upto).withColumn("_new", new)

    slim = table.select(*dict.fromkeys([*keys, "_bin", "start", "stop", *order]))
    begun = flagged(slim.join(reach, [*keys, "_bin"])).groupBy(*keys, "_bin").agg(F.sum("_new").alias("_all"))
    begun = begun.select(*keys, "_bin", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_begun"))
    rows = flagged(table.join(reach.join(begun, [*keys, "_bin"]), [*keys, "_bin"]))
    number = F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_begun")
    return rows.withColumn(out, number).drop("_upto", "_new", "_before", "_begun", "_bin")


def merged(df: DataFrame, keys: Sequence[str], gap: int = 1, width: int = BIN) -> DataFrame:
    """The union of the rows' intervals in each key, as disjoint intervals; adjacent ones are joined."""
    numbered = with_cluster(df.select(*keys, "start", "stop").distinct(), keys, ["start", "stop"], gap, width)
    return numbered.groupBy(*keys, "cluster").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("cluster")


def _binned(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))


def fitting_width(*tables: DataFrame) -> int:
    """A width of bins for rows (start, stop): a power of two not below the mean length of any of the tables, so a row is in about two bins
    and a bin holds few rows that don't overlap; wide enough that the longest row is in 65,536 bins at most."""
    length = F.col("stop") - F.col("start") + 1
    wanted = 32.0
    for table in tables:
        mean, most = table.agg(F.avg(length), F.max(length)).first()
        wanted = max(wanted, mean or 0, (most or 0) / (1 << 16))
    return 1 << math.ceil(math.log2(wanted))


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int = BIN) -> DataFrame:
    """Pairs of overlapping rows; b's other columns must have other names, its interval comes as start_b and stop_b.

    An equi-join on keys and bin; a pair counts only in the first bin that it shares. All rows of a bin are compared, so where many rows
    lie over each other ``width`` should be near their length (``fitting_width``).
    """
    b = _binned(b, width).withColumnsRenamed({"start": "start_b", "stop": "stop_b"})
    first = F.floor(F.greatest("start", "start_b") / width) == F.col("_bin")
    return _binned(a, width).join(b, [*keys, "_bin"]).where((F.col("start") <= F.col("stop_b")) & (F.col("start_b") <= F.col("stop")) & first).drop("_bin")


def without_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], row: Sequence[str], width: int = BIN) -> DataFrame:
    """Rows of ``a`` (told apart by ``row``) that overlap no row of ``b``."""
    hit = overlaps(a.select(*row, *keys, "start", "stop"), b.select(*keys, "start", "stop"), keys, width).select(*row).distinct()
    return a.join(hit, list(row), "left_anti")


def coverage(a: DataFrame, b: DataFrame, keys: Sequence[str], row: str, width: int = BIN) -> DataFrame:
    """Adds to each row of ``a``: covered, its positions that ``b`` covers, and fraction of its length."""
    pairs = overlaps(a.select(row, *keys, "start", "stop"), merged(b, keys, 1, width), keys, width)
    length = F.least("stop", "stop_b") - F.greatest("start", "start_b") + 1
    sums = pairs.groupBy(row).agg(F.sum(length).alias("covered"))
    covered = F.coalesce("covered", F.lit(0).cast("long"))
    return a.join(sums, row, "left").withColumn("covered", covered).withColumn("fraction", F.col("covered") / (F.col("stop") - F.col("start") + 1))


def on_tiles(df: DataFrame, size: int) -> DataFrame:
    """A row for each tile (from 1, of ``size`` positions) that an interval touches, clipped to it."""
    tiles = df.withColumn("tile", F.explode(F.sequence(F.floor((F.col("start") - 1) / size), F.floor((F.col("stop") - 1) / size))))
    return tiles.withColumns({"start": F.greatest("start", F.col("tile") * size + 1), "stop": F.least("stop", (F.col("tile") + 1) * size)})


def on_windows(df: DataFrame, size: int, step: int) -> DataFrame:
    """A row for each window [w * step + 1, w * step + size] that an interval overlaps; windows may overlap."""
    first = F.greatest(F.lit(0), F.ceil((F.col("start") - size) / step))
    return df.withColumn("window", F.explode(F.sequence(first.cast("long"), F.floor((F.col("stop") - 1) / step))))


def subtracted(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int = BIN) -> DataFrame:
    """(keys, start, stop): the positions of ``a`` that ``b`` doesn't cover, as disjoint intervals.

    Both are merged and cut into tiles of ``width``, so a tile has ``width`` / 2 stretches of ``b`` at most.
    """
    mine, other = on_tiles(merged(a, keys), width), on_tiles(merged(b, keys), width)
    holes = other.groupBy(*keys, "tile").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("holes"))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    rows = mine.join(holes, [*keys, "tile"], "left").withColumn("holes", F.coalesce("holes", none))
    first = F.concat(F.array("start"), F.transform("holes", lambda h: h["stop"] + 1))
    last = F.concat(F.transform("holes", lambda h: h["start"] - 1), F.array("stop"))
    rest = F.transform(F.arrays_zip(first.alias("x"), last.alias("y")), lambda z: F.struct(F.greatest(z["x"], F.col("start")).alias("low"), F.least(z["y"], F.col("stop")).alias("high")))
    left = rows.select(*keys, F.explode(F.filter(rest, lambda z: z["low"] <= z["high"])).alias("z"))
    return merged(left.select(*keys, F.col("z.low").alias("start"), F.col("z.high").alias("stop")), keys)
