"""Per-base labels of gene models, their reductions and masks.

Labels: 0 intergenic; 1-3 intron by phase; 4-6 exon by frame; 7 start; 8-10 exon to intron; 11-13 intron to exon; 14 stop.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.envelope import stretches
from locusframe.operators.intervals import BIN, merged, on_windows, subtracted
from locusframe.operators.transcripts import TX, in_reading_order, with_phase
from locusframe.session import importable, stored

#: The exon labels by frame (fixed values).
FRAMES = ((4, 7, 10, 12), (5, 8, 13), (6, 9, 11, 14))
#: How many classes a scheme has, and how many of them are left for what is not exon.
SCHEMES = {2: 1, 3: 2, 4: 1, 5: 2, 7: 4}


def classes_of(scheme: int) -> list[int]:
    """The class of each of the 15 labels in a coarser scheme."""
    rest = SCHEMES[scheme]
    frames = scheme - rest > 1
    out = [min(label, rest - 1) for label in range(4)]
    for label in range(4, 15):
        frame = next(i for i, labels in enumerate(FRAMES) if label in labels)
        out.append(rest + (frame if frames else 0))
    return out


#: Older schemes of 7 classes (intergenic, intron by phase, exon by frame) and 5, by their number and that of fewer (fixed values).
OLDER = {(7, 5): (0, 1, 1, 1, 2, 3, 4), (7, 3): (0, 1, 1, 1, 2, 2, 2), (7, 2): (0, 0, 0, 0, 1, 1, 1), (5, 3): (0, 1, 2, 2, 2), (5, 2): (0, 0, 1, 1, 1)}
#: Tiles whose labels a task paints at once.
TILES_AT_ONCE = 64
#: Fields of a stretch that is painted: its piece's start, stop, phase, number (0 for introns) and total, and its own ends.
OWN = ("start", "stop", "phase", "n", "total", "low", "high")


def reduced_older(label: Column, classes: int, fewer: int) -> Column:
    """A label of an older scheme of 7 or 5 classes in one of fewer."""
    return F.get(F.array(*map(F.lit, OLDER[classes, fewer])), label)


def reduced(label: Column, classes: int) -> Column:
    """A label of 15 classes in a scheme of fewer."""
    return F.get(F.array(*map(F.lit, classes_of(classes))), label)


def pieces(cds: DataFrame) -> DataFrame:
    """Coding exons and the introns between them as intervals: (TX, start, stop, phase, n, total), n null for introns.

    ``phase`` is that of the exon itself, or of the exon after the intron; n is the exon's number of ``total``.
    """
    order, whole = Window.partitionBy(*TX).orderBy(*in_reading_order("line_no")), Window.partitionBy(*TX)
    ahead = {"start_2": F.lead("start").over(order), "stop_2": F.lead("stop").over(order), "phase_2": F.lead("phase").over(order)}
    rows = with_phase(cds).withColumns({"n": F.row_number().over(order), "total": F.count("*").over(whole), **ahead})
    piece = lambda start, stop, phase, n: F.struct(start.alias("start"), stop.alias("stop"), phase.alias("phase"), n.alias("n"), F.col("total"))
    exon = piece(F.col("start"), F.col("stop"), F.col("phase"), F.col("n"))
    intron = piece(F.least("stop", "stop_2") + 1, F.greatest("start", "start_2") - 1, F.col("phase_2"), F.lit(None).cast("int"))
    each = rows.select(*TX, F.explode(F.array(exon, intron)).alias("x")).where("x.start <= x.stop")
    return each.select(*TX, "x.*")


def label_at(x: Column, strand: Column, pos: Column) -> Column:
    """The label of a position of a piece ``x`` (fields as in ``pieces``).

    With o = (3 - phase) mod 3 and k the base's place in its exon in reading order: inside 4 + (k + o) mod 3, the
    first 11 + (o + 1) mod 3, the last 8 + (length - phase + 1) mod 3; the transcript's first is 7, its last 14. An
    intron has 1 + (o + 1) mod 3 of the exon that follows.
    """
    size = x["stop"] - x["start"] + 1
    k = F.when(strand == "-", x["stop"] - pos).otherwise(pos - x["start"])
    o = (3 - x["phase"]) % 3
    label = (
        F.when(x["n"].isNull(), 1 + (o + 1) % 3).when((k == size - 1) & (x["n"] == x["total"]), 14).when((k == 0) & (x["n"] == 1), 7)
        .when(k == size - 1, 8 + (size - x["phase"] + 1) % 3).when(k == 0, 11 + (o + 1) % 3).otherwise(4 + (k + o) % 3)
    )
    return label.cast("int")


def all_labels(cds: DataFrame) -> DataFrame:
    """A row for each base of exons and introns: (seqid, strand, tx_id, pos, label)."""
    rows = pieces(cds).withColumn("x", F.struct("start", "stop", "phase", "n", "total"))
    return rows.withColumn("pos", F.explode(F.sequence("start", "stop"))).select(*TX, "pos", label_at(F.col("x"), F.col("strand"), F.col("pos")).alias("label"))


def exon_labels(cds: DataFrame) -> DataFrame:
    """A row for each coding base: (seqid, strand, tx_id, pos, label), with start and stop at the transcript's ends."""
    rows = pieces(cds).where("n is not null").withColumn("x", F.struct("start", "stop", "phase", "n", "total"))
    return rows.withColumn("pos", F.explode(F.sequence("start", "stop"))).select(*TX, "pos", label_at(F.col("x"), F.col("strand"), F.col("pos")).alias("label"))


def label_runs(cds: DataFrame, width: int = BIN) -> DataFrame:
    """(seqid, strand, tx_id, start, stop): which transcript's labels hold where, as maximal runs. Of transcripts at one base that of
    the larger id holds; each base has one owner."""
    own = stretches(pieces(cds), width).select("seqid", "strand", "tx_id", F.col("low").alias("start"), F.col("high").alias("stop"))
    return merged(own, TX)


def label_tiles(cds: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """(seqid, strand, chunk, labels): arrays of ``size`` labels for each tile that a transcript touches, in reading
    direction; 0 where none is. Of two labels of one base that of the larger transcript id holds (of one transcript's, the
    larger). A tile begins every ``size - overlap`` positions.

    Only intervals are shuffled. Each stretch of a tile has one owner before anything is painted (``envelope.stretches``), so a tile
    has ``size`` stretches at most and a base is painted once, however many transcripts cover it.
    """
    step = size - overlap
    tiles = owned(cds, size, overlap).groupBy("seqid", "strand", "chunk").agg(F.collect_list("own").alias("own"))

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TILES_AT_ONCE):
                part = batch.slice(i, TILES_AT_ONCE)
                n = part.num_rows
                minus = part["strand"].to_numpy(zero_copy_only=False) == "-"
                best = np.zeros(n * size, np.int64)
                row, field = listed(part["own"], OWN)
                paint_labels(best, row, field, minus[row], part["chunk"].to_numpy()[row] * step + 1, size)
                flat = pa.array(best.astype(np.int32))
                arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, n * size + 1, size, dtype=np.int32)), flat)
                yield pa.record_batch([part["seqid"], part["strand"], part["chunk"], arrays], ["seqid", "strand", "chunk", "labels"])

    importable(cds.sparkSession)
    kinds = dict(tiles.dtypes)
    return tiles.mapInArrow(paint, f"seqid {kinds['seqid']}, strand {kinds['strand']}, chunk long, labels array<int>")


def owned(cds: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """(seqid, strand, chunk, own): the stretches that ``label_tiles`` paints, with the tiles they touch; ``own`` has the fields ``OWN``."""
    own = F.struct("start", "stop", "phase", "n", "total", "low", "high")
    held = stretches(pieces(cds), size).withColumns({"own": own, "start": F.col("low"), "stop": F.col("high")})
    return on_windows(held, size, size - overlap).select("seqid", "strand", F.col("window").alias("chunk"), "own")


def listed(lists: pa.ListArray, names: Sequence[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The rows that the structs in the lists of a column belong to, and the structs' fields; null lists have none."""
    fields = lists.flatten().flatten()
    return lists.value_parent_indices().to_numpy(), dict(zip(names, (c.to_numpy(zero_copy_only=False) for c in fields), strict=True))


def paint_labels(best: np.ndarray, row: np.ndarray, field: Mapping[str, np.ndarray], minus: np.ndarray, low: np.ndarray, size: int) -> None:
    """Puts the labels of stretches into ``best``, in which each row has ``size`` places in reading direction. Of each stretch there are its row,
    its fields (``OWN``), whether its strand is minus, and its tile's first position."""
    first, last = np.maximum(field["low"], low), np.minimum(field["high"], low + size - 1)
    count = last - first + 1
    at = np.repeat(np.arange(len(row)), count)
    pos = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    turned = minus[at]
    place = np.where(turned, size - 1 - (pos - low[at]), pos - low[at])
    np.maximum.at(best, row[at] * size + place, _labels({k: v[at] for k, v in field.items() if k not in ("low", "high")}, turned, pos))


def _labels(x: Mapping[str, np.ndarray], minus: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """``label_at`` for many positions; n is 0 for introns."""
    size = x["stop"] - x["start"] + 1
    k = np.where(minus, x["stop"] - pos, pos - x["start"])
    o = (3 - x["phase"]) % 3
    out = np.where(k == 0, 11 + (o + 1) % 3, 4 + (k + o) % 3)
    out = np.where(k == size - 1, 8 + (size - x["phase"] + 1) % 3, out)
    out = np.where((k == 0) & (x["n"] == 1), 7, out)
    out = np.where((k == size - 1) & (x["n"] == x["total"]), 14, out)
    return np.where(x["n"] == 0, 1 + (o + 1) % 3, out)


def one_hot(labels: Column, classes: int = 15) -> Column:
    """An array of ``classes`` channels for each label of an array."""
    return F.transform(labels, lambda x: F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == x).cast("int")))


def masked(kept: DataFrame, filtered: DataFrame, keys: list[str], flank: int) -> DataFrame:
    """Half-open stretches whose bases have weight 0: the filtered ones, and half the flank around them unless a kept
    one is within the whole flank."""
    at = lambda df, r: df.select(*keys, F.greatest(F.col("start") - r, F.lit(0)).alias("start"), (F.col("stop") + r - 1).alias("stop")).where("start <= stop")
    around = subtracted(at(filtered, flank // 2), at(kept, flank), keys)
    return merged(around.unionByName(at(filtered, 0)), keys).withColumn("stop", F.col("stop") + 1)


def transitions(cds: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Half-open stretches within ``reach`` of a change between coding and not."""
    runs = merged(cds, keys)
    ends = runs.select(*keys, F.explode(F.array(F.col("start"), F.col("stop") + 1)).alias("at"))
    near = ends.select(*keys, F.greatest(F.lit(0), F.col("at") - reach).alias("start"), (F.col("at") + reach - 1).alias("stop"))
    return merged(near, keys).withColumn("stop", F.col("stop") + 1)


def reading_frames(starts: DataFrame, stops: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """(keys, start, stop): each start (keys, pos) with the first stop (keys, pos) more than three positions after it.

    A running minimum over starts and stops from the end of each bin of ``width`` positions, and the first stop of the
    bins after it; not a join of all pairs. A stop less than four positions ahead is passed over by looking from four on.
    """
    none = F.lit(None).cast("long")
    ahead = starts.select(*keys, (F.col("pos") + 4).alias("at"), F.col("pos").alias("start"), none.alias("end"))
    both = ahead.union(stops.select(*keys, F.col("pos").alias("at"), none.alias("start"), F.col("pos").alias("end")))
    both = stored(both.withColumn("bin", F.floor(F.col("at") / width)))
    later = Window.partitionBy(*keys).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bins = both.groupBy(*keys, "bin").agg(F.min("end").alias("first")).withColumn("first", F.min("first").over(later))
    inside = Window.partitionBy(*keys, "bin").orderBy(F.col("at").desc(), F.col("end").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("next", F.min("end").over(inside)).join(bins, [*keys, "bin"]).withColumn("stop", F.coalesce("next", "first"))
    return found.where("start is not null and stop is not null").select(*keys, "start", "stop")


def frame_ends(cds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seqid, strand, pos) of the start labels, and of the stop labels, of all transcripts."""
    exons = stored(pieces(cds).where("n is not null and (n = 1 or n = total)"))
    head, tail = (F.when(F.col("strand") == "-", F.col(a)).otherwise(F.col(b)).alias("pos") for a, b in (("stop", "start"), ("start", "stop")))
    return exons.where("n = 1 and not (n = total and start = stop)").select("seqid", "strand", head), exons.where("n = total").select("seqid", "strand", tail)
