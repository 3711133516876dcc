"""Tiles of sequences, greedy groups, and sizes that divide well."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.sequence import on_strand, revcomp, stop_check, translate_cds
from locusframe.operators.intervals import running
from locusframe.session import stored

#: Positions of a tile that features are joined to.
TILE = 1 << 12


def _windows(sequence: Column, size: int, step: int) -> Column:
    """An array of stretches of up to ``size``, one every ``step`` positions, in one pass over the sequence."""
    if size == step:
        return F.regexp_extract_all(sequence, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.regexp_extract_all(sequence, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1))


def chunks(sequences: DataFrame, size: int, overlap: int = 0, pad: bool = True) -> DataFrame:
    """(seq_name, strand, chunk, start, stop, sequence): tiles on both strands, from 1, inclusive.

    A tile begins every ``size - overlap`` positions. The last is filled with N, or left out if not ``pad`` and short.
    Minus tiles hold the reverse complement of the plus tile, and are numbered backwards.
    """
    return tiled(sequences, size, overlap, pad).drop("length")


def tiled(sequences: DataFrame, size: int, overlap: int = 0, pad: bool = True) -> DataFrame:
    """``chunks`` with length, that of the whole sequence."""
    step = size - overlap
    length = F.length("sequence").cast("long")
    n = F.greatest(F.lit(1), F.ceil((length - overlap) / step)) if pad else F.floor((length - overlap) / step)
    cuts = F.when(length > 0, _windows(F.col("sequence"), size, step)).otherwise(F.array(F.lit("")))
    # Cut first, then explode: else each tile's row has a copy of the whole sequence, to find its length from.
    each = sequences.select("seq_name", length.alias("length"), n.cast("long").alias("n"), cuts.alias("cuts"))
    rows = each.select("seq_name", "length", "n", F.posexplode("cuts").alias("i", "cut")).where("i < n")
    at = F.col("i").cast("long") * step
    tiles = rows.select("seq_name", "length", "n", "i", (at + 1).alias("start"), F.least(at + size, F.col("length")).alias("stop"), F.rpad("cut", size, "N").alias("sequence"))
    both = tiles.withColumn("strand", F.explode(F.array(F.lit("-"), F.lit("+"))))
    minus = F.col("strand") == "-"
    return both.select(
        "seq_name", "length", "strand", F.when(minus, F.col("n") - 1 - F.col("i")).otherwise(F.col("i")).alias("chunk"), "start", "stop",
        F.when(minus, revcomp(F.col("sequence"))).otherwise(F.col("sequence")).alias("sequence"),
    )


def sequence_tiles(sequences: DataFrame, extra: int = 0, size: int = TILE) -> DataFrame:
    """(seqid, tile, tile_sequence): the positions from tile * size + 1 on, with ``extra`` of the next tile.

    Features are joined to tiles, not to whole sequences, so a long sequence isn't copied to each of its features.
    """
    cuts = F.posexplode(_windows(F.col("sequence"), size + extra, size)).alias("tile", "tile_sequence")
    return sequences.select(F.col("seq_name").alias("seqid"), cuts).withColumn("tile", F.col("tile").cast("long"))


def with_bases(rows: DataFrame, tiles: DataFrame, at: Column, n: int, out: str, size: int = TILE) -> DataFrame:
    """Adds the ``n`` bases from position ``at`` of each row's seqid; rows of unknown sequences or places are left out.

    ``tiles`` must overlap by at least ``n`` - 1.
    """
    placed = rows.withColumn("_at", at).where("_at > 0").withColumn("tile", F.floor((F.col("_at") - 1) / size))
    found = placed.join(tiles, ["seqid", "tile"])
    return found.withColumn(out, F.substring("tile_sequence", (F.col("_at") - F.col("tile") * size).cast("int"), F.lit(n))).drop("_at", "tile", "tile_sequence")


def spliced(cds: DataFrame, sequences: DataFrame, size: int = TILE) -> DataFrame:
    """(seqid, strand, tx_id, sequence): the features of each transcript cut out of the genome and joined in reading order.

    What lies beyond a sequence's end is left out; a transcript of an unknown sequence has a null one.

    Transcripts are put together before they meet tiles, so one that lies in a single tile is cut out where it meets it, and no piece is
    shuffled again; only pieces of those that cross tiles are.
    """
    place = lambda pos: F.floor((pos - 1) / size)
    tx = cds.groupBy("seqid", "strand", "tx_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("parts"), place(F.min("start")).alias("tile"), place(F.max("stop")).alias("last"))
    tiles = sequence_tiles(sequences, 0, size)
    # Places in the tile, found before the join: what is cut out reads the tile alone.
    at = F.transform("parts", lambda p: F.struct((p["start"] - F.col("tile") * size).cast("int").alias("at"), (p["stop"] - p["start"] + 1).cast("int").alias("n")))
    inside = tx.where("tile = last").select("seqid", "strand", "tx_id", "tile", at.alias("cuts")).join(tiles, ["seqid", "tile"], "left")
    cut = F.array_join(F.transform("cuts", lambda c: F.substring("tile_sequence", c["at"], c["n"])), "")
    one = inside.select("seqid", "strand", "tx_id", F.when(F.col("tile_sequence").isNotNull(), on_strand(cut, F.col("strand"))).alias("sequence"))

    each = tx.where("tile < last").select("seqid", "strand", "tx_id", F.posexplode("parts").alias("i", "p")).select("seqid", "strand", "tx_id", "i", "p.*")
    spread = each.withColumn("tile", F.explode(F.sequence(place(F.col("start")), place(F.col("stop"))))).join(tiles, ["seqid", "tile"], "left")
    low = F.greatest("start", F.col("tile") * size + 1)
    n = F.least("stop", (F.col("tile") + 1) * size) - low + 1
    piece = F.substring("tile_sequence", (low - F.col("tile") * size).cast("int"), n.cast("int"))
    pieces = F.sort_array(F.collect_list(F.struct("i", "tile", piece.alias("piece"))))
    # Whether there is a tile, not the tile itself, goes through the shuffle.
    whole = spread.groupBy("seqid", "strand", "tx_id").agg(pieces.alias("pieces"), F.bool_or(F.col("tile_sequence").isNotNull()).alias("known"))
    joined = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    return one.unionByName(whole.select("seqid", "strand", "tx_id", F.when(F.col("known"), on_strand(joined, F.col("strand"))).alias("sequence")))


def stop_report(cds: DataFrame, sequences: DataFrame) -> DataFrame:
    """Stop codons of each transcript's spliced coding sequence: one row a transcript, as ``stop_check`` has them, and the
    first inner stop codon. One of an unknown sequence has length 0 and no codons."""
    rows = spliced(cds, sequences).withColumn("sequence", F.coalesce("sequence", F.lit("")))
    facts = rows.withColumn("x", stop_check(F.col("sequence")))
    codon = F.when(F.col("x.first_internal") > 0, F.upper(F.substring("sequence", F.col("x.first_internal").cast("int"), F.lit(3)))).otherwise("NA")
    return facts.select("seqid", "strand", "tx_id", "x.*", codon.alias("first_codon"))


def passing(report: DataFrame) -> DataFrame:
    """Of a ``stop_report`` the transcripts in frame, with a stop codon at the end and none before it."""
    return report.where("in_frame and valid_stop and internal = 0")


def proteins(cds: DataFrame, sequences: DataFrame) -> DataFrame:
    """(tx_id, sequence): the peptides of all transcripts of known sequences."""
    return spliced(cds, sequences).where("sequence is not null").select("seqid", "strand", "tx_id", translate_cds(F.col("sequence")).alias("sequence"))


def greedy_groups(sequences: DataFrame, least: int, most: int) -> DataFrame:
    """(seq_name, group): in order, a group closes when it reaches ``least`` (1 or more); beyond ``most`` groups, all go to the last.

    Running sums of length come from order ranges; the at most ``most`` - 1 ends are then found one after another,
    each by a small aggregate: the first running sum that is ``least`` or more beyond the last end.
    """
    order = ["seq_ord", "seq_name", "n"]
    lengths = sequences.select("seq_ord", "seq_name", F.length("sequence").cast("long").alias("n"))
    ranged = stored(lengths.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sums = stored(running(ranged, [], order, "range", F.coalesce("n", F.lit(0)), "upto", "sum", 1))
    ends: list[int] = []
    if (sums.agg(F.max("upto")).first()[0] or 0) > least:
        while len(ends) < most - 1:
            end = sums.where(F.col("upto") >= (ends[-1] if ends else 0) + least).agg(F.min("upto")).first()[0]
            if end is None:
                break
            ends.append(end)
    before = F.col("upto") - F.coalesce("n", F.lit(0))
    closed = F.filter(F.array(*map(F.lit, ends)).cast("array<bigint>"), lambda end: end <= before)
    return sums.select("seq_name", F.size(closed).cast("long").alias("group"))


def near_sqrt_divisor(n: int) -> int:
    """The divisor of n that is nearest to its square root; of two as near, the smaller."""
    root = math.sqrt(n)
    low = next(d for d in range(math.isqrt(n), 0, -1) if n % d == 0)
    return min((low, n // low), key=lambda d: (abs(d - root), d))


def nearest_divisor(n: Column) -> Column:
    """``near_sqrt_divisor`` of a column of positive numbers."""
    up_to = F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt(n)))
    low = F.array_max(F.filter(up_to, lambda d: n % d == 0))
    return F.when(F.sqrt(n) - low <= n / low - F.sqrt(n), low).otherwise(F.floor(n / low))


def adapted_chunk(longest: int, size: int, factor: int) -> int:
    """A chunk size for sequences shorter than ``size``: the next multiple of lcm(18, factor)."""
    unit = math.lcm(18, factor)
    return size if longest >= size else max(unit, -(-longest // unit) * unit)


def adapted_chunks(longest: Column, size: int, factor: int) -> Column:
    """``adapted_chunk`` of a column."""
    unit = math.lcm(18, factor)
    return F.when(longest >= size, F.lit(size).cast("long")).otherwise(F.greatest(F.lit(unit).cast("long"), F.ceil(longest / unit) * unit))


def divides(chunk: int) -> None:
    """Fails unless a chunk size divides by 9 and by 2, as decoding in parallel stretches needs."""
    if chunk % 9 or chunk % 2:
        raise ValueError(f"the chunk size {chunk} must divide by 9 and 2")


def with_shard(rows: DataFrame, k: int, *order: str) -> DataFrame:
    """Adds shard: of the rows in an order by the md5 of the order columns, which mixes neighbours, every k-th one.

    Counts of shards differ by one at most. Running numbers come from ranges of that order.
    """
    mixed = rows.withColumn("_mixed", F.md5(F.concat_ws("|", *order))).repartitionByRange("_mixed").withColumn("_range", F.spark_partition_id())
    numbered = running(mixed, [], ["_range", "_mixed", *order], "_range", F.lit(1).cast("long"), "_n", "sum", 1)
    return numbered.withColumn("shard", F.pmod(F.col("_n") - 1, F.lit(k))).drop("_mixed", "_range", "_n")


def chunk_index(seqid: Column, start: Column, offsets: Mapping[str, int], size: int) -> Column:
    """The number of the tile of a coordinate; ``offsets`` has the number of each sequence's first tile."""
    table = F.create_map(*(F.lit(x) for pair in offsets.items() for x in pair))
    return F.try_element_at(table, seqid) + F.floor(start / size)


def length_check(rows: DataFrame, column: str, n: int) -> DataFrame:
    """One row: how many examples there are (n), and how many are not ``n`` long (short)."""
    wrong = F.coalesce(F.length(column) != n, F.lit(True))
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(wrong.cast("long")), F.lit(0)).alias("short"))


def clipped_log(x: Column, low: float = -30.0) -> Column:
    """ln(x) between ``low`` and 0; ``low`` where x is 0 or less."""
    return F.when(x > 0, F.greatest(F.lit(low), F.least(F.lit(0.0), F.ln(x)))).otherwise(F.lit(low))


def lifted(features: DataFrame, exons: DataFrame) -> DataFrame:
    """Features in transcript coordinates (tx_id, start, stop) on the genome, one part for each exon they touch."""
    order = Window.partitionBy("tx_id").orderBy(F.when(F.col("strand") == "-", -F.col("stop")).otherwise(F.col("start")))
    size = F.col("stop") - F.col("start") + 1
    placed = exons.withColumn("upto", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))).select(
        "tx_id", "seqid", "strand", F.col("start").alias("e0"), F.col("stop").alias("e1"), (F.col("upto") - size).alias("before"), "upto"
    )
    both = features.join(placed, "tx_id").where("start <= upto and stop > before")
    low, high = F.greatest("start", F.col("before") + 1) - F.col("before"), F.least("stop", "upto") - F.col("before")
    minus = F.col("strand") == "-"
    return both.select(
        "tx_id", "seqid", "strand", F.when(minus, F.col("e1") - high + 1).otherwise(F.col("e0") + low - 1).alias("start"),
        F.when(minus, F.col("e1") - low + 1).otherwise(F.col("e0") + high - 1).alias("stop"),
    )
