"""Training examples: sequence, labels, weights and a track of each tile, in tables that meet without a shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.genome import chunks, with_shard
from locusframe.operators.intervals import on_tiles
from locusframe.operators.labels import OWN, TILES_AT_ONCE, listed, owned, paint_labels
from locusframe.session import fresh_path, importable

KEYS = ["seqid", "strand", "tile"]
#: Tiles that a bucket holds on average, at most.
TILES = 20_000
#: Types of packed arrays.
PACKED = {"labels": "<i4", "weights": "<f8", "track": "<f8"}
#: What tells a tile of both strands apart.
TILE = ["seqid", "tile"]
COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int, *lists: Column) -> DataFrame:
    """``df`` written to the shared folder in ``buckets`` by ``keys``, one file each: tables of one number of buckets join on these keys
    without a shuffle. With ``lists`` (aggregates), a key's rows become one row where they were dealt out to. The table is in the catalog
    only while it is read; its files stay."""
    spark = df.sparkSession
    importable(spark)
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    rows = dealt.groupBy(*keys).agg(*lists) if lists else dealt
    rows.write.format("parquet").option("path", fresh_path(spark)).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def sequence_part(sequences: DataFrame, size: int) -> DataFrame:
    """(TILE, sequence): tiles of the plus strand."""
    rows = chunks(sequences, size).where("strand = '+'")
    return rows.select(F.col("seq_name").alias("seqid"), F.floor((F.col("start") - 1) / size).alias("tile"), "sequence")


def label_part(cds: DataFrame, size: int) -> DataFrame:
    """(TILE, x): stretches of labels with their strand."""
    own = F.struct((F.col("strand") == "-").cast("int").alias("minus"), "own.*")
    return owned(cds, size).where("strand in ('+', '-')").select("seqid", F.col("chunk").alias("tile"), own.alias("x"))


def weight_part(masked: DataFrame, size: int) -> DataFrame:
    """(TILE, x): the places of the half-open, disjoint stretches (seqid, start, stop; from 0) of ``masked``, which weigh 0."""
    rows = on_tiles(masked.select("seqid", (F.col("start") + 1).alias("start"), F.col("stop").cast("long").alias("stop")).where("start <= stop"), size)
    place = lambda c: F.col(c) - 1 - F.col("tile") * size
    return rows.select("seqid", "tile", F.struct(place("start").alias("low"), place("stop").alias("high")).alias("x"))


def track_part(track: DataFrame, size: int) -> DataFrame:
    """(TILE, x): values (seqid, pos from 0, value; one a position) by place."""
    x = F.struct(F.pmod("pos", F.lit(size)).cast("long").alias("at"), F.col("value").cast("double").alias("value"))
    return track.where("value is not null").select("seqid", F.floor(F.col("pos") / size).alias("tile"), x.alias("x"))


def _flat(n: int, size: int, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * size + 1, size, dtype=np.int32)), pa.array(values.reshape(-1)))


def _turned(sequences: pa.Array, size: int) -> pa.Array:
    """Reverse complements of tiles."""
    texts = sequences.cast(pa.string())
    whole = "".join(texts.to_pylist())
    if whole.isascii():
        turned = whole.translate(COMPLEMENT)[::-1]
        return pa.array([turned[i : i + size] for i in range(len(whole) - size, -1, -size)], pa.string())
    return pa.array([x.translate(COMPLEMENT)[::-1] for x in texts.to_pylist()], pa.string())


def _bytes(n: int, values: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values)
    width = values.nbytes // n
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, values.nbytes + 1, width, dtype=np.int32)), pa.py_buffer(values)])


def _painter(size: int, empty: float, shards: bool, packed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [*KEYS, "sequence", "labels", "weights", "track", *(["shard"] if shards else [])]

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, TILES_AT_ONCE):
                part = whole.slice(i, TILES_AT_ONCE)
                n = part.num_rows
                # Rows of the plus strand, then those of the minus strand.
                best = np.zeros(2 * n * size, np.int64)
                row, field = listed(part["own_labels"], ("minus", *OWN))
                minus = field.pop("minus")
                paint_labels(best, row + minus * n, field, minus == 1, part["tile"].to_numpy()[row] * size + 1, size)

                weights = np.ones((n, size))
                row, field = listed(part["own_weights"], ("low", "high"))
                count = field["high"] - field["low"] + 1
                weights.reshape(-1)[np.repeat(row * size + field["low"] - np.cumsum(count) + count, count) + np.arange(count.sum())] = 0

                track = np.full((n, size), float(empty))
                row, field = listed(part["own_track"], ("at", "value"))
                track[row, field["at"]] = field["value"]

                array = (lambda x: _bytes(2 * n, x)) if packed else lambda x: _flat(2 * n, size, x)  # noqa: E731, B023
                both = lambda x: array(np.concatenate([x, x[:, ::-1]]))  # noqa: E731, B023
                twice = lambda x: pa.concat_arrays([x, x])
                columns = [
                    twice(part["seqid"]), pa.array(["+"] * n + ["-"] * n), twice(part["tile"]), pa.concat_arrays([part["sequence"].cast(pa.string()), _turned(part["sequence"], size)]),
                    array(best.astype(np.int32)), both(weights), both(track), *([pa.concat_arrays([part["plus"], part["minus"]])] if shards else []),
                ]
                yield pa.record_batch(columns, names)

    return paint


def examples(
    sequences: DataFrame, cds: DataFrame, masked: DataFrame, track: DataFrame, size: int, empty: float = 0.0, buckets: int = 200, shards: int = 0, packed: bool = False
) -> DataFrame:
    """(seqid, strand, tile, sequence, labels, weights, track): all tiles of all sequences (seq_name, sequence) on both strands.

    Each part is shuffled by its own tiles into a bucketed table; the four then meet bucket by bucket. Parts are lists of stretches and values, and
    sequences of the plus strand; whole arrays are painted once, for both strands, where the parts have met. A tile without a part has
    label 0, weight 1 and the track's ``empty`` value all along. Parts of tiles that no sequence has are left out.

    There are ``buckets`` buckets at least, and more where one would hold over ``TILES`` tiles. With ``shards``, column shard is added as
    ``example_shards`` does, but found from the tiles' keys alone: the arrays are not shuffled for it. With ``packed``, arrays are the bytes of NumPy's
    ``PACKED`` types, which are written and read whole, not number by number; ``unpacked`` gives the arrays.
    """
    tiles = sequences.agg(F.sum(2 * F.ceil(F.greatest(F.lit(1), F.length("sequence")) / size))).first()[0] or 0
    buckets = max(buckets, -(-int(tiles) // TILES))
    parts = [bucketed(sequence_part(sequences, size), TILE, buckets)]
    for name, part in (("labels", label_part(cds, size)), ("weights", weight_part(masked, size)), ("track", track_part(track, size))):
        parts.append(bucketed(part, TILE, buckets, F.collect_list("x").alias(f"own_{name}")))
    if shards:
        keys = parts[0].select("seqid", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand"), "tile")
        of = lambda strand: F.max(F.when(F.col("strand") == strand, F.col("shard")))
        parts.append(bucketed(with_shard(keys, shards, *KEYS), TILE, buckets, of("+").alias("plus"), of("-").alias("minus")))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part.hint("merge"), TILE, "left")
    kinds = dict(out.dtypes)
    array = (lambda kind: "binary") if packed else lambda kind: f"array<{kind}>"
    schema = f"seqid {kinds['seqid']}, strand string, tile long, sequence string, labels {array('int')}, weights {array('double')}, track {array('double')}"
    return out.mapInArrow(_painter(size, empty, bool(shards), packed), schema + (f", shard {kinds['plus']}" if shards else ""))


def example_shards(rows: DataFrame, shards: int) -> DataFrame:
    """Adds shard: every ``shards``-th example in a mixed order."""
    return with_shard(rows, shards, *KEYS)


def write_shards(rows: DataFrame, path: str) -> None:
    """A folder of Parquet for each shard, with a file from each task that has rows of it: whole examples are not shuffled once more."""
    rows.write.partitionBy("shard").parquet(path)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """A row's numbers as a row, from lists or packed arrays of one length."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)
    return column.flatten().to_numpy().reshape(len(column), -1)


def unpacked(rows: DataFrame) -> DataFrame:
    """Examples whose arrays were ``packed``, with arrays."""
    importable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TILES_AT_ONCE):
                part = batch.slice(i, TILES_AT_ONCE)
                found = {c: _matrix(part[c], kind) for c, kind in PACKED.items()}
                yield pa.record_batch([_flat(part.num_rows, found[c].shape[1], found[c]) if c in found else part[c] for c in part.schema.names], part.schema.names)

    kinds = {c: "array<int>" if kind == "<i4" else "array<double>" for c, kind in PACKED.items()}
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds.get(c, kind)}" for c, kind in rows.dtypes))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["labels", "masked", "masked_places", "track"]
    for batch in batches:
        kept = [c for c in batch.schema.names if c not in PACKED]
        for i in range(0, batch.num_rows, TILES_AT_ONCE):
            part = batch.slice(i, TILES_AT_ONCE)
            labels, weights, track = (_matrix(part[c], kind) for c, kind in PACKED.items())
            labels, zero = labels.astype(np.int64), (weights == 0).astype(np.int64)
            place = np.arange(labels.shape[1])
            sums = (labels @ place, zero.sum(axis=1), zero @ place, track @ place.astype(float))
            yield pa.record_batch([*(part[c] for c in kept), *map(pa.array, sums)], [*kept, *names])


def place_sums(rows: DataFrame) -> DataFrame:
    """Examples with sums in place of their arrays, packed or not: labels and track by place (from 0), masked, the number of places that weigh 0, and masked_places, their sum."""
    importable(rows.sparkSession)
    kept = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes if c not in PACKED)
    return rows.mapInArrow(_summed, f"{kept}, labels long, masked long, masked_places long, track double")
