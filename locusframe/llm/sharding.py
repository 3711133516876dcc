"""Balanced shards by sampled splitters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm._common import hinted, written

LOWEST = -(2**63)
#: A range of the running sums is to have about so many bytes of the given sizes.
RANGE_BYTES = 1 << 30
#: The table of ranges is broadcast up to this many rows.
BROADCAST_RANGES = 500_000


def shard_by_splitters(
    df: DataFrame,
    key: str,
    size: str,
    ties: Sequence[str],
    n_shards: int = 40,
    n_ranges: int | None = None,
    per_range: int = 25,
    overfull: float = 2.0,
    large_share: int = 50,
) -> DataFrame:
    """Adds ``law`` ("bytes"), ``shard`` and ``slot`` to every row, so that shards have nearly equal sizes.

    ``key`` is a bigint to sort by (a hash of the text keeps equal texts together), ``size`` a positive
    bigint, ``ties`` columns that order rows of one key. ``key`` and ``size`` may not be null.

    1. A sample is drawn with a chance in proportion to the size, ``per_range`` rows for each range, by a hash of key
       and ties: so that it is the same for any file layout. Its weighted quantiles split the keys into ``n_ranges``
       ranges: unless given, 16 a shard or one for each RANGE_BYTES, whichever is more.
    2. Each range's bytes are counted over all rows. A range of over ``overfull`` times its fair share (a hot
       key) is subdivided by a hash of the ties.
    3. A running sum in each piece, plus the sum of all earlier pieces, is the row's place among all bytes;
       the shard follows from that place.

    Rows over 1/``large_share`` of a shard, of which there can be ``n_shards * large_share`` at most, are dealt
    out first, largest first, each turn to the shards that have least; the others fill each shard up to the common
    level. So sizes differ by about 1/``large_share`` of a shard, unless one row is larger than a shard. Slots run
    from 0 without gaps.

    Rows that are the same in all these columns are interchangeable, so the file layout decides nothing. Null ties
    come first. Columns of the added names are replaced, all others stay. No rows: no rows. Only the sample's
    quantiles, the pieces' sums and the shards' sums are broadcast, the first two up to BROADCAST_RANGES rows.
    """
    spark = df.sparkSession
    total, largest = df.agg(F.sum(size), F.max(size)).first()
    kept = [c for c in df.columns if c not in ("law", "shard", "slot")]
    if not total:
        return df.select(*(F.col(f"`{c}`") for c in kept), F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    k, s = F.col(f"`{key}`"), F.col(f"`{size}`")
    n_ranges = n_ranges or max(16 * n_shards, int(total) // RANGE_BYTES)
    # The table of ranges is looked up by the key's highest bits, which makes an equi-join of it.
    shift = 63 - max(12, n_ranges.bit_length())
    is_large = s * (n_shards * large_share) > F.lit(total).cast("decimal(38,0)")
    small = df.where(~is_large)

    # Large rows: a bounded number. In each turn, the largest go to the shards that have least.
    ranked = df.where(is_large).withColumn("__shard_rank", F.row_number().over(Window.orderBy(s.desc(), k, *ties)) - 1)
    turns = (
        ranked.groupBy(F.floor(F.col("__shard_rank") / max(1, n_shards // 40)).alias("__shard_turn"))
        .agg(F.sort_array(F.collect_list(F.struct("__shard_rank", s.alias("__shard_size")))).alias("__shard_rows"))
        .agg(F.sort_array(F.collect_list(F.struct("__shard_turn", "__shard_rows"))).alias("__shard_turns"))
    )
    empty = F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        lambda i: F.struct(F.lit(0).cast("long").alias("load"), i.alias("shard"), F.array().cast("array<int>").alias("ranks")),
    )

    def add_turn(loads: Column, turn: Column) -> Column:
        pairs = F.arrays_zip(F.array_sort(loads).alias("had"), turn["__shard_rows"].alias("got"))
        return F.transform(
            pairs,
            lambda x: F.struct(
                (x["had"]["load"] + F.coalesce(x["got"]["__shard_size"], F.lit(0))).alias("load"),
                x["had"]["shard"].alias("shard"),
                F.concat(x["had"]["ranks"], F.filter(F.array(x["got"]["__shard_rank"]), lambda r: r.isNotNull())).alias("ranks"),
            ),
        )

    dealt = turns.select(F.inline(F.aggregate("__shard_turns", empty, add_turn))).select(
        F.col("shard").alias("__shard_shard"), F.posexplode("ranks").alias("__shard_index", "__shard_rank")
    )
    large = ranked.join(F.broadcast(dealt), "__shard_rank").withColumn("__shard_index", F.col("__shard_index").cast("long"))
    shards = spark.range(n_shards).select(F.col("id").cast("int").alias("__shard_shard"))
    in_large = large.groupBy("__shard_shard").agg(F.sum(size).alias("__shard_bytes"), F.count("*").alias("__shard_large"))
    every = Window.orderBy("__shard_shard")
    quota = F.greatest(F.lit(total / n_shards) - F.coalesce("__shard_bytes", F.lit(0)), F.lit(0.0))
    quotas = written(
        shards.join(in_large, "__shard_shard", "left")
        .select("__shard_shard", F.coalesce("__shard_large", F.lit(0)).alias("__shard_large"), quota.alias("__shard_quota"))
        .withColumn("__shard_share_from", F.sum("__shard_quota").over(every) - F.col("__shard_quota"))
        .withColumn("__shard_share_to", F.lead("__shard_share_from").over(every))
    )
    small_total, room = (small.agg(F.sum(size)).first()[0] or 0), quotas.agg(F.sum("__shard_quota")).first()[0]

    # Splitters: weighted quantiles of the sample.
    chance = F.least(F.lit(1.0), s * (n_ranges * per_range / max(1, small_total)))
    # Equal rows are drawn together: they are one row of the sample with their common weight.
    draw = F.xxhash64(k, *ties, F.lit("splitters")) / F.lit(2.0**64) + 0.5
    sample = small.select(k.alias("__shard_k"), draw.alias("__shard_draw"), chance.alias("__shard_p"), (s / chance).alias("__shard_w"))
    sample = sample.where("__shard_draw < __shard_p").groupBy("__shard_k", "__shard_draw").agg(F.sum("__shard_w").alias("__shard_w"))
    in_sample = Window.orderBy("__shard_k", "__shard_draw").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("__shard_w").over(in_sample) - F.col("__shard_w")
    step = F.floor(before * (n_ranges / max(1, small_total)))
    quantiles = sample.select("__shard_k", step.alias("__shard_step")).groupBy("__shard_step").agg(F.min("__shard_k").alias("__shard_lo")).select("__shard_lo")
    quantiles = quantiles.union(spark.createDataFrame([(LOWEST,)], "__shard_lo long")).distinct()
    by_lo = Window.orderBy("__shard_lo")
    high = F.coalesce(F.col("__shard_hi") - 1, F.lit(2**63 - 1))
    ranges = written(
        quantiles.select("__shard_lo", F.lead("__shard_lo").over(by_lo).alias("__shard_hi"), F.row_number().over(by_lo).alias("__shard_range"))
    )
    lookup = ranges.withColumn(
        "__shard_prefix", F.explode(F.sequence(F.shiftright("__shard_lo", shift), F.shiftright(high, shift)))
    )

    def in_range(rows: DataFrame, table: DataFrame) -> DataFrame:
        fits = (F.shiftright(k, shift) == F.col("__shard_prefix")) & (k >= F.col("__shard_lo")) & (F.col("__shard_hi").isNull() | (k < F.col("__shard_hi")))
        return rows.join(hinted(table, BROADCAST_RANGES), fits).drop("__shard_prefix", "__shard_lo", "__shard_hi")

    # Overfull ranges are subdivided.
    limit = overfull * small_total / n_ranges
    counted = in_range(small, lookup).groupBy("__shard_range").agg(F.sum(size).alias("__shard_bytes"))
    parts = written(counted.select("__shard_range", F.greatest(F.lit(1), F.ceil(F.col("__shard_bytes") / (limit or 1))).alias("__shard_parts")))
    lookup = lookup.join(parts, "__shard_range")
    pieces = in_range(small, lookup).withColumn("__shard_part", F.pmod(F.xxhash64(key, *ties), F.col("__shard_parts")))

    # Each piece's place among all bytes and rows.
    in_order = Window.orderBy("__shard_range", "__shard_part")
    places = written(
        pieces.groupBy("__shard_range", "__shard_part").agg(F.sum(size).alias("__shard_bytes"), F.count("*").alias("__shard_rows"))
        .select(
            "__shard_range", "__shard_part",
            (F.sum("__shard_bytes").over(in_order) - F.col("__shard_bytes")).alias("__shard_bytes_before"),
            (F.sum("__shard_rows").over(in_order) - F.col("__shard_rows")).alias("__shard_rows_before"),
        )
    )
    own = Window.partitionBy("__shard_range", "__shard_part").orderBy(key, *ties)
    middle = F.col("__shard_bytes_before") + F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, 0)) - s / 2
    share = middle * (room / small_total if small_total else 0.0)
    placed = (
        pieces.join(hinted(places, BROADCAST_RANGES), ["__shard_range", "__shard_part"])
        .withColumn("__shard_row", F.col("__shard_rows_before") + F.row_number().over(own) - 1)
        .withColumn("__shard_share", share)
    )
    # Shards by that place; buckets of equal width make an equi-join of it.
    buckets = 4 * n_shards
    bucket = lambda x: F.least(F.floor(x * (buckets / (room or 1.0))), F.lit(buckets))
    to = F.coalesce("__shard_share_to", F.lit(room))
    by_bucket = quotas.where("__shard_quota > 0").select(
        "__shard_shard", "__shard_share_from", "__shard_share_to", F.explode(F.sequence(bucket(F.col("__shard_share_from")), bucket(to))).alias("__shard_bucket")
    )
    up_to = F.col("__shard_share_to").isNull() | (F.col("__shard_share") < F.col("__shard_share_to"))
    fits = (bucket(F.col("__shard_share")) == F.col("__shard_bucket")) & (F.col("__shard_share") >= F.col("__shard_share_from")) & up_to
    placed = placed.join(F.broadcast(by_bucket), fits)
    starts = written(placed.groupBy("__shard_shard").agg(F.min("__shard_row").alias("__shard_start")))
    large_in = quotas.select("__shard_shard", "__shard_large")
    placed = placed.join(F.broadcast(starts.join(large_in, "__shard_shard")), "__shard_shard").withColumn(
        "__shard_index", F.col("__shard_row") - F.col("__shard_start") + F.col("__shard_large")
    )
    out = [*(F.col(f"`{c}`") for c in kept), F.lit("bytes").alias("law"), F.col("__shard_shard").alias("shard"), F.col("__shard_index").alias("slot")]
    return placed.select(*out).unionByName(large.select(*out))
