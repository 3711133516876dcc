"""Merging annotations: loci, equal structures, priorities, identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.intervals import running, with_cluster, without_overlap
from locusframe.operators.transcripts import first_by, structure
from locusframe.session import stored

KEYS = ["seqid", "strand"]


def with_locus(transcripts: DataFrame) -> DataFrame:
    """Adds locus: transcripts of one strand whose spans overlap (touching ones do not)."""
    return with_cluster(transcripts, KEYS, ["start", "stop", "line_no"], out="locus")


def distinct_structures(transcripts: DataFrame, keys: list[str]) -> DataFrame:
    """Of transcripts with equal features one stays: that with most UTR bases, then the first seen."""
    kept = first_by(transcripts.withColumn("structure", structure()), [*keys, "structure"], F.col("utr_bp").desc(), F.col("line_no"))
    return kept.drop("structure")


def locus_ids(transcripts: DataFrame, locus: tuple[str, ...] = ("locus",)) -> DataFrame:
    """Adds gene (gene_ and the number of the locus in order of sequence, start and strand) and tx (its number in the locus).

    A locus is told apart by sequence, strand and the columns ``locus``. Loci are numbered within bins of each sequence;
    one row a sequence says how many are in those before.
    """
    transcripts = stored(transcripts)
    keys = [*KEYS, *locus]
    loci = transcripts.groupBy(*keys).agg(F.min("start").alias("_from"))
    loci = stored(running(loci, ["seqid"], ["_from", "strand"], "_from", F.lit(1).cast("long"), "_n", "sum"))
    counts = loci.groupBy("seqid").agg(F.count("*").alias("_count"))
    before = counts.withColumn("_earlier", F.sum("_count").over(Window.orderBy("seqid")) - F.col("_count")).drop("_count")
    number = (F.col("_n") + F.col("_earlier")).cast("string")
    gene = F.concat(F.lit("gene_"), F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number))
    loci = loci.join(before, "seqid").select(*keys, gene.alias("gene"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("start", "tx_id"))
    return transcripts.withColumn("_nth", nth).join(loci, keys).withColumn("tx", F.concat("gene", F.lit(".t"), "_nth")).drop("_nth")


def merge_all(transcripts: DataFrame) -> DataFrame:
    """All inputs' transcripts in loci, without equal structures, with new ids."""
    return locus_ids(distinct_structures(with_locus(transcripts), [*KEYS, "locus"]))


def merge_by_priority(first: DataFrame, rest: DataFrame) -> DataFrame:
    """All of ``first``, and of ``rest`` what overlaps none of its loci on the strand; both numbered together."""
    first, rest = stored(with_locus(first)), stored(rest)
    loci = first.groupBy(*KEYS, "locus").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    free = with_locus(without_overlap(rest, loci, KEYS, ["tx_id", *KEYS]))
    both = first.withColumn("_side", F.lit(0)).unionByName(free.withColumn("_side", F.lit(1)))
    return locus_ids(distinct_structures(both, [*KEYS, "_side", "locus"]), ("_side", "locus")).drop("_side")
