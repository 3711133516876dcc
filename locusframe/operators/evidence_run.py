"""The evidence run on files: hits to classes, peptides, gene models and confidence, in one call."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators import evidence
from locusframe.session import stored
from locusframe.sources.parts import fasta_lengths
from locusframe.sources.text import read_fasta, read_hits, write_classes, write_fasta, write_gff

Paths = str | Sequence[str]


@dataclass(frozen=True)
class Limits:
    """Of a hit that supports a peptide, and of a peptide that stands by itself."""

    evalue: float = 1e-5
    pident: float = 0.0
    query_cover: float = 0.8
    target_cover: float = 0.8
    cds: int = 250
    score: float = 50.0


def run_evidence(
    spark: SparkSession, peptides: Paths, transcripts: Paths, proteins: Paths, hits: Paths, short_hits: Paths, out: str,
    limits: Limits = Limits(), free: DataFrame | None = None, compression: str | None = None,
) -> DataFrame:
    """(id, tx_id, class, by): every peptide that stays, as HC by a protein, HC by itself, or LC.

    ``peptides``, ``transcripts`` and ``proteins`` are FASTA, the hits tables of 12 columns (of the peptides and of their shortened forms). Peptides
    whose coding part is complete from its first M on are shortened; a hit on a protein, both well covered, makes a complete one confident; of
    the others those confident that are long, of high score, free of conflicts (``free``: id, flag; all, if it is None) and behind a stop codon.
    A peptide's transcript is its id without ``.p`` and a number. Into ``out`` go classes.json (one map), revised.pep and candidates.gff3 (models
    on transcripts), the last two gzipped if ``compression`` is gzip. Peptides of unknown transcripts have no model.
    """
    # Sequences stay in their files; what is stored and shuffled of them are facts.
    pep = read_fasta(spark, peptides).select(F.col("seq_name").alias("id"), "header", "sequence")
    facts = ("query", "subject", "pident", "tstart", "bits")
    normal = stored(read_hits(spark, hits).select(*facts, "qstart", "alen", "evalue"))
    short = normal.select(*facts) if short_hits == hits else stored(read_hits(spark, short_hits).select(*facts))
    classes = stored(evidence.cds_classes(normal, short))
    write_classes(classes, f"{out}/classes.json")
    revised = evidence.revised_in_place(pep, classes)
    write_fasta(revised, f"{out}/revised.pep", "header", compression=compression)

    score = F.coalesce(F.regexp_extract("header", r"score=([0-9.]+)", 1).try_cast("double"), F.lit(0.0))
    size = F.length(F.regexp_replace("sequence", r"\*$", ""))
    slim = stored(revised.select(F.col("id").alias("query"), size.alias("qlen"), *(c.alias(n) for n, c in evidence.header_facts(F.col("header")).items()), score.alias("score")))
    facts = slim.drop("query", "qlen").withColumn("tx_id", F.regexp_replace("id", r"\.p\d+$", ""))
    plus, minus = evidence.first_stops(F.col("sequence"))
    known = stored(read_fasta(spark, transcripts).select(F.col("seq_name").alias("tx_id"), F.length("sequence").cast("long").alias("size"), plus.alias("plus"), minus.alias("minus")))
    lengths = known.select("tx_id", F.col("size").alias("length"))
    models = evidence.candidate_rows(facts.where("start is not null").select("id", "tx_id", "start", "stop", "strand"), lengths)
    gene, top = F.concat("id", F.lit(".gene")), F.col("type").isin("gene", "mRNA")
    attrs = F.when(F.col("type") == "gene", F.concat(F.lit("ID="), gene)).when(F.col("type") == "mRNA", F.concat(F.lit("ID="), "id", F.lit(";Parent="), gene)).otherwise(F.concat(F.lit("Parent="), "id"))
    dot = F.lit(".")
    rows = models.select(F.col("tx_id").alias("seqid"), dot.alias("source"), "type", "start", "stop", dot.alias("score"), "strand", dot.alias("phase"), attrs.alias("attrs"), "id", top.alias("top"))
    write_gff(rows, f"{out}/candidates.gff3", ["seqid", "id", F.col("top").desc(), "type", "start"], compression)

    targets = fasta_lengths(spark, proteins).select(F.col("seq_name").alias("subject"), F.col("length").alias("slen"))
    complete = slim.where("kind = 'complete'").select("query", "qlen")
    held = evidence.covered_queries(normal, limits.evalue, limits.pident, limits.query_cover, limits.target_cover, complete, targets).select(F.col("query").alias("id"))
    held = stored(held)

    rest = stored(facts.join(held, "id", "left_anti"))
    # A stop codon before the coding part: the first one of its strand ends before it.
    ends, before = F.when(F.col("strand") == "-", F.struct(F.col("minus").alias("at"), (F.col("size") - F.col("stop")).alias("room"))).otherwise(F.struct(F.col("plus").alias("at"), (F.col("start") - 1).alias("room"))), F.col("x")
    near = rest.where("start is not null").select("id", "tx_id", "strand", "start", "stop").join(known, "tx_id").withColumn("x", ends)
    utrs = near.groupBy("tx_id").agg(F.max((before["at"] > 0) & (before["at"] + 2 <= before["room"])).alias("flag"))
    free = rest.select("id", F.lit(True).alias("flag")) if free is None else free
    alone = evidence.confident(rest, free, utrs, limits.cds, limits.score).select("id", "tx_id", "class", F.lit("itself").alias("by"))
    return facts.join(held, "id", "left_semi").select("id", "tx_id", F.lit("HC").alias("class"), F.lit("protein").alias("by")).unionByName(alone)
