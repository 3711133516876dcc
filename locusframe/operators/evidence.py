"""Evidence: alignment hits, peptide candidates, hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions import genome
from locusframe.functions.sequence import STARTS, STOPS, on_strand, revcomp, splice_strand
from locusframe.operators.transcripts import first_by
from locusframe.session import hinted, stored


def species_of(subject: Column) -> Column:
    """The first word, up to its first underscore."""
    return F.substring_index(F.split(subject, " ")[0], "_", 1)


def query_cover() -> Column:
    return F.when(F.col("qlen") > 0, F.col("alen") / F.col("qlen"))


def good_hits(hits: DataFrame, evalue: float, pident: float, qcov: float) -> DataFrame:
    """Hits within inclusive limits; none of a query of no length."""
    return hits.where((F.col("evalue") <= evalue) & (F.col("pident") >= pident) & (query_cover() >= qcov))


def best_hits(hits: DataFrame) -> DataFrame:
    """Of each query the hit of largest score (bits times query coverage).

    Of equal ones the first line, if there is a column line_no (as a file's reader adds it), else the least subject.
    """
    scored = hits.withColumns({"score": F.col("bits") * query_cover(), "species": species_of(F.col("subject"))})
    ties = ["line_no"] if "line_no" in hits.columns else ["subject", "qstart", "alen"]
    return first_by(scored, ["query"], F.col("score").desc(), *map(F.col, ties))


def top_hits(hits: DataFrame, n: int) -> DataFrame:
    """Of each query its ``n`` hits of largest score, numbered; Spark limits each group before the shuffle, so a hot query is small."""
    scored = hits.withColumn("score", F.col("bits") * query_cover())
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "subject", "qstart", "alen")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def ranked_species(hits: DataFrame, evalue: float, pident: float, qcov: float, top: int) -> DataFrame:
    """Species by the number of queries they are best for, then by score; ``top`` of them are marked."""
    votes = best_hits(good_hits(hits, evalue, pident, qcov)).groupBy("species").agg(F.count("*").alias("votes"), F.sum("score").alias("total"))
    place = F.row_number().over(Window.orderBy(F.col("votes").desc(), F.round("total", 3).desc(), "species"))
    return votes.withColumn("place", place.cast("long")).withColumn("mark", F.when(F.col("place") <= top, "TOP").otherwise(""))


def supported_queries(
    hits: DataFrame, evalue: float, pident: float, qcov: float, tcov: float, orfs: DataFrame | None = None, lengths: DataFrame | None = None
) -> DataFrame:
    """The first strict hit of each query: both sides covered.

    ``lengths`` (subject, slen) gives target lengths, 0 where one is missing; a hit on a target of no length isn't strict.
    ``orfs`` (query, header) limits the queries to complete ones that are known.
    """
    if lengths is not None:
        hits = hits.drop("slen").join(lengths.select("subject", "slen"), "subject", "left").withColumn("slen", F.coalesce("slen", F.lit(0)))
    if orfs is not None:
        hits = hits.join(orfs.where(orf_type(F.col("header")) == "complete").select("query").distinct(), "query", "left_semi")
    strict = good_hits(hits, evalue, pident, qcov).where(F.when(F.col("slen") > 0, F.col("alen") / F.col("slen")) >= tcov)
    return first_by(strict, ["query"], F.col("bits").desc(), F.col("subject"), F.col("qstart"), F.col("alen"))


def covered_queries(hits: DataFrame, evalue: float, pident: float, qcov: float, tcov: float, queries: DataFrame, lengths: DataFrame) -> DataFrame:
    """(query): those that ``supported_queries`` has, of the ``queries`` (query, qlen), with target ``lengths`` (subject, slen).

    Whether there is a strict hit is asked, not which, so of the hits of a query on a subject the longest one is enough.
    """
    hits = hits.select("query", "subject", "evalue", "pident", "alen")
    good = good_hits(hits.join(hinted(queries.select("query", "qlen")), "query"), evalue, pident, qcov)
    longest = good.groupBy("query", "subject").agg(F.max("alen").alias("alen"))
    found = longest.join(lengths.select("subject", "slen"), "subject").where(F.when(F.col("slen") > 0, F.col("alen") / F.col("slen")) >= tcov)
    return found.select("query").distinct()


def support_score(ident: Column, ident_short: Column, tstart: Column, tstart_short: Column, qstart: Column) -> Column:
    """(target starts apart) - (query start - 1) + ln(identity ratio) ^ 1000, with a ratio of 0 as +infinity."""
    ratio = ident / F.when(ident_short == 0, 1e-4).otherwise(ident_short)
    power = F.when(ratio == 0, F.lit(float("inf"))).when(ratio > 0, F.pow(F.abs(F.ln(ratio)), 1000))
    return (tstart_short - tstart) - (qstart - 1) + power


def hit_pairs(normal: DataFrame, short: DataFrame) -> DataFrame:
    """(query, subject, support, best, n): the pairs of hits of one query and subject that two searches have, ``n`` of the same facts as one row.

    Copies are counted before the join, so those of a subject cost what one of them does.
    """
    a = normal.groupBy("query", "subject", "pident", "tstart", "qstart", "bits").agg(F.count("*").alias("n"))
    s = short.groupBy("query", "subject", *(F.col(c).alias(f"{c}_s") for c in ("pident", "tstart", "bits"))).agg(F.count("*").alias("n_s"))
    score = support_score(F.col("pident"), F.col("pident_s"), F.col("tstart"), F.col("tstart_s"), F.col("qstart"))
    return a.join(s, ["query", "subject"]).select("query", "subject", score.alias("support"), F.greatest("bits", "bits_s").alias("best"), (F.col("n") * F.col("n_s")).alias("n"))


def _first_pairs(pairs: DataFrame, top: int) -> DataFrame:
    """(query, class, last): of the ``top`` first pairs of each query whether any supports the longer form, and the last one's best; no last, if there are fewer."""
    order = Window.partitionBy("query").orderBy(F.col("best").desc(), "subject", F.col("support").desc())
    # A row stands for one pair at least, so no more than ``top`` rows count.
    seen = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    seen = seen.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") - F.col("n") < top)
    kind = F.when(F.bool_or(F.coalesce(F.col("support") > 0, F.lit(False))), "incomplete").otherwise("complete")
    return seen.groupBy("query").agg(kind.alias("class"), F.min(F.when(F.col("upto") >= top, F.col("best"))).alias("last"))


def hit_floors(normal: DataFrame, short: DataFrame, top: int) -> DataFrame:
    """(query, floor): bits that some more than ``top`` subjects of a query likely reach in both searches.

    The subjects are dealt into slots, whose greatest bits are small to shuffle; queries with few slots in use have no floor.
    """
    slot = F.pmod(F.xxhash64("subject"), F.lit(3 * top)).alias("slot")
    none = F.lit(None).cast("double")
    sides = normal.select("query", slot, F.col("bits").alias("a"), none.alias("b")).unionByName(short.select("query", slot, none.alias("a"), F.col("bits").alias("b")))
    most = sides.groupBy("query", "slot").agg(F.max("a").alias("a"), F.max("b").alias("b")).where("a is not null and b is not null")
    floor = F.get(F.sort_array(F.collect_list(F.least("a", "b")), asc=False), F.lit(top + top // 2 - 1))
    return most.groupBy("query").agg(floor.alias("floor")).where("floor is not null")


def cds_classes(normal: DataFrame, short: DataFrame, top: int = 25) -> DataFrame:
    """(query, class): incomplete if any of the ``top`` hits that both searches have supports the longer form.

    Only subjects that reach their query's floor are paired at first. If ``top`` pairs reach it, no other can be among them, as
    both of its hits are below; the queries of which fewer do so are paired whole.
    """
    normal, short = normal.select("query", "subject", "pident", "tstart", "qstart", "bits"), short.select("query", "subject", "pident", "tstart", "bits")
    floors = stored(hit_floors(normal, short, top))
    if floors.isEmpty():
        return _first_pairs(hit_pairs(normal, short), top).select("query", "class")
    small = hinted(floors)
    above = [x.join(small, "query").where("bits >= floor").select("query", "subject") for x in (normal, short)]
    subjects = hinted(stored(above[0].unionByName(above[1]).distinct().withColumn("near", F.lit(True))), 500_000)
    # Hits of queries that have no floor stay, too.
    pairs = hit_pairs(*(x.join(subjects, ["query", "subject"], "left").join(small, "query", "left").where("near or floor is null") for x in (normal, short)))
    found = stored(_first_pairs(pairs, top).join(small, "query", "left").withColumn("settled", F.col("floor").isNull() | F.coalesce(F.col("last") >= F.col("floor"), F.lit(False))))
    settled = found.where("settled").select("query", "class")
    open_ = stored(floors.join(settled, "query", "left_anti").select("query"))
    if open_.isEmpty():
        return settled
    whole = [x.join(hinted(open_), "query", "left_semi") for x in (normal, short)]
    return settled.unionByName(_first_pairs(hit_pairs(*whole), top).select("query", "class"))


def header_facts(header: Column) -> dict[str, Column]:
    """What a peptide's header says: id, kind, length and coordinates; null where absent."""
    number = lambda pattern, i=1: F.nullif(F.regexp_extract(header, pattern, i), F.lit("")).cast("long")
    place = r":(\d+)-(\d+)\(([+-])\)"
    return {
        "id": F.split(header, " ")[0], "kind": orf_type(header), "length": number(r"len:(\d+)"), "start": number(place), "stop": number(place, 2),
        "strand": F.nullif(F.regexp_extract(header, place, 3), F.lit("")),
    }


def orf_type(header: Column) -> Column:
    found = F.lit("unknown")
    for kind in ("3prime_partial", "internal", "5prime_partial", "complete"):
        found = F.when(header.contains(f"type:{kind}"), kind).otherwise(found)
    return found


def _with_short(peptides: DataFrame) -> DataFrame:
    """Adds s_header and s_sequence: what ``shortened`` makes of a peptide, or null."""
    core = F.regexp_replace("sequence", r"\*$", "")
    tail = F.when(F.col("sequence").endswith("*"), "*").otherwise("")
    rows = peptides.withColumns({"core": core, "tail": tail, **{f"h_{k}": v for k, v in header_facts(F.col("header")).items()}})
    fits = F.col("h_kind").isin("5prime_partial", "internal") & F.col("core").contains("M") & F.col("h_start").isNotNull()
    rows = rows.withColumn("cut", F.instr("core", "M") - 1).withColumn("core", F.expr("substring(core, cut + 1)"))
    start = F.when(F.col("h_strand") == "+", F.col("h_start") + 3 * F.col("cut")).otherwise(F.col("h_start"))
    stop = F.when(F.col("h_strand") == "+", F.col("h_stop")).otherwise(F.col("h_stop") - 3 * F.col("cut"))
    place = F.concat(F.lit(":"), start, F.lit("-"), stop, F.lit("("), "h_strand", F.lit(")"))
    size = F.concat(F.lit("len:"), F.length("core"))
    header = F.regexp_replace(F.col("header"), F.lit(r":\d+-\d+\([+-]\)"), place)
    header = F.when(header.rlike(r"len:\d+"), F.regexp_replace(header, F.lit(r"len:\d+"), size)).otherwise(F.concat(header, F.lit(" "), size))
    return rows.select(*peptides.columns, F.when(fits, header).alias("s_header"), F.when(fits, F.concat("core", "tail")).alias("s_sequence"))


def shortened(peptides: DataFrame) -> DataFrame:
    """Incomplete peptides from their first M on, with the header's coordinates and length; others are left out."""
    rows = _with_short(peptides).where("s_header is not null")
    return rows.select("id", F.col("s_header").alias("header"), F.col("s_sequence").alias("sequence"))


def _revised(rows: DataFrame) -> DataFrame:
    """``revised`` of peptides that stand with their class and short form."""
    use = F.coalesce(orf_type(F.col("header")).isin("5prime_partial", "internal") & (F.col("class") == "complete") & F.col("s_header").isNotNull(), F.lit(False))
    fixed = F.when(F.col("s_header").contains("type:5prime_partial"), F.replace("s_header", F.lit("type:5prime_partial"), F.lit("type:complete"))).otherwise(
        F.replace("s_header", F.lit("type:internal"), F.lit("type:3prime_partial"))
    )
    return rows.select("id", F.when(use, fixed).otherwise(F.col("header")).alias("header"), F.when(use, F.col("s_sequence")).otherwise(F.col("sequence")).alias("sequence"))


def revised(peptides: DataFrame, classes: DataFrame, short: DataFrame) -> DataFrame:
    """Incomplete peptides whose class is complete take their shortened form, with the kind put right; others stay."""
    s = short.select("id", F.col("header").alias("s_header"), F.col("sequence").alias("s_sequence"))
    c = classes.select(F.col("query").alias("id"), "class")
    return _revised(peptides.join(c, "id", "left").join(s, "id", "left"))


def revised_in_place(peptides: DataFrame, classes: DataFrame) -> DataFrame:
    """``revised`` with the peptides' own shortened forms: one whose id stands once is shortened where it is, so no sequence is shuffled
    for it. Peptides of repeated ids meet all forms of their id, as they do there."""
    often = stored(peptides.groupBy("id").count().where("count > 1").select("id"))
    chosen = hinted(classes.where("class = 'complete'").select(F.col("query").alias("id"), "class"))
    if often.isEmpty():
        return _revised(_with_short(peptides).join(chosen, "id", "left"))
    few = hinted(often)
    once, more = (peptides.join(few, "id", how) for how in ("left_anti", "left_semi"))
    return _revised(_with_short(once).join(chosen, "id", "left")).unionByName(revised(more, classes, shortened(more)))


def cds_part_hints(cds: DataFrame, shrink: int = 15) -> DataFrame:
    """Coding parts without ``shrink`` bases at both ends; what would turn over becomes its middle."""
    s, e = F.col("start") + shrink, F.col("stop") - shrink
    middle = F.floor((s + e) / 2)
    return cds.withColumns({"start": F.when(s > e, middle).otherwise(s), "stop": F.when(s > e, middle).otherwise(e)})


def intron_hints(parts: DataFrame) -> DataFrame:
    """The gap between each two consecutive lines of one parent."""
    order = Window.partitionBy("seqid", "tx_id").orderBy("line_no")
    rows = parts.withColumns({"s0": F.lag("start").over(order), "e0": F.lag("stop").over(order)}).where("s0 is not null")
    low, high = F.least("stop", "e0") + 1, F.greatest("start", "s0") - 1
    return rows.select("seqid", "strand", "tx_id", low.alias("start"), high.alias("stop")).where("start <= stop")


def codon_hints(cds: DataFrame, sequences: DataFrame, codons: tuple[str, ...], at: str) -> DataFrame:
    """Coding parts that begin with a start codon (``at`` "start"), or that a stop codon follows (``at`` "stop").

    The hint lies on the part's first or last three bases, which are looked up in tiles of the sequences.
    """
    plus = F.col("strand") != "-"
    if at == "start":
        place = F.when(plus, F.col("start")).otherwise(F.col("stop") - 2)
        low = place
    else:
        place = F.when(plus, F.col("stop") + 1).otherwise(F.col("start") - 3)
        low = F.when(plus, F.col("stop") - 2).otherwise(F.col("start"))
    found = genome.with_bases(cds, genome.sequence_tiles(sequences, 2), place, 3, "codon").withColumn("codon", F.upper(on_strand(F.col("codon"), F.col("strand"))))
    return found.where(F.col("codon").isin(*codons)).select("seqid", "strand", "tx_id", low.alias("start"), (low + 2).alias("stop"), "codon")


def mult_score(attrs: Column) -> Column:
    """The number of alignments behind a hint (``mult=``), 1 unless it says."""
    return F.coalesce(F.nullif(F.regexp_extract(attrs, r"mult=(\d+)", 1), F.lit("")).cast("long"), F.lit(1).cast("long"))


def in_order(rows: DataFrame, start: str = "start", stop: str = "stop") -> DataFrame:
    """Swaps the ends of reversed intervals."""
    return rows.withColumns({start: F.least(start, stop), stop: F.greatest(start, stop)})


def mapped_rates(alignments: DataFrame, key: str, mapped: Column, least: float = 0.0) -> DataFrame:
    """(key, rate): percent of each key's alignments that are ``mapped``, if it is at least ``least``."""
    rate = 100.0 * F.count(F.when(mapped, 1)) / F.count("*")
    return alignments.groupBy(key).agg(rate.alias("rate")).where(F.col("rate") >= least)


def mapped_percent(lines: Column) -> Column:
    """The percentage in a report's line such as ``90 + 0 mapped (90.00% : N/A)``; null in other lines."""
    return F.nullif(F.regexp_extract(lines, r"^\d+ \+ \d+ mapped \((\d+(?:\.\d+)?)%", 1), F.lit("")).cast("double")


def aligned_hints(rows: DataFrame, sequences: DataFrame | None = None, source: str = "P", priority: int = 4, shrink: int = 15) -> DataFrame:
    """Hint lines (seqid, strand, type, start, stop, score, phase, grp, attrs) from alignment features.

    Features whose line has a ``*`` are left out. Ends are put in order. Coding parts give CDSpart hints; the gaps between
    consecutive coding lines of a parent give intron hints; with ``sequences``, features of type gene give start and stop
    hints where such codons stand at their first bases, or after their last.
    """
    kept = in_order(rows.where(~F.coalesce(F.col("attrs").contains("*"), F.lit(False))))
    coding = kept.where(F.lower("type").isin("cds", "protein_match"))
    columns = ["seqid", "strand", "tx_id", "start", "stop"]
    parts = cds_part_hints(coding, shrink).select(*columns, F.lit("CDSpart").alias("type"), "score", "phase")
    plain = lambda df, kind: df.select(*columns, F.lit(kind).alias("type"), F.lit("0").alias("score"), F.lit(".").alias("phase"))
    every = parts.unionByName(plain(intron_hints(coding), "intron"))
    if sequences is not None:
        genes = kept.where("type = 'gene'")
        every = every.unionByName(plain(codon_hints(genes, sequences, STARTS, "start"), "start")).unionByName(plain(codon_hints(genes, sequences, STOPS, "stop"), "stop"))
    attrs = F.concat(F.lit(f"src={source};grp="), F.coalesce("tx_id", F.lit("")), F.lit(f";pri={priority}"))
    return every.select("seqid", "strand", "type", "start", "stop", "score", "phase", F.col("tx_id").alias("grp"), attrs.alias("attrs"))


def stranded_introns(introns: DataFrame, sequences: DataFrame) -> DataFrame:
    """Introns without a strand get it from their splice sites (both: two rows; neither: none); others stay.

    With a column attrs, the score of each is its number of alignments.
    """
    extra = ["score"] if "attrs" in introns.columns else []
    rows = introns.withColumn("score", mult_score(F.col("attrs"))) if extra else introns
    known = rows.where(F.col("strand") != ".").select("seqid", "start", "stop", "strand", *extra)
    tiles = genome.sequence_tiles(sequences, 1)
    open_ = genome.with_bases(rows.where("strand = '.'"), tiles, F.col("start"), 2, "first")
    open_ = genome.with_bases(open_, tiles, F.col("stop") - 1, 2, "last").withColumn("s", splice_strand(F.col("first"), F.col("last"))).where("s is not null")
    each = F.explode(F.when(F.col("s") == "both", F.array(F.lit("+"), F.lit("-"))).otherwise(F.array("s")))
    return known.union(open_.select("seqid", "start", "stop", each.alias("strand"), *extra))


def has_stop(seq: Column) -> Column:
    """Whether a stop codon stands anywhere, in any frame."""
    return F.coalesce(F.upper(seq).rlike("|".join(STOPS)), F.lit(False))


def first_stops(seq: Column) -> tuple[Column, Column]:
    """Where the first stop codon, in any frame, begins on each strand, from 1; 0 if there is none."""
    first = lambda x: F.coalesce(F.regexp_instr(F.upper(x), F.lit("|".join(STOPS))), F.lit(0))
    return first(seq), first(revcomp(seq))


def stops_in_utrs(wanted: DataFrame, sequences: DataFrame, key: str = "tx_id") -> DataFrame:
    """(key, flag): of the ``wanted`` transcripts that have a sequence, whether a stop codon stands in it."""
    return sequences.join(wanted.select(key).distinct(), key, "left_semi").select(key, has_stop(F.col("sequence")).alias("flag"))


def candidate_rows(peptides: DataFrame, lengths: DataFrame) -> DataFrame:
    """Gene models on transcripts: gene, mRNA, exon, CDS and UTR rows of each peptide whose transcript has a length.

    ``peptides`` has (id, tx_id, start, stop, strand) of the coding part; a UTR row is left out if it is empty.
    """
    five = lambda plus: F.when(F.col("strand") == "+", plus)
    left = F.struct(five("five_prime_UTR").otherwise("three_prime_UTR").alias("type"), F.lit(1).cast("long").alias("start"), (F.col("start") - 1).alias("stop"))
    right = F.struct(five("three_prime_UTR").otherwise("five_prime_UTR").alias("type"), (F.col("stop") + 1).alias("start"), F.col("length").alias("stop"))
    whole = lambda kind: F.struct(F.lit(kind).alias("type"), F.lit(1).cast("long").alias("start"), F.col("length").alias("stop"))
    coding = F.struct(F.lit("CDS").alias("type"), F.col("start"), F.col("stop"))
    rows = peptides.join(lengths.select("tx_id", "length"), "tx_id")
    each = rows.withColumn("x", F.explode(F.array(whole("gene"), whole("mRNA"), whole("exon"), coding, left, right)))
    return each.select("tx_id", "id", "strand", "x.*").where("start <= stop")


def confident(candidates: DataFrame, no_conflict: DataFrame, stop_in_utr: DataFrame, min_cds: int = 250, min_score: float = 50.0) -> DataFrame:
    """Adds class: HC if long enough, above the score, complete, without conflict and with a stop in the 5' UTR; else LC.

    An LC candidate of a transcript that has an HC one is left out. Flags that are missing count as false.
    """
    flags = candidates.join(no_conflict.select("id", F.col("flag").alias("free")), "id", "left")
    flags = flags.join(stop_in_utr.select("tx_id", F.col("flag").alias("utr")), "tx_id", "left")
    high = (F.col("length") * 3 >= min_cds) & (F.col("score") > min_score) & (F.col("kind") == "complete") & F.coalesce("free", F.lit(False)) & F.coalesce("utr", F.lit(False))
    marked = flags.withColumn("high", F.coalesce(high, F.lit(False)))
    any_high = marked.where("high").select("tx_id").distinct()
    kept = marked.where("high").unionByName(marked.where("not high").join(any_high, "tx_id", "left_anti"))
    return kept.withColumn("class", F.when(F.col("high"), "HC").otherwise("LC")).drop("high", "free", "utr")


def prefiltered(proteins: DataFrame, ranked: DataFrame, subject: str, gate: int) -> DataFrame:
    """Proteins of the marked species only, if there are more than ``gate`` proteins; else all."""
    if proteins.limit(gate + 1).count() <= gate:
        return proteins
    wanted = ranked.where("mark = 'TOP'").select("species")
    return proteins.withColumn("species", species_of(F.col(subject))).join(wanted, "species", "left_semi").drop("species")
