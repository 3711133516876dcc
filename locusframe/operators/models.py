"""Gene models as rows of annotation files: from files to transcripts, and from merged or repaired transcripts to rows.

A row has (seqid, source, type, start, stop, score, strand, phase, attrs) and columns to sort by; ``sources.text`` writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.attributes import format_pairs
from locusframe.operators.merging import KEYS
from locusframe.operators.transcripts import TX, in_reading_order

#: Feature types of untranslated regions (fixed values).
UTR = ("UTR", "five_prime_UTR", "three_prime_UTR", "5UTR", "3UTR", "5_prime_UTR", "3_prime_UTR")
#: What stands in for a missing source.
NO_SOURCE = "merge"
#: Of a coding part by its place: 2 if it is the first, and 1 if it is the last.
KINDS = ("internal", "terminal", "initial", "single")


def _joined(spans: Column) -> Column:
    """Ordered intervals (start, stop) as their union; adjacent ones are joined."""
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["stop"] + 1),
        F.concat(
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
            F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop"))),
        ),
    ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["stop"].alias("stop")))))
    return F.aggregate(spans, F.array().cast("array<struct<start:bigint,stop:bigint>>"), step)


def models_of(features: DataFrame) -> DataFrame:
    """One row a transcript of each input: what ``merging`` works on, and its exon, CDS and UTR parts for output.

    ``features`` are rows of files (``read_models``): file_idx, source, type, phase, line_no and ids. A transcript is told
    apart by file, sequence, strand and id, and must have exons or coding parts. start, stop and parts are those of its
    exons, or of its coding parts without any; out_start and out_stop include UTRs; utr_bp is the length of their union.
    """
    own = features.where(F.col("type").isin("exon", "CDS", *UTR) & F.col("tx_id").isNotNull())
    span = F.struct("start", "stop")
    of = lambda kind, x: F.sort_array(F.collect_list(F.when(kind, x)))
    utr = F.col("type").isin(*UTR)
    tx = own.groupBy("file_idx", *TX).agg(
        of(F.col("type") == "exon", span).alias("exons"), of(F.col("type") == "CDS", F.struct("start", "stop", "phase")).alias("cds"),
        of(utr, F.struct("start", "stop", "type")).alias("utr"), F.min("line_no").alias("line_no"), F.min("gene_id").alias("gene_id"),
        F.sort_array(F.collect_set(F.nullif(F.nullif("source", F.lit(".")), F.lit("")))).alias("sources"),
    )
    tx = tx.where((F.size("exons") > 0) | (F.size("cds") > 0))
    parts = F.when(F.size("exons") > 0, F.col("exons")).otherwise(F.transform("cds", lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"))))
    low = lambda a: F.array_min(F.transform(a, lambda x: x["start"]))
    high = lambda a: F.array_max(F.transform(a, lambda x: x["stop"]))
    tx = tx.withColumn("parts", parts).withColumns({"start": low("parts"), "stop": high("parts")})
    length = F.aggregate(_joined(F.col("utr")), F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"] + 1)
    name = F.concat_ws(":", F.col("file_idx"), *KEYS, "tx_id")
    return tx.withColumns({
        "out_start": F.least("start", F.coalesce(low("utr"), "start")), "out_stop": F.greatest("stop", F.coalesce(high("utr"), "stop")), "utr_bp": length,
        "tx_id": name, "line_no": F.col("file_idx") * (1 << 40) + F.col("line_no"),
    })


def _row(kind: Column, start: Column, stop: Column, phase: Column, rank: int | Column, i: Column, pairs: list[tuple[str, Column]]) -> Column:
    return F.struct(
        kind.alias("type"), start.alias("start"), stop.alias("stop"), phase.alias("phase"), (F.lit(rank) if isinstance(rank, int) else rank).alias("rank"),
        i.cast("int").alias("i"), format_pairs(pairs).alias("attrs"),
    )


def cluster_rows(merged: DataFrame) -> DataFrame:
    """Rows of gene, transcript, exon, UTR and CDS of a merged annotation (``models_of``, then ``merging``).

    Sort them by (gene, nth, rank, i) for a file: genes by their number, transcripts by theirs.
    """
    dot, none = F.lit("."), F.lit(None).cast("int")
    nth = F.substring_index("tx", ".t", -1).cast("int")
    source = F.when(F.size("sources") > 0, F.array_join("sources", ",")).otherwise(NO_SOURCE)
    number = lambda prefix, i: F.concat("tx", F.lit(prefix), (i + 1).cast("string"))
    part = lambda kind, rank, prefix: lambda x, i: _row(
        kind(x), x["start"], x["stop"], dot, rank, i, [("ID", number(prefix, i)), ("Parent", F.col("tx"))]
    )
    exons = F.transform("parts", part(lambda x: F.lit("exon"), 1, ".exon"))
    utrs = F.transform("utr", part(lambda x: x["type"], 2, ".utr"))
    cds = F.transform("cds", lambda x, i: _row(
        F.lit("CDS"), x["start"], x["stop"], F.coalesce(F.nullif(x["phase"], F.lit("")), dot), 3, i, [("ID", number(".cds", i)), ("Parent", F.col("tx"))]
    ))
    whole = F.array(_row(F.lit("transcript"), F.col("out_start"), F.col("out_stop"), dot, 0, none, [("ID", F.col("tx")), ("Parent", F.col("gene"))]))
    each = merged.select("seqid", "strand", "gene", nth.alias("nth"), source.alias("source"), F.explode(F.concat(whole, exons, utrs, cds)).alias("x"))
    genes = merged.groupBy("seqid", "strand", "gene").agg(
        F.min("out_start").alias("start"), F.max("out_stop").alias("stop"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources")
    )
    top = genes.select("seqid", "strand", "gene", F.lit(0).alias("nth"), source.alias("source"), _row(F.lit("gene"), F.col("start"), F.col("stop"), dot, 0, none, [("ID", F.col("gene"))]).alias("x"))
    return top.unionByName(each).select("seqid", "source", "x.type", "x.start", "x.stop", dot.alias("score"), "strand", "x.phase", "x.attrs", "gene", "nth", "x.rank", "x.i")


def rebuilt_genes(cds: DataFrame, utrs: DataFrame, parents: DataFrame, known_genes: DataFrame) -> DataFrame:
    """(seqid, gene_id, gene_start, strand, made, tx and others): genes anew with their transcripts, and those with their parts, from which ``rebuilt_lines``
    makes rows. A gene has a row for each sequence that it is on.

    A transcript without coding parts is left out. ``parents`` (tx_id, gene_id) names its gene; one that isn't in ``known_genes`` (gene_id), or none,
    is made: ``<transcript>.gene``. ``cds`` and ``utrs`` have (TX, source, type, start, stop, phase). Transcripts are shuffled whole, and no line is.
    """
    none = F.lit(None).cast("string")
    # What a coding part says goes to one list, what a UTR says to the other.
    part = F.struct("start", "stop", F.col("phase").cast("string").alias("phase"))
    utr = F.struct("start", "stop", "type")
    mine = cds.select(*TX, "source", part.alias("cds")).withColumn("utr", F.lit(None).cast(utrs.select(utr.alias("x")).schema["x"].dataType))
    other = utrs.select(none.alias("seqid"), none.alias("strand"), "tx_id", none.alias("source"), F.lit(None).cast(mine.schema["cds"].dataType).alias("cds"), utr.alias("utr"))
    tx = mine.unionByName(other).groupBy("tx_id").agg(
        F.min("seqid").alias("seqid"), F.min("strand").alias("strand"), F.min("source").alias("source"), F.sort_array(F.collect_list("cds")).alias("cds"), F.sort_array(F.collect_list("utr")).alias("utr")
    ).where(F.size("cds") > 0)
    ends = lambda how, field: F.array_compact(F.array(*(how(F.transform(c, lambda x: x[field])) for c in ("cds", "utr"))))
    tx = tx.withColumns({"start": F.array_min(ends(F.array_min, "start")), "stop": F.array_max(ends(F.array_max, "stop"))})
    own = parents.groupBy("tx_id").agg(F.min("gene_id").alias("gene_id")).join(known_genes.select("gene_id").distinct(), "gene_id", "left_semi")
    tx = tx.join(own, "tx_id", "left").withColumn("made", F.col("gene_id").isNull()).withColumn("gene_id", F.coalesce("gene_id", F.concat("tx_id", F.lit(".gene"))))
    genes = tx.groupBy("gene_id").agg(
        F.min("seqid").alias("first"), F.min("strand").alias("strand"), F.min("start").alias("gene_start"), F.max("stop").alias("gene_stop"), F.bool_and("made").alias("made"), F.min("source").alias("source"),
        F.collect_list(F.struct("tx_id", "seqid", "strand", "source", "start", "stop", "cds", "utr")).alias("tx"),
    )
    return genes.withColumn("seqid", F.explode(F.array_distinct(F.concat(F.array("first"), F.transform("tx", lambda t: t["seqid"])))))


def rebuilt_lines() -> Column:
    """Rows of each of the ``rebuilt_genes`` on its sequence in their order in a file, as structs (tx_start, tx_id, rank, i, type, start, stop, phase, strand, source,
    attrs). Exons are the union of coding parts and UTRs, adjacent parts joined."""
    dot, none = F.lit("."), F.lit(None).cast("int")

    def row(tx: tuple[Column, Column], rank: int, i: Column, kind: Column, x: Column, phase: Column, strand: Column, source: Column, pairs: list[tuple[str, Column]], ends: tuple[str, str] = ("start", "stop")) -> Column:
        low, high = (x[e] if x is not None else F.col(e) for e in ends)
        return F.struct(
            tx[0].alias("tx_start"), tx[1].alias("tx_id"), F.lit(rank).alias("rank"), i.cast("int").alias("i"), kind.alias("type"), low.alias("start"), high.alias("stop"), phase.alias("phase"),
            strand.alias("strand"), source.alias("source"), format_pairs(pairs).alias("attrs"),
        )

    def of(t: Column) -> Column:
        place, own = (t["start"], t["tx_id"]), (t["strand"], t["source"])
        ids = lambda prefix, i: [("ID", F.concat(t["tx_id"], F.lit(prefix), (i + 1).cast("string"))), ("Parent", t["tx_id"])]
        span = lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))
        exons = _joined(F.sort_array(F.concat(F.transform(t["cds"], span), F.transform(t["utr"], span))))
        return F.concat(
            F.array(row(place, 0, none, F.lit("transcript"), t, dot, *own, [("ID", t["tx_id"]), ("Parent", F.col("gene_id"))])),
            F.transform(exons, lambda x, i: row(place, 1, i, F.lit("exon"), x, dot, *own, ids(".exon", i))),
            F.transform(t["cds"], lambda x, i: row(place, 2, i, F.lit("CDS"), x, F.coalesce(x["phase"], dot), *own, ids(".cds", i))),
            F.transform(t["utr"], lambda x, i: row(place, 3, i, x["type"], x, dot, *own, ids(".utr", i))),
        )

    source = F.when(F.col("made"), "rebuild").otherwise(F.col("source"))
    top = row((F.lit(None).cast("long"), F.lit(None).cast("string")), 0, none, F.lit("gene"), None, dot, F.col("strand"), source, [("ID", F.col("gene_id"))], ("gene_start", "gene_stop"))
    here = F.flatten(F.transform(F.filter("tx", lambda t: t["seqid"].eqNullSafe(F.col("seqid"))), of))
    return F.sort_array(F.when(F.col("seqid").eqNullSafe(F.col("first")), F.concat(F.array(top), here)).otherwise(here))


def rebuilt_rows(cds: DataFrame, utrs: DataFrame, parents: DataFrame, known_genes: DataFrame) -> DataFrame:
    """Rows of gene, transcript, exon, CDS and UTR anew from coding parts (extended by ``with_stop_codon``) and UTRs, as ``rebuilt_genes`` has them.

    Sort by (seqid, gene_start, gene_id, tx_start, tx_id, rank, i) for a file, or write the genes with their lines (``sources.text.write_groups``).
    """
    rows = rebuilt_genes(cds, utrs, parents, known_genes).select("seqid", "gene_id", "gene_start", F.explode(rebuilt_lines()).alias("x"))
    return rows.select("seqid", "x.source", "x.type", "x.start", "x.stop", F.lit(".").alias("score"), "x.strand", "x.phase", "x.attrs", "gene_id", "gene_start", "x.tx_start", "x.tx_id", "x.rank", "x.i")


def isoform_lines(features: DataFrame, chosen: DataFrame) -> DataFrame:
    """The lines (read_gff with ``raw``) of ``chosen`` transcripts (gene_id, tx_id), with a gene and a transcript line before
    the first of each. Sort by (file, place) for a file."""
    lines = features.where(~F.col("type").isin("gene", "transcript", "mRNA")).join(chosen.select("gene_id", "tx_id"), ["gene_id", "tx_id"], "left_semi")
    spans = lines.groupBy("file", "gene_id", "tx_id").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("line_no").alias("line_no"), F.min_by(F.struct("seqid", "source", "strand"), "line_no").alias("x")
    )

    def head(kind: str, attrs: Column, before: float) -> DataFrame:
        line = F.concat_ws("\t", F.col("x.seqid"), F.col("x.source"), F.lit(kind), F.col("start").cast("string"), F.col("stop").cast("string"), F.lit("."), F.col("x.strand"), F.lit("."), attrs)
        return spans.select("file", (F.col("line_no") - before).alias("place"), line.alias("line"))

    gene = F.concat(F.lit('gene_id "'), "gene_id", F.lit('";'))
    tx = F.concat(gene, F.lit(' transcript_id "'), "tx_id", F.lit('";'))
    return lines.select("file", F.col("line_no").cast("double").alias("place"), "line").unionByName(head("gene", gene, 0.2)).unionByName(head("transcript", tx, 0.1))


def gtf_genes(features: DataFrame) -> DataFrame:
    """(seqid, gene_id, gene_start, gene_stop, gene_strand, tx): genes with their transcripts, and those with their parts, from whose ids and places
    ``gtf_lines`` makes rows.

    Transcripts are put together before they are shuffled, so ids go once with a transcript, not with each part, and texts are not
    shuffled at all.
    """
    parts = features.where(~F.col("type").isin("gene", "transcript", "mRNA"))
    dot, more = F.lit("."), {}
    if "source" in features.columns:
        more["source"] = F.coalesce("source", dot)
    if "phase" in features.columns:
        more["phase"] = F.coalesce(F.col("phase").cast("string"), dot)
    part = F.struct("type", "line_no", "start", "stop", "gene_id", *(x.alias(c) for c, x in more.items()))
    # Parts of a type stand together, in reading direction.
    key = lambda x: F.when(F.col("strand") == "-", -x["stop"]).otherwise(x["start"])
    placed = F.transform("own", lambda x: F.struct(x["type"].alias("type"), key(x).alias("key"), x["line_no"].alias("line_no"), x.alias("x")))
    # Exploded as an array of one, what is looked at many times is worked out once.
    tx = parts.groupBy(*TX).agg(F.collect_list(part).alias("own")).select(*TX, F.explode(F.array(F.transform(F.sort_array(placed), lambda x: x["x"]))).alias("own"))
    tx = tx.withColumn("exons", F.exists("own", lambda x: x["type"] == "exon"))
    ends = lambda x, i, step: F.coalesce(F.get("own", i + step)["type"] != x["type"], F.lit(True))
    kind = lambda first, last: (F.when(first, 2).otherwise(0) + F.when(last, 1).otherwise(0)).cast("byte")
    slim = F.transform("own", lambda x, i: F.struct(
        x["type"].alias("type"), x["start"].alias("start"), x["stop"].alias("stop"), F.when(x["type"] == "CDS", kind(ends(x, i, -1), ends(x, i, 1))).alias("kind"),
        ((x["type"] == "CDS") & ~F.col("exons")).alias("twice"), x["gene_id"].alias("gene_id"), *(x[c].alias(c) for c in more)
    ))
    each = tx.select(*TX, F.explode(F.array(slim)).alias("own")).withColumn("gene_id", F.explode(F.array_distinct(F.transform("own", lambda x: x["gene_id"]))))
    own = F.filter("own", lambda x: x["gene_id"].eqNullSafe(F.col("gene_id")))
    each = each.select(*TX, "gene_id", F.explode(F.array(F.transform(own, lambda x: x.dropFields("gene_id")))).alias("own"))
    span = {"start": F.array_min(F.transform("own", lambda x: x["start"])), "stop": F.array_max(F.transform("own", lambda x: x["stop"]))}
    return each.withColumns(span).groupBy("seqid", "gene_id").agg(
        F.min("start").alias("gene_start"), F.max("stop").alias("gene_stop"), F.min("strand").alias("gene_strand"), F.collect_list(F.struct("tx_id", "strand", "start", "stop", "own")).alias("tx")
    )


def gtf_lines(genes: DataFrame, prefix: str = "") -> Column:
    """Rows of each of the ``gtf_genes`` in their order in a file, as structs (tx_id, rank, start, stop, type, source, strand, phase, attrs)."""
    dot, start = F.lit("."), f"{prefix}." if prefix else ""
    fields = genes.schema["tx"].dataType.elementType["own"].dataType.elementType.names

    def row(tx_id: Column, rank: int, at: Column, kind: Column, source: Column, strand: Column, phase: Column, attrs: Column, ends: tuple[str, str] = ("start", "stop")) -> Column:
        low, high = (at[e] if at is not None else F.col(e) for e in ends)
        return F.struct(
            tx_id.alias("tx_id"), F.lit(rank).alias("rank"), low.alias("start"), high.alias("stop"), kind.alias("type"), source.alias("source"), strand.alias("strand"),
            phase.alias("phase"), attrs.alias("attrs"),
        )

    def parts(t: Column) -> Column:
        name = F.concat(F.lit(start), t["tx_id"])
        ids = F.concat(F.lit('transcript_id "'), name, F.lit('"; gene_id "'), F.col("gene_id"), F.lit('";'))

        def part(x: Column) -> Column:
            of = lambda c: x[c] if c in fields else dot
            cds = F.concat(ids, F.when(x["type"] == "CDS", F.concat(F.lit(" cds_type="), F.get(F.array(*map(F.lit, KINDS)), x["kind"]), F.lit(";"))).otherwise(""))
            one = row(t["tx_id"], 2, x, x["type"], of("source"), t["strand"], of("phase"), cds)
            return F.when(x["twice"], F.array(one, row(t["tx_id"], 2, x, F.lit("exon"), of("source"), t["strand"], of("phase"), ids))).otherwise(F.array(one))

        return F.concat(F.array(row(t["tx_id"], 1, t, F.lit("transcript"), dot, t["strand"], dot, name)), F.flatten(F.transform(t["own"], part)))

    gene = row(F.lit(None).cast("string"), 0, None, F.lit("gene"), dot, F.col("gene_strand"), dot, F.col("gene_id"), ("gene_start", "gene_stop"))
    # Parts without a gene or sequence have no gene to stand in.
    named = F.col("gene_id").isNotNull() & F.col("seqid").isNotNull()
    return F.when(named, F.sort_array(F.concat(F.array(gene), F.flatten(F.transform("tx", parts))))).otherwise(F.array(gene))


def gtf_rows(features: DataFrame, prefix: str = "") -> DataFrame:
    """Rows of an annotation as GTF: genes with bare ids, transcripts with bare ids, then parts by start, with cds_type.

    Coding parts stand as exons, too, in transcripts without any. Sort by (seqid, gene_start, gene_stop, gene_id, tx_id,
    rank, start, stop, type) for a file, or write ``gtf_genes`` with their ``gtf_lines`` (``sources.text.write_groups``).
    """
    genes = gtf_genes(features)
    rows = genes.select("seqid", "gene_start", "gene_stop", "gene_id", F.explode(gtf_lines(genes, prefix)).alias("x"))
    return rows.select("seqid", "x.source", "x.type", "x.start", "x.stop", F.lit(".").alias("score"), "x.strand", "x.phase", "x.attrs", "gene_start", "gene_stop", "gene_id", "x.tx_id", "x.rank")


def as_gff3(features: DataFrame) -> DataFrame:
    """GTF rows as GFF3 rows: ids become ID and Parent."""
    own = F.when(F.col("type") == "gene", F.concat(F.lit("ID="), "gene_id")).when(
        F.col("type").isin("transcript", "mRNA"), F.concat(F.lit("ID="), "tx_id", F.lit(";Parent="), "gene_id")
    )
    return features.drop("attributes").withColumn("attrs", own.otherwise(F.concat(F.lit("Parent="), "tx_id")))


def hierarchy_counts(rows: DataFrame) -> DataFrame:
    """(gene_id, n_tx, n_utr, n_cds) of GFF3 rows: genes, transcripts by their parent gene, parts by their parent."""
    tx = rows.where(F.col("type").isin("transcript", "mRNA")).select("tx_id", F.col("gene_id").alias("gene"))
    parts = rows.where(F.col("type").isin("CDS", "exon", *UTR)).groupBy("tx_id").agg(
        F.count(F.when(F.col("type").isin(*UTR), 1)).alias("utr"), F.count(F.when(F.col("type") == "CDS", 1)).alias("cds")
    )
    both = tx.join(parts, "tx_id", "left")
    return both.groupBy(F.col("gene").alias("gene_id")).agg(
        F.countDistinct("tx_id").alias("n_tx"), F.coalesce(F.sum("utr"), F.lit(0)).alias("n_utr"), F.coalesce(F.sum("cds"), F.lit(0)).alias("n_cds")
    )
