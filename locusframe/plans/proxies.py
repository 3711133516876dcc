"""Projections of general tables onto genome-like ones, as DataFrames and as the same SQL.

They let every operator run, and be held against SQL, on tables of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASES = ("ACGT" * 7)[:26] + ("acgt" * 7)[:26]
RESIDUES = ("ACDEFGHIKLMNPQRSTVWY" * 2)[:26]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Dealt out by order, so lines of one are told apart and put together without another shuffle.
    return table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("p"), F.min("l_quantity").cast("long").alias("q"), F.min("l_suppkey").alias("s")
    )


def _as_features(lines: DataFrame, *more: str) -> DataFrame:
    o, ln = F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long")
    g = F.floor(o / 4)
    start = (g % 4000) * 150 + ln * 80 + F.col("p") % 30
    return lines.select(
        F.concat(F.lit("chr"), g % 4).alias("seqid"), F.when(g % 3 == 0, "-").otherwise("+").alias("strand"),
        F.concat(F.lit("g"), g).alias("gene_id"), F.concat(F.lit("t"), o).alias("tx_id"), F.lit("CDS").alias("type"),
        start.alias("start"), (start + F.col("q") - 1).alias("stop"), (o * 10 + ln).alias("line_no"),
        (o % 2).alias("file_idx"), F.col("p").cast("long").alias("p"), F.col("s").cast("long").alias("s"), *more,
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene models: an order is a transcript, its lines are coding exons, four orders are a gene."""
    return _as_features(_lines(spark, sf_dir))


FEATURES = """m AS (SELECT CAST(l_orderkey AS BIGINT) AS o, CAST(l_linenumber AS BIGINT) AS ln, CAST(min(l_partkey) AS BIGINT) AS p,
  CAST(min(l_quantity) AS BIGINT) AS q, CAST(min(l_suppkey) AS BIGINT) AS s FROM lineitem GROUP BY l_orderkey, l_linenumber),
f AS (SELECT 'chr' || (o // 4 % 4) AS seqid, CASE WHEN o // 4 % 3 = 0 THEN '-' ELSE '+' END AS strand, 'g' || (o // 4) AS gene_id,
  't' || o AS tx_id, 'CDS' AS type, (o // 4 % 4000) * 150 + ln * 80 + p % 30 AS start,
  (o // 4 % 4000) * 150 + ln * 80 + p % 30 + q - 1 AS stop, o * 10 + ln AS line_no, o % 2 AS file_idx, p, s FROM m)"""


def hits(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Alignment hits: a query for each order, a subject for each part, whose species is the supplier."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("q"), F.col("l_orderkey") % 5000).alias("query"),
        F.concat(F.lit("sp"), F.col("l_suppkey") % 40, F.lit("_"), F.col("l_partkey")).alias("subject"),
        F.round(100 * (1 - F.col("l_discount")), 2).alias("pident"), F.col("l_quantity").cast("double").alias("alen"),
        F.lit(50.0).alias("qlen"), (40 + F.col("l_partkey") % 30).cast("double").alias("slen"), F.col("l_tax").alias("evalue"),
        F.round("l_extendedprice", 2).alias("bits"), (F.col("l_linenumber") * 3).cast("long").alias("qstart"), (F.col("l_suppkey") % 20).cast("long").alias("tstart"), *more,
    )


HITS = """h AS (SELECT 'q' || (l_orderkey % 5000) AS query, 'sp' || (l_suppkey % 40) || '_' || l_partkey AS subject,
  round(100 * (1 - l_discount), 2) AS pident, CAST(l_quantity AS DOUBLE) AS alen, 50.0::DOUBLE AS qlen, CAST(40 + l_partkey % 30 AS DOUBLE) AS slen,
  l_tax AS evalue, round(l_extendedprice, 2) AS bits, CAST(l_linenumber * 3 AS BIGINT) AS qstart, CAST(l_suppkey % 20 AS BIGINT) AS tstart FROM lineitem)"""


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences: letters of documents as bases (case is the soft mask), all else as N."""
    seq = F.regexp_replace(F.translate("text", LETTERS, BASES), "[^ACGTacgt]", "N")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("seq_name"), F.col("doc_id").cast("long").alias("seq_ord"), seq.alias("sequence"))


DNA = f"""d AS (SELECT 'd' || doc_id AS seq_name, CAST(doc_id AS BIGINT) AS seq_ord,
  regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGTacgt]', 'N', 'g') AS sequence FROM documents)"""


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of some hundred bases: 16 from the digest of each line of 16 neighbouring orders, in their order."""
    o = F.col("l_orderkey").cast("long")
    # Dealt out by contig, so the lines of one are told apart and put together without another shuffle.
    rows = table(spark, sf_dir, "lineitem").select(F.floor(o / 16).alias("k"), o.alias("o"), F.col("l_linenumber").cast("long").alias("ln")).repartition("k").distinct()
    bases = F.translate(F.substring(F.md5(F.concat_ws("-", "o", "ln")), 1, 16), "0123456789abcdef", "ACGTACGTACGTACGT")
    whole = rows.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("o", "ln", bases.alias("bases")))).alias("lines"))
    return whole.select(F.concat(F.lit("c"), "k").alias("seq_name"), F.array_join(F.transform("lines", lambda x: x["bases"]), "").alias("sequence"))


CONTIGS = """ctg AS (SELECT 'c' || (o // 16) AS seq_name, string_agg(translate(substr(md5(o || '-' || ln), 1, 16), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY o, ln) AS sequence
  FROM (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS o, CAST(l_linenumber AS BIGINT) AS ln FROM lineitem) GROUP BY o // 16)"""


def on_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gene models with the documents as their sequences: each transcript in one of them, anywhere in its length."""
    docs, o = table(spark, sf_dir, "documents"), F.col("l_orderkey").cast("long")
    lengths = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc"), F.length("text").cast("long").alias("n"))
    # The join moves the lines' numbers; ids are made of them after it.
    lines = _lines(spark, sf_dir).withColumn("doc", F.concat(F.lit("d"), o % docs.count())).join(lengths, "doc")
    start = 1 + o * 37 % F.greatest(F.lit(1).cast("long"), F.col("n") - 700) + F.col("l_linenumber").cast("long") * 80 + F.col("p").cast("long") % 30
    rows = _as_features(lines.withColumn("at", start), "doc", "at")
    return rows.withColumns({"seqid": F.col("doc"), "stop": F.col("at") + F.col("stop") - F.col("start"), "start": F.col("at")}).drop("doc", "at")


#: After FEATURES and DNA.
ON_DOCUMENTS = """fd AS (SELECT seqid, strand, gene_id, tx_id, type, start, start + width AS stop, line_no, file_idx, p, s FROM (
  SELECT d.seq_name AS seqid, strand, gene_id, tx_id, type, stop - start AS width, line_no, file_idx, p, s,
    1 + CAST(substr(tx_id, 2) AS BIGINT) * 37 % greatest(1, length(sequence) - 700) + line_no % 10 * 80 + p % 30 AS start
  FROM f JOIN d ON d.seq_name = 'd' || (CAST(substr(tx_id, 2) AS BIGINT) % (SELECT count(*) FROM documents))))"""


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by position: a user is a sequence, half an hour is a position."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id") % 20).alias("seqid"), F.when(F.col("event_type").isin("view", "click"), "+").otherwise("-").alias("strand"),
        F.floor(F.unix_timestamp("ts") / 1800).alias("pos"), F.col("value").cast("double").alias("val"), F.col("event_id").cast("long").alias("event_id"),
    )


TRACK = """w AS (SELECT 'u' || (user_id % 20) AS seqid, CASE WHEN event_type IN ('view', 'click') THEN '+' ELSE '-' END AS strand,
  CAST(floor(epoch(date_trunc('second', ts)) / 1800) AS BIGINT) AS pos, CAST(value AS DOUBLE) AS val, CAST(event_id AS BIGINT) AS event_id FROM events)"""


def peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peptides with the facts of their headers: type, coordinates, strand."""
    kind = F.element_at(F.array(*map(F.lit, ("complete", "5prime_partial", "internal", "3prime_partial"))), (F.col("doc_id") % 4 + 1).cast("int"))
    seq = F.regexp_replace(F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), LETTERS[:26], RESIDUES), "Y", "YM")
    seq = F.concat(seq, F.when(F.col("doc_id") % 2 == 0, "*").otherwise(""))
    start = F.col("doc_id") * 10 + 1
    header = F.concat(
        F.lit("p"), "doc_id", F.lit(" type:"), kind, F.lit(" len:"), F.length("sequence"), F.lit(" :"), start, F.lit("-"), start + 3 * F.length("sequence") - 1,
        F.when(F.col("doc_id") % 3 == 0, "(-)").otherwise("(+)"),
    )
    # As an exploded array of one, the sequence is computed once, whatever is selected from it later.
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(seq)).alias("sequence"))
    return rows.select(F.concat(F.lit("p"), "doc_id").alias("id"), header.alias("header"), "sequence")


PEPTIDES = f"""p0 AS (SELECT doc_id, (['complete', '5prime_partial', 'internal', '3prime_partial'])[doc_id % 4 + 1] AS kind,
  replace(translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS[:26]}', '{RESIDUES}'), 'Y', 'YM')
    || CASE WHEN doc_id % 2 = 0 THEN '*' ELSE '' END AS sequence FROM documents),
pep AS (SELECT 'p' || doc_id AS id, 'p' || doc_id || ' type:' || kind || ' len:' || length(sequence) || ' :' || (doc_id * 10 + 1) || '-'
  || (doc_id * 10 + 3 * length(sequence)) || CASE WHEN doc_id % 3 = 0 THEN '(-)' ELSE '(+)' END AS header, sequence FROM p0)"""
