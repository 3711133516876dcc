"""Queries of gene decoding, with SQL that finds the same best paths by recursion over positions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions import examples, genome
from locusframe.operators import decoding, evidence, grammar, labels, models
from locusframe.operators import transcripts as T
from locusframe.plans import proxies as P
from locusframe.plans.queries import FD, F_, KEYS, LABELS, REV, D, gc_scores, query
from locusframe.session import fresh_path, stored
from locusframe.sources import cards, parts
from locusframe.sources import text as io

#: Mean lengths of exons, introns and what is between genes, and scores of a strong (G, C) and a weak base (A, T) in exons and introns.
MOVES = grammar.gene_moves(40, 60, 150)
STRONG, WEAK = {"exon": 350_000, "intron": -250_000}, {"exon": -150_000, "intron": 300_000}
LEAST = 45


_BY_BASE = np.zeros((256, grammar.STATES), np.int64)
for _bases, _score in (("GCgc", STRONG), ("ATat", WEAK)):
    _BY_BASE[list(_bases.encode()), 4:] = _score["exon"]
    _BY_BASE[list(_bases.encode()), 1:4] = _score["intron"]


def base_scores(sequences: list[str]) -> np.ndarray:
    """Scores of the 15 states by base alone: exons like G and C, introns A and T; the rest, and other letters, have none."""
    letters = np.frombuffer("".join(sequences).encode(), np.uint8).reshape(len(sequences), -1)
    return _BY_BASE[letters]


def _recursion() -> str:
    """Tables path (seq_name, strand, n, score, genes) of the best paths; genes is text such as ``;12-50,80-120``, on the own strand."""
    states = range(grammar.STATES)
    new_s, new_g = [], []
    for to in states:
        ways = [(s, f"s{s} + ({int(MOVES[s, to])})") for s in states if to in grammar.STEPS[s]]
        ways = [(s, f"CASE WHEN NOT stop_here THEN {x} END" if s == 5 and to in (6, 9) else x) for s, x in ways]
        best = f"greatest({', '.join(x for _, x in ways)})"
        kind = "0" if to == 0 else "e_intron" if to in grammar.INTRONS else "e_exon"
        mask = {grammar.START: "start_here", grammar.STOP: "stop_here"} | {s: "donor_here" for s in grammar.EXON_ENDS} | {s: "acceptor_here" for s in grammar.EXON_BEGINS}
        score = f"{best} + {kind}"
        new_s.append((f"CASE WHEN {mask[to]} THEN {score} END" if to in mask else score) + f" AS s{to}")
        said = {grammar.START: "|| ';' || p", grammar.STOP: "|| '-' || p"} | {s: "|| '-' || p" for s in grammar.EXON_ENDS} | {s: "|| ',' || p" for s in grammar.EXON_BEGINS}
        text = " ".join(f"WHEN {x} = {best} THEN g{s}" for s, x in ways)
        new_g.append(f"(CASE {text} END) {said.get(to, '')} AS g{to}")
    s_names, g_names = ", ".join(f"s{i}" for i in states), ", ".join(f"g{i}" for i in states)
    strong, weak = "b IN ('G', 'C')", "b IN ('A', 'T')"
    return f"""strands AS (SELECT seq_name, '+' AS strand, upper(sequence) AS q FROM ctg UNION ALL SELECT seq_name, '-', upper({REV.format("sequence")}) FROM ctg),
walk AS (
  SELECT seq_name, strand, q, CAST(0 AS BIGINT) AS p, {', '.join(f"CAST({'0' if i == 0 else 'NULL'} AS BIGINT) AS s{i}" for i in states)}, {', '.join(f"CAST('' AS VARCHAR) AS g{i}" for i in states)} FROM strands WHERE length(q) > 0
  UNION ALL
  SELECT seq_name, strand, q, p, {', '.join(new_s)}, {', '.join(new_g)}
  FROM (SELECT *, substr(q, p, 3) = 'ATG' AS start_here, p > 2 AND substr(q, p - 2, 3) IN ('TAA', 'TAG', 'TGA') AS stop_here,
      substr(q, p + 1, 2) IN ('GT', 'GC') AS donor_here, p > 2 AND substr(q, p - 2, 2) = 'AG' AS acceptor_here,
      CASE WHEN {strong} THEN {STRONG['exon']} WHEN {weak} THEN {WEAK['exon']} ELSE 0 END AS e_exon, CASE WHEN {strong} THEN {STRONG['intron']} WHEN {weak} THEN {WEAK['intron']} ELSE 0 END AS e_intron
    FROM (SELECT seq_name, strand, q, p + 1 AS p, substr(q, p + 1, 1) AS b, {s_names}, {g_names} FROM walk WHERE p < length(q)))
),
path AS MATERIALIZED (SELECT seq_name, strand, length(q) AS n, greatest(s0, s14) AS score, CASE WHEN s0 = greatest(s0, s14) THEN g0 ELSE g14 END AS genes FROM walk WHERE p = length(q))"""


GENES = f"""ge AS (SELECT seq_name, strand, n, unnest(list_filter(string_split(genes, ';'), lambda x: x <> '')) AS parts FROM path),
ex AS (SELECT seq_name, strand, n, CAST(regexp_extract(parts, '^[0-9]+') AS BIGINT) AS tx, unnest(string_split(parts, ',')) AS x FROM ge),
ec AS (SELECT seq_name, strand, n, tx, CAST(split_part(x, '-', 1) AS BIGINT) AS a, CAST(split_part(x, '-', 2) AS BIGINT) AS b FROM ex),
sq AS (SELECT ec.seq_name, ec.strand, tx, string_agg(substr(q, a, b - a + 1), '' ORDER BY a) AS s FROM ec JOIN strands USING (seq_name, strand) GROUP BY ALL),
ok AS (SELECT seq_name, strand, tx FROM sq WHERE length(s) >= {LEAST} AND len(list_filter(range(1, length(s) - 3, 3), lambda i: substr(s, i, 3) IN ('TAA', 'TAG', 'TGA'))) = 0),
fe AS (SELECT seq_name AS seqid, strand, seq_name || CASE WHEN strand = '-' THEN '.minus.' ELSE '.plus.' END || tx AS gene_id, CASE WHEN strand = '-' THEN n + 1 - b ELSE a END AS start,
  CASE WHEN strand = '-' THEN n + 1 - a ELSE b END AS stop, a AS line_no FROM ec JOIN ok USING (seq_name, strand, tx)),
fp AS (SELECT *, (3 - coalesce(sum(stop - start + 1) OVER (PARTITION BY gene_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 3) % 3 AS phase,
  count(*) OVER (PARTITION BY gene_id) AS c, row_number() OVER (PARTITION BY gene_id ORDER BY line_no) AS r FROM fe),
names AS (SELECT *, 'transcript_id "' || gene_id || '.t1"; gene_id "' || gene_id || '";' AS a FROM fp)"""


def _said(pieces: DataFrame, scores: DataFrame) -> DataFrame:
    """Coding exons of all transcripts of each sequence and strand as text."""
    exons = F.array_sort(F.collect_list(F.struct("start", "stop")))
    text = F.concat(F.lit(";"), F.array_join(F.transform("exons", lambda x: F.concat(x["start"], F.lit("-"), x["stop"])), ","))
    each = grammar.gene_parts(pieces).groupBy(*grammar.KEYS, "tx").agg(exons.alias("exons")).select(*grammar.KEYS, "tx", text.alias("text"))
    genes = each.groupBy(*grammar.KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tx", "text"))), lambda x: x["text"]), "").alias("genes"))
    return scores.join(genes, grammar.KEYS, "left").withColumn("genes", F.coalesce("genes", F.lit("")))


@query("decode_grammar", "SELECT seq_name, strand, score, genes FROM path", f"RECURSIVE {P.CONTIGS}, {_recursion()}")
def decode_grammar(spark, d):
    """The best path of gene labels through each sequence, both strands: its score, and coding exons by transcript."""
    found = stored(grammar.decoded_blocks(stored(P.contigs(spark, d)), base_scores, MOVES, size=256))
    return _said(grammar.path_pieces(found), found.where("score is not null").select(*grammar.KEYS, "score"))


@query("annotate_again", "SELECT seq_name, strand, genes FROM path", f"RECURSIVE {P.CONTIGS}, {_recursion()}")
def annotate_again(spark, d):
    """What blocks cut is decoded again around their borders. The scores here are by base alone, so the best path stays what it was."""
    sequences = stored(P.contigs(spark, d))
    first = stored(grammar.decoded_blocks(sequences, base_scores, MOVES, size=128))
    pieces = grammar.predicted_again(sequences, first, base_scores, MOVES, 128, grammar.REACH)
    return _said(pieces, first.where("score is not null").select(*grammar.KEYS))


@query("annotate_genes", """SELECT seqid, 'gene' AS type, min(start) AS start, max(stop) AS stop, strand, '.' AS phase, gene_id AS attrs FROM fp GROUP BY seqid, strand, gene_id
UNION ALL SELECT seqid, 'transcript', min(start), max(stop), strand, '.', gene_id || '.t1' FROM fp GROUP BY seqid, strand, gene_id
UNION ALL SELECT seqid, 'CDS', start, stop, strand, CAST(CAST(phase AS BIGINT) AS VARCHAR), a || ' cds_type=' || CASE WHEN c = 1 THEN 'single' WHEN r = 1 THEN 'initial' WHEN r = c THEN 'terminal' ELSE 'internal' END || ';' FROM names
UNION ALL SELECT seqid, 'exon', start, stop, strand, CAST(CAST(phase AS BIGINT) AS VARCHAR), a FROM names""", f"RECURSIVE {P.CONTIGS}, {_recursion()}, {GENES}")
def annotate_genes(spark, d):
    """Gene models predicted for whole sequences, with phases, written as a GTF file and read again."""
    cds = grammar.annotated_genes(P.contigs(spark, d), base_scores, MOVES, size=256, least=LEAST)
    path = fresh_path(spark)
    io.write_gtf(models.gtf_rows(T.with_phase(cds)), path, ["seqid", "gene_start", "gene_stop", "gene_id", "tx_id", "rank", "start", "stop", "type"])
    return io.read_gff(spark, path).select("seqid", "type", "start", "stop", "strand", "phase", "attrs")


@query("fasta_tiles", """SELECT seq_name, tile, md5(substr(sequence, CAST(tile * 4096 + 1 AS BIGINT), 4096)) AS digest
FROM (SELECT *, unnest(range(0, CAST((length(sequence) + 4095) // 4096 AS BIGINT))) AS tile FROM d)""", D)
def fasta_tiles(spark, d):
    """Tiles of records, written as FASTA and read in parts."""
    path = fresh_path(spark)
    io.write_fasta(P.dna(spark, d), path)
    return parts.fasta_tiles(spark, path).select("seq_name", "tile", F.md5("sequence").alias("digest"))


@query("label_runs", """ow AS (SELECT seqid, strand, pos, max(tx_id) AS tx_id FROM la GROUP BY ALL)
SELECT seqid, strand, tx_id, min(pos) AS start, max(pos) AS stop FROM (SELECT *, pos - row_number() OVER (PARTITION BY seqid, strand, tx_id ORDER BY pos) AS k FROM ow) GROUP BY seqid, strand, tx_id, k""", f"{F_}, {LABELS},")
def label_runs(spark, d):
    """Which transcript owns which stretch, where they lie over each other."""
    return labels.label_runs(P.features(spark, d))


@query("overlap_labels", """ow AS (SELECT seqid, strand, pos, arg_max(label, tx_id) AS label FROM la GROUP BY ALL),
wi AS (SELECT *, unnest(range(greatest(0, CAST(ceil((pos - 500) / 450.0) AS BIGINT)), (pos - 1) // 450 + 1)) AS chunk FROM ow),
pl AS (SELECT *, CASE WHEN strand = '-' THEN 499 - (pos - 1 - chunk * 450) ELSE pos - 1 - chunk * 450 END AS place FROM wi)
SELECT seqid, strand, chunk, count(*) AS n, CAST(sum(place * label) AS BIGINT) AS checksum FROM pl GROUP BY ALL""", f"{F_}, {LABELS},")
def overlap_labels(spark, d):
    """Labels of tiles that overlap by 50 bases."""
    tiles = labels.label_tiles(P.features(spark, d), 500, 50)
    total = F.aggregate(F.transform("labels", lambda x, i: x.cast("long") * i), F.lit(0).cast("long"), lambda a, x: a + x)
    return tiles.select(*KEYS, "chunk", F.size(F.filter("labels", lambda x: x > 0)).cast("long").alias("n"), total.alias("checksum"))


ON_D = LABELS.replace("FROM f)", "FROM fd)", 1)
EXAMPLES = f"""tt AS (SELECT seqid, min(start) AS start, max(stop) AS stop, min(line_no) AS line_no FROM fd GROUP BY gene_id, seqid, strand, tx_id),
far AS (SELECT DISTINCT seqid, unnest(range(greatest(start - 10, 0), stop + 10)) AS pos FROM tt WHERE line_no % 7 = 0),
near AS (SELECT DISTINCT seqid, unnest(range(greatest(start - 20, 0), stop + 20)) AS pos FROM tt WHERE line_no % 7 <> 0),
core AS (SELECT DISTINCT seqid, unnest(range(start, stop)) AS pos FROM tt WHERE line_no % 7 = 0),
zero AS (SELECT * FROM core UNION (SELECT * FROM far EXCEPT SELECT * FROM near)),
tv AS (SELECT 'd' || substr(seqid, 2) AS seqid, pos - (SELECT min(pos) FROM w) AS pos, max(val) AS val FROM w GROUP BY ALL),
ow AS (SELECT seqid, strand, pos, arg_max(label, tx_id) AS label FROM la GROUP BY ALL),
ti AS (SELECT seq_name AS seqid, unnest(range(0, greatest(1, CAST(ceil(length(sequence) / 500.0) AS BIGINT)))) AS tile, sequence FROM d),
cu AS (SELECT seqid, tile, rpad(substr(sequence, CAST(tile * 500 + 1 AS BIGINT), 500), 500, 'N') AS s FROM ti),
st AS (SELECT seqid, unnest(['+', '-']) AS strand, tile, s FROM cu),
sl AS (SELECT seqid, strand, (pos - 1) // 500 AS tile, CAST(sum(label * CASE WHEN strand = '-' THEN 499 - (pos - 1) % 500 ELSE (pos - 1) % 500 END) AS BIGINT) AS v FROM ow GROUP BY ALL),
sm AS (SELECT seqid, pos // 500 AS tile, count(*) AS n, CAST(sum(pos % 500) AS BIGINT) AS v FROM zero GROUP BY ALL),
sv AS (SELECT seqid, pos // 500 AS tile, sum(val * (pos % 500)) AS plus, sum(val * (499 - pos % 500)) AS minus FROM tv GROUP BY ALL)
SELECT st.seqid, st.strand, st.tile, md5(CASE WHEN st.strand = '-' THEN {REV.format("s")} ELSE s END) AS digest, coalesce(sl.v, 0) AS labels, coalesce(n, 0) AS masked,
  coalesce(CASE WHEN st.strand = '-' THEN 499 * n - sm.v ELSE sm.v END, 0) AS masked_places, round(coalesce(CASE WHEN st.strand = '-' THEN minus ELSE plus END, 0), 3) AS track,
  CAST((row_number() OVER (ORDER BY md5(st.seqid || '|' || st.strand || '|' || st.tile), st.seqid, st.strand, st.tile) - 1) % 8 AS BIGINT) AS shard
FROM st LEFT JOIN sl ON sl.seqid = st.seqid AND sl.strand = st.strand AND sl.tile = st.tile LEFT JOIN sm ON sm.seqid = st.seqid AND sm.tile = st.tile
  LEFT JOIN sv ON sv.seqid = st.seqid AND sv.tile = st.tile"""


@query("example_shards", EXAMPLES, f"{FD}, {P.TRACK}, {ON_D},")
def example_shards(spark, d):
    """Training examples of all tiles of both strands, written in 8 shards and read again: sums of their parts by place."""
    cds, track = stored(P.on_documents(spark, d)), P.track(spark, d)
    tx = T.assembled(cds).select("seqid", "tx_id", "start", "stop", (F.col("line_no") % 7 == 0).alias("filtered"))
    masked = labels.masked(tx.where("not filtered"), tx.where("filtered"), ["seqid"], 20)
    first = track.agg(F.min("pos")).first()[0] or 0
    values = track.groupBy(F.concat(F.lit("d"), F.substring("seqid", 2, 20)).alias("seqid"), (F.col("pos") - first).alias("pos")).agg(F.max("val").alias("value"))
    rows = examples.examples(P.dna(spark, d), cds, masked, values, 500, buckets=8, shards=8, packed=True)
    path = fresh_path(spark)
    examples.write_shards(rows, path)
    back = examples.place_sums(spark.read.parquet(path))
    sums = ["labels", "masked", "masked_places", F.round("track", 3).alias("track")]
    return back.select(*examples.KEYS, F.md5("sequence").alias("digest"), *sums, F.col("shard").cast("long").alias("shard"))


@query("error_map", """ti AS (SELECT seq_name, k AS tile, string_split(substr(sequence, k * 900 + 1, 900), '') AS cs
  FROM (SELECT seq_name, sequence, unnest(range(0, (length(sequence) + 899) // 900)) AS k FROM d)),
b AS (SELECT seq_name, tile, unnest(cs) AS c FROM ti),
p AS (SELECT seq_name, tile, CASE WHEN c IN ('a', 'c', 'g', 't') THEN 1 ELSE 0 END AS label, CASE WHEN upper(c) IN ('G', 'C') THEN 1 ELSE 0 END AS predicted FROM b WHERE c <> 'N' AND c <> '')
SELECT seq_name, CAST(tile AS BIGINT) AS tile, CAST(label AS INTEGER) AS label, CAST(predicted AS INTEGER) AS predicted, count(*) AS n,
  round(count(*) * (ln(1 + exp(-3)) + CASE WHEN label = predicted THEN 0 ELSE 3 END), 4) AS loss FROM p GROUP BY seq_name, tile, label, predicted""", f"{D},")
def error_map(spark, d):
    """Tiles of all sequences, the last ones short, scored in filled-up batches and held against the soft mask as labels; N has none."""
    tiles = genome.sequence_tiles(P.dna(spark, d), 0, 900).withColumnsRenamed({"seqid": "seq_name", "tile_sequence": "sequence"})
    letters = F.regexp_extract_all("sequence", F.lit("(?s)."), F.lit(0))
    mask = F.transform(letters, lambda c: F.when(c == "N", F.lit(None)).otherwise(c.isin("a", "c", "g", "t").cast("int")))
    errors = decoding.error_map(tiles.withColumn("labels", mask), gc_scores, 2)
    return decoding.confusion(errors, ["seq_name", "tile"]).withColumn("loss", F.round("loss", 4))


@query("feature_parts", """k AS (SELECT *, CASE WHEN line_no % 3 = 0 OR gene_id LIKE '%5' THEN 'exon' ELSE 'CDS' END AS kind FROM f),
c AS (SELECT tx_id, kind, string_agg(start || '-' || stop, ',' ORDER BY start, stop) AS parts FROM k GROUP BY tx_id, kind)
SELECT tx_id, coalesce(max(parts) FILTER (WHERE kind = 'CDS'), max(parts)) AS parts FROM c GROUP BY tx_id""", f"{F_},")
def feature_parts(spark, d):
    """Coding parts of all transcripts, exons of those that have no coding ones."""
    exon = (F.col("line_no") % 3 == 0) | F.col("gene_id").endswith("5")
    rows = P.features(spark, d).withColumns({"type": F.when(exon, "exon").otherwise("CDS"), "phase": F.lit(None).cast("int")})
    text = F.array_join(F.transform("parts", lambda x: F.concat(x["start"], F.lit("-"), x["stop"])), ",")
    return T.coordinates(rows).select("tx_id", text.alias("parts"))


@query("gene_names", """x AS (SELECT DISTINCT tx_id, CASE WHEN line_no // 10 % 5 = 0 THEN NULL ELSE gene_id END AS own, CASE WHEN line_no // 10 % 7 = 0 THEN 'new_' || gene_id END AS given FROM f)
SELECT tx_id, coalesce(given, own, tx_id || '_g') AS gene_id FROM x""", f"{F_},")
def gene_names(spark, d):
    """All transcripts with new genes for some; those that have none are a gene of their own."""
    o = F.floor(F.col("line_no") / 10)
    rows = P.features(spark, d).select("tx_id", F.when(o % 5 != 0, F.col("gene_id")).alias("gene_id"), F.when(o % 7 == 0, F.concat(F.lit("new_"), "gene_id")).alias("new_gene")).distinct()
    return T.with_gene(rows.select("tx_id", "gene_id"), rows.where("new_gene is not null"))


@query("label_channels", """b AS (SELECT seq_name, unnest(string_split(upper(sequence), '')) AS c FROM d)
SELECT seq_name, [count(*) FILTER (WHERE c = 'A'), count(*) FILTER (WHERE c = 'C'), count(*) FILTER (WHERE c = 'G'), count(*) FILTER (WHERE c = 'T')]::VARCHAR AS channels FROM b WHERE c <> '' GROUP BY seq_name""", f"{D},")
def label_channels(spark, d):
    """Channels of all labels of all sequences, summed; a label that no channel stands for adds to none."""
    tiles = genome.sequence_tiles(P.dna(spark, d)).select(F.col("seqid").alias("seq_name"), F.regexp_extract_all(F.upper("tile_sequence"), F.lit("(?s)."), F.lit(0)).alias("c"))
    hot = tiles.select("seq_name", labels.one_hot(F.transform("c", lambda x: F.instr(F.lit("ACGTN"), x) - 1), 4).alias("hot"))
    of = lambda i: F.aggregate("hot", F.lit(0).cast("long"), lambda s, x: s + x[i])
    each = hot.groupBy("seq_name").agg(*(F.sum(of(i)).alias(f"c{i}") for i in range(4)))
    return each.select("seq_name", F.concat(F.lit("["), F.concat_ws(", ", *(f"c{i}" for i in range(4))), F.lit("]")).alias("channels"))


@query("log_track", """SELECT seqid, strand, pos, event_id, round(CASE WHEN x > 0 THEN greatest(-6.0, least(0.0, ln(x))) ELSE -6.0 END, 6) AS log
FROM (SELECT *, (val - 20) / 100 AS x FROM w)""", P.TRACK)
def log_track(spark, d):
    """Logarithms of all values of a track, within bounds; those of values that have none are the lower bound."""
    x = (F.col("val") - 20) / 100
    return P.track(spark, d).select("seqid", "strand", "pos", "event_id", F.round(genome.clipped_log(x, -6.0), 6).alias("log"))


@query("mapped_reports", """WITH n AS (SELECT l_suppkey AS run, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'R') AS m FROM lineitem GROUP BY l_suppkey)
SELECT 'run' || run AS run, CAST(10000 * m // n AS DOUBLE) / 100 AS percent FROM n""")
def mapped_reports(spark, d):
    """Mapped percentages read from reports of runs: each has a line of all alignments, one of mapped ones, and one of pairs."""
    rows = P.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("l_returnflag") != "R", 1)).alias("m"))
    share = F.floor(F.lit(10000) * F.col("m") / F.col("n"))
    percent = F.concat(F.floor(share / 100), F.lit("."), F.lpad((share % 100).cast("string"), 2, "0"))
    texts = F.array(
        F.concat("n", F.lit(" + 0 in total (QC-passed reads + QC-failed reads)")), F.concat("m", F.lit(" + 0 mapped ("), percent, F.lit("% : N/A)")),
        F.concat("m", F.lit(" + 0 properly paired (12.50% : N/A)")),
    )
    path = fresh_path(spark)
    said = rows.select("l_suppkey", F.explode(texts).alias("line"))
    said.select(F.concat(F.lit("run"), "l_suppkey", F.lit("\t"), "line").alias("value")).write.text(path)
    lines = spark.read.text(path).select(F.substring_index("value", "\t", 1).alias("run"), evidence.mapped_percent(F.substring_index("value", "\t", -1)).alias("percent"))
    return lines.where("percent is not null")


@query("newest_epoch", """SELECT o_custkey AS run, max(o_orderkey) AS n, 'epoch_' || max(o_orderkey) AS name FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey""")
def newest_epoch(spark, d):
    """The folder of the highest epoch of each run, by number and not by spelling; other folders are passed over."""
    names = P.table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.concat(F.when(F.col("o_orderstatus") == "F", "best_").otherwise("epoch_"), "o_orderkey").alias("name"))
    return cards.numbered(names, "name").groupBy("run").agg(F.max("n").alias("n"), F.max_by("name", "n").alias("name"))
