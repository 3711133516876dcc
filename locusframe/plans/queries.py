"""Queries over the general tables: each applies one operator to a projection of whole tables; with SQL for the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions import genome, tracks
from locusframe.functions import sequence as S
from locusframe.functions.attributes import format_gff, parse
from locusframe.operators import decoding, evaluation, evidence, intervals, labels, merging, models
from locusframe.operators import transcripts as T
from locusframe.plans import proxies as P
from locusframe.session import fresh_path, stored
from locusframe.sources import cards as cards_io
from locusframe.sources import text as io
from locusframe.sources.text import wig_runs
from locusframe.streaming.files import arriving

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = ["seqid", "strand"]
INF = 2**31 - 1

TX_SQL = """t AS (SELECT gene_id, seqid, strand, tx_id, min(start) AS start, max(stop) AS stop, count(*) AS n,
  CAST(sum(stop - start + 1) AS BIGINT) AS bp, min(line_no) AS line_no, min(file_idx) AS file_idx, max(p) AS utr_bp,
  string_agg(start || '-' || stop, ',' ORDER BY start, stop) AS parts FROM f GROUP BY gene_id, seqid, strand, tx_id)"""


def _locus(source: str, gap: int = 0, order: str = "start, stop, line_no") -> str:
    """Rows of ``source`` with the number of their group of overlapping rows."""
    return f"""SELECT *, CAST(sum(new) OVER (PARTITION BY seqid, strand ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM (
    SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY seqid, strand ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap}
      THEN 0 ELSE 1 END AS new FROM {source})"""


def _merged(source: str) -> str:
    return f"SELECT seqid, strand, min(start) AS start, max(stop) AS stop FROM ({_locus(f'(SELECT DISTINCT seqid, strand, start, stop FROM {source})', 1, 'start, stop')}) GROUP BY seqid, strand, cluster"


def query(name: str, sql: str | None, base: str = "") -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = f"WITH {base} {sql}" if base else sql
        return fn

    return add


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """The proxy's transcripts, with a source file and a number that stands for UTR bases."""
    return T.assembled(P.features(spark, d), F.min("file_idx").alias("file_idx"), F.max("p").alias("utr_bp"))


GAPS = """gaps AS (SELECT * FROM (SELECT seqid, strand, tx_id, gene_id, stop + 1 AS start,
  lead(start) OVER (PARTITION BY seqid, strand, tx_id ORDER BY start, stop) - 1 AS stop FROM f) WHERE stop >= start)"""

# ---- spans, lengths, sets of transcripts

F_ = P.FEATURES
FT = f"{P.FEATURES}, {TX_SQL}"


@query("feature_filter", "SELECT tx_id, start, stop, type FROM f WHERE type IN ('CDS', 'intron') AND seqid IN ('chr0', 'chr2')", F_)
def feature_filter(spark, d):
    return T.of_kinds(P.features(spark, d), ("CDS", "intron"), ("chr0", "chr2")).select("tx_id", "start", "stop", "type")


@query("tx_assemble", "SELECT seqid, strand, gene_id, tx_id, start, stop, n, bp, parts AS structure FROM t", FT)
def tx_assemble(spark, d):
    return T.assembled(P.features(spark, d)).select(*T.TX, "gene_id", "start", "stop", "n", "bp", T.structure().alias("structure"))


@query("tx_ranges", "SELECT seqid, tx_id, start, stop FROM t", FT)
def tx_ranges(spark, d):
    return P.features(spark, d).groupBy("seqid", "tx_id").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


@query("cds_len", "SELECT tx_id, bp FROM t", FT)
def cds_len(spark, d):
    return P.features(spark, d).groupBy("tx_id").agg(F.sum(T.length()).alias("bp"))


@query("gene_span", "SELECT seqid, gene_id, min(start) AS start, max(stop) AS stop, count(*) AS n_tx FROM t GROUP BY seqid, gene_id", FT)
def gene_span(spark, d):
    return T.assembled(P.features(spark, d)).groupBy("seqid", "gene_id").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n_tx"))


@query("tx_with_cds", "SELECT tx_id FROM f GROUP BY tx_id HAVING count(*) FILTER (s % 5 = 0) > 0", F_)
def tx_with_cds(spark, d):
    """Transcripts that have a coding part or an exon (here: of some suppliers; the others are introns)."""
    kind = F.when(F.col("s") % 5 == 0, F.when(F.col("p") % 2 == 0, "CDS").otherwise("exon")).otherwise("intron")
    return T.having(P.features(spark, d).withColumn("type", kind)).select("tx_id")


@query("source_labels", "SELECT gene_id, string_agg(DISTINCT CAST(s % 7 AS VARCHAR), ',' ORDER BY CAST(s % 7 AS VARCHAR)) AS sources FROM f GROUP BY gene_id", F_)
def source_labels(spark, d):
    return P.features(spark, d).groupBy("gene_id").agg(F.array_join(F.sort_array(F.collect_set((F.col("s") % 7).cast("string"))), ",").alias("sources"))


@query("anno_stats", """SELECT seqid, count(*) AS n_exons, CAST(sum(stop - start + 1) AS BIGINT) AS bp, count(DISTINCT tx_id) AS n_tx, count(DISTINCT gene_id) AS n_genes,
  (SELECT count(*) FROM gaps WHERE gaps.seqid = f.seqid) AS n_introns FROM f GROUP BY seqid""", f"{F_}, {GAPS}")
def anno_stats(spark, d):
    return T.statistics(P.features(spark, d))


@query("lc_anti", "SELECT tx_id, bp FROM t WHERE tx_id NOT IN (SELECT tx_id FROM f WHERE p % 11 = 0)", FT)
def lc_anti(spark, d):
    f = P.features(spark, d)
    return T.assembled(f).join(f.where("p % 11 = 0").select("tx_id").distinct(), "tx_id", "left_anti").select("tx_id", "bp")


@query("bed_from_gff", "SELECT coalesce(c.seqid, 'unknown') AS seqid, f.start, f.stop, f.tx_id FROM f LEFT JOIN (SELECT DISTINCT gene_id, seqid FROM f WHERE s % 3 = 0) c USING (gene_id)", F_)
def bed_from_gff(spark, d):
    f = P.features(spark, d)
    return f.drop("seqid").join(f.where("s % 3 = 0").select("gene_id", "seqid").distinct(), "gene_id", "left").select(F.coalesce("seqid", F.lit("unknown")).alias("seqid"), "start", "stop", "tx_id")


# ---- intervals


@query("locus_cluster", f"SELECT seqid, strand, cluster AS locus, min(start) AS start, max(stop) AS stop, count(*) AS n_tx FROM ({_locus('t')}) GROUP BY ALL", FT)
def locus_cluster(spark, d):
    return merging.with_locus(T.assembled(P.features(spark, d))).groupBy(*KEYS, "locus").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n_tx"))


@query("interval_merge", _merged("f"), F_)
def interval_merge(spark, d):
    return intervals.merged(P.features(spark, d), KEYS)


@query("covered_bp", f"SELECT seqid, strand, CAST(sum(stop - start + 1) AS BIGINT) AS bp FROM ({_merged('f')}) GROUP BY ALL", F_)
def covered_bp(spark, d):
    return intervals.merged(P.features(spark, d), KEYS).groupBy(*KEYS).agg(F.sum(T.length()).alias("bp"))


COVER = f"""g AS ({_merged("(SELECT * FROM f WHERE s % 4 = 0)")})
SELECT line_no, CAST(coalesce(sum(least(f.stop, g.stop) - greatest(f.start, g.start) + 1) FILTER (g.start IS NOT NULL), 0) AS BIGINT) AS covered,
  round(coalesce(sum(least(f.stop, g.stop) - greatest(f.start, g.start) + 1) FILTER (g.start IS NOT NULL), 0) / max(f.stop - f.start + 1), 6) AS fraction
FROM (SELECT * FROM f WHERE s % 4 <> 0) f LEFT JOIN g ON f.seqid = g.seqid AND f.strand = g.strand AND f.start <= g.stop AND g.start <= f.stop GROUP BY line_no"""


@query("interval_coverage", COVER, f"{F_},")
def interval_coverage(spark, d):
    f = P.features(spark, d)
    return intervals.coverage(f.where("s % 4 <> 0"), f.where("s % 4 = 0"), KEYS, "line_no").select("line_no", "covered", F.round("fraction", 6).alias("fraction"))


@query("overlap_pairs", """SELECT a.line_no AS a, b.line_no AS b FROM (SELECT * FROM f WHERE s % 4 = 0) a JOIN (SELECT * FROM f WHERE s % 4 = 1) b
  ON a.seqid = b.seqid AND a.strand = b.strand AND a.start <= b.stop AND b.start <= a.stop""", F_)  # fmt: skip
def overlap_pairs(spark, d):
    f = stored(P.features(spark, d).where("s % 4 in (0, 1)").select(*KEYS, "start", "stop", "line_no", "s"))
    b = f.where("s % 4 = 1").select(*KEYS, "start", "stop", F.col("line_no").alias("b"))
    a = f.where("s % 4 = 0").select(*KEYS, "start", "stop", F.col("line_no").alias("a"))
    return intervals.overlaps(a, b, KEYS, intervals.fitting_width(a, b)).select("a", "b")


@query("no_conflict", """SELECT tx_id, bool_and(NOT EXISTS (SELECT 1 FROM f g WHERE g.s % 6 = 0 AND g.seqid = f.seqid AND g.strand = f.strand
  AND g.start <= f.stop AND f.start <= g.stop)) AS free FROM f WHERE s % 6 <> 0 GROUP BY tx_id""", F_)  # fmt: skip
def no_conflict(spark, d):
    f = P.features(spark, d)
    cover = intervals.coverage(f.where("s % 6 <> 0"), f.where("s % 6 = 0"), KEYS, "line_no")
    return cover.groupBy("tx_id").agg(F.bool_and(F.col("fraction") == 0).alias("free"))


@query("tx_chunks", "SELECT tx_id, c AS tile, greatest(start, c * 500 + 1) AS start, least(stop, (c + 1) * 500) AS stop FROM (SELECT *, unnest(generate_series((start - 1) // 500, (stop - 1) // 500)) AS c FROM t)", FT)
def tx_chunks(spark, d):
    return intervals.on_tiles(T.assembled(P.features(spark, d)), 500).select("tx_id", "tile", "start", "stop")


@query("window_overlap", """SELECT tx_id, unnest(generate_series(greatest(0, CAST(ceil((start - 500) / 400.0) AS BIGINT)), (stop - 1) // 400)) AS "window" FROM t""", FT)
def window_overlap(spark, d):
    return intervals.on_windows(T.assembled(P.features(spark, d)), 500, 400).select("tx_id", "window")


@query("chunk_index", "SELECT line_no, CAST(substr(seqid, 4) AS BIGINT) * 2000 + start // 500 AS chunk FROM f", F_)
def chunk_index(spark, d):
    offsets = {f"chr{i}": 2000 * i for i in range(4)}
    return P.features(spark, d).select("line_no", genome.chunk_index(F.col("seqid"), F.col("start"), offsets, 500).alias("chunk"))


@query("norm_coords", "SELECT line_no, least(start, p * 40) AS start, greatest(start, p * 40) AS stop FROM f", F_)
def norm_coords(spark, d):
    return evidence.in_order(P.features(spark, d).select("line_no", "start", (F.col("p") * 40).alias("stop")))


# ---- inside transcripts

READ = "CASE WHEN strand = '-' THEN -stop ELSE start END, line_no"
PHASE = f"""ph AS (SELECT *, CAST((3 - coalesce(sum(stop - start + 1) OVER (PARTITION BY seqid, strand, tx_id ORDER BY {READ}
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 3) % 3 AS BIGINT) AS phase FROM f)"""

@query("introns", "SELECT tx_id, start, stop FROM gaps", f"{F_}, {GAPS}")
def introns(spark, d):
    return T.introns(P.features(spark, d)).select("tx_id", "start", "stop")


@query("redo_phase", "SELECT line_no, phase FROM ph", f"{F_}, {PHASE}")
def redo_phase(spark, d):
    return T.with_phase(P.features(spark, d)).select("line_no", F.col("phase").cast("long").alias("phase"))


INTRON_PHASE = f"""SELECT * FROM (SELECT tx_id, least(stop, lead(stop) OVER o) + 1 AS start, greatest(start, lead(start) OVER o) - 1 AS stop,
  lead(phase) OVER o AS phase, lead(start) OVER o AS s2 FROM ph WINDOW o AS (PARTITION BY seqid, strand, tx_id ORDER BY {READ})) WHERE s2 IS NOT NULL AND stop >= start"""


@query("intron_phase", f"SELECT tx_id, start, stop, phase FROM ({INTRON_PHASE})", f"{F_}, {PHASE}")
def intron_phase(spark, d):
    return T.intron_phases(P.features(spark, d)).select("tx_id", "start", "stop", F.col("phase").cast("long").alias("phase"))


@query("cds_type", f"""SELECT line_no, CASE WHEN c = 1 THEN 'single' WHEN r = 1 THEN 'initial' WHEN r = c THEN 'terminal' ELSE 'internal' END AS kind
  FROM (SELECT line_no, row_number() OVER (PARTITION BY seqid, strand, tx_id ORDER BY {READ}) AS r, count(*) OVER (PARTITION BY seqid, strand, tx_id) AS c FROM f)""", F_)  # fmt: skip
def cds_type(spark, d):
    return T.with_kind(P.features(spark, d)).select("line_no", "kind")


GLUED = """SELECT tx_id, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(new) OVER (PARTITION BY seqid, strand, tx_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, CASE WHEN lag(stop) OVER (PARTITION BY seqid, strand, tx_id ORDER BY start, stop) = start - 1 THEN 0 ELSE 1 END AS new FROM f)) GROUP BY tx_id, run"""


@query("check_splits", GLUED, F_)
def check_splits(spark, d):
    return T.glued(P.features(spark, d)).select("tx_id", "start", "stop")


@query("longest_isoform", "SELECT gene_id, tx_id, bp FROM t QUALIFY row_number() OVER (PARTITION BY gene_id ORDER BY bp DESC, line_no) = 1", FT)
def longest_isoform(spark, d):
    return T.longest_isoform(P.features(spark, d)).select("gene_id", "tx_id", "bp")


@query("one_isoform", "SELECT gene_id, tx_id FROM t QUALIFY row_number() OVER (PARTITION BY gene_id ORDER BY stop - start DESC, line_no) = 1", FT)
def one_isoform(spark, d):
    return T.widest_isoform(P.features(spark, d)).select("gene_id", "tx_id")


@query("norm_tx", """SELECT tx_id, type, start, stop, phase FROM ph UNION ALL SELECT tx_id, 'intron', start, stop, NULL FROM gaps
  UNION ALL SELECT tx_id, 'transcript', start, stop, NULL FROM t""", f"{FT}, {PHASE}, {GAPS}")  # fmt: skip
def norm_tx(spark, d):
    return T.normalised(P.features(spark, d)).select("tx_id", "type", "start", "stop", F.col("phase").cast("long").alias("phase"))


@query("extend_stop", f"""SELECT line_no, CASE WHEN strand = '-' AND lo = 1 THEN least(start, coalesce(low, start)) ELSE start END AS start,
  CASE WHEN strand = '+' AND hi = 1 THEN greatest(stop, coalesce(high, stop)) ELSE stop END AS stop FROM (
  SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY stop DESC, line_no) AS hi, row_number() OVER (PARTITION BY tx_id ORDER BY start, line_no) AS lo FROM f
  WHERE s % 3 <> 0) LEFT JOIN (SELECT tx_id, max(stop) AS high, min(start) AS low FROM f WHERE s % 3 = 0 GROUP BY tx_id) USING (tx_id)""", F_)  # fmt: skip
def extend_stop(spark, d):
    f = P.features(spark, d)
    return T.with_stop_codon(f.where("s % 3 <> 0"), f.where("s % 3 = 0")).select("line_no", "start", "stop")


@query("rebuild_hierarchy", "SELECT tx_id, CASE WHEN gene_id IN (SELECT gene_id FROM f WHERE s % 9 = 0) THEN gene_id ELSE tx_id || '.gene' END AS gene_id, start, stop FROM t", FT)
def rebuild_hierarchy(spark, d):
    f = P.features(spark, d)
    return T.hierarchy(f, f.where("s % 9 = 0").select("gene_id")).select("tx_id", "gene_id", "start", "stop")


RENAME = """g AS (SELECT seqid, gene_id, 'x_' || seqid || '_g' || row_number() OVER (PARTITION BY seqid ORDER BY min(start), max(stop), gene_id) AS new_gene FROM f GROUP BY seqid, gene_id)
SELECT tx_id, new_gene, new_gene || '.t' || row_number() OVER (PARTITION BY seqid, gene_id ORDER BY line_no) AS new_tx FROM t JOIN g USING (seqid, gene_id)"""


@query("rename_ids", RENAME, f"{FT},")
def rename_ids(spark, d):
    return T.renamed_by_place(P.features(spark, d), "x").select("tx_id", "new_gene", "new_tx")


@query("intron_hints", """SELECT tx_id, start, stop FROM (SELECT tx_id, least(stop, lag(stop) OVER o) + 1 AS start, greatest(start, lag(start) OVER o) - 1 AS stop, lag(start) OVER o AS s0
  FROM f WINDOW o AS (PARTITION BY seqid, tx_id ORDER BY line_no)) WHERE s0 IS NOT NULL AND start <= stop""", F_)  # fmt: skip
def intron_hints(spark, d):
    return evidence.intron_hints(P.features(spark, d)).select("tx_id", "start", "stop")


@query("cdspart_hint", """SELECT line_no, CASE WHEN start + 15 > stop - 15 THEN (start + stop) // 2 ELSE start + 15 END AS start,
  CASE WHEN start + 15 > stop - 15 THEN (start + stop) // 2 ELSE stop - 15 END AS stop FROM f""", F_)  # fmt: skip
def cdspart_hint(spark, d):
    return evidence.cds_part_hints(P.features(spark, d)).select("line_no", "start", "stop")


# ---- merging and agreement

STRUCT = """SELECT * FROM lt QUALIFY row_number() OVER (PARTITION BY seqid, strand, locus, parts ORDER BY utr_bp DESC, line_no) = 1"""
MERGE = """n AS (SELECT seqid, strand, locus, row_number() OVER (ORDER BY seqid, min(start), strand) AS k FROM u GROUP BY seqid, strand, locus)
SELECT tx_id, 'gene_' || lpad(CAST(k AS VARCHAR), 6, '0') AS gene,
  'gene_' || lpad(CAST(k AS VARCHAR), 6, '0') || '.t' || row_number() OVER (PARTITION BY seqid, strand, locus ORDER BY start, tx_id) AS tx, start, stop
FROM u JOIN n USING (seqid, strand, locus)"""
LT = f"lt AS (SELECT * EXCLUDE (cluster, new), cluster AS locus FROM ({_locus('t')}))"


@query("struct_dedupe", f"SELECT tx_id FROM ({STRUCT})", f"{FT}, {LT}")
def struct_dedupe(spark, d):
    return merging.distinct_structures(merging.with_locus(transcripts(spark, d)), [*KEYS, "locus"]).select("tx_id")


@query("merge_full", MERGE, f"{FT}, {LT}, u AS ({STRUCT}),")
def merge_full(spark, d):
    return merging.merge_all(transcripts(spark, d)).select("tx_id", "gene", "tx", "start", "stop")


def _part(name: str, where: str, number: int) -> str:
    return f"""{name}t AS (SELECT * FROM t WHERE {where}), {name}l AS (SELECT * EXCLUDE (cluster, new), {number} * 1000000000 + cluster AS locus FROM ({_locus(name + "t")})),
  {name}u AS ({STRUCT.replace("FROM lt", f"FROM {name}l")})"""


PRIORITY = f"""{_part("first_", "file_idx = 0", 0)}, ag AS (SELECT seqid, strand, locus, min(start) AS start, max(stop) AS stop FROM first_l GROUP BY ALL),
{_part("second_", "file_idx = 1 AND NOT EXISTS (SELECT 1 FROM ag WHERE ag.seqid = t.seqid AND ag.strand = t.strand AND ag.start <= t.stop AND t.start <= ag.stop)", 1)},
u AS (SELECT * FROM first_u UNION ALL SELECT * FROM second_u), {MERGE}"""


@query("priority_merge", PRIORITY, f"{FT},")
def priority_merge(spark, d):
    t = stored(transcripts(spark, d))
    return merging.merge_by_priority(t.where("file_idx = 0"), t.where("file_idx = 1")).select("tx_id", "gene", "tx", "start", "stop")


def _scores(a: str, b: str) -> str:
    return f"""x AS (SELECT (SELECT count(*) FROM (({a}) INTERSECT ({b}))) AS tp, (SELECT count(*) FROM (({a}) EXCEPT ({b}))) AS fp, (SELECT count(*) FROM (({b}) EXCEPT ({a}))) AS fn)
SELECT tp, fp, fn, round(tp / (tp + fp), 9) AS "precision", round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM x"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


SIDE = "SELECT seqid, strand, start, stop FROM f WHERE s % 5 <> "


@query("cds_f1", _scores(SIDE + "0", SIDE + "1"), f"{F_},")
def cds_f1(spark, d):
    f = P.features(spark, d)
    side = lambda n: f.where(F.col("s") % 5 != n).select(*KEYS, "start", "stop")
    return _rounded(evaluation.set_scores(side(0), side(1)))


CHAIN = "SELECT seqid, strand, string_agg(start || '-' || stop, ',' ORDER BY start, stop) AS structure FROM f WHERE p % 9 <> {} GROUP BY seqid, strand, tx_id"


@query("tx_f1", _scores(CHAIN.format(0), CHAIN.format(1)), f"{F_},")
def tx_f1(spark, d):
    f = P.features(spark, d)
    side = lambda n: T.assembled(f.where(F.col("p") % 9 != n)).select(*KEYS, T.structure().alias("structure"))
    return _rounded(evaluation.set_scores(side(0), side(1)))


# ---- hits

H = P.HITS
SCORED = "SELECT *, bits * (alen / qlen) AS score, split_part(subject, '_', 1) AS species FROM h"
BEST = " QUALIFY row_number() OVER (PARTITION BY query ORDER BY bits * (alen / qlen) DESC, subject, qstart, alen) = 1"
GOOD = " WHERE evalue <= 0.05 AND pident >= 93 AND alen / qlen >= 0.5"


@query("best_hit", f"SELECT query, subject, round(score, 4) AS score FROM ({SCORED}{BEST})", H)
def best_hit(spark, d):
    return evidence.best_hits(P.hits(spark, d)).select("query", "subject", F.round("score", 4).alias("score"))


@query("rank_species", f"""r AS (SELECT species, count(*) AS votes, sum(score) AS total FROM ({SCORED}{GOOD}{BEST}) GROUP BY species)
SELECT species, votes, round(total, 2) AS total, row_number() OVER (ORDER BY votes DESC, round(total, 3) DESC, species) AS place,
  CASE WHEN row_number() OVER (ORDER BY votes DESC, round(total, 3) DESC, species) <= 10 THEN 'TOP' ELSE '' END AS mark FROM r""", f"{H},")  # fmt: skip
def rank_species(spark, d):
    return evidence.ranked_species(P.hits(spark, d), 0.05, 93.0, 0.5, 10).withColumn("total", F.round("total", 2))


@query("hc_protein", f"""SELECT query, subject, bits FROM h{GOOD} AND alen / slen >= 0.6
  QUALIFY row_number() OVER (PARTITION BY query ORDER BY bits DESC, subject, qstart, alen) = 1""", H)  # fmt: skip
def hc_protein(spark, d):
    return evidence.supported_queries(P.hits(spark, d), 0.05, 93.0, 0.5, 0.6).select("query", "subject", "bits")


@query("hit_join", "SELECT a.query, a.subject, a.bits, b.bits AS bits_s FROM (SELECT * FROM h WHERE qstart <= 9) a JOIN (SELECT * FROM h WHERE qstart > 9) b USING (query, subject)", H)
def hit_join(spark, d):
    h = P.hits(spark, d)
    return h.where("qstart <= 9").join(h.where("qstart > 9").select("query", "subject", F.col("bits").alias("bits_s")), ["query", "subject"]).select("query", "subject", "bits", "bits_s")


CLASS = """b AS (SELECT a.query, a.subject, greatest(a.bits, c.bits) AS best, CASE WHEN a.pident > 0 THEN
    (c.tstart - a.tstart) - (a.qstart - 1) + pow(abs(ln(a.pident / CASE WHEN c.pident = 0 THEN 1e-4 ELSE c.pident END)), 1000) ELSE CAST('inf' AS DOUBLE) END AS support
  FROM h a JOIN h c ON a.query = c.query AND a.subject = c.subject)
SELECT query, CASE WHEN bool_or(support > 0) THEN 'incomplete' ELSE 'complete' END AS class FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY best DESC, subject, support DESC) AS n FROM b) WHERE n <= 25 GROUP BY query"""


@query("cds_class", CLASS, f"{H},")
def cds_class(spark, d):
    h = P.hits(spark, d)
    return evidence.cds_classes(h, h)


@query("species_semi", f"SELECT DISTINCT subject FROM h WHERE split_part(subject, '_', 1) IN (SELECT species FROM ({SCORED}{GOOD}{BEST}) GROUP BY species HAVING count(*) > 60)", H)
def species_semi(spark, d):
    h = P.hits(spark, d)
    wanted = evidence.best_hits(evidence.good_hits(h, 0.05, 93.0, 0.5)).groupBy("species").count().where(F.col("count") > 60)
    return h.select("subject").distinct().join(wanted, evidence.species_of(F.col("subject")) == wanted["species"], "left_semi")


# ---- sequences

D = P.DNA
FD = f"{F_}, {D}, {P.ON_DOCUMENTS}"
REV = "reverse(translate({}, 'ACGTNacgtn', 'TGCANtgcan'))"


@query("seq_lengths", "SELECT seq_name, CAST(length(sequence) AS BIGINT) AS n FROM d", D)
def seq_lengths(spark, d):
    return P.dna(spark, d).select("seq_name", F.length("sequence").cast("long").alias("n"))


@query("seq_min_len", "SELECT seq_name FROM d WHERE length(sequence) >= 500", D)
def seq_min_len(spark, d):
    return P.dna(spark, d).where(F.length("sequence") >= 500).select("seq_name")


@query("revcomp", f"SELECT seq_name, md5({REV.format('sequence')}) AS digest FROM d", D)
def revcomp(spark, d):
    return P.dna(spark, d).select("seq_name", F.md5(S.revcomp(F.col("sequence"))).alias("digest"))


BASES = """SELECT CASE WHEN upper(c) IN ('A', 'C', 'G', 'T') THEN upper(c) ELSE 'N' END AS base, c IN ('a', 'c', 'g', 't') AS softmask, count(*) AS n
FROM (SELECT unnest(string_split(sequence, '')) AS c FROM d WHERE sequence <> '') GROUP BY ALL"""


@query("base_onehot", BASES, D)
def base_onehot(spark, d):
    """Counts by base and soft mask of all bases in long form."""
    return P.dna(spark, d).select(F.inline(S.base_rows(F.col("sequence")))).groupBy("base", "softmask").agg(F.count("*").alias("n"))


@query("base_freq", f"SELECT base, CAST(sum(n) AS BIGINT) AS n, round(100.0 * sum(n) / (SELECT sum(n) FROM ({BASES})), 6) AS percent FROM ({BASES}) GROUP BY base", D)
def base_freq(spark, d):
    upper = F.upper("sequence")
    sums = P.dna(spark, d).agg(F.sum(F.length(upper)).alias("all"), *(F.sum(F.length(upper) - F.length(F.replace(upper, F.lit(b), F.lit("")))).alias(b) for b in "ACGTN"))
    rows = sums.select("all", F.inline(F.array(*(F.struct(F.lit(b).alias("base"), F.col(b).alias("n")) for b in "ACGTN"))))
    return rows.where("n > 0").select("base", "n", F.round(100.0 * F.col("n") / F.col("all"), 6).alias("percent"))


CODED = """c AS (SELECT seq_name, length(sequence) AS n, list_transform(generate_series(1, length(sequence) // 3), lambda i: upper(substr(sequence, i * 3 - 2, 3))) AS c FROM d)"""
#: The coding sequences of all transcripts, cut out of the documents.
SPLICED = f"""sp0 AS (SELECT seqid, strand, tx_id, string_agg(substr(sequence, start, stop - start + 1), '' ORDER BY start, stop) AS seq FROM fd JOIN d ON seqid = seq_name GROUP BY ALL),
sp AS (SELECT seqid, strand, tx_id, CASE WHEN strand = '-' THEN {REV.format("seq")} ELSE seq END AS sequence FROM sp0)"""
REPORT = """sc0 AS (SELECT *, length(sequence) AS n, length(sequence) % 3 = 0 AND length(sequence) >= 3 AS in_frame, upper(sequence) AS u FROM sp),
sc1 AS (SELECT *, CASE WHEN in_frame THEN list_filter(generate_series(1, n - 3, 3), lambda i: substr(u, i, 3) IN ('TAA', 'TAG', 'TGA')) ELSE [] END AS at_ FROM sc0),
sc AS (SELECT tx_id, CAST(n AS BIGINT) AS n, in_frame, CASE WHEN n >= 3 THEN right(u, 3) ELSE 'NA' END AS last, in_frame AND right(u, 3) IN ('TAA', 'TAG', 'TGA') AS valid_stop,
  CAST(len(at_) AS BIGINT) AS internal, CAST(coalesce(at_[1], 0) AS BIGINT) AS first_internal, CASE WHEN len(at_) > 0 THEN substr(u, at_[1], 3) ELSE 'NA' END AS first_codon FROM sc1)"""


@query("splice_cds", "SELECT tx_id, md5(sequence) AS digest FROM sp", f"{FD}, {SPLICED}")
def splice_cds(spark, d):
    """Coding sequences cut out of the genome."""
    return genome.spliced(P.on_documents(spark, d), P.dna(spark, d)).select("tx_id", F.md5("sequence").alias("digest"))


@query("stop_check", "SELECT * FROM sc", f"{FD}, {SPLICED}, {REPORT}")
def stop_check(spark, d):
    return genome.stop_report(P.on_documents(spark, d), P.dna(spark, d)).drop(*KEYS)


@query("passing_lines", "SELECT line_no, tx_id FROM fd WHERE tx_id IN (SELECT tx_id FROM sc WHERE in_frame AND valid_stop AND internal = 0)", f"{FD}, {SPLICED}, {REPORT}")
def passing_lines(spark, d):
    """Lines of transcripts in frame, with a stop codon at the end and none before."""
    f = stored(P.on_documents(spark, d))
    return f.join(genome.passing(genome.stop_report(f, P.dna(spark, d))).select("tx_id"), "tx_id", "left_semi").select("line_no", "tx_id")


@query("stop_table", """SELECT tx_id, CAST(n AS VARCHAR) AS n, CASE WHEN in_frame THEN 'True' ELSE 'False' END AS in_frame, first_codon FROM sc""", f"{FD}, {SPLICED}, {REPORT}")
def stop_table(spark, d):
    """The report as a table with a header, read again as text."""
    path = fresh_path(spark)
    io.write_table(genome.stop_report(P.on_documents(spark, d), P.dna(spark, d)), path)
    return spark.read.csv(path, sep="\t", header=True).select("tx_id", "n", "in_frame", "first_codon")


@query("postprocess", "SELECT tx_id FROM sc WHERE n >= 200 AND internal = 0", f"{FD}, {SPLICED}, {REPORT}")
def postprocess(spark, d):
    """Transcripts of long enough coding sequences without an inner stop codon."""
    return genome.stop_report(P.on_documents(spark, d), P.dna(spark, d)).where("n >= 200 and internal = 0").select("tx_id")


CODON_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in S.CODONS.items()) + "}"


@query("translate_cds", f"SELECT seq_name, md5(coalesce(array_to_string(list_transform(c, lambda x: coalesce(({CODON_MAP})[x], 'X')), ''), '')) AS digest FROM c", f"{D}, {CODED}")
def translate_cds(spark, d):
    return P.dna(spark, d).select("seq_name", F.md5(S.translate_cds(F.col("sequence"))).alias("digest"))


AMINO = f"list_transform(generate_series(1, length(sequence) // 3), lambda i: coalesce(({CODON_MAP})[upper(substr(sequence, i * 3 - 2, 3))], 'X'))"


@query("protein_from_gff", f"SELECT tx_id, coalesce(array_to_string({AMINO}, ''), '') AS sequence FROM sp", f"{FD}, {SPLICED}")
def protein_from_gff(spark, d):
    """Proteins of all transcripts, written as FASTA and read again."""
    path = fresh_path(spark)
    io.write_fasta(genome.proteins(P.on_documents(spark, d), P.dna(spark, d)).select("tx_id", "sequence"), path, "tx_id")
    return io.read_fasta(spark, path).select(F.col("seq_name").alias("tx_id"), "sequence")


@query("utr_stop", "SELECT seq_name, regexp_matches(upper(sequence), 'TAA|TAG|TGA') AS stop FROM d WHERE 'd' || (seq_ord % 7 * 3) <> seq_name", D)
def utr_stop(spark, d):
    """Whether a stop codon stands anywhere in the UTRs (here: whole sequences) of transcripts that have a sequence."""
    dna = P.dna(spark, d)
    wanted = dna.where(F.concat(F.lit("d"), F.col("seq_ord") % 7 * 3) != F.col("seq_name")).select("seq_name")
    return evidence.stops_in_utrs(wanted, dna, "seq_name").select("seq_name", F.col("flag").alias("stop"))


SITES = "('gtag', 'gcag', 'atac')"


@query("intron_strand", f"""i0 AS (SELECT seq_name, sequence, unnest(range(0, CAST(length(sequence) // 600 + 1 AS BIGINT))) * 600 + 5 + seq_ord * 37 % 500 AS start FROM d),
i AS (SELECT seq_name, start, start + 15 AS stop, sequence FROM i0 WHERE start + 15 <= length(sequence)),
x AS (SELECT seq_name, start, stop, lower(substr(sequence, start, 2) || substr(sequence, stop - 1, 2)) AS a,
  lower({REV.format('substr(sequence, stop - 1, 2)')} || {REV.format('substr(sequence, start, 2)')}) AS b FROM i)
SELECT seq_name, start, stop, '+' AS strand FROM x WHERE a IN {SITES} UNION ALL SELECT seq_name, start, stop, '-' FROM x WHERE b IN {SITES}""", f"{D},")  # fmt: skip
def intron_strand(spark, d):
    """Strands of made-up introns, one in each 600 bases of all sequences."""
    dna = P.dna(spark, d)
    n = F.length("sequence").cast("long")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(n / 600))).alias("k")
    made = dna.select(F.col("seq_name").alias("seqid"), "seq_ord", n.alias("n"), at).withColumn("start", F.col("k") * 600 + 5 + F.col("seq_ord") * 37 % 500)
    made = made.where("start + 15 <= n").select("seqid", "start", (F.col("start") + 15).alias("stop"), F.lit(".").alias("strand"))
    return evidence.stranded_introns(made, dna.select("seq_name", "sequence")).withColumnRenamed("seqid", "seq_name")


def _codon_sql(place: str, low: str, codons: str) -> str:
    three = f"upper(CASE WHEN strand = '-' THEN {REV.format('substr(sequence, place, 3)')} ELSE substr(sequence, place, 3) END)"
    return f"""x AS (SELECT fd.*, {place} AS place FROM fd)
SELECT tx_id, {low} AS start, {low} + 2 AS stop, {three} AS codon FROM x JOIN d ON seqid = seq_name WHERE place > 0 AND {three} IN ({codons})"""


@query("start_hint", _codon_sql("CASE WHEN strand = '-' THEN stop - 2 ELSE start END", "place", "'ATG', 'TTG', 'GTG', 'CTG'"), FD + ",")
def start_hint(spark, d):
    return evidence.codon_hints(P.on_documents(spark, d), P.dna(spark, d), S.STARTS, "start").select("tx_id", "start", "stop", "codon")


@query("stop_hint", _codon_sql("CASE WHEN strand = '-' THEN start - 3 ELSE stop + 1 END", "CASE WHEN strand = '-' THEN start ELSE stop - 2 END", "'TAA', 'TAG', 'TGA'"), FD + ",")
def stop_hint(spark, d):
    return evidence.codon_hints(P.on_documents(spark, d), P.dna(spark, d), S.STOPS, "stop").select("tx_id", "start", "stop", "codon")


GREEDY = """RECURSIVE o AS (SELECT seq_name, CAST(length(sequence) AS BIGINT) AS n, row_number() OVER (ORDER BY seq_ord, seq_name, length(sequence)) AS k FROM d),
r AS (SELECT k, seq_name, CASE WHEN n >= 100000 THEN 0 ELSE n END AS s, CAST(0 AS BIGINT) AS g, CASE WHEN n >= 100000 THEN 1 ELSE 0 END AS nx FROM o WHERE k = 1
  UNION ALL SELECT o.k, o.seq_name, CASE WHEN r.s + o.n >= 100000 THEN 0 ELSE r.s + o.n END, r.g + r.nx, CASE WHEN r.s + o.n >= 100000 THEN 1 ELSE 0 END FROM r JOIN o ON o.k = r.k + 1)
SELECT seq_name, CASE WHEN (SELECT sum(n) FROM o) <= 100000 THEN 0 ELSE least(g, 19) END AS "group" FROM r"""


@query("greedy_groups", GREEDY.replace("RECURSIVE ", f"RECURSIVE {D}, ", 1), " ")
def greedy_groups(spark, d):
    return genome.greedy_groups(P.dna(spark, d), 100_000, 20)


def _chunk_sql(size: int, step: int) -> str:
    cut = f"rpad(substr(sequence, CAST(i * {step} + 1 AS BIGINT), {size}), {size}, 'N')"
    return f"""x AS (SELECT seq_name, sequence, k, unnest(generate_series(0, k - 1)) AS i FROM (SELECT *, greatest(1, CAST(ceil((length(sequence) - {size - step}) / {step}.0) AS BIGINT)) AS k FROM d))
SELECT seq_name, '+' AS strand, i AS chunk, i * {step} + 1 AS start, least(i * {step} + {size}, length(sequence)) AS stop, md5({cut}) AS digest FROM x
UNION ALL SELECT seq_name, '-', k - 1 - i, i * {step} + 1, least(i * {step} + {size}, length(sequence)), md5({REV.format(cut)}) FROM x"""


def _chunks(spark, d, size: int, overlap: int) -> DataFrame:
    return genome.chunks(P.dna(spark, d), size, overlap).select("seq_name", "strand", "chunk", "start", "stop", F.md5("sequence").alias("digest"))


@query("chunk_seqs", _chunk_sql(900, 900), f"{D},")
def chunk_seqs(spark, d):
    return _chunks(spark, d, 900, 0)


@query("flat_chunks", _chunk_sql(900, 810), f"{D},")
def flat_chunks(spark, d):
    return _chunks(spark, d, 900, 90)


# ---- tracks

W = P.TRACK


@query("wig_agg", "SELECT seqid, strand, pos, round(avg(val), 6) AS mean, count(*) AS n FROM w GROUP BY seqid, strand, pos", W)
def wig_agg(spark, d):
    return P.track(spark, d).groupBy(*KEYS, "pos").agg(F.round(F.avg("val"), 6).alias("mean"), F.count("*").alias("n"))


@query("wig_max", "SELECT seqid, pos, greatest(ln(0.001), max(val)) AS value FROM w GROUP BY seqid, pos", W)
def wig_max(spark, d):
    """The largest value at each position, and the floor of the older format where it is below."""
    return tracks.largest(P.track(spark, d), ["seqid", "pos"], "val").withColumnRenamed("val", "value")


@query("wig_runs", """SELECT seqid, strand, min(pos) AS start, count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY seqid, strand ORDER BY pos) AS run
  FROM (SELECT DISTINCT seqid, strand, pos FROM w)) GROUP BY seqid, strand, run""", W)  # fmt: skip
def wig_runs_query(spark, d):
    means = P.track(spark, d).groupBy(*KEYS, "pos").agg(F.avg("val").alias("value"))
    return wig_runs(means, KEYS).select(*KEYS, "start", "n")


# ---- labels

LABELS = f"""{PHASE}, ps AS (SELECT *, row_number() OVER (PARTITION BY seqid, strand, tx_id ORDER BY {READ}) AS r, count(*) OVER (PARTITION BY seqid, strand, tx_id) AS c FROM ph),
b AS (SELECT *, unnest(generate_series(start, stop)) AS pos FROM ps),
bk AS (SELECT *, CASE WHEN strand = '-' THEN stop - pos ELSE pos - start END AS k, stop - start + 1 AS z, (3 - phase) % 3 AS o FROM b),
ex AS (SELECT seqid, strand, tx_id, pos, CAST(CASE WHEN k = z - 1 AND r = c THEN 14 WHEN k = 0 AND r = 1 THEN 7 WHEN k = z - 1 THEN 8 + (z - phase + 1) % 3
  WHEN k = 0 THEN 11 + (o + 1) % 3 ELSE 4 + (k + o) % 3 END AS INTEGER) AS label FROM bk),
ip AS (SELECT * FROM (SELECT seqid, strand, tx_id, least(stop, lead(stop) OVER q) + 1 AS start, greatest(start, lead(start) OVER q) - 1 AS stop, lead(phase) OVER q AS phase, lead(start) OVER q AS s2
  FROM ph WINDOW q AS (PARTITION BY seqid, strand, tx_id ORDER BY {READ})) WHERE s2 IS NOT NULL AND stop >= start),
la AS (SELECT * FROM ex UNION ALL SELECT seqid, strand, tx_id, unnest(generate_series(start, stop)), CAST(1 + ((3 - phase) % 3 + 1) % 3 AS INTEGER) FROM ip)"""


@query("label_freq", "SELECT label, count(*) AS n FROM la GROUP BY label", f"{F_}, {LABELS}")
def label_freq(spark, d):
    return labels.all_labels(P.features(spark, d)).groupBy("label").agg(F.count("*").alias("n"))


def _case(scheme: int) -> str:
    return f"([{', '.join(map(str, labels.classes_of(scheme)))}])[label + 1]"


@query("label_reduce", "SELECT " + ", ".join(f"CAST({_case(k)} AS INTEGER) AS to_{k}" for k in labels.SCHEMES) + ", count(*) AS n FROM la GROUP BY ALL", f"{F_}, {LABELS}")
def label_reduce(spark, d):
    rows = labels.all_labels(P.features(spark, d)).select(*(labels.reduced(F.col("label"), k).alias(f"to_{k}") for k in labels.SCHEMES))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


CHUNKED = """ch AS (SELECT seqid, strand, (pos - 1) // 500 AS chunk, CASE WHEN strand = '-' THEN 499 - (pos - 1) % 500 ELSE (pos - 1) % 500 END AS "offset", arg_max(label, tx_id) AS label
  FROM la GROUP BY seqid, strand, pos)"""


@query("chunk_labels", """SELECT seqid, strand, chunk, count(*) AS n, CAST(sum("offset" * label) AS BIGINT) AS checksum FROM ch GROUP BY ALL""", f"{F_}, {LABELS}, {CHUNKED}")
def chunk_labels(spark, d):
    """How many bases of each tile have a label, and the sum of the labels by place."""
    tiles = labels.label_tiles(P.features(spark, d), 500)
    n = F.size(F.filter("labels", lambda x: x > 0)).cast("long")
    total = F.aggregate(F.transform("labels", lambda x, i: x.cast("long") * i), F.lit(0).cast("long"), lambda a, x: a + x)
    return tiles.select(*KEYS, "chunk", n.alias("n"), total.alias("checksum"))


@query("nonempty_chunks", "SELECT seqid, strand, chunk FROM ch GROUP BY ALL HAVING max(label) > 3", f"{F_}, {LABELS}, {CHUNKED}")
def nonempty_chunks(spark, d):
    """Chunks that hold a coding base."""
    return labels.label_tiles(P.features(spark, d), 500).where(F.exists("labels", lambda x: x > 3)).select(*KEYS, "chunk")


MASK = """far AS (SELECT seqid, greatest(start - 10, 0) AS a, stop + 10 AS b FROM t WHERE line_no % 7 = 0),
near AS (SELECT seqid, greatest(start - 20, 0) AS a, stop + 20 AS b FROM t WHERE line_no % 7 <> 0),
core AS (SELECT seqid, start AS a, stop AS b FROM t WHERE line_no % 7 = 0),
fp AS (SELECT DISTINCT seqid, unnest(generate_series(a, b - 1)) AS pos FROM far), np AS (SELECT DISTINCT seqid, unnest(generate_series(a, b - 1)) AS pos FROM near),
cp AS (SELECT DISTINCT seqid, unnest(generate_series(a, b - 1)) AS pos FROM core)
SELECT seqid, count(*) AS n, CAST(sum(pos) AS BIGINT) AS checksum FROM (SELECT * FROM cp UNION (SELECT * FROM fp EXCEPT SELECT * FROM np)) GROUP BY seqid"""


@query("tx_mask", MASK, f"{FT},")
def tx_mask(spark, d):
    """Masked positions by sequence; a list says which transcripts are filtered."""
    t = stored(T.assembled(P.features(spark, d)).select("seqid", "tx_id", "start", "stop", "line_no"))
    flagged = T.in_list(t, t.where("line_no % 7 = 0").select("tx_id"), "tx_id", "filtered")
    zero = labels.masked(flagged.where("not filtered"), flagged.where("filtered"), ["seqid"], 20)
    n, ends = F.col("stop") - F.col("start"), F.col("stop") + F.col("start") - 1
    return zero.groupBy("seqid").agg(F.sum(n).alias("n"), F.sum((n * ends / 2).cast("long")).alias("checksum"))


@query("shards", """SELECT CAST((row_number() OVER (ORDER BY md5(seq_name), seq_name) - 1) % 8 AS BIGINT) AS shard, count(*) OVER () AS n_all, seq_name FROM d""", D)
def shards(spark, d):
    """Sequences over 8 shards, every eighth one in a mixed order."""
    dna = P.dna(spark, d).select("seq_name")
    return genome.with_shard(dna, 8, "seq_name").withColumn("n_all", F.lit(dna.count()))


# ---- peptides

PEP = P.PEPTIDES
KIND = """CASE WHEN contains(header, 'type:complete') THEN 'complete' WHEN contains(header, 'type:5prime_partial') THEN '5prime_partial'
  WHEN contains(header, 'type:internal') THEN 'internal' WHEN contains(header, 'type:3prime_partial') THEN '3prime_partial' ELSE 'unknown' END"""
SHORT = f"""sh AS (SELECT id, regexp_replace(regexp_replace(header, ':\\d+-\\d+\\([+-]\\)', ':' || CASE WHEN st = '+' THEN a + 3 * cut ELSE a END || '-' ||
    CASE WHEN st = '+' THEN b ELSE b - 3 * cut END || '(' || st || ')'), 'len:\\d+', 'len:' || length(substr(core, cut + 1))) AS header, substr(core, cut + 1) || tail AS sequence FROM (
  SELECT *, strpos(core, 'M') - 1 AS cut FROM (SELECT id, header, {KIND} AS kind, rtrim(sequence, '*') AS core, CASE WHEN sequence LIKE '%*' THEN '*' ELSE '' END AS tail,
    CAST(regexp_extract(header, ':(\\d+)-(\\d+)\\(([+-])\\)', 1) AS BIGINT) AS a, CAST(regexp_extract(header, ':(\\d+)-(\\d+)\\(([+-])\\)', 2) AS BIGINT) AS b,
    regexp_extract(header, ':(\\d+)-(\\d+)\\(([+-])\\)', 3) AS st FROM pep)) WHERE kind IN ('5prime_partial', 'internal') AND cut >= 0)"""


@query("orf_type", f"SELECT id, {KIND} AS kind FROM pep", PEP)
def orf_type(spark, d):
    return P.peptides(spark, d).select("id", evidence.orf_type(F.col("header")).alias("kind"))


@query("pep_headers", """SELECT id, CAST(regexp_extract(header, 'len:(\\d+)', 1) AS BIGINT) AS length, CAST(regexp_extract(header, ':(\\d+)-(\\d+)\\(', 1) AS BIGINT) AS start,
  CAST(regexp_extract(header, ':(\\d+)-(\\d+)\\(', 2) AS BIGINT) AS stop, regexp_extract(header, '\\(([+-])\\)', 1) AS strand FROM pep""", PEP)  # fmt: skip
def pep_headers(spark, d):
    facts = evidence.header_facts(F.col("header"))
    return P.peptides(spark, d).select("id", *(facts[k].alias(k) for k in ("length", "start", "stop", "strand")))


@query("trim_first_m", "SELECT id, header, sequence FROM sh", f"{PEP}, {SHORT}")
def trim_first_m(spark, d):
    return evidence.shortened(P.peptides(spark, d))


@query("revise_pep", f"""SELECT pep.id, CASE WHEN c THEN CASE WHEN contains(sh.header, 'type:5prime_partial') THEN replace(sh.header, 'type:5prime_partial', 'type:complete')
  ELSE replace(sh.header, 'type:internal', 'type:3prime_partial') END ELSE pep.header END AS header, CASE WHEN c THEN sh.sequence ELSE pep.sequence END AS sequence
FROM (SELECT *, {KIND} IN ('5prime_partial', 'internal') AND length(sequence) % 5 <> 0 AS k FROM pep) pep LEFT JOIN sh ON sh.id = pep.id,
LATERAL (SELECT k AND sh.id IS NOT NULL AS c)""", f"{PEP}, {SHORT}")  # fmt: skip
def revise_pep(spark, d):
    pep = P.peptides(spark, d)
    classes = pep.select(F.col("id").alias("query"), F.when(F.length("sequence") % 5 != 0, "complete").otherwise("incomplete").alias("class"))
    return evidence.revised(pep, classes, evidence.shortened(pep))


# ---- more of the above


@query("tx_span", "SELECT tx_id, start, stop, stop - start + 1 AS width FROM t", FT)
def tx_span(spark, d):
    return T.assembled(P.features(spark, d)).select("tx_id", "start", "stop", T.length().alias("width"))


@query("rename_first_seen", "SELECT gene_id, 'n' || row_number() OVER (ORDER BY min(line_no)) AS new FROM f GROUP BY gene_id", F_)
def rename_first_seen(spark, d):
    return T.renamed_by_first_line(P.features(spark, d), "gene_id", "n")


PARENTS = """n AS (SELECT gene_id AS old, 'n' || row_number() OVER (ORDER BY min(line_no)) AS new FROM f WHERE s % 2 = 0 GROUP BY gene_id)
SELECT line_no, coalesce(a.new, gene_id) || ',' || coalesce(b.new, 'g' || p) AS parent FROM f LEFT JOIN n a ON a.old = gene_id LEFT JOIN n b ON b.old = 'g' || p"""


@query("new_parents", PARENTS, f"{F_},")
def new_parents(spark, d):
    f = P.features(spark, d)
    names = T.renamed_by_first_line(f.where("s % 2 = 0"), "gene_id", "n").withColumnRenamed("gene_id", "old")
    return T.with_new_parents(f.select("line_no", F.concat("gene_id", F.lit(",g"), "p").alias("parent")), names)


ATTRS = """CASE WHEN line_no % 2 = 0 THEN 'gene_id "' || gene_id || '"; transcript_id "' || tx_id || '"; n "' || p || '";' ELSE 'ID=' || tx_id || ';Parent=' || gene_id || ';n=' || p END"""


def _attributes(spark, d) -> DataFrame:
    return P.features(spark, d).select("line_no", F.expr(ATTRS).alias("attrs"))


@query("attr_parse", "SELECT line_no, CASE WHEN line_no % 2 = 0 THEN gene_id END AS gene, CASE WHEN line_no % 2 = 1 THEN gene_id END AS parent, CAST(p AS VARCHAR) AS n FROM f", F_)
def attr_parse(spark, d):
    a = parse(F.col("attrs"))
    value = lambda k: F.try_element_at(a, F.lit(k))
    return _attributes(spark, d).select("line_no", value("gene_id").alias("gene"), value("Parent").alias("parent"), value("n").alias("n"))


@query("attr_format", "SELECT line_no, CASE WHEN line_no % 2 = 0 THEN 'gene_id=' || gene_id || ';n=' || p || ';transcript_id=' || tx_id ELSE 'ID=' || tx_id || ';Parent=' || gene_id || ';n=' || p END AS attrs FROM f", F_)
def attr_format(spark, d):
    return _attributes(spark, d).select("line_no", format_gff(parse(F.col("attrs"))).alias("attrs"))


@query("mult_score", "SELECT line_no, CASE WHEN p % 3 = 0 THEN p ELSE 1 END AS score FROM f", F_)
def mult_score(spark, d):
    attrs = F.when(F.col("p") % 3 == 0, F.concat(F.lit("src=E;mult="), "p", F.lit(";"))).otherwise("src=E;")
    return P.features(spark, d).select("line_no", evidence.mult_score(attrs).alias("score"))


@query("top_hits", f"SELECT query, subject, place FROM (SELECT query, subject, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, subject, qstart, alen) AS BIGINT) AS place FROM ({SCORED})) WHERE place <= 5", H)
def top_hits(spark, d):
    return evidence.top_hits(P.hits(spark, d), 5).select("query", "subject", F.col("place").cast("long").alias("place"))


@query("species_id", "SELECT subject, split_part(subject, '_', 1) AS species, count(*) AS n FROM h GROUP BY ALL", H)
def species_id(spark, d):
    return P.hits(spark, d).select("subject", evidence.species_of(F.concat("subject", F.lit(" x_y"))).alias("species")).groupBy("subject", "species").agg(F.count("*").alias("n"))


@query("hits_scan", """SELECT query, count(*) AS n, count(CASE WHEN pident % 2 >= 1 THEN pident END) AS numbers, count(DISTINCT subject) AS subjects FROM h GROUP BY query""", H)
def hits_scan(spark, d):
    """A table of 12 columns, written with texts that are no numbers and subjects with more than an id, and read."""
    path = fresh_path(spark)
    text = F.when(F.col("pident") % 2 >= 1, F.col("pident").cast("string")).otherwise("-")
    subject = F.concat("subject", F.when(F.col("qstart") % 2 == 0, " more").otherwise("\\nmore"))
    rows = P.hits(spark, d).select("query", subject.alias("subject"), text.alias("pident"), *("alen qlen slen qstart qstart tstart tstart evalue bits".split()))
    rows.toDF(*(f"c{i}" for i in range(12))).select(F.concat_ws("\t", *(F.col(f"c{i}").cast("string") for i in range(12)))).write.text(path)
    return io.read_hits(spark, path).groupBy("query").agg(F.count("*").alias("n"), F.count("pident").alias("numbers"), F.countDistinct("subject").alias("subjects"))


@query("short_hits", f"""SELECT species, count(*) AS votes, round(sum(score), 2) AS total FROM (SELECT *, bits * (alen / qlen) AS score, split_part(subject, '_', 1) AS species FROM h
  WHERE evalue <= 0.05 AND pident >= 93 AND alen / qlen >= 0.5 QUALIFY row_number() OVER (PARTITION BY query ORDER BY bits * (alen / qlen) DESC, o, l) = 1) GROUP BY species""",
  P.HITS.replace("AS tstart FROM", "AS tstart, l_orderkey AS o, l_linenumber AS l FROM"))
def short_hits(spark, d):
    """A table of 8 columns with comments and short lines; of a query's best hits the first line holds."""
    path = fresh_path(spark)
    rows = P.hits(spark, d, "l_orderkey", "l_linenumber")
    line = F.concat_ws("\t", *(F.col(c).cast("string") for c in "query subject pident alen evalue bits qlen slen".split()))
    lines = F.explode(F.array(line, F.when(F.col("l_linenumber") == 1, "# comment").otherwise("too\tshort")))
    rows.repartitionByRange("l_orderkey", "l_linenumber").sortWithinPartitions("l_orderkey", "l_linenumber").select(lines).write.text(path)
    hits = io.read_short_hits(spark, path, folders=True)
    best = evidence.best_hits(evidence.good_hits(hits, 0.05, 93.0, 0.5))
    return best.groupBy("species").agg(F.count("*").alias("votes"), F.round(F.sum("score"), 2).alias("total"))


@query("prefilter_db", f"""r AS (SELECT species, count(*) AS votes, sum(score) AS total FROM ({SCORED}{GOOD}{BEST}) GROUP BY species),
m AS (SELECT species FROM r ORDER BY votes DESC, round(total, 3) DESC, species LIMIT 5)
SELECT DISTINCT subject FROM h WHERE (SELECT count(DISTINCT subject) FROM h) <= 1000 OR split_part(subject, '_', 1) IN (SELECT species FROM m)""", f"{H},")  # fmt: skip
def prefilter_db(spark, d):
    h = P.hits(spark, d)
    return evidence.prefiltered(h.select("subject").distinct(), evidence.ranked_species(h, 0.05, 93.0, 0.5, 5), "subject", 1000)


@query("align_rate", "SELECT query, round(100.0 * count(*) FILTER (alen >= 10) / count(*), 6) AS rate FROM h GROUP BY query HAVING 100.0 * count(*) FILTER (alen >= 10) / count(*) >= 80", H)
def align_rate(spark, d):
    return evidence.mapped_rates(P.hits(spark, d), "query", F.col("alen") >= 10, 80.0).withColumn("rate", F.round("rate", 6))


PART = """SELECT 'CDSpart' AS type, tx_id, CASE WHEN start + 15 > stop - 15 THEN (start + stop) // 2 ELSE start + 15 END AS start, CASE WHEN start + 15 > stop - 15 THEN (start + stop) // 2 ELSE stop - 15 END AS stop FROM f"""
INTRON = """SELECT 'intron' AS type, tx_id, start, stop FROM (SELECT tx_id, least(stop, lag(stop) OVER o) + 1 AS start, greatest(start, lag(start) OVER o) - 1 AS stop, lag(start) OVER o AS s0
  FROM f WINDOW o AS (PARTITION BY seqid, tx_id ORDER BY line_no)) WHERE s0 IS NOT NULL AND start <= stop"""


@query("hints", f"SELECT type, tx_id, start, stop, count(*) AS n FROM ({PART} UNION ALL {INTRON}) GROUP BY ALL", F_)
def hints(spark, d):
    f = P.features(spark, d)
    parts = evidence.cds_part_hints(f).select(F.lit("CDSpart").alias("type"), "tx_id", "start", "stop")
    gaps = evidence.intron_hints(f).select(F.lit("intron").alias("type"), "tx_id", "start", "stop")
    return parts.unionByName(gaps).groupBy("type", "tx_id", "start", "stop").agg(F.count("*").alias("n"))


@query("concat_hints", f"SELECT 1 AS source, tx_id, start, stop FROM ({PART}) UNION ALL SELECT 2, tx_id, start, stop FROM ({INTRON})", F_)
def concat_hints(spark, d):
    """Hints of several sources as one bag, each with its source."""
    f = P.features(spark, d)
    parts = [evidence.cds_part_hints(f), evidence.intron_hints(f)]
    first, second = (x.select(F.lit(i + 1).alias("source"), "tx_id", "start", "stop") for i, x in enumerate(parts))
    return first.unionByName(second)


@query("orf_pairs", """a AS (SELECT seqid, strand, pos FROM la WHERE label = 7), z AS (SELECT seqid, strand, pos FROM la WHERE label = 14)
SELECT seqid, strand, start, stop FROM (SELECT seqid, strand, pos AS start, (SELECT min(z.pos) FROM z WHERE z.seqid = a.seqid AND z.strand = a.strand AND z.pos > a.pos + 3) AS stop FROM a) WHERE stop IS NOT NULL""", f"{F_}, {LABELS},")  # fmt: skip
def orf_pairs(spark, d):
    return labels.reading_frames(*labels.frame_ends(P.features(spark, d)), KEYS)


@query("transition_weights", f"""cd AS (SELECT DISTINCT seqid, strand, pos AS start, pos AS stop FROM la WHERE label > 3), ru AS ({_merged('cd')}),
en AS (SELECT seqid, strand, unnest([start, stop + 1]) AS at_ FROM ru), ne AS (SELECT seqid, strand, greatest(0, at_ - 25) AS start, at_ + 24 AS stop FROM en)
SELECT seqid, strand, start, stop + 1 AS stop FROM ({_merged('ne')})""", f"{F_}, {LABELS},")  # fmt: skip
def transition_weights(spark, d):
    return labels.transitions(P.features(spark, d), KEYS, 25)


CAND = """ca AS (SELECT 't' || doc_id || '.p1' AS id, 't' || doc_id AS tx_id, CAST(doc_id % 90 AS BIGINT) AS start, CAST(doc_id % 90 + 60 AS BIGINT) AS stop, CASE WHEN doc_id % 3 = 0 THEN '-' ELSE '+' END AS strand,
  CAST(length(text) AS BIGINT) AS length, CAST(doc_id % 120 AS DOUBLE) AS score, CASE WHEN doc_id % 2 = 0 THEN 'complete' ELSE 'internal' END AS kind FROM documents)"""


def _candidates(spark, d) -> DataFrame:
    i = F.col("doc_id").cast("long")
    return P.table(spark, d, "documents").select(
        F.concat(F.lit("t"), i, F.lit(".p1")).alias("id"), F.concat(F.lit("t"), i).alias("tx_id"), (i % 90).alias("start"), (i % 90 + 60).alias("stop"),
        F.when(i % 3 == 0, "-").otherwise("+").alias("strand"), F.length("text").cast("long").alias("length"), (i % 120).cast("double").alias("score"),
        F.when(i % 2 == 0, "complete").otherwise("internal").alias("kind"),
    )


@query("pep_to_gff3", """y AS (SELECT c.tx_id, c.id, c.strand, c.start, c.stop, t.bp FROM ca c JOIN t ON c.tx_id = t.tx_id)
SELECT * FROM (SELECT tx_id, id, strand, unnest(['gene', 'mRNA', 'exon']) AS type, CAST(1 AS BIGINT) AS start, bp AS stop FROM y UNION ALL SELECT tx_id, id, strand, 'CDS', start, stop FROM y
UNION ALL SELECT tx_id, id, strand, CASE WHEN strand = '+' THEN 'five_prime_UTR' ELSE 'three_prime_UTR' END, 1, start - 1 FROM y
UNION ALL SELECT tx_id, id, strand, CASE WHEN strand = '+' THEN 'three_prime_UTR' ELSE 'five_prime_UTR' END, stop + 1, bp FROM y) WHERE start <= stop""", f"{FT}, {CAND},")  # fmt: skip
def pep_to_gff3(spark, d):
    lengths = P.features(spark, d).groupBy("tx_id").agg(F.sum(T.length()).alias("length"))
    return evidence.candidate_rows(_candidates(spark, d).select("id", "tx_id", "start", "stop", "strand"), lengths)


@query("hc_intrinsic", """u AS (SELECT tx_id, regexp_matches(upper(sequence), 'TAA|TAG|TGA') AS flag FROM (SELECT 't' || substr(seq_name, 2) AS tx_id, substr(sequence, 1, 60) AS sequence FROM d)),
k AS (SELECT id, length * 3 >= 250 AND score > 50 AND kind = 'complete' AND flag AND (tx_id IN (SELECT tx_id FROM t WHERE bp % 2 = 0)) AS high, tx_id FROM ca JOIN u USING (tx_id))
SELECT id, CASE WHEN high THEN 'HC' ELSE 'LC' END AS class FROM k""", f"{FT}, {CAND}, {D},")  # fmt: skip
def hc_intrinsic(spark, d):
    """Confidence of all candidates; the 5' UTR is a transcript's first 60 bases here."""
    candidates = _candidates(spark, d)
    free = candidates.join(T.assembled(P.features(spark, d)).select("tx_id", (F.col("bp") % 2 == 0).alias("flag")), "tx_id").select("id", "flag")
    utrs = P.dna(spark, d).select(F.concat(F.lit("t"), F.substring("seq_name", 2, 20)).alias("tx_id"), F.substring("sequence", 1, 60).alias("sequence"))
    utr = evidence.stops_in_utrs(candidates, utrs)
    return evidence.confident(candidates, free, utr).select("id", "class")


@query("anno_subset", """SELECT 'a.' || tx_id AS tx_id, 'a.' || gene_id AS gene_id, start, stop FROM t WHERE seqid = 'chr0' UNION ALL
  SELECT 'b.' || tx_id, 'b.' || gene_id, start, stop FROM t WHERE tx_id IN (SELECT tx_id FROM f WHERE s % 4 = 0)""", FT)  # fmt: skip
def anno_subset(spark, d):
    """Two parts of an annotation, each with a prefix to its ids, together."""
    f = P.features(spark, d)
    t = T.assembled(f)
    both = T.with_prefix(t.where("seqid = 'chr0'"), "a").unionByName(T.with_prefix(T.subset(t, f.where("s % 4 = 0")), "b"))
    return both.select("tx_id", "gene_id", "start", "stop")


@query("lift_coordinates", """ex AS (SELECT tx_id, seqid, strand, start AS e0, stop AS e1, sum(stop - start + 1) OVER o - (stop - start + 1) AS before, sum(stop - start + 1) OVER o AS upto FROM f
  WINDOW o AS (PARTITION BY tx_id ORDER BY CASE WHEN strand = '-' THEN -stop ELSE start END ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, greatest(5, before + 1) - before AS lo, least(60, upto) - before AS hi FROM ex WHERE upto >= 5 AND before < 60)
SELECT tx_id, CAST(CASE WHEN strand = '-' THEN e1 - hi + 1 ELSE e0 + lo - 1 END AS BIGINT) AS start, CAST(CASE WHEN strand = '-' THEN e1 - lo + 1 ELSE e0 + hi - 1 END AS BIGINT) AS stop FROM c""", f"{F_},")  # fmt: skip
def lift_coordinates(spark, d):
    f = P.features(spark, d)
    parts = f.select("tx_id").distinct().select("tx_id", F.lit(5).cast("long").alias("start"), F.lit(60).cast("long").alias("stop"))
    return genome.lifted(parts, f).select("tx_id", "start", "stop")


@query("shard_len_check", """SELECT CAST(sum(2 * greatest(1, CAST(ceil(length(sequence) / 900.0) AS BIGINT))) AS BIGINT) AS n,
  CAST(sum(CASE WHEN length(sequence) > 0 AND length(sequence) % 900 = 0 THEN 0 ELSE 2 END) AS BIGINT) AS short FROM d""", D)  # fmt: skip
def shard_len_check(spark, d):
    """All tiles of both strands without padding at the end, and how many are shorter than 900."""
    path = fresh_path(spark)
    tiles = genome.chunks(P.dna(spark, d), 900)
    tiles.withColumn("sequence", F.substring("sequence", F.lit(1), (F.col("stop") - F.col("start") + 1).cast("int"))).write.parquet(path)
    return genome.length_check(spark.read.parquet(path), "sequence", 900)


# ---- files: tables are written in a format, then read


@query("fasta_scan", "SELECT seq_name, md5(sequence) AS digest FROM d", D)
def fasta_scan(spark, d):
    path = fresh_path(spark)
    io.write_fasta(P.dna(spark, d), path)
    return io.read_fasta(spark, path).select("seq_name", F.md5("sequence").alias("digest"))


@query("species_list", "SELECT 'sp' || s_suppkey AS name FROM supplier WHERE s_suppkey % 3 = 0")
def species_list(spark, d):
    """Names from a list file; its blank lines and comments are dropped."""
    path = fresh_path(spark)
    name = F.concat(F.lit("sp"), F.col("s_suppkey"))
    line = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" "), name)).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("# "), name)).otherwise(" ")
    P.table(spark, d, "supplier").select(line).write.text(path)
    return io.read_lines(spark, path)


@query("sniff_format", """SELECT n_nationkey AS nation, CASE WHEN n_nationkey % 3 = 0 THEN 'fasta' WHEN n_nationkey % 3 = 1 AND n_nationkey % 2 = 0 THEN 'fastq' ELSE 'unknown' END AS format FROM nation""")
def sniff_format(spark, d):
    """The formats of files by their first and third lines; one file a nation is written."""
    path = fresh_path(spark)
    i = F.col("n_nationkey")
    first = F.concat(F.when(i % 3 == 0, ">").when(i % 3 == 1, "@").otherwise("s"), i)
    lines = F.concat_ws("\n", first, F.lit("ACGT"), F.when(i % 2 == 0, "+").otherwise("ACGT"))
    P.table(spark, d, "nation").select(i.alias("nation"), lines.alias("value")).write.partitionBy("nation").text(path)
    return io.sniff_files(spark, path).select(F.regexp_extract("file", r"nation=(\d+)", 1).cast("long").alias("nation"), "format")


@query("model_cards", """SELECT CAST(n_nationkey AS BIGINT) AS nation, CASE WHEN n_nationkey % 3 = 0 THEN 'clamsa' ELSE '' END AS missing, 'http://host/w/' || n_regionkey AS url FROM nation""")
def model_cards(spark, d):
    """What cards lack, and their addresses; one file a nation is written."""
    path = fresh_path(spark)
    i = F.col("n_nationkey")
    last = F.when(i % 3 == 0, "clamsa: null").otherwise("clamsa: false  # no")
    card = F.concat_ws("\n", F.lit("# card"), F.concat(F.lit('weights_url: "http://host//w/'), "n_regionkey", F.lit('"')), F.lit("softmasking: true"), last)
    P.table(spark, d, "nation").select(i.alias("nation"), card.alias("value")).write.partitionBy("nation").text(path)
    cards = stored(cards_io.read_cards(spark, path))
    known = cards_io.distinct_urls(cards)
    url = F.regexp_replace(F.try_element_at("card", F.lit("weights_url")), "(?<!:)//+", "/")
    rows = cards.select(F.regexp_extract("file", r"nation=(\d+)", 1).cast("long").alias("nation"), F.array_join(cards_io.missing_keys(F.col("card")), ",").alias("missing"), url.alias("url"))
    return rows.join(known, "url", "left_semi").select("nation", "missing", "url")


@query("latest_version", """SELECT n_regionkey AS region, 'v1.' || max(n_nationkey) || '.0' AS tag FROM nation GROUP BY n_regionkey""")
def latest_version(spark, d):
    """The highest version among tags, by numbers and not by letters."""
    tag = F.concat(F.lit("v1."), "n_nationkey", F.lit(".0"))
    tags = P.table(spark, d, "nation").select("n_regionkey", F.explode(F.array(tag, F.lit("latest"))).alias("tag"))
    return tags.groupBy(F.col("n_regionkey").alias("region")).agg(F.max_by("tag", cards_io.version_of(F.col("tag"))).alias("tag"))


@query("gtf_scan", "SELECT seqid, strand, tx_id, gene_id, start, stop, type FROM f", F_)
def gtf_scan(spark, d):
    path = fresh_path(spark)
    attrs = F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; transcript_id "'), "tx_id", F.lit('";'))
    rows = P.features(spark, d).withColumns({"source": F.lit("x"), "score": F.lit("."), "phase": F.lit("."), "attrs": attrs})
    io.write_gff(rows, path)
    return io.read_gff(spark, path).select(*T.TX, "gene_id", "start", "stop", "type")


@query("wig_scan", "SELECT seqid, pos, CAST(max(val) AS DOUBLE) AS value FROM w GROUP BY seqid, pos", W)
def wig_scan(spark, d):
    path = fresh_path(spark)
    io.write_wig(P.track(spark, d).groupBy("seqid", "pos").agg(F.max("val").alias("value")), path)
    return io.read_wig(spark, path).select("seqid", "pos", "value")


@query("shard_read", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(length(sequence)) AS BIGINT) AS bp FROM d", D)
def shard_read(spark, d):
    """Sequences written in 8 shards and read again."""
    path = fresh_path(spark)
    genome.with_shard(P.dna(spark, d), 8, "seq_name").write.partitionBy("shard").parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum(F.length("sequence").cast("long")).alias("bp"))


@query("stream_hints", "SELECT line_no, CASE WHEN start + 15 > stop - 15 THEN (start + stop) // 2 ELSE start + 15 END AS start, CASE WHEN start + 15 > stop - 15 THEN (start + stop) // 2 ELSE stop - 15 END AS stop FROM f", F_)
def stream_hints(spark, d):
    """The hints of arriving feature files, by a stream that ends when it has read all."""
    rows = P.features(spark, d).select("line_no", "start", "stop")
    folder, out, state = fresh_path(spark), fresh_path(spark), fresh_path(spark)
    rows.write.parquet(folder)
    arriving(spark, folder, "line_no long, start long, stop long", evidence.cds_part_hints, out, state).awaitTermination()
    return spark.read.schema("line_no long, start long, stop long").parquet(out)


@query("gff_hierarchy", """SELECT gene_id, count(DISTINCT tx_id) AS n_tx, count(*) FILTER (p % 3 = 0) AS n_utr, count(*) FILTER (p % 3 <> 0) AS n_cds FROM f GROUP BY gene_id""", F_)
def gff_hierarchy(spark, d):
    """Genes with the numbers of their transcripts and parts, from a GFF3 file of genes, mRNAs and parts."""
    path = fresh_path(spark)
    f = P.features(spark, d)
    parts = f.select("seqid", "strand", F.when(F.col("p") % 3 == 0, "five_prime_UTR").otherwise("CDS").alias("type"), "start", "stop", F.concat(F.lit("Parent="), "tx_id").alias("attrs"))
    mrna = T.assembled(f).select("seqid", "strand", F.lit("mRNA").alias("type"), "start", "stop", F.concat(F.lit("ID="), "tx_id", F.lit(";Parent="), "gene_id").alias("attrs"))
    gene = f.groupBy("seqid", "strand", "gene_id").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    gene = gene.select("seqid", "strand", F.lit("gene").alias("type"), "start", "stop", F.concat(F.lit("ID="), "gene_id").alias("attrs"))
    io.write_gff(gene.unionByName(mrna).unionByName(parts).withColumns({c: F.lit(".") for c in ("source", "score", "phase")}), path)
    return models.hierarchy_counts(io.read_gff(spark, path))


MERGED_FILES = f"""x AS (SELECT *, CASE WHEN p % 3 = 0 THEN 'five_prime_UTR' ELSE 'CDS' END AS kind FROM f),
t AS (SELECT file_idx, seqid, strand, tx_id AS tid, min(start) FILTER (kind = 'CDS') AS start, max(stop) FILTER (kind = 'CDS') AS stop, file_idx * 1000000000000 + min(line_no) AS line_no,
  string_agg(start || '-' || stop, ',' ORDER BY start, stop) FILTER (kind = 'CDS') AS parts, coalesce(sum(stop - start + 1) FILTER (kind <> 'CDS'), 0) AS utr_bp, min(start) AS out_start,
  max(stop) AS out_stop, file_idx || ':' || seqid || ':' || strand || ':' || tx_id AS tx_id FROM x GROUP BY file_idx, seqid, strand, tx_id HAVING count(*) FILTER (kind = 'CDS') > 0),
{LT}, u AS ({STRUCT}), m0 AS (WITH {MERGE}), mg AS (SELECT m0.gene, m0.tx, t.* FROM m0 JOIN t USING (tx_id)),
pt AS (SELECT mg.tx, x.*, row_number() OVER (PARTITION BY tx, kind ORDER BY x.start, x.stop) AS i FROM mg JOIN x ON x.file_idx = mg.file_idx AND x.seqid = mg.seqid AND x.strand = mg.strand AND x.tx_id = mg.tid)
SELECT seqid, strand, 'gene' AS type, min(out_start) AS start, max(out_stop) AS stop, 'ID=' || gene AS attrs FROM mg GROUP BY seqid, strand, gene
UNION ALL SELECT seqid, strand, 'transcript', out_start, out_stop, 'ID=' || tx || ';Parent=' || gene FROM mg
UNION ALL SELECT seqid, strand, 'exon', start, stop, 'ID=' || tx || '.exon' || i || ';Parent=' || tx FROM pt WHERE kind = 'CDS'
UNION ALL SELECT seqid, strand, kind, start, stop, 'ID=' || tx || CASE WHEN kind = 'CDS' THEN '.cds' ELSE '.utr' END || i || ';Parent=' || tx FROM pt"""


@query("merge_files", MERGED_FILES, f"{F_},")
def merge_files(spark, d):
    """Two files, a GTF and a GFF3, merged, written as GFF3 and read again."""
    f = P.features(spark, d).withColumn("type", F.when(F.col("p") % 3 == 0, "five_prime_UTR").otherwise("CDS")).withColumns({c: F.lit(".") for c in ("source", "score", "phase")})
    gtf, gff, out = fresh_path(spark), fresh_path(spark), fresh_path(spark)
    io.write_gtf(f.where("file_idx = 0").withColumn("attributes", F.create_map(F.lit("gene_id"), "gene_id", F.lit("transcript_id"), "tx_id")), gtf, ["line_no"])
    io.write_gff(f.where("file_idx = 1").withColumn("attrs", F.concat(F.lit("Parent="), "tx_id")), gff, ["line_no"])
    found = models.models_of(io.read_models(spark, [gtf, gff], folders=True))
    io.write_gff(models.cluster_rows(merging.merge_all(found)), out, ["gene", "nth", "rank", "i"])
    return io.read_gff(spark, out).select("seqid", "strand", "type", "start", "stop", "attrs")


GTF = """ct AS (SELECT *, count(*) OVER w AS c, row_number() OVER (w ORDER BY CASE WHEN strand = '-' THEN -stop ELSE start END, line_no) AS r FROM f WINDOW w AS (PARTITION BY seqid, strand, tx_id)),
ck AS (SELECT *, CASE WHEN c = 1 THEN 'single' WHEN r = 1 THEN 'initial' WHEN r = c THEN 'terminal' ELSE 'internal' END AS kind FROM ct)
SELECT seqid, 'gene' AS type, min(start) AS start, max(stop) AS stop, gene_id AS attrs FROM f GROUP BY seqid, gene_id
UNION ALL SELECT seqid, 'transcript', min(start), max(stop), 'x.' || tx_id FROM f GROUP BY seqid, strand, gene_id, tx_id
UNION ALL SELECT seqid, 'CDS', start, stop, 'transcript_id "x.' || tx_id || '"; gene_id "' || gene_id || '"; cds_type=' || kind || ';' FROM ck
UNION ALL SELECT seqid, 'exon', start, stop, 'transcript_id "x.' || tx_id || '"; gene_id "' || gene_id || '";' FROM ck"""


@query("write_gtf", GTF, f"{F_},")
def write_gtf(spark, d):
    """The annotation as an ordered GTF file, read again."""
    path = fresh_path(spark)
    genes = models.gtf_genes(P.features(spark, d))
    io.write_groups(genes, path, ["seqid", "gene_start", "gene_stop", "gene_id"], models.gtf_lines(genes, "x"), "gzip")
    return io.read_gff(spark, path).select("seqid", "type", "start", "stop", "attrs")


REBUILD = f"""c AS (SELECT seqid, strand, tx_id, line_no, CASE WHEN strand = '-' AND lo = 1 THEN least(start, coalesce(low, start)) ELSE start END AS start,
  CASE WHEN strand = '+' AND hi = 1 THEN greatest(stop, coalesce(high, stop)) ELSE stop END AS stop FROM (
  SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY stop DESC, line_no) AS hi, row_number() OVER (PARTITION BY tx_id ORDER BY start, line_no) AS lo FROM f
  WHERE s % 3 <> 0) LEFT JOIN (SELECT tx_id, max(stop) AS high, min(start) AS low FROM f WHERE s % 3 = 0 GROUP BY tx_id) USING (tx_id)),
b AS (SELECT seqid, strand, tx_id, start, stop, 'CDS' AS type FROM c UNION ALL SELECT seqid, strand, tx_id, start, stop, 'UTR' FROM f WHERE s % 3 = 0 AND tx_id IN (SELECT tx_id FROM c)),
w AS (SELECT tx_id, seqid, strand, min(start) AS start, max(stop) AS stop FROM b GROUP BY ALL),
g AS (SELECT w.*, CASE WHEN gene_id IN (SELECT gene_id FROM f WHERE s % 9 = 0) THEN gene_id ELSE w.tx_id || '.gene' END AS gene FROM w JOIN (SELECT DISTINCT tx_id, gene_id FROM f) USING (tx_id)),
e AS (SELECT tx_id, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(new) OVER (PARTITION BY tx_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS k FROM (
  SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY tx_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM b)) GROUP BY tx_id, k),
r AS (SELECT 'gene' AS type, min(start) AS start, max(stop) AS stop, 'ID=' || gene AS attrs FROM g GROUP BY gene
UNION ALL SELECT 'transcript', start, stop, 'ID=' || tx_id || ';Parent=' || gene FROM g
UNION ALL SELECT 'exon', start, stop, 'ID=' || tx_id || '.exon' || row_number() OVER (PARTITION BY tx_id ORDER BY start) || ';Parent=' || tx_id FROM e
UNION ALL SELECT type, start, stop, 'ID=' || tx_id || '.' || lower(type) || row_number() OVER (PARTITION BY tx_id, type ORDER BY start, stop) || ';Parent=' || tx_id FROM b)
SELECT * FROM r"""


@query("extend_rebuild", REBUILD, f"{F_},")
def extend_rebuild(spark, d):
    """Coding parts reach to stop codons, exons are made anew from them and the UTRs, missing genes are made; as GFF3."""
    f = stored(P.features(spark, d).select(*T.TX, "gene_id", "start", "stop", "line_no", "s")).withColumns({"source": F.lit("x"), "phase": F.lit(".")})
    stops = f.where("s % 3 = 0")
    cds = T.with_stop_codon(f.where("s % 3 <> 0").select(*T.TX, "source", "start", "stop", "phase", "line_no"), stops)
    genes = models.rebuilt_genes(cds, stops.withColumn("type", F.lit("UTR")), f.select("tx_id", "gene_id"), f.where("s % 9 = 0"))
    path = fresh_path(spark)
    io.write_groups(genes, path, ["seqid", "gene_start", "gene_id"], models.rebuilt_lines(), "gzip")
    return io.read_gff(spark, path).select("type", "start", "stop", "attrs")


ISOFORM = r"""ch AS (SELECT gene_id, tx_id FROM t QUALIFY row_number() OVER (PARTITION BY gene_id ORDER BY bp DESC, line_no) = 1),
li AS (SELECT 'gene_id "' || gene_id || '";' AS a, ' transcript_id "' || tx_id || '";' AS b, * FROM f JOIN ch USING (gene_id, tx_id)),
sp AS (SELECT any_value(seqid) || chr(9) || '.' || chr(9) AS l, chr(9) || min(start) || chr(9) || max(stop) || chr(9) || '.' || chr(9) || any_value(strand) || chr(9) || '.' || chr(9) AS r, a, b FROM li GROUP BY a, b)
SELECT seqid || chr(9) || '.' || chr(9) || 'CDS' || chr(9) || start || chr(9) || stop || chr(9) || '.' || chr(9) || strand || chr(9) || '.' || chr(9) || a || b AS line FROM li
UNION ALL SELECT l || 'gene' || r || a FROM sp UNION ALL SELECT l || 'transcript' || r || a || b FROM sp"""


@query("isoform_gtf", ISOFORM, f"{FT},")
def isoform_gtf(spark, d):
    """The lines of each gene's longest isoform, with gene and transcript lines before, in the file's order."""
    path, out = fresh_path(spark), fresh_path(spark)
    attributes = F.create_map(F.lit("gene_id"), "gene_id", F.lit("transcript_id"), "tx_id")
    io.write_gtf(P.features(spark, d).withColumns({c: F.lit(".") for c in ("source", "score", "phase")} | {"attributes": attributes}), path, ["line_no"])
    rows = stored(io.read_gff(spark, path, raw=True, folders=True))
    io.write_lines(models.isoform_lines(rows, T.longest_isoform(rows)), out, ["file", "place"])
    return spark.read.text(out).withColumnRenamed("value", "line")


HINT_SQL = f"""k AS (SELECT * FROM fd WHERE p % 13 <> 0),
pa AS (SELECT 'CDSpart' AS type, tx_id, CASE WHEN start + 15 > stop - 15 THEN (start + stop) // 2 ELSE start + 15 END AS start, CASE WHEN start + 15 > stop - 15 THEN (start + stop) // 2 ELSE stop - 15 END AS stop FROM k),
ga AS (SELECT 'intron' AS type, tx_id, start, stop FROM (SELECT tx_id, least(stop, lag(stop) OVER o) + 1 AS start, greatest(start, lag(start) OVER o) - 1 AS stop, lag(start) OVER o AS s0
  FROM k WINDOW o AS (PARTITION BY seqid, tx_id ORDER BY line_no)) WHERE s0 IS NOT NULL AND start <= stop),
ge AS (SELECT seqid, strand, tx_id, min(start) AS start, max(stop) AS stop FROM fd GROUP BY ALL),
st AS (SELECT tx_id, strand, start, stop, upper(CASE WHEN strand = '-' THEN {REV.format('substr(sequence, stop - 2, 3)')} ELSE substr(sequence, start, 3) END) AS a,
  CASE WHEN strand = '-' AND start < 4 THEN '' ELSE upper(CASE WHEN strand = '-' THEN {REV.format('substr(sequence, start - 3, 3)')} ELSE substr(sequence, stop + 1, 3) END) END AS z FROM ge JOIN d ON seqid = seq_name),
co AS (SELECT 'start' AS type, tx_id, CASE WHEN strand = '-' THEN stop - 2 ELSE start END AS start, CASE WHEN strand = '-' THEN stop ELSE start + 2 END AS stop FROM st WHERE a IN ('ATG', 'TTG', 'GTG', 'CTG')
  UNION ALL SELECT 'stop', tx_id, CASE WHEN strand = '-' THEN start ELSE stop - 2 END, CASE WHEN strand = '-' THEN start + 2 ELSE stop END FROM st WHERE z IN ('TAA', 'TAG', 'TGA'))
SELECT type, start, stop, 'src=P;grp=' || tx_id || ';pri=4' AS attrs FROM (SELECT * FROM pa UNION ALL SELECT * FROM ga UNION ALL SELECT * FROM co)"""


@query("aligned_hints", HINT_SQL, f"{FD},")
def aligned_hints(spark, d):
    """Hints from alignments, as a GFF file read again: coding parts, introns, start and stop codons; lines with a * are left out."""
    f = P.on_documents(spark, d).withColumns({"score": F.lit("."), "phase": F.lit("."), "attrs": F.when(F.col("p") % 13 == 0, "x*").otherwise("x")})
    f = stored(f.select(*T.TX, "type", "start", "stop", "score", "phase", "attrs", "line_no"))
    spans = f.groupBy(*T.TX).agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    genes = spans.withColumns({"type": F.lit("gene"), "score": F.lit("."), "phase": F.lit("."), "attrs": F.lit("x"), "line_no": F.lit(0).cast("long")})
    path = fresh_path(spark)
    io.write_gff(evidence.aligned_hints(f.unionByName(genes), P.dna(spark, d)).withColumn("source", F.lit("x")), path)
    return io.read_gff(spark, path).select("type", "start", "stop", "attrs")


@query("annotate", """ch AS (SELECT seq_name, unnest(generate_series(1, length(sequence))) AS pos, sequence FROM d),
gc AS (SELECT seq_name, pos FROM ch WHERE upper(substr(sequence, pos, 1)) IN ('G', 'C')),
ru AS (SELECT seq_name, min(pos) AS start, max(pos) AS stop FROM (SELECT *, pos - row_number() OVER (PARTITION BY seq_name ORDER BY pos) AS k FROM gc) GROUP BY seq_name, k)
SELECT seq_name, strand, count(*) AS n, CAST(sum(start * 7 + stop) AS BIGINT) AS checksum FROM ru, (SELECT unnest(['+', '-']) AS strand) GROUP BY ALL""".replace(
    "ch AS (SELECT seq_name, unnest(generate_series(1, length(sequence))) AS pos, sequence FROM d),\ngc AS (SELECT seq_name, pos FROM ch WHERE upper(substr(sequence, pos, 1)) IN ('G', 'C'))",
    "gc AS (SELECT seq_name, unnest(list_filter(generate_series(1, length(sequence)), lambda i: cs[i] IN ('G', 'C'))) AS pos FROM (SELECT *, string_split(upper(sequence), '') AS cs FROM d))"), f"{D},")
def annotate(spark, d):
    """Whole sequences tiled, scored on both strands and decoded; the scorer here tells G and C from the rest."""
    moves = np.log(np.full((2, 2), 0.5))
    runs = decoding.genome_runs(P.dna(spark, d), 900, 90, gc_scores, moves, moves[0])
    found = decoding.annotated(runs, [1])
    return found.groupBy("seq_name", "strand").agg(F.count("*").alias("n"), F.sum(F.col("start") * 7 + F.col("stop")).alias("checksum"))


def gc_scores(sequences: list[str]) -> np.ndarray:
    """Log scores of two states for sequences of one length: 1 for G and C."""
    letters = np.frombuffer("".join(sequences).upper().encode(), np.uint8).reshape(len(sequences), -1)
    strong = (letters == ord("G")) | (letters == ord("C"))
    return np.stack([np.where(strong, -3.0, 0.0), np.where(strong, 0.0, -3.0)], axis=2)


@query("track_tiles", """v AS (SELECT seqid, pos - (SELECT min(pos) FROM w) AS pos, max(val) AS val FROM w GROUP BY seqid, pos),
n AS (SELECT seqid, max(pos) + 1 AS length FROM v GROUP BY seqid),
ti AS (SELECT seqid, length, unnest(generate_series(0, length // 50 - 1)) AS tile FROM n WHERE length >= 50),
s AS (SELECT ti.seqid, tile, (SELECT max(length // 50) - 1 FROM n) AS last, round(coalesce(sum(greatest(val, ln(0.001)) * (pos % 50)), 0) + ln(0.001) * (1225 - coalesce(sum(pos % 50), 0)), 4) AS a,
  round(coalesce(sum(greatest(val, ln(0.001)) * (49 - pos % 50)), 0) + ln(0.001) * (1225 - coalesce(sum(49 - pos % 50), 0)), 4) AS b
  FROM ti LEFT JOIN v ON v.seqid = ti.seqid AND v.pos // 50 = tile GROUP BY ti.seqid, tile)
SELECT seqid, '+' AS strand, tile, a AS checksum FROM s UNION ALL SELECT seqid, '-', last - tile, b FROM s""", f"{W},")
def track_tiles(spark, d):
    """Tiles of 50 values of a track, also read backwards."""
    t = P.track(spark, d)
    first = t.agg(F.min("pos")).first()[0] or 0
    own = stored(tracks.largest(t.withColumn("pos", F.col("pos") - first), ["seqid", "pos"], "val"))
    lengths = own.groupBy("seqid").agg((F.max("pos") + 1).alias("length"))
    tiles = stored(tracks.track_tiles(own, lengths, ["seqid"], ["val"], 50, [tracks.FLOOR]))
    last = tiles.agg(F.max("tile")).first()[0] or 0
    total = F.aggregate(F.transform("val", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return tracks.both_strands(tiles, [], last).select("seqid", "strand", "tile", F.round(total, 4).alias("checksum"))


@query("near_sqrt_divisor", """dv AS (SELECT n, unnest(list_filter(generate_series(1, n), lambda d: n % d = 0)) AS d FROM (SELECT DISTINCT p_partkey AS n FROM part WHERE p_partkey > 0))
SELECT n, arg_min(d, abs(d - sqrt(n)) * 1000000 + d) AS divisor, CASE WHEN n >= 150 THEN 150 ELSE greatest(36, CAST(ceil(n / 36.0) AS BIGINT) * 36) END AS chunk FROM dv GROUP BY n""", " ")
def near_sqrt_divisor(spark, d):
    """Of each part's number the divisor nearest to its root, and the adapted chunk size."""
    rows = P.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("n")).where("n > 0").distinct()
    return rows.select("n", genome.nearest_divisor(F.col("n")).cast("long").alias("divisor"), genome.adapted_chunks(F.col("n"), 150, 4).cast("long").alias("chunk"))


from locusframe.plans import file_queries, gene_queries  # noqa: E402, F401 - they register their queries
