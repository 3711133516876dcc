"""The genome operators on hand-made fixtures and random intervals."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.functions import genome, tracks
from locusframe.functions import sequence as S
from locusframe.functions.attributes import format_gff, format_gtf, format_ordered, parse, parse_pairs
from locusframe.operators import decoding, evaluation, evidence, intervals, labels, merging, models
from locusframe.operators import transcripts as T
from locusframe.sources import cards
from locusframe.sources import text as io
from locusframe.streaming.files import arriving

FEATURE = "seqid string, strand string, gene_id string, tx_id string, type string, start long, stop long, line_no long"


def feats(spark, rows, strand="+", seqid="chr1"):
    """(tx, start, stop) or (tx, start, stop, strand) rows."""
    full = [(seqid, r[3] if len(r) > 3 else strand, "g", r[0], "CDS", r[1], r[2], i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, FEATURE)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_loci_split_where_intervals_merge(spark):
    rows = feats(spark, [("a", 1, 10), ("b", 10, 20), ("c", 21, 30)])
    assert got(merging.with_locus(T.assembled(rows)), "tx_id", "locus") == [("a", 1), ("b", 1), ("c", 2)]
    adjacent = feats(spark, [("a", 1, 10), ("b", 11, 20), ("c", 22, 30)])
    assert got(intervals.merged(adjacent, ["seqid"]), "start", "stop") == [(1, 20), (22, 30)]


@pytest.mark.parametrize("width", [7, 64, 10_000])
def test_binned_operators_agree_with_brute_force(spark, width):
    rng = np.random.default_rng(width)
    make = lambda n: [(str(i), int(s), int(s + rng.integers(0, 40))) for i, s in enumerate(rng.integers(1, 900, n))]
    a, b = make(80), make(60)
    fa, fb = feats(spark, a), feats(spark, b)
    pairs = intervals.overlaps(fa.select("seqid", "tx_id", "start", "stop"), fb.select("seqid", F.col("tx_id").alias("b"), "start", "stop"), ["seqid"], width)
    want = sorted(((x[0], y[0]) for x in a for y in b if x[1] <= y[2] and y[1] <= x[2]), key=str)
    assert got(pairs, "tx_id", "b") == want
    free = intervals.without_overlap(fa, fb, ["seqid"], ["tx_id"], width)
    assert got(free, "tx_id") == sorted({(x[0],) for x in a} - {(p[0],) for p in want})
    on = {p for y in b for p in range(y[1], y[2] + 1)}
    cover = intervals.coverage(fa, fb, ["seqid"], "tx_id", width)
    assert got(cover, "tx_id", "covered") == sorted(((x[0], len(on & set(range(x[1], x[2] + 1)))) for x in a), key=str)
    islands = intervals.merged(fb, ["seqid"], 1, width).collect()
    assert {p for r in islands for p in range(r["start"], r["stop"] + 1)} == on
    assert all(y["start"] > x["stop"] + 1 for x, y in zip(sorted(islands), sorted(islands)[1:], strict=False) for x, y in [sorted([x, y], key=lambda r: r["start"])])


def test_tiles_and_windows(spark):
    rows = feats(spark, [("a", 95, 205)])
    assert got(intervals.on_tiles(rows, 100), "tile", "start", "stop") == [(0, 95, 100), (1, 101, 200), (2, 201, 205)]
    brute = sorted((w,) for w in range(20) if w * 40 + 1 <= 205 and w * 40 + 100 >= 95)
    assert got(intervals.on_windows(rows, 100, 40), "window") == sorted(brute, key=str)


def test_structures_and_priority(spark):
    schema = "seqid string, strand string, tx_id string, start long, stop long, line_no long, utr_bp long, parts array<struct<start:long,stop:long>>"
    tx = lambda name, s, e, n, utr=0, strand="+": ("c", strand, name, s, e, n, utr, [(s, e)])
    table = spark.createDataFrame([tx("a", 1, 9, 0), tx("b", 1, 9, 1, 5), tx("c", 1, 8, 2, 5), tx("d", 1, 8, 3, 5)], schema)
    assert got(merging.distinct_structures(table, ["seqid"]), "tx_id") == [("b",), ("c",)]
    rest = spark.createDataFrame([tx("x", 200, 250, 0), tx("y", 201, 250, 1), tx("z", 100, 200, 2, 0, "-")], schema)
    merged = merging.merge_by_priority(spark.createDataFrame([tx("p", 100, 200, 0)], schema), rest)
    assert got(merged, "tx_id") == [("p",), ("y",), ("z",)]


def test_phases_introns_and_kinds(spark):
    rows = feats(spark, [("a", 1, 4), ("a", 11, 15), ("a", 21, 26), ("m", 1, 4, "-"), ("m", 11, 15, "-")])
    assert got(T.with_phase(rows), "tx_id", "start", "phase") == [("a", 1, 0), ("a", 11, 2), ("a", 21, 0), ("m", 1, 1), ("m", 11, 0)]
    assert got(T.introns(rows), "tx_id", "start", "stop") == [("a", 16, 20), ("a", 5, 10), ("m", 5, 10)]
    assert got(T.with_kind(rows), "tx_id", "start", "kind") == [
        ("a", 1, "initial"), ("a", 11, "internal"), ("a", 21, "terminal"), ("m", 1, "terminal"), ("m", 11, "initial")
    ]
    assert got(T.glued(feats(spark, [("a", 1, 3), ("a", 4, 6), ("a", 8, 9)])), "start", "stop") == [(1, 6), (8, 9)]


def test_isoforms_take_the_first_of_equals(spark):
    rows = feats(spark, [("b", 1, 9), ("a", 11, 19), ("c", 1, 5)])
    assert got(T.longest_isoform(rows), "tx_id") == [("b",)]


def test_stop_codons_extend_the_outer_exon(spark):
    cds = feats(spark, [("p", 1, 9), ("m", 10, 18, "-")])
    stops = feats(spark, [("p", 10, 12), ("m", 7, 9, "-")])
    assert got(T.with_stop_codon(cds, stops), "tx_id", "start", "stop") == [("m", 7, 18), ("p", 1, 12)]


def test_stop_check(spark):
    rows = spark.createDataFrame([("ATGTAA",), ("ATGTAGTAA",), ("ATGTA",), ("ATGAAA",), ("",)], "s string")
    out = [tuple(r["x"]) for r in rows.select(S.stop_check(F.col("s")).alias("x")).collect()]
    assert out == [
        (6, True, "TAA", True, 0, 0), (9, True, "TAA", True, 1, 4), (5, False, "GTA", False, 0, 0), (6, True, "AAA", False, 0, 0), (0, False, "NA", False, 0, 0)
    ]


def test_splicing_and_the_stop_report(spark):
    genome_rows = spark.createDataFrame([("chr1", "ccATGTAGcccTAAccTTATTTCATcc" * 3)], "seq_name string, sequence string")
    whole = "ccATGTAGcccTAAccTTATTTCATcc" * 3
    rows = feats(spark, [("a", 3, 8), ("a", 12, 14), ("m", 17, 25, "-"), ("far", 80, 99)]).unionByName(feats(spark, [("gone", 1, 9)], seqid="chr9"))
    for size in (4, 7, 4096):  # parts that cross tiles
        out = {r["tx_id"]: r["sequence"] for r in genome.spliced(rows, genome_rows, size).collect()}
        assert out == {"a": "ATGTAGTAA", "m": "ATGAAATAA", "far": whole[79:99], "gone": None}
    report = {r["tx_id"]: tuple(r)[3:] for r in genome.stop_report(rows, genome_rows).collect()}
    assert report["a"] == (9, True, "TAA", True, 1, 4, "TAG") and report["m"] == (9, True, "TAA", True, 0, 0, "NA") and report["gone"] == (0, False, "NA", False, 0, 0, "NA")
    assert got(genome.passing(genome.stop_report(rows, genome_rows)), "tx_id") == [("m",)]
    assert got(genome.proteins(rows, genome_rows).where("tx_id in ('a', 'm')"), "tx_id", "sequence") == [("a", "M**"), ("m", "MK*")]


def test_sequence_functions(spark):
    row = spark.createDataFrame([("AaCxTNB", "ATGgcNtaa")], "a string, b string")
    bases = row.select(F.inline(S.base_rows(F.col("a")))).select(S.one_hot(F.col("base"), F.col("softmask")).alias("x")).collect()
    assert ["".join(map(str, r["x"])) for r in bases] == ["100000", "100001", "010000", "000010", "000100", "000010", "000010"]
    assert row.select(S.revcomp(F.lit("ACgtN")), S.translate_cds(F.col("b"))).first() == ("NacGT", "MX*")
    splice = [("GT", "AG"), ("CT", "AC"), ("AA", "AA")]
    assert [r[0] for r in spark.createDataFrame(splice, "a string, b string").select(S.splice_strand(F.col("a"), F.col("b"))).collect()] == ["+", "-", None]


def test_tiles_of_sequences(spark):
    seqs = spark.createDataFrame([("s", 0, "ACGTACGTA")], "seq_name string, seq_ord long, sequence string")
    assert genome.chunks(seqs, 4, pad=False).where("strand = '+'").count() == 2
    padded = genome.chunks(seqs, 4).where("strand = '+'")
    assert got(padded, "chunk", "start", "sequence") == [(0, 1, "ACGT"), (1, 5, "ACGT"), (2, 9, "ANNN")]
    assert got(genome.chunks(seqs, 4).where("strand = '-'"), "chunk", "sequence") == [(0, "NNNT"), (1, "ACGT"), (2, "ACGT")]


def test_greedy_groups(spark):
    seqs = spark.createDataFrame([(f"s{i}", i, "A" * n) for i, n in enumerate((5, 3, 9, 2, 8))], "seq_name string, seq_ord long, sequence string")
    assert got(genome.greedy_groups(seqs, 10, 10), "seq_name", "group") == [("s0", 0), ("s1", 0), ("s2", 0), ("s3", 1), ("s4", 1)]
    assert {r["group"] for r in genome.greedy_groups(seqs, 10, 1).collect()} == {0}
    assert genome.near_sqrt_divisor(36) == 6 and genome.near_sqrt_divisor(20) in (4, 5) and genome.adapted_chunk(3, 10, 2) == 18


def test_greedy_groups_gather_no_rows(spark):
    sizes = [(i * 37) % 11 for i in range(500)]
    seqs = spark.createDataFrame([(f"s{i}", i, "A" * n) for i, n in enumerate(sizes)], "seq_name string, seq_ord long, sequence string")
    for least, most in ((25, 1000), (25, 7), (1, 9), (sum(sizes), 5), (sum(sizes) - 1, 5)):
        total, group, want = 0, 0, {}
        for i, n in enumerate(sizes):
            want[f"s{i}"] = min(group, most - 1) if sum(sizes) > least else 0
            total += n
            if total >= least:
                total, group = 0, group + 1
        out = genome.greedy_groups(seqs, least, most)
        assert {r["seq_name"]: r["group"] for r in out.collect()} == want
        assert "collect_list" not in out._jdf.queryExecution().toString()


def test_lift_to_the_genome(spark):
    exons = feats(spark, [("a", 11, 20), ("a", 31, 40), ("m", 11, 20, "-"), ("m", 31, 40, "-")])
    parts = spark.createDataFrame([("a", 8, 13), ("m", 8, 13)], "tx_id string, start long, stop long")
    assert got(genome.lifted(parts, exons), "tx_id", "start", "stop") == [("a", 18, 20), ("a", 31, 33), ("m", 18, 20), ("m", 31, 33)]


def test_golden_labels(spark):
    plus = labels.all_labels(feats(spark, [("a", 4, 11), ("a", 16, 22)])).toPandas().set_index("pos")["label"]
    assert [int(plus.get(p, 0)) for p in range(1, 24)] == [0, 0, 0, 7, 5, 6, 4, 5, 6, 4, 8, 1, 1, 1, 1, 11, 4, 5, 6, 4, 5, 14, 0]
    minus = labels.label_tiles(feats(spark, [("a", 4, 11), ("a", 16, 22)], "-"), 23).first()["labels"]
    assert minus == [0, 7, 5, 6, 4, 5, 6, 10, 3, 3, 3, 3, 13, 6, 4, 5, 6, 4, 5, 14, 0, 0, 0]
    assert [labels.classes_of(5)[i] for i in (4, 7, 10, 12, 5, 8, 13, 6, 9, 11, 14)] == [2] * 4 + [3] * 3 + [4] * 4
    row = spark.range(7).select(labels.reduced_older(F.col("id").cast("int"), 7, 5).alias("a"), labels.reduced_older(F.col("id").cast("int"), 7, 3).alias("b")).collect()
    assert [tuple(r) for r in row] == [(0, 0), (1, 1), (1, 1), (1, 1), (2, 2), (3, 2), (4, 2)]
    hot = spark.createDataFrame([([0, 14],)], "x array<int>").select(labels.one_hot(F.col("x")).alias("h")).first()["h"]
    assert [h.index(1) for h in hot] == [0, 14] and all(sum(h) == 1 for h in hot)


@pytest.mark.parametrize("size", [10, 37])
def test_label_tiles_are_the_labels_of_bases(spark, size):
    rng = np.random.default_rng(size)
    rows = [(f"t{k}", int(s), int(s + w), "+-"[k % 2]) for k in range(12) for s, w in zip(np.cumsum(rng.integers(30, 60, 3)) + 20 * k, rng.integers(0, 25, 3), strict=True)]
    cds = feats(spark, rows)
    want = {}
    for r in labels.all_labels(cds).collect():
        key = (r["strand"], r["pos"])
        want[key] = max(want.get(key, ("", 0)), (r["tx_id"], r["label"]))
    found = {}
    for r in labels.label_tiles(cds, size).collect():
        for i, x in enumerate(r["labels"] if r["strand"] == "+" else r["labels"][::-1]):
            if x:
                found[r["strand"], r["chunk"] * size + i + 1] = x
    assert found == {k: v[1] for k, v in want.items()}


@pytest.mark.parametrize("width", [8, 1 << 14])
def test_reading_frames_are_brute_force(spark, width):
    rng = np.random.default_rng(width)
    starts, stops = (sorted(set(rng.integers(0, 300, n).tolist())) for n in (60, 30))
    table = lambda x: spark.createDataFrame([("c", v) for v in x], "seqid string, pos long")
    want = sorted((a, min(z for z in stops if z > a + 3)) for a in starts if any(z > a + 3 for z in stops))
    assert sorted((r["start"], r["stop"]) for r in labels.reading_frames(table(starts), table(stops), ["seqid"], width).collect()) == want


def test_subtracted_is_brute_force(spark):
    rng = np.random.default_rng(1)
    make = lambda n: [(str(i), int(s), int(s + rng.integers(0, 30))) for i, s in enumerate(rng.integers(1, 400, n))]
    a, b = make(25), make(15)
    on = lambda x: {p for r in x for p in range(r[1], r[2] + 1)}
    for width in (16, 1 << 14):
        out = intervals.subtracted(feats(spark, a), feats(spark, b), ["seqid"], width).collect()
        assert {p for r in out for p in range(r["start"], r["stop"] + 1)} == on(a) - on(b)
        assert sum(r["stop"] - r["start"] + 1 for r in out) == len(on(a) - on(b))


def test_mask(spark):
    at = lambda s, e: spark.createDataFrame([("c", s, e)], "seqid string, start long, stop long")
    assert got(labels.masked(at(1300, 1400), at(1000, 1100), ["seqid"], 500), "start", "stop") == [(1000, 1100), (750, 800)]


def test_hits_and_classes(spark):
    schema = "query string, subject string, pident double, alen double, qlen double, slen double, evalue double, bits double, qstart long, tstart long"
    hit = lambda q, s, **k: tuple((dict(query=q, subject=s, pident=30.0, alen=5.0, qlen=10.0, slen=10.0, evalue=1e-5, bits=9.0, qstart=1, tstart=1) | k).values())
    table = spark.createDataFrame([hit("a", "x_1"), hit("a", "y_1"), hit("b", "y_2", bits=20.0), hit("c", "z_1", evalue=1e-4), hit("d", "z_2", qlen=0.0)], schema)
    ranks = evidence.ranked_species(table, 1e-5, 30.0, 0.5, 1).orderBy("place")
    assert got(ranks, "species", "votes", "mark") == [("x", 1, ""), ("y", 1, "TOP")]
    normal = spark.createDataFrame([hit("q", f"s_{i:02}", bits=100.0 - i, qstart=1 if i != 25 else 0) for i in range(26)], schema)
    assert got(evidence.cds_classes(normal, normal, 25), "query", "class") == [("q", "complete")]
    assert got(evidence.cds_classes(normal, normal, 26), "query", "class") == [("q", "incomplete")]


def test_peptides(spark):
    rows = [("p", "p type:5prime_partial len:5 :10-27(+)", "AAMKK*"), ("m", "m type:internal :10-27(-)", "AAMKK*"), ("c", "c type:complete :1-3(+)", "MA"), ("n", "n type:internal :1-9(+)", "AAA")]
    pep = spark.createDataFrame(rows, "id string, header string, sequence string")
    short = evidence.shortened(pep)
    assert got(short, "header", "sequence") == [("m type:internal :10-21(-) len:3", "MKK*"), ("p type:5prime_partial len:3 :16-27(+)", "MKK*")]
    classes = spark.createDataFrame([("p", "complete"), ("m", "incomplete"), ("n", "complete")], "query string, class string")
    assert got(evidence.revised(pep, classes, short), "id", "sequence") == [("c", "MA"), ("m", "AAMKK*"), ("n", "AAA"), ("p", "MKK*")]
    assert "type:complete" in evidence.revised(pep, classes, short).where("id = 'p'").first()["header"]


def test_hints(spark):
    cds = feats(spark, [("a", 100, 200), ("b", 100, 110)])
    assert got(evidence.cds_part_hints(cds), "start", "stop") == [(105, 105), (115, 185)]


def test_scores(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert tuple(evaluation.set_scores(a, b).first()) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert evaluation.set_scores(a.limit(0), b).first()["f1"] == 0


def test_attributes(spark):
    lines = ['gene_id "g 1"; transcript_id "t;1"'.replace(";1", "1"), "ID=x;Parent=y;a=1;a=2", ' note "n" ; k=v;', ""]
    out = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "s string").select(parse(F.col("s"))).collect()]
    assert out == [{"gene_id": "g 1", "transcript_id": "t1"}, {"ID": "x", "Parent": "y", "a": "2"}, {"note": "n", "k": "v"}, {}]
    m = F.create_map(*map(F.lit, ("b", "2", "Parent", "p", "ID", "i")))
    g = F.create_map(*map(F.lit, ("b", "2", "transcript_id", "t", "gene_id", "g")))
    assert tuple(spark.range(1).select(format_gff(m), format_gtf(g)).first()) == ("ID=i;Parent=p;b=2", 'gene_id "g"; transcript_id "t"; b "2";')


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first\r\nACGT\r\nAC\r\n>s2\n\n>s3\nNN\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as out:
        out.write(">z\nAC\nGT")
    assert got(io.read_fasta(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fa.gz")]), "seq_name", "sequence") == [("s1", "ACGTAC"), ("s2", ""), ("s3", "NN"), ("z", "ACGT")]
    io.write_fasta(io.read_fasta(spark, str(tmp_path / "a.fa")), str(tmp_path / "out_fa"), width=4)
    assert got(io.read_fasta(spark, str(tmp_path / "out_fa")), "seq_name", "sequence") == [("s1", "ACGTAC"), ("s2", ""), ("s3", "NN")]
    (tmp_path / "a.gff").write_text("##gff\nc\ts\tCDS\t1\t9\t.\t+\t0\tID=x;Parent=t1,t2\nbad line\nc\ts\texon\t5\t9\t.\t+\t.\tgene_id \"g\"; transcript_id \"t\";\n")
    gff = io.read_gff(spark, str(tmp_path / "a.gff"))
    assert got(gff, "type", "start", "tx_id", "gene_id") == [("CDS", 1, "t1", None), ("exon", 5, "t", "g")]
    io.write_gff(gff, str(tmp_path / "out_gff"))
    assert got(io.read_gff(spark, str(tmp_path / "out_gff")), "type", "start", "stop", "tx_id") == [("CDS", 1, 9, "t1"), ("exon", 5, 9, "t")]
    (tmp_path / "a.wig").write_text("track x\nfixedStep chrom=c start=5 step=1\n1.5\n2\nfixedStep chrom=d start=2 step=3\n7\n8\n")
    wig = io.read_wig(spark, str(tmp_path / "a.wig"))
    assert got(wig, "seqid", "pos", "value") == [("c", 5, 1.5), ("c", 6, 2.0), ("d", 2, 7.0), ("d", 5, 8.0)]
    (tmp_path / "h.tsv").write_text("q\ts x\t99\t5\t0\t0\t1\t5\t1\tbad\t1e-9\t50\n")
    assert got(io.read_hits(spark, str(tmp_path / "h.tsv")), "subject", "tend", "bits") == [("s", None, 50.0)]
    (tmp_path / "l.txt").write_text("one\n\n# no\n two\n")
    assert got(io.read_lines(spark, str(tmp_path / "l.txt")), "name") == [("one",), ("two",)]


def test_viterbi_is_the_best_path(spark):
    rng = np.random.default_rng(9)
    scores, moves, start = rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    value = lambda p: start[p[0]] + sum(scores[t, s] for t, s in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:], strict=False))
    assert tuple(decoding.viterbi(scores, moves, start)) == max(np.ndindex(*[3] * 6), key=value)
    chunks = spark.createDataFrame([("a", "AAATTT"), ("b", "")], "chunk string, sequence string")
    score = lambda many: np.array([[[0.0, -3.0] if c == "A" else [-3.0, 0.0] for c in s] for s in many])
    out = decoding.decoded(chunks, score, np.log([[0.9, 0.1], [0.1, 0.9]]), np.log([0.5, 0.5]))
    assert got(out, "chunk", "labels") == [("a", [0, 0, 0, 1, 1, 1]), ("b", [])]
    runs = decoding.label_runs(out.select("chunk", F.posexplode("labels").alias("pos", "label")), ["chunk"])
    assert got(runs, "label", "start", "stop") == [(0, 0, 2), (1, 3, 5)]
    genome_rows = spark.createDataFrame([("s", "AAAATTTTTTAAATAAAATT")], "seq_name string, sequence string")
    even = np.log(np.full((2, 2), 0.5))
    both = decoding.genome_runs(genome_rows, 6, 2, score, even, even[0])
    plus = decoding.annotated(both.where("strand = '+'"), [1])
    assert got(plus, "start", "stop") == [(14, 14), (19, 20), (5, 10)]
    assert got(decoding.annotated(both.where("strand = '-'"), [1]), "start", "stop") == [(1, 4), (11, 13), (15, 18)]
    chosen = spark.createDataFrame([("s", 1)], "seq_name string, code int")
    again = both.withColumn("label", F.col("label") + 10)
    mixed = decoding.predicted_again(both, again, chosen, ["seq_name"])
    assert {(r["strand"], r["label"] >= 10) for r in mixed.collect()} == {("+", False), ("-", True)}
    with pytest.raises(Exception, match="features: 4"):
        decoding.checked_features(spark.createDataFrame([([[0.0] * 4],)], "x array<array<double>>"), "x").collect()


def test_models_from_files(spark, tmp_path):
    (tmp_path / "a.gtf").write_text(
        "#x\nc\tA\tCDS\t10\t20\t.\t+\t0\tgene_id \"g\"; transcript_id \"t\";\nc\tA\tUTR\t1\t9\t.\t+\t.\tgene_id \"g\"; transcript_id \"t\";\n"
        "d\tA\tCDS\t10\t20\t.\t+\t0\tgene_id \"g\"; transcript_id \"t\";\n"
    )
    (tmp_path / "b.gff").write_text("c\tB\texon\t10\t20\t.\t+\t.\tParent=u\nc\tB\tCDS\t12\t18\t.\t+\t0\tParent=u\nc\tB\tUTR\t30\t40\t.\t+\t.\tParent=only\n")
    found = models.models_of(io.read_models(spark, [str(tmp_path / "a.gtf"), str(tmp_path / "b.gff")]))
    assert got(found, "tx_id", "start", "stop", "out_start", "utr_bp") == [("0:c:+:t", 10, 20, 1, 9), ("0:d:+:t", 10, 20, 10, 0), ("1:c:+:u", 10, 20, 10, 0)]
    rows = models.cluster_rows(merging.merge_all(found))
    io.write_gff(rows, str(tmp_path / "out"), ["gene", "nth", "rank", "i"])
    lines = [r[0].split("\t") for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [(x[0], x[1], x[2], x[3], x[4], x[8]) for x in lines] == [
        ("c", "A", "gene", "1", "20", "ID=gene_000001"), ("c", "A", "transcript", "1", "20", "ID=gene_000001.t1;Parent=gene_000001"),
        ("c", "A", "exon", "10", "20", "ID=gene_000001.t1.exon1;Parent=gene_000001.t1"), ("c", "A", "UTR", "1", "9", "ID=gene_000001.t1.utr1;Parent=gene_000001.t1"),
        ("c", "A", "CDS", "10", "20", "ID=gene_000001.t1.cds1;Parent=gene_000001.t1"), ("d", "A", "gene", "10", "20", "ID=gene_000002"),
        ("d", "A", "transcript", "10", "20", "ID=gene_000002.t1;Parent=gene_000002"), ("d", "A", "exon", "10", "20", "ID=gene_000002.t1.exon1;Parent=gene_000002.t1"),
        ("d", "A", "CDS", "10", "20", "ID=gene_000002.t1.cds1;Parent=gene_000002.t1"),
    ]


def test_exons_are_rebuilt_from_parts(spark):
    part = lambda n, s, e: ("c", "+", n, "x", "CDS", s, e, "0")
    schema = "seqid string, strand string, tx_id string, source string, type string, start long, stop long, phase string"
    cds = spark.createDataFrame([part("t", 10, 20), part("o", 100, 110)], schema)
    utr = spark.createDataFrame([("c", "+", "t", "x", "UTR", s, e, ".") for s, e in ((21, 30), (40, 50))] + [("c", "+", "none", "x", "UTR", 1, 2, ".")], schema)
    parents = spark.createDataFrame([("t", "g"), ("o", "lost")], "tx_id string, gene_id string")
    rows = models.rebuilt_rows(cds, utr, parents, spark.createDataFrame([("g",)], "gene_id string"))
    assert got(rows.where("type = 'exon'"), "tx_id", "start", "stop") == [("o", 100, 110), ("t", 10, 30), ("t", 40, 50)]
    assert got(rows.where("type = 'gene'"), "attrs", "source", "start", "stop") == [("ID=g", "x", 10, 50), ("ID=o.gene", "rebuild", 100, 110)]


def test_lines_are_numbered_across_parts(spark, tmp_path):
    (tmp_path / "long.txt").write_text("".join(f"line {i}\r\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = io.numbered_lines(spark, str(tmp_path / "long.txt"))
        assert lines.rdd.getNumPartitions() > 3
        assert got(lines, "line_no", "line") == sorted(((i, f"line {i}") for i in range(5000)), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_short_hits_skip_what_the_format_skips(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("# q\nq\ts_1\t50\t10\t1e-9\t99\t20\t30\textra\n\nq\tshort\t1\nq\ts_2\t50\t10\t1e-9\t99\t20\t30\nq\ts_3\tx\t10\t1e-9\t99\t20\t30\n")
    hits = io.read_short_hits(spark, str(tmp_path / "h.tsv"))
    assert got(hits, "line_no", "subject") == [(1, "s_1"), (4, "s_2")]
    assert got(evidence.best_hits(hits), "query", "subject") == [("q", "s_1")]


def test_supported_queries_look_up_lengths_and_orfs(spark):
    schema = "query string, subject string, pident double, alen double, qlen double, slen double, evalue double, bits double, qstart long, tstart long"
    row = lambda q, s: (q, s, 90.0, 9.0, 10.0, 0.0, 1e-9, 50.0, 1, 1)
    hits = spark.createDataFrame([row("a", "x"), row("b", "x"), row("c", "y")], schema)
    lengths = spark.createDataFrame([("x", 10.0)], "subject string, slen double")
    orfs = spark.createDataFrame([("a", "a type:complete"), ("b", "b type:internal"), ("c", "c type:complete")], "query string, header string")
    assert got(evidence.supported_queries(hits, 1e-5, 30.0, 0.5, 0.5, orfs, lengths), "query") == [("a",)]


def test_codon_rows_and_coordinates(spark):
    rows = feats(spark, [("a", 1, 9), ("a", 21, 29), ("m", 1, 9, "-")])
    assert got(T.codon_rows(rows), "tx_id", "type", "start", "stop") == [
        ("a", "start_codon", 1, 3), ("a", "stop_codon", 27, 29), ("m", "start_codon", 7, 9), ("m", "stop_codon", 1, 3)
    ]
    mixed = rows.withColumn("type", F.when(F.col("tx_id") == "m", "exon").otherwise("CDS")).withColumn("phase", F.lit(0))
    assert {r["tx_id"]: [(p["start"], p["stop"]) for p in r["parts"]] for r in T.coordinates(mixed).collect()} == {"a": [(1, 9), (21, 29)], "m": [(1, 9)]}
    named = spark.createDataFrame([("a", "new")], "tx_id string, new_gene string")
    own = T.assembled(rows).withColumn("gene_id", F.lit(None).cast("string"))
    assert got(T.with_gene(own, named), "tx_id", "gene_id") == [("a", "new"), ("m", "m_g")]


def test_tracks(spark):
    values = spark.createDataFrame([("s", 0, 1.0, -9.0), ("s", 3, 2.0, 0.5)], "seqid string, pos long, a double, b double")
    lengths = spark.createDataFrame([("s", 5), ("tiny", 1)], "seqid string, length long")
    tiles = tracks.track_tiles(values, lengths, ["seqid"], ["a", "b"], 2, [0.0, -1.0])
    assert got(tiles, "tile", "a", "b") == [(0, [1.0, 0.0], [-9.0, -1.0]), (1, [0.0, 2.0], [-1.0, 0.5])]
    minus = tracks.both_strands(tiles, [("a", "b")], 1).where("strand = '-'")
    assert got(minus, "tile", "a", "b") == [(0, [0.5, -1.0], [2.0, 0.0]), (1, [-1.0, -9.0], [0.0, 1.0])]


def test_small_settings(spark, tmp_path):
    (tmp_path / "one.yaml").write_text("# c\nweights_url: 'http://h//a'\nsoftmasking: true # yes\nclamsa:\n")
    (tmp_path / "two.yaml").write_text("# nothing\n")
    read = cards.read_cards(spark, [str(tmp_path / "one.yaml"), str(tmp_path / "two.yaml")])
    assert sorted(r[0] for r in read.select(F.array_join(cards.missing_keys(F.col("card")), ",")).collect()) == ["clamsa", "weights_url,softmasking,clamsa"]
    assert got(cards.distinct_urls(read), "url") == [("http://h/a",)]
    tags = spark.createDataFrame([("v1.9.0",), ("1.10.0",), ("latest",)], "tag string")
    assert tags.agg(F.max_by("tag", cards.version_of(F.col("tag")))).first()[0] == "1.10.0"
    names = spark.createDataFrame([("epoch_10",), ("epoch_9",), ("other",)], "name string")
    assert [r["name"] for r in cards.numbered(names, "name").orderBy("n").collect()] == ["epoch_9", "epoch_10"]
    genome.divides(18)
    with pytest.raises(ValueError, match="must divide"):
        genome.divides(20)
    logs = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (-1.0,)], "x double").select(genome.clipped_log(F.col("x"))).collect()
    assert [r[0] for r in logs] == [-30.0, 0.0, 0.0, -30.0]
    report = spark.createDataFrame([("12 + 0 mapped (93.50% : N/A)",), ("x",)], "v string").select(evidence.mapped_percent(F.col("v"))).collect()
    assert [r[0] for r in report] == [93.5, None]


def test_attributes_in_their_order(spark):
    rows = spark.createDataFrame([('b "2"; a "1"; b "3";',)], "x string").select(parse_pairs(F.col("x")).alias("p"))
    assert tuple(rows.select(format_ordered(F.col("p")), format_ordered(F.col("p"), gtf=True)).first()) == ("b=2;a=1;b=3", 'b "2"; a "1"; b "3";')


def test_interval_plans_read_their_input_once(spark):
    """What is read more than once is stored; else each nesting would double the reads."""
    seen = F.udf(lambda x: x, "long")
    for build in (merging.merge_all, merging.with_locus):
        table = T.assembled(feats(spark, [("a", 1, 10), ("b", 5, 20)])).withColumns({"utr_bp": F.lit(0), "start": seen("start")})
        plan = build(table)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and plan.count("Scan parquet") <= 4


def test_stream_equals_batch(spark, tmp_path):
    rows = feats(spark, [("a", 100, 200), ("b", 100, 110)])
    rows.write.parquet(str(tmp_path / "in"))
    arriving(spark, str(tmp_path / "in"), FEATURE, evidence.cds_part_hints, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert got(spark.read.parquet(str(tmp_path / "out")), "start", "stop") == got(evidence.cds_part_hints(rows), "start", "stop")


def test_sniffed_needs_a_plus_for_fastq(spark):
    rows = spark.createDataFrame([(1, ">a", "x"), (2, " @a", "+"), (3, "@a", "x"), (4, None, None)], "i int, a string, c string")
    got = {r["i"]: r["f"] for r in rows.select("i", io.sniffed("a", "c").alias("f")).collect()}
    assert got == {1: "fasta", 2: "fastq", 3: "unknown", 4: "unknown"}


def test_top_hits_keeps_ties_in_order_of_subject(spark):
    rows = spark.createDataFrame(
        [("q", s, b, 1, 10.0, 10.0) for s, b in [("b", 5.0), ("a", 5.0), ("c", 1.0)]], "query string, subject string, bits double, qstart int, alen double, qlen double"
    )
    assert [(r["subject"], r["place"]) for r in evidence.top_hits(rows, 2).orderBy("place").collect()] == [("a", 1), ("b", 2)]
