"""What goes through shuffles and into tasks stays small against the input."""

import contextlib
import io

from locusframe.functions import genome


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue()


def test_spliced_shuffles_pieces_and_no_tiles(spark):
    dna = spark.createDataFrame([("s", "ACGTACGTAC"), ("e", "")], "seq_name string, sequence string")
    cds = spark.createDataFrame([("s", "+", "a", 2, 4), ("s", "+", "a", 8, 99), ("s", "-", "b", 3, 6), ("x", "+", "c", 1, 3)], "seqid string, strand string, tx_id string, start long, stop long")
    rows = genome.spliced(cds, dna, 4)
    assert sorted(map(tuple, rows.select("tx_id", "sequence").collect()), key=str) == [("a", "CGTTAC"), ("b", "GTAC"), ("c", None)]
    assert "max(tile_sequence" not in plan(rows)


def test_tiles_hold_no_whole_sequence(spark):
    from pyspark.sql import functions as F

    dna = spark.range(3).select(F.col("id").cast("string").alias("seq_name"), F.repeat(F.lit("ACG"), F.col("id").cast("int") * 5).alias("sequence"))
    rows = genome.chunks(dna, 4, 1)
    generate = next(x for x in plan(rows).split("== Physical Plan ==")[1].splitlines() if "Generate posexplode" in x)
    assert "sequence" not in generate.split("posexplode(", 1)[1].split(")", 1)[1].split("], ")[0]
    assert rows.where("seq_name = '2'").count() == 20


def test_runs_inside_tiles_are_not_merged_again(spark, monkeypatch):
    import numpy as np

    from locusframe.operators import decoding

    seen = []
    real = decoding.merged

    def counted(df, keys, *more):
        seen.append(df.count())
        return real(df, keys, *more)

    monkeypatch.setattr(decoding, "merged", counted)
    letters = "GGATTTGCGCAAAGATTACCCCCCCCCCCCCCCCCCCCCCCCATAT" * 3

    def score(sequences):
        strong = np.array([[c in "GC" for c in x] for x in sequences])
        return np.stack([np.where(strong, -3.0, 0.0), np.where(strong, 0.0, -3.0)], axis=2)

    even = np.log(np.full((2, 2), 0.5))
    dna = spark.createDataFrame([("s", letters), ("e", ""), ("z", None)], "seq_name string, sequence string")
    found = decoding.genome_runs(dna, 10, 4, score, even, even[0])
    strong = [c in "GC" for c in letters]
    begins = [0, *(i for i in range(1, len(letters)) if strong[i] != strong[i - 1]), len(letters)]
    expected = [(int(strong[a]), a + 1, b) for a, b in zip(begins, begins[1:], strict=False)]
    for strand in "+-":
        got = found.where(f"strand = '{strand}' and seq_name = 's'").select("label", "start", "stop").collect()
        assert sorted(map(tuple, got), key=lambda x: x[1]) == expected
    assert decoding.annotated(found, [1]).count() == 2 * sum(x[0] for x in expected)
    assert len(seen) == 1 and seen[0] <= 2 * 2 * -(-len(letters) // 6)


def test_bins_fit_the_lengths_of_rows(spark):
    from locusframe.operators import intervals

    rows = [("c", i * 40, i * 40 + 25, i) for i in range(200)]
    a, b = (spark.createDataFrame(rows, f"k string, start long, stop long, {n} long") for n in "ab")
    width = intervals.fitting_width(a, b)
    assert width == 32
    assert sorted(map(tuple, intervals.overlaps(a, b, ["k"], width).select("a", "b").collect())) == [(i, i) for i in range(200)]
    long = spark.createDataFrame([("c", 1, 1 << 40)], "k string, start long, stop long")
    assert intervals.fitting_width(a, long) == 1 << 40
    assert intervals.fitting_width(a.limit(0)) == 32


def test_set_scores_deal_rows_by_their_number(spark, monkeypatch):
    from locusframe.operators import evaluation

    monkeypatch.setattr(evaluation, "ROWS", 10)
    one, two = (spark.range(*x).selectExpr("cast(id as string) as k", "id % 3 as v") for x in ((0, 60), (20, 90)))
    got = evaluation.set_scores(one.union(one), two)
    assert tuple(got.select("tp", "fp", "fn").first()) == (40, 20, 30)
    assert "REPARTITION_BY_NUM" in plan(got) and plan(got).count("HashAggregate(keys=[k") <= 2


def test_shards_are_found_from_keys_alone(spark, monkeypatch):
    from locusframe.functions import examples

    seen = []
    real = examples.with_shard
    monkeypatch.setattr(examples, "with_shard", lambda rows, *more: seen.append(rows.columns) or real(rows, *more))
    monkeypatch.setattr(examples, "TILES", 5)
    dna = spark.createDataFrame([("a", "ACGT" * 12 + "G"), ("b", "TTTTa"), ("e", "")], "seq_name string, sequence string")
    cds = spark.createDataFrame([("a", "+", "g", "t1", "CDS", 3, 11, 1)], "seqid string, strand string, gene_id string, tx_id string, type string, start long, stop long, line_no long")
    masked = spark.createDataFrame([("a", 0, 3)], "seqid string, start long, stop long")
    track = spark.createDataFrame([("a", 0, 1.5)], "seqid string, pos long, value double")
    rows = examples.examples(dna, cds, masked, track, 20, 0.0, 1, 3)
    assert seen == [examples.KEYS]
    assert rows.rdd.getNumPartitions() == 2 and "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    slim = examples.example_shards(rows.drop("shard"), 3).select(*examples.KEYS, "shard")
    assert sorted(map(tuple, rows.select(*examples.KEYS, "shard").collect())) == sorted(map(tuple, slim.collect()))


def test_channels_are_summed_in_one_pass(spark):
    from locusframe.functions import sequence as S

    rows = spark.createDataFrame([("a", "ACgtNNxé"), ("e", ""), ("z", None)], "seq_name string, sequence string")
    assert {r["seq_name"]: r["sums"] for r in S.channel_sums(rows).collect()} == {"a": [1, 1, 1, 1, 4], "e": [0] * 5, "z": None}


def test_transcripts_meet_tiles_whole(spark, tmp_path):
    dna = spark.createDataFrame([("s", "ACGTTGCATGCCATGA"), ("e", ""), ("z", None)], "seq_name string, sequence string")
    parts = [("s", "+", "a", 1, 2), ("s", "+", "a", 3, 4), ("s", "-", "b", 5, 8), ("s", "+", "c", 2, 9), ("s", "+", "c", 3, 6), ("s", "+", "d", 14, 30), ("s", "-", "f", 40, 41), ("e", "+", "g", 1, 3), ("z", "+", "h", 1, 9)]
    cds = spark.createDataFrame(parts, "seqid string, strand string, tx_id string, start long, stop long")
    rows = genome.spliced(cds, dna, 4)
    # Features of c lie over each other and over tiles: each stands whole, in order of start and stop.
    assert {r["tx_id"]: r["sequence"] for r in rows.collect()} == {"a": "ACGT", "b": "TGCA", "c": "CGTTGCAT" + "GTTG", "d": "TGA", "f": None, "g": None, "h": None}
    # Cut out and joined after the tile was met, without another shuffle: in the plan's first branch no aggregate stands above the join.
    first = plan(rows).split("== Physical Plan ==")[1].split("Union")[1].split("Join")[0]
    assert "Aggregate" not in first


HIT = "query string, subject string, pident double, tstart double, qstart double, bits double"


def classes_by_loops(normal, short, top):
    """What ``cds_classes`` says, from every pair."""
    pairs = {}
    for q, s, ident, at, start, bits in normal:
        for q2, s2, ident2, at2, _, bits2 in short:
            if (q, s) == (q2, s2):
                support = (at2 - at) - (start - 1) + (0.0 if ident == ident2 else float("inf"))
                pairs.setdefault(q, []).append((-max(bits, bits2), s, -support))
    return {q: "incomplete" if any(x[2] < 0 for x in sorted(found)[:top]) else "complete" for q, found in pairs.items()}


def test_copies_of_hits_are_one_pair(spark):
    from locusframe.operators import evidence

    hits = spark.createDataFrame([("q", "s", 50.0, 5.0, 1.0, 9.0)] * 300 + [("q", "s", 50.0, 9.0, 1.0, 8.0)], HIT)
    pairs = evidence.hit_pairs(hits, hits)
    assert sorted((r["best"], r["support"], r["n"]) for r in pairs.collect()) == [(8.0, 0.0, 1), (9.0, -4.0, 300), (9.0, 0.0, 90_000), (9.0, 4.0, 300)]
    # Copies count as pairs: 300 with support first, then those without; the other way round none is reached.
    assert [r["class"] for r in evidence.cds_classes(hits, hits, 25).collect()] == ["incomplete"]
    back = hits.select("query", "subject", "pident", "qstart", "bits", (10 - hits["tstart"]).alias("tstart"))
    same = back.where("bits = 9")
    assert [r["class"] for r in evidence.cds_classes(same, back, 90_000).collect()] == ["complete"]


def test_classes_with_floors_are_those_of_all_pairs(spark, monkeypatch):
    import random

    from locusframe.operators import evidence

    dice = random.Random(4)
    normal, short = [], []
    for q in range(12):
        for i in range(80):
            for _ in range(dice.choice((1, 1, 3))):
                hit = (f"q{q}", f"s{i:02}", 50.0, float(dice.randrange(30)), float(dice.randrange(20, 26)), float(dice.randrange(12 if q % 2 else 400)))
                # Of the first queries the best subjects are only in one search or the other, so their floors don't hold.
                if q < 4 and i < 60:
                    (normal if i % 2 else short).append((*hit[:5], hit[5] + 1000))
                else:
                    normal.append(hit)
                    short.append((*hit[:3], float(dice.randrange(30)), *hit[4:]))
    # A query of few subjects has no floor.
    normal += [("few", "a", 50.0, 1.0, 1.0, 5.0)] * 40
    short += [("few", "a", 50.0, 1.0, 1.0, 5.0), ("few", "a", 50.0, 2.0, 1.0, 4.0)]
    n, s = spark.createDataFrame(normal, HIT), spark.createDataFrame(short, HIT)
    sizes = []
    real = evidence.hit_pairs

    def counted(*sides):
        pairs = real(*sides)
        sizes.append(pairs.count())
        return pairs

    monkeypatch.setattr(evidence, "hit_pairs", counted)
    for top in (4, 5, 9):
        sizes.clear()
        assert {r["query"]: r["class"] for r in evidence.cds_classes(n, s, top).collect()} == classes_by_loops(normal, short, top)
        assert len(sizes) == 2 and sizes[0] < real(n, s).count() / 2
    assert set(classes_by_loops(normal, short, 5).values()) == {"complete", "incomplete"}


def test_lengths_of_records_move_no_letters(spark, tmp_path, monkeypatch):
    from locusframe.sources import parts

    monkeypatch.setattr(parts, "headed_chunks", None)
    monkeypatch.setattr(parts, "stored", lambda df: seen.append(df.columns) or df)
    seen = []
    (tmp_path / "a.fa").write_text("AC\n>a one\nAC GT\r\n\u00a0T\n\n>b\n>c\nAAA\n")
    (tmp_path / "b.fa").write_text("CC\n")
    (tmp_path / "c.fa").write_text("")
    (tmp_path / "d.fa").write_text(">a\nG")
    rows = parts.fasta_lengths(spark, [str(tmp_path / f"{x}.fa") for x in "abcd"])
    assert sorted(map(tuple, rows.collect())) == [("a", "a", 1), ("a", "a one", 5), ("b", "b", 0), ("c", "c", 3)]
    assert seen == [["file", "at", "header", "n"]]


def test_annotations_are_shuffled_as_genes_not_lines(spark, tmp_path):
    from locusframe.operators import models
    from locusframe.sources import text

    made = [
        ("c", "+", "g1", "t1", "CDS", 10, 20, 1), ("c", "+", "g1", "t1", "CDS", 30, 40, 2), ("c", "-", "g1", "t1", "CDS", 50, 60, 3), ("c", "-", "g1", "t1", "UTR", 61, 65, 4),
        ("c", "+", "g2", "t2", "CDS", 5, 9, 5), ("c", "+", "g2", "t2", "exon", 5, 9, 6), ("c", "+", "g3", "t2", "CDS", 15, 19, 7), ("c", "-", "g4", "t3", "CDS", 7, 9, 8),
        ("c", "-", "g4", "t3", "CDS", 1, 4, 9), ("c", "+", None, "t4", "CDS", 1, 4, 10), ("c", "+", "g1", "t1", "gene", 1, 100, 0),
    ]
    features = spark.createDataFrame(made, "seqid string, strand string, gene_id string, tx_id string, type string, start long, stop long, line_no long").repartition(3)
    rows = models.gtf_rows(features, "x")
    cells = {(r["gene_id"], r["tx_id"], r["strand"], r["type"], r["start"], r["stop"], r["attrs"]) for r in rows.collect()}
    cds = lambda g, t, kind: f'transcript_id "x.{t}"; gene_id "{g}"; cds_type={kind};'
    exon = lambda g, t: f'transcript_id "x.{t}"; gene_id "{g}";'
    want = {("g1", None, "+", "gene", 10, 65, "g1"), ("g2", None, "+", "gene", 5, 9, "g2"), ("g3", None, "+", "gene", 15, 19, "g3"), ("g4", None, "-", "gene", 1, 9, "g4"), (None, None, "+", "gene", 1, 4, None)}
    want |= {("g1", "t1", "+", "transcript", 10, 40, "x.t1"), ("g1", "t1", "-", "transcript", 50, 65, "x.t1"), ("g2", "t2", "+", "transcript", 5, 9, "x.t2"), ("g3", "t2", "+", "transcript", 15, 19, "x.t2"), ("g4", "t3", "-", "transcript", 1, 9, "x.t3")}
    for g, t, strand, low, high, kind in (("g1", "t1", "+", 10, 20, "initial"), ("g1", "t1", "+", 30, 40, "terminal"), ("g1", "t1", "-", 50, 60, "single"), ("g4", "t3", "-", 7, 9, "initial"), ("g4", "t3", "-", 1, 4, "terminal")):
        want |= {(g, t, strand, "CDS", low, high, cds(g, t, kind)), (g, t, strand, "exon", low, high, exon(g, t))}
    # The transcript of two genes has an exon in one of them, so its coding parts are no exons.
    want |= {("g1", "t1", "-", "UTR", 61, 65, exon("g1", "t1")), ("g2", "t2", "+", "CDS", 5, 9, cds("g2", "t2", "initial")), ("g2", "t2", "+", "exon", 5, 9, exon("g2", "t2")), ("g3", "t2", "+", "CDS", 15, 19, cds("g3", "t2", "terminal"))}
    assert cells == want
    assert plan(models.gtf_rows(features, "x")).count("hashpartitioning") == 2

    genes, order = models.gtf_genes(features), ["seqid", "gene_start", "gene_stop", "gene_id"]
    text.write_groups(genes, str(tmp_path / "groups"), order, models.gtf_lines(genes, "x"), "gzip")
    text.write_gtf(rows, str(tmp_path / "lines"), [*order, "tx_id", "rank", "start", "stop", "type"])
    assert all(p.name.endswith(".gz") for p in (tmp_path / "groups").glob("part-*"))
    lines = lambda x: [r["value"] for p in sorted((tmp_path / x).glob("part-*")) for r in spark.read.text(str(p)).collect()]
    assert lines("groups") == lines("lines") and len(lines("lines")) == len(want)


def test_files_between_steps_are_compressed(spark, tmp_path, monkeypatch):
    from locusframe.plans import file_queries

    made = []
    monkeypatch.setattr(file_queries, "fresh_path", lambda spark: made.append(str(tmp_path / f"f{len(made)}")) or made[-1])
    assert file_queries.gtf_to_gff3(spark, "/root/testdata/sf0.001").count() > 10_000
    names = [p.name for path in made for p in (tmp_path / path).glob("part-*")]
    assert len(made) == 2 and names and all(n.endswith(".txt.gz") for n in names)


def test_patterns_run_only_where_their_key_is(spark):
    from pyspark.sql import functions as F

    from locusframe.functions.attributes import value_of

    rows = spark.createDataFrame([('gene_id "a"; x=IDs',), ("ID=b;Parent=c",), (None,), ("",)], "attrs string")
    found = rows.select(value_of(F.col("attrs"), "ID").alias("ID"), value_of(F.col("attrs"), "gene_id").alias("gene_id"))
    assert list(map(tuple, found.collect())) == [("", "a"), ("b", ""), (None, None), ("", "")]
    assert "Contains(attrs" in plan(found) or "contains(attrs" in plan(found).lower()


def test_rebuilt_genes_are_shuffled_whole(spark, tmp_path):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from locusframe.operators import models
    from locusframe.operators import transcripts as T
    from locusframe.sources import text

    made = [
        ("c", "+", "t1", 10, 20, 1), ("c", "+", "t1", 30, 40, 2), ("c", "+", "t1", 35, 40, 3), ("c", "-", "t2", 50, 60, 4), ("c", "-", "t2", 50, 55, 5), ("d", "+", "t3", 5, 9, 6),
        ("d", "-", "t4", 15, 19, 7), ("d", "-", "t5", 7, 9, 8), ("c", ".", "t6", 1, 4, 9), ("c", "+", None, 1, 4, 10),
    ]
    schema = "seqid string, strand string, tx_id string, start long, stop long, line_no long"
    cds = spark.createDataFrame(made, schema).repartition(3).withColumns({"source": F.lit("x"), "phase": F.lit("0")})
    ends = [("c", "+", "t1", 41, 43, 11), ("c", "+", "t1", 41, 49, 12), ("c", "-", "t2", 47, 49, 13), ("d", "-", "t4", 11, 14, 14), ("x", "+", "t3", 10, 12, 15), ("c", "+", None, 5, 7, 16), ("c", "+", "t9", 5, 7, 17)]
    stops = spark.createDataFrame(ends, schema).withColumns({"source": F.lit("y"), "phase": F.lit("."), "type": F.lit("UTR")})

    # As two windows and a join have it.
    outer = stops.groupBy(*T.TX).agg(F.max("stop").alias("high"), F.min("start").alias("low"))
    over = lambda *order: F.row_number().over(Window.partitionBy(*T.TX).orderBy(*order)) == 1
    rows = cds.withColumns({"hi": over(F.col("stop").desc(), "line_no"), "lo": over("start", "line_no")}).join(outer, T.TX, "left")
    stop = F.when((F.col("strand") == "+") & F.col("hi"), F.greatest("stop", "high")).otherwise(F.col("stop"))
    start = F.when((F.col("strand") == "-") & F.col("lo"), F.least("start", "low")).otherwise(F.col("start"))
    want = rows.withColumns({"start": start, "stop": stop}).select(cds.columns)
    longer = T.with_stop_codon(cds, stops)
    assert longer.columns == cds.columns and sorted(map(tuple, longer.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert plan(T.with_stop_codon(cds, stops)).count("hashpartitioning") == 1

    # Gene g is on two sequences.
    parents = spark.createDataFrame([("t1", "g"), ("t2", "h"), ("t3", "g"), ("t4", "g"), ("t5", "lost")], "tx_id string, gene_id string")
    known = spark.createDataFrame([("g",), ("h",), ("g",)], "gene_id string")
    own = longer.where("tx_id is not null")
    args = (own, stops.where("tx_id is not null"), parents, known)
    order = ["seqid", "gene_start", "gene_id", "tx_start", "tx_id", "rank", "i"]
    text.write_groups(models.rebuilt_genes(*args), str(tmp_path / "groups"), order[:3], models.rebuilt_lines(), "gzip")
    text.write_gff(models.rebuilt_rows(*args), str(tmp_path / "lines"), order)
    lines = lambda x: [r["value"] for p in sorted((tmp_path / x).glob("part-*")) for r in spark.read.text(str(p)).collect()]
    assert lines("groups") == lines("lines")
    assert [x.split("\t")[:5] for x in lines("groups") if "\tgene\t" in x] == [["c", "rebuild", "gene", "1", "4"], ["c", "x", "gene", "5", "49"], ["c", "x", "gene", "47", "60"], ["d", "rebuild", "gene", "7", "9"]]
    assert sum("\tCDS\t" in x for x in lines("groups")) == 9 and sum("\tUTR\t" in x for x in lines("groups")) == 5
    assert all(p.name.endswith(".gz") for p in (tmp_path / "groups").glob("part-*"))
