"""Files in small parts: records that span many of them."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import grammar
from locusframe.plans.gene_queries import base_scores
from locusframe.sources import parts
from locusframe.sources import text as io


@pytest.fixture
def small_parts(spark):
    names = {"spark.sql.files.maxPartitionBytes": "8192", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def records(rng):
    letters = list("ACGTacgtN")
    sizes = [0, 1, 59, 60, 61, 70_001, 0, 12_345, 200_000, 3]
    return [(f"r{i}", f"r{i} len={n}", "".join(rng.choice(letters, n))) for i, n in enumerate(sizes)]


def test_fasta_records_over_parts(spark, small_parts, tmp_path):
    made = records(np.random.default_rng(1))
    widths = [60, 60, 60, 60, 60, 60, 60, 80, 61, 1]
    body = lambda s, w: "".join(s[i : i + w] + ("\r\n" if w == 61 else "\n") for i in range(0, len(s), w))
    text = "; no record\nACGT\n" + "".join(f">{h}\n{body(s, w)}" + "\n" * (w == 80) for (_, h, s), w in zip(made, widths, strict=True))
    (tmp_path / "a.fa").write_text(text)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as out:
        out.write(">z one\nAC\nGT\n>r5 again\nTTTT")
    both = [str(tmp_path / "a.fa"), str(tmp_path / "b.fa.gz")]
    assert spark.read.text(both[0]).rdd.getNumPartitions() > 20
    size = 1_000
    got = sorted(map(tuple, parts.fasta_tiles(spark, both, size).collect()))
    every = [*made, ("z", "z one", "ACGT"), ("r5", "r5 again", "TTTT")]
    assert got == sorted((n, h, i // size, s[i : i + size]) for n, h, s in every for i in range(0, len(s), size))
    assert sorted(map(tuple, parts.fasta_lengths(spark, both).collect())) == sorted((n, h, len(s)) for n, h, s in every)
    upper = parts.fasta_tiles(spark, both[0], 100_000, upper=True).where("seq_name = 'r8'").orderBy("tile").collect()
    assert "".join(r["sequence"] for r in upper) == made[8][2].upper()


def test_reading_with_upper_drops_the_soft_mask(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s x\nACgt\nnn\n")
    assert [r["sequence"] for r in io.read_fasta(spark, str(tmp_path / "a.fa"), upper=True).collect()] == ["ACGTNN"]


def test_wig_blocks_over_parts(spark, small_parts, tmp_path):
    rng = np.random.default_rng(2)
    blocks = [("chr1", 1, 1, 20_000), ("chr1", 30_000, 5, 3), ("chr2", 7, 2, 5_000), ("chr3", 4, 1, 0), ("chr3", 9, 10, 1)]
    want, lines = [], ["track type=wiggle_0"]
    for name, start, step, n in blocks:
        lines.append(f"fixedStep chrom={name} start={start} step={step}")
        for i, value in enumerate(rng.integers(-50, 50, n) / 8):
            lines.append(f"{value:g}" if i % 7 else f" {value:.4e} ")
            want.append((name, start + i * step, float(value)))
            if i % 900 == 5:
                lines.append("# no number")
    (tmp_path / "a.wig").write_text("\n".join(lines) + "\n")
    assert spark.read.text(str(tmp_path / "a.wig")).rdd.getNumPartitions() > 5
    assert sorted(map(tuple, io.read_wig(spark, str(tmp_path / "a.wig")).collect())) == sorted(want)
    chunks = parts.wig_chunks(spark, str(tmp_path / "a.wig"), 100)
    assert chunks.agg(F.max(F.size("values"))).first()[0] == 100


def test_empty_files(spark, tmp_path):
    (tmp_path / "a").write_text("")
    assert parts.fasta_tiles(spark, str(tmp_path / "a")).count() == 0 and io.read_wig(spark, str(tmp_path / "a")).count() == 0


@pytest.mark.parametrize("margin", [2, 30])
def test_blocks_of_tiles_are_blocks_of_sequences(spark, margin):
    rng = np.random.default_rng(3)
    whole = spark.createDataFrame([(f"s{n}", "".join(rng.choice(list("ACGTN"), n))) for n in (1, 30, 64, 65, 300, 128)], "seq_name string, sequence string")
    size = 32
    tiles = whole.select("seq_name", F.posexplode(F.regexp_extract_all("sequence", F.lit(f".{{1,{size}}}"), F.lit(0))).alias("tile", "sequence")).withColumn("tile", F.col("tile").cast("long"))
    names = ["seq_name", "strand", "block", "last", "first", "length", "total", "letters"]
    rows = lambda df: sorted(map(tuple, df.select(*names).collect()))
    assert rows(parts.tile_blocks(tiles, size, margin)) == rows(grammar.blocks(whole, size, margin))


def test_genes_of_a_file_in_parts(spark, small_parts, tmp_path):
    """From FASTA tiles to gene models, with no whole sequence in a row: as from whole sequences."""
    rng = np.random.default_rng(4)
    whole = [(f"s{i}", "".join(rng.choice(list("ACGT"), n))) for i, n in enumerate((9_000, 500))]
    table = spark.createDataFrame(whole, "seq_name string, sequence string")
    io.write_fasta(table, str(tmp_path / "fa"))
    moves = grammar.gene_moves(40, 60, 150)
    tiles = parts.fasta_tiles(spark, str(tmp_path / "fa"), 512)
    table_1 = grammar.stored(parts.tile_blocks(tiles, 512, grammar.REACH))
    rows = lambda df: sorted(map(tuple, grammar.gene_parts(grammar.path_pieces(df)).collect()))
    found = rows(grammar.decoded_table(table_1, base_scores, moves, grammar.REACH))
    assert found and found == rows(grammar.decoded_blocks(table, base_scores, moves, 700))
