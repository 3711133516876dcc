"""Training examples: their parts by place, and how they meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.functions import examples, tracks
from locusframe.operators import labels

SIZE = 20


@pytest.fixture
def parts(spark):
    sequences = spark.createDataFrame([("a", "ACGT" * 12 + "G"), ("b", "TTTTa"), ("e", "")], "seq_name string, sequence string")
    cds = spark.createDataFrame([("a", "+", "g", "t1", "CDS", 3, 11, 1), ("a", "+", "g", "t1", "CDS", 30, 35, 2), ("a", "-", "h", "t2", "CDS", 18, 26, 3), ("x", "+", "k", "t3", "CDS", 1, 9, 4)], "seqid string, strand string, gene_id string, tx_id string, type string, start long, stop long, line_no long")
    masked = spark.createDataFrame([("a", 0, 3), ("a", 18, 45), ("b", 4, 4), ("x", 1, 5)], "seqid string, start long, stop long")
    track = spark.createDataFrame([("a", 0, 1.5), ("a", 21, -2.0), ("a", 48, 4.0), ("a", 700, 9.0), ("b", 1, None)], "seqid string, pos long, value double")
    return sequences, cds, masked, track


def test_examples_by_place(spark, parts):
    sequences, cds, masked, track = parts
    out = {(r["seqid"], r["strand"], r["tile"]): r for r in examples.examples(*parts, SIZE, -1.0, 3).collect()}
    assert set(out) == {(s, x, t) for s, n in (("a", 3), ("b", 1), ("e", 1)) for t in range(n) for x in "+-"}
    painted = {(r["seqid"], r["strand"], r["chunk"]): r["labels"] for r in labels.label_tiles(cds, SIZE).collect()}
    text = dict(map(tuple, sequences.collect()))
    for (seqid, strand, tile), r in out.items():
        turn = slice(None, None, -1 if strand == "-" else 1)
        cut = text[seqid][tile * SIZE : (tile + 1) * SIZE].ljust(SIZE, "N")
        assert r["sequence"] == (cut if strand == "+" else cut.translate(str.maketrans("ACGTacgt", "TGCAtgca"))[::-1])
        assert r["labels"] == painted.get((seqid, strand, tile), [0] * SIZE)
        zero = {p for s, a, b in masked.collect() if s == seqid for p in range(a, b)}
        assert r["weights"] == [0.0 if tile * SIZE + i in zero else 1.0 for i in range(SIZE)][turn]
        values = {p: -1.0 if v is None else v for s, p, v in track.collect() if s == seqid}
        assert r["track"] == [values.get(tile * SIZE + i, -1.0) for i in range(SIZE)][turn]


def test_parts_meet_without_a_shuffle(spark, parts):
    plan = examples.examples(*parts, SIZE, 0.0, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan and "Broadcast" not in plan


def test_shards_are_strides(spark, parts, tmp_path):
    rows = examples.example_shards(examples.examples(*parts, SIZE, 0.0, 2), 3)
    examples.write_shards(rows, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    counts = [r["count"] for r in back.groupBy("shard").count().collect()]
    assert len(counts) == 3 and max(counts) - min(counts) <= 1 and sum(counts) == 10 and len([p for p in (tmp_path / "shards").iterdir() if p.name.startswith("shard=")]) == 3


def test_painted_places(spark):
    rng = np.random.default_rng(1)
    made, want = [], {}
    for k in range(150):
        flat = np.full((2, 30), [[7.0], [0.0]])
        at = 0
        while (at := at + int(rng.integers(1, 6))) < 30:
            end = min(29, at + int(rng.integers(0, 5)))
            made.append((k, at, end, None if at % 5 == 0 else float(at), -float(end)))
            flat[0, at : end + 1], flat[1, at : end + 1] = 7.0 if at % 5 == 0 else at, -end
            at = end
        want[k] = flat.tolist()
    rows = spark.createDataFrame(made, "k int, low int, high int, a double, b double").repartition(3)
    out = {r["k"]: [r["a"], r["b"]] for r in tracks.painted(rows, ["k"], 30, ["a", "b"], [7.0, 0.0]).collect()}
    assert out == {k: v for k, v in want.items() if k in out} and len(out) == 150
    assert tracks.painted(rows.where(F.lit(False)), ["k"], 30, ["a"], [7.0]).count() == 0


def test_packed_examples_are_the_same(spark, parts, tmp_path):
    plain, packed = (examples.examples(*parts, SIZE, -1.0, 3, 2, packed=p) for p in (False, True))
    examples.write_shards(packed, str(tmp_path / "packed"))
    back = spark.read.parquet(str(tmp_path / "packed"))
    assert {k for _, k in packed.select("labels", "weights", "track").dtypes} == {"binary"}
    want = sorted(map(tuple, plain.select(*plain.columns[:7]).collect()), key=lambda r: r[:3])
    assert sorted(map(tuple, examples.unpacked(back).select(*plain.columns[:7]).collect()), key=lambda r: r[:3]) == want
    sums = {tuple(r)[:3]: tuple(r)[3:] for r in examples.place_sums(back).select(*examples.KEYS, "labels", "masked", "masked_places", "track").collect()}
    at = np.arange(SIZE)
    assert sums == {r[:3]: (at @ np.array(r[4]), r[5].count(0.0), sum(i for i in at if r[5][i] == 0), at @ np.array(r[6])) for r in want}


def test_tiles_are_dealt_out_once_for_both_strands(spark, parts, monkeypatch):
    """Parts go to their buckets as they are, not as whole arrays of each strand."""
    seen = []
    real = examples.bucketed
    monkeypatch.setattr(examples, "bucketed", lambda df, keys, *more: seen.append((list(keys), df.dtypes)) or real(df, keys, *more))
    assert examples.examples(*parts, SIZE, 0.0, 2).count() == 10
    assert all(keys == ["seqid", "tile"] and not any(kind.startswith("array") for _, kind in dtypes) for keys, dtypes in seen)
