"""Owners of stretches against painting base by base."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import envelope, labels


def painted(rows):
    """(position, piece) pairs of the largest transcript at each position."""
    at = {}
    for low, high, piece in rows:
        for pos in range(low, high + 1):
            at.setdefault(pos, set()).add(piece)
    return {(pos, p) for pos, own in at.items() for p in own if p[0] == max(x[0] for x in own)}


def unrolled(stretches):
    return [(pos, p) for low, high, p in stretches for pos in range(low, high + 1)]


def made(rng, n, wide=60, names=12):
    out = []
    for _ in range(n):
        low = int(rng.integers(1, 150))
        high = low + int(rng.integers(0, wide))
        out.append((low, high, (f"t{rng.integers(0, names)}", low, high, int(rng.integers(0, 3)), 1, 1)))
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 7, 60, 300])
def test_envelope_is_painting(n):
    rng = np.random.default_rng(n)
    for _ in range(10):
        rows = made(rng, n)
        got = unrolled(envelope.envelope(rows))
        assert len(got) == len(set(got)) and set(got) == painted(rows)
        halves = envelope.envelope(rows[: n // 2]) + envelope.envelope(rows[n // 2 :])
        assert set(unrolled(envelope.envelope(halves))) == painted(rows)


def test_stretches_of_deep_bins(spark, monkeypatch):
    """More rows than a task holds, all in a few bins."""
    monkeypatch.setattr(envelope, "HELD", 100)
    rng = np.random.default_rng(9)
    rows = [("c", "+-"[i % 2], *x) for i, x in enumerate(made(rng, 3_000, names=400))]
    pieces = spark.createDataFrame([(c, s, p[0], p[1], p[2], p[3], None if p[3] == 0 else p[4], p[5]) for c, s, _, _, p in rows], "seqid string, strand string, tx_id string, start long, stop long, phase long, n int, total long").repartition(3)
    out = envelope.stretches(pieces, 64)
    for strand in "+-":
        own = [(lo, hi, (p[0], p[1], p[2], p[3], 0 if p[3] == 0 else 1, 1)) for _, s, lo, hi, p in rows if s == strand]
        got = [(r["low"], r["high"], tuple(r[c] for c in ("tx_id", "start", "stop", "phase", "n", "total"))) for r in out.where(F.col("strand") == strand).collect()]
        assert sorted(unrolled(got)) == sorted(painted(own))
        assert all((lo - 1) // 64 == (hi - 1) // 64 for lo, hi, _ in got)
    assert out.groupBy("strand", "bin").count().agg(F.max("count")).first()[0] < 3 * 64


def test_overlapping_tiles_are_cut_from_one_track(spark):
    rng = np.random.default_rng(10)
    rows = []
    for tx in range(12):
        at = int(rng.integers(1, 300))
        for k in range(int(rng.integers(1, 5))):
            n = int(rng.integers(3, 40))
            rows.append(("c", "+-"[tx % 2], "g", f"t{tx}", "CDS", at, at + n, 10 * tx + k))
            at += n + int(rng.integers(2, 50))
    cds = spark.createDataFrame(rows, "seqid string, strand string, gene_id string, tx_id string, type string, start long, stop long, line_no long")
    whole = {r["strand"]: r["labels"] if r["strand"] == "+" else r["labels"][::-1] for r in labels.label_tiles(cds, 1_000).collect()}
    for size, overlap in ((50, 0), (64, 20), (40, 39)):
        for r in labels.label_tiles(cds, size, overlap).collect():
            low = r["chunk"] * (size - overlap)
            own = r["labels"] if r["strand"] == "+" else r["labels"][::-1]
            assert own == (whole[r["strand"]] + [0] * size)[low : low + size]
    runs = labels.label_runs(cds, 32).collect()
    best = {}
    for r in labels.all_labels(cds).collect():
        best[r["strand"], r["pos"]] = max(best.get((r["strand"], r["pos"]), ""), r["tx_id"])
    assert sorted((r["strand"], p, r["tx_id"]) for r in runs for p in range(r["start"], r["stop"] + 1)) == sorted((s, p, t) for (s, p), t in best.items())


def test_full_bins_are_painted_and_not_swept(spark, monkeypatch):
    import pyarrow as pa

    kinds = {"seqid": pa.string(), "strand": pa.string(), "tx_id": pa.string(), "phase": pa.int32(), "n": pa.int32(), "total": pa.int32()}
    schema = pa.schema([(c, kinds.get(c, pa.int64())) for c in envelope._NAMES])

    def batch(rows):
        cut = [("c", "+", b, max(lo, b * 64 + 1), min(hi, b * 64 + 64), *p) for lo, hi, p in rows for b in range((lo - 1) // 64, (hi - 1) // 64 + 1)]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*cut, strict=True), schema, strict=True)], schema)

    rows = [(lo, hi, (f"t{i:04}", *p[1:])) for i, (lo, hi, p) in enumerate(made(np.random.default_rng(4), 2_000))]
    crossed = [*rows, *((lo, hi, ("t0001", *p[1:])) for lo, hi, p in rows[:1] + rows[5:9])]
    for given in (rows, crossed):
        got = [(x[0], x[1], x[2]) for _, x in envelope._rows(envelope.reduced(batch(given), 64))]
        assert sorted(unrolled(got)) == sorted(painted(given))
    swept = []
    real = envelope.envelope
    monkeypatch.setattr(envelope, "envelope", lambda rows: swept.append(1) or real(rows))
    envelope.reduced(batch(rows), 64)
    assert not swept
    envelope.reduced(batch(crossed), 64)
    assert swept


def test_rows_of_many_bins_are_not_swept(monkeypatch):
    """Some rows in each of more bins than are painted at once."""
    import pyarrow as pa

    kinds = {"seqid": pa.string(), "strand": pa.string(), "tx_id": pa.string(), "phase": pa.int32(), "n": pa.int32(), "total": pa.int32()}
    schema = pa.schema([(c, kinds.get(c, pa.int64())) for c in envelope._NAMES])
    monkeypatch.setattr(envelope, "PAINTED", 64 * 3)
    monkeypatch.setattr(envelope, "envelope", None)
    rng, given = np.random.default_rng(5), []
    for b in range(20):
        for k in range(1 if b % 4 == 0 else 4):
            low = b * 64 + 1 + int(rng.integers(0, 40))
            given.append((low, low + int(rng.integers(0, 24)), (f"t{b}.{k}", low, low + 30, 0, 1, 1)))
    flat = [("c", "+", (lo - 1) // 64, lo, hi, *p) for lo, hi, p in given]
    out = envelope.reduced(pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*flat, strict=True), schema, strict=True)], schema), 64)
    assert sorted(unrolled([x for _, x in envelope._rows(out)])) == sorted(painted(given))
    assert out.column("bin").to_pylist() == sorted(out.column("bin").to_pylist())
