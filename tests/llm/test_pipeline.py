"""run() against a plain-Python version of its stages; the learned scores are taken from the model itself."""

import hashlib

import numpy as np
import pandas as pd
import pytest

from locusframe.llm import nearcopies
from tests.llm.test_operators import brute_components, brute_fingerprint, brute_windows

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    good = "Plain words make up quiet sentence {} of text {} here. Another {} follows after {} of them."
    texts = [good.format(*(hashlib.md5(f"{i}{j}".encode()).hexdigest()[:6] for j in range(4))) + f" More {i} words {i * 7} come." for i in range(150)]
    texts += [f"*** buy$$$ now### {i} ***\n | a | b | c |" for i in range(60)] + texts[:20] + [None, ""]
    item = " ".join(f"bench{i}" for i in range(20))
    texts += [f"Some quiet text about {item} and that is all of it."]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": ["en", "fr"] * (len(texts) // 2) + ["en"] * (len(texts) % 2), "source": "s", "n_chars": 1})
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = pd.DataFrame({"doc_id": range(210), "quality": [1] * 150 + [0] * 60, "toxic": 0})
    spark.createDataFrame(labels).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, item


def test_stages_and_run(spark, tables):
    folder, docs, item = tables
    now, outs = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == corpus_pipeline.COLUMNS
        now = spark.createDataFrame(now.toPandas(), now.schema)
        outs.append({r["doc_id"]: r["text"] for r in now.collect()})
    graded, unique, clean, mixed = outs
    assert set(graded) >= set(range(150)) and not set(graded) & set(range(150, 210))
    ids = sorted(graded)
    roots = brute_components([brute_fingerprint(graded[i]) for i in ids])
    assert set(unique) == {ids[r] for r in roots}
    bad = {r[0] for r in brute_windows(list(unique.items()), [(1, item)]) if r[5]}
    assert bad and set(clean) == set(unique) - bad
    assert mixed and set(mixed) <= set(clean)
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert set(out["doc_id"]) == set(mixed) and out["shard"].between(0, 39).all()
    assert (out.groupby("shard")["slot"].max() + 1 == out.groupby("shard").size()).all()


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_copies_beyond_the_fingerprint_go(spark):
    """Few words replaced change many bits of a fingerprint; the exact similarity of the shingles decides."""
    base = [hashlib.md5(f"w{i}".encode()).hexdigest()[:7] for i in range(100)]
    near, far = list(base), list(base)
    near[3], near[50] = "one", "two"  # 9 of 96 shingles differ: similarity 0.83
    far[10], far[40], far[70] = "one", "two", "three"  # 15 of 96 differ: 0.73
    many = [" ".join([*base[:40], f"x{i}", *base[41:]]) for i in range(300)]  # each 0.9 to base and to each other
    rows = [(7, " ".join(base)), (8, " ".join(near)), (9, " ".join(far)), *((100 + i, t) for i, t in enumerate(many))]
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, _docs(spark, rows), "").collect()} == {7, 9}


def test_rows_without_an_own_id_stay(spark, tmp_path):
    rows = [(None, f"quite different words number {i} stand in row {i * 13} of this table") for i in range(6)]
    rows += [(5, "one text of the repeated id says this"), (5, "and another text of it says something else"), (5, "one text of the repeated id says this")]
    out = [r["text"] for r in corpus_pipeline.one_of_each(spark, _docs(spark, rows), "").collect()]
    assert sorted(out) == sorted({t for _, t in rows})
    item = " ".join(f"bench{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(5, "clean text"), (5, f"here is {item}"), (None, "clean too"), (None, item)]
    out = [r["text"] for r in corpus_pipeline.without_benchmark(spark, _docs(spark, left), str(tmp_path)).collect()]
    assert sorted(out) == ["clean text", "clean too"]


def test_dense_bands_lose_no_link(spark, monkeypatch):
    """A passage that many unlike texts share fills bands; pairs among them beyond each row's nearest are still found."""
    monkeypatch.setattr(nearcopies, "NEAREST", 0)
    monkeypatch.setattr(nearcopies, "ROWS_AT_ONCE", 25)
    rng = np.random.default_rng(4)
    word = lambda *x: hashlib.md5(repr(x).encode()).hexdigest()[:6]
    shared = [word("s", i) for i in range(60)]
    texts = []
    for i in range(60):  # pairs of near copies; different pairs are at about 0.5
        own = [word(i, j) for j in range(28)]
        texts += [shared + own, shared + own[:-3] + [word(i, "x", k) for k in range(3)]]
    texts = [" ".join(t) for t in texts]
    order = rng.permutation(len(texts))
    docs = _docs(spark, [(int(i), texts[i]) for i in order])
    sets = [set(nearcopies.shingles(t.encode(), 5).tolist()) for t in texts]
    near = [[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]
    assert sum(map(sum, near)) == 240
    rows = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    groups = [(i, nearcopies.signature(nearcopies.shingles(t.encode(), 5))[3]) for i, t in enumerate(texts)]
    none = spark.createDataFrame([], "node long, root long")
    links = nearcopies.rest_links(spark.createDataFrame(groups, "rid long, bands array<long>"), none, rows, 5, 0.8)
    assert sorted({tuple(r) for r in links.collect()}) == [(i, i + 1) for i in range(0, 120, 2)]
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()) == list(range(0, 120, 2))


def test_stages_on_odd_rows(spark, tables):
    """Null and repeated ids, null and very long texts, extra and clashing columns, and no rows at all."""
    folder, docs, _ = tables
    long = " ".join(hashlib.md5(f"l{i}".encode()).hexdigest()[:5] for i in range(30_000))
    texts = [docs["text"][i] for i in range(12)] + [long, None, None, "", "  "]
    rows = [(None if i % 3 == 0 else 7, t, "en", None, 1, "s", 1.0, 3) for i, t in enumerate(texts)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, score double, rid int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, folder).toPandas()
        assert set(corpus_pipeline.COLUMNS) <= set(out.columns), name
        assert set(out["text"].dropna()) <= set(t for t in texts if t is not None)
        if name == "SimHash near-dedup":
            assert len(out) == 14  # the texts without words are one group
        if name == "sharding":
            assert len(out) == len(texts)
        assert stage(spark, odd.limit(0), folder).count() == 0, name
