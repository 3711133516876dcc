"""Near copies by exact similarity of word shingles: candidates from SimHash anchors and, for copies whose fingerprints
are too far apart for these, from MinHash bands."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm._common import hinted, written
from locusframe.llm.components import connected_components
from locusframe.llm.simhash import forest, near_links
from locusframe.session import importable

#: A pair of similarity s shares none of BANDS bands of ROWS minima with probability (1 - s**ROWS)**BANDS: 7e-5 at 0.8.
BANDS, ROWS = 24, 5
#: Rows of one band are first compared with so many of their nearest by SimHash bits, looked for among so many neighbours
#: in fingerprint order. Where a band has more rows, and they aren't all connected then, all are compared (``rest_links``).
NEAREST, AMONG = 8, 4096
#: Rows of a band that one task compares with each other, or with so many others.
ROWS_AT_ONCE = 1_000
#: Candidates' row ids are broadcast up to this many (of 8 bytes).
BROADCAST_ROWS = 500_000
_draw = np.random.default_rng(42)
FACTORS = _draw.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _draw.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """64-bit hashes of all runs of ``words`` words, repeats too; a shorter text is one run, one without words none."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.array([digest(joined[i:j]) for i, j in spans], np.uint64)


def signature(hashes: np.ndarray) -> tuple[int, int, int, list[int]]:
    """Two numbers for the set of shingles, its SimHash, and its bands (none for an empty set)."""
    found = np.unique(hashes)
    key = np.frombuffer(xxhash.xxh128_digest(found.tobytes()), "<i8")
    if not len(found):
        return int(key[0]), int(key[1]), 0, []
    minima = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(found), 4096):
        block = found[i : i + 4096]
        minima = np.minimum(minima, (block * FACTORS + OFFSETS).min(axis=1))
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(found), bitorder="little").view("<i8")[0]
    rows = minima.reshape(BANDS, ROWS)
    bands = np.array([xxhash.xxh64_intdigest(r.tobytes(), n) for n, r in enumerate(rows)], np.uint64).view(np.int64)
    return int(key[0]), int(key[1]), int(bits), bands.tolist()


def _links(rid: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate links in one band: every row with the least one, and with its NEAREST by bits."""
    order = np.argsort(bits, kind="stable")
    rid, bits = rid[order], bits[order]
    yield np.full(len(rid), rid.min()), rid
    for i in range(0, len(rid), 512):
        low = max(0, i - AMONG // 2)
        own, near = bits[i : i + 512], bits[low : i + 512 + AMONG // 2]
        apart = np.bitwise_count((own[:, None] ^ near[None, :]).view(np.uint64))
        apart[np.arange(len(own)), np.arange(len(own)) + i - low] = 255
        k = min(NEAREST, len(near) - 1)
        pick = np.argpartition(apart, k - 1, axis=1)[:, :k]
        yield np.repeat(rid[i : i + 512], k), rid[low + pick.ravel()]


def candidates(groups: DataFrame) -> DataFrame:
    """(a, b), a < b: links between rows (rid, bits, bands) that share a band."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64)] * 3
        for batch in _and_end(batches):
            part = [np.empty(0, np.int64)] * 3 if batch is None else [c.to_numpy() for c in batch.columns]
            band, rid, bits = (np.concatenate([k, p]) for k, p in zip(kept, part, strict=True))
            cut = len(band) if batch is None or not len(band) else int(np.searchsorted(band, band[-1]))
            kept = [x[cut:] for x in (band, rid, bits)]
            edges = np.flatnonzero(np.r_[True, band[1:cut] != band[: cut - 1], True]) if cut else np.zeros(1, np.int64)
            for i in np.flatnonzero(np.diff(edges) > 1):
                for a, b in _links(rid[edges[i] : edges[i + 1]], bits[edges[i] : edges[i + 1]]):
                    yield pa.record_batch([np.minimum(a, b), np.maximum(a, b)], ["a", "b"])

    importable(groups.sparkSession)
    rows = groups.select(F.explode("bands").alias("band"), "rid", "bits").repartition("band").sortWithinPartitions("band")
    return rows.mapInArrow(compare, "a long, b long").where("a < b")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True)


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def similar(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have at least this Jaccard similarity; texts: (rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for a, s, t in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                if a.as_py() != last:
                    last, one = a.as_py(), np.unique(shingles(s.as_py(), words))
                two = np.unique(shingles(t.as_py(), words))
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both >= similarity * (len(one) + len(two) - both) - 1e-9)
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    nodes = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
    texts = written(texts.select("rid", F.col("text").cast("binary").alias("text")).join(hinted(nodes, BROADCAST_ROWS), "rid"))
    first, second = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    both = pairs.join(second, "b").join(first.hint("merge"), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long")


def anchored(groups: DataFrame) -> DataFrame:
    """(a, b), a < b: links between rows (rid, bits) whose fingerprints are equal or that the anchors connect."""
    own = written(groups.groupBy("bits").agg(F.min("rid").alias("least")))
    near = near_links(own.select(F.col("bits").alias("fp")))
    x, y = own.toDF("a", "x"), own.toDF("b", "y")
    apart = near.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    same = groups.join(own, "bits").where("rid != least").select(F.col("least").alias("a"), F.col("rid").alias("b"))
    return apart.union(same)


def _by_prefix(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets of different roots (and sides, unless all have one) of at least this similarity.

    Elements are ordered by rarity. Sets that are similar enough share one of the first ``len - similarity * len + 1``
    of them, and have sizes that are as similar; these pairs alone are looked at, and each exactly.
    """
    size = np.array([len(x) for x in sets])
    every, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    order = np.lexsort((code, often[code], row))
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    first = place < np.repeat(size - np.ceil(similarity * size - 1e-9) + 1, size)
    code, row = code[order][first], row[order][first]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    edges = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True])
    seen: set[tuple[int, int]] = set()
    one_side = side.min() == side.max()
    found_a, found_b = [], []
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        if j - i < 2 or root[row[i:j]].min() == root[row[i:j]].max():
            continue
        for k in range(i, j - 1):
            x, ys = row[k], row[k + 1 : j]
            ok = (root[ys] != root[x]) & (np.minimum(size[ys], size[x]) >= similarity * np.maximum(size[ys], size[x]) - 1e-9)
            if not one_side:
                ok &= side[ys] != side[x]
            for y in ys[ok].tolist():
                if (x, y) in seen:
                    continue
                seen.add((x, y))
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if both >= similarity * (size[x] + size[y] - both) - 1e-9:
                    found_a.append(x)
                    found_b.append(y)
                    root = np.where(root == root[y], root[x], root)
    return np.array(found_a, np.int64), np.array(found_b, np.int64)


def rest_links(groups: DataFrame, roots: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): the links that ``candidates`` may have left out, so that components come out whole.

    A band of up to NEAREST + 1 rows has had all its pairs compared, and one of a single component needs no more. For the
    others, the sets of shingles themselves are dealt by band, in pairs of parts of about ROWS_AT_ONCE rows if there are
    more, and compared inside tasks: no pairs are emitted but a spanning forest of links.
    """
    slim = groups.join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("rid", F.coalesce("root", "rid").alias("root"), F.explode("bands").alias("band"))
    dense = slim.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y"))
    dense = dense.where((F.col("n") > NEAREST + 1) & (F.col("x") < F.col("y"))).select("band", F.ceil(F.col("n") / ROWS_AT_ONCE).alias("parts"))
    places = written(slim.join(hinted(written(dense), BROADCAST_ROWS), "band"))
    if not places.limit(1).count():
        return places.select(F.col("rid").alias("a"), F.col("rid").alias("b"))
    part = F.pmod(F.xxhash64("rid"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = places.withColumn("part", part).withColumn("other", other)
    key = F.xxhash64("band", F.least("part", "other"), F.greatest("part", "other")).alias("key")
    dealt = dealt.groupBy("rid", "root").agg(F.collect_set(F.struct(key, (F.col("part") > F.col("other")).alias("side"))).alias("keys"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                yield pa.record_batch([*part.columns[:3], pa.array([np.unique(shingles(part.column(3)[0].as_py(), words)).tobytes()], pa.binary())], ["rid", "root", "keys", "elements"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(batches), itemgetter(0)):
            _, rid, root, side, raw = zip(*rows, strict=True)
            a, b = _by_prefix([np.frombuffer(x, np.uint64) for x in raw], np.array(root), np.array(side), similarity)
            a, b = forest(np.array(rid)[a], np.array(rid)[b]) if len(a) else (a, b)
            yield pa.record_batch([np.minimum(a, b), np.maximum(a, b)], ["a", "b"])

    importable(groups.sparkSession)
    own = dealt.join(texts.select("rid", F.col("text").cast("binary").alias("text")), "rid").select("rid", "root", "keys", "text")
    keys = "keys array<struct<key:bigint,side:boolean>>"
    made = own.mapInArrow(sets, f"rid long, root long, {keys}, elements binary").select(F.explode("keys").alias("k"), "rid", "root", "elements")
    made = made.select("k.key", "rid", "root", "k.side", "elements").repartition("key").sortWithinPartitions("key")
    return made.mapInArrow(compare, "a long, b long")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, root) after more links: only the roots that these connect are looked at anew."""
    x, y = roots.toDF("a", "ra"), roots.toDF("b", "rb")
    tops = links.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    above = written(connected_components(tops, "a", "b")).toDF("node", "top")
    moved = roots.join(above.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.union(above.join(roots.select("node"), "node", "left_anti").select("node", F.col("top").alias("root")))


def kept_rows(rows: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(rid): of ``rows`` (rid, doc_id, text; rid each once) one of each group of near copies, that of least doc_id.

    Texts are lower-cased (A-Z) and split at ASCII white space. Two are near copies if their sets of shingles of
    ``words`` words have a Jaccard similarity of ``similarity`` or more; groups are what such links connect. Texts
    without words are copies of each other. Equal sets are taken together first, so groups of copies cost one row.
    Rows are told apart by rid alone: ids may be null or repeat; of equal ids, or none, the least rid stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signature(shingles(x.as_py(), words)) for x in batch.column(2)]
            k1, k2, bits, bands = zip(*found, strict=True) if found else ((), (), (), ())
            made = [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bits, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column(0), batch.column(1), *made], ["rid", "doc_id", "k1", "k2", "bits", "bands"])

    importable(rows.sparkSession)
    signed = rows.select("rid", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = signed.mapInArrow(run, "rid long, doc_id long, k1 long, k2 long, bits long, bands array<long>")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    groups = signed.groupBy("k1", "k2").agg(F.min(best).alias("best"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    groups = written(groups.select(F.col("best.rid").alias("rid"), "best", "bits", "bands"))
    pairs = written(candidates(groups).union(anchored(groups)).distinct())
    links = written(similar(pairs, rows, words, similarity))
    roots = written(connected_components(links, "a", "b"))
    more = written(rest_links(groups, roots, rows, words, similarity))
    if more.limit(1).count():
        roots = written(_joined(roots, more))
    of = groups.select("rid", "best").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
    return of.groupBy(F.coalesce("root", "rid").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.rid").alias("rid"))
