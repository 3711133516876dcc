"""SimHash fingerprints, and near-duplicates among them by anchor points of a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm._common import hinted, written
from locusframe.llm.components import connected_components
from locusframe.session import importable

#: The binary Golay code of length 23: every word is within 3 bits of exactly one code word.
LENGTH, RADIUS, GENERATOR = 23, 3, 0b110001110101
MASK = (1 << LENGTH) - 1
#: Candidate pairs that are compared at a time in one task.
PAIRS_AT_ONCE = 1_000_000
#: Anchors that must be split are broadcast up to this many (of 16 bytes).
BROADCAST_HOT = 500_000


def fingerprint(text: bytes | None, words: int, seed: int) -> int:
    """The fingerprint, as a signed 64-bit number, of the UTF-8 bytes of one text."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return int(np.uint64(digest(b" ".join(parts), seed)).view(np.int64))
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[i:j], seed) for i, j in spans], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        block = hashes[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row; bytes.lower and bytes.split know ASCII only, as wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_py(), words, seed) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    importable(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


@cache
def _patterns(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of up to ``most`` bits, by syndrome and weight: the patterns, where each class starts, its size.

    A word minus any pattern of its own syndrome is a code word, at the pattern's weight.
    """
    levels = [np.zeros(1, np.int64)]
    for _ in range(most):  # one more bit, above those that are set; each level is sorted
        levels.append(np.concatenate([levels[-1][: np.searchsorted(levels[-1], 1 << b)] | 1 << b for b in range(LENGTH)]))
    words = np.concatenate(levels)
    remainder = words.copy()
    for bit in range(LENGTH - 1, 10, -1):
        remainder ^= (remainder >> bit & 1) * (GENERATOR << (bit - 11))
    kind = remainder * (most + 1) + np.bitwise_count(words)
    order = np.argsort(kind, kind="stable")
    sizes = np.bincount(kind, minlength=(most + 1) << 11)
    return words[order], np.cumsum(sizes) - sizes, sizes


def _syndrome(words: np.ndarray) -> np.ndarray:
    out = words.copy()
    for bit in range(LENGTH - 1, 10, -1):
        out ^= np.where(out >> bit & 1, GENERATOR << (bit - 11), 0)
    return out


def anchors(prints: np.ndarray, within: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the fingerprint, anchor, whether it is the nearest one) for every anchor within 2 x RADIUS + within bits.

    Anchors are pairs of code words over bits 0-22 and 23-45; each fingerprint is within 2 x RADIUS of one.
    """
    most = 2 * RADIUS + within
    patterns, starts, sizes = _patterns(most)
    low, high = prints & MASK, prints >> LENGTH & MASK
    low_kind, high_kind = _syndrome(low) * (most + 1), _syndrome(high) * (most + 1)
    for w in range(most + 1):
        for v in range(most + 1 - w):
            n, m = sizes[low_kind + w], sizes[high_kind + v]
            count = n * m
            row = np.repeat(np.arange(len(prints)), count)
            if not len(row):
                continue
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            p = patterns[starts[low_kind + w][row] + nth // m[row]]
            q = patterns[starts[high_kind + v][row] + nth % m[row]]
            yield row, (low[row] ^ p) | (high[row] ^ q) << LENGTH, np.full(len(row), w <= RADIUS and v <= RADIUS)


def nearest(prints: np.ndarray) -> np.ndarray:
    """The one anchor within RADIUS bits of both halves of each fingerprint."""
    patterns, starts, _ = _patterns(RADIUS)
    kinds = np.arange(1 << 11)[:, None] * (RADIUS + 1) + np.arange(RADIUS + 1)
    only = patterns[starts[kinds[np.arange(1 << 11), _patterns(RADIUS)[2][kinds].argmax(axis=1)]]]
    low, high = prints & MASK, prints >> LENGTH & MASK
    return (low ^ only[_syndrome(low)]) | (high ^ only[_syndrome(high)]) << LENGTH


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component in these links), one for each node but the roots."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    rest = root != np.arange(len(nodes))
    return nodes[rest], nodes[root[rest]]


def _compare(group: np.ndarray, fp: np.ndarray, home: np.ndarray, member: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of one group: of those at home there with all members; rows are sorted by group."""
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    number = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    members = fp[member]
    sizes = np.bincount(number[member], minlength=len(edges) - 1)
    starts = np.cumsum(sizes) - sizes
    homes = np.flatnonzero(home)
    first, size = starts[number[homes]], sizes[number[homes]]
    found_a, found_b = [], []
    blocks = np.cumsum(size) // PAIRS_AT_ONCE
    for block in np.unique(blocks):
        pick = blocks == block
        h, f, n = homes[pick], first[pick], size[pick]
        x = np.repeat(fp[h], n)
        y = members[np.repeat(f, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        near = (x != y) & (np.bitwise_count((x ^ y).view(np.uint64)) <= within)
        if near.any():
            u, v = forest(x[near], y[near])
            found_a.append(u)
            found_b.append(v)
    none = np.empty(0, np.int64)
    return np.concatenate(found_a or [none]), np.concatenate(found_b or [none])


def near_links(prints: DataFrame, within: int = 2, hot_homes: int = 10_000, rows_at_once: int = 500_000) -> DataFrame:
    """(a, b): links that connect just what fingerprints (column fp, each once) at ``within`` or fewer bits connect.

    Each fingerprint x is within 2 x RADIUS of its nearest anchor, its home. One within ``within`` bits of x is then
    within 2 x RADIUS + ``within`` of that anchor, so copying each fingerprint to all anchors that near loses no
    pair. Tasks take an anchor's rows as a stream, those at home there first, compare all with these, and return a
    spanning forest of the links they find, not all pairs. An anchor with over ``hot_homes`` fingerprints at home is
    split: its rows are dealt over as many parts as it has times so many, and those at home go to every part.
    """

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([nearest(batch.column(0).to_numpy())], ["anchor"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_prints = batch.column(0).to_numpy()
            for i in range(0, len(all_prints), 4096):
                prints = all_prints[i : i + 4096]
                for row, anchor, home in anchors(prints, within):
                    yield pa.record_batch([anchor, prints[row], home, np.ones(len(row), bool)], ["grp", "fp", "home", "member"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool)]
        waiting = [kept]
        for batch in batches:
            waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(x[0]) for x in waiting) < rows_at_once:
                continue
            kept = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            a, b = _compare(*kept, within)
            yield pa.record_batch([a, b], ["a", "b"])
            # The last group may go on: its rows at home are compared with what comes, and all else is done with.
            stays = (kept[0] == kept[0][-1]) & kept[2]
            kept = [x[stays] for x in kept]
            kept[3] = np.zeros(len(kept[3]), bool)
            waiting = [kept]
        a, b = _compare(*(np.concatenate(x) for x in zip(*waiting, strict=True)), within)
        yield pa.record_batch([a, b], ["a", "b"])

    importable(prints.sparkSession)
    near = prints.select("fp").mapInArrow(spread, "grp long, fp long, home boolean, member boolean")
    counted = prints.select("fp").mapInArrow(at_home, "anchor long").groupBy("anchor").count().where(F.col("count") > hot_homes)
    hot = written(counted.select(F.col("anchor").alias("grp"), F.ceil(F.col("count") / hot_homes).alias("parts")))
    if hot.limit(1).count():
        one = F.pmod(F.xxhash64("fp"), F.col("parts"))
        part = F.explode(F.when(F.col("home") & (F.col("parts") > 1), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(one)))
        dealt = near.join(hinted(hot, BROADCAST_HOT), "grp", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
        dealt = dealt.withColumn("part", part)
        group = F.when(F.col("parts") > 1, F.xxhash64("grp", "part")).otherwise(F.col("grp"))
        near = dealt.select(group.alias("grp"), "fp", "home", (F.col("part") == one).alias("member"))
    near = near.repartition("grp").sortWithinPartitions("grp", F.col("home").desc())
    return near.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, within: int = 2, seed: int = 42) -> DataFrame:
    """Returns (doc_id, fingerprint, component_id) for every row of ``docs``.

    Texts are lower-cased (A-Z), split at ASCII white space and hashed by shingles of ``words`` words (repeats
    count; a shorter text is one shingle; a null or empty one has fingerprint 0, which is linked like any other).
    Documents link if their fingerprints differ in ``within`` or fewer bits; component_id is the least doc_id
    reachable. Equal fingerprints are taken together first, so groups of copies cost one row. Repeated rows stay
    repeated; a null doc_id keeps its row and is no component's id unless all of that component are null.
    """
    prints = written(with_fingerprint(docs, doc_id, text, words, seed))
    least = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = written(connected_components(near_links(least, within), "a", "b"))
    of = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least_of = written(of.groupBy("root").agg(F.min("least").alias("component_id")))
    component = written(of.join(least_of, "root").select("fp", "component_id"))
    return prints.join(component, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
