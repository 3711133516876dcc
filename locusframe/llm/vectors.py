"""Near-duplicates among embeddings: coarse lists, product codes and exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm._common import drawn, hinted, written
from locusframe.llm.components import connected_components
from locusframe.llm.simhash import forest
from locusframe.session import importable

#: Candidate pairs that are compared at a time in one task.
PAIRS_AT_ONCE = 200_000
#: The sizes of all lists of all labels are broadcast up to this many rows (of 40 bytes).
BROADCAST_LISTS = 200_000


def _lloyd(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centres of ``rows``; starts at rows spread evenly over a fixed permutation."""
    k = min(k, len(rows))
    centres = rows[np.random.default_rng(3).permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(rows, centres)
        count = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


@dataclass
class ProductIndex:
    """Coarse centres, and for each of ``parts`` subspaces the codebook of residuals."""

    coarse: np.ndarray
    books: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, parts: int, codes: int) -> ProductIndex:
        """Fits the coarse centres, then the codebooks on what they leave."""
        coarse = _lloyd(sample, lists)
        rest = sample - coarse[_nearest(sample, coarse)]
        return cls(coarse, [_lloyd(x, codes) for x in np.array_split(rest, parts, axis=1)])

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = _nearest(rows, self.coarse)
        parts = np.array_split(rows - self.coarse[own], len(self.books), axis=1)
        return own, np.stack([_nearest(x, b) for x, b in zip(parts, self.books, strict=True)], axis=1).astype(np.uint8)

    def decode(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.coarse[own] + np.hstack([b[codes[:, i]] for i, b in enumerate(self.books)])

    @cached_property
    def apart(self) -> np.ndarray:
        """Distances of all centres, rounded up a little so that no list is missed: once for an index, four bytes a pair."""
        square = (self.coarse**2).sum(axis=1)
        return (np.sqrt(np.maximum(square[:, None] + square - 2 * self.coarse @ self.coarse.T, 0)) + 1e-5).astype(np.float32)

    def probes(self, rows: np.ndarray, own: np.ndarray, reach: float) -> list[np.ndarray]:
        """For each row its own list and all others beyond a plane that is at most ``reach`` away.

        A vector of list c is no farther from c than from the row's own centre o, so it is beyond the plane halfway
        between them. The way between two vectors of different lists crosses the plane between their centres, so one
        of both is at most half their distance from it.
        """
        square = (rows**2).sum(axis=1)[:, None] + (self.coarse**2).sum(axis=1) - 2 * rows @ self.coarse.T
        near = square - square[np.arange(len(rows)), own][:, None] <= 2 * reach * self.apart[own] + 1e-9
        near[np.arange(len(rows)), own] = True
        return [np.flatnonzero(x) for x in near]


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(float)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares of very small or large numbers would be lost
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))


def near_vectors(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98, deviations: float = 4.0,
    list_size: int = 500, max_lists: int = 4_096, parts: int = 16, codes: int = 64, sample_rows: int = 16_384, part_rows: int = 4_000,
) -> DataFrame:
    """Returns (vec_id, n_links, component_id, kept) for every row: links of cosine >= ``cosine`` within one label.

    Vectors that are null or zero or hold null or non-finite components, and rows without a label, have no links
    and are their own components. Each length of vectors is searched apart. Repeated rows stay repeated, and count
    as links of each other; a null vec_id keeps its row.

    Equal vectors of one label (by a 128-bit hash) are taken together first, as they all link to each other, so a group
    of copies costs one row. The index is fitted on ``sample_rows`` of the distinct vectors at most, drawn by a hash;
    it has a coarse list for about ``list_size`` vectors of a label, ``max_lists`` at most. All vectors are coded: the
    nearest centre, and the residual as ``parts`` codes of ``codes`` values. Each is looked for in its own list and in
    every other one beyond a plane that is near enough (see ``probes``; no fixed number). Near enough is half of
    ``deviations`` times what a random step of the links' greatest length has along one direction: so a link is lost
    only if its step is that far from random (within the whole step, if the length of vectors makes that less, none is).
    In a list, a table of the vector's distances to all codes estimates its distance to each member. Members whose
    estimate is beyond the reach by more than their own coding error are left out (that bound is exact); the rest are
    reranked by exact cosine in double precision. Tasks return counts and a spanning forest, not all pairs. A list's
    searches are dealt over tasks of ``part_rows``, each with ``part_rows`` of its members.
    """
    kind = dict(rows.dtypes)[vector]
    base = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<float>" if kind == "array<float>" else "array<double>").alias("v"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & sound & F.exists("v", lambda x: x != 0), F.lit(False))
    plain = F.transform(F.when(usable, F.col("v")), lambda x: x + 0.0)  # one zero only
    base = base.withColumn("v", plain.cast(dict(base.dtypes)["v"]))
    base = written(base.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v"), "row": F.monotonically_increasing_id()}))
    slim = base.where("v is not null").select("row", "vec_id", "label", "h1", "h2", F.size("v").alias("size"))
    groups = written(
        slim.groupBy("label", "h1", "h2", "size").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    )
    vectors = base.where("v is not null").join(groups.select(F.col("node").alias("row"), "copies"), "row").select(F.col("row").alias("node"), "label", "copies", "v")
    found_counts, found_links = [], []
    for n, most, nodes in groups.groupBy("size", "label").count().groupBy("size").agg(F.max("count"), F.sum("count")).orderBy("size").collect():
        lists = min(max_lists, max(8, most // list_size))
        sample = vectors.where(F.size("v") == n).where(drawn(sample_rows, nodes, "index", "node")).limit(2 * sample_rows)
        index = ProductIndex.fit(_unit(np.stack(sample.orderBy("node").toPandas()["v"])), lists, min(parts, n), codes) if nodes else None
        step = np.sqrt(2 - 2 * cosine)
        probe = float(step / 2 * min(1.0, deviations / np.sqrt(n)))
        counts, links = _search(vectors.where(F.size("v") == n), index, n, cosine, float(step), probe, part_rows)
        found_counts.append(counts)
        found_links.append(links)
    single = base.where("v is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    if not found_counts:
        return single
    counts, links = found_counts[0], found_links[0]
    for c, e in zip(found_counts[1:], found_links[1:], strict=True):
        counts, links = counts.union(c), links.union(e)
    roots = connected_components(links, "a", "b").withColumnRenamed("node", "own")
    rooted = groups.join(roots, groups["node"] == roots["own"], "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted.select("label", "h1", "h2", "size", "node", "copies", "least", "root"))
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    totals = counts.groupBy("node").agg(F.sum("n").alias("n"))
    of = written(
        rooted.join(least, "root").join(totals, "node", "left")
        .select("label", "h1", "h2", "size", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    )
    linked = slim.join(of, ["label", "h1", "h2", "size"]).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
    return linked.unionByName(single)


def _search(vectors: DataFrame, index: ProductIndex, n: int, cosine: float, reach: float, probe: float, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """Counts (node, n) of linked other vectors and links (a, b) among distinct vectors (node, label, copies, v) of length ``n``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector with its list, code and coding error, and the lists to look in."""
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                rows = _unit(part.column(3).flatten().to_numpy().reshape(-1, n))
                own, coded = index.encode(rows)
                error = np.sqrt(((rows - index.decode(own, coded)) ** 2).sum(axis=1))
                lists = pa.array([x.astype(np.int32) for x in index.probes(rows, own, probe)], pa.list_(pa.int32()))
                coded = pa.array([x.tobytes() for x in coded], pa.binary())
                made = [*part.columns, pa.array(own.astype(np.int32)), pa.array(error), coded, lists]
                yield pa.record_batch(made, ["node", "label", "copies", "v", "own", "error", "code", "lists"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part, which has some members of one list and some of the vectors looked for in it."""
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if kept and batch.num_rows and batch["key"][0] == batch["key"][-1] == kept[-1]["key"][-1]:  # one part goes on
                kept.append(batch)
                continue
            table = pa.Table.from_batches([*kept, batch]).combine_chunks()
            keys = table["key"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            yield from _links(table.slice(0, cut), keys[:cut], index, n, cosine, reach)
            kept = table.slice(cut).to_batches()
        if kept:
            table = pa.Table.from_batches(kept).combine_chunks()
            yield from _links(table, table["key"].to_numpy(), index, n, cosine, reach)

    importable(vectors.sparkSession)
    kinds = dict(vectors.dtypes)
    placed = vectors.select("node", "label", "copies", "v").mapInArrow(
        place, f"node long, label {kinds['label']}, copies long, v {kinds['v']}, own int, error double, code binary, lists array<int>"
    )
    placed = written(placed)
    looked = placed.select("label", F.explode("lists").alias("list"), (F.col("list") == F.col("own")).cast("long").alias("m"))
    size = looked.groupBy("label", "list").agg(F.sum("m").alias("m"), F.count("*").alias("q"))
    size = written(size.where("m > 0").select("label", "list", F.ceil(F.col("m") / part_rows).alias("rows"), F.ceil(F.col("q") / part_rows).alias("cols")))
    zero = F.lit(0).cast("long")
    dealt = lambda df: df.join(hinted(size, BROADCAST_LISTS), ["label", "list"])
    members = dealt(placed.withColumn("list", F.col("own"))).withColumn("r", F.pmod(F.xxhash64("node"), F.col("rows")))
    members = members.withColumn("c", F.explode(F.sequence(zero, F.col("cols") - 1)))
    queries = dealt(placed.withColumn("list", F.explode("lists"))).withColumn("c", F.pmod(F.xxhash64("node", F.lit(1)), F.col("cols")))
    queries = queries.withColumn("r", F.explode(F.sequence(zero, F.col("rows") - 1)))
    key = F.xxhash64("label", "list", "r", "c").alias("key")
    shared = [key, F.xxhash64("label").alias("label"), "list", "own", "node", "copies", "v"]
    as_member = members.select(F.lit(True).alias("member"), *shared, "error", "code", "lists")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("error", "double"), ("code", "binary"), ("lists", "array<int>"))]
    as_query = queries.select(F.lit(False).alias("member"), *shared, *none)
    out = written(as_member.union(as_query).repartition("key").sortWithinPartitions("key").mapInArrow(search, "a long, b long, n long"))
    counts = out.where("n > 0").select(F.col("a").alias("node"), "n")
    return counts, out.where("b is not null").select("a", "b")


def _links(table: pa.Table, keys: np.ndarray, index: ProductIndex, n: int, cosine: float, reach: float) -> Iterator[pa.RecordBatch]:
    """For whole parts: how many vectors each one links with, and a spanning forest of those links.

    A pair of different lists may be found from both sides; it counts in the lower list only, if so.
    """
    if not len(keys):
        return
    column = lambda name: table[name].combine_chunks().to_numpy(zero_copy_only=False)
    label, cell, own, node, copies, member, error = (column(c) for c in ("label", "list", "own", "node", "copies", "member", "error"))
    raw, code, lists = table["v"].combine_chunks(), table["code"].combine_chunks(), table["lists"].combine_chunks()
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        members, queries = np.flatnonzero(member[i:j]) + i, np.flatnonzero(~member[i:j]) + i
        if not len(members) or len(queries) == 0 or j - i < 3:  # a lone member finds itself
            continue
        rows = _unit(raw.slice(i, j - i).flatten().to_numpy().reshape(-1, n))
        coded = np.frombuffer(b"".join(code.take(pa.array(members)).to_pylist()), np.uint8).reshape(len(members), -1)
        back = [frozenset(x) for x in lists.take(pa.array(members)).to_pylist()]
        step = max(1, PAIRS_AT_ONCE // len(members))
        for k in range(0, len(queries), step):
            q = queries[k : k + step]
            rest = np.array_split(rows[q - i] - index.coarse[cell[q]], len(index.books), axis=1)
            far = np.zeros((len(q), len(members)))
            for s, (x, book) in enumerate(zip(rest, index.books, strict=True)):
                lookup = (x**2).sum(axis=1)[:, None] + (book**2).sum(axis=1) - 2 * x @ book.T
                far += lookup[:, coded[:, s]]
            near = np.sqrt(np.maximum(far, 0)) <= reach + error[members] + 1e-7
            near &= (node[q][:, None] != node[members]) & (label[q][:, None] == label[members]) & (cell[q][:, None] == cell[members])
            a, b = np.nonzero(near)
            exact = (rows[q[a] - i] * rows[members[b] - i]).sum(axis=1) >= cosine
            a, b = q[a[exact]], b[exact]
            other = own[a] != cell[a]
            twice = np.fromiter((x in back[y] for x, y in zip(own[a[other]], b[other], strict=True)), bool, int(other.sum()))
            keep = np.ones(len(a), bool)
            keep[other] = ~twice | (cell[a[other]] < own[a[other]])
            a, b = a[keep], members[b[keep]]
            if not len(a):
                continue
            # From one list only: the other side's count is added here; within a list both sides look.
            across = own[a] != cell[a]
            ends, gains = np.r_[node[a], node[b[across]]], np.r_[copies[b], copies[a[across]]]
            hit, at = np.unique(ends, return_inverse=True)
            linked = np.zeros(len(hit), np.int64)
            np.add.at(linked, at, gains)
            u, v = forest(node[a], node[b])
            yield pa.record_batch(
                [pa.array(np.r_[hit, u]), pa.array([None] * len(hit) + v.tolist(), pa.int64()), pa.array(np.r_[linked, np.zeros(len(u), np.int64)])],
                ["a", "b", "n"],
            )
