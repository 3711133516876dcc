"""Which transcript owns each stretch of a sequence: the upper envelope of intervals by transcript id."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.session import importable

#: (transcript, start, stop, phase, n, total): an exon or intron as ``labels.pieces`` has it, with n 0 for introns.
Piece = tuple[str, int, int, int, int, int]
#: Rows that a task holds before it reduces them.
HELD = 1 << 14
#: Positions of all bins together that a task paints at once, and for each row.
PAINTED = 1 << 22
FOR_A_ROW = 1 << 10
#: Rows of a bin, on average, from which a task reduces them before the shuffle.
DEPTH = 2
_NAMES = ["seqid", "strand", "bin", "low", "high", "tx_id", "start", "stop", "phase", "n", "total"]


class _Active:
    """A piece in the sweep; that of the largest transcript id comes first."""

    __slots__ = ("high", "piece")

    def __init__(self, high: int, piece: Piece) -> None:
        self.high, self.piece = high, piece

    def __lt__(self, other: _Active) -> bool:
        return self.piece[0] > other.piece[0]


def envelope(rows: Iterable[tuple[int, int, Piece]]) -> list[tuple[int, int, Piece]]:
    """The stretches (low, high, piece) of ``rows`` that no row of a larger transcript covers, by a sweep with a heap.

    Where a transcript's own pieces overlap, each of them has the stretch. The envelope of envelopes is that of all rows.
    """
    rows = sorted(set(rows))
    out: list[tuple[int, int, Piece]] = []
    ends: dict[Piece, int] = {}
    heap: list[_Active] = []
    i = 0
    for at, after in pairwise(sorted({r[0] for r in rows} | {r[1] + 1 for r in rows})):
        while i < len(rows) and rows[i][0] == at:
            heapq.heappush(heap, _Active(rows[i][1], rows[i][2]))
            i += 1
        tops: list[_Active] = []
        while heap and (not tops or heap[0].piece[0] == tops[0].piece[0]):
            x = heapq.heappop(heap)
            if x.high >= at:
                tops.append(x)
        for x in tops:
            heapq.heappush(heap, x)
            k = ends.get(x.piece)
            if k is not None and out[k][1] == at - 1:
                out[k] = (out[k][0], after - 1, x.piece)
            else:
                ends[x.piece] = len(out)
                out.append((at, after - 1, x.piece))
    return out


def _batch(schema: pa.Schema, keys: list[tuple], rows: list[list[tuple[int, int, Piece]]]) -> pa.RecordBatch:
    flat = [(*key, low, high, *piece) for key, own in zip(keys, rows, strict=True) for low, high, piece in own]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*flat, strict=True), schema, strict=True)] if flat else [pa.array([], f.type) for f in schema], _NAMES)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[tuple, tuple[int, int, Piece]]]:
    for x in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
        yield x[:3], (x[3], x[4], x[5:])


def _new_keys(rows: pa.RecordBatch) -> np.ndarray:
    """Whether each row's bin is another one than that of the row before."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in _NAMES[:3]:
        codes = rows.column(c).dictionary_encode().indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _bins(rows: pa.RecordBatch) -> int:
    """How many bins the rows are in."""
    seqid, strand = (rows.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in _NAMES[:2])
    at = rows.column("bin").to_numpy()
    return len(np.unique((seqid * (strand.max() + 1) + strand) * (at.max() - at.min() + 1) + at - at.min()))


def _swept(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The envelope of each bin by sweeps."""
    held: dict[tuple, list] = defaultdict(list)
    for key, row in _rows(rows):
        held[key].append(row)
    return _batch(rows.schema, list(held), [envelope(x) if len(x) > 1 else x for x in held.values()])


def reduced(rows: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """The rows' ``envelope`` in each bin of ``width`` positions, sorted by bin.

    A bin's only row is final. Bins that are full of rows are painted, ``PAINTED`` positions at once: an array has the last row, by transcript,
    at each position. Those where rows of one transcript overlap, and few rows in wide bins, are swept.
    """
    keys = [*_NAMES[:3], "tx_id", "low"]
    rows = pa.record_batch(rows.columns, _NAMES)
    rows = rows.take(pc.sort_indices(rows, [(k, "ascending") for k in keys]))
    new = _new_keys(rows)
    group = np.cumsum(new) - 1
    low, high = rows.column("low").to_numpy(), rows.column("high").to_numpy()
    tx = rows.column("tx_id").dictionary_encode().indices.to_numpy()
    same = ~new[1:] & (tx[1:] == tx[:-1])
    # Rows of one transcript come by their begin, so overlapping ones have neighbours that overlap.
    crossed = np.zeros(group[-1] + 1, bool)
    crossed[group[1:][same & (low[1:] <= high[:-1])]] = True
    alone = np.bincount(group) == 1
    few = ~alone & (np.bincount(group) * FOR_A_ROW < width)
    swept = (crossed | few)[group]
    out = [rows.filter(pa.array(alone[group]))] if alone.any() else []
    if swept.any():
        out.append(_swept(rows.filter(pa.array(swept))))
    own = np.flatnonzero(~swept & ~alone[group])
    # Bins that are painted, numbered from 0, and so many of them at once.
    bins = np.cumsum(np.diff(group[own], prepend=-1) != 0) - 1
    most = max(1, PAINTED // width)
    for i in range(0, int(bins[-1]) + 1 if len(own) else 0, most):
        now = slice(*np.searchsorted(bins, (i, i + most)))
        out.append(_painted(rows, own[now], bins[now] - i, width))
    if len(out) == 1:
        return out[0]
    both = pa.Table.from_batches(out).combine_chunks()
    return both.take(pc.sort_indices(both, [(k, "ascending") for k in _NAMES[:3]])).combine_chunks().to_batches()[0]


def _painted(rows: pa.RecordBatch, own: np.ndarray, bins: np.ndarray, width: int) -> pa.RecordBatch:
    """The envelope of the rows ``own``, which come by their ``bins`` (from 0) and transcripts, by arrays."""
    low, n = rows.column("low").to_numpy()[own], (rows.column("high").to_numpy() - rows.column("low").to_numpy() + 1)[own]
    base = rows.column("bin").to_numpy()[own] * width + 1
    place = np.repeat(bins * width + low - base - np.cumsum(n) + n, n) + np.arange(n.sum())
    top = np.full((bins[-1] + 1) * width, -1, np.int64)
    # Rows come by transcript, and of several values for a place the last one holds.
    top[place] = np.repeat(own, n)
    edge = np.ones(len(top), bool)
    edge[1:] = (top[1:] != top[:-1]) | (np.arange(1, len(top)) % width == 0)
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(top)) - 1
    begin, end = begin[top[begin] >= 0], end[top[begin] >= 0]
    found = rows.take(pa.array(top[begin]))
    start = found.column("bin").to_numpy() * width + 1
    bounds = {"low": pa.array(start + begin % width), "high": pa.array(start + end % width)}
    return pa.record_batch([bounds.get(c, found.column(c)) for c in _NAMES], _NAMES)


def stretches(pieces: DataFrame, width: int) -> DataFrame:
    """(seqid, strand, bin, low, high, tx_id, start, stop, phase, n, total): who owns what of each bin of ``width`` positions (from 1).

    ``pieces``: as ``labels.pieces`` gives them. Of pieces that cover a position that of the larger transcript id holds it. The other columns
    are the piece's own. A bin has ``width`` stretches at most, if no transcript's own pieces overlap, however deep it is covered: tasks
    reduce their rows of each bin before the shuffle, and again as they meet, holding ``HELD`` rows and a bin's stretches.
    """
    importable(pieces.sparkSession)
    bins = F.explode(F.sequence(F.floor((F.col("start") - 1) / width), F.floor((F.col("stop") - 1) / width))).alias("bin")
    rows = pieces.select("seqid", "strand", bins, "tx_id", "start", "stop", F.col("phase").cast("int").alias("phase"), F.coalesce("n", F.lit(0)).cast("int").alias("n"), F.col("total").cast("int").alias("total"))
    rows = rows.withColumns({"low": F.greatest("start", F.col("bin") * width + 1), "high": F.least("stop", (F.col("bin") + 1) * width)}).select(*_NAMES)
    schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">")
    longs, ints = ("bin", "low", "high", "start", "stop"), ("phase", "n", "total")
    arrow = pa.schema([(n, pa.int64() if n in longs else pa.int32() if n in ints else pa.string()) for n in _NAMES])

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(pa.record_batch(batch.columns, _NAMES))
            if sum(x.num_rows for x in held) >= HELD:
                yield less_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
        if sum(x.num_rows for x in held):
            yield less_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def less_of(some: pa.RecordBatch) -> pa.RecordBatch:
        """What is dealt over so many bins that few would be lost goes on as it is."""
        return reduced(some, width) if some.num_rows > DEPTH * _bins(some) else some

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(pa.record_batch(batch.columns, _NAMES))
            n = sum(x.num_rows for x in held)
            if n < HELD:
                continue
            whole = reduced(pa.Table.from_batches(held).combine_chunks().to_batches()[0], width)
            # Rows come by bin: all but those of the last bin are final.
            last = np.flatnonzero(_new_keys(whole))[-1]
            if last:
                yield whole.slice(0, last)
            held = [whole.slice(last)]
        if sum(x.num_rows for x in held):
            yield reduced(pa.Table.from_batches(held).combine_chunks().to_batches()[0], width)

    less = rows.mapInArrow(before, schema)
    return less.repartition("seqid", "strand", "bin").sortWithinPartitions("seqid", "strand", "bin").mapInArrow(meet, schema)
