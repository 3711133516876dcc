"""Gene decoding: the best path through a grammar of the 15 labels, exact for sequences of any length, and gene models from it.

A sequence is cut into blocks. The path's score over a block, by its state before and at the end, is a max-plus matrix; products of
a vector with these matrices give the scores at all block borders, and from them each block is decoded in a task of its own.
Scores are whole numbers (millionths of a log), so sums are exact in any order and the result doesn't depend on the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.genome import stop_report
from locusframe.functions.sequence import revcomp
from locusframe.operators.intervals import running_all
from locusframe.session import importable, stored

STATES = 15
INTERGENIC, START, STOP = 0, 7, 14
INTRONS, EXON_ENDS, EXON_BEGINS = (1, 2, 3), (8, 9, 10), (11, 12, 13)
#: Which states may follow a state. An exon that ends in frame 1, 2, 0 has the intron label 1, 2, 3, and the next exon begins in the
#: frame after. Start and stop codons are not split, and exons have two bases at least.
STEPS = {
    0: (0, 7), 1: (1, 11), 2: (2, 12), 3: (3, 13), 4: (5, 8), 5: (6, 9, 14), 6: (4, 10), 7: (5,),
    8: (1,), 9: (2,), 10: (3,), 11: (4, 10), 12: (5, 8), 13: (6, 9), 14: (0,),
}
#: The frame of each exon state.
FRAME = {4: 0, 7: 0, 10: 0, 12: 0, 5: 1, 8: 1, 13: 1, 6: 2, 9: 2, 11: 2, 14: 2}
UNIT = 1_000_000
NEVER = -(1 << 60)
#: Bases on each side of a block that the masks look at.
REACH = 2
DONORS, ACCEPTORS = ("GT", "GC"), ("AG",)
#: Positions of padded blocks that a task decodes at a time, as one batch.
CELLS = 1 << 17
#: Positions of both strands that one task decodes.
TASK = 1 << 19
#: Bases of the longest sequence that is decoded in one pass, and positions of both strands of such ones in one task.
WHOLE, WHOLE_TASK = 1 << 13, 1 << 21

Scorer = Callable[[list[str]], np.ndarray]


def gene_moves(exon: float = 200, intron: float = 4500, between: float = 10_000) -> np.ndarray:
    """Scores of all steps (15 x 15) for exons, introns and intergenic stretches of these mean lengths; NEVER where there is no step."""
    out = np.full((STATES, STATES), NEVER, np.int64)
    for state, after in STEPS.items():
        leave = 1 / (between if state == 0 else intron if state in INTRONS else exon)
        goes_on = after[0]
        for to in after:
            p = 1.0 if len(after) == 1 else 1 - leave if to == goes_on else leave / (len(after) - 1)
            out[state, to] = round(UNIT * float(np.log(p)))
    return out


def class_scores(probabilities: np.ndarray, epsilon: float = 0.01) -> np.ndarray:
    """Scores of states for class probabilities [..., 15]: a state shows its own class but for ``epsilon``, dealt equally to the others."""
    p = np.asarray(probabilities, np.float64)
    mixed = (1 - epsilon) * p + epsilon / (STATES - 1) * (p.sum(axis=-1, keepdims=True) - p)
    return np.round(UNIT * np.log(np.maximum(mixed, 1e-12))).astype(np.int64)


#: The states before each state, in order.
_BEFORE = [[s for s, after in STEPS.items() if to in after] for to in range(STATES)]
#: The first, second and third of them; a state with fewer has its first again. State 5 alone has three.
_WAYS = np.array([[x[k] if k < len(x) else x[0] for k in range(3)] for x in _BEFORE])
_THIRD = _BEFORE[5][2]
_OTHER = np.arange(256, dtype=np.uint8)
_OTHER[list(b"ACGTNacgtn")] = list(b"TGCANtgcan")
_CODE = np.full(256, 4, np.int64)
for _i, _base in enumerate("ACGT"):
    _CODE[ord(_base)] = _CODE[ord(_base.lower())] = _i


def _is_one(codes: np.ndarray, at: int, n: int, words: Sequence[str]) -> np.ndarray:
    """Whether the letters from ``at`` of each of ``n`` places on are one of ``words`` (of one length)."""
    wanted = np.zeros(5 ** len(words[0]), bool)
    wanted[[sum(int(_CODE[ord(c)]) * 5**k for k, c in enumerate(w)) for w in words]] = True
    return wanted[sum(codes[:, at + k : at + k + n] * 5**k for k in range(len(words[0])))]


def masked_scores(scores: np.ndarray, letters: np.ndarray, donors: Sequence[str] = DONORS, acceptors: Sequence[str] = ACCEPTORS) -> tuple[np.ndarray, np.ndarray]:
    """Scores [n, length, 15] with NEVER where the sequence forbids a state, and whether each place ends a stop codon.

    ``letters`` [n, length + 4] has two more bases on each side (bytes). A start needs ATG from its place on, a stop state a stop codon
    that ends there, an exon's last base a donor after it, its first an acceptor before it.
    """
    n = scores.shape[1]
    codes = _CODE[letters]
    stops = _is_one(codes, 0, n, ("TAA", "TAG", "TGA"))
    out = scores.astype(np.int64)
    out[..., START][~_is_one(codes, REACH, n, ("ATG",))] = NEVER
    out[..., STOP][~stops] = NEVER
    for states, bad in ((EXON_ENDS, ~_is_one(codes, REACH + 1, n, donors)), (EXON_BEGINS, ~_is_one(codes, 0, n, acceptors))):
        for s in states:
            out[..., s][bad] = NEVER
    return out, stops


def forward(entry: np.ndarray, scores: np.ndarray, stops: np.ndarray, lengths: np.ndarray, moves: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Best scores at the end of each of n blocks for entry vectors [n, rows, 15]; with ``keep``, also the ways taken, [length, 15, n], for ``paths``.

    A step doesn't go from state 5 to 6 or 9 where a stop codon ends. Of steps as good that from the lower state holds; ways
    are those of the first row. Blocks shorter than the longest are padded; ``lengths`` has their own. All states go one place
    on together: each has two states before it (the same one twice, if it has one), and state 5 a third.
    """
    n, length = scores.shape[:2]
    rows = entry.shape[1]
    now = np.ascontiguousarray(np.moveaxis(entry, 2, 0)).astype(np.int64)
    one, two = np.empty_like(now), np.empty_like(now)
    each = np.ascontiguousarray(np.moveaxis(scores, 0, 2))
    back = np.zeros((length, STATES, n), np.int8) if keep else None
    every, states = np.arange(STATES), (_WAYS[:, 0], _WAYS[:, 1])
    # Spread out once: an array goes into a sum or maximum faster than one number a row.
    first, second = (np.ascontiguousarray(np.broadcast_to(moves[x, every][:, None, None], now.shape)) for x in states)
    least = np.full(now.shape, NEVER, np.int64)
    third, shortest = moves[_THIRD, 5], int(lengths.min()) if n else 0
    place, stop = np.nonzero(stops.T)
    bounds = np.searchsorted(place, np.arange(length + 1)).tolist()
    for t in range(length):
        np.add(np.take(now, states[0], axis=0, out=one, mode="clip"), first, out=one)
        np.add(np.take(now, states[1], axis=0, out=two, mode="clip"), second, out=two)
        if bounds[t] < bounds[t + 1]:
            # State 5 is the first one before both 6 and 9.
            ended = stop[bounds[t] : bounds[t + 1]]
            one[6, ended] = NEVER
            one[9, ended] = NEVER
        last = now[_THIRD] + third
        if back is not None:
            np.greater(two[:, :, 0], one[:, :, 0], out=back[t].view(bool))
        np.maximum(one, two, out=one)
        if back is not None:
            back[t, 5][last[:, 0] > one[5, :, 0]] = 2
        np.maximum(one[5], last, out=one[5])
        one += each[t][:, :, None]
        np.maximum(one, least, out=one)
        if t >= shortest:
            over = np.flatnonzero(lengths <= t)
            one[:, over] = now[:, over]
        now, one = one, now
    return np.moveaxis(now, 0, 2).reshape(n, rows, STATES), back


def paths(back: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The states [n, exits, 1 + length] on the paths that end in ``ends`` [n, exits]; the first is the state before the block."""
    length, _, n = back.shape
    out = np.zeros((length + 1, n, ends.shape[1]), np.int8)
    now, rows = ends.astype(np.int64), np.arange(n)[:, None]
    ways, flat, shortest = _WAYS.ravel(), back.reshape(length, -1), int(lengths.min()) if n else 0
    for t in range(length - 1, -1, -1):
        before = ways[now * 3 + flat[t][now * n + rows]]
        if t >= shortest:
            live = (lengths > t)[:, None]
            out[t + 1] = np.where(live, now, 0)
            now = np.where(live, before, now)
        else:
            out[t + 1] = now
            now = before
    out[0] = now
    return np.moveaxis(out, 0, 2)


def decode(sequence: str, scorer: Scorer, moves: np.ndarray, ends: Sequence[int] = (INTERGENIC, STOP)) -> tuple[int, np.ndarray]:
    """(score, states) of one sequence as one block, from an intergenic state before it."""
    padded = "N" * REACH + sequence + "N" * REACH
    letters = np.frombuffer(padded.encode(), np.uint8)[None]
    scores, stops = masked_scores(scorer([padded])[:, REACH:-REACH], letters)
    entry = np.full((1, 1, STATES), NEVER, np.int64)
    entry[0, 0, INTERGENIC] = 0
    lengths = np.array([len(sequence)])
    best, back = forward(entry, scores, stops, lengths, moves, keep=True)
    end = max(ends, key=lambda s: (best[0, 0, s], -s))
    return int(best[0, 0, end]), paths(back, lengths, np.array([[end]]))[0, 0, 1:]


def path_runs(states: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(kind, begin, end, first, last) of a path's runs: intergenic (0), introns by their label (1 to 3), exons (4); places from 0."""
    kind = np.minimum(states, 4)
    new = np.ones(len(states), bool)
    # An exon ends at its last state, so two exons never touch within a run.
    new[1:] = kind[1:] != kind[:-1]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(states)) - 1
    return list(zip(kind[begin].tolist(), begin.tolist(), end.tolist(), states[begin].tolist(), states[end].tolist(), strict=True))


# ---- Spark

KEYS = ["seq_name", "strand"]


def blocks(sequences: DataFrame, size: int, margin: int = REACH) -> DataFrame:
    """(seq_name, strand, block, last, first, length, total, letters): both strands of sequences (seq_name, sequence) in blocks of ``size``.

    ``first`` is a block's first position on its own strand, from 1; ``letters`` has ``margin`` more bases on each side, N beyond the
    sequence's ends. Sequences without letters have no blocks.
    """
    if margin < REACH:
        raise ValueError(f"the margin must be {REACH} at least")
    pad = F.lit("N" * margin)
    cuts = F.regexp_extract_all(F.concat(pad, "sequence", pad), F.lit(f"(?s)(?=(.{{1,{size + 2 * margin}}})).{{1,{size}}}"), F.lit(1))
    each = sequences.where(F.length("sequence") > 0).select("seq_name", F.length("sequence").cast("long").alias("total"), cuts.alias("cuts"))
    rows = each.select("seq_name", "total", F.posexplode("cuts").alias("i", "letters"))
    rows = rows.withColumn("count", F.ceil(F.col("total") / size)).where("i < count")
    length = F.least(F.lit(size).cast("long"), F.col("total") - F.col("i").cast("long") * size)
    both = rows.withColumns({"length": length, "strand": F.explode(F.array(F.lit("+"), F.lit("-")))})
    minus = F.col("strand") == "-"
    at = F.col("i").cast("long") * size
    block = F.when(minus, F.col("count") - 1 - F.col("i")).otherwise(F.col("i").cast("long"))
    return both.select(
        *KEYS, block.alias("block"), (block == F.col("count") - 1).alias("last"),
        F.when(minus, F.col("total") - at - F.col("length") + 1).otherwise(at + 1).alias("first"),
        F.col("length").cast("int").alias("length"), "total", F.when(minus, revcomp(F.col("letters"))).otherwise(F.col("letters")).alias("letters"),
    )


def packed(lengths: np.ndarray, cells: int = CELLS) -> Iterator[np.ndarray]:
    """Rows in batches of like lengths, each of ``cells`` padded positions at most (or one longer row)."""
    order = np.argsort(lengths, kind="stable")[::-1]
    i = 0
    while i < len(order):
        n = max(1, cells // max(1, int(lengths[order[i]])))
        yield order[i : i + n]
        i += n


def scored(letters: Sequence[str], lengths: np.ndarray, margin: int, scorer: Scorer) -> tuple[np.ndarray, np.ndarray]:
    """Padded scores and stop places of blocks of unlike lengths; the scorer gets those of one length together."""
    longest = int(lengths.max())
    scores, stops = np.zeros((len(letters), longest, STATES), np.int64), np.zeros((len(letters), longest), bool)
    for size in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == size)
        some = [letters[i] for i in at]
        codes = np.frombuffer("".join(some).encode(), np.uint8).reshape(len(at), -1)
        own = scorer(some)[:, margin : margin + size]
        scores[at, :size], stops[at, :size] = masked_scores(own, codes[:, margin - REACH : margin + size + REACH])
    return scores, stops


def _batches(batch: pa.RecordBatch, margin: int, scorer: Scorer, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, scores, stops, lengths) of a batch's blocks, in padded batches."""
    lengths, letters = batch.column("length").to_numpy(), batch.column("letters").to_pylist()
    chosen = np.arange(batch.num_rows) if wanted is None else np.flatnonzero(wanted)
    for part in packed(lengths[chosen]) if len(chosen) else ():
        at = chosen[part]
        yield at, *scored([letters[i] for i in at], lengths[at], margin, scorer), lengths[at]


def _vectors(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(-1, STATES)


def border_scores(table: DataFrame, scorer: Scorer, moves: np.ndarray, margin: int, begins: Sequence[int] = (INTERGENIC,)) -> DataFrame:
    """(seq_name, strand, block, entry): the best scores of all states before each block of a stored table of ``blocks``.

    Blocks become matrices in tasks of their own; then one stream a sequence and strand multiplies a vector through them: a row of 225
    numbers for each block, one vector in memory.
    """

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray | None] = [None] * batch.num_rows
            for at, scores, stops, lengths in _batches(batch, margin, scorer, ~batch.column("last").to_numpy(zero_copy_only=False)):
                entry = np.full((len(at), STATES, STATES), NEVER, np.int64)
                entry[:, np.arange(STATES), np.arange(STATES)] = 0
                for i, m in zip(at, forward(entry, scores, stops, lengths, moves)[0], strict=True):
                    out[i] = m.ravel()
            yield pa.record_batch([*(batch.column(c) for c in (*KEYS, "block")), pa.array(out, pa.list_(pa.int64()))], [*KEYS, "block", "matrix"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for batch in batches:
            entries = []
            for *own, m in zip(*(batch.column(c).to_pylist() for c in (*KEYS, "matrix")), strict=True):
                if own != key:
                    key, now = own, np.full(STATES, NEVER, np.int64)
                    now[list(begins)] = 0
                entries.append(now)
                if m is not None:
                    now = np.maximum((now[:, None] + np.array(m).reshape(STATES, STATES)).max(axis=0), NEVER)
            yield pa.record_batch([*(batch.column(c) for c in (*KEYS, "block")), pa.array(entries, pa.list_(pa.int64()))], [*KEYS, "block", "entry"])

    kinds = ", ".join(f"{c} {k}" for c, k in table.select(*KEYS, "block").dtypes)
    each = table.mapInArrow(matrices, f"{kinds}, matrix array<long>")
    return each.repartition(*KEYS).sortWithinPartitions(*KEYS, "block").mapInArrow(stream, f"{kinds}, entry array<long>")


RUN = "array<struct<kind:int,start:bigint,stop:bigint,first:int,last:int>>"


def _paths(scorer: Scorer, moves: np.ndarray, margin: int) -> Callable:
    """For blocks with entry vectors: a row for each state that a block's path may end in (those of array exits, or all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            entry = _vectors(batch.column("entry"))
            exits = batch.column("exits").to_pylist()
            first = batch.column("first").to_numpy()
            for at, scores, stops, lengths in _batches(batch, margin, scorer):
                best, back = forward(entry[at][:, None], scores, stops, lengths, moves, keep=True)
                ways = paths(back, lengths, np.broadcast_to(np.arange(STATES), (len(at), STATES)))
                rows, out = [], []
                for k, i in enumerate(at.tolist()):
                    for state in range(STATES) if exits[i] is None else exits[i]:
                        if best[k, 0, state] > NEVER // 2:
                            way = ways[k, state, : lengths[k] + 1]
                            runs = [(x, b + int(first[i]), e + int(first[i]), f, g) for x, b, e, f, g in path_runs(way[1:])]
                            rows.append(i)
                            out.append((state, int(way[0]), int(best[k, 0, state]), [dict(zip(("kind", "start", "stop", "first", "last"), r, strict=True)) for r in runs]))
                taken = batch.select([*KEYS, "block", "last", "total"]).take(pa.array(rows, pa.int64()))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], [], []), (pa.int32(), pa.int32(), pa.int64(), kind), strict=True)]
                yield pa.record_batch([*taken.columns, *columns], [*taken.schema.names, "leave", "came", "score", "runs"])

    return run


def _whole(scorer: Scorer, moves: np.ndarray, size: int, margin: int, ends: Sequence[int]) -> Callable:
    """For sequences (seq_name, sequence): the rows of ``decoded_blocks``, from one pass over each strand of a whole sequence."""
    exits = np.array(sorted(ends))

    def letters_of(texts: list[bytes], longest: int) -> np.ndarray:
        """Both strands (plus first) as bytes, with ``margin`` N before and N after."""
        out = np.full((2 * len(texts), longest + 2 * margin), ord("N"), np.uint8)
        for i, text in enumerate(texts):
            own = np.frombuffer(text, np.uint8)
            out[i, margin : margin + len(own)] = own
            out[len(texts) + i, margin : margin + len(own)] = _OTHER[own[::-1]]
        return out

    def scored_blocks(letters: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each block is scored by itself, with its margins; those of one length together."""
        n, longest = len(letters), letters.shape[1] - 2 * margin
        scores, stops = np.zeros((n, longest, STATES), np.int64), np.zeros((n, longest), bool)
        for own in np.unique(length).tolist():
            at = np.flatnonzero(length == own)
            r, place = row[at, None], start[at, None] + np.arange(own)
            some = letters[r, start[at, None] + np.arange(own + 2 * margin)]
            text, wide = some.tobytes().decode("ascii"), own + 2 * margin
            found = scorer([text[i : i + wide] for i in range(0, len(text), wide)])[:, margin : margin + own]
            scores[r, place], stops[r, place] = masked_scores(found, some[:, margin - REACH : margin + own + REACH])
        return scores, stops

    def decoded(names: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        total = np.tile([len(x) for x in texts], 2)
        n, count = len(total), -(-total // size)
        minus = np.arange(n) >= len(texts)
        # Blocks are cut on the plus strand, so the first one of the minus strand may be short.
        shift = np.where(minus, count * size - total, 0)
        row = np.repeat(np.arange(n), count)
        block = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = np.maximum(block * size - shift[row], 0)
        length = np.minimum((block + 1) * size - shift[row], total[row]) - start
        scores, stops = scored_blocks(letters_of(texts, int(total.max())), row, start, length)
        entry = np.full((n, 1, STATES), NEVER, np.int64)
        entry[:, 0, INTERGENIC] = 0
        best, back = forward(entry, scores, stops, total, moves, keep=True)
        end = exits[best[:, 0, exits].argmax(axis=1)]
        score = best[np.arange(n), 0, end]
        states = paths(back, total, end[:, None])[:, 0]
        path, column = states[:, 1:], np.arange(states.shape[1] - 1)
        kind = np.minimum(path, 4)
        new = (column + shift[:, None]) % size == 0
        new[:, 0] = True
        new[:, 1:] |= kind[:, 1:] != kind[:, :-1]
        new &= (column < total[:, None]) & (score > NEVER // 2)[:, None]
        at, begin = np.nonzero(new)
        stop = np.append(begin[1:], 0)
        stop[np.append(at[1:] != at[:-1], True)] = 0
        stop = np.where(stop == 0, total[at], stop)
        heads = np.flatnonzero((begin == 0) | ((begin + shift[at]) % size == 0))
        r, b = at[heads], (begin[heads] + shift[at[heads]]) // size
        fields = {"kind": kind[at, begin].astype(np.int32), "start": begin + 1, "stop": stop, "first": path[at, begin].astype(np.int32), "last": path[at, stop - 1].astype(np.int32)}
        runs = pa.StructArray.from_arrays([pa.array(c) for c in fields.values()], list(fields))
        return pa.record_batch([
            names.take(pa.array(r % len(texts))), pa.array(np.where(minus[r], "-", "+")).cast(pa.string()), pa.array(b), pa.array(total[r]), pa.array(states[r, begin[heads]].astype(np.int32)),
            pa.array(score[r], mask=b != count[r] - 1), pa.ListArray.from_arrays(pa.array(np.append(heads, len(at)).astype(np.int32)), runs),
        ], [*KEYS, "block", "total", "came", "score", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.encode("ascii", "replace") for x in batch.column("sequence").to_pylist()]
            for at in packed(np.array([2 * len(x) for x in texts])):
                yield decoded(batch.column("seq_name").take(pa.array(at)), [texts[i] for i in at])

    return run


def decoded_blocks(
    sequences: DataFrame, scorer: Scorer, moves: np.ndarray, size: int = 1 << 12, margin: int = REACH, ends: Sequence[int] = (INTERGENIC, STOP), whole: int = WHOLE
) -> DataFrame:
    """(seq_name, strand, block, total, came, score, runs): the best path of every sequence (seq_name, sequence) on both strands, as runs in each block.

    The path is that of one pass over the whole sequence (``decode``), whatever ``size`` is, if the scorer looks no further than ``margin``
    bases. A run has kind (0 intergenic, 1 to 3 intron, 4 exon), start and stop on its own strand, and the states at its ends; a run
    at a block's border may go on in the next block. ``came`` is the state before the block. ``score`` is the whole path's, in the sequence's last block, else null. A
    sequence must begin after an intergenic base and end in a state of ``ends``; seq_name must be unique. Empty sequences give no row.

    Sequences of up to ``whole`` bases are decoded in one pass inside a task (their blocks are only scored by themselves); longer ones
    by blocks in tasks of their own. Both have the same result.
    """
    if margin < REACH:
        raise ValueError(f"the margin must be {REACH} at least")
    n = F.length("sequence").cast("long")
    short = F.sum(F.when(n <= whole, 2 * n))
    positions, rest = sequences.agg(F.coalesce(short, F.lit(0)), F.coalesce(F.sum(F.when(n > whole, 2 * n)), F.lit(0))).first()
    out = []
    # Sequences are few bytes for their work, so they and blocks are dealt out by their number, not by bytes.
    if rest or not positions:
        table = blocks(sequences.where(n > whole), size, margin).repartition(max(1, -(-rest // TASK)), *KEYS, "block")
        out.append(decoded_table(stored(table), scorer, moves, margin, ends))
    if positions:
        importable(sequences.sparkSession)
        dealt = sequences.where((n > 0) & (n <= whole)).select("seq_name", "sequence").repartition(-(-positions // WHOLE_TASK), "seq_name")
        name = dict(dealt.dtypes)["seq_name"]
        out.append(dealt.mapInArrow(_whole(scorer, moves, size, margin, ends), f"seq_name {name}, strand string, block long, total long, came int, score long, runs {RUN}"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def decoded_table(table: DataFrame, scorer: Scorer, moves: np.ndarray, margin: int, ends: Sequence[int] = (INTERGENIC, STOP)) -> DataFrame:
    """``decoded_blocks`` for a stored table of blocks, such as ``parts.tile_blocks`` makes from files without a whole sequence in any row."""
    importable(table.sparkSession)
    entries = border_scores(table, scorer, moves, margin)
    rows = table.join(entries, [*KEYS, "block"]).withColumn("exits", F.when(F.col("last"), F.array(*map(F.lit, ends))))
    each = stored(rows.mapInArrow(_paths(scorer, moves, margin), f"{_kinds(table)}, last boolean, total long, leave int, came int, score long, runs {RUN}"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From a sequence's last block to its first: which of the block's paths is on the best one."""
        key, block, state, rows, whole = None, None, None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal state
            if rows:
                last = rows[0]["last"]
                own = max(rows, key=lambda r: (r["score"], -r["leave"])) if last else next(r for r in rows if r["leave"] == state)
                state = own["came"]
                whole.append((*key, block, own["leave"], own["score"] if last else None))
                rows.clear()
            if len(whole) >= 5_000:
                yield flush()

        def flush() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64())
            out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*whole, strict=True), kinds, strict=True)], [*KEYS, "block", "leave", "path_score"])
            whole.clear()
            return out

        for batch in batches:
            for row in batch.to_pylist():
                if (row["seq_name"], row["strand"]) != key or row["block"] != block:
                    yield from close()
                    key, block = (row["seq_name"], row["strand"]), row["block"]
                rows.append(row)
        yield from close()
        if whole:
            yield flush()

    slim = each.select(*KEYS, "block", "last", "leave", "came", "score").repartition(*KEYS).sortWithinPartitions(*KEYS, F.col("block").desc(), "leave")
    chosen = slim.mapInArrow(chain, f"{_kinds(table)}, leave int, path_score long")
    return each.join(chosen, [*KEYS, "block", "leave"]).select(*KEYS, "block", "total", "came", F.col("path_score").alias("score"), "runs")


def _kinds(table: DataFrame) -> str:
    return ", ".join(f"{c} {k}" for c, k in table.select(*KEYS, "block").dtypes)


def path_pieces(blocks_: DataFrame) -> DataFrame:
    """(seq_name, strand, total, kind, start, stop, first, last): the runs of all blocks, cut at block borders."""
    return blocks_.select(*KEYS, "total", F.explode("runs").alias("r")).select(*KEYS, "total", "r.*")


def state_at(run: Column, pos: Column) -> Column:
    """The state of a run at one of its positions: inside an exon by the frame of its first state."""
    frames = F.array(*(F.lit(FRAME.get(s, 0)) for s in range(STATES)))
    inner = 4 + (F.get(frames, run["first"]) + (pos - run["start"]).cast("int")) % 3
    return F.when(pos == run["start"], run["first"]).when(pos == run["stop"], run["last"]).when(run["kind"] < 4, run["kind"]).otherwise(inner).cast("int")


def _state_in(runs: Column, pos: Column) -> Column:
    return F.get(F.transform(F.filter(runs, lambda r: (r["start"] <= pos) & (pos <= r["stop"])), lambda r: state_at(r, pos)), F.lit(0))


def doubtful(first: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """(seq_name, window, code): block borders (the place after them on the plus strand) inside a gene, by strand: 0 plus, 1 minus, 2 both.

    ``table``: the ``blocks`` that ``first`` (``decoded_blocks``) was decoded from.
    """
    begins = first.join(table.select(*KEYS, "block", F.col("first").alias("at")), [*KEYS, "block"]).where("block > 0 and came != 0 and runs[0].first != 0")
    place = F.when(F.col("strand") == "-", F.col("total") + 2 - F.col("at")).otherwise(F.col("at"))
    sides = begins.groupBy("seq_name", place.alias("window")).agg(F.bool_or(F.col("strand") == "+").alias("plus"), F.bool_or(F.col("strand") == "-").alias("minus"))
    return sides.select("seq_name", "window", F.when(F.col("plus") & F.col("minus"), 2).when(F.col("minus"), 1).otherwise(0).alias("code"))


def predicted_again(
    sequences: DataFrame, first: DataFrame, scorer: Scorer, moves: np.ndarray, size: int, margin: int, evidence: DataFrame | None = None
) -> DataFrame:
    """Pieces (as ``path_pieces`` gives them) of the first result, with stretches around doubtful block borders scored and decoded again.

    ``evidence`` (seq_name, window, code) names borders and strands, as ``doubtful`` does, which is used if it is None. A window has half of
    ``size`` on each side of its border, so the scorer now sees what was cut; its path must leave and enter the first result in the states
    that this has at the window's ends, so the two always fit together. Windows of one strand don't overlap.
    """
    half = size // 2
    table = stored(blocks(sequences, size, margin))
    first = stored(first)
    evidence = doubtful(first, table, size) if evidence is None else evidence
    strands = F.when(F.col("code") == 0, F.array(F.lit("+"))).when(F.col("code") == 1, F.array(F.lit("-"))).when(F.col("code") == 2, F.array(F.lit("+"), F.lit("-")))
    chosen = evidence.select("seq_name", "window", F.explode(strands).alias("strand")).distinct()
    both = table.join(first.select(*KEYS, "block", "came", "runs"), [*KEYS, "block"])
    place = F.when(F.col("strand") == "-", F.col("total") + 2 - F.col("first")).otherwise(F.col("first"))
    right = both.where("block > 0").withColumn("window", place).join(chosen, [*KEYS, "window"], "left_semi").drop("window", "last")
    names = {c: f"{c}_2" for c in ("first", "length", "letters", "came", "runs")}
    left = both.withColumn("block", F.col("block") + 1).select(*KEYS, "block", *(F.col(c).alias(n) for c, n in names.items()))
    a, c = F.least(F.lit(half), "length_2").alias("a"), F.least(F.lit(half), "length").alias("c")
    pairs = right.join(left, [*KEYS, "block"]).withColumns({"a": a, "c": c})
    begin, end = F.col("first") - F.col("a"), F.col("first") + F.col("c") - 1
    entry = F.when(F.col("a") == F.col("length_2"), F.col("came_2")).otherwise(_state_in(F.col("runs_2"), begin - 1))
    letters = F.concat(F.substring("letters_2", F.col("length_2") - F.col("a") + 1, F.col("a") + margin), F.substring("letters", F.lit(margin + 1), F.col("c") + margin))
    # States first: lambdas in a select see its own new columns.
    known = pairs.withColumns({"before": entry, "leave": _state_in(F.col("runs"), end), "letters": letters})
    vector = F.transform(F.sequence(F.lit(0), F.lit(STATES - 1)), lambda s: F.when(s == F.col("before"), F.lit(0)).otherwise(F.lit(NEVER)).cast("long"))
    windows = known.select(
        *KEYS, "block", F.lit(False).alias("last"), "total", begin.alias("first"), (F.col("a") + F.col("c")).alias("length"), "letters",
        vector.alias("entry"), F.array("leave").alias("exits"),
    )
    windows = stored(windows)
    importable(sequences.sparkSession)
    again = windows.mapInArrow(_paths(scorer, moves, margin), f"{_kinds(table)}, last boolean, total long, leave int, came int, score long, runs {RUN}")
    # What the first result keeps of each block: all but the windows at its two ends.
    ends = windows.select(*KEYS, "block", F.col("first").alias("low_w"), (F.col("first") + F.col("length") - 1).alias("high_w"))
    kept = first.select(*KEYS, "block", "total", "runs").join(ends.select(*KEYS, "block", "high_w"), [*KEYS, "block"], "left")
    kept = kept.join(ends.select(*KEYS, (F.col("block") - 1).alias("block"), "low_w"), [*KEYS, "block"], "left")
    low, high = F.coalesce(F.col("high_w") + 1, F.lit(1)), F.coalesce(F.col("low_w") - 1, "total")
    rest = kept.select(*KEYS, "total", low.alias("low"), high.alias("high"), F.explode("runs").alias("r")).where("r.start <= high and r.stop >= low")
    begin, end = F.greatest("r.start", "low"), F.least("r.stop", "high")
    cut = rest.select(*KEYS, "total", F.col("r.kind").alias("kind"), begin.alias("start"), end.alias("stop"), state_at(F.col("r"), begin).alias("first"), state_at(F.col("r"), end).alias("last"))
    return cut.unionByName(path_pieces(again))


def gene_parts(pieces: DataFrame, width: int = 1 << 14) -> DataFrame:
    """(seq_name, strand, total, tx, start, stop): coding exons of all transcripts, put together over block borders; ``tx`` is the place of the
    start codon on the own strand.

    Each exon piece learns the last exon begin and the last start codon at or before it: running maxima by bins of
    ``width``, so a transcript of any number of blocks is never one group of pieces. What belongs to no start codon (a gene that is open
    at a sequence's begin) is left out.
    """
    exons = pieces.where("kind = 4")
    begin = F.when(F.col("first").isin(START, *EXON_BEGINS), F.col("start"))
    start = F.when(F.col("first") == START, F.col("start"))
    values = {"begin_before": F.col("begin"), "tx_before": F.col("tx")}
    rows = running_all(exons.withColumns({"begin": begin, "tx": start}), KEYS, ["start"], "start", values, "max", width)
    whole = rows.select(*KEYS, "total", F.coalesce("tx", "tx_before").alias("tx"), F.coalesce("begin", "begin_before").alias("begin"), "start", "stop").where("tx is not null")
    return whole.groupBy(*KEYS, "total", "tx", "begin").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("begin")


def gene_features(parts: DataFrame) -> DataFrame:
    """The coding exons as features (seqid, strand, gene_id, tx_id, type, start, stop, line_no) in plus coordinates; each gene has one transcript."""
    minus = F.col("strand") == "-"
    gene = F.concat_ws(".", F.col("seq_name"), F.when(minus, "minus").otherwise("plus"), F.col("tx"))
    return parts.select(
        F.col("seq_name").alias("seqid"), "strand", gene.alias("gene_id"), F.concat(gene, F.lit(".t1")).alias("tx_id"), F.lit("CDS").alias("type"),
        F.when(minus, F.col("total") + 1 - F.col("stop")).otherwise(F.col("start")).alias("start"),
        F.when(minus, F.col("total") + 1 - F.col("start")).otherwise(F.col("stop")).alias("stop"), F.col("start").alias("line_no"),
    )


def annotated_genes(sequences: DataFrame, scorer: Scorer, moves: np.ndarray, size: int = 1 << 12, margin: int = REACH, least: int = 200) -> DataFrame:
    """Gene models of whole sequences: features as ``gene_features`` has them, of transcripts with ``least`` coding bases and no inner stop codon.

    A codon that an intron splits is not seen by the grammar; those that make a stop codon are found in the spliced sequence.
    """
    sequences = stored(sequences.select("seq_name", "sequence"))
    cds = stored(gene_features(gene_parts(path_pieces(decoded_blocks(sequences, scorer, moves, size, margin)))))
    good = stop_report(cds, sequences).where((F.col("n") >= least) & (F.col("internal") == 0))
    return cds.join(good.select("tx_id"), "tx_id", "left_semi").select(*cds.columns)
