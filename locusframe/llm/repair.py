"""Conversation structure repair: the cheapest edits that give every conversation legal roles.

Each turn is a 4x4 matrix over (cost, audit) elements, with inserts closed in; min-plus products along a conversation
give its repair. Products are associative, so pieces of a long conversation are multiplied in tasks of their own and
reduced as a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm._common import hinted, written
from locusframe.session import importable

Element = tuple[int, str]
Matrix = list[list[Element | None]]
#: States after the kept roles so far: nothing, a system turn, a user turn, an assistant turn. Legal ends are the first and last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: Where the one role that a state allows besides a system turn leads, and its name.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
BLANKS = " \t\n\x0b\x0c\r"
#: Turns, and characters of text, that a piece of a long conversation has at most (or one longer turn).
PIECE_ROWS, PIECE_CHARS = 1024, 1 << 20
#: Parts whose nodes are multiplied to one at a time.
FAN_IN = 32


def least(*elements: Element | None) -> Element | None:
    return min((e for e in elements if e is not None), default=None)


def product(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product; of equal costs the ASCII-least audit holds."""

    def entry(i: int, j: int) -> Element | None:
        paths = [(a[i][k][0] + b[k][j][0], k) for k in range(4) if a[i][k] is not None and b[k][j] is not None]
        if not paths:
            return None
        cost = min(paths)[0]
        return cost, min(a[i][k][1] + b[k][j][1] for c, k in paths if c == cost)

    return [[entry(i, j) for j in range(4)] for i in range(4)]


def _inserts() -> Matrix:
    """Any number of inserts: one from each state, closed under products."""
    one: Matrix = [[(0, "") if i == j else (2, "I") if NEXT[i] == j else None for j in range(4)] for i in range(4)]
    return product(one, one)


INSERTS = _inserts()
IDENTITY: Matrix = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]


@cache
def turn_matrix(initial: str, fault: str) -> tuple[tuple[Element | None, ...], ...]:
    """A turn by its role's initial and its fault (b, d: to be deleted; t: costs one more if it stays; else none), after any inserts."""
    edits: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        edits[i][i] = (3, "D")
        if fault in ("b", "d"):
            continue
        more = int(fault == "t")
        to = NEXT[i]
        edits[i][to] = least(edits[i][to], (2 + more, "R"))
        if initial == NAMES[to][0]:
            edits[i][to] = least(edits[i][to], (more, "K"))
        if initial == "s" and i == NOTHING:
            edits[i][SYSTEM] = least(edits[i][SYSTEM], (more, "K"))
    return tuple(tuple(row) for row in product(INSERTS, edits))


def turns_product(turns: Sequence[tuple[str, str]], entries: Sequence[int] = range(4)) -> Matrix:
    """The product of the matrices of ``turns`` (initial, fault); only the rows ``entries`` are worked out."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in entries:
        now = list(IDENTITY[i])
        for turn in turns:
            m = turn_matrix(*turn)
            step: list[Element | None] = []
            for j in range(4):
                cost, ways = -1, []
                for k in range(4):
                    if now[k] is not None and m[k][j] is not None:
                        c = now[k][0] + m[k][j][0]
                        if not ways or c < cost:
                            cost, ways = c, [k]
                        elif c == cost:
                            ways.append(k)
                step.append((cost, min(now[k][1] + m[k][j][1] for k in ways)) if ways else None)
            now = step
        out[i] = now
    return out


def finished(m: Matrix) -> tuple[int, str, int]:
    """(cost, audit, state before the last inserts) of a whole conversation's matrix."""
    found = least(*(product(m, INSERTS)[NOTHING][j] for j in ENDS))
    before = min((m[NOTHING][k], k) for k in range(4) for j in ENDS
                 if m[NOTHING][k] is not None and INSERTS[k][j] is not None
                 and (m[NOTHING][k][0] + INSERTS[k][j][0], m[NOTHING][k][1] + INSERTS[k][j][1]) == found)
    return found[0], found[1], before[1]


def repaired_lines(turns: Sequence[tuple[str, str]], audit: str, state: int) -> tuple[str, int]:
    """The repaired (role, text) turns as lines ``role:text``, each after a newline, and the state after them."""
    out, rest = [], iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
        else:
            state = NEXT[state]
            role = NAMES[state]
        out.append(f"\n{role}:{text}")
    return "".join(out), state


# ---- nodes: what is known of consecutive turns of one conversation

NODE = (
    "blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, low long, high long, "
    "distinct long, first_turn long, last_turn long, costs array<long>, audits array<string>"
)
_FIELDS = [x.split()[0] for x in NODE.split(", ")]


def node_of(turns: Sequence[tuple[int | None, str, str]], entries: Sequence[int] = range(4)) -> dict:
    """The node of consecutive turns (turn, initial, fault)."""
    known = [t for t, _, _ in turns if t is not None]
    initials, faults = [i for _, i, _ in turns], [f for _, _, f in turns]
    m = turns_product([(i, f) for _, i, f in turns], entries)
    return {
        "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "first_initial": initials[0] if turns else None, "last_initial": initials[-1] if turns else None,
        "low": min(known, default=None), "high": max(known, default=None), "distinct": sum(i == 0 or known[i - 1] != t for i, t in enumerate(known)),
        "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "matrix": m,
    }


def joined(a: dict, b: dict) -> dict:
    """The node of ``a``'s turns and then ``b``'s; associative."""
    both = lambda f, k: f((x for x in (a[k], b[k]) if x is not None), default=None)
    first = lambda k, x, y: x[k] if x[k] is not None else y[k]
    meet = a["last_initial"] is not None and b["first_initial"] is not None and a["last_initial"] + b["first_initial"] not in ("su", "ua", "au")
    same = a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    return {
        **{k: a[k] + b[k] for k in ("blank", "duplicate", "truncated")}, "illegal": a["illegal"] + b["illegal"] + meet,
        "first_initial": first("first_initial", a, b), "last_initial": first("last_initial", b, a), "low": both(min, "low"), "high": both(max, "high"),
        "distinct": a["distinct"] + b["distinct"] - same, "first_turn": first("first_turn", a, b), "last_turn": first("last_turn", b, a),
        "matrix": product(a["matrix"], b["matrix"]),
    }


def _tree(nodes: list[dict]) -> tuple[dict, tuple]:
    """The product of all nodes, and the balanced tree of how it came about."""
    if len(nodes) == 1:
        return nodes[0], ()
    half = len(nodes) // 2
    (a, below_a), (b, below_b) = _tree(nodes[:half]), _tree(nodes[half:])
    return joined(a, b), ((a, below_a), (b, below_b))


def _states(node: dict, below: tuple, entry: int, leave: int) -> Iterator[tuple[int, int]]:
    """(entry, leave) of each leaf on the best path through a tree."""
    if not below:
        yield entry, leave
        return
    (a, below_a), (b, below_b) = below
    x, y = a["matrix"][entry], b["matrix"]
    k = min((x[k][0] + y[k][leave][0], x[k][1] + y[k][leave][1], k) for k in range(4) if x[k] is not None and y[k][leave] is not None)[2]
    yield from _states(a, below_a, entry, k)
    yield from _states(b, below_b, k, leave)


def _packed(node: dict) -> list:
    cells = [e for row in node["matrix"] for e in row]
    flat = {**node, "costs": [-1 if e is None else e[0] for e in cells], "audits": ["" if e is None else e[1] for e in cells]}
    return [flat[k] for k in _FIELDS]


def _unpacked(row: Sequence) -> dict:
    node = {k: None if not isinstance(v, (str, list)) and not hasattr(v, "__len__") and pd.isna(v) else v for k, v in zip(_FIELDS, row, strict=True)}
    node |= {k: int(v) for k, v in node.items() if k not in ("first_initial", "last_initial", "costs", "audits") and v is not None}
    cells = [None if c < 0 else (int(c), a) for c, a in zip(node.pop("costs"), node.pop("audits"), strict=True)]
    return node | {"matrix": [cells[4 * i : 4 * i + 4] for i in range(4)]}


# ---- Spark


def damaged(conversations: DataFrame, key: Sequence[str] = ("conv_id", "turn")) -> DataFrame:
    """(conv_id, turn, role, text, copy, live): rows with planted faults by crc32 of ``conv_id:turn`` modulo 20; a dropped row stays with
    live false. Nulls of role and text, and of the ids where they are hashed, are one space."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(some(key[0]), F.lit(":"), some(key[1])).cast("binary")) % 20
    rows = conversations.select(F.col(key[0]).alias("conv_id"), F.col(key[1]).cast("long").alias("turn"), some("role").alias("role"), some("text").alias("text"), code.alias("_code"))
    copies = F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_code") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("_code") != 0).alias("live"))


def _faults(rows: DataFrame, small: int) -> DataFrame:
    """Adds fault (b, d, t or none) and the text's two hashes; rows are told apart by (rid, copy).

    First places of texts that occur more than once are few rows as a rule: they are broadcast if they are, else shuffled.
    """
    bare = F.rtrim("text", F.lit(BLANKS))
    rows = rows.withColumns({
        "blank": bare == "", "cut": ~F.right(bare, F.lit(1)).isin(".", "!", "?"),
        "h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("second"), "text"), "at": F.struct("turn", "rid", "copy"),
    })
    same = ["conv_id", "role", "h1", "h2"]
    first = rows.where("live and not blank").groupBy(*same).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = hinted(written(first), small).alias("f")
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in same]
    found = rows.alias("r").join(first, on, "left").select("r.*", F.col("f.first").alias("first"))
    fault = F.when(F.col("blank"), "b").when(F.col("first").isNotNull() & (F.col("at") != F.col("first")), "d").when(F.col("cut"), "t").otherwise("")
    return found.withColumn("fault", fault).drop("blank", "cut", "at", "first")


#: A task's rows: finished conversations, pieces of others, and the turns of these.
_OUT = (
    f"kind string, conv_id {{}}, part int, seg int, pos int, role string, text string, {NODE}, gaps long, cost long, audit string, repaired_sha256 string"
)


def _result(node: dict) -> tuple[int, int, str, int]:
    cost, audit, before = finished(node["matrix"])
    gaps = 0 if node["low"] is None else node["high"] - node["low"] + 1 - node["distinct"]
    return gaps, cost, audit, before


def _scan(schema: str, kind: pa.DataType) -> Callable:
    """Reads a range of sorted turns: conversations that lie inside it whole are finished; the first, the last and long ones become pieces."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"part": pa.int32(), "seg": pa.int32(), "pos": pa.int32(), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string()), "conv_id": kind}
    longs = ("blank", "duplicate", "truncated", "illegal", "low", "high", "distinct", "first_turn", "last_turn", "gaps", "cost")
    typed = pa.schema([(n, types.get(n) or (pa.int64() if n in longs else pa.string())) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        now: list[tuple] = []
        state = {"conv": None, "seg": -1, "part": -1, "begun": False, "chars": 0, "first": True}

        def emit(whole: bool) -> None:
            base = {"conv_id": state["conv"], "part": state["part"]}
            node = node_of([t[:3] for t in now], (NOTHING,) if whole else range(4))
            if whole:
                gaps, cost, audit, before = _result(node)
                lines, end = repaired_lines([t[3:] for t in now], audit, NOTHING)
                sha = hashlib.sha256(lines[1:].encode()).hexdigest()
                out.append(base | {"kind": "done", "gaps": gaps, "cost": cost, "audit": audit, "repaired_sha256": sha} | {k: node[k] for k in ("blank", "duplicate", "truncated", "illegal")})
                return
            state["seg"] += 1
            base["seg"] = state["seg"]
            out.append(base | {"kind": "piece"} | dict(zip(_FIELDS, _packed(node), strict=True)))
            out.extend(base | {"kind": "turn", "pos": i, "role": t[3], "text": t[4]} for i, t in enumerate(now))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(out, schema=typed)
            out.clear()
            return batch

        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in batch.schema.names if n not in ("rid", "h1", "h2", "copy")}
            for conv, turn, role, text, live, fault, part in zip(*(cols[c] for c in ("conv_id", "turn", "role", "text", "live", "fault", "part")), strict=True):
                if not state["begun"] or conv != state["conv"]:
                    if state["begun"]:
                        emit(whole=not state["first"] and state["seg"] < 0)
                        state["first"] = False
                    now.clear()
                    state |= {"conv": conv, "seg": -1, "part": part, "begun": True, "chars": 0}
                elif len(now) >= PIECE_ROWS or state["chars"] >= PIECE_CHARS:
                    emit(whole=False)
                    now.clear()
                    state["chars"] = 0
                if live:
                    now.append((turn, role[:1], fault, role, text))
                    state["chars"] += len(text)
                if len(out) >= 2_000:
                    yield flush()
        if state["begun"]:
            emit(whole=False)
        if out:
            yield flush()

    return run


def repair_conversations(rows: DataFrame, small: int = 200_000) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows``: (conv_id, turn, role, text, and optionally copy and live, as ``damaged`` gives them); other columns are dropped. Turns are
    taken by turn, nulls first; of one turn, by role, then by the text's hash, so equal rows stay next to each other. A turn's first
    fault counts: blank, duplicate (its role and text seen earlier in the conversation), truncated (its last character that is no
    blank is none of ``.!?``). Rows without a conversation id are one conversation. Null roles and texts count as one space. A conversation
    that has only rows that aren't live has zeros, an empty audit and the digest of the empty text; an empty table gives no rows.

    Turns are dealt out by Spark's sampled ranges of (conversation, turn, role, hashes, row), so a conversation with a third of all rows is many
    tasks. Conversations inside a range are finished there. The others' pieces (``PIECE_ROWS`` turns or ``PIECE_CHARS`` characters at
    most) are multiplied as a tree, level by level; on the way back each piece learns the states it is entered and left in, and gives
    its repaired lines. Only the digest of a long conversation reads these in one task: as a stream, a piece at a time.
    """
    spark = rows.sparkSession
    importable(spark)
    have = set(rows.columns)
    none = {"copy": F.lit(0), "live": F.lit(True)}
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    slim = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), some("role").alias("role"), some("text").alias("text"), *(F.col(c) if c in have else x.alias(c) for c, x in none.items()))
    slim = written(slim.withColumn("rid", F.monotonically_increasing_id()))
    order = ["conv_id", "turn", "role", "h1", "h2", "rid", "copy"]
    dealt = _faults(slim, small).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    conv = dict(slim.dtypes)["conv_id"]
    schema = _OUT.format(conv)
    empty = spark.createDataFrame([], f"conv_id {conv}")
    out = written(dealt.mapInArrow(_scan(schema, empty.toArrow().schema.field(0).type), schema))
    done = out.where("kind = 'done'")
    top, digests = _long_ones(out, conv)
    return done.select(*RESULT).unionByName(
        top.alias("t").join(digests.alias("d"), F.col("t.conv_id").eqNullSafe(F.col("d.conv_id"))).select("t.*", "d.repaired_sha256").select(*RESULT)
    )


RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _long_ones(out: DataFrame, conv: str) -> tuple[DataFrame, DataFrame]:
    """Results of the conversations in pieces, and their digests."""
    levels = [out.where("kind = 'piece'").select("conv_id", F.col("part").cast("long").alias("up"), F.col("seg").cast("long").alias("place"), *_FIELDS)]
    schema = f"conv_id {conv}, up long, place long, {NODE}"

    def up(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        node, _ = _tree([_unpacked(r) for r in frame[_FIELDS].itertuples(index=False, name=None)])
        return pd.DataFrame([[frame["conv_id"].iloc[0], frame["up"].iloc[0] // FAN_IN, frame["up"].iloc[0], *_packed(node)]], columns=["conv_id", "up", "place", *_FIELDS])

    # Pieces of one part become one node; then those of FAN_IN parts, until each conversation has one.
    while True:
        levels.append(written(levels[-1].groupBy("conv_id", "up").applyInPandas(up, schema)))
        if levels[-1].groupBy("conv_id").count().where("count > 1").isEmpty():
            break
    top = levels[-1]

    answer = f"{schema}, gaps long, cost long, audit string, entry int, leave int"

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            more = [_result(_unpacked(r)) for r in frame[_FIELDS].itertuples(index=False, name=None)]
            yield frame.assign(gaps=[m[0] for m in more], cost=[m[1] for m in more], audit=[m[2] for m in more], entry=NOTHING, leave=[m[3] for m in more])

    top = written(top.mapInPandas(finish, answer))
    known = top.select("conv_id", F.col("place").alias("up"), "entry", "leave")
    states = f"conv_id {conv}, up long, place long, entry int, leave int, audit string"

    def down(frame: pd.DataFrame) -> pd.DataFrame:
        parent = frame[frame["place"].isna()].iloc[0]
        frame = frame[frame["place"].notna()].sort_values("place")
        nodes = [_unpacked(r) for r in frame[_FIELDS].itertuples(index=False, name=None)]
        at = list(_states(*_tree(nodes), int(parent["entry"]), int(parent["leave"])))
        audits = [n["matrix"][i][j][1] for n, (i, j) in zip(nodes, at, strict=True)]
        return pd.DataFrame({"conv_id": frame["conv_id"], "up": frame["up"], "place": frame["place"].astype("int64"), "entry": [i for i, _ in at], "leave": [j for _, j in at], "audit": audits})

    for level in reversed(levels[:-1]):
        both = level.unionByName(known, allowMissingColumns=True)
        below = written(both.groupBy("conv_id", "up").applyInPandas(down, states))
        known = below.select("conv_id", F.col("place").alias("up"), "entry", "leave")
    pieces = below.select("conv_id", F.col("up").alias("part"), F.col("place").alias("seg"), "entry", "audit")
    lines = f"conv_id {conv}, part long, seg long, lines string"

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        piece = frame[frame["pos"].isna()].iloc[0]
        frame = frame[frame["pos"].notna()].sort_values("pos")
        text, _ = repaired_lines(list(zip(frame["role"], frame["text"], strict=True)), piece["audit"], int(piece["entry"]))
        return pd.DataFrame([[piece["conv_id"], piece["part"], piece["seg"], text]], columns=["conv_id", "part", "seg", "lines"])

    turns = out.where("kind = 'turn'").select("conv_id", F.col("part").cast("long").alias("part"), F.col("seg").cast("long").alias("seg"), "pos", "role", "text")
    chunks = turns.unionByName(pieces, allowMissingColumns=True).groupBy("conv_id", "part", "seg").applyInPandas(write, lines)
    # What is inserted after the last turn: an answer to a user turn, a pair after a system turn alone.
    tail = F.when(F.col("leave") == USER, "\nassistant:").when(F.col("leave") == SYSTEM, "\nuser:\nassistant:").otherwise("")
    chunks = chunks.unionByName(top.select("conv_id", F.lit(2**62).alias("part"), F.lit(0).cast("long").alias("seg"), tail.alias("lines")))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, first, hasher, kind = False, None, True, hashlib.sha256(), None
        row = lambda: pa.record_batch([pa.array([now], kind), pa.array([hasher.hexdigest()])], ["conv_id", "repaired_sha256"])
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for c, x in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                if not begun or c != now:
                    if begun:
                        yield row()
                    begun, now, first, hasher = True, c, True, hashlib.sha256()
                hasher.update((x[1:] if first else x).encode())
                first = first and not x
        if begun:
            yield row()

    sorted_ = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    return top, sorted_.select("conv_id", "lines").mapInArrow(digest, f"conv_id {conv}, repaired_sha256 string")
