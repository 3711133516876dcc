"""Conversation repair against a shortest-path search over all edits."""

import hashlib
import heapq
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import repair
from locusframe.llm.queries import QUERIES
from tests.test_queries import FOLDER, needs_tables

BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    """Rows (conv, turn, role, text) with the contract's faults: {conv: turns after damage}."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if code == 1 else text.translate({ord(c): None for c in ".!?"}) if code == 2 else text
        kept.extend([(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1))
    return out


def search(turns):
    """The least (cost, audit) over all edit sequences, by uniform-cost search, with the repaired lines."""
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == len(turns) and last in ("", "a"):
            return cost, audit, "\n".join(lines)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        wanted = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[wanted]
        heapq.heappush(heap, (cost + 2, audit + "I", i, wanted, (*lines, f"{name}:")))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, lines))
            if fault not in ("b", "d"):
                heapq.heappush(heap, (cost + 2 + (fault == "t"), audit + "R", i + 1, wanted, (*lines, f"{name}:{text}")))
                if role[:1] == wanted or (role[:1] == "s" and last == ""):
                    heapq.heappush(heap, (cost + (fault == "t"), audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
    raise AssertionError


def brute(conversations):
    out = []
    for conv, turns in conversations.items():
        order = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
        seen, faults = set(), []
        for _, role, text in (turns := sorted(turns, key=order)):
            bare = text.rstrip(BLANK)
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, lines = search([(r, t, f) for (_, r, t), f in zip(turns, faults, strict=True)])
        out.append((conv, gaps, *map(faults.count, "bdt"), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*repair.RESULT).collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(rng, n, most):
    """No two turns of one number, so that their order is the contract's alone."""
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["a.", "b?", "c", "", " \t", None, "d!", "e. "]
    out = []
    for conv in range(n):
        turns = rng.choice(3 * most, int(rng.integers(0, most + 1)), replace=False)
        out += [(conv, int(t), roles[rng.choice(6, p=[0.1, 0.4, 0.35, 0.05, 0.05, 0.05])], texts[rng.integers(0, 8)]) for t in turns]
    return out


def test_whole_table_is_search(spark):
    rows = conversations(np.random.default_rng(5), 150, 9)
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (900, None, "user", None), (901, 3, "assistant", "word " * 50_000), (902, None, None, None)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("other")).withColumn("kind", F.lit(1)).repartition(3)
    assert got(repair.repair_conversations(repair.damaged(table))) == brute(damage(rows))


def test_pieces_of_long_conversations_are_search(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_ROWS", 7)
    monkeypatch.setattr(repair, "FAN_IN", 2)
    rng = np.random.default_rng(6)
    rows = [(1, i, ["system", "user", "assistant"][rng.integers(0, 3)], f"{rng.integers(0, 90)}{'.?x'[rng.integers(0, 3)]}") for i in range(400)]
    rows += [(2, i, "user", "x.") for i in range(60)] + conversations(rng, 20, 5)
    assert got(repair.repair_conversations(repair.damaged(spark.createDataFrame(rows, SCHEMA).repartition(5)), small=1)) == brute(damage(rows))


def test_repeated_rows_nulls_and_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert got(repair.repair_conversations(repair.damaged(none))) == []
    # Without a turn or with one number, turns stand by role and text; equal rows are duplicates.
    plain = [("c", None, "user", "b."), ("c", None, "user", "b."), ("c", 1, "assistant", "x."), ("d", 1, "assistant", "y.")]
    out = got(repair.repair_conversations(spark.createDataFrame(plain, "conv_id string, turn int, role string, text string")))
    assert out == brute({"c": [x[1:] for x in plain[:3]], "d": [plain[3][1:]]})
    dead = spark.createDataFrame([(5, 0, "user", "x", False)], SCHEMA + ", live boolean")
    assert got(repair.repair_conversations(dead)) == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_product_is_associative():
    rng = np.random.default_rng(7)
    turns = [(str(rng.choice(["s", "u", "a", ""])), str(rng.choice(["", "", "t", "b"]))) for _ in range(40)]
    whole = repair.turns_product(turns)
    for cut in (1, 13, 39):
        assert repair.product(repair.turns_product(turns[:cut]), repair.turns_product(turns[cut:])) == whole


@needs_tables
@pytest.mark.parametrize("folder", [FOLDER])
def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert len(set(r[:2] for r in rows)) == len(rows)
    assert got(QUERIES["op13_conversation_repair"](spark, folder)) == brute(damage(rows))
