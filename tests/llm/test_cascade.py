"""The rule cascade against plain loops."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import cascade
from locusframe.llm.queries import QUERIES
from tests.test_queries import FOLDER, needs_tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    hit = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def verdict(text):
    """Whether every rule lets a text pass, by plain loops."""
    text = text or ""
    n, chars, symbols, dup, repeat = base(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    bullets = sum(strip(x).startswith(("-", "*", "•")) for x in lines)
    cut = sum(strip(x).endswith(("...", "…")) for x in lines)
    lettered = sum(any(c.isalpha() or ord(c) > 127 for c in w) for w in WORD.findall(text))
    return not (
        n < 50 or 100 * repeat > 50 * n or chars < 2 * n or chars > 14 * n or 10 * symbols > n or 2 * dup > len(lines)
        or 10 * bullets > 9 * len(lines) or 10 * cut > 3 * len(lines) or 10 * lettered < 7 * n
    )


def texts(rng):
    words = ["alpha", "Été", "x", "1", "#", "*", "a|b", " ", "\x1c", "long" * 9, "\U0001f600"]
    out = [None, "", " \n\t ", "a b a b a b", "- a\n- a\n- b\n", "end...\nend…\n", "word " * 30_000, "\n".join(["one two three"] * 40), "x" * 3_000_000]
    for _ in range(300):
        n = int(rng.integers(0, 160))
        many = words[: int(rng.integers(1, len(words) + 1))] + [f"w{i}" for i in range(int(rng.integers(0, 200)))]
        out.append("".join(str(rng.choice(many)) + str(rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b"], p=[0.7, 0.1, 0.1, 0.04, 0.03, 0.03])) for _ in range(n)))
    return out


REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_features_and_verdicts_are_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(cascade, "BLOCK", 50)
    for text in texts(np.random.default_rng(2))[:100]:
        raw = (text or "").encode()
        if len(raw) < 100_000:
            assert tuple(cascade.FEATURES[n](raw) for n in REPORT) == base(text)
    monkeypatch.undo()
    all_texts = texts(np.random.default_rng(3)) * 2
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(all_texts)], "doc_id long, text string, n_words int").withColumn("kept", F.lit("other")).repartition(3)
    out = {r["doc_id"]: r for r in cascade.quality_rules(docs, report=REPORT, wanted=50).collect()}
    assert sorted(out) == list(range(len(all_texts)))
    for i, text in enumerate(all_texts):
        if len(text or "") < 1_000_000:
            assert tuple(out[i][n] for n in REPORT) == base(text)
            assert out[i]["kept"] == verdict(text) == (out[i]["rejected_by"] is None)
    again = {r["doc_id"]: r["kept"] for r in cascade.apply_rules(docs, cascade.RULES[::-1]).collect()}
    assert again == {i: r["kept"] for i, r in out.items()}


def test_order_is_by_rejection_for_cost():
    a, b, c, d = (cascade.Rule(n, (n,), lambda x: x > 0) for n in "abcd")
    rejected = np.zeros((100, 4), bool)
    rejected[:50, 0], rejected[:90, 1], rejected[40:80, 2] = True, True, True
    profile = cascade.Profile({"a": 1.0, "b": 10.0, "c": 2.0, "d": 0.5}, rejected)
    # a rejects 50 for 1; of the rest c rejects 30 for 2 and b 10 for 10; d rejects none.
    assert [r.name for r in cascade.ordered([d, c, b, a], cascade.Profile(profile.cost, rejected[:, ::-1]))] == ["a", "c", "b", "d"]
    assert [r.name for r in cascade.ordered([a, b, c, d], profile, ["b"])][0] == "b"
    assert [r.name for r in cascade.ordered([a, b], cascade.Profile({}, np.zeros((0, 2), bool)))] == ["a", "b"]


def test_later_rules_see_only_what_is_left(spark):
    """A feature that fails on words of other rules' texts isn't asked for there."""
    part = cascade._Cascade([b"a", b"b " * 60, b"c " * 60])
    left = np.arange(3)[~part.rejected(cascade.BASE[0], np.arange(3))]
    part.rejected(cascade.RULES[3], left)
    assert part.known["n_symbols"].tolist() == [False, True, True]


def test_empty_table(spark):
    assert cascade.quality_rules(spark.createDataFrame([], "doc_id long, text string"), report=REPORT).count() == 0


@needs_tables
@pytest.mark.parametrize("name", ["op12_quality_rules"])
def test_query(spark, name):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    out = QUERIES[name](spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    for r in out:
        n, chars, symbols, dup, repeat = base(docs[r["doc_id"]])
        failed = n < 50 or 100 * repeat > 50 * n
        assert tuple(r[c] for c in (*REPORT, "base_failed", "kept")) == (n, chars, symbols, dup, repeat, failed, verdict(docs[r["doc_id"]]))
