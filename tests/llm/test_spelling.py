"""Spelling variants against all edits of each word."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from locusframe.llm import spelling
from locusframe.llm.queries import QUERIES
from tests.test_queries import FOLDER, needs_tables

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def counts(docs, least=7, twice=2):
    found = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= least
    return {w: n for w, n in found.items() if n >= twice}


def edits(word):
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {a + c + b for a, b in cut for c in LETTERS} | {a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in LETTERS if c != b[0]}


def brute(words, ratio=10):
    near = {w: [x for x in edits(w) if x in words] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def made(rng, n):
    stems = ["".join(rng.choice(list("abcé"), int(rng.integers(1, 8)))) for _ in range(n)] + ["a" * k for k in range(1, 12)] + ["ab" * k for k in range(1, 6)]
    return {w: int(10 ** rng.integers(0, 5)) for w in stems}


@pytest.mark.parametrize("limits", [{}, {"shard_words": 40, "block_bytes": 3_000}, {"shard_words": 1_000, "shard_chars": 100, "block_bytes": 1}])
def test_variants_are_all_edits(spark, limits):
    words = made(np.random.default_rng(4), 250)
    table = spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n long, best string").repartition(3)
    assert got(spelling.spelling_variants(table, **limits)) == brute(words)


def test_trie_holds_its_words():
    words = sorted(made(np.random.default_rng(8), 300)) + ["é" * 5_000]
    words.sort()
    trie = spelling.unpacked(spelling.trie_bytes(words, range(len(words))))
    assert [trie.word(i) for i in range(len(words))] == words
    assert sorted(i for i in trie.final if i >= 0) == list(range(len(words)))
    for w in words[::7]:
        assert sorted(trie.word(i) for i in spelling.neighbours(w, trie)) == (sorted(edits(w) & set(words)) if len(w) < 50 else [])
    assert [trie.word(i) for i in spelling.neighbours("é" * 4_999, trie)] == ["é" * 5_000]


def test_counts_of_odd_texts(spark):
    long = "Straßenbahn " * 30_000
    docs = [(1, "Straßenbahn STRASSENBAHN straßenbahn, Éclairs éclairs éclairs×÷"), (2, None), (None, "ABCDEFG abcdefg"), (None, "ABCDEFG abcdefg"), (3, ""), (4, long), (5, "x" * 200_000 + " " + "x" * 200_000), (6, "éclairs eclairs")]
    docs += [(i, "variante varianten Variant") for i in range(100, 200)]
    table = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, n int")
    out = {r["word"]: r["n"] for r in spelling.counted_words(table).collect()}
    assert out == counts(docs)
    assert got(spelling.spelling_variants(spelling.counted_words(table.where("doc_id is null or doc_id != 5")))) == brute(counts([d for d in docs if d[0] != 5]))


def test_empty_tables(spark):
    assert spelling.spelling_variants(spelling.counted_words(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


@needs_tables
@pytest.mark.parametrize("name", ["op11_spelling_variants"])
def test_query(spark, name):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert got(QUERIES[name](spark, FOLDER)) == brute(counts(docs))
