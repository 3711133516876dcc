"""The pipeline's near-copy stage against the similarity of all pairs."""

from collections import defaultdict

import corpus_pipeline
from tests.test_queries import FOLDER, needs_tables


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def roots(sets):
    """The least index that each set reaches by links of similarity 0.8 or more; empty sets link to each other."""
    above = list(range(len(sets)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or [None]:
            holders[x].append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s or [None] for j in holders[x] if j > i}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                a, b = sorted((root(i), root(j)))
                above[b] = a
    return [root(i) for i in range(len(sets))]


@needs_tables
def test_one_of_each_is_all_pairs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    sets = [shingle_set(t) for _, t in rows]
    want = {rows[i][0] for i, r in enumerate(roots(sets)) if r == i}
    got = [r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, FOLDER).collect()]
    assert len(want) < len(rows) and sorted(got) == sorted(want)
