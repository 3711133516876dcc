"""Each operator on small tables: against brute force, and on null, empty, long, tied, repeated and extra input."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from locusframe.llm import chat, crf, langid, linededup, mixing, quality, sharding, simhash, urlfilter, vectors
from locusframe.llm._common import drawn, in_parts, sampled
from locusframe.llm.components import connected_components
from locusframe.llm.decontamination import find_contaminated

DOCS = "doc_id long, text string, lang string, source string"
LONG = "word " * 20_000


def words_2(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_windows(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words_2(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words_2(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_decontamination_is_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "é"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(n)) for i, n in enumerate((13, 14, 20, 40, 12, 5, 2, 1, 3))] + [(1, None), (20, ""), (21, "..."), (22, "w1 w2"), (22, "w1 w2")]
    items += [(23, items[3][1]), (24, items[3][1][:60])]
    docs = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 80, 40))]
    docs += [(100 + i, f"{text(30)}, {items[k][1].upper()}! {text(9)}") for i, k in enumerate((0, 1, 2, 3, 3, 4, 5))]
    docs += [(200, None), (201, ""), (None, items[3][1]), (None, items[3][1]), (5, items[2][1]), (202, LONG), (203, "É É é")]
    got = find_contaminated(spark.createDataFrame(docs, "doc_id long, text string").withColumn("rid", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == brute_windows(docs, items)


def test_decontamination_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert rows(find_contaminated(docs, bench)) == brute_windows([(1, "a b")], [])
    assert rows(find_contaminated(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string"))) == []


def test_decontamination_counts_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "x y z"), (3, "d")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b c"), (None, "x y"), (7, "x y"), (None, "")], "item_id long, text string")
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(1, 3, 3, 1, digest(""), True), (2, 3, 2, 2, digest("7"), True), (3, 1, 0, 0, digest(""), False)]
    assert rows(find_contaminated(docs, bench)) == want


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    least = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if bin(prints[i] ^ prints[j]).count("1") <= 2 and least[i] != least[j]:
                    least[i] = least[j] = min(least[i], least[j])
                    changed = True
    return least


def test_simhash_is_brute_force(spark):
    rng = np.random.default_rng(2)
    base = [" ".join(rng.choice([f"v{i}" for i in range(500)], 200)) for _ in range(6)]
    texts = []
    for b in base:
        w = b.split()
        texts += [b, b.upper(), b + " end", " ".join(w[:100] + ["x"] + w[101:])]
    texts += [None, "", " \t", "one", "one two", "ONE  two", " ", LONG, "a b c d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("fp", F.lit("x"))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    assert got == {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, brute_components(prints), strict=True))}


def test_simhash_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "q r s t u v")], "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, 3), (3, 3), (3, 3), (None, None)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_anchors_lose_no_pair():
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**63), 2**63, 200, dtype=np.int64)
    y = x ^ (np.int64(1) << rng.integers(0, 63, 200)) ^ (np.int64(1) << rng.integers(0, 63, 200))
    home, near = defaultdict(set), defaultdict(set)
    for row, anchor, own in simhash.anchors(x, 2):
        for r, a in zip(row[own], anchor[own], strict=True):
            home[r].add(a)
    for row, anchor, _ in simhash.anchors(y, 2):
        for r, a in zip(row, anchor, strict=True):
            near[r].add(a)
    assert all(len(home[i]) == 1 and home[i] <= near[i] for i in range(200))


@pytest.mark.parametrize("hot", [10_000, 20])
def test_hot_anchors_lose_no_pair(spark, hot):
    rng = np.random.default_rng(9)
    base = rng.integers(-(2**63), 2**63, 4, dtype=np.int64)
    flips = np.int64(1) << rng.integers(0, 63, (400, 3))  # near each other by up to 6 bits, most at one anchor
    prints = sorted({int(base[i % 4] ^ np.bitwise_xor.reduce(f)) for i, f in enumerate(flips)})
    own = {r: a for row, anchor, home in simhash.anchors(np.array(prints), 2) for r, a in zip(row[home], anchor[home], strict=True)}
    assert simhash.nearest(np.array(prints)).tolist() == [own[i] for i in range(len(prints))]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp long"), hot_homes=hot, rows_at_once=1000)
    root = dict(connected_components(links, "a", "b").collect())
    least = brute_components([p % 2**64 for p in prints])
    assert {p: root.get(p, p) for p in prints} == {p: min(prints[j] for j in range(len(prints)) if least[j] == least[i]) for i, p in enumerate(prints)}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (202, 202), (None, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


def check_shards(out, sizes, n):
    shards = out.groupby("shard")
    assert (shards["slot"].max() + 1 == shards.size()).all() and (shards["slot"].nunique() == shards.size()).all()
    total = np.zeros(n)
    for k, v in shards["size"].sum().items():
        total[k] = v
    assert total.sum() == sizes.sum()
    assert total.max() - total.min() <= 2 * sizes.max()


@pytest.mark.parametrize("hot", [0, 2000])
def test_sharding(spark, hot):
    rng = np.random.default_rng(4)
    sizes = np.r_[rng.integers(16, 3000, 3000), np.full(hot, 500)]
    keys = np.r_[rng.integers(-(2**63), 2**63, 3000), np.full(hot, 77)]
    table = pd.DataFrame({"doc_id": range(len(sizes)), "k": keys, "size": sizes, "shard_of": "x"})
    out = sharding.shard_by_splitters(spark.createDataFrame(table), "k", "size", ["doc_id"], n_shards=10, n_ranges=50, per_range=10).toPandas()
    assert sorted(out["doc_id"]) == list(range(len(sizes))) and set(out["law"]) == {"bytes"}
    check_shards(out, sizes, 10)
    totals = out.groupby("shard")["size"].sum()
    assert totals.max() / totals.min() < 1.05


def test_sharding_of_few_rows(spark):
    schema = "doc_id long, k long, size long"
    assert sharding.shard_by_splitters(spark.createDataFrame([], schema), "k", "size", ["doc_id"]).count() == 0
    out = sharding.shard_by_splitters(spark.createDataFrame([(1, 5, 16), (1, 5, 16), (None, 6, 10**9)], schema), "k", "size", ["doc_id"]).toPandas()
    assert len(out) == 3
    check_shards(out, out["size"], 40)


def test_shards_do_not_follow_the_file_layout(spark):
    rng = np.random.default_rng(14)
    texts = [None, ""] + [f"t{i % 40}" for i in range(300)] + ["hot"] * 300
    rows = [(int(i) if i % 50 else None, t, int(s), "x", "y", "z") for i, (t, s) in enumerate(zip(texts, rng.integers(16, 400, len(texts)), strict=True))]
    schema = "doc_id long, text string, size long, shard string, slot string, law string"  # names that the result has, too
    outs = []
    for table in (spark.createDataFrame(rows, schema).coalesce(1), spark.createDataFrame(rows[::-1], schema).repartition(5)):
        keyed = table.withColumn("k", F.xxhash64("text"))
        out = sharding.shard_by_splitters(keyed, "k", "size", ["doc_id", "text"], n_shards=7, n_ranges=20).toPandas()
        assert list(out.columns) == ["doc_id", "text", "size", "k", "law", "shard", "slot"]
        check_shards(out, out["size"], 7)
        outs.append(sorted(map(repr, out[["doc_id", "text", "size", "shard"]].values.tolist())))
    assert outs[0] == outs[1]


def test_samples_hold_at_any_count(spark):
    """The chance of a row is a share of 2^64, so it isn't rounded to none where rows are many."""
    rows = spark.range(200_000)
    n = rows.where(drawn(3_000, 200_000, "x", "id")).count()
    assert 2_700 < n < 3_300 and rows.where(drawn(5, 5, "x", "id")).count() == 200_000
    for count in (10**10, 10**13, 10**17):
        limit = (3_000 << 64) // count - (1 << 63)
        assert limit > -(1 << 63) and abs((limit + (1 << 63)) / 2**64 * count / 3_000 - 1) < 1e-2
    some = sampled(rows.union(rows), 100, 400_000, "x", "id")
    assert 50 < some.count() == some.distinct().count() <= 100  # of rows that repeat, fewer may be left


def test_parts_are_cut_by_bytes():
    batch = pa.record_batch([pa.array(["x" * n for n in (5, 5, 100, 1, 1)] + [None])], ["t"])
    assert [p.num_rows for p in in_parts(batch, 0, most_bytes=10)] == [2, 1, 3]
    assert [p.num_rows for p in in_parts(batch, 0, most_bytes=1000, most_rows=4)] == [4, 2]


def test_line_dedup_of_repeats_ties_and_long_pages(spark):
    page = "<SCRIPT>hidden</script>\t<p>common</p><p>\tcommon </p>own {}<script>never closed"
    data = [(i, "http://h", page.format(i)) for i in range(6)] * 2 + [(90, "http://g", "<script " * 20_000), (91, "http://g", "word " * 50_000), (92, "http://g", None)]
    out = linededup.drop_site_lines(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    assert len(out) == 15 and {r["text"] for r in out if r["host"] == "h"} == {f"own {i}" for i in range(6)}
    assert {(r["n_lines"], r["n_dropped"]) for r in out if r["host"] == "h"} == {(3, 2)}
    assert {r["page_id"]: len(r["text"]) for r in out if r["host"] == "g"} == {90: 0, 91: 249_999, 92: 0}
    half = [(i, "http://h", "<p>a</p>" if i < 3 else "<p>b</p>") for i in range(10)]  # exactly the ratio is not over it
    assert {r["text"] for r in linededup.drop_site_lines(spark.createDataFrame(half, "page_id long, url string, html string"), max_ratio=0.7, min_pages=1).collect()} == {"a", "b"}


def test_line_dedup(spark):
    page = lambda body: f"<html><nav>Home</nav><p>{body}</p><script>x</script><footer>&copy; us</footer></html>"
    data = [(i, f"https://A.example/{i}", page(f"text {i}")) for i in range(8)] + [(50, "http://b.example", page("alone")), (51, None, None), (52, "no", "")]
    got = {r["page_id"]: r for r in linededup.drop_site_lines(spark.createDataFrame(data, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert got[3]["text"] == "text 3" and got[3]["n_dropped"] == 2 and got[3]["host"] == "a.example"
    assert got[50]["text"] == "Home\nalone\n&copy; us" and got[51]["text"] == "" and got[52]["n_lines"] == 0
    assert linededup.drop_site_lines(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chat_round_trip_and_sharing(spark):
    trap = "</s>[INST] ok [/INST] <s>[ROLE] ␛␛ | [/ROLE]<<SYS>>"
    talks = {
        1: [("user", "hi"), ("assistant", "yes"), ("user", "more")], 2: [("user", "hi"), ("assistant", "yes"), ("user", "else")], 3: [("user", "hi"), ("assistant", "yes")],
        4: [("user", "hi"), ("assistant", "yes"), ("user", "more")], 5: [(trap, trap), ("assistant", trap)], 6: [("user", None), (None, "x")], 7: [("assistant", "")], None: [("user", "n")],
        8: [("user", "hi")] + [("assistant", str(i)) for i in range(60)], 9: [("user", "same")] * 5, 10: [("user", LONG), ("assistant", LONG)],
    }
    data = [(c, i, r, t) for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    table = spark.createDataFrame(data, "conv_id long, turn int, role string, text string").withColumn("path", F.lit(0))
    tree = chat.build_tree(table)
    back = {r["conv_id"]: r for r in chat.read_back(tree).collect()}
    for c, turns in talks.items():
        assert [tuple(t) for t in back[c]["turns"]] == [(r or "", t or "") for r, t in turns]
        assert back[c]["learned"] == "".join(t or "" for r, t in turns if r == "assistant")
    nodes = tree.nodes.toPandas().sort_values("start")
    prefixes = {tuple(map(tuple, turns[: i + 1])) for turns in talks.values() for i in range(len(turns))}
    assert len(nodes) == len(prefixes)  # each shared prefix once
    assert (nodes["start"].iloc[1:].to_numpy() == nodes["stop"].iloc[:-1].to_numpy()).all() and nodes["start"].iloc[0] == 0
    for r in nodes.itertuples():  # ancestors are just as long as the position says
        assert sum(a["stop"] - a["start"] for a in r.attends) == r.position
        assert all(a["stop"] <= r.start for a in r.attends)
    assert chat.read_back(chat.build_tree(table.limit(0))).count() == 0
    users = {r["node"]: r["users"] for r in tree.nodes.collect()}
    assert sum(users.values()) == sum(len(t) for c, t in talks.items() if c != 4)  # 4 is a copy of 1


def test_chat_of_equal_turn_numbers_and_repeated_rows(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, None, "system", "first"), (1, 0, "user", "a")]
    back = chat.read_back(chat.build_tree(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).first()
    texts = sorted(["a", "a", "b"], key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert [tuple(t) for t in back["turns"]] == [("system", "first"), ("assistant", "z")] + [("user", t) for t in texts]


def test_crf_marginals_are_brute_force():
    rng = np.random.default_rng(5)
    lengths = np.array([1, 4, 3, 0, 5])
    scores, moves = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3))
    got = crf.marginals(scores, lengths, moves)
    at = 0
    for n in lengths:
        want = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n) if n else []:
            w = np.exp(sum(scores[at + t, path[t]] for t in range(n)) + sum(moves[path[t], path[t + 1]] for t in range(n - 1)))
            for t in range(n):
                want[t, path[t]] += w
        if n:
            assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def quality_tables(spark):
    good = "Plain words make up this quiet sentence number {}. And one more follows it."
    bad = "*** buy$$$ now### {} ***\n | a | b | c |"
    texts = [(good if i % 3 else bad).format(i) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)] + [(600, None, None, None), (601, "", "en", None), (602, LONG, "en", "s"), (None, texts[0], "en", "s")], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 600)] + [(0, 1), (None, 1), (5, None), (7, 3)], "doc_id long, quality int")
    return docs, labels


def test_quality(spark):
    docs, labels = quality_tables(spark)
    out = quality.score_quality(docs.withColumn("score", F.lit("old")), quality.fit_quality(docs, labels)).toPandas()
    assert len(out) == 604 and out["score"].between(0, 1).all()
    known = out[out["doc_id"] < 600]
    assert ((known["doc_id"] % 3 > 0).astype(int) == known["predicted"]).mean() > 0.98
    none = quality.fit_quality(docs, labels.limit(0))
    assert (quality.score_quality(docs, none).toPandas()["score"] == 0.5).all()
    assert quality.score_quality(docs.limit(0), none).count() == 0


def test_language(spark):
    rng = np.random.default_rng(6)
    stems = {"aa": ["zor", "miv", "tak"], "bb": ["lou", "pee", "nai"], "cc": ["sch", "wir", "und"]}
    speak = lambda l, n: " ".join("".join(rng.choice(stems[l], rng.integers(1, 3))) for _ in range(n))  # noqa: E731, E741
    data = [(i, speak(k, 12), k, "s") for i, k in enumerate(list(stems) * 120)]
    data += [(900, None, "aa", "s"), (901, "123 !!", "aa", "s"), (902, speak("aa", 40) + " " + speak("bb", 9), None, "s"), (903, "zor " * 30_000, None, "s"), (None, "zor", "aa", "s")]
    docs = spark.createDataFrame(data, DOCS)
    out = langid.predict_language(docs.withColumn("score", F.lit(1)), langid.fit_languages(docs)).toPandas().sort_values("doc_id").set_index("doc_id")
    assert (out["lang"] == out["lang_pred"]).iloc[:360].mean() > 0.97
    assert out.loc[900, "lang_pred"] == out.loc[901, "lang_pred"] == "und" and out.loc[902, "lang_pred"] == out.loc[903, "lang_pred"] == "aa"
    assert out["score"].between(0, 1).all()
    empty = langid.fit_languages(docs.limit(0))
    assert set(langid.predict_language(docs, empty).toPandas()["lang_pred"]) == {"und"}


def test_mixing(spark):
    rng = np.random.default_rng(7)
    data = [(i, "t " * int(n), ["en", "fr", None][i % 3], "big" if i % 4 else "small") for i, n in enumerate(rng.integers(1, 60, 4000))]
    docs = spark.createDataFrame([*data, (5000, None, "fr", "none"), (None, "x", "en", "big")], DOCS).withColumn("weight", F.lit(9))
    dims = {"src": F.col("source"), "lg": F.col("lang")}
    aims = {"src": {"big": 0.5, "small": 0.5}, "lg": {"en": 0.5, "fr": 0.25, "": 0.25}}
    out = mixing.mix_to_targets(docs, dims, mixing.tokens_of(F.col("text")), targets=aims, whole_share=0.0).toPandas()
    assert len(out) == 4002 and out["probability"].between(0, 1).all() and not out[out["src"] == "none"]["sampled"].any()
    taken = out[out["sampled"]]
    for dim, aim in aims.items():
        share = taken.groupby(dim)["tokens"].sum() / taken["tokens"].sum()
        assert all(abs(share[k] - v) < 0.05 for k, v in aim.items())
    assert mixing.mix_to_targets(docs.limit(0), dims, mixing.tokens_of(F.col("text"))).count() == 0


def test_mixing_in_spark_is_mixing_on_the_driver(spark):
    rng = np.random.default_rng(17)
    data = [(i if i % 9 else None, "t " * int(n), ["en", "fr", None][i % 3], f"s{i % 7}") for i, n in enumerate(rng.integers(0, 60, 500))]
    docs = spark.createDataFrame(data, DOCS)
    dims = {"src": F.col("source"), "lg": F.col("lang")}
    for aims in ({}, {"src": {"s1": 0.5, "s2": 0.5}}):
        args = (dims, mixing.tokens_of(F.col("text")), mixing.draw_key(F.col("doc_id"), F.col("text")), aims)
        small, large = (mixing.mix_to_targets(docs, *args, rounds=6, whole_share=0.2, driver_cells=n).toPandas().sort_values(["text", "src", "lg", "doc_id"]) for n in (1000, 1))
        assert np.allclose(small["weight"], large["weight"]) and np.allclose(small["probability"], large["probability"])
        assert (small["sampled"].to_numpy() == large["sampled"].to_numpy()).all()
    drawn_by = mixing.draw_of(mixing.draw_key(F.col("doc_id"), F.col("text")))
    assert docs.where("doc_id is null").select(drawn_by).distinct().count() > 20  # rows without an id are drawn by their texts


def test_rake_reaches_both_marginals():
    cells = np.array([(i, j) for i in range(3) for j in range(2)])
    out = mixing.rake(cells, np.arange(1.0, 7.0), [np.array([0.2, 0.3, 0.5]), np.array([0.6, 0.4])], 50)
    assert np.allclose(np.bincount(cells[:, 0], out), [0.2, 0.3, 0.5]) and np.allclose(np.bincount(cells[:, 1], out), [0.6, 0.4])


def test_chat_of_one_long_conversation(spark):
    """Rows without an id are one conversation; its turns cost no more than those of short ones."""
    n = 30_000
    rows = spark.range(n).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("say "), "id").alias("text"))
    short = rows.where("turn < 3").withColumn("conv_id", F.lit(1).cast("long"))
    tree = chat.build_tree(rows.union(short))
    assert tree.nodes.count() == n and tree.nodes.agg(F.max("users")).first()[0] == 2
    back = {r["conv_id"]: r for r in chat.read_back(tree).select("conv_id", "turns", "learned").collect()}
    assert [t["text"] for t in back[None]["turns"]] == [f"say {i}" for i in range(n)] and len(back[1]["turns"]) == 3
    assert back[None]["learned"] == "".join(f"say {i}" for i in range(1, n, 2))
    last = tree.nodes.orderBy(F.desc("depth")).select("start", "position", "attends").first()
    assert last["start"] == last["position"] and [(x["start"], x["stop"]) for x in last["attends"]] == [(0, last["start"])]


def test_chat_of_many_copies(spark):
    """Copies of a frequent conversation are dealt out, and none is lost or doubled."""
    copies = spark.range(2_000).select(F.col("id").alias("conv_id"), F.when(F.col("id") % 3 == 0, F.lit("a")).otherwise(F.concat(F.lit("b"), F.col("id") % 700)).alias("leaf"))
    leaves = copies.select("leaf").distinct().withColumn("said", F.upper("leaf"))
    out = chat.to_copies(copies, leaves).collect()
    assert sorted(r["conv_id"] for r in out) == list(range(2_000)) and all(r["said"] == r["leaf"].upper() for r in out)
    few = chat.to_copies(copies.where("conv_id < 4"), leaves)
    assert sorted(r["conv_id"] for r in few.collect()) == [0, 1, 2, 3]
    assert chat.to_copies(copies.limit(0), leaves).count() == 0


def test_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    cases = {
        "http://a.Example.NET/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"), "https://x.net/?q#f": ("x.net", "/", "net/", "block"), "https://x.net?q": ("x.net", "", None, None),
        "http://example.com/de/x#y": ("example.com", "/de/x", "example.com/de/", "block"), "http://notexample.com/de/x": ("notexample.com", "/de/x", None, None),
        "u.org/fr/1": ("", "", None, None), "http://w.org/fr/?a=b": ("w.org", "/fr/", "org/fr/", "allow"), "a?b=http://z.net/en/": ("z.net", "/en/", "net/", "block"), "": ("", "", None, None),
        "http://": ("", "", None, None),
    }
    data = [(i, u, "x") for i, u in enumerate(cases)] + [(99, None, "x"), (99, None, "x")]
    data += [(1000 + i, f"http://h{i % 9}.{t}/{p}/{i}", "x") for i in range(200) for t, p in (("net", "en"), ("org", "fr"))]
    got = urlfilter.judge_urls(spark.createDataFrame(data, "page_id long, url string, host string"), rules).collect()
    assert len(got) == len(data) and all(r["verdict"] in ("allow", "block") for r in got)
    by_id = {r["page_id"]: r for r in got}
    for i, want in enumerate(cases.values()):
        r = by_id[i]
        assert (r["host"], r["path"], r["rule"]) == want[:3] and want[3] in (None, r["verdict"])
    assert urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_urls_learned_from_labels(spark):
    """Held-out urls: what the trees say agrees with labels that depend on form alone, on suffixes they have not seen."""
    rng = np.random.default_rng(21)
    words = ["alpha", "beta", "gamma", "delta"]
    good = lambda i: f"https://{rng.choice(words)}{i}.{['com', 'org', 'net'][i % 3]}/{rng.choice(words)}/{rng.choice(words)}"
    bad = lambda i: f"http://{i * 7919 % 10_007}-{i}.{['com', 'org', 'net'][i % 3]}/a?id={i}&x={i * 31}&y=1&s={i * 17}"
    labelled = spark.createDataFrame([(good(i), "allow") for i in range(400)] + [(bad(i), "block") for i in range(400)] + [(None, "block"), ("http://z", None)], "url string, verdict string")
    held = [(i, good(10_000 + i)) for i in range(100)] + [(1000 + i, bad(10_000 + i)) for i in range(100)] + [(5000, "http://" + "a" * 100_000)]
    out = urlfilter.judge_urls(spark.createDataFrame(held, "page_id long, url string"), [], labelled).toPandas()
    low, high = out[out["page_id"] < 1000]["score"].to_numpy(), out[out["page_id"].between(1000, 4999)]["score"].to_numpy()
    auc = (high[:, None] > low).mean() + 0.5 * (high[:, None] == low).mean()
    assert auc > 0.97 and len(out) == 201


def test_vectors_are_brute_force(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(60, 16))
    v = [c + rng.normal(size=16) * 0.03 for c in centre for _ in range(4)] + [centre[0]] * 30 + [centre[1] * 2.5]
    label = [i % 3 for i in range(60) for _ in range(4)] + [0] * 30 + [1]
    data = [(i, x.tolist(), k) for i, (x, k) in enumerate(zip(v, label, strict=True))]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, centre[0].tolist(), None), (905, [], 1), (906, [1.0, 0.0], 1), (907, [2.0, 0.0], 1)]
    table = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(table).collect()}
    x = np.array([r[1] for r in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (np.array(label)[:, None] == np.array(label))
    np.fill_diagonal(near, False)
    least = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(least[i], least[near[i]].min(initial=10**9)) for i in range(len(x))])
        if (new == least).all():
            break
        least = new
    want = {i: (int(near[i].sum()), int(least[i]), int(least[i]) == i) for i in range(len(x))}
    want |= {i: (0, i, True) for i in (900, 901, 902, 903, 904, 905)} | {906: (1, 906, True), 907: (1, 906, False)}
    assert got == want
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_repeated_vectors_and_split_lists(spark):
    """Lists are split into parts, ids repeat, lengths differ in size: nothing is lost or counted twice."""
    rng = np.random.default_rng(31)
    centre = rng.normal(size=(8, 24))
    x = np.concatenate([c + rng.normal(size=(40, 24)) * 0.02 for c in centre]).astype(np.float32)
    x[::7] *= np.float32(1e-25)
    data = [(i % 300, v.tolist(), "l") for i, v in enumerate(x)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(table, list_size=40, part_rows=30).collect())
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    ids = np.arange(len(x)) % 300
    least = ids.copy()
    for _ in range(len(x)):
        least = np.array([least[n].min() for n in near])
    assert got == sorted((int(i), int(n.sum()) - 1, int(c)) for i, n, c in zip(ids, near, least, strict=True))


def test_letters_are_alphabetic():
    assert langid.words_of("² ½ Ⅷ ① 123 _") == [] and langid.words_of("aⅧb É²x") == ["a", "b", "é", "x"]


def test_language_and_quality_of_many_lines_and_repeats(spark):
    docs, labels = quality_tables(spark)
    model = quality.fit_quality(docs, labels)
    many = "Plain words make up this line.\n" * 30_000
    lines = quality._lines(many)
    assert np.allclose(model.line_scores(lines[:20_000])[5:100], quality.line_features("\n".join(lines[:20_000]))[5:100] @ model.weights)
    odd = spark.createDataFrame([(1, many), (1, many), (2, "\n\n \n"), (3, None)], "doc_id long, text string")
    out = quality.score_quality(odd, model).toPandas()
    assert len(out) == 4 and out["score"].between(0, 1).all() and out[out["doc_id"] == 1]["score"].nunique() == 1
    again = quality.fit_quality(docs.union(docs), labels)
    assert np.allclose(again.weights, model.weights)  # repeated rows teach nothing new


def test_language_features_cover_the_whole_word():
    long = "a" * 50 + "qxz" + "b" * 50
    slot = zlib.crc32(b"qxz") % langid.SLOTS
    assert slot in langid.word_features(long, {}) and slot not in langid.word_features("a" * 50 + "b" * 50, {})
