"""The subpackage's queries: against DuckDB where SQL can express them, else their contracts, on the smallest tables."""

import math
import re
import zlib

import numpy as np
import pytest

from locusframe.llm import langid, quality
from locusframe.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import brute_components, brute_fingerprint
from tests.test_queries import FOLDER, needs_tables, same_rows

pytestmark = needs_tables


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same_rows(spark, QUERIES[name], ORACLE_SQL[name], FOLDER)


def test_fingerprints_of_all_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas().sort_values("doc_id")
    prints = [brute_fingerprint(t) for t in docs["text"]]
    ids = docs["doc_id"].tolist()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op10_simhash_near_dedup"](spark, FOLDER).collect()}
    assert got == {i: (f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, brute_components(prints), strict=True)}


def test_shards_of_all_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas().set_index("doc_id")["text"]
    out = QUERIES["op4_sharding"](spark, FOLDER).toPandas().set_index("doc_id")
    assert sorted(out.index) == sorted(docs.index) and out["grown_shard"].isna().all() and set(out["law"]) == {"bytes"}
    raw = docs.map(lambda t: (t or "").encode())
    assert (out["size"] == raw.map(len).reindex(out.index) + 16).all()
    assert (out["text_crc32"] == raw.map(zlib.crc32).reindex(out.index)).all()
    for _, slots in out.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    sizes = out.groupby("shard")["size"].sum()
    assert set(out["shard"]) == set(range(40))
    # No shard is over the mean unless by one row of its own, which no law can cut.
    assert sizes.max() <= max(1.2 * sizes.mean(), out["size"].max() + 16)


def test_urls_of_all_pages(spark):
    out = QUERIES["op7_url_filter"](spark, FOLDER).toPandas().set_index("page_id")
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").toPandas().set_index("page_id")["url"]
    assert sorted(out.index) == sorted(pages.index) and out["verdict"].isin(["allow", "block"]).all()
    rules = {"net/": ("net", "/", "block"), "example.net/en/": ("example.net", "/en/", "allow"), "example.com/de/": ("example.com", "/de/", "block"), "org/fr/": ("org", "/fr/", "allow")}
    for page, url in pages.items():
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest).group()
            path = re.match(r"[^?#]*", rest[len(host) :]).group()
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [name for name, (h, p, _) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=len, default=None)
        r = out.loc[page]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert rule is None or r["verdict"] == rules[rule][2]


def test_held_out_documents(spark):
    """Neither model has seen them: their languages, and their quality where it is labelled."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas().set_index("doc_id")
    held = docs.index.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    language = QUERIES["op5_language_id"](spark, FOLDER).toPandas().set_index("doc_id").reindex(docs.index)
    assert (language["held_out"] == held).all() and language["score"].between(0, 1).all()
    known = held & docs["lang"].notna() & docs["text"].notna()
    assert (language["lang_pred"] == docs["lang"])[known].mean() > 0.95
    good = QUERIES["op8_quality_classifier"](spark, FOLDER).toPandas().set_index("doc_id").reindex(docs.index)
    assert (good["held_out"] == held).all() and good["score"].between(0, 1).all() and ((good["score"] >= 0.7) == (good["predicted"] == 1)).all()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas().drop_duplicates("doc_id").set_index("doc_id")["quality"].reindex(docs.index)
    seen = held & labels.isin([0, 1])
    assert seen.sum() >= 5 and (good["predicted"] == labels)[seen].mean() > 0.9


def test_language_scores_are_forward_backward(spark):
    """The query's scores, from its own model's weights by plain loops over words."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.fit_languages(docs)
    out = QUERIES["op5_language_id"](spark, FOLDER).toPandas().set_index("doc_id")
    k, step = len(model.languages), np.exp(model.moves)
    for r in docs.orderBy("doc_id").collect():
        words = langid.words_of(r["text"])
        if not words:
            assert tuple(out.loc[r["doc_id"], ["lang_pred", "score"]]) == ("und", 0.0)
            continue
        emit = np.array([np.exp(sum(model.weights[f].astype(float) for f in langid.word_features(w, model.lexicon))) for w in words])
        ahead, back = [emit[0]], [np.ones(k)]
        for e in emit[1:]:
            ahead.append(np.array([sum(ahead[-1][i] * step[i, j] for i in range(k)) for j in range(k)]) * e)
            ahead[-1] /= ahead[-1].sum()
        for e in emit[:0:-1]:
            back.insert(0, np.array([sum(step[i, j] * e[j] * back[0][j] for j in range(k)) for i in range(k)]))
            back[0] /= back[0].sum()
        both = np.array([a * b / (a * b).sum() for a, b in zip(ahead, back, strict=True)]).mean(axis=0)
        assert out.loc[r["doc_id"], "lang_pred"] == model.languages[both.argmax()] and abs(out.loc[r["doc_id"], "score"] - both.max()) < 1e-4


def plain_features(lines, i):
    """What a line says of itself, in plain loops."""
    line = lines[i]
    raw, words = line.encode("utf-8", "surrogatepass"), line.split()
    n, k = max(1, len(raw)), max(1, len(words))
    same = sum(1 for x in lines if x == line)
    count = lambda chars: sum(1 for b in raw if chr(b) in chars)
    return [
        math.log(1 + len(line)), math.log(1 + len(words)), min(len(line) / k, 40) / 10, 10 * count("*#$%&@^~=<>{}[]\\/_+`") / n, 2 * count("|") / k,
        4 * count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n, 10 * count("0123456789") / n, 2 * count("!") / k, 4 * count(".,") / k, len(set(words)) / k,
        3 * sum(1 for a, b in zip(words, words[1:], strict=False) if a == b) / k, 1.0 if same > 1 else 0.0, min(same - 1, 8) / 4,
        1.0 if line[:1].isupper() else 0.0, 1.0 if line and line[-1] in ".!?" else 0.0, 1.0 if len(words) < 4 else 0.0, 1.0,
    ]


def test_quality_scores_are_forward_backward(spark):
    """The query's scores of all rows, from its own model's weights by plain loops over lines."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    out = QUERIES["op8_quality_classifier"](spark, FOLDER).toPandas().set_index("doc_id")["score"]
    step = [[math.exp(x) for x in row] for row in model.moves]
    assert len(out) == docs.count()
    for r in docs.collect():
        lines = [x for x in (r["text"] or "").split("\n") if x.strip()] or [""]
        own = [plain_features(lines, i) for i in range(len(lines))]
        emit = []
        for i in range(len(lines)):
            before = own[i - 1][:-1] if i else [0.0] * (len(own[0]) - 1)
            after = own[i + 1][:-1] if i + 1 < len(lines) else [0.0] * (len(own[0]) - 1)
            row = [*own[i], *before, *after, float(i == 0), float(i + 1 == len(lines))]
            total = [sum(x * w[y] for x, w in zip(row, model.weights, strict=True)) for y in (0, 1)]
            emit.append([math.exp(t - max(total)) for t in total])
        ahead, back = [emit[0]], [[1.0, 1.0]]
        scaled = lambda pair: [x / sum(pair) for x in pair]
        for e in emit[1:]:
            ahead.append(scaled([sum(ahead[-1][i] * step[i][j] for i in (0, 1)) * e[j] for j in (0, 1)]))
        for e in reversed(emit[1:]):
            back.append(scaled([sum(step[i][j] * e[j] * back[-1][j] for j in (0, 1)) for i in (0, 1)]))
        good = [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(ahead, reversed(back), strict=True)]
        size = [max(1, len(x)) for x in lines]
        assert abs(out[r["doc_id"]] - sum(g * n for g, n in zip(good, size, strict=True)) / sum(size)) < 1e-6, r["doc_id"]
