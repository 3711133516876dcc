"""Benchmark decontamination by a prefix-filtered set join of word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm._common import ascii_lower, hinted, written

#: Runs of these separate words; digits, a-z and everything beyond ASCII belong to words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A benchmark table is broadcast up to this many rows (of some 100 bytes); a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS), ""), F.array().cast("array<string>"))


def _run(words: Column, start: Column, n: int) -> list[Column]:
    """``n`` words from ``start`` (0-based) on; null beyond the end."""
    return [F.get(words, start + i) for i in range(n)]


def benchmark_windows(bench: DataFrame, item_id: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(wid, words, n) for each distinct window, and (wid, item) for the items that have it, null for those without an id."""
    items = bench.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1))))
    each = items.select("item", "w", starts.alias("s")).select("item", F.slice("w", F.col("s"), window).alias("words"))
    grouped = each.groupBy("words").agg(F.collect_set(F.struct("item")).alias("items"))
    ided = written(grouped.withColumn("wid", F.monotonically_increasing_id()).withColumn("n", F.size("words")))
    return ided.select("wid", "words", "n"), ided.select("wid", F.explode("items.item").alias("item"))


def find_contaminated(
    docs: DataFrame,
    bench: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    shingle: int = 3,
    hit_share: int = 20,
) -> DataFrame:
    """Returns, for every row of ``docs``, how much of it benchmark windows cover.

    Columns: the document's id, n_words, n_hit (words inside any occurrence of a window), n_items (items with
    an occurring window), items_sha256 (of their ids, sorted as strings, comma-joined), contaminated
    (n_hit > 0 and ``hit_share`` * n_hit >= n_words). A window is ``window`` consecutive words of an item; a
    shorter item is one window.

    A window is a set of placed shingles of ``shingle`` words (of all its words if it has fewer), and a document
    holds it only if it has all of them. One scan finds the places of benchmark shingles in all documents and so
    their rarity. Shingles are ordered by rarity; as all must be present, the necessary prefix is the rarest
    alone. Documents that have it give a place for the window, which must lie inside the document (length and
    position); then each shingle of the window must stand at its own place (exact containment; words, not
    hashes, are compared).

    Null or empty texts have no words and no hits; rows are told apart by their place in the input, so repeated
    rows and null ids are kept. Items without an id count in n_hit, together as one in n_items, and not in items_sha256. Nothing is collected but shingle lengths.
    """
    windows, items = benchmark_windows(bench, item_id, item_text, window)
    lengths = F.least(F.col("n"), F.lit(shingle))
    pieces = windows.select("wid", "n", "words", lengths.alias("k")).select(
        "wid", "n", "k", "words", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("k"))).alias("j")
    )
    b = [f"b{i}" for i in range(shingle)]
    w = [f"w{i}" for i in range(shingle)]
    cells = [F.when(F.col("k") > i, F.get("words", F.col("j") + i)).alias(b[i]) for i in range(shingle)]
    pieces = written(pieces.select("wid", "n", "k", "j", *cells))
    shingles = written(pieces.select("k", *b).distinct().withColumn("sid", F.monotonically_increasing_id()))
    same = [F.col(f"p.{x}").eqNullSafe(F.col(f"s.{x}")) for x in b]
    parts = pieces.alias("p").join(shingles.alias("s"), [F.col("p.k") == F.col("s.k"), F.col("p.b0") == F.col("s.b0"), *same[1:]])
    parts = written(parts.select("wid", "n", "j", "sid"))
    ks = sorted(r[0] for r in shingles.select("k").distinct().collect())

    # One scan: the places of all benchmark shingles, and each row's last place for its number of words.
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("w")
    )
    shifted = [F.col("w"), *(F.slice("w", i + 1, F.greatest(F.lit(1), F.size("w"))) for i in range(1, shingle))]
    zipped = F.arrays_zip(*(c.alias(x) for c, x in zip(shifted, w, strict=True)))
    places = rows.select("rid", "doc_id", F.size("w").alias("n_words"), F.posexplode_outer(zipped).alias("pos", "z"))
    places = places.select("rid", "doc_id", "n_words", "pos", *(F.col(f"z.{x}").alias(x) for x in w))
    found = []
    for k in ks:
        own = shingles.where(F.col("k") == k).select(
            F.col("sid").alias(f"sid{k}"), *(F.col(x).alias(f"{x}_{k}") for x in b[:k]), F.xxhash64(*b[:k]).alias(f"h{k}")
        )
        match = [F.xxhash64(*w[:k]) == F.col(f"h{k}"), *(F.col(w[i]) == F.col(f"{b[i]}_{k}") for i in range(k))]
        places = places.join(hinted(own, BROADCAST_ROWS), match, "left")
        found.append(F.col(f"sid{k}"))
    sids = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<bigint>")
    last = F.col("pos").isNull() | (F.col("pos") == F.col("n_words") - 1)
    places = places.select("rid", "doc_id", "n_words", "pos", sids.alias("sids"), last.alias("last"))
    places = written(places.where("last or size(sids) > 0"))
    hits = places.select("rid", "n_words", "pos", F.explode("sids").alias("sid"))

    # The rarest shingle of each window is its prefix.
    rarity = written(hits.groupBy("sid").count())
    ranked = parts.join(rarity, "sid")
    whole = ranked.groupBy("wid").agg(F.count("*").alias("there"), F.min(F.struct("count", "sid", "j")).alias("first"))
    sized = parts.groupBy("wid").agg(F.count("*").alias("m"), F.first("n").alias("n"))
    prefixes = written(
        whole.join(sized, "wid").where("there = m").select("wid", "n", "m", F.col("first.sid").alias("sid"), F.col("first.j").alias("j"))
    )
    starts = hits.join(hinted(prefixes, BROADCAST_ROWS), "sid").withColumn("start", F.col("pos") - F.col("j"))
    starts = starts.where("start >= 0 and start + n <= n_words").select("rid", "wid", "n", "m", "start")
    needed = parts.join(prefixes.select("wid"), "wid", "left_semi").select("wid", "j", "sid")
    wanted = starts.join(hinted(needed, BROADCAST_ROWS), "wid").withColumn("pos", F.col("start") + F.col("j"))
    there = wanted.join(hits.select("rid", "pos", "sid"), ["rid", "pos", "sid"], "left_semi")
    matched = written(
        there.groupBy("rid", "wid", "start", "n", "m").count().where(F.col("count") == F.col("m")).select("rid", "wid", "start", "n")
    )

    # Words under any match, each once; and the items.
    spans = matched.groupBy("rid", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    earlier = F.max("end").over(Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(earlier, F.lit(0)))))
    covered = spans.groupBy("rid").agg(F.sum("new").alias("n_hit"))
    wids = matched.select("rid", "wid").distinct()
    named = wids.join(hinted(items, BROADCAST_ROWS), "wid").groupBy("rid").agg(
        F.sort_array(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull().cast("long")).alias("unnamed")
    )
    names = F.coalesce("items", F.array().cast("array<string>"))
    n_words, n_hit = F.col("n_words").cast("long"), F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return (
        places.where("last").select("rid", "doc_id", "n_words")
        .join(covered, "rid", "left").join(named, "rid", "left")
        .select(
            F.col("doc_id").alias(doc_id), n_words.alias("n_words"), n_hit.alias("n_hit"), (F.size(names) + F.coalesce("unnamed", F.lit(0))).cast("long").alias("n_items"),
            F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
            ((n_hit > 0) & (hit_share * n_hit >= n_words)).alias("contaminated"),
        )
    )
