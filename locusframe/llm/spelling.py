"""Spelling variants: every word against all words at edit distance one, by tries that are broadcast in shards."""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm._common import ascii_lower, hinted, written
from locusframe.session import fresh_path, importable

#: Runs of letters of which words are made: all in one byte of Latin-1.
RUNS = r"[A-Za-zÀ-ÿ]{%d,}"
#: Words that one task looks for.
TASK_WORDS = 1 << 15


def counted_words(docs: DataFrame, least: int = 7, twice: int = 2, every: int = 31, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(word, n): maximal runs of letters, A-Z lower-cased, of ``least`` letters and ``twice`` occurrences at least.

    With h the crc32 of ``<doc_id>:<run>``, runs whose h ``every`` divides lose the letter h modulo their length. A null id counts
    as the empty text; null texts have no runs.
    """
    # A shorter run can't become a word, so only runs of the least length are taken out of the text.
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUNS % least), F.lit(0))).alias("run"))
    runs = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"), F.length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    words = hashed.select(F.when(F.col("h") % every == 0, lost).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= twice)


@dataclass(frozen=True)
class Trie:
    """Words as a trie in arrays. Node k has the letter ``labels[k]`` and the children ``first[k]`` to ``first[k + 1] - 1``; if a word ends
    there, ``final[k]`` is its number, else -1. Nodes are numbered by depth, then in order of their words."""

    labels: str
    first: Sequence[int]
    final: Sequence[int]
    flat: bytes
    ends: Sequence[int]
    counts: Sequence[int]

    def word(self, i: int) -> str:
        return self.flat[self.ends[i - 1] if i else 0 : self.ends[i]].decode("latin-1")


def trie_bytes(words: Sequence[str], counts: Sequence[int]) -> tuple[bytes, ...]:
    """A trie of sorted distinct words, packed: labels, first, final, flat, ends, counts."""
    flat = "".join(words).encode("latin-1")
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size)
    letters, begin = np.frombuffer(flat, np.uint8), ends - size
    labels, children, final = [np.zeros(1, np.uint8)], [], [np.full(1, -1, np.int32)]
    alive, node, depth = np.arange(len(words)), np.zeros(len(words), np.int64), 0
    if len(words) and size[0] == 0:
        final[0][0], alive, node = 0, alive[1:], node[1:]
    nodes = 1
    while len(alive):
        letter = letters[begin[alive] + depth]
        new = np.ones(len(alive), bool)
        new[1:] = (node[1:] != node[:-1]) | (letter[1:] != letter[:-1])
        number = np.cumsum(new) - 1
        labels.append(letter[new])
        children.append(np.bincount(node[new], minlength=nodes))
        nodes = int(number[-1]) + 1
        ending = size[alive] == depth + 1
        level = np.full(nodes, -1, np.int32)
        level[number[ending]] = alive[ending]
        final.append(level)
        alive, node, depth = alive[~ending], number[~ending], depth + 1
    children.append(np.zeros(nodes, np.int64))
    first = np.concatenate([[1], 1 + np.cumsum(np.concatenate(children))]).astype(np.int32)
    return np.concatenate(labels).tobytes(), first.tobytes(), np.concatenate(final).tobytes(), flat, ends.astype(np.int32).tobytes(), np.asarray(counts, np.int64).tobytes()


def unpacked(parts: Sequence[bytes]) -> Trie:
    labels, first, final, flat, ends, counts = parts
    return Trie(labels.decode("latin-1"), array("i", first), array("i", final), flat, array("i", ends), array("q", counts))


def neighbours(word: str, trie: Trie) -> list[int]:
    """The numbers of the trie's words that are one insertion, deletion or replacement from ``word``, each once.

    The word's Levenshtein automaton and the trie are walked together, depth first. Before its edit the automaton has one state
    at each depth: the word's own path. At each of its nodes the edit is tried, and what follows must be the rest of the word. Of
    edits that give the same word only the last is tried: deleting from a run of one letter, or putting that letter into it.
    """
    labels, first, final, find, n = trie.labels, trie.first, trie.final, trie.labels.find, len(word)
    found: list[int] = []
    node = 0
    for i in range(n):
        letter, low, high = word[i], first[node], first[node + 1]
        if i + 1 == n or word[i + 1] != letter:  # deleted
            k, j = node, i + 1
            while j < n:
                k = find(word[j], first[k], first[k + 1])
                if k < 0:
                    break
                j += 1
            else:
                if final[k] >= 0:
                    found.append(final[k])
        own = -1
        for child in range(low, high):
            if labels[child] == letter:
                own = child
                continue
            for j in (i + 1, i):  # replaced, inserted before
                k = child
                while j < n:
                    k = find(word[j], first[k], first[k + 1])
                    if k < 0:
                        break
                    j += 1
                else:
                    if final[k] >= 0:
                        found.append(final[k])
        if own < 0:
            return found
        node = own
    found.extend(final[k] for k in range(first[node], first[node + 1]) if final[k] >= 0)  # inserted at the end
    return found


def trie_shards(words: DataFrame, shard_words: int, shard_chars: int) -> DataFrame:
    """(part, k, bytes, trie): the tries of ranges of words (word, n), each of ``shard_words`` words and ``shard_chars`` letters at most, or
    of one longer word. Tasks build them from Spark's sampled ranges."""
    total = words.count()
    ranged = words.repartitionByRange(max(1, -(-total // shard_words)), "word").sortWithinPartitions("word").withColumn("part", F.spark_partition_id())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, chars, k, part = [], [], 0, 0, 0
        row = lambda: pa.record_batch([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([list(trie_bytes(now, counts))], pa.list_(pa.binary()))], ["part", "k", "trie"])
        for batch in batches:
            for word, n, part in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "part")), strict=True):  # noqa: B020
                if now and (len(now) >= shard_words or chars + len(word) > shard_chars):
                    yield row()
                    now, counts, chars, k = [], [], 0, k + 1
                now.append(word)
                counts.append(n)
                chars += len(word)
        if now:
            yield row()

    built = ranged.mapInArrow(build, "part int, k int, trie array<binary>")
    return built.select("part", "k", F.aggregate("trie", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x)).alias("bytes"), "trie")


def _blocks(sizes: Sequence[tuple[int, int, int]], most: int) -> Iterator[list[tuple[int, int]]]:
    """Shards in blocks of ``most`` bytes together, or of one larger shard."""
    block, held = [], 0
    for part, k, size in sizes:
        if block and held + size > most:
            yield block
            block, held = [], 0
        block.append((part, k))
        held += size
    if block:
        yield block


def near_words(words: DataFrame, shard_words: int = 1 << 18, shard_chars: int = 1 << 23, block_bytes: int = 64 << 20) -> DataFrame:
    """(word, n, n_near, best_n, best): how many of ``words`` (word, n; distinct) are one edit from each, and the one of largest n (of
    these the least word); null where there is none.

    Tries go to the executors in blocks of ``block_bytes`` at most, whatever the number of words; a block is one job over all
    words, in which a word's neighbours are reduced before they leave the task. What the blocks give is added up by a shuffle.
    """
    spark = words.sparkSession
    importable(spark)
    # Words are few bytes for their work, so they are dealt out by number.
    dealt = words.repartition(max(1, -(-words.count() // TASK_WORDS)))
    shards = written(trie_shards(words, shard_words, shard_chars))
    sizes = [(r["part"], r["k"], r["bytes"]) for r in shards.select("part", "k", "bytes").orderBy("part", "k").toLocalIterator()]
    path = fresh_path(spark)
    schema = "word string, n long, n_near long, best_n long, best string"
    for number, block in enumerate(_blocks(sizes, block_bytes) if sizes else [[]]):
        chosen = shards.where(F.struct("part", "k").between(F.struct(*map(F.lit, block[0])), F.struct(*map(F.lit, block[-1])))) if block else shards.limit(0)
        sent = spark.sparkContext.broadcast([r["trie"] for r in chosen.select("trie").collect()])
        dealt.mapInArrow(_search(sent, number == 0), schema).write.mode("append").parquet(path)
        sent.destroy()
    found = spark.read.schema(schema).parquet(path)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), "best")))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def _search(sent, all_words: bool):
    """The words' neighbours in the tries that were sent; a word without any gives a row only if ``all_words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [unpacked(x) for x in sent.value]
        for batch in batches:
            out: list[tuple] = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                near, best_n, best = 0, None, None
                for trie in tries:
                    found = neighbours(word, trie)
                    if found:
                        near += len(found)
                        i = min(found, key=lambda i: (-trie.counts[i], i))
                        if best is None or (-trie.counts[i], trie.word(i)) < (-best_n, best):
                            best_n, best = trie.counts[i], trie.word(i)
                if near or all_words:
                    out.append((word, n, near, best_n, best))
            if out:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["word", "n", "n_near", "best_n", "best"])

    return run


def last_forms(forms: DataFrame, small: int = 200_000) -> DataFrame:
    """(word, root) for rows (word, form): where following forms ends. Steps are doubled until none leads on: as many joins as the
    logarithm of the longest chain, which is short as each form is much more frequent than the one before."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = hinted(now.select(F.col("word").alias("root"), F.col("root").alias("next")), small)
        if now.join(ahead, "root", "left_semi").isEmpty():
            return now
        now = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def spelling_variants(words: DataFrame, ratio: int = 10, **limits: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for ``words`` (word, n).

    A word's form is the most frequent word one edit from it (of these the least in code-point order), if that has ``ratio`` times its
    occurrences or more, else null; root is where following forms ends, the word itself if it has none. Words must be distinct and not
    null, of letters up to U+00FF, as ``counted_words`` gives them; other columns are dropped. An empty table gives no rows.
    """
    near = near_words(words.select("word", F.col("n").cast("long").alias("n")), **limits)
    fits = F.col("best_n") >= ratio * F.col("n")
    rows = written(near.select("word", "n", F.col("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")))
    roots = last_forms(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
