"""Language of words in code-switched text, by a conditional random field over words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm import crf
from locusframe.llm._common import drawn, in_parts
from locusframe.llm.quality import held_out
from locusframe.session import importable

LETTERS = re.compile(r"[^\W\d_]+")
#: Features are hashed into so many slots; the lexicon's words follow after them.
SLOTS = 1 << 15
UNKNOWN = "und"
#: Words whose scores a worker keeps; it starts anew beyond that.
KEPT_WORDS = 300_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters (``str.isalpha``), in lower case."""
    found = LETTERS.findall(text.lower()) if text else []
    if not found or "".join(found).isalpha():
        return found
    # Numbers that are no decimal digits, such as fractions, are word characters but no letters.
    return [w for x in found for w in ([x] if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]


def word_features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Numbers of a word's features: affixes of 1 to 3 letters, n-grams of 2 and 3, and its lexicon entry."""
    marked = f"<{word}>"
    names = [f"p{marked[:k]}" for k in (2, 3, 4)] + [f"s{marked[-k:]}" for k in (2, 3, 4)]
    grams = (marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1))
    found = {zlib.crc32(x.encode("utf-8", "surrogatepass")) % SLOTS for x in chain(names, grams)}
    if word in lexicon:
        found.add(lexicon[word])
    return sorted(found)


def bags(words: list[str], lexicon: dict[str, int]) -> crf.Bags:
    rows = [word_features(w, lexicon) for w in words]
    sizes = np.array([len(r) for r in rows], np.int64)
    return crf.Bags(np.concatenate([np.array(r, np.int64) for r in rows]), np.cumsum(sizes) - sizes, SLOTS + len(lexicon))


@dataclass
class LanguageModel:
    languages: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    table: list[np.ndarray] = field(default_factory=list)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "table": []}

    def word_scores(self, words: np.ndarray) -> np.ndarray:
        """A row of label scores for each of these distinct words; scores of words seen before are kept."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.table = {}, []
        new = [w for w in words if w not in self.known]
        if new:
            first = len(self.known)
            self.known.update((w, first + i) for i, w in enumerate(new))
            self.table.append(bags(new, self.lexicon).dot(self.weights))
            self.table = [np.concatenate(self.table)]
        return self.table[0][np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Each text's language, of largest mean marginal over its words, and that mean."""
        each = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in each], np.int64)
        found, score = np.array([UNKNOWN] * len(texts), object), np.zeros(len(texts))
        if not self.languages or not lengths.sum():
            return found.tolist(), score
        codes, distinct = pd.factorize(np.array([w for words in each for w in words], object))
        probs = crf.marginals(self.word_scores(distinct)[codes], lengths, self.moves)
        some = np.flatnonzero(lengths)
        means = np.add.reduceat(probs, (np.cumsum(lengths) - lengths)[some], axis=0) / lengths[some][:, None]
        found[some] = np.array(self.languages, object)[means.argmax(axis=1)]
        score[some] = np.clip(means.max(axis=1), 0.0, 1.0)
        return found.tolist(), score


def fit_languages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    max_docs: int = 3_000, span: int = 60, max_lexicon: int = 4_000, rounds: int = 60,
) -> LanguageModel:
    """Trains on ``max_docs`` documents at most, ``span`` consecutive words at most of each.

    The sample is drawn by a 64-bit hash over all documents that have a text and a language and aren't held out: a
    chance of any size, so it doesn't run empty where documents are many. Its spans are cut into runs of 3 to 20 words that are joined, in a fixed mixed order, to code-switched
    sequences, from which the transitions are learned; labels are the documents' languages.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    slim = usable.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    # Drawn with the text, so rows that share an id are drawn apart; twice as many for those without letters.
    n = slim.count()
    some = slim.where(drawn(2 * max_docs, n, "language", "id", "text"))

    importable(docs.sparkSession)

    def spans(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i, x, y in zip(part["id"], part["text"], part["lang"], strict=True):
                words = words_of(x)
                first = zlib.crc32(i.encode()) % max(1, len(words) - span + 1)
                rows.append((i, y, words[first : first + span]))
            yield pd.DataFrame(rows, columns=["id", "lang", "words"])

    runs_of = some.mapInPandas(spans, "id string, lang string, words array<string>").where(F.size("words") > 0)
    # Repeated rows count once; what is left is bounded, and sorted so that the file layout doesn't matter.
    got = runs_of.distinct().orderBy(F.xxhash64("id", "words", F.lit("language")), "id", "lang").limit(max_docs).toPandas()
    got = got.sort_values("id", kind="stable")
    languages = sorted(got["lang"].unique())
    if not languages:
        return LanguageModel([], {}, np.zeros((SLOTS, 0)), np.zeros((0, 0)))
    rng = np.random.default_rng(5)
    number = {x: i for i, x in enumerate(languages)}
    runs = []
    for y, words in zip(got["lang"], got["words"], strict=True):
        i = 0
        while i < len(words):
            n = int(rng.integers(3, 21))
            runs.append((number[y], list(words[i : i + n])))
            i += n
    order = rng.permutation(len(runs))
    mixed = [w for i in order for w in runs[i][1]]
    labels = np.array([runs[i][0] for i in order for _ in runs[i][1]])
    lengths = np.full(-(-len(mixed) // 100), 100)
    lengths[-1] = len(mixed) - 100 * (len(lengths) - 1)
    codes, distinct = pd.factorize(np.array(mixed, object))
    often = np.argsort(-np.bincount(codes), kind="stable")[:max_lexicon]
    lexicon = {distinct[i]: SLOTS + n for n, i in enumerate(often)}
    weights, moves = crf.fit(bags(list(distinct), lexicon), codes, labels, lengths, len(languages), rounds, 0.1, 1e-6)
    return LanguageModel(languages, lexicon, weights.astype(np.float32), moves)


def predict_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1) to every row of ``docs``; whole texts are read.

    A text that is null or has no letters gets "und" and 0. Older columns of these names are replaced.
    """
    importable(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    names, kinds = docs.columns, dict(docs.dtypes)
    place = names.index(text)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in in_parts(batch, place):
                languages, score = model.predict(part.column(place).to_pylist())
                columns = [*part.columns, pa.array(languages, pa.string()), pa.array(score, pa.float64())]
                yield pa.record_batch(columns, [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", lang_pred string, score double"
    return docs.mapInArrow(run, schema)
