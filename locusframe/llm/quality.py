"""Document quality from a conditional random field over lines."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm import crf
from locusframe.llm._common import in_parts, sampled, written
from locusframe.session import importable

CAPITALS = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SYMBOLS = b"*#$%&@^~=<>{}[]\\/_+`"
OWN = 17
LINE_END = re.compile(r"\n")
#: Lines of a text whose features are held at a time.
LINES_AT_ONCE = 8_192


def _lines(text: str | None) -> list[str]:
    """The non-blank lines, or one empty line if there is none."""
    return [x for x in LINE_END.split(text or "") if x.strip()] or [""]


def own_features(lines: list[str], times: Counter[str]) -> np.ndarray:
    """One row of features for each of these lines of a text, whose lines occur so many ``times``."""
    rows = []
    for line in lines:
        raw, words = line.encode("utf-8", "surrogatepass"), line.split()
        n, k = max(1, len(raw)), max(1, len(words))
        share = lambda part: (len(raw) - len(raw.translate(None, part))) / n  # noqa: B023, E731
        rows.append((
            math.log1p(len(line)), math.log1p(len(words)), min(len(line) / k, 40) / 10,
            share(SYMBOLS) * 10, raw.count(b"|") / k * 2, share(CAPITALS) * 4, share(DIGITS) * 10, raw.count(b"!") / k * 2,
            (raw.count(b".") + raw.count(b",")) / k * 4, len(set(words)) / k, sum(map(eq, words, words[1:])) / k * 3,
            float(times[line] > 1), min(times[line] - 1, 8) / 4, float(line[:1].isupper()), float(raw[-1:] in b".!?" and raw != b""),
            float(len(words) < 4), 1.0,
        ))
    return np.array(rows)


def line_features(text: str | None, first: int = 0, most: int | None = None) -> np.ndarray:
    """Own and neighbours' features of the lines ``first`` to ``first + most`` (of all), one row for each."""
    lines = _lines(text)
    stop = len(lines) if most is None else min(len(lines), first + most)
    low, high = max(0, first - 1), min(len(lines), stop + 1)
    own = own_features(lines[low:high], Counter(lines))
    around = np.zeros((len(own), 2 * (OWN - 1) + 2))
    around[1:, : OWN - 1] = own[:-1, :-1]
    around[:-1, OWN - 1 : -2] = own[1:, :-1]
    around[0, -2] = float(low == 0)
    around[-1, -1] = float(high == len(lines))
    return np.hstack([own, around])[first - low : stop - low]


@dataclass
class QualityModel:
    weights: np.ndarray
    moves: np.ndarray

    def line_scores(self, lines: list[str]) -> np.ndarray:
        """Label scores of all lines of a text; features of LINES_AT_ONCE lines are held at a time."""
        times = Counter(lines)
        edge = self.weights[3 * OWN - 2 :]
        own, before = self.weights[:OWN], np.vstack([self.weights[OWN : 2 * OWN - 1], np.zeros((1, 2))])
        after = np.vstack([self.weights[2 * OWN - 1 : 3 * OWN - 2], np.zeros((1, 2))])
        each = [own_features(lines[i : i + LINES_AT_ONCE], times) @ np.hstack([own, before, after]) for i in range(0, len(lines), LINES_AT_ONCE)]
        parts = np.vstack(each)
        out = parts[:, :2].copy()
        out[1:] += parts[:-1, 2:4]
        out[:-1] += parts[1:, 4:]
        out[0] += edge[0]
        out[-1] += edge[1]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """For each text the share of its characters on good lines, by the lines' marginals."""
        if not texts:
            return np.empty(0)
        each = [_lines(t) for t in texts]
        lengths = np.array([len(x) for x in each])
        good = crf.marginals(np.vstack([self.line_scores(x) for x in each]), lengths, self.moves)[:, 1]
        size = np.fromiter((max(1, len(x)) for lines in each for x in lines), float, int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        return np.clip(np.add.reduceat(good * size, starts) / np.add.reduceat(size, starts), 0.0, 1.0)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    max_docs: int = 3_000, max_lines: int = 40, rounds: int = 150,
) -> QualityModel:
    """Trains on ``max_docs`` labelled documents at most, each with ``max_lines`` consecutive lines at most.

    The sample is drawn by a hash of the id over all labelled documents that aren't held out: a chance of any size, so
    it doesn't run empty where labels are many. Each line gets its document's label. ``max_lines`` keeps single long
    texts from filling a sample that the driver holds; neighbours and repeats are looked up in the whole text. Rows without an id, a text or a label of 0 or 1, and ids with two different labels, are not
    used. Without any labelled row every document scores 0.5.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("_y"), F.max(label).alias("_z")).where("_y = _z")
    known = written(sampled(known.select("_id", "_y"), max_docs, known.count(), "quality", "_id"))
    # Rows of one id and text count once, so repeated rows can't fill the sample; an id with several texts gives its least.
    sample = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where("_text is not null")
    sample = sample.join(F.broadcast(known), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))

    importable(docs.sparkSession)

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i, x, y in zip(part["_id"], part["_text"], part["_y"], strict=True):
                n = len(_lines(x))
                first = zlib.crc32(str(i).encode()) % max(1, n - max_lines + 1)
                rows.append((str(i), int(y), line_features(x, first, max_lines).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["id", "y", "x"])

    got = sample.select("_id", "_text", "_y").mapInPandas(features, "id string, y int, x array<double>").toPandas().sort_values("id")
    width = 3 * OWN
    if not len(got):
        return QualityModel(np.zeros((width, 2)), np.zeros((2, 2)))
    values = np.vstack([np.reshape(x, (-1, width)) for x in got["x"]])
    lengths = np.array([len(x) // width for x in got["x"]])
    marks = np.repeat(got["y"].to_numpy(np.int64), lengths)
    scale = np.maximum(values.std(axis=0), 0.05)
    weights, moves = crf.fit(crf.Dense(values / scale), np.arange(len(values)), marks, lengths, 2, rounds, 0.05, 1e-4)
    return QualityModel(weights / scale[:, None], moves)


def score_quality(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Adds score (0 to 1, higher: better) and predicted (1 from ``threshold`` on) to every row of ``docs``.

    Whole texts are scored; a null or blank text counts as one empty line. Other columns stay as they are, except older ones of these names.
    """
    importable(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    names = docs.columns
    kinds = dict(docs.dtypes)
    score, predicted = "score", "predicted"
    place = names.index(text)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in in_parts(batch, place, 2 << 20):
                scores = model.scores(part.column(place).to_pylist())
                columns = [*part.columns, pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())]
                yield pa.record_batch(columns, [*names, score, predicted])

    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + f", {score} double, {predicted} int"
    return docs.mapInArrow(run, schema)
