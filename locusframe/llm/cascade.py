"""Quality rules as a short-circuit cascade: rules are ordered by what they reject for their cost, and a rule sees only
the documents that those before it left."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm._common import in_parts, sampled, written
from locusframe.session import importable

SYMBOLS = b"#*$%&|<>"
#: Bytes of a text whose words are split at once.
BLOCK = 1 << 20


def _blocks(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about ``BLOCK`` bytes, cut at blanks."""
    at = 0
    while at < len(raw):
        end = at + BLOCK
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield raw[at:end]
        at = end


def word_count(raw: bytes) -> int:
    return sum(len(block.split()) for block in _blocks(raw))


def word_chars(raw: bytes) -> int:
    """Code points that are no blanks: bytes that don't continue a character."""
    solid = np.frombuffer(raw.translate(None, b" \t\n\x0b\x0c\r"), np.uint8)
    return int(np.count_nonzero((solid & 0xC0) != 0x80))


def symbol_count(raw: bytes) -> int:
    return len(raw) - len(raw.translate(None, SYMBOLS))


def _lines(raw: bytes) -> list[bytes]:
    return [line for line in raw.split(b"\n") if line.strip()]


def line_count(raw: bytes) -> int:
    return len(_lines(raw))


def repeated_lines(raw: bytes) -> int:
    lines = _lines(raw)
    return len(lines) - len(set(lines))


def bullet_lines(raw: bytes) -> int:
    return sum(line.lstrip().startswith((b"-", b"*", "•".encode())) for line in _lines(raw))


def cut_lines(raw: bytes) -> int:
    """Lines that end in an ellipsis."""
    return sum(line.rstrip().endswith((b"...", "…".encode())) for line in _lines(raw))


def lettered_words(raw: bytes) -> int:
    """Words with a letter; characters beyond ASCII count as such."""
    return sum(1 for block in _blocks(raw) for word in block.split() if not word.isascii() or word.translate(None, _NO_LETTERS))


_NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())


def repeated_words(raw: bytes) -> int:
    """Words inside windows of three words that occur twice or more in the text."""
    seen: dict[bytes, int] = {}
    ids = [np.fromiter((seen.setdefault(w, len(seen)) for w in block.split()), np.int64) for block in _blocks(raw)]
    w = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    if len(w) < 4:
        return 0
    _, pairs = np.unique(w[:-1] * len(seen) + w[1:], return_inverse=True)
    _, windows, counts = np.unique(pairs[:-1] * len(seen) + w[2:], return_inverse=True, return_counts=True)
    often = counts[windows] > 1
    hit = np.zeros(len(w), bool)
    for i in range(3):
        hit[i : len(w) - 2 + i] |= often
    return int(hit.sum())


#: What rules are made of, by name: each a number of a text's UTF-8 bytes.
FEATURES: dict[str, Callable[[bytes], int]] = {
    "n_words": word_count, "word_chars": word_chars, "n_symbols": symbol_count, "n_lines": line_count, "n_dup_lines": repeated_lines,
    "n_bullet_lines": bullet_lines, "n_cut_lines": cut_lines, "n_lettered": lettered_words, "n_repeat_words": repeated_words,
}


@dataclass(frozen=True)
class Rule:
    """Rejects texts for which ``rejects`` (of arrays of the features ``needs``, in this order) is true."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., np.ndarray]


#: The two rules that the contract states, and what other quality filters of web text have, with bounds that leave prose alone.
BASE = (
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 50 * n),
)
RULES = (
    *BASE,
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (c < 2 * n) | (c > 14 * n)),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 10 * s > n),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda n, d: 2 * d > n),
    Rule("bullets", ("n_lines", "n_bullet_lines"), lambda n, b: 10 * b > 9 * n),
    Rule("cut_lines", ("n_lines", "n_cut_lines"), lambda n, c: 10 * c > 3 * n),
    Rule("few_letters", ("n_words", "n_lettered"), lambda n, a: 10 * a < 7 * n),
)


@dataclass(frozen=True)
class Profile:
    """What a sample says: seconds a text of each feature, and which rules reject each text (texts x rules)."""

    cost: dict[str, float]
    rejected: np.ndarray


def _raw(batch: pa.RecordBatch, text: str) -> list[bytes]:
    return [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]


class _Cascade:
    """Features of the texts of a part, each worked out once and only where it is asked for."""

    def __init__(self, raw: list[bytes]) -> None:
        self.raw = raw
        self.values: dict[str, np.ndarray] = {}
        self.known: dict[str, np.ndarray] = {}

    def feature(self, name: str, at: np.ndarray) -> np.ndarray:
        if name not in self.values:
            self.values[name], self.known[name] = np.zeros(len(self.raw), np.int64), np.zeros(len(self.raw), bool)
        fn, values = FEATURES[name], self.values[name]
        for i in at[~self.known[name][at]]:
            values[i] = fn(self.raw[i])
        self.known[name][at] = True
        return values[at]

    def rejected(self, rule: Rule, at: np.ndarray) -> np.ndarray:
        return rule.rejects(*(self.feature(n, at) for n in rule.needs))


def profiled(docs: DataFrame, rules: Sequence[Rule] = RULES, wanted: int = 2_000, text: str = "text") -> Profile:
    """Costs and rejections of ``rules`` on ``wanted`` distinct texts at most (those of least hashes), measured in tasks."""
    importable(docs.sparkSession)
    texts = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    sample = written(sampled(texts, wanted, max(1, texts.count()), "cascade", "text"))
    features = sorted({n for r in rules for n in r.needs})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_parts(whole, 0):
                part, spent = _Cascade(_raw(batch, "text")), []
                at = np.arange(batch.num_rows)
                for name in features:
                    began = time.process_time()
                    part.feature(name, at)
                    spent.append((time.process_time() - began) / max(1, batch.num_rows))
                bits = np.stack([part.rejected(r, at) for r in rules], axis=1)
                yield pa.record_batch([pa.array(bits.tolist(), pa.list_(pa.bool_())), pa.array([spent] * batch.num_rows, pa.list_(pa.float64()))], ["rejected", "spent"])

    seen = sample.mapInArrow(measure, "rejected array<boolean>, spent array<double>").collect()
    spent = np.mean([r["spent"] for r in seen], axis=0) if seen else np.ones(len(features))
    return Profile(dict(zip(features, spent.tolist(), strict=True)), np.array([r["rejected"] for r in seen], bool).reshape(len(seen), len(rules)))


def ordered(rules: Sequence[Rule], profile: Profile, known: Sequence[str] = ()) -> list[Rule]:
    """The rules by what they reject, of what those before them leave, for the cost of the features that aren't there yet.

    ``known`` features are worked out anyway. Of rules as good, the one named first goes first; rules that reject nothing go last, the
    cheaper first.
    """
    left, alive, have, out = list(range(len(rules))), np.ones(len(profile.rejected), bool), set(known), []
    while left:
        price = {i: sum(profile.cost.get(n, 0.0) for n in set(rules[i].needs) - have) + 1e-9 for i in left}
        gain = {i: int(profile.rejected[alive, i].sum()) for i in left}
        best = max(left, key=lambda i: (gain[i] / price[i], -price[i], -i))
        left.remove(best)
        out.append(rules[best])
        alive &= ~profile.rejected[:, best]
        have |= set(rules[best].needs)
    return out


def apply_rules(docs: DataFrame, rules: Sequence[Rule], report: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Adds kept (no rule rejects the text) and rejected_by (the first rule, in this order, that does, else null), and the features
    ``report``, which are worked out for every text; columns of these names are replaced.

    Other features are worked out only for texts that get as far as a rule that needs them. kept doesn't depend on the order of
    rules; rejected_by does. A null text counts as empty, without words; texts are taken whole, the words of a long one in blocks.
    Equal texts get equal verdicts, and repeated rows stay. An empty table gives no rows.
    """
    importable(docs.sparkSession)
    names = ["rejected_by", "kept", *report]
    rows = docs.drop(*(n for n in names if n in docs.columns and n != text))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    at_text = rows.columns.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_parts(whole, at_text):
                part, alive = _Cascade(_raw(batch, text)), np.arange(batch.num_rows)
                first = np.full(batch.num_rows, -1)
                for name in report:
                    part.feature(name, alive)
                for i, rule in enumerate(rules):
                    bad = part.rejected(rule, alive)
                    first[alive[bad]] = i
                    alive = alive[~bad]
                by = pa.array([rules[i].name if i >= 0 else None for i in first], pa.string())
                out = [by, pa.array(first < 0), *(pa.array(part.values[n]) for n in report)]
                yield pa.record_batch([*batch.columns, *out], [*batch.schema.names, *names])

    return rows.mapInArrow(judge, f"{kinds}, rejected_by string, kept boolean" + "".join(f", {n} long" for n in report))


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, report: Sequence[str] = (), wanted: int = 2_000, text: str = "text") -> DataFrame:
    """``apply_rules`` in the order that a sample of ``wanted`` texts gives."""
    return apply_rules(docs, ordered(rules, profiled(docs, rules, wanted, text), report), report, text)
