"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm._common import hinted, small_enough, written

BROADCAST_CELLS = 200_000
#: Ids are hashed to a number below this one for the sampling.
DRAWS = 1 << 32


def topic_of(text: Column) -> Column:
    """A coarse form of a text, standing in for a topic where a table has none."""
    return (
        F.when(F.coalesce(F.trim(text) == "", F.lit(True)), "empty")
        .when(text.contains("License") | text.contains("Copyright"), "licensed")
        .when(text.contains(" | "), "tabular")
        .when(F.length(text) < 500, "short")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """Words at single blanks and line ends, one at least: a cheap weight of a text."""
    spaces = F.length(text) - F.length(F.translate(text, " \n", ""))
    return F.coalesce(spaces, F.lit(0)).cast("long") + 1


def draw_key(doc_id: Column, text: Column) -> Column:
    """What decides a document's draw: its id, or without one a digest of its text, so that such rows are drawn apart."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(text)), F.lit(""))


def draw_of(key: Column) -> Column:
    """A number from 0 up to 1 from the md5 of the key: the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / DRAWS


def tempered(totals: Mapping[str, float], power: float) -> dict[str, float]:
    """Shares in proportion to ``totals`` to this power: below 1, small groups get more than their part."""
    raised = {k: v**power for k, v in totals.items() if v > 0}
    whole = sum(raised.values())
    return {k: v / whole for k, v in raised.items()}


def rake(cells: np.ndarray, weights: np.ndarray, targets: Sequence[np.ndarray], rounds: int) -> np.ndarray:
    """Scales ``weights`` so that their sums by each column of ``cells`` (category numbers) reach the targets."""
    out = weights.astype(float).copy()
    for _ in range(rounds):
        for dim, target in enumerate(targets):
            sums = np.bincount(cells[:, dim], out, len(target))
            out *= np.divide(target, sums, out=np.zeros(len(target)), where=sums > 0)[cells[:, dim]]
    return out


def most_wanted(rate: np.ndarray, tokens: np.ndarray, whole_share: float) -> float:
    """The rate that gets probability 1: cells of higher ones have no more than ``whole_share`` of the tokens."""
    order = np.argsort(rate, kind="stable")
    enough = np.cumsum(tokens[order]) >= (1 - whole_share) * tokens.sum()
    return float(rate[order][enough][0])


def raked_factors(cells: DataFrame, keys: Sequence[str], aims: Mapping[str, DataFrame], rounds: int) -> DataFrame:
    """``cells`` with column weight, raked as ``rake`` does, but by Spark: for cell tables of any size.

    Raking only ever multiplies a category's cells by one number, so a table of factors for each dimension is all that
    changes from step to step: a cell's weight is its tokens times the factors of its categories.
    """
    factors = {k: written(aims[k].select(k, F.lit(1.0).alias(f"{k}_f"))) for k in keys}

    def weighted() -> DataFrame:
        out, weight = cells, F.col("__mix_sum").cast("double")
        for k in keys:
            out = out.join(hinted(factors[k], BROADCAST_CELLS), k)
            weight = weight * F.col(f"{k}_f")
        return out.withColumn("weight", weight)

    for _ in range(rounds):
        for k in keys:
            sums = weighted().groupBy(k).agg(F.sum("weight").alias("_s"))
            new = F.when(F.col("_s") > 0, F.col(f"{k}_f") * F.col(f"{k}_aim") / F.col("_s")).otherwise(0.0)
            factors[k] = written(sums.join(aims[k], k).join(factors[k], k).select(k, new.alias(f"{k}_f")))
    return weighted().drop(*(f"{k}_f" for k in keys))


def most_wanted_of(rated: DataFrame, whole_share: float) -> float:
    """``most_wanted`` by Spark: a search between the rates, one small aggregate for each halving."""
    tokens, low, high = rated.agg(F.sum("__mix_sum"), F.min("rate"), F.max("rate")).first()
    need = (1 - whole_share) * tokens
    # The answer is the least rate, from low to high, below or at which are enough tokens.
    while low < high:
        middle = low + (high - low) / 2
        upto = F.col("rate") <= middle
        held, below, above = rated.agg(
            F.sum(F.when(upto, F.col("__mix_sum"))), F.max(F.when(upto, F.col("rate"))), F.min(F.when(~upto, F.col("rate")))
        ).first()
        low, high = (low, below) if held is not None and held >= need else (above, high)
    return float(low)


def mix_to_targets(
    docs: DataFrame,
    dims: Mapping[str, Column],
    tokens: Column,
    draw: Column | None = None,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    power: float = 0.9,
    rounds: int = 25,
    whole_share: float = 0.01,
    driver_cells: int = 1_000_000,
) -> DataFrame:
    """Adds the ``dims`` (as strings, null as ""), tokens, weight (raked share of all tokens), probability and sampled.

    ``targets`` gives each dimension's shares, by category; a missing dimension is tempered: its own token
    shares to ``power``. Tokens are summed by cell (a combination of categories) over all documents; raking
    scales the cells to all marginals in turn, ``rounds`` times. A document's probability is in proportion to its
    cell's raked weight by token. The most wanted cells, up to ``whole_share`` of all tokens, have probability 1:
    they are taken whole, and all others in proportion, so expected tokens of the sample have the raked shares
    but for what those few cells lack, and a rare category does not thin out everything else. No document is
    taken twice. The draw is a hash of ``draw`` (doc_id unless given; see ``draw_key`` for rows without one). A
    category without a target, or with one of 0, is not sampled. Repeated rows are drawn alike.

    A cell table of up to ``driver_cells`` rows is raked on the driver, a larger one by Spark, with the same result
    but for rounding. Existing columns of the added names are replaced. No rows: no rows.
    """
    names = list(dims)
    added = [*names, "tokens", "weight", "probability", "sampled"]
    keys = {f"__mix_{n}": F.coalesce(c.cast("string"), F.lit("")) for n, c in dims.items()}
    drawn_by = (F.col("doc_id") if draw is None else draw).cast("string")
    keyed = docs.withColumns(keys | {"__mix_tokens": tokens.cast("long"), "__mix_draw": drawn_by})
    cells = written(keyed.groupBy(*keys).agg(F.sum("__mix_tokens").alias("__mix_sum")))
    if small_enough(cells, driver_cells):
        table = _on_driver(cells, keys, names, targets or {}, power, rounds, whole_share)
    else:
        aims = {k: _aims(cells, k, (targets or {}).get(n), power) for k, n in zip(keys, names, strict=True)}
        fitted = raked_factors(cells, list(keys), aims, rounds)
        rate = F.when(F.col("__mix_sum") > 0, F.col("weight") / F.col("__mix_sum")).otherwise(0.0)
        rated = written(fitted.withColumn("rate", rate))
        top = most_wanted_of(rated, whole_share)
        share = F.least(F.lit(1.0), F.col("rate") / top) if top else F.lit(0.0)
        table = rated.select(*keys, "weight", share.alias("probability"))
    mixed = keyed.drop("weight", "probability", "sampled").join(hinted(table, BROADCAST_CELLS), list(keys))
    first = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    return mixed.select(
        *first, *(F.col(f"__mix_{n}").alias(n) for n in names), F.col("__mix_tokens").alias("tokens"), "weight", "probability",
        (draw_of(F.col("__mix_draw")) < F.col("probability")).alias("sampled"),
    )


def _aims(cells: DataFrame, key: str, target: Mapping[str, float] | None, power: float) -> DataFrame:
    """(key, key_aim): the share each category of one dimension is to have."""
    own = written(cells.groupBy(key).agg(F.sum("__mix_sum").cast("double").alias("_s")))
    if target is not None:
        given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in target.items()], f"{key} string, _t double")
        return written(own.join(hinted(given, BROADCAST_CELLS), key, "left").select(key, F.coalesce("_t", F.lit(0.0)).alias(f"{key}_aim")))
    raised = F.when(F.col("_s") > 0, F.pow("_s", F.lit(power))).otherwise(0.0)
    whole = own.agg(F.sum(raised)).first()[0]
    return written(own.select(key, (raised / whole).alias(f"{key}_aim")))


def _on_driver(
    cells: DataFrame, keys: Mapping[str, Column], names: Sequence[str], targets: Mapping[str, Mapping[str, float]], power: float, rounds: int, whole_share: float
) -> DataFrame:
    """(keys, weight, probability) of a cell table that fits the driver."""
    rows = cells.orderBy(*keys).toPandas()
    codes, aims = [], []
    for n in names:
        own = rows.groupby(f"__mix_{n}")["__mix_sum"].sum()
        aim = dict(targets.get(n) or tempered(own.to_dict(), power))
        codes.append(own.index.get_indexer(rows[f"__mix_{n}"]))
        aims.append(np.array([float(aim.get(k, 0.0)) for k in own.index]))
    tokens = rows["__mix_sum"].to_numpy(float)
    fitted = rake(np.stack(codes, axis=1), tokens, aims, rounds) if len(rows) else np.empty(0)
    rate = np.divide(fitted, tokens, out=np.zeros(len(rows)), where=tokens > 0)
    rows["weight"] = fitted
    rows["probability"] = np.minimum(1.0, rate / most_wanted(rate, tokens, whole_share)) if rate.any() else rate
    schema = ", ".join(f"{k} string" for k in keys) + ", weight double, probability double"
    return cells.sparkSession.createDataFrame(rows[[*keys, "weight", "probability"]].values.tolist(), schema)
