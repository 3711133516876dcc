"""URL filtering: host and path rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm._common import hinted, sampled, written
from locusframe.llm.linededup import host_of

BROADCAST_ROWS = 200_000
#: Block rates of labelled rows are those of the other folds.
FOLDS = 5
FEATURES = [
    "url_length", "host_length", "path_length", "host_labels", "path_depth", "digit_ratio", "hyphens", "entropy", "parameters",
    "query_length", "is_https", "has_fragment", "has_file", "domain_rate", "suffix_rate",
]


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(F.instr(url, "://") > 0, F.lit(False)), path).otherwise("")


def fitting_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each distinct host, the rules (host, path, verdict) of it and the domains above it."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = hosts.select("host").distinct().select("host", F.explode(above).alias("rule_host"))
    known = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    found = each.join(hinted(known, BROADCAST_ROWS), "rule_host")
    entry = F.struct(
        F.length(F.concat("rule_host", "rule_path")).alias("n"), F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_path").alias("path"), F.col("rule_verdict").alias("verdict"),
    )
    return written(found.groupBy("host").agg(F.collect_list(entry).alias("rules")))


def lexical(df: DataFrame) -> DataFrame:
    """Adds the lexical features of column ``url`` (and ``host``, ``path``); nothing is null."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    chars = F.array_distinct(F.split(url, ""))
    shares = F.transform(chars, lambda c: F.when(c == "", 0.0).otherwise((F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n))
    entropy = F.aggregate(shares, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    values = {
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"), "host_labels": F.size(labels),
        "path_depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / n, "hyphens": F.length(url) - F.length(F.replace(url, F.lit("-"), F.lit(""))),
        "entropy": entropy, "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")), "query_length": F.length(query),
        "is_https": url.startswith("https").cast("int"), "has_fragment": url.contains("#").cast("int"), "has_file": F.col("path").rlike(r"\.\w+$").cast("int"),
    }
    domain = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".")
    return df.withColumns({k: v.cast("double") for k, v in values.items()} | {"domain": domain, "suffix": F.element_at(labels, -1)})


def _with_rates(df: DataFrame, sample: DataFrame, prior: float, own: bool, weight: float = 10.0) -> DataFrame:
    """Adds the smoothed block rates of each row's domain and suffix in the (bounded) sample.

    If ``df`` is the sample ``own`` itself, a row's rate is that of the other folds, so no row sees its own label. Keys that
    have one verdict only in the sample get the share of all rows: such a rate would say the label outright, and the
    trees would learn nothing of the urls' form.
    """
    for column, name in (("domain", "domain_rate"), ("suffix", "suffix_rate")):
        sums = sample.groupBy(column).agg(F.sum("y").alias("_y"), F.count("*").alias("_n")).where("_y > 0 and _y < _n")
        keys = [column]
        if own:
            keys = [column, "fold"]
            folds = sample.groupBy(*keys).agg(F.sum("y").alias("_yf"), F.count("*").alias("_nf")).join(sums, column)
            sums = folds.withColumns({"_y": F.col("_y") - F.col("_yf"), "_n": F.col("_n") - F.col("_nf")})
        rates = written(sums.select(*keys, ((F.col("_y") + prior * weight) / (F.col("_n") + weight)).alias(name)))
        df = df.join(hinted(rates, BROADCAST_ROWS), keys, "left")
    return df.fillna(prior, ["domain_rate", "suffix_rate"])


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, labelled: DataFrame | None = None, page_id: str = "page_id", url: str = "url",
    max_labelled: int = 20_000, trees: int = 20, depth: int = 4, threshold: float = 0.5,
) -> DataFrame:
    """Returns (page_id, host, path, rule, verdict, score) for every row of ``pages``.

    ``rules`` are (host, path, "allow" or "block"); one fits its host and all subdomains if the path starts with
    its path; the longest of them decides (of equal ones, the greatest by spelling). Other rows get the trees'
    verdict: "block" from a score of ``threshold`` on. ``labelled`` has (url, verdict) to learn from; without it,
    the urls that rules decide are the labelled ones. ``max_labelled`` different ones at most are drawn by a hash.
    Features are those of ``lexical`` and the sample's smoothed block rates by domain (two last labels) and suffix
    (for training, out of fold). With no
    labelled rows, or one verdict only, the score is that verdict's share (0 without any). Null urls have an
    empty host and path, and are judged like any other.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    parsed = lambda df: df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = parsed(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")))
    by_host = fitting_rules(rows, rules)
    fits = F.filter(F.coalesce("rules", F.array().cast(dict(by_host.dtypes)["rules"])), lambda r: F.col("path").startswith(r["path"]))
    ruled = rows.join(by_host, "host", "left").withColumn("hit", F.array_max(fits)).drop("rules")
    known = ruled.where("hit is not null").select("url", F.col("hit.verdict").alias("verdict")) if labelled is None else labelled
    known = known.where(F.col("url").isNotNull() & F.col("verdict").isin("allow", "block"))
    known = known.select("url", "verdict")
    sample = sampled(known, max_labelled, known.count(), "urls", "url", "verdict").withColumn("y", (F.col("verdict") == "block").cast("double"))
    fold = F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS))
    sample = written(lexical(parsed(sample)).withColumn("fold", fold))
    n, blocked = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    prior = blocked / n if n else 0.0
    if 0 < prior < 1:
        stages = [VectorAssembler(inputCols=FEATURES, outputCol="features"), GBTClassifier(labelCol="y", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7)]
        model = Pipeline(stages=stages).fit(_with_rates(sample, sample, prior, own=True))
        scored = model.transform(_with_rates(lexical(ruled), sample, prior, own=False)).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = ruled.withColumn("score", F.lit(float(prior)))
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", learned).alias("verdict"), "score")
