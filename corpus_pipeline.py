"""The corpus pipeline: quality, near-duplicates, benchmark text, mixture and shards, in this order.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a DataFrame.
``run`` writes each stage's rows as Parquet into the shared folder and reads them again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import mixing, nearcopies, quality
from locusframe.llm._common import written
from locusframe.llm.decontamination import find_contaminated
from locusframe.llm.sharding import shard_by_splitters

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model predicts to be good."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def tagged(docs: DataFrame) -> DataFrame:
    """The rows with a row id, read back from Parquet so that it stays the same."""
    return written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("rid")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of least id, of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    Candidates come from the SimHash operator's anchors and from MinHash bands; each link is verified exactly.

    Rows are told apart by a row id, so null or repeated doc_ids merge nothing. The rows that stay are about as
    many as the documents, so they are joined by a shuffle at any size.
    """
    rows = tagged(docs)
    first = written(nearcopies.kept_rows(rows))
    return rows.join(first.hint("merge"), "rid", "left_semi").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the benchmark doesn't contaminate, each judged by its own text, whatever its doc_id."""
    rows = tagged(docs)
    found = find_contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="rid")
    bad = written(found.where("contaminated").select("rid"))
    return rows.join(bad, "rid", "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents by probabilities raked to tempered source, language and topic shares."""
    text = F.col("text")
    dims = {"mix_source": F.col("source"), "mix_lang": F.col("lang"), "mix_topic": mixing.topic_of(text)}
    return mixing.mix_to_targets(docs, dims, mixing.tokens_of(text), mixing.draw_key(F.col("doc_id"), text)).where("sampled").select(*COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard of 40 and their slot in it."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    keyed = docs.select(*COLUMNS, size.alias("size"), F.xxhash64("text").alias("text_key"), F.xxhash64(*COLUMNS).alias("tie"))
    return shard_by_splitters(keyed, "text_key", "size", ["doc_id", "tie"]).select(*COLUMNS, "size", "law", "shard", "slot")


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

#: SQL can express neither the line model nor the fingerprints; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
