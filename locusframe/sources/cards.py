"""Small tables of settings: cards of ``key: value`` lines, versions, numbered folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a card must say.
REQUIRED = ("weights_url", "softmasking", "clamsa")


def read_cards(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, card): each file's top-level ``key: value`` lines as a map; quotes, comments and empty values are dropped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\s+#.*$", "").alias("line"))
    pair = lines.where(F.col("line").rlike(r"^[A-Za-z_][\w-]*\s*:")).select(
        "file", F.trim(F.substring_index("line", ":", 1)).alias("key"), F.regexp_replace(F.expr("trim(substring(line, instr(line, ':') + 1))"), "^[\"']|[\"']$", "").alias("value")
    )
    known = pair.where(~F.col("value").isin("", "null", "~")).groupBy("file", "key").agg(F.max("value").alias("value"))
    cards = known.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("card"))
    return lines.select("file").distinct().join(cards, "file", "left").withColumn("card", F.coalesce("card", F.create_map().cast("map<string,string>")))


def missing_keys(card: Column, required: Sequence[str] = REQUIRED) -> Column:
    """The required keys that a card lacks."""
    return F.array_except(F.array(*map(F.lit, required)), F.map_keys(card))


def distinct_urls(cards: DataFrame, key: str = "weights_url") -> DataFrame:
    """(url): each address once, doubled slashes in its path made single."""
    url = F.regexp_replace(F.try_element_at("card", F.lit(key)), "(?<!:)//+", "/")
    return cards.select(url.alias("url")).where("url is not null").distinct()


def version_of(tag: Column) -> Column:
    """(major, minor, patch) of a tag such as v1.2.3; null for other tags."""
    pattern = r"^v?(\d+)\.(\d+)\.(\d+)$"
    part = lambda i: F.regexp_extract(tag, pattern, i).try_cast("int")
    return F.when(tag.rlike(pattern), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def numbered(names: DataFrame, column: str, prefix: str = "epoch_") -> DataFrame:
    """Names that are the prefix and a number, with that number as n, to be ordered by."""
    n = F.regexp_extract(column, f"^{prefix}(\\d+)$", 1).try_cast("long")
    return names.withColumn("n", n).where("n is not null")
