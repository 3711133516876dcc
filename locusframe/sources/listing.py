"""Which files a list of patterns names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def opened_braces(pattern: str) -> list[str]:
    """A pattern's alternatives, the outer braces first; a brace that is never closed is an ordinary character."""
    begin = pattern.find("{")
    depth, cuts = 0, [begin]
    for i in range(begin, len(pattern)) if begin >= 0 else ():
        c = pattern[i]
        depth += (c == "{") - (c == "}")
        if (c == "," and depth == 1) or depth == 0:
            cuts.append(i)
        if depth == 0:
            break
    if begin < 0 or depth:
        return [pattern]
    parts = [pattern[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return [x for part in parts for x in opened_braces(pattern[:begin] + part + pattern[cuts[-1] + 1 :])]


def listed(spark: SparkSession, patterns: Sequence[str], recursive: bool = False) -> DataFrame:
    """(pattern, file, length, modified): the files that each pattern matches, and a row without a file for one that matches none.

    Braces are opened, then Spark lists each alternative; no content is read. Blank patterns are dropped, a pattern given twice counts
    once, and a file that two alternatives of a pattern match is listed once. With ``recursive``, folders are searched, too.
    """
    schema = "pattern string, file string, length long, modified timestamp"
    found = [spark.createDataFrame([], schema)]
    for pattern in dict.fromkeys(p.strip() for p in patterns if p.strip()):
        for one in opened_braces(pattern):
            try:
                files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(one)
            except AnalysisException as missing:
                if missing.getCondition() != "PATH_NOT_FOUND":
                    raise
                continue
            found.append(files.select(F.lit(pattern).alias("pattern"), F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified")))
    files = reduce(DataFrame.unionByName, found).distinct()
    asked = spark.createDataFrame([(p,) for p in dict.fromkeys(p.strip() for p in patterns if p.strip())], "pattern string")
    return asked.join(files, "pattern", "left")


def unmatched(listing: DataFrame) -> DataFrame:
    """The patterns of a ``listed`` table that match nothing."""
    return listing.where("file is null").select("pattern")
