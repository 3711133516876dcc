"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm._common import written

#: What no reader sees; without an end tag it goes on to the end of the page, as in browsers.
HIDDEN = r"(?is)<(script|style)\b(?:.*?</\1>|.*)|<!--(?:.*?-->|.*)"
#: What ends a line of a page: line ends, and the tags that browsers break at. Other tags are removed.
BREAKS = r"(?i)</?(?:p|div|li|ul|ol|br|h[1-6]|nav|article|section|footer|header|title|head|body|table|tr|td|th)\b[^>]*>|[\r\n]+"
TAGS = r"<[^>]*>"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    host = F.regexp_extract(F.regexp_replace(url, r"(?s)^.*?://", ""), r"^[^/?#]*", 0)
    return F.when(F.coalesce(F.instr(url, "://") > 0, F.lit(False)), F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def page_lines(html: Column) -> Column:
    """The visible lines of a page, without blanks and tabs around them and without empty ones; none for null."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, "\n"), BREAKS, "\n"), TAGS, "")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t"))), lambda x: x != "")
    return F.coalesce(lines, F.array().cast("array<string>"))


def drop_site_lines(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", max_ratio: float = 0.3, min_pages: int = 5
) -> DataFrame:
    """Returns (page_id, host, n_lines, n_dropped, text): each page without its site's boilerplate lines.

    A line is boilerplate if at least ``min_pages`` pages of its host hold it and these are more than
    ``max_ratio`` of the host's pages. All its occurrences are dropped; the kept lines are joined by line ends.

    Lines are counted by a 128-bit hash, with a partial aggregation before the shuffle, so a host or a line with
    very many pages is no hot key. A host has at most (mean lines a page / ``max_ratio``) boilerplate lines, so
    they travel as one array for each host; that table is joined to the pages, whose large hosts Spark's skew
    join may split. Null or lineless pages give an empty text, null urls belong to the host "". Repeated rows
    count as pages of their own; other columns are ignored.
    """
    marks = F.transform(page_lines(F.col(html)), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    slim = pages.select(host_of(F.col(url)).alias("host"), F.array_distinct(marks).alias("marks"))
    totals = slim.groupBy("host").agg(F.count("*").alias("total")).where(F.col("total") >= min_pages)
    counts = slim.select("host", F.explode("marks").alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("n"))
    counts = written(counts.where(F.col("n") >= min_pages))
    common = counts.join(written(totals), "host").where(F.col("n") > F.lit(max_ratio) * F.col("total"))
    common = written(common.groupBy("host").agg(F.collect_list("mark").alias("dropped")))
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), page_lines(F.col(html)).alias("lines"))
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    kept = F.filter(
        "lines",
        lambda x: ~F.array_contains(F.coalesce("dropped", none), F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))),
    )
    done = rows.join(common, "host", "left").select("page_id", "host", F.size("lines").alias("n_lines"), kept.alias("kept"))
    return done.select(
        "page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text")
    )
