"""Agreement of two annotations as sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.session import stored

#: Rows that a task compares.
ROWS = 1_000_000


def set_scores(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall and f1 over distinct rows; 0 where undefined. Columns must agree."""
    # Which sides a row is on, as bits: one aggregate, dealt out by the number of rows, so that a task's table doesn't grow with the input.
    marked = stored(predicted.withColumn("_p", F.lit(1)).unionByName(truth.withColumn("_p", F.lit(2))))
    dealt = marked.repartition(max(1, -(-marked.count() // ROWS)), *predicted.columns)
    sides = dealt.groupBy(*predicted.columns).agg(F.bit_or("_p").alias("_s"))
    count = lambda n: F.count(F.when(F.col("_s") == n, 1))
    tp, fp, fn = count(3), count(1), count(2)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return sides.agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
