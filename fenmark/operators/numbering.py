"""Row numbers over a whole table without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenmark.session import written

#: Rows of a range, about.
RANGE_ROWS = 1 << 20


def number_rows(df: DataFrame, order: str, name: str, buckets: int | None = None) -> DataFrame:
    """df with name = 1, 2, ... in the order of a unique column of any type that can be ordered; nulls come first.

    Rows are dealt into ranges, as many as their number needs (or `buckets`), sorted there and written once; a row's number is its place
    in its range, plus the rows of the ranges before, of which there is one row a range. An empty table stays empty.
    """
    spark = df.sparkSession
    ranges = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    by = F.col(order).asc_nulls_first()
    table = written(df.repartitionByRange(ranges, by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()))
    # the high bits of _at tell the range, the low ones the place in it
    table = table.withColumn("_range", F.shiftright("_at", 33))
    offsets, before = [], 0
    for r in table.groupBy("_range").count().orderBy("_range").collect():
        offsets.append((r["_range"], before))
        before += r["count"]
    starts = spark.createDataFrame(offsets, "_range long, _before long")
    return table.join(F.broadcast(starts), "_range").withColumn(name, F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1).drop("_range", "_at", "_before")
