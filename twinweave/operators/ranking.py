"""Running numbers over a whole table in any order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinweave.operators.checkpoints import materialise

_PLACES = 33  # of the row in its partition, in the ids that Spark gives


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Add the place of each row in the order, from 1. Rows that the order does not tell apart get places in any order.

    The rows are range-sorted and written with their place in their range; what meets in one task is one
    count for each range.
    """
    kept = [c for c in df.columns if c != name]
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = materialise(spread.select(*kept, F.monotonically_increasing_id().alias("__at")), "ranked")
    part = F.shiftright("__at", _PLACES)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << _PLACES) - 1)) + 1
    return held.withColumn("__part", part).join(F.broadcast(counts), "__part").select(*kept, place.cast("int").alias(name))  # one row for each range
