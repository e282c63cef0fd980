"""Dense numbers in a total order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import materialize

_LOCAL = 33  # bits of monotonically_increasing_id that count within a partition


def numbered(df: DataFrame, name: str, *order: str | Column, start: int = 0) -> DataFrame:
    """``df`` with ``name`` counting from ``start`` in the given order, which should be total. Rows are range-sorted;
    only the partitions' sizes are summed up in one place."""
    s = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = s.groupBy(F.shiftright("_at", _LOCAL).alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row per partition
    out = s.withColumn("_part", F.shiftright("_at", _LOCAL)).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << _LOCAL) - 1) + start).drop("_at", "_part", "_before")
