"""Running totals over a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import materialise


def running_total(df: DataFrame, value: str, order: list[str], group: list[str] | None = None, out: str = "upto") -> DataFrame:
    """``df`` with the inclusive running sum of ``value`` by ``order`` (unique within a group), per group if any.

    Two levels: rows are range-partitioned, so that a large group spreads over many tasks; each range sums its rows, the
    sums of the ranges before are added to a sum within the range. Ranges are checkpointed once, so that their numbers
    stay what they were when a task is repeated. Null values count as 0.
    """
    group = group or []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *group, *order).withColumn("__range", F.spark_partition_id())
    ranged = materialise(ranged)
    sums = ranged.groupBy(*group, "__range").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as ranges and groups; a single window over them is small whatever the data.
    offsets = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).drop("__sum")
    within = Window.partitionBy(*group, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("__local", F.sum(F.coalesce(F.col(value), F.lit(0))).over(within))
    same = [local[g].eqNullSafe(offsets[g]) for g in group] + [local["__range"] == offsets["__range"]]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    joined = local.join(offsets, condition)
    return joined.select(*[local[c] for c in df.columns], (F.col("__local") + F.col("__before")).alias(out))
