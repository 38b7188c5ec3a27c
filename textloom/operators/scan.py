"""Row numbers and running sums in a total order, without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.scratch import materialize


def ordered_scan(df: DataFrame, order: list[Column | str], sums: dict[str, str] | None = None, number: str = "row_number") -> DataFrame:
    """df with `number` (from 1) and, for each name in sums, the sum of a column over all rows before.

    The rows are range-partitioned and written once; each range is then numbered by
    itself and shifted by the totals of the ranges before it, of which there are as
    many as shuffle partitions.
    """
    sums = sums or {}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "scan")
    totals = ranged.groupBy("__part").agg(F.count("*").alias("__n"), *(F.sum(c).alias(f"__t_{k}") for k, c in sums.items()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), *(F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__s_{k}") for k in sums))
    own = Window.partitionBy("__part").orderBy(*order)
    prior = own.rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(shifts), "__part")  # one row a partition
    out = out.withColumn(number, F.row_number().over(own) + F.col("__n0"))
    for k, c in sums.items():
        out = out.withColumn(k, F.coalesce(F.sum(c).over(prior), F.lit(0)) + F.col(f"__s_{k}"))
    return out.drop("__part", "__n0", *(f"__s_{k}" for k in sums))
