"""Running sums over an order that is too long for one task."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder (``spark.checkpoint.dir``) and read back.

    Only a session in a single process may go without that setting.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="relcast-"))
    return df.checkpoint(eager=True)


def running(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` in their group up to each row in order; groups have no null.

    Rows are dealt to ranges of the order and written, since ranges are drawn anew whenever they are computed; a range is
    summed in a task and starts from the sums of the group's ranges before it, of which there are few.
    """
    dealt = written(rows.withColumn("__value", value).repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()))
    sums = dealt.groupBy(*group, "__part").agg(F.sum("__value").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*group, "__part", F.coalesce(before, F.lit(0)).alias("__start"))
    within = F.sum("__value").over(Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(starts, [*group, "__part"]).withColumn(name, F.col("__start") + within).drop("__part", "__start", "__value")
