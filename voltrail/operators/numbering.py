"""Row numbers over data that does not fit one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltrail.functions.measures import join_keyed
from voltrail.session import checkpointed


def number_rows(df: DataFrame, order: list[str], keys=(), name: str = "row_no") -> DataFrame:
    """Number rows from 1 in ``order``, per key, without a per-key window.

    A range-partitioned sort spreads rows evenly, hot keys included; exact
    copies are told apart by their input position so they can be split too.
    The call runs a job: the sorted rows are checkpointed, which pins down both the order and the
    position ids.  The numbers then follow from one small table of counts per
    key and partition.
    """
    placed = df.withColumn("_input", F.monotonically_increasing_id())
    ranked = (
        placed.orderBy(*keys, *order, "_input")
        .drop("_input")
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_pos", 33))
    )
    fixed = checkpointed(ranked)
    cell = [*keys, "_part"]
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        fixed.groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_pos").alias("_first"))
        .select(
            *cell,
            (F.coalesce(F.sum("_rows").over(before), F.lit(0)) + 1 - F.col("_first")).alias("_shift"),
        )
    )
    return (
        join_keyed(fixed, offsets, cell)
        .withColumn(name, F.col("_pos") + F.col("_shift"))
        .drop("_pos", "_part", "_shift")
    )
