"""Verification queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest_summary(bronze: DataFrame) -> DataFrame:
    """Row count, time range and number of days.

    Rows are first counted per day, which turns the distinct count into a
    count of days.
    """
    per_day = bronze.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("timestamp").alias("lo"),
        F.max("timestamp").alias("hi"),
    )
    return per_day.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        F.min("lo").alias("earliest"),
        F.max("hi").alias("latest"),
        F.count("day").alias("days_of_data"),
    )


def newest_rows(bronze: DataFrame, n: int = 20) -> DataFrame:
    return bronze.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(n)


def table_counts(**tables: DataFrame) -> DataFrame:
    """Row count per named table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    first, *others = counts
    for c in others:
        first = first.unionAll(c)
    return first
