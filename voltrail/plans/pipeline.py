"""Bronze to silver to sessions to gold, each layer stored and read again.

Everything after bronze reads stored tables: silver is deduplicated once,
trips and charging sessions are found once, and a gold or dashboard table
reads the few columns it needs of them.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail import VEHICLE
from voltrail.operators import charging, gold, telemetry, trips
from voltrail.sources.tables import store_by, stored_by, width_of


@dataclass(frozen=True)
class Stored:
    """The stored tables below ``root``."""

    spark: SparkSession
    root: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    @property
    def silver(self) -> DataFrame:
        return stored_by(self.spark, f"{self.root}/silver")

    @property
    def trips(self) -> DataFrame:
        return self.read("trips")

    @property
    def charges(self) -> DataFrame:
        return self.read("charging_sessions")


def day_width(bronze: DataFrame) -> int:
    """Days that share a folder of the layers above, by the rows of a date."""
    return width_of(telemetry.timed(bronze), F.to_date("timestamp"))


def build(bronze: DataFrame, root: str, keys=VEHICLE, carry_gap: bool = True) -> Stored:
    """Store silver by date, or by spans of days where dates are many and small,
    then trips and charging sessions."""
    spark = bronze.sparkSession
    out = Stored(spark, root)
    rows = telemetry.silver(bronze, keys)
    store_by(rows, f"{root}/silver", "date", day_width(bronze))
    # A partition column is read last; the silver table keeps its own order.
    stored = out.silver.select(*rows.columns)
    trips.trip_ratios(trips.trips(stored, keys, carry_gap=carry_gap)).write.mode("overwrite").parquet(
        f"{root}/trips"
    )
    charging.charging_sessions(stored, keys, carry_gap=carry_gap).write.mode("overwrite").parquet(
        f"{root}/charging_sessions"
    )
    return out


def build_gold(stored: Stored, keys=()) -> dict[str, DataFrame]:
    """The gold tables over the stored layers, stored themselves."""
    daily = gold.daily_summary(stored.trips, keys)
    tables = {
        "lifetime_kpis": gold.lifetime_kpis(stored.trips, stored.charges, stored.silver, keys),
        "daily_summary": daily,
        "weekly_summary": gold.weekly_summary(daily, keys),
        "monthly_summary": gold.monthly_summary(daily, keys),
        "hourly_patterns": gold.hourly_patterns(stored.trips, keys),
        "battery_health": gold.battery_health_daily(stored.silver, keys),
        "efficiency_by_temperature": gold.efficiency_by_temperature(stored.trips, keys),
        "efficiency_by_speed": gold.efficiency_by_speed(stored.trips, keys),
    }
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{stored.root}/{name}")
    return {name: stored.read(name) for name in tables}
