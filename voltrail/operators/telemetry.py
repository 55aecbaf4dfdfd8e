"""Bronze to silver: latest copy per instant, range checks, derived measures."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrail import VEHICLE
from voltrail.functions.measures import (
    fahrenheit_to_celsius,
    kmh_to_mph,
    power_kw,
    watts_to_kw,
)

# Accepted ranges, both ends inclusive.
VALID_RANGES = {
    "speed_kmh": (0, 200),
    "voltage_volts": (200, 450),
    "soc": (0, 100),
}

# Thresholds of the derived columns.
MIN_SPEED_KMH = 3
MIN_POWER_KW = 0.5
CHARGE_AMPS = -1.0


def timed(df: DataFrame) -> DataFrame:
    """Drop rows without a timestamp."""
    return df.filter(F.col("timestamp").isNotNull())


def dedup_latest(
    df: DataFrame,
    keys=VEHICLE,
    ts: str | None = "timestamp",
    version: str = "_ingested_at",
    tie_break=("_source_file", "id"),
) -> DataFrame:
    """Keep the latest ingested row per key and instant (per key without ``ts``).

    Spark plans ``row_number() = 1`` as a group limit on both sides of the
    shuffle, so each task ships at most one row per instant however many
    copies it holds.  Equal versions are settled by ``tie_break``, which ends
    in the unique id: the winner is the same after a retried task, and no
    column is read for the order alone.
    """
    group = [*keys, ts] if ts else list(keys)
    first = [c for c in tie_break if c in df.columns]
    order = [F.col(version).desc(), *[F.col(c).asc() for c in first]]
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def valid(ranges=VALID_RANGES) -> Column:
    """True where every ranged measure is NULL or inside its range."""
    checks = [F.col(c).isNull() | F.col(c).between(lo, hi) for c, (lo, hi) in ranges.items()]
    return reduce(lambda a, b: a & b, checks)


def validate(df: DataFrame, ranges=VALID_RANGES) -> DataFrame:
    return df.filter(valid(ranges))


# --- derived columns -------------------------------------------------------


def _kw() -> Column:
    return power_kw(F.col("current_amps"), F.col("voltage_volts"))


def calendar() -> dict[str, Column]:
    """Date, hour and weekday (1 is Sunday)."""
    return {
        "date": F.to_date("timestamp"),
        "hour": F.hour("timestamp"),
        "day_of_week": F.dayofweek("timestamp"),
    }


def drivetrain_kw() -> Column:
    """Battery power less climate power; unknown climate power counts as 0."""
    return _kw() - watts_to_kw(F.coalesce(F.col("hvac_measured_power_w"), F.lit(0.0)))


def instant_efficiency() -> Column:
    """mi/kWh while driving on battery power, else NULL."""
    speed = F.col("speed_kmh")
    return F.when(
        (speed > MIN_SPEED_KMH) & (_kw() > MIN_POWER_KW), F.round(kmh_to_mph(speed) / _kw(), 2)
    )


def flags() -> dict[str, Column]:
    """Driving state; unknown where its inputs are."""
    speed, returning = F.col("speed_kmh"), F.col("current_amps") < CHARGE_AMPS
    return {
        "is_moving": speed > 0,
        "is_charging": returning & (speed == 0),
        "is_regen": returning & (speed > 0),
    }


def enrich(df: DataFrame) -> DataFrame:
    """The silver projection: 32 columns in order, after any vehicle key."""
    lead = [c for c in VEHICLE if c in df.columns]
    return df.select(
        *lead,
        "id",
        "timestamp",
        *[expr.alias(name) for name, expr in calendar().items()],
        "soc",
        "soc_hd",
        "speed_kmh",
        F.round(kmh_to_mph(F.col("speed_kmh")), 1).alias("speed_mph"),
        "current_amps",
        "voltage_volts",
        F.round(_kw(), 3).alias("power_kw"),
        F.round(drivetrain_kw(), 3).alias("drivetrain_power_kw"),
        "distance_mi",
        "ambient_temp_f",
        F.round(fahrenheit_to_celsius(F.col("ambient_temp_f")), 1).alias("ambient_temp_c"),
        "battery_avg_temp_c",
        "battery_max_temp_c",
        "battery_min_temp_c",
        "battery_coolant_temp_c",
        F.round(F.col("battery_max_temp_c") - F.col("battery_min_temp_c"), 1).alias("battery_temp_spread_c"),
        "hvac_measured_power_w",
        F.round(watts_to_kw(F.col("hvac_measured_power_w")), 3).alias("hvac_power_kw"),
        "hvac_commanded_power_w",
        "ac_compressor_on",
        "battery_capacity_ah",
        "battery_resistance_mohm",
        instant_efficiency().alias("instant_efficiency_mi_per_kwh"),
        *[expr.alias(name) for name, expr in flags().items()],
        "_ingested_at",
    )


def of_known_vehicle(df: DataFrame, keys=VEHICLE) -> DataFrame:
    """Rows whose keys are all known; the others are ``of_unknown_vehicle``."""
    return df.dropna(subset=list(keys)) if keys else df


def of_unknown_vehicle(df: DataFrame, keys=VEHICLE) -> DataFrame:
    """Quarantine: rows that no vehicle can be told for.  They never share a
    key with each other, so none removes another as a copy."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys], F.lit(False)))


def silver(bronze: DataFrame, keys=VEHICLE) -> DataFrame:
    """Cleaned telemetry.  Ranges are checked after the dedup: a late invalid
    copy of a row removes the instant instead of reviving the older copy."""
    return enrich(validate(dedup_latest(timed(of_known_vehicle(bronze, keys)), keys)))
