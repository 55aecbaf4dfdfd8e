"""Gold tables: lifetime measures, calendar rollups, battery health, buckets.

``keys=()`` aggregates over the whole fleet, ``keys=("vehicle_id",)`` per
vehicle.  All inputs but battery health are trip-sized tables.  Sums and means
of rounded measures are taken in fixed point, so a table does not change from
run to run with the order of partial sums.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.functions.measures import bucket, fixed_avg, fixed_sum, label, ratio
from voltrail.operators.trips import MIN_TRIP_MILES

# Bucket edges and labels.
TEMPERATURE_EDGES = [20, 32, 50, 70, 85, 100]
TEMPERATURE_LABELS = [
    "< 20°F", "20-32°F", "32-50°F", "50-70°F", "70-85°F", "85-100°F", "100°F+",
]
SPEED_EDGES = [15, 25, 35, 45, 55, 65, 75]
SPEED_LABELS = [
    "< 15 mph", "15-25 mph", "25-35 mph", "35-45 mph",
    "45-55 mph", "55-65 mph", "65-75 mph", "75+ mph",
]

# Shortest charge and shortest trip that count.
MIN_CHARGE_MINUTES = 1
MIN_BUCKET_MILES = 1


def _driven(trips: DataFrame) -> DataFrame:
    return trips.filter(F.col("distance_miles") > MIN_TRIP_MILES)


def trip_totals(trips: DataFrame, keys=()) -> DataFrame:
    return (
        _driven(trips)
        .groupBy(*keys)
        .agg(
            fixed_sum(F.col("distance_miles"), 2).alias("total_miles"),
            fixed_sum(F.col("energy_consumed_kwh"), 3).alias("total_energy_consumed_kwh"),
            fixed_sum(F.col("energy_regen_kwh"), 3).alias("total_energy_regen_kwh"),
            fixed_sum(F.col("net_energy_kwh"), 3).alias("total_net_energy_kwh"),
            fixed_sum(F.col("hvac_energy_kwh"), 3).alias("total_hvac_energy_kwh"),
            F.count(F.lit(1)).alias("total_trips"),
            fixed_sum(F.col("duration_minutes"), 1).alias("total_driving_minutes"),
            fixed_avg(F.col("efficiency_mi_per_kwh"), 2).alias("avg_efficiency"),
            F.max("max_speed_mph").alias("top_speed_mph"),
        )
    )


def charge_totals(charges: DataFrame, keys=()) -> DataFrame:
    return (
        charges.filter(F.col("duration_minutes") > MIN_CHARGE_MINUTES)
        .groupBy(*keys)
        .agg(
            fixed_sum(F.col("energy_added_kwh"), 3).alias("total_energy_charged_kwh"),
            F.count(F.lit(1)).alias("total_charge_sessions"),
            fixed_sum(F.col("duration_minutes"), 1).alias("total_charge_minutes"),
        )
    )


def battery_ends(silver: DataFrame, keys=()) -> DataFrame:
    """First and latest capacity and resistance, over rows with a capacity.

    A fleet-wide result breaks equal times by vehicle.
    """
    ties = [c for c in ("vehicle_id",) if c in silver.columns and c not in keys]
    at = F.struct("timestamp", *ties) if ties else F.col("timestamp")
    return (
        _with_capacity(silver)
        .groupBy(*keys)
        .agg(
            F.min_by("battery_capacity_ah", at).alias("initial_capacity_ah"),
            F.max_by("battery_capacity_ah", at).alias("latest_capacity_ah"),
            F.min_by("battery_resistance_mohm", at).alias("initial_resistance_mohm"),
            F.max_by("battery_resistance_mohm", at).alias("latest_resistance_mohm"),
        )
    )


def _with_capacity(silver: DataFrame) -> DataFrame:
    return silver.filter(F.col("battery_capacity_ah") > 0)


def lifetime_kpis(trips: DataFrame, charges: DataFrame, silver: DataFrame, keys=()) -> DataFrame:
    """One row per key (one in all for ``keys=()``), also where a part is empty."""
    return kpis_of([trip_totals(trips, keys), charge_totals(charges, keys), battery_ends(silver, keys)], keys)


def kpis_of(parts: list[DataFrame], keys=()) -> DataFrame:
    """The lifetime measures from trip totals, charge totals and battery ends."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # Each column is filled by one part only, in one row per key.
    t = stacked.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in stacked.columns if c not in keys]
    )
    miles, consumed = F.col("total_miles"), F.col("total_energy_consumed_kwh")
    trips_n = F.coalesce("total_trips", F.lit(0))
    return t.select(
        *keys,
        F.round("total_miles", 1).alias("total_miles_driven"),
        F.round("total_energy_consumed_kwh", 1).alias("total_energy_consumed_kwh"),
        F.round("total_energy_regen_kwh", 1).alias("total_energy_regen_kwh"),
        F.round("total_net_energy_kwh", 1).alias("total_net_energy_kwh"),
        F.round("total_hvac_energy_kwh", 1).alias("total_hvac_energy_kwh"),
        F.round("total_energy_charged_kwh", 1).alias("total_energy_charged_kwh"),
        F.round(ratio(miles, F.col("total_net_energy_kwh")), 2).alias(
            "lifetime_efficiency_mi_per_kwh"
        ),
        F.round("avg_efficiency", 2).alias("avg_trip_efficiency_mi_per_kwh"),
        trips_n.alias("total_trips"),
        F.round(F.col("total_driving_minutes") / 60.0, 1).alias("total_driving_hours"),
        F.round(ratio(miles, trips_n.cast("double")), 1).alias("avg_trip_distance_miles"),
        "top_speed_mph",
        F.coalesce("total_charge_sessions", F.lit(0)).alias("total_charge_sessions"),
        F.round(F.col("total_charge_minutes") / 60.0, 1).alias("total_charge_hours"),
        F.round(ratio(F.col("total_energy_regen_kwh"), consumed) * 100, 1).alias(
            "regen_recovery_pct"
        ),
        F.round(ratio(F.col("total_hvac_energy_kwh"), consumed) * 100, 1).alias("hvac_energy_pct"),
        "initial_capacity_ah",
        "latest_capacity_ah",
        F.round(ratio(F.col("latest_capacity_ah"), F.col("initial_capacity_ah")) * 100, 1).alias(
            "battery_capacity_retention_pct"
        ),
        "initial_resistance_mohm",
        "latest_resistance_mohm",
        F.current_timestamp().alias("last_updated"),
    )


# --- calendar rollups ------------------------------------------------------


def _sum(col: str, places: int, digits: int):
    return F.round(fixed_sum(F.col(col), places), digits).alias(col)


def _avg(col: str, places: int, digits: int, name: str | None = None):
    return F.round(fixed_avg(F.col(col), places), digits).alias(name or col)


def daily_summary(trips: DataFrame, keys=()) -> DataFrame:
    return (
        _driven(trips)
        .groupBy(*keys, F.to_date("trip_start").alias("drive_date"))
        .agg(
            F.count(F.lit(1)).alias("trips"),
            F.round(fixed_sum(F.col("distance_miles"), 2), 1).alias("miles_driven"),
            _sum("net_energy_kwh", 3, 2),
            _sum("energy_consumed_kwh", 3, 2),
            _sum("energy_regen_kwh", 3, 2),
            _sum("hvac_energy_kwh", 3, 2),
            F.round(
                ratio(fixed_sum(F.col("distance_miles"), 2), fixed_sum(F.col("net_energy_kwh"), 3)),
                2,
            ).alias("efficiency_mi_per_kwh"),
            _sum("duration_minutes", 1, 1).alias("driving_minutes"),
            _avg("avg_speed_mph", 1, 1),
            _avg("avg_ambient_temp_f", 1, 1),
            _avg("avg_battery_temp_c", 1, 1),
            F.max("soc_start").alias("max_soc"),
            F.min("soc_end").alias("min_soc"),
        )
    )


def _period_efficiency():
    return F.round(
        ratio(fixed_sum(F.col("miles_driven"), 1), fixed_sum(F.col("net_energy_kwh"), 2)), 2
    ).alias("efficiency_mi_per_kwh")


def weekly_summary(daily: DataFrame, keys=()) -> DataFrame:
    """Weeks start on Monday.  Means are unweighted over days."""
    return daily.groupBy(*keys, F.date_trunc("week", "drive_date").alias("week_start")).agg(
        F.sum("trips").alias("trips"),
        _sum("miles_driven", 1, 1),
        _sum("net_energy_kwh", 2, 2),
        _period_efficiency(),
        _sum("driving_minutes", 1, 1),
        _avg("avg_speed_mph", 1, 1),
        _avg("avg_ambient_temp_f", 1, 1),
    )


def monthly_summary(daily: DataFrame, keys=()) -> DataFrame:
    return daily.groupBy(*keys, F.date_trunc("month", "drive_date").alias("month_start")).agg(
        F.sum("trips").alias("trips"),
        _sum("miles_driven", 1, 1),
        _sum("net_energy_kwh", 2, 2),
        _sum("energy_consumed_kwh", 2, 2),
        _sum("energy_regen_kwh", 2, 2),
        _sum("hvac_energy_kwh", 2, 2),
        _period_efficiency(),
        F.round(fixed_sum(F.col("driving_minutes"), 1) / 60.0, 1).alias("driving_hours"),
        _avg("avg_speed_mph", 1, 1),
        _avg("avg_ambient_temp_f", 1, 1),
    )


def hourly_patterns(trips: DataFrame, keys=()) -> DataFrame:
    return (
        _driven(trips)
        .groupBy(*keys, F.hour("trip_start").alias("hour_of_day"))
        .agg(
            F.count(F.lit(1)).alias("trip_count"),
            _avg("distance_miles", 2, 1, "avg_distance_miles"),
            _avg("efficiency_mi_per_kwh", 2, 2, "avg_efficiency"),
            _avg("avg_speed_mph", 1, 1),
            _avg("duration_minutes", 1, 1, "avg_duration_minutes"),
        )
    )


def battery_health_daily(silver: DataFrame, keys=()) -> DataFrame:
    return (
        _with_capacity(silver)
        .groupBy(*keys, F.col("date").alias("measure_date"))
        .agg(
            _avg("battery_capacity_ah", 9, 2, "avg_capacity_ah"),
            _avg("battery_resistance_mohm", 9, 1, "avg_resistance_mohm"),
            _avg("battery_avg_temp_c", 9, 1, "avg_battery_temp_c"),
            F.round(F.max("battery_temp_spread_c"), 1).alias("max_temp_spread_c"),
            _avg("battery_coolant_temp_c", 9, 1, "avg_coolant_temp_c"),
        )
    )


# --- efficiency buckets ----------------------------------------------------


def _rated(trips: DataFrame) -> DataFrame:
    return trips.filter(
        (F.col("distance_miles") > MIN_BUCKET_MILES) & F.col("efficiency_mi_per_kwh").isNotNull()
    )


def efficiency_by_temperature(trips: DataFrame, keys=()) -> DataFrame:
    """A trip without a temperature counts in the last bucket."""
    order = bucket(F.col("avg_ambient_temp_f"), TEMPERATURE_EDGES)
    hvac, net = fixed_avg(F.col("hvac_energy_kwh"), 3), fixed_avg(F.col("net_energy_kwh"), 3)
    grouped = (
        _rated(trips)
        .groupBy(*keys, order.alias("bucket_order"))
        .agg(
            F.count(F.lit(1)).alias("trip_count"),
            _avg("efficiency_mi_per_kwh", 2, 2, "avg_efficiency_mi_per_kwh"),
            _avg("distance_miles", 2, 1, "avg_distance_miles"),
            F.round(hvac, 3).alias("avg_hvac_energy_kwh"),
            F.round(ratio(hvac, net) * 100, 1).alias("hvac_energy_pct"),
        )
    )
    return _labelled(grouped, keys, "temp_range", TEMPERATURE_LABELS)


def efficiency_by_speed(trips: DataFrame, keys=()) -> DataFrame:
    """A trip without a speed counts in the last bucket."""
    order = bucket(F.col("avg_speed_mph"), SPEED_EDGES)
    regen_share = ratio(F.col("energy_regen_kwh"), F.col("energy_consumed_kwh"))
    grouped = (
        _rated(trips)
        .groupBy(*keys, order.alias("bucket_order"))
        .agg(
            F.count(F.lit(1)).alias("trip_count"),
            _avg("efficiency_mi_per_kwh", 2, 2, "avg_efficiency_mi_per_kwh"),
            _avg("distance_miles", 2, 1, "avg_distance_miles"),
            _avg("net_energy_kwh", 3, 2, "avg_net_energy_kwh"),
            F.round(F.avg(regen_share) * 100, 1).alias("avg_regen_pct"),
        )
    )
    return _labelled(grouped, keys, "speed_range", SPEED_LABELS)


def _labelled(grouped: DataFrame, keys, name: str, labels: list[str]) -> DataFrame:
    measures = [c for c in grouped.columns if c not in {*keys, "bucket_order"}]
    return grouped.select(
        *keys, label(F.col("bucket_order"), labels).alias(name), *measures, "bucket_order"
    )
