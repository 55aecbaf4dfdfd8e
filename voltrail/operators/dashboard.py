"""Dashboard queries over silver and gold tables.

Ordered results sort summary-sized tables, except the two timelines, which
sort the rows of one time range.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrail.functions.measures import bucket, fixed_avg, fixed_sum, label, ratio, ticks
from voltrail.operators.gold import MIN_CHARGE_MINUTES
from voltrail.operators.trips import MIN_TRIP_MILES, moving

# Cards, labels, edges and default prices.
KPI_CARDS = (
    "total_miles_driven", "lifetime_efficiency_mi_per_kwh", "total_net_energy_kwh",
    "total_trips", "total_driving_hours", "avg_trip_distance_miles", "top_speed_mph",
    "regen_recovery_pct", "hvac_energy_pct", "battery_capacity_retention_pct",
    "total_charge_sessions", "total_energy_charged_kwh",
)
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
SOC_EDGES = [20, 40, 60, 80]
SOC_LABELS = ["0-20%", "20-40%", "40-60%", "60-80%", "80-100%"]
MIN_RATED_CHARGE_MINUTES = 5
ELECTRICITY_RATE = 0.12  # $ per kWh
GAS_MILES_PER_GALLON = 30.0
GAS_PRICE = 3.50  # $ per gallon


def kpi_cards(kpis: DataFrame, keys=()) -> DataFrame:
    return kpis.select(*keys, *KPI_CARDS)


# --- efficiency and energy over time ---------------------------------------


def daily_efficiency(daily: DataFrame, keys=()) -> DataFrame:
    return (
        daily.filter(F.col("efficiency_mi_per_kwh").isNotNull())
        .select(
            *keys, "drive_date", "efficiency_mi_per_kwh", "miles_driven",
            "net_energy_kwh", "avg_ambient_temp_f",
        )
        .orderBy(*keys, "drive_date")
    )


def weekly_efficiency(weekly: DataFrame, keys=()) -> DataFrame:
    return weekly.select(
        *keys, "week_start", "efficiency_mi_per_kwh", "miles_driven", "trips"
    ).orderBy(*keys, "week_start")


def _month() -> Column:
    return F.date_format("month_start", "yyyy-MM").alias("month")


def monthly_efficiency(monthly: DataFrame, keys=()) -> DataFrame:
    return monthly.orderBy(*keys, "month_start").select(
        *keys, _month(), "efficiency_mi_per_kwh", "miles_driven",
        "net_energy_kwh", "driving_hours", "trips",
    )


def daily_energy(daily: DataFrame, keys=()) -> DataFrame:
    return daily.select(
        *keys, "drive_date", "energy_consumed_kwh", "energy_regen_kwh", "hvac_energy_kwh",
        (F.col("net_energy_kwh") - F.col("hvac_energy_kwh")).alias("drivetrain_energy_kwh"),
    ).orderBy(*keys, "drive_date")


def energy_split(daily: DataFrame, keys=()) -> DataFrame:
    net, hvac = fixed_sum(F.col("net_energy_kwh"), 2), fixed_sum(F.col("hvac_energy_kwh"), 2)
    return daily.groupBy(*keys).agg(
        F.round(net - hvac, 1).alias("drivetrain_kwh"),
        F.round(hvac, 1).alias("hvac_kwh"),
        F.round(fixed_sum(F.col("energy_regen_kwh"), 2), 1).alias("regen_recovered_kwh"),
    )


def cumulative_totals(daily: DataFrame, keys=()) -> DataFrame:
    """Running totals by day.  The window holds one row per day."""
    so_far = Window.partitionBy(*keys).orderBy("drive_date")

    def running(col: str, places: int) -> Column:
        return F.sum(ticks(F.col(col), places)).over(so_far).cast("double") / 10.0**places

    return daily.select(
        *keys,
        "drive_date",
        running("miles_driven", 1).alias("cumulative_miles"),
        running("net_energy_kwh", 2).alias("cumulative_energy_kwh"),
    ).orderBy(*keys, "drive_date")


# --- temperature and speed -------------------------------------------------


def efficiency_vs_temperature(by_temperature: DataFrame, keys=()) -> DataFrame:
    return by_temperature.orderBy(*keys, "bucket_order").select(
        *keys, "temp_range", "trip_count", "avg_efficiency_mi_per_kwh",
        "avg_hvac_energy_kwh", "hvac_energy_pct",
    )


def efficiency_vs_speed(by_speed: DataFrame, keys=()) -> DataFrame:
    return by_speed.orderBy(*keys, "bucket_order").select(
        *keys, "speed_range", "trip_count", "avg_efficiency_mi_per_kwh", "avg_regen_pct"
    )


def efficiency_scatter(daily: DataFrame, keys=()) -> DataFrame:
    return daily.filter(F.col("efficiency_mi_per_kwh").isNotNull()).select(
        *keys, "drive_date", "avg_ambient_temp_f", "efficiency_mi_per_kwh", "miles_driven"
    )


# --- battery ---------------------------------------------------------------


def capacity_trend(health: DataFrame, keys=()) -> DataFrame:
    return health.select(*keys, "measure_date", "avg_capacity_ah", "avg_resistance_mohm").orderBy(
        *keys, "measure_date"
    )


def battery_temperature_trend(health: DataFrame, keys=()) -> DataFrame:
    return health.select(
        *keys, "measure_date", "avg_battery_temp_c", "max_temp_spread_c", "avg_coolant_temp_c"
    ).orderBy(*keys, "measure_date")


# --- driving patterns ------------------------------------------------------


def driving_hours(hourly: DataFrame, keys=()) -> DataFrame:
    return hourly.select(
        *keys, "hour_of_day", "trip_count", "avg_distance_miles", "avg_efficiency", "avg_speed_mph"
    ).orderBy(*keys, "hour_of_day")


def weekday_distribution(silver: DataFrame, keys=()) -> DataFrame:
    """Per weekday over moving rows.

    Rows are first summed per date, so the distinct count of dates is a plain
    count over at most one row per date.
    """
    speed, eff = ticks(F.col("speed_mph"), 1), ticks(F.col("instant_efficiency_mi_per_kwh"), 2)
    per_date = (
        moving(silver)
        .groupBy(*keys, "day_of_week", "date")
        .agg(
            F.sum(eff).alias("eff_sum"),
            F.count(eff).alias("eff_n"),
            F.sum(speed).alias("speed_sum"),
            F.count(speed).alias("speed_n"),
        )
    )

    def avg(name: str, places: int) -> Column:
        n = F.nullif(F.sum(f"{name}_n"), F.lit(0))
        return F.round(F.sum(f"{name}_sum").cast("double") / n / 10.0**places, places)

    return (
        per_date.groupBy(*keys, "day_of_week")
        .agg(
            F.count("date").alias("days_with_driving"),
            avg("eff", 2).alias("avg_efficiency"),
            avg("speed", 1).alias("avg_speed_mph"),
        )
        .orderBy(*keys, "day_of_week")
        .select(
            *keys,
            label(F.col("day_of_week"), DAY_NAMES).alias("day_name"),
            "day_of_week",
            "days_with_driving",
            "avg_efficiency",
            "avg_speed_mph",
        )
    )


# --- trip and charge lists -------------------------------------------------


def _shown(columns: dict[str, tuple[str, int]]) -> list[Column]:
    return [F.round(col, digits).alias(name) for name, (col, digits) in columns.items()]


def trip_list(trips: DataFrame, keys=()) -> DataFrame:
    return (
        trips.filter(F.col("distance_miles") > MIN_TRIP_MILES)
        .select(
            *keys,
            "trip_id",
            "trip_start",
            "trip_end",
            "duration_minutes",
            *_shown({"distance_miles": ("distance_miles", 1)}),
            "efficiency_mi_per_kwh",
            *_shown(
                {
                    "net_energy_kwh": ("net_energy_kwh", 2),
                    "energy_regen_kwh": ("energy_regen_kwh", 2),
                    "hvac_energy_kwh": ("hvac_energy_kwh", 2),
                    "avg_speed_mph": ("avg_speed_mph", 1),
                }
            ),
            "max_speed_mph",
            *_shown(
                {
                    "soc_start_pct": ("soc_start", 1),
                    "soc_end_pct": ("soc_end", 1),
                    "soc_used_pct": ("soc_used", 1),
                    "ambient_temp_f": ("avg_ambient_temp_f", 0),
                    "battery_temp_c": ("avg_battery_temp_c", 0),
                }
            ),
        )
        .orderBy(F.col("trip_start").desc())
    )


def charge_list(charges: DataFrame, keys=()) -> DataFrame:
    return (
        charges.filter(F.col("duration_minutes") > MIN_CHARGE_MINUTES)
        .select(
            *keys,
            "session_id",
            "charge_start",
            "charge_end",
            "duration_minutes",
            *_shown(
                {
                    "soc_start_pct": ("soc_start", 1),
                    "soc_end_pct": ("soc_end", 1),
                    "soc_gained_pct": ("soc_gained", 1),
                    "avg_charge_kw": ("avg_charge_rate_kw", 1),
                    "peak_charge_kw": ("peak_charge_rate_kw", 1),
                    "energy_added_kwh": ("energy_added_kwh", 2),
                    "battery_temp_c": ("avg_battery_temp_c", 0),
                }
            ),
        )
        .orderBy(F.col("charge_start").desc())
    )


def charge_rate_by_soc(charges: DataFrame, keys=()) -> DataFrame:
    """A session without a starting charge counts in the last bucket."""
    return (
        charges.filter(F.col("duration_minutes") > MIN_RATED_CHARGE_MINUTES)
        .groupBy(*keys, bucket(F.col("soc_start"), SOC_EDGES).alias("bucket_order"))
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.round(fixed_avg(F.col("avg_charge_rate_kw"), 2), 1).alias("avg_charge_rate_kw"),
            F.round(fixed_avg(F.col("peak_charge_rate_kw"), 2), 1).alias("avg_peak_charge_rate_kw"),
        )
        .orderBy(*keys, "bucket_order")
        .select(
            *keys,
            label(F.col("bucket_order"), SOC_LABELS).alias("starting_soc_range"),
            "sessions",
            "avg_charge_rate_kw",
            "avg_peak_charge_rate_kw",
        )
    )


# --- recent activity -------------------------------------------------------


def _since(silver: DataFrame, as_of, **back) -> DataFrame:
    """Rows newer than ``as_of`` less an interval; prunes a ``date`` partition."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    start = now - F.make_dt_interval(**{k: F.lit(v) for k, v in back.items()})
    rows = silver.filter(F.col("timestamp") > start)
    return rows.filter(F.col("date") >= F.to_date(start))


def last_day(silver: DataFrame, as_of=None, hours: int = 24, keys=()) -> DataFrame:
    return (
        _since(silver, as_of, hours=hours)
        .select(
            *keys, "timestamp", "speed_mph", "power_kw", F.col("soc_hd").alias("soc"),
            "battery_avg_temp_c", "hvac_power_kw", "instant_efficiency_mi_per_kwh",
        )
        .orderBy("timestamp")
    )


def soc_week(silver: DataFrame, as_of=None, days: int = 7, keys=()) -> DataFrame:
    return (
        _since(silver, as_of, days=days)
        .select(*keys, "timestamp", F.col("soc_hd").alias("soc"), "is_charging", "is_moving")
        .orderBy("timestamp")
    )


# --- cost ------------------------------------------------------------------


def rate_params(monthly: DataFrame, rate: float = ELECTRICITY_RATE) -> DataFrame:
    """The table with the price as a constant column."""
    return monthly.withColumn("electricity_rate_per_kwh", F.lit(float(rate)))


def electricity_cost(
    monthly: DataFrame,
    rate: float = ELECTRICITY_RATE,
    mpg: float = GAS_MILES_PER_GALLON,
    gas_price: float = GAS_PRICE,
    keys=(),
) -> DataFrame:
    miles, net = F.col("miles_driven"), F.col("net_energy_kwh")
    cost = net * F.col("electricity_rate_per_kwh")
    return (
        rate_params(monthly, rate)
        .select(
            *keys,
            "month_start",
            _month(),
            "net_energy_kwh",
            F.round(cost, 2).alias("estimated_cost"),
            F.round(ratio(miles, net), 2).alias("efficiency"),
            F.round(ratio(miles, cost), 1).alias("miles_per_dollar"),
            F.round(miles / float(mpg) * float(gas_price), 2).alias("gas_equivalent_cost"),
        )
        .orderBy(*keys, "month_start")
    )
