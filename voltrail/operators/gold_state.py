"""Gold tables as mergeable partial state, one set of rows per vehicle and day.

Every gold table is a rollup: rows that count, their day, further groups, and
measures made of parts - exact sums, counts, extremes, first and last values -
that merge.  The state of a day is computed from the rows of that day alone, so
an increment replaces the state of the days it touched and reads nothing else;
the table itself merges state, at most one row per vehicle, day and group.

The results equal those of ``operators.gold`` and, for the weekday table, of
``operators.dashboard``.
"""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrail import VEHICLE
from voltrail.functions.measures import bucket, label, ratio, ticks
from voltrail.operators import gold
from voltrail.operators.dashboard import DAY_NAMES
from voltrail.operators.sessions import Measure, Part, mean
from voltrail.operators.trips import MIN_TRIP_MILES

DAY = "state_date"


@dataclass(frozen=True)
class Rollup:
    """``rows`` names the table the state is made of: trips, charges or silver.

    ``group`` are columns of the state besides vehicle and day; ``by`` those of
    the result, of ``group`` and ``DAY``; ``shape`` names and orders them.
    """

    rows: str
    where: Column
    day: Column
    measures: tuple[Measure, ...]
    group: dict[str, Column] = field(default_factory=dict)
    by: tuple[str, ...] = ()
    shape: Callable[[DataFrame, tuple], DataFrame] = lambda df, keys: df

    def state(self, rows: DataFrame, keys=VEHICLE) -> DataFrame:
        """Partial results per vehicle, day and group."""
        parts = {p.name: p for m in self.measures for p in m.parts}
        counted = rows.filter(self.where).withColumns({DAY: self.day, **self.group})
        return counted.groupBy(*keys, DAY, *self.group).agg(*[p.rows.alias(n) for n, p in parts.items()])

    def result(self, state: DataFrame, keys=()) -> DataFrame:
        """The gold table, over the fleet or per vehicle."""
        merged = state.groupBy(*keys, *self.by).agg(*[m.merge.alias(m.name) for m in self.measures])
        return self.shape(merged, keys)


# --- measures --------------------------------------------------------------


def _summed(col: str, places: int) -> tuple[Part, Column]:
    """An exact sum: its part, and the merged value."""
    value = ticks(F.col(col), places)
    part = Part(f"{col}__s", "sum", F.sum(value), F.sum(f"{col}__s"))
    return part, part.again.cast("double") / 10.0**places


def total(col: str, places: int, digits: int | None, name: str | None = None) -> Measure:
    part, value = _summed(col, places)
    return Measure(name or col, (part,), value if digits is None else F.round(value, digits))


def average(col: str, places: int, digits: int, name: str | None = None) -> Measure:
    return mean(name or col, F.col(col), digits, places)


def count(name: str) -> Measure:
    part = Part(f"{name}__n", "sum", F.count(F.lit(1)), F.sum(f"{name}__n"))
    return Measure(name, (part,), part.again)


def extreme(name: str, col: str, kind: str, digits: int | None = None) -> Measure:
    pick = F.max if kind == "max" else F.min
    part = Part(f"{name}__x", kind, pick(col), pick(f"{name}__x"))
    return Measure(name, (part,), part.again if digits is None else F.round(part.again, digits))


def _share(name: str, top: tuple[str, int], bottom: tuple[str, int], digits: int) -> Measure:
    """Ratio of two sums that other measures keep."""
    values = [F.sum(f"{c}__s").cast("double") / 10.0**p for c, p in (top, bottom)]
    return Measure(name, (), F.round(ratio(*values), digits))


def _end(name: str, col: str, first: bool) -> Measure:
    """Value at the first or last instant; equal instants by vehicle."""
    at, pick, edge = ("first_at", F.min_by, F.min) if first else ("last_at", F.max_by, F.max)
    instant = F.col("timestamp")
    parts = (
        Part(at, "min" if first else "max", edge(instant), edge(at)),
        Part(f"{name}__v", "first" if first else "last", pick(col, instant), pick(f"{name}__v", F.struct(at, *VEHICLE))),
    )
    return Measure(name, parts, parts[1].again)


# --- the gold tables -------------------------------------------------------


def _driven() -> Column:
    return F.col("distance_miles") > MIN_TRIP_MILES


def _rated() -> Column:
    return (F.col("distance_miles") > gold.MIN_BUCKET_MILES) & F.col("efficiency_mi_per_kwh").isNotNull()


def _trip_day() -> Column:
    return F.to_date("trip_start")


def _named_day(name: str):
    return lambda df, keys: df.withColumnRenamed(DAY, name)


def _bucketed(name: str, labels: list[str]):
    def shape(df: DataFrame, keys) -> DataFrame:
        rest = [c for c in df.columns if c not in {*keys, "bucket_order"}]
        return df.select(*keys, label(F.col("bucket_order"), labels).alias(name), *rest, "bucket_order")

    return shape


def _mean_share(top: tuple[str, int], bottom: tuple[str, int]) -> Column:
    """Ratio of two means that other measures keep."""
    means = []
    for name, places in (top, bottom):
        n = F.nullif(F.sum(f"{name}__n"), F.lit(0))
        means.append(F.sum(f"{name}__sum").cast("double") / n / 10.0**places)
    return F.round(ratio(*means) * 100, 1)


def _weekdays(df: DataFrame, keys) -> DataFrame:
    named = label(F.col("day_of_week"), DAY_NAMES).alias("day_name")
    return df.select(*keys, named, *[c for c in df.columns if c not in keys]).orderBy(*keys, "day_of_week")


#: Decimal places of a ratio of two energies, so that its mean does not depend on order.
SHARE_PLACES = 12


def rollups() -> dict[str, Rollup]:
    """Every gold table that is made of rows; the calendar rollups of weeks and
    months are made of the daily table."""
    regen = ratio(F.col("energy_regen_kwh"), F.col("energy_consumed_kwh"))
    capacity = F.col("battery_capacity_ah") > 0
    net_mean = mean("net__mean", F.col("net_energy_kwh"), 2, 3)
    return {
        "trip_totals": Rollup(
            "trips", _driven(), _trip_day(),
            (
                total("distance_miles", 2, None, "total_miles"),
                total("energy_consumed_kwh", 3, None, "total_energy_consumed_kwh"),
                total("energy_regen_kwh", 3, None, "total_energy_regen_kwh"),
                total("net_energy_kwh", 3, None, "total_net_energy_kwh"),
                total("hvac_energy_kwh", 3, None, "total_hvac_energy_kwh"),
                count("total_trips"),
                total("duration_minutes", 1, None, "total_driving_minutes"),
                average("efficiency_mi_per_kwh", 2, 15, "avg_efficiency"),
                extreme("top_speed_mph", "max_speed_mph", "max"),
            ),
        ),
        "charge_totals": Rollup(
            "charges", F.col("duration_minutes") > gold.MIN_CHARGE_MINUTES, F.to_date("charge_start"),
            (
                total("energy_added_kwh", 3, None, "total_energy_charged_kwh"),
                count("total_charge_sessions"),
                total("duration_minutes", 1, None, "total_charge_minutes"),
            ),
        ),
        "battery_ends": Rollup(
            "silver", capacity, F.col("date"),
            (
                _end("initial_capacity_ah", "battery_capacity_ah", True),
                _end("latest_capacity_ah", "battery_capacity_ah", False),
                _end("initial_resistance_mohm", "battery_resistance_mohm", True),
                _end("latest_resistance_mohm", "battery_resistance_mohm", False),
            ),
        ),
        "daily_summary": Rollup(
            "trips", _driven(), _trip_day(),
            (
                count("trips"),
                total("distance_miles", 2, 1, "miles_driven"),
                *[total(c, 3, 2) for c in ("net_energy_kwh", "energy_consumed_kwh", "energy_regen_kwh", "hvac_energy_kwh")],
                _share("efficiency_mi_per_kwh", ("distance_miles", 2), ("net_energy_kwh", 3), 2),
                total("duration_minutes", 1, 1, "driving_minutes"),
                *[average(c, 1, 1) for c in ("avg_speed_mph", "avg_ambient_temp_f", "avg_battery_temp_c")],
                extreme("max_soc", "soc_start", "max"),
                extreme("min_soc", "soc_end", "min"),
            ),
            by=(DAY,), shape=_named_day("drive_date"),
        ),
        "hourly_patterns": Rollup(
            "trips", _driven(), _trip_day(),
            (
                count("trip_count"),
                average("distance_miles", 2, 1, "avg_distance_miles"),
                average("efficiency_mi_per_kwh", 2, 2, "avg_efficiency"),
                average("avg_speed_mph", 1, 1),
                average("duration_minutes", 1, 1, "avg_duration_minutes"),
            ),
            group={"hour_of_day": F.hour("trip_start")}, by=("hour_of_day",),
        ),
        "battery_health": Rollup(
            "silver", capacity, F.col("date"),
            (
                average("battery_capacity_ah", 9, 2, "avg_capacity_ah"),
                average("battery_resistance_mohm", 9, 1, "avg_resistance_mohm"),
                average("battery_avg_temp_c", 9, 1, "avg_battery_temp_c"),
                extreme("max_temp_spread_c", "battery_temp_spread_c", "max", 1),
                average("battery_coolant_temp_c", 9, 1, "avg_coolant_temp_c"),
            ),
            by=(DAY,), shape=_named_day("measure_date"),
        ),
        "efficiency_by_temperature": Rollup(
            "trips", _rated(), _trip_day(),
            (
                count("trip_count"),
                average("efficiency_mi_per_kwh", 2, 2, "avg_efficiency_mi_per_kwh"),
                average("distance_miles", 2, 1, "avg_distance_miles"),
                average("hvac_energy_kwh", 3, 3, "avg_hvac_energy_kwh"),
                Measure("hvac_energy_pct", net_mean.parts, _mean_share(("avg_hvac_energy_kwh", 3), ("net__mean", 3))),
            ),
            group={"bucket_order": bucket(F.col("avg_ambient_temp_f"), gold.TEMPERATURE_EDGES)}, by=("bucket_order",),
            shape=_bucketed("temp_range", gold.TEMPERATURE_LABELS),
        ),
        "efficiency_by_speed": Rollup(
            "trips", _rated(), _trip_day(),
            (
                count("trip_count"),
                average("efficiency_mi_per_kwh", 2, 2, "avg_efficiency_mi_per_kwh"),
                average("distance_miles", 2, 1, "avg_distance_miles"),
                average("net_energy_kwh", 3, 2, "avg_net_energy_kwh"),
                mean("avg_regen_pct", 100 * regen, 1, SHARE_PLACES),
            ),
            group={"bucket_order": bucket(F.col("avg_speed_mph"), gold.SPEED_EDGES)}, by=("bucket_order",),
            shape=_bucketed("speed_range", gold.SPEED_LABELS),
        ),
        "weekday_distribution": Rollup(
            "silver", F.col("is_moving"), F.col("date"),
            (
                # Days count once over the fleet, however many vehicles drove.
                Measure("days_with_driving", (), F.count_distinct(DAY)),
                average("instant_efficiency_mi_per_kwh", 2, 2, "avg_efficiency"),
                average("speed_mph", 1, 1, "avg_speed_mph"),
            ),
            group={"day_of_week": F.col("day_of_week")}, by=("day_of_week",), shape=_weekdays,
        ),
    }


KPI_PARTS = ("trip_totals", "charge_totals", "battery_ends")
CALENDAR = {"weekly_summary": gold.weekly_summary, "monthly_summary": gold.monthly_summary}
TABLES = (
    "lifetime_kpis", "daily_summary", *CALENDAR, "hourly_patterns", "battery_health",
    "efficiency_by_temperature", "efficiency_by_speed", "weekday_distribution",
)


def table(name: str, state: Callable[[str], DataFrame], keys=()) -> DataFrame:
    """A gold table; ``state`` reads the stored state of a rollup."""
    known = rollups()
    if name in CALENDAR:
        return CALENDAR[name](table("daily_summary", state, keys), keys)
    if name == "lifetime_kpis":
        return gold.kpis_of([known[p].result(state(p), keys) for p in KPI_PARTS], keys)
    return known[name].result(state(name), keys)
