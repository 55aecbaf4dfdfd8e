"""Signals to samples, live state, distance since a reset."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrail import VEHICLE
from voltrail.functions.measures import (
    KM_PER_MILE,
    MILES_PER_KM,
    join_keyed,
    power_kw,
    watts_to_kw,
)
from voltrail.operators.frames import SIGNAL_NAMES

# A sample is stored only if one of these was seen.
CORE_SIGNALS = ("speed_mph", "current_amps", "voltage_volts", "soc")

# Fixed value: live efficiency above this is reported as -1.
MAX_LIVE_EFFICIENCY = 20.0


def _last_values(signals: DataFrame, group: list, ts: str) -> DataFrame:
    """Latest value of each signal per group, one column per signal.

    Equal timestamps are settled by the larger value, so a retried task gives
    the same row.  In a batch the latest row per signal is found first, with a
    partial aggregate, and then laid out in columns; a stream may aggregate
    only once and does both in one step.
    """
    newest = F.max(F.struct(ts, "value"))
    if signals.isStreaming:
        return signals.groupBy(*group).agg(
            *[
                F.max(F.when(F.col("signal") == s, F.struct(ts, "value")))["value"].alias(s)
                for s in SIGNAL_NAMES
            ]
        )
    named = [g if isinstance(g, str) else "window" for g in group]
    return (
        signals.groupBy(*group, "signal")
        .agg(newest.alias("newest"))
        .groupBy(*named)
        .agg(
            *[F.max(F.when(F.col("signal") == s, F.col("newest.value"))).alias(s) for s in SIGNAL_NAMES]
        )
    )


def assemble(
    signals: DataFrame, interval: str = "3 seconds", keys=VEHICLE, ts: str = "timestamp"
) -> DataFrame:
    """Sparse samples: the last value of each signal seen in each interval.

    Signals not seen in an interval stay NULL.  Samples without any core
    signal are dropped.  On a stream, set a watermark on ``ts`` first.
    """
    wide = _last_values(signals, [*keys, F.window(ts, interval)], ts)
    return with_core(
        wide.select(
            *keys,
            F.col("window.start").alias("timestamp"),
            *[_sample_column(s) for s in SIGNAL_NAMES],
        )
    )


def _sample_column(signal: str) -> Column:
    if signal == "ac_compressor_on":
        return (F.col(signal) != 0).alias(signal)
    return F.col(signal)


def with_core(samples: DataFrame) -> DataFrame:
    """Keep samples that hold at least one core signal."""
    return samples.filter(F.coalesce(*[F.col(c) for c in CORE_SIGNALS]).isNotNull())


def mph_to_whole_kmh(mph: Column, exact: bool = False) -> Column:
    """Stored speed.  The factors in use lose one km/h on most whole speeds
    because the product is cut off; ``exact=True`` rounds instead."""
    kmh = mph * KM_PER_MILE
    return (F.round(kmh) if exact else kmh).cast("int")


def to_bronze_units(samples: DataFrame, exact: bool = False) -> DataFrame:
    """Samples with ``speed_kmh`` in place of ``speed_mph``."""
    return samples.withColumn("speed_kmh", mph_to_whole_kmh(F.col("speed_mph"), exact)).drop(
        "speed_mph"
    )


def to_store(samples: DataFrame) -> DataFrame:
    """Store form: distance in km, not yet synced."""
    return samples.withColumn("distance_km", F.col("distance_mi") * KM_PER_MILE).drop(
        "distance_mi"
    ).withColumn("synced", F.lit(False))


def from_store(stored: DataFrame) -> DataFrame:
    """Store form back to miles."""
    return stored.withColumn("distance_mi", F.col("distance_km") * MILES_PER_KM).drop("distance_km")


def fill_defaults(samples: DataFrame) -> DataFrame:
    """Missing id, time and flag get a new id, the current time and false."""
    return samples.withColumns(
        {
            "id": F.coalesce("id", F.expr("uuid()")),
            "timestamp": F.coalesce("timestamp", F.current_timestamp()),
            "synced": F.coalesce("synced", F.lit(False)),
        }
    )


# --- live state ------------------------------------------------------------


def latest_state(signals: DataFrame, keys=VEHICLE, ts: str = "timestamp") -> DataFrame:
    """Last known value of every signal, one row per vehicle."""
    return _last_values(signals, list(keys), ts)


def live_power_kw() -> Column:
    return power_kw(F.col("current_amps"), F.col("voltage_volts"))


def live_efficiency(speed_mph: Column, power: Column) -> Column:
    """mi/kWh; -1 if negative or above the limit; NULL for 0/0."""
    value = speed_mph / F.nullif(power, F.lit(0.0))
    outside = (value < 0) | (value > MAX_LIVE_EFFICIENCY)
    return (
        F.when((power == 0) & (speed_mph != 0), F.lit(-1.0))
        .when(outside, F.lit(-1.0))
        .otherwise(F.abs(value))
    )


def live_drivetrain_kw() -> Column:
    return live_power_kw() - watts_to_kw(F.col("hvac_measured_power_w"))


def live_temp_spread() -> Column:
    return F.col("battery_max_temp_c") - F.col("battery_min_temp_c")


def live_view(state: DataFrame) -> DataFrame:
    """Latest state plus the measures a live screen shows."""
    return state.withColumns(
        {
            "power_kw": live_power_kw(),
            "drivetrain_power_kw": live_drivetrain_kw(),
            "battery_temp_spread_c": live_temp_spread(),
        }
    ).withColumn("efficiency", live_efficiency(F.col("speed_mph"), F.col("power_kw")))


# --- distance since the first reading or the last reset --------------------


def relative_distance(
    readings: DataFrame,
    resets: DataFrame | None = None,
    keys=VEHICLE,
    ts: str = "timestamp",
    distance: str = "distance_mi",
    cell: int = 3600,
) -> DataFrame:
    """Readings with ``relative_distance``.

    Without ``resets`` the zero point is the first reading.  A row of
    ``resets(keys, reset_at)`` moves it to the last reading at or before
    ``reset_at`` (0 if there is none), for all later readings.

    The first reading is a plain aggregate.  Resets are carried forward in two
    passes: in order within time cells of ``cell`` seconds, then across the
    much smaller table of cells.
    """
    known = readings.filter(F.col(distance).isNotNull())
    # At equal times the smaller reading counts as the earlier one.
    first = known.groupBy(*keys).agg(F.min(F.struct(ts, distance))[distance].alias("_zero"))
    if resets is None:
        if not keys:
            based = known.crossJoin(F.broadcast(first))
        else:
            based = join_keyed(known, first, list(keys))
        return based.withColumn(
            "relative_distance", F.col(distance) - F.col("_zero")
        ).drop("_zero")

    # One stream of readings and resets; at equal times the reading comes first.
    at = F.col(ts)
    events = known.select(*known.columns, F.lit(0).alias("_kind")).unionByName(
        resets.select(*keys, F.col("reset_at").alias(ts), F.lit(1).alias("_kind")),
        allowMissingColumns=True,
    )
    second = F.unix_timestamp(at)
    events = events.withColumn("_cell", second - F.pmod(second, F.lit(cell).cast("long")))
    ordered = carry_last(events, {"_seen": F.col(distance)}, keys, [ts, "_kind", distance])
    zeroed = ordered.withColumn(
        "_reset_zero", F.when(F.col("_kind") == 1, F.coalesce("_seen", F.lit(0.0)))
    )
    carried = carry_last(zeroed, {"_from_reset": F.col("_reset_zero")}, keys, [ts, "_kind", distance])
    rows = carried.filter("_kind = 0")
    based = join_keyed(rows, first, list(keys)) if keys else rows.crossJoin(F.broadcast(first))
    zero = F.coalesce("_from_reset", "_zero")
    return based.select(*known.columns, (F.col(distance) - zero).alias("relative_distance"))


def carry_last(df: DataFrame, values: dict[str, Column], keys, order: list[str]) -> DataFrame:
    """Last non-NULL value so far, in ``order``, per key; ``df`` has ``_cell``."""
    cell = [*keys, "_cell"]
    inside = Window.partitionBy(*cell).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    across = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*cell).agg(
        *[
            F.max(F.when(v.isNotNull(), F.struct(*order, v.alias("_value"))))["_value"].alias(f"{n}_end")
            for n, v in values.items()
        ]
    )
    before = ends.select(
        *cell,
        *[F.last(f"{n}_end", ignorenulls=True).over(across).alias(f"{n}_before") for n in values],
    )
    local = df.withColumns({n: F.last(v, ignorenulls=True).over(inside) for n, v in values.items()})
    joined = join_keyed(local, before, cell)
    return joined.withColumns(
        {n: F.coalesce(n, f"{n}_before") for n in values}
    ).drop(*[f"{n}_before" for n in values])
