"""Trips: runs of moving rows, with distance, energy and efficiency."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail import VEHICLE
from voltrail.operators.sessions import (
    GAP_SECONDS,
    Energy,
    SessionSpec,
    closing,
    highest,
    mean,
    merge_slots,
    opening,
    slot_facts,
    spread,
)

# Fixed value: shortest trip that counts in efficiency and in the gold tables.
MIN_TRIP_MILES = 0.1

TRIP_COLUMNS = (
    "trip_id", "trip_start", "trip_end", "duration_minutes", "sample_count",
    "distance_miles", "energy_consumed_kwh", "energy_regen_kwh", "hvac_energy_kwh",
    "avg_speed_mph", "max_speed_mph", "soc_start", "soc_end",
    "avg_ambient_temp_f", "avg_battery_temp_c",
)


def trip_spec() -> SessionSpec:
    """What a trip measures."""
    kw, hvac = F.col("power_kw"), F.col("hvac_power_kw")
    return SessionSpec(
        measures=(
            spread("distance_miles", "distance_mi", 2),
            mean("avg_speed_mph", F.col("speed_mph"), 1, places=1),
            highest("max_speed_mph", F.col("speed_mph")),
            opening("soc_start", "soc_hd"),
            closing("soc_end", "soc_hd"),
            mean("avg_ambient_temp_f", F.col("ambient_temp_f"), 1),
            mean("avg_battery_temp_c", F.col("battery_avg_temp_c"), 1),
        ),
        energies=(
            Energy("energy_consumed_kwh", ("power_kw",), F.when(kw > 0, kw).otherwise(0.0), True),
            Energy("energy_regen_kwh", ("power_kw",), F.when(kw < 0, -kw).otherwise(0.0), True),
            Energy("hvac_energy_kwh", ("hvac_power_kw",), F.coalesce(hvac, F.lit(0.0))),
        ),
    )


def moving(silver: DataFrame) -> DataFrame:
    return silver.filter("is_moving")


def trip_slots(silver: DataFrame, keys=VEHICLE, gap=GAP_SECONDS) -> DataFrame:
    """Slot facts of the moving rows."""
    return slot_facts(moving(silver), trip_spec(), keys, gap=gap)


def trips_from_slots(
    slots: DataFrame, keys=VEHICLE, gap=GAP_SECONDS, carry_gap: bool = True
) -> DataFrame:
    return trips_of(merge_slots(slots, trip_spec(), keys, gap, carry_gap), keys)


def trips_of(sessions: DataFrame, keys=VEHICLE, more: tuple[str, ...] = ()) -> DataFrame:
    """Sessions of moving rows under the names of trips."""
    return sessions.withColumnsRenamed(
        {"session_id": "trip_id", "session_start": "trip_start", "session_end": "trip_end"}
    ).select(*keys, *TRIP_COLUMNS, *more)


def trips(
    silver: DataFrame, keys=VEHICLE, gap: int = GAP_SECONDS, carry_gap: bool = True
) -> DataFrame:
    """One row per trip.  ``carry_gap=True`` charges the idle time before a
    trip to it, at the power of its first row; ``False`` leaves it out."""
    return trips_from_slots(trip_slots(silver, keys, gap), keys, gap, carry_gap)


def trip_ratios(trips: DataFrame) -> DataFrame:
    """Add efficiency, net energy and charge used."""
    counted = (F.col("energy_consumed_kwh") > 0) & (F.col("distance_miles") > MIN_TRIP_MILES)
    return trips.withColumns(
        {
            "efficiency_mi_per_kwh": F.when(
                counted, F.round(F.col("distance_miles") / F.col("energy_consumed_kwh"), 2)
            ),
            "net_energy_kwh": F.round(
                F.col("energy_consumed_kwh") - F.col("energy_regen_kwh"), 3
            ),
            "soc_used": F.round(F.col("soc_start") - F.col("soc_end"), 2),
        }
    )
