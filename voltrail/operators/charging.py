"""Charging sessions: runs of charging rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail import VEHICLE
from voltrail.operators.sessions import (
    GAP_SECONDS,
    Energy,
    Measure,
    SessionSpec,
    highest,
    lowest,
    mean,
    merge_slots,
    slot_facts,
)

CHARGE_COLUMNS = (
    "session_id", "charge_start", "charge_end", "duration_minutes", "sample_count",
    "soc_start", "soc_end", "soc_gained", "avg_charge_rate_kw", "peak_charge_rate_kw",
    "energy_added_kwh", "avg_battery_temp_c",
)


def charge_spec() -> SessionSpec:
    """What a charging session measures."""
    kw = F.abs("power_kw")
    return SessionSpec(
        measures=(
            lowest("soc_start", "soc_hd"),
            highest("soc_end", F.col("soc_hd")),
            Measure("soc_gained", (), F.round(F.max("soc_end") - F.min("soc_start"), 2)),
            mean("avg_charge_rate_kw", kw, 2, places=3),
            highest("peak_charge_rate_kw", kw, 2),
            mean("avg_battery_temp_c", F.col("battery_avg_temp_c"), 1),
        ),
        energies=(Energy("energy_added_kwh", ("power_kw",), kw),),
    )


def charging(silver: DataFrame) -> DataFrame:
    return silver.filter("is_charging")


def charge_slots(silver: DataFrame, keys=VEHICLE, gap=GAP_SECONDS) -> DataFrame:
    """Slot facts of the charging rows."""
    return slot_facts(charging(silver), charge_spec(), keys, gap=gap)


def charges_from_slots(
    slots: DataFrame, keys=VEHICLE, gap=GAP_SECONDS, carry_gap: bool = True
) -> DataFrame:
    return charges_of(merge_slots(slots, charge_spec(), keys, gap, carry_gap), keys)


def charges_of(sessions: DataFrame, keys=VEHICLE, more: tuple[str, ...] = ()) -> DataFrame:
    """Sessions of charging rows under the names of charging sessions."""
    return sessions.withColumnsRenamed(
        {"session_start": "charge_start", "session_end": "charge_end"}
    ).select(*keys, *CHARGE_COLUMNS, *more)


def charging_sessions(
    silver: DataFrame, keys=VEHICLE, gap: int = GAP_SECONDS, carry_gap: bool = True
) -> DataFrame:
    """One row per charging session; ``carry_gap`` as for trips."""
    return charges_from_slots(charge_slots(silver, keys, gap), keys, gap, carry_gap)
