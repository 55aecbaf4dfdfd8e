"""Stored layers that follow what arrives, without a full rebuild.

Below a root lie silver, slots, sessions and gold state, each stored by date.
After rows have arrived in bronze, ``refresh`` replaces

* silver and slots of the dates that the arrived rows belong to,
* those sessions that can have changed, see ``splice``,
* the gold state of dates whose rows or sessions changed,

and no other file.  Where dates are many and small, a span of days shares a
folder in every layer, and is made anew as a whole.  The result equals a build
from scratch.  Sessions are
stored under their stable key, vehicle and start; their running number is
given on reading.
"""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltrail import VEHICLE
from voltrail.operators import gold_state, telemetry
from voltrail.operators.charging import CHARGE_COLUMNS, charge_spec, charges_of, charging
from voltrail.operators.sessions import GAP_SECONDS, Measure, SessionSpec, merge_slots, slot_facts
from voltrail.operators.trips import TRIP_COLUMNS, moving, trip_ratios, trip_spec, trips_of
from voltrail.plans.pipeline import day_width
from voltrail.session import checkpointed
from voltrail.sources.tables import (
    Layout,
    layout_of,
    replace_partitions,
    store_by,
    stored_beside,
    stored_by,
    stored_in,
    values_of,
)

SLOT_DAY, START_DAY = "slot_date", "start_date"
DAY_SECONDS = 86_400
#: Gold tables brought up to date at the same time.
SIDE_BY_SIDE = 4


@dataclass(frozen=True)
class Kind:
    """Trips or charging sessions."""

    name: str
    rows: Callable[[DataFrame], DataFrame]
    spec: Callable[[], SessionSpec]
    named: Callable[..., DataFrame]
    columns: tuple[str, ...]  # the number and the start first


KINDS = (
    Kind("trips", moving, trip_spec, trips_of, TRIP_COLUMNS),
    Kind("charges", charging, charge_spec, charges_of, CHARGE_COLUMNS),
)


def _spec(kind: Kind) -> SessionSpec:
    """What a session measures, and where the one before it ended."""
    known = kind.spec()
    before = Measure("prev_end", (), F.min_by("prev_last_ts", "first_ts"))
    return replace(known, measures=(*known.measures, before))


@dataclass(frozen=True)
class Lake:
    """The stored layers below ``root``."""

    spark: SparkSession
    root: str
    gap: int = GAP_SECONDS
    carry_gap: bool = True

    def __post_init__(self):
        if self.gap <= 0 or DAY_SECONDS % self.gap:
            raise ValueError("slots must not cross midnight: the gap has to divide a day")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    @property
    def silver(self) -> DataFrame:
        return stored_by(self.spark, self.path("silver"))

    def layout(self, by: str) -> Layout:
        """Folders by ``by``: spans as long as those of silver, in every layer."""
        return Layout(by, layout_of(self.spark, self.path("silver"), "date").width)

    def sessions(self, kind: Kind) -> DataFrame:
        """Sessions with their number; the window holds one row per session."""
        stored = stored_by(self.spark, self.path(kind.name))
        number, start, *rest = kind.columns
        order = Window.partitionBy(*VEHICLE).orderBy(start)
        numbered = stored.withColumn(number, F.row_number().over(order).cast("long"))
        return numbered.select(*VEHICLE, number, start, *rest)

    @property
    def trips(self) -> DataFrame:
        return trip_ratios(self.sessions(KINDS[0]))

    @property
    def charges(self) -> DataFrame:
        return self.sessions(KINDS[1])

    def gold(self, name: str, keys=()) -> DataFrame:
        """A gold table, merged from its state."""
        return gold_state.table(name, lambda n: stored_by(self.spark, self.path(f"gold/{n}")), keys)

    # --- parts of a build and a refresh

    def slots_of(self, kind: Kind, silver: DataFrame) -> DataFrame:
        facts = slot_facts(kind.rows(silver), _spec(kind), gap=self.gap)
        return facts.withColumn(SLOT_DAY, F.to_date(F.timestamp_seconds("_slot")))

    def sessions_of(self, kind: Kind, slots: DataFrame, before: str | None = None) -> DataFrame:
        """Sessions under their stable key; ``before`` names a column with the
        end of the session before a vehicle's first slot."""
        merged = merge_slots(slots, _spec(kind), gap=self.gap, carry_gap=self.carry_gap, before=before)
        number, start, *_ = kind.columns
        named = kind.named(merged, VEHICLE, ("prev_end",)).drop(number)
        return named.withColumn(START_DAY, F.to_date(start))

    def state_rows(self, source: str, days: list) -> DataFrame:
        """The rows that make the gold state of some days: those days and what
        shares their folders."""
        by = "date" if source == "silver" else START_DAY
        rows = stored_beside(self.spark, self.path(source), by, days)
        return trip_ratios(rows) if source == "trips" else rows


def build(bronze: DataFrame, root: str, gap: int = GAP_SECONDS, carry_gap: bool = True) -> Lake:
    """All layers from scratch."""
    lake = Lake(bronze.sparkSession, root, gap, carry_gap)
    width = day_width(bronze)
    store_by(telemetry.silver(bronze), lake.path("silver"), "date", width)
    for kind in KINDS:
        slots = store_by(lake.slots_of(kind, lake.silver), lake.path(f"{kind.name}-slots"), SLOT_DAY, width)
        store_by(lake.sessions_of(kind, slots), lake.path(kind.name), START_DAY, width)
    sources = {"silver": lake.silver, "trips": lake.trips, "charges": lake.charges}

    def store(name: str, rollup: gold_state.Rollup) -> None:
        store_by(rollup.state(sources[rollup.rows]), lake.path(f"gold/{name}"), gold_state.DAY, width)

    _side_by_side(store, gold_state.rollups())
    return lake


def _side_by_side(job: Callable[[str, gold_state.Rollup], None], rollups: dict[str, gold_state.Rollup]) -> None:
    """Small jobs that do not depend on each other share the cluster."""
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        for done in [pool.submit(job, name, rollup) for name, rollup in rollups.items()]:
            done.result()


def refresh(lake: Lake, bronze: DataFrame, arrived: DataFrame) -> dict[str, list]:
    """Bring the layers up to date with rows that have ``arrived`` in ``bronze``.

    Returns the dates with changes per layer.  Run it again after a failure: every
    step leads to the same tables.
    """
    known = telemetry.of_known_vehicle(telemetry.timed(arrived))
    touched = checkpointed(known.select(*VEHICLE, F.to_date("timestamp").alias("date")).distinct())
    days = values_of(touched, "date")  # bounded by the days a batch covers
    if not days:
        return {}
    done = {"silver": days}
    rows = telemetry.silver(bronze.filter(lake.layout("date").holds(F.to_date("timestamp"), days)))
    replace_partitions(rows.select(*lake.silver.columns), lake.path("silver"), "date", days)
    for kind in KINDS:
        slots = lake.slots_of(kind, stored_beside(lake.spark, lake.path("silver"), "date", days))
        replace_partitions(slots, lake.path(f"{kind.name}-slots"), SLOT_DAY, days)
        done[kind.name] = splice(lake, kind, touched)

    def replace_state(name: str, rollup: gold_state.Rollup) -> None:
        changed = done[rollup.rows]
        state = rollup.state(lake.state_rows(rollup.rows, changed))
        replace_partitions(state, lake.path(f"gold/{name}"), gold_state.DAY, changed)

    _side_by_side(replace_state, gold_state.rollups())
    return done


def splice(lake: Lake, kind: Kind, touched: DataFrame) -> list:
    """Replace the sessions that rows of ``touched`` (vehicle, date) can have
    changed; returns the start dates rewritten.

    Per vehicle these are the sessions that start on the dates touched, the one
    before, which may go on into them, and the one after, which may be joined
    or take its idle time from another one now.  They are found by their
    bounds, a few narrow columns of the sessions of touched vehicles, and made
    anew of the slots of their own dates; the first takes the end of the
    session before it from the stored table.  Dates on which no session differs
    are not written.
    """
    spark, path = lake.spark, lake.path(kind.name)
    number, start, *_ = kind.columns
    end = kind.columns[2]
    table = stored_by(spark, path)
    days = touched.groupBy(*VEHICLE).agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    lo, hi = F.col("first_day").cast("timestamp"), F.date_add("last_day", 1).cast("timestamp")
    near = days.join(table.select(*VEHICLE, start, end, "prev_end"), list(VEHICLE), "left")
    s, e = F.col(start), F.col(end)
    region = checkpointed(
        near.groupBy(*VEHICLE, "first_day", "last_day").agg(
            F.max(F.when(s < lo, s)).alias("before_start"),
            F.max_by(F.when(s < lo, e), F.when(s < lo, s)).alias("before_end"),
            F.max_by(F.when(s < lo, F.col("prev_end")), F.when(s < lo, s)).alias("before"),
            F.max(F.when(s < hi, e)).alias("reach"),
            F.min(F.when(s >= hi, s)).alias("after_start"),
            F.min_by(F.when(s >= hi, e), F.when(s >= hi, s)).alias("after_end"),
        )
        .withColumns(
            {
                "from_ts": F.coalesce("before_start", lo),
                "to_ts": F.coalesce("after_end", F.greatest("reach", hi)),
            }
        )
    )
    layout = lake.layout(START_DAY)

    def span(first: Column, last: Column) -> Column:
        return F.sequence(layout.folder(first), layout.folder(last))

    spans = F.array(
        span(F.col("first_day"), F.greatest("last_day", F.to_date("reach"))),
        F.when(F.col("before_start").isNotNull(), span(F.to_date("before_start"), F.to_date("before_end"))),
        F.when(F.col("after_start").isNotNull(), span(F.to_date("after_start"), F.to_date("after_end"))),
    )
    read = values_of(region.select(F.explode(F.flatten(F.array_compact(spans))).alias("folder")), "folder")

    def inside(rows: DataFrame, at: str) -> DataFrame:
        bounds = region.select(*VEHICLE, "from_ts", "to_ts", "before")
        return rows.join(bounds, list(VEHICLE)).filter(F.col(at).between(F.col("from_ts"), F.col("to_ts"))).drop("from_ts", "to_ts")

    slots = stored_in(spark, lake.path(f"{kind.name}-slots"), SLOT_DAY, read)
    new = checkpointed(lake.sessions_of(kind, inside(slots, "first_ts"), "before").select(*table.columns))
    old = checkpointed(inside(stored_in(spark, path, START_DAY, read), start).select(*table.columns))
    changed = values_of(new.exceptAll(old).unionByName(old.exceptAll(new)), START_DAY)
    if changed:
        rows = stored_beside(spark, path, START_DAY, changed)
        gone = old.select(*VEHICLE, start)
        kept = rows.join(gone, [*VEHICLE, start], "left_anti").select(*table.columns)
        made = new.filter(layout.holds(F.col(START_DAY), changed))
        replace_partitions(kept.unionByName(made), path, START_DAY, changed)
    return changed
