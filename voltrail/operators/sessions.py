"""Time-gap sessions and energy integration.

A session is a run of rows of one key in which neighbours are at most ``gap``
whole seconds apart.  Rows are first reduced to *slots*: time cells, ``gap``
seconds wide.  Two rows in one slot are always closer than the gap, so a slot
never spans a session boundary and only slots have to be put in order.

Everything that needs order therefore runs on bounded groups:

* the per-key window runs over slots, one row per key and ``gap`` seconds of
  driving, however many samples a key holds;
* the per-slot window runs over whole seconds, at most ``gap`` of them.

Row-level data is only ever aggregated, with a partial aggregate before each
shuffle, so a key, slot or second that holds a large share of all rows costs
the same as any other.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrail import VEHICLE
from voltrail.functions.measures import join_keyed, ticks

GAP_SECONDS = 300
LEAST_UNKEYED_GAP = 60
SECONDS_PER_HOUR = 3600.0

#: Decimal places kept when averaging raw (unrounded) measures.
RAW_PLACES = 9


# --- what a session table can hold -----------------------------------------


@dataclass(frozen=True)
class Part:
    """A partial aggregate: over rows, and over earlier results of itself.

    ``kind`` says how two results merge: min, max, sum, first or last.
    """

    name: str
    kind: str
    rows: Column
    again: Column


def _least(name: str, value) -> Part:
    return Part(name, "min", F.min(value), F.min(name))


def _most(name: str, value) -> Part:
    return Part(name, "max", F.max(value), F.max(name))


def _sum(name: str, value) -> Part:
    return Part(name, "sum", F.sum(value), F.sum(name))


def _count(name: str, value) -> Part:
    return Part(name, "sum", F.count(value), F.sum(name))


def _first(name: str, value, ts: str) -> Part:
    return Part(name, "first", F.min_by(value, ts), F.min_by(name, "first_ts"))


def _last(name: str, value, ts: str) -> Part:
    return Part(name, "last", F.max_by(value, ts), F.max_by(name, "last_ts"))


@dataclass(frozen=True)
class Measure:
    """An output column: what to keep per slot and how slots merge.

    Slot rows also carry ``first_ts`` and ``last_ts`` to order first and last
    values by.
    """

    name: str
    parts: tuple[Part, ...]
    merge: Column


def spread(name: str, col: str, digits: int) -> Measure:
    """Highest minus lowest value."""
    lo, hi = _least(f"{name}__lo", col), _most(f"{name}__hi", col)
    return Measure(name, (lo, hi), F.round(hi.again - lo.again, digits))


def lowest(name: str, col: str) -> Measure:
    part = _least(name, col)
    return Measure(name, (part,), part.again)


def highest(name: str, value: Column, digits: int | None = None) -> Measure:
    part = _most(name, value)
    return Measure(name, (part,), part.again if digits is None else F.round(part.again, digits))


def opening(name: str, col: str, ts: str = "timestamp") -> Measure:
    """Value at the first instant, NULL if it is NULL there."""
    part = _first(name, col, ts)
    return Measure(name, (part,), part.again)


def closing(name: str, col: str, ts: str = "timestamp") -> Measure:
    """Value at the last instant, NULL if it is NULL there."""
    part = _last(name, col, ts)
    return Measure(name, (part,), part.again)


def mean(name: str, value: Column, digits: int, places: int = RAW_PLACES) -> Measure:
    total = _sum(f"{name}__sum", ticks(value, places))
    n = _count(f"{name}__n", ticks(value, places))
    avg = total.again.cast("double") / F.nullif(n.again, F.lit(0)) / 10.0**places
    return Measure(name, (total, n), F.round(avg, digits))


@dataclass(frozen=True)
class Energy:
    """Power integrated over the interval that ends at each row, in kWh.

    ``rate`` is the power in kW, over the columns in ``inputs``.  With
    ``idle_is_zero`` a row that draws no power counts 0 even where its
    interval is unknown.
    """

    name: str
    inputs: tuple[str, ...]
    rate: Column
    idle_is_zero: bool = False
    places: int = 3

    @property
    def ticks(self) -> Column:
        return ticks(self.rate, self.places)


@dataclass(frozen=True)
class SessionSpec:
    measures: tuple[Measure, ...]
    energies: tuple[Energy, ...] = ()
    digits: int = 3
    inputs: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        names = dict.fromkeys(c for e in self.energies for c in e.inputs)
        object.__setattr__(self, "inputs", tuple(names))

    def parts(self, ts: str) -> list[Part]:
        """Everything a slot keeps, except its inner energy."""
        return [
            _least("first_ts", ts),
            _most("last_ts", ts),
            _count("rows", F.lit(1)),
            *[p for m in self.measures for p in m.parts],
            *[_first(c, c, ts) for c in self.inputs],
            *[_count(f"{e.name}__rated", e.rate) for e in self.energies],
        ]


# --- slots -----------------------------------------------------------------


def _whole_second(ts: str) -> Column:
    return F.unix_timestamp(F.col(ts))


def slot_start(second: Column, gap: int) -> Column:
    """First second of the slot; also right before 1970."""
    return second - F.pmod(second, F.lit(max(gap, 1)).cast("long"))


def with_slot(df: DataFrame, ts: str, gap: int) -> DataFrame:
    if gap < 0:
        raise ValueError("gap must not be negative")
    second = _whole_second(ts)
    return df.withColumn("_slot", slot_start(second, gap)).withColumn("_second", second)


def slot_facts(df: DataFrame, spec: SessionSpec, keys=VEHICLE, ts="timestamp", gap=GAP_SECONDS):
    """One row per key and slot: time bounds, partial measures, inner energy."""
    base = with_slot(df, ts, gap)
    cell = [*keys, "_slot"]
    parts = spec.parts(ts)
    if not spec.energies:
        return base.groupBy(*cell).agg(*[p.rows.alias(p.name) for p in parts])
    # One pass: rows to whole seconds, seconds to slots.  Intervals are counted
    # in whole seconds, so only the first row of a second has a non-zero one;
    # the ordered window is bounded by the slot width, and a hot second is
    # combined before the shuffle.
    seconds = base.groupBy(*cell, "_second").agg(*[p.rows.alias(p.name) for p in parts])
    order = Window.partitionBy(*cell).orderBy("_second")
    step = F.col("_second") - F.lag("_second").over(order)
    return (
        seconds.withColumn("_step", step)
        .groupBy(*cell)
        .agg(
            *[p.again.alias(p.name) for p in parts],
            *[_watts(e.ticks, F.col("_step")).alias(f"{e.name}__inner") for e in spec.energies],
        )
    )


def _watts(power: Column, seconds: Column) -> Column:
    return F.sum((power * seconds).cast("decimal(38,0)"))


def number_slots(slots: DataFrame, keys=VEHICLE, gap=GAP_SECONDS, before: str | None = None) -> DataFrame:
    """Add each slot's neighbours and its session number, from 1 per key.

    ``before`` names a column with the last instant ahead of a key's slots,
    where they are not all the key has.

    Without keys all slots are put in order together, which the calendar
    bounds as long as slots are not too short.
    """
    if not keys and gap < LEAST_UNKEYED_GAP:
        raise ValueError(f"without keys the gap must be {LEAST_UNKEYED_GAP} seconds or more")
    order = Window.partitionBy(*keys).orderBy("_slot")
    first, prev = _whole_second("first_ts"), _whole_second("prev_last_ts")
    lag = F.lag("last_ts").over(order)
    return (
        slots.withColumn("prev_last_ts", lag if before is None else F.coalesce(lag, F.col(before)))
        .withColumn("next_first_ts", F.lead("first_ts").over(order))
        .withColumn("starts", F.col("prev_last_ts").isNull() | (first - prev > gap))
        .withColumn(
            "session_id",
            F.sum(F.col("starts").cast("long")).over(
                order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
    )


def merge_slots(
    slots: DataFrame,
    spec: SessionSpec,
    keys=VEHICLE,
    gap=GAP_SECONDS,
    carry_gap: bool = False,
    before: str | None = None,
) -> DataFrame:
    """Sessions from slot facts, whether they come from a batch or a stream.

    ``carry_gap=True`` also integrates the idle interval in front of a
    session, at the power of the session's first row.
    """
    numbered = number_slots(slots, keys, gap, before)
    idle = _whole_second("first_ts") - _whole_second("prev_last_ts")
    lead_in = idle if carry_gap else F.when(F.col("starts"), F.lit(0)).otherwise(idle)
    steps = numbered.withColumn("_lead_in", lead_in)
    for e in spec.energies:
        # The inputs of a slot fact are those of the slot's first row.
        steps = steps.withColumn(f"{e.name}__lead", (e.ticks * F.col("_lead_in")).cast("decimal(38,0)")).withColumn(
            f"{e.name}__known",
            F.col(f"{e.name}__rated") - (F.col("_lead_in").isNull() & draws_power(e)).cast("long"),
        )
    return finish_sessions(steps, spec, keys)


def draws_power(e: Energy) -> Column:
    """True where a row's interval has to be known for its energy to be."""
    drawn = e.rate.isNotNull()
    return drawn & (e.rate != 0) if e.idle_is_zero else drawn


def finish_sessions(steps: DataFrame, spec: SessionSpec, keys=VEHICLE) -> DataFrame:
    """Sessions from facts that know their session, lead-in energy and number
    of known intervals: one row per slot, or one for all of a session."""
    start, end = F.min("first_ts"), F.max("last_ts")
    return steps.groupBy(*keys, "session_id").agg(
        start.alias("session_start"),
        end.alias("session_end"),
        F.round((F.unix_timestamp(end) - F.unix_timestamp(start)) / 60.0, 1).alias(
            "duration_minutes"
        ),
        F.sum("rows").alias("sample_count"),
        *[m.merge.alias(m.name) for m in spec.measures],
        *[_total(e, spec.digits).alias(e.name) for e in spec.energies],
    )


def _total(e: Energy, digits: int) -> Column:
    """NULL if no row of the session has both a power and an interval."""
    inner = F.coalesce(F.sum(f"{e.name}__inner").cast("double"), F.lit(0.0))
    lead = F.coalesce(F.sum(f"{e.name}__lead").cast("double"), F.lit(0.0))
    kwh = (inner + lead) / (SECONDS_PER_HOUR * 10.0**e.places)
    return F.when(F.sum(f"{e.name}__known") > 0, F.round(kwh, digits))


# --- row-level forms -------------------------------------------------------


def neighbours(df: DataFrame, keys=VEHICLE, ts="timestamp", gap=GAP_SECONDS) -> DataFrame:
    """Every row with ``prev_ts``, ``next_ts``, ``is_start`` and ``session_id``.

    Rows are reduced to instants before anything is put in order: a window over
    the instants of a slot, then one over the slots.  Rows of one instant are
    neighbours of each other, in any order, so only they share a task.
    """
    cell = [*keys, "_slot"]
    rows = with_slot(df, ts, gap)
    slots = number_slots(
        rows.groupBy(*cell).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")),
        keys,
        gap,
    ).select(*cell, "prev_last_ts", "next_first_ts", "session_id")
    order = Window.partitionBy(*cell).orderBy(ts)
    instants = (
        rows.groupBy(*cell, ts)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_prev", F.lag(ts).over(order))
        .withColumn("_next", F.lead(ts).over(order))
    )
    same = Window.partitionBy(*cell, ts).orderBy(F.lit(0))
    placed = join_keyed(rows.withColumn("_copy", F.row_number().over(same)), instants, [*cell, ts])
    joined = join_keyed(
        placed.withColumn("_prev", F.when(F.col("_copy") > 1, F.col(ts)).otherwise(F.col("_prev"))).withColumn(
            "_next", F.when(F.col("_copy") < F.col("_copies"), F.col(ts)).otherwise(F.col("_next"))
        ),
        slots,
        cell,
    )
    prev = F.coalesce("_prev", "prev_last_ts")
    late = F.col("_second") - F.unix_timestamp(prev) > gap
    return joined.select(
        *df.columns,
        prev.alias("prev_ts"),
        F.coalesce("_next", "next_first_ts").alias("next_ts"),
        (prev.isNull() | late).cast("int").alias("is_start"),
        "session_id",
    )


def sessionize(df: DataFrame, keys=VEHICLE, ts="timestamp", gap=GAP_SECONDS) -> DataFrame:
    """Every row with its ``session_id``: slot facts joined back, no row-level order."""
    cell = [*keys, "_slot"]
    rows = with_slot(df, ts, gap)
    slots = number_slots(
        rows.groupBy(*cell).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")),
        keys,
        gap,
    ).select(*cell, "session_id")
    return join_keyed(rows, slots, cell).select(*df.columns, "session_id")


def integrate(
    df: DataFrame,
    rate: str,
    keys=VEHICLE,
    ts="timestamp",
    gap=GAP_SECONDS,
    carry_gap: bool = False,
) -> DataFrame:
    """Energy in kWh of one power column (kW, 3 decimals) per session."""
    spec = SessionSpec((), (Energy("energy_kwh", (rate,), F.col(rate)),))
    return merge_slots(slot_facts(df, spec, keys, ts, gap), spec, keys, gap, carry_gap)
