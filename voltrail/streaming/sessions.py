"""Trips and charging sessions from a stream.

Three stateful steps follow each other.  Rows become whole seconds, seconds
become slots - two tumbling windows, with state bounded by time, one row per
second of an open slot, however many rows arrive - and slots become sessions:
one small state per vehicle holds its open session, how many it had and where
the last one ended.  A session comes out once, as soon as the watermark says
that no row can join it any more, numbered as the batch form numbers it, and
its facts leave the state; the vehicle keeps its count and its last second.

Slots come out of their window in the order of time, so a session is only ever
appended to.  Python sees one row per vehicle and slot.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from voltrail import VEHICLE
from voltrail.operators.charging import charge_spec, charges_of, charging
from voltrail.operators.sessions import GAP_SECONDS, Energy, Part, SessionSpec, draws_power, finish_sessions
from voltrail.operators.trips import moving, trip_spec, trips_of
from voltrail.sources.batches import BatchLog
from voltrail.streaming.ingest import AVAILABLE_NOW


def stream_slots(
    df: DataFrame,
    spec: SessionSpec,
    delay: str | None,
    keys=VEHICLE,
    ts: str = "timestamp",
    gap: int = GAP_SECONDS,
) -> DataFrame:
    """Slot facts of a stream, each emitted once its slot can no longer change.

    Rows later than ``delay`` are dropped by the watermark; None leaves the
    watermark that the stream already has.
    """
    return _windowed_slots(df, spec, delay, keys, ts, gap).drop("_window")


def _windowed_slots(df: DataFrame, spec: SessionSpec, delay: str | None, keys, ts: str, gap: int) -> DataFrame:
    """Slot facts with their window, which carries the watermark on."""
    parts = spec.parts(ts)
    seconds = (
        (df if delay is None else df.withWatermark(ts, delay))
        .groupBy(*keys, F.window(ts, "1 second").alias("_second"))
        .agg(*[p.rows.alias(p.name) for p in parts])
    )
    slots = seconds.groupBy(
        *keys, F.window("_second", f"{max(gap, 1)} seconds").alias("_window")
    ).agg(
        *[p.again.alias(p.name) for p in parts],
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.unix_timestamp("first_ts").alias("at"),
                    *[e.ticks.alias(e.name) for e in spec.energies],
                )
            )
        ).alias("_steps"),
    )
    return slots.select(
        *keys,
        "_window",
        F.unix_timestamp("_window.start").alias("_slot"),
        *[p.name for p in parts],
        *[_inner(e).alias(f"{e.name}__inner") for e in spec.energies],
    )


def _inner(e: Energy) -> Column:
    """Energy inside a slot: a fold over its seconds, at most one per second."""
    zero = F.struct(F.lit(None).cast("long").alias("at"), F.lit(0).cast("decimal(38,0)").alias("sum"))

    def step(acc: Column, row: Column) -> Column:
        watts = (row[e.name] * (row["at"] - acc["at"])).cast("decimal(38,0)")
        total = acc["sum"] + F.coalesce(watts, F.lit(0).cast("decimal(38,0)"))
        return F.struct(row["at"].alias("at"), total.cast("decimal(38,0)").alias("sum"))

    return F.aggregate("_steps", zero, step)["sum"]


def stream_trip_slots(silver: DataFrame, delay: str | None, keys=VEHICLE, gap=GAP_SECONDS) -> DataFrame:
    return stream_slots(moving(silver), trip_spec(), delay, keys, gap=gap)


def stream_charge_slots(silver: DataFrame, delay: str | None, keys=VEHICLE, gap=GAP_SECONDS) -> DataFrame:
    return stream_slots(charging(silver), charge_spec(), delay, keys, gap=gap)


# --- sessions that close ---------------------------------------------------

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_MERGE: dict[str, Callable] = {
    "min": min,
    "max": max,
    "sum": lambda a, b: a + b,
    "first": lambda a, b: a,
    "last": lambda a, b: b,
}


def merge_value(kind: str, old, new):
    """Two partial results, the later one second; None is no result, except
    that the first and the last value may be unknown."""
    if kind in {"first", "last"}:
        return _MERGE[kind](old, new)
    if old is None or new is None:
        return new if old is None else old
    return _MERGE[kind](old, new)


def _plain(field: T.StructField) -> tuple[Column, str]:
    """A value in a form Python holds exactly: instants as microseconds,
    decimals as text."""
    col = F.col(field.name)
    if isinstance(field.dataType, T.TimestampType):
        return F.unix_micros(col).alias(field.name), "long"
    if isinstance(field.dataType, T.DecimalType):
        return col.cast("string").alias(field.name), "string"
    return col, field.dataType.simpleString()


def _typed(field: T.StructField) -> Column:
    col = F.col(field.name)
    if isinstance(field.dataType, T.TimestampType):
        return F.timestamp_micros(col).alias(field.name)
    return col.cast(field.dataType).alias(field.name)


class _Folder:
    """One vehicle's slots, in order, into sessions.

    ``held`` is the state: sessions so far, last second of the newest, whether
    it is open, and its facts: parts, then per energy inner, lead and known.
    """

    def __init__(self, parts: list[Part], kinds: list[str], energies: list[str], gap: int, carry_gap: bool):
        self.parts, self.whole = [(p.name, p.kind) for p in parts], {p.name for p, k in zip(parts, kinds, strict=True) if k == "string"}
        self.energies, self.gap, self.carry_gap, self.width = energies, gap, carry_gap, max(gap, 1)

    def empty(self) -> list:
        return [0, None, False] + [None] * (len(self.parts) + 3 * len(self.energies))

    def closes_at(self, held: list) -> int:
        """Second from which no slot that is still open can join."""
        reach = held[1] + self.gap
        return reach - reach % self.width + self.width

    def add(self, held: list, slot: dict) -> tuple[list, list | None]:
        """The state after a slot, and the session it closes, if any."""
        first, prev, done = slot["first_ts"] // 1_000_000, held[1], None
        idle = None if prev is None else first - prev
        starts = idle is None or idle > self.gap
        lead = idle if self.carry_gap or not starts else 0
        if starts:
            done = held if held[2] else None
            held = [held[0] + 1, None, True] + [None] * (len(held) - 3)
        facts, n = held[3:], len(self.parts)
        for i, (name, kind) in enumerate(self.parts):
            value = slot[name]
            if starts:
                facts[i] = value
            elif name in self.whole and kind == "sum":
                both = [int(v) for v in (facts[i], value) if v is not None]
                facts[i] = str(sum(both)) if both else None
            else:
                facts[i] = merge_value(kind, facts[i], value)
        for j, e in enumerate(self.energies):
            at = n + 3 * j
            ticks, inner = slot[f"{e}__ticks"], slot[f"{e}__inner"]
            facts[at] = str(int(facts[at] or 0) + int(inner or 0))
            if ticks is not None and lead is not None:
                facts[at + 1] = str(int(facts[at + 1] or 0) + int(ticks) * lead)
            unknown = lead is None and slot[f"{e}__draws"]
            facts[at + 2] = (facts[at + 2] or 0) + slot[f"{e}__rated"] - int(unknown)
        return [held[0], slot["last_ts"] // 1_000_000, True, *facts], done

    def close(self, held: list) -> list:
        """The state once its session is out."""
        return [held[0], held[1], False] + [None] * (len(held) - 3)


class _Sessions(StatefulProcessor):
    """``_Folder`` over the slots of a batch, with a timer for the open session."""

    def __init__(self, folder: _Folder, state: str, columns: list[str], exact: set[str]):
        self.folder, self.state, self.columns, self.exact = folder, state, columns, exact

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("sessions", self.state)

    def _due(self, held: list) -> int:
        return self.folder.closes_at(held) * 1000

    def _keep(self, key: tuple, before: list | None, held: list, out: list, now: int) -> pd.DataFrame:
        """Close what can be closed, hold the rest, and say what came out."""
        if held[2] and self._due(held) <= now:
            out.append([*key, held[0], *held[3:]])
            held = self.folder.close(held)
        old = self._due(before) if before and before[2] else None
        new = self._due(held) if held[2] else None
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if new is not None and old != new:
            self.handle.registerTimer(new)
        self.held.update(tuple(held))
        return pd.DataFrame(out, columns=self.columns).astype(object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = list(self.held.get()) if self.held.exists() else None
        held, out = before or self.folder.empty(), []
        found = [{k: None if v is None or v != v else v for k, v in r.items()} for b in rows for r in b.to_dict("records")]
        for slot in sorted(found, key=lambda r: r["first_ts"]):
            slot.update({k: int(slot[k]) for k in self.exact if slot[k] is not None})
            held, done = self.folder.add(held, slot)
            if done:
                out.append([*key, done[0], *done[3:]])
        yield self._keep(key, before, held, out, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            return
        held, now = list(self.held.get()), timerValues.getCurrentWatermarkInMs()
        if held[2] and self._due(held) <= now:
            self.held.update(tuple(self.folder.close(held)))
            yield pd.DataFrame([[*key, held[0], *held[3:]]], columns=self.columns).astype(object)

    def close(self) -> None:
        pass


def stream_sessions(
    df: DataFrame,
    spec: SessionSpec,
    delay: str | None,
    keys=VEHICLE,
    ts: str = "timestamp",
    gap: int = GAP_SECONDS,
    carry_gap: bool = True,
) -> DataFrame:
    """Facts of every session of a stream, emitted once, when it has closed;
    ``finish_sessions`` makes its measures of them."""
    if not keys:
        raise ValueError("a stream of sessions needs a key to hold state by")
    slots = _windowed_slots(df, spec, delay, keys, ts, gap)
    parts = spec.parts(ts)
    fields = [slots.schema[p.name] for p in parts]
    plain = [_plain(f) for f in fields]
    names = [e.name for e in spec.energies]
    rows = slots.select(
        *keys,
        F.window_time("_window").alias("_until"),
        *[c for c, _ in plain],
        *[F.col(f"{n}__inner").cast("decimal(38,0)").cast("string").alias(f"{n}__inner") for n in names],
        *[e.ticks.cast("decimal(38,0)").cast("string").alias(f"{e.name}__ticks") for e in spec.energies],
        *[F.coalesce(draws_power(e), F.lit(False)).alias(f"{e.name}__draws") for e in spec.energies],
    )
    facts = [f"`{f.name}` {t}" for f, (_, t) in zip(fields, plain, strict=True)]
    for n in names:
        facts += [f"`{n}__inner` string", f"`{n}__lead` string", f"`{n}__known` long"]
    state = ", ".join(["sessions long, last_s long, is_open boolean", *facts])
    key_types = [f"`{k}` {slots.schema[k].dataType.simpleString()}" for k in keys]
    columns = [*keys, "session_id", *[f.name for f in fields]]
    columns += [f"{n}__{x}" for n in names for x in ("inner", "lead", "known")]
    folder = _Folder(parts, [t for _, t in plain], names, gap, carry_gap)

    exact = {f.name for f, (_, t) in zip(fields, plain, strict=True) if t in {"long", "bigint", "int"}}
    exact |= {f"{n}__rated" for n in names}
    closed = rows.groupBy(*keys).transformWithStateInPandas(
        _Sessions(folder, state, columns, exact),
        ", ".join([*key_types, "session_id long", *facts]),
        "Append",
        "EventTime",
    )
    sums = [F.col(f"{n}__{x}").cast("decimal(38,0)").alias(f"{n}__{x}") for n in names for x in ("inner", "lead")]
    return closed.select(*keys, "session_id", *map(_typed, fields), *sums, *[f"{n}__known" for n in names])


def _sessions_log(spark: SparkSession, root: str) -> BatchLog:
    return BatchLog(spark, root)


def _write_sessions(
    facts: DataFrame, finish: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, trigger: dict | None
) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        _sessions_log(batch.sparkSession, root).commit(finish(batch), batch_id)

    stream = (
        facts.writeStream.foreachBatch(write)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
    )
    # State with timers needs this store; a stream keeps the settings it starts with.
    conf = facts.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    conf.set(STATE_STORE, ROCKS)
    try:
        return stream.start()
    finally:
        conf.unset(STATE_STORE) if before is None else conf.set(STATE_STORE, before)


def trip_stream(
    silver: DataFrame,
    delay: str | None,
    root: str,
    checkpoint: str,
    keys=VEHICLE,
    gap: int = GAP_SECONDS,
    carry_gap: bool = True,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append every trip to the table below ``root`` once it has closed."""
    facts = stream_sessions(moving(silver), trip_spec(), delay, keys, gap=gap, carry_gap=carry_gap)
    return _write_sessions(facts, lambda b: trips_of(finish_sessions(b, trip_spec(), keys), keys), root, checkpoint, trigger)


def charge_stream(
    silver: DataFrame,
    delay: str | None,
    root: str,
    checkpoint: str,
    keys=VEHICLE,
    gap: int = GAP_SECONDS,
    carry_gap: bool = True,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append every charging session to the table below ``root`` once it has closed."""
    facts = stream_sessions(charging(silver), charge_spec(), delay, keys, gap=gap, carry_gap=carry_gap)
    return _write_sessions(
        facts, lambda b: charges_of(finish_sessions(b, charge_spec(), keys), keys), root, checkpoint, trigger
    )


def closed_sessions(spark: SparkSession, root: str) -> DataFrame:
    """The trips or charging sessions that have closed so far."""
    return _sessions_log(spark, root).read()
