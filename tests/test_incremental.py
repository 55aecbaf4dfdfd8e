"""Streams that close sessions, committed batches, and tables kept up to date."""

import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_telemetry import T0, bronze, plan
from voltrail import schemas
from voltrail.operators import charging, gold, gold_state, store, telemetry, trips
from voltrail.plans import pipeline, refresh
from voltrail.sources import files, tables
from voltrail.sources.batches import KEEP, BatchLog
from voltrail.streaming import ingest, sync
from voltrail.streaming import sessions as stream_ses


def same(a, b):
    assert a.columns == b.columns
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def files_of(path) -> dict[str, int]:
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("part-*")}


# --- sessions that close in the stream ---------------------------------------


def _days(seed: int, days: int = 3, vehicles: int = 3):
    """Drives and charges of a few vehicles, across midnight too."""
    rng, rows = random.Random(seed), []
    for v in range(vehicles):
        at = rng.randint(0, 3_000)
        while at < days * 86_400:
            charge, length = rng.random() < 0.3, rng.randint(1, 9)
            for _ in range(length):
                rows.append(
                    {
                        "at": at, "vehicle_id": f"v{v}", "speed_kmh": 0 if charge else rng.randint(1, 120),
                        "current_amps": -20.0 if charge else rng.choice([30.0, -5.0, None, 0.0]), "voltage_volts": 380.0,
                        "distance_mi": 10 + at / 90, "soc_hd": rng.choice([None, 50.0, 61.5]),
                        "hvac_measured_power_w": rng.choice([None, 700.0]), "ambient_temp_f": rng.choice([None, 61.3]),
                    }
                )
                at += rng.choice([1, 3, 60, 299, 300, 301])
            at += rng.choice([301, 4_000, 30_000])
    return rows


@pytest.mark.parametrize("carry_gap", [True, False])
def test_stream_closes_sessions_one_by_one(spark, tmp_path, carry_gap):
    root, rows = f"file://{tmp_path}", _days(1)
    silver = telemetry.silver(bronze(spark, rows))
    far = {"at": 40 * 86_400, "vehicle_id": "far", "speed_kmh": 50}
    steps = [[r for r in rows if r["at"] // 86_400 == d] for d in range(3)] + [[far]]
    known = []
    for n, part in enumerate(steps):
        telemetry.silver(bronze(spark, part)).coalesce(1).write.parquet(f"{root}/in/{n}")
        stream = spark.readStream.schema(silver.schema).parquet(f"{root}/in/*")
        args = ("1 hour", f"{root}/trips", f"{root}/ck"), {"carry_gap": carry_gap}
        ingest.drain(stream_ses.trip_stream(stream, *args[0], **args[1]))
        out = {tuple(r) for r in stream_ses.closed_sessions(spark, f"{root}/trips").collect()}
        assert len(known) == 0 or set(known[-1]) <= out  # what came out stays as it is
        known.append(out)
    assert 0 < len(known[0]) < len(known[1]) < len(known[3])
    want = trips.trips(silver, carry_gap=carry_gap)
    got = stream_ses.closed_sessions(spark, f"{root}/trips").filter("vehicle_id <> 'far'")
    assert same(got.select(*want.columns), want)
    # Only the vehicle whose event closed the others still holds a session.
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "sessions").load(f"{root}/ck")
    held = {r["key"]["vehicle_id"]: r["value"] for r in state.select("key", "value").collect()}
    assert set(held) <= {"v0", "v1", "v2", "far"} and not any(held[v]["is_open"] for v in held if v != "far")
    assert all(held[v]["first_ts"] is None and held[v]["sessions"] > 0 for v in held if v != "far")


def test_stream_of_charges(spark, tmp_path):
    root, rows = f"file://{tmp_path}", _days(2)
    silver = telemetry.silver(bronze(spark, rows))
    far = {"at": 40 * 86_400, "vehicle_id": "far", "speed_kmh": 0, "current_amps": -9.0, "voltage_volts": 400.0}
    telemetry.silver(bronze(spark, [*rows, far])).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(silver.schema).parquet(f"{root}/in")
    ingest.drain(stream_ses.charge_stream(stream, "1 hour", f"{root}/out", f"{root}/ck"))
    want = charging.charging_sessions(silver)
    assert same(stream_ses.closed_sessions(spark, f"{root}/out").select(*want.columns), want)


def test_a_stream_of_sessions_needs_a_key(spark, tmp_path):
    stream = spark.readStream.schema(telemetry.silver(bronze(spark, [])).schema).parquet(str(tmp_path))
    with pytest.raises(ValueError):
        stream_ses.trip_stream(stream, "1 hour", f"{tmp_path}/a", f"{tmp_path}/b", keys=())


# --- committed batches -------------------------------------------------------


def test_batches_merge_by_size_and_stay_few(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    log, written = BatchLog(spark, root, fanout=3, facts={"max_id": F.max("id")}), 0
    for n in range(20):
        assert log.commit(spark.range(n * 10, n * 10 + 10), n)
        written = max(written, len(log.manifest().entries))
    assert written <= 3 * 2  # two waiting folders a tier
    assert log.read().count() == 200 and log.read().distinct().count() == 200
    assert [(e.first, e.last) for e in log.manifest().entries] == [(0, 8), (9, 17), (18, 18), (19, 19)]
    assert sum(e.rows for e in log.manifest().entries) == 200
    assert max(e.facts["max_id"] for e in log.manifest().entries) == 199
    assert len(list((tmp_path / "t" / "log").glob("[0-9]*"))) == KEEP
    kept = {e.folder for e in log.manifest().entries} | {f for _, f in log.manifest().retired}
    assert {p.name for p in (tmp_path / "t" / "data").iterdir() if p.is_dir()} == kept


def test_a_batch_counts_once_and_whole(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    log = BatchLog(spark, root)
    assert log.read().columns == [] and log.commit(spark.range(3), 0) and not log.commit(spark.range(3), 0)
    # A write whose manifest was never reached, and one cut off while it was written.
    log._write(spark.range(100, 105), 1, 1, 0)
    (tmp_path / "t" / "log" / f"{7:020d}").write_text('{"version": 7, "last"')
    assert log.read().count() == 3
    assert log.commit(spark.range(10, 12), 1) and log.manifest().version == 8
    assert sorted(r[0] for r in log.read().collect()) == [0, 1, 2, 10, 11]
    assert len(log.remove_orphans()) == 1 and log.read().count() == 5
    # No rows, and a column that comes later.
    assert log.commit(spark.range(0), 2) and len(log.manifest().entries) == 2
    log.commit(spark.range(1).withColumn("x", F.lit("y")), 3)
    assert sorted(map(tuple, log.read().filter("id = 0").collect()), key=str) == [(0, "y"), (0, None)]
    with pytest.raises(ValueError):
        BatchLog(spark, root, fanout=1)


# --- merges that touch some partitions ---------------------------------------


def test_upsert_rewrites_only_partitions_with_a_match(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = [(f"k{i}", f"d{i % 4}", float(i)) for i in range(40)] + [(None, "d9", 1.0)]
    tables.store_by(spark.createDataFrame(rows, "k string, day string, x double"), path, "day")
    before = files_of(tmp_path / "t")
    source = spark.createDataFrame([("k1", 100.0), ("k5", 500.0), ("none", 1.0), (None, 9.0)], "k string, x double")
    assert tables.upsert_stored(spark, path, source, ["k"], ["x"], "day") == ["d1", "d9"]
    after = files_of(tmp_path / "t")
    stays = {f for f in before if "day=d1" not in f and "day=d9" not in f}
    assert stays and {f: before[f] for f in stays} == {f: t for f, t in after.items() if f in stays}
    assert not any("day=d1" in f or "day=d9" in f for f in set(before) & set(after))
    got = {r["k"]: r["x"] for r in tables.stored_by(spark, path).collect()}
    assert got == {k: {"k1": 100.0, "k5": 500.0, None: 9.0}.get(k, x) for k, _, x in rows}
    # A source that names partitions is searched for in those alone.
    named = spark.createDataFrame([("k2", "d2", -1.0), ("k3", "d2", -1.0)], "k string, day string, x double")
    assert tables.upsert_stored(spark, path, named, ["k"], ["x"], "day") == ["d2"]
    assert {r["x"] for r in tables.stored_by(spark, path).filter("k in ('k2', 'k3')").collect()} == {-1.0, 3.0}
    assert tables.upsert_stored(spark, path, named.limit(0), ["k"], ["x"], "day") == []
    assert [p.name for p in tmp_path.iterdir()] == ["t"]  # nothing is left beside the table


def test_marks_and_retention_touch_some_dates(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    rows = [
        ("a", T0, True), ("b", T0 + timedelta(seconds=5), True),  # a date that goes whole
        ("c", T0 + timedelta(days=1), True), ("d", T0 + timedelta(days=1), None),  # one that loses a row
        ("e", T0 + timedelta(days=2), False), ("f", T0 + timedelta(days=30), True), ("g", None, True),
    ]
    df = spark.createDataFrame(rows, "id string, timestamp timestamp, synced boolean")
    tables.store_by(store.store_rows(df), path, store.DAY)
    before = files_of(tmp_path / "s")
    done = store.retain_stored(spark, path, 7, T0 + timedelta(days=20))
    first = T0.date()
    assert done == {"dropped": [first], "rewritten": [first + timedelta(days=1)]}
    assert sorted(r["id"] for r in tables.stored_by(spark, path).collect()) == ["d", "e", "f", "g"]
    after = files_of(tmp_path / "s")
    moved = {f for f in before if f"date={first}" in f or f"date={first + timedelta(days=1)}" in f}
    assert {f: t for f, t in before.items() if f not in moved} == {f: t for f, t in after.items() if f in before}
    ids = spark.createDataFrame([("e",), ("f",), ("zz",), (None,)], "id string")
    assert store.mark_synced_stored(spark, path, ids) == [first + timedelta(days=2)]  # f is marked already

    assert store.pending(tables.stored_by(spark, path)).select("id").collect()[0]["id"] == "d"


# --- layers that follow what arrives -----------------------------------------


def _same_layers(lake, full):
    for kind in refresh.KINDS:
        got, want = lake.sessions(kind), full.sessions(kind)
        assert same(got, want), kind.name
    assert same(lake.silver.select(*full.silver.columns), full.silver)
    for name in gold_state.TABLES:
        drop = "last_updated"
        assert same(lake.gold(name).drop(drop), full.gold(name).drop(drop)), name


def test_refresh_equals_a_build_from_scratch(spark, tmp_path):
    """Late rows inside, between, before and after what is stored; corrected
    copies, one of which takes an instant away and parts a session."""
    root, rows, rng = f"file://{tmp_path}", _days(3, 4), random.Random(3)
    late_days = {("v0", 2), ("v1", 0), ("v1", 3), ("v2", 1)}
    day = lambda r: (r["at"] + 43_200) // 86_400  # noqa: E731  T0 is noon
    first = [r for r in rows if (r["vehicle_id"], day(r)) not in late_days]
    second = [r for r in rows if (r["vehicle_id"], day(r)) in late_days]
    corrected = [{**r, "speed_kmh": rng.choice([0, 30, 250]), "_ingested_at": T0 + timedelta(days=99)} for r in rng.sample(first, 6)]
    second += corrected + [{"at": 7 * 86_400, "vehicle_id": "new", "speed_kmh": 40}]
    lake = refresh.build(bronze(spark, first), f"{root}/lake")
    every = bronze(spark, first + second)
    refresh.refresh(lake, every, bronze(spark, second))
    _same_layers(lake, refresh.build(every, f"{root}/full"))
    # Nothing new: nothing is written.
    before = files_of(tmp_path / "lake" / "trips")
    assert refresh.refresh(lake, every, bronze(spark, [])) == {}
    assert files_of(tmp_path / "lake" / "trips") == before


def test_a_late_drive_rewrites_its_own_and_the_next_date(spark, tmp_path):
    root = f"file://{tmp_path}"
    drive = lambda d: [{"at": d * 86_400 + s, "speed_kmh": 50, "current_amps": 9.0, "voltage_volts": 400.0, "distance_mi": float(s)} for s in (0, 60, 120)]
    rows = [r for d in range(8) if d != 4 for r in drive(d)]
    lake = refresh.build(bronze(spark, rows), f"{root}/lake")
    before = files_of(tmp_path / "lake")
    done = refresh.refresh(lake, bronze(spark, rows + drive(4)), bronze(spark, drive(4)))
    late = (T0 + timedelta(days=4)).date()
    # The drive after it takes its idle time from the late one now.
    assert done == {"silver": [late], "trips": [late, late + timedelta(days=1)], "charges": []}
    after = files_of(tmp_path / "lake")
    touched = (str(late), str(late + timedelta(days=1)))
    stays = {f: t for f, t in before.items() if not any(f"={d}" in f for d in touched)}
    assert len(stays) > 20 and all(after.get(f) == t for f, t in stays.items())
    # Gold reads the partitions of the dates that changed, and no others.
    for source, column in (("trips", "start_date"), ("silver", "date")):
        rows = lake.state_rows(source, done[source])
        assert re.search(rf"PartitionFilters: \[[^\n]*{column}#\d+ (IN|=)", plan(rows))
        read = {r[0] for r in rows.select(F.input_file_name()).distinct().collect()}
        assert read and all(any(f"{column}={d}" in f for d in done[source]) for f in read)


def test_many_small_dates_share_folders(spark, tmp_path, monkeypatch):
    """Twelve dates of a few rows: every layer has few folders, a late drive and a
    later one rewrite theirs alone, and the layers equal a build from scratch."""
    monkeypatch.setattr(tables, "FOLDERS", 3)
    root = f"file://{tmp_path}"
    row = {"current_amps": 9.0, "voltage_volts": 400.0, "battery_capacity_ah": 90.0}
    drive = lambda d, v: [{"at": d * 86_400 + s, "vehicle_id": v, "speed_kmh": 50, "distance_mi": float(s), **row} for s in (0, 60)]
    park = lambda d: [{"at": d * 86_400 + 9_000 + s, "vehicle_id": "v0", "speed_kmh": 0, "current_amps": -9.0, "voltage_volts": 400.0} for s in (0, 90)]
    rows = [r for d in range(12) for v in ("v0", "v1") if (d, v) != (4, "v0") for r in drive(d, v) + park(d)]
    late = drive(4, "v0") + drive(30, "v1")
    lake = refresh.build(bronze(spark, rows), f"{root}/lake")
    folders = lambda: {str(p.parent.relative_to(tmp_path / "lake")) for p in (tmp_path / "lake").rglob("part-*")}
    layers = {f.rsplit("/", 1)[0] for f in folders()}
    assert len(layers) == 14
    assert all(1 < sum(f.startswith(f"{n}/") for f in folders()) <= tables.FOLDERS for n in layers)
    before = files_of(tmp_path / "lake" / "silver")
    every = bronze(spark, rows + late)
    done = refresh.refresh(lake, every, bronze(spark, late))
    days = [(T0 + timedelta(days=d)).date() for d in (4, 5, 30)]
    assert done == {"silver": [days[0], days[2]], "trips": days, "charges": []}
    after = files_of(tmp_path / "lake" / "silver")
    assert len(before) - 1 <= sum(after.get(f) == t for f, t in before.items()) < len(before)
    _same_layers(lake, refresh.build(every, f"{root}/full"))


def _forty_dates() -> list[dict]:
    """A drive of either vehicle and a charge on every one of forty dates."""
    row = {"current_amps": 9.0, "voltage_volts": 400.0, "battery_capacity_ah": 90.0, "ambient_temp_f": 61.0}
    drive = [
        {"at": d * 86_400 + s, "vehicle_id": v, "speed_kmh": 50 + d, "distance_mi": s / 20, **row}
        for d in range(40) for v in ("v0", "v1") for s in (0, 60, 120)
    ]
    charge = [
        {"at": d * 86_400 + 9_000 + s, "vehicle_id": "v0", "speed_kmh": 0, "current_amps": -9.0, "voltage_volts": 400.0}
        for d in range(40) for s in (0, 90)
    ]
    return drive + charge


def test_a_refresh_that_touches_every_date(spark, tmp_path):
    """One corrected copy a date, and a drive between: folders and what a
    refresh carries in its filters do not grow with the dates."""
    root, rows = f"file://{tmp_path}", _forty_dates()
    late = [{**r, "speed_kmh": 20, "_ingested_at": T0 + timedelta(days=99)} for r in rows[::6]]
    late += [{"at": 20 * 86_400 + 30_000 + s, "vehicle_id": "v1", "speed_kmh": 30, "distance_mi": s / 20} for s in (0, 60)]
    lake = refresh.build(bronze(spark, rows), f"{root}/lake")
    every = bronze(spark, rows + late)
    done = refresh.refresh(lake, every, bronze(spark, late))
    assert len(done["silver"]) == len(done["trips"]) == 40
    for layer in {p.parent.parent for p in (tmp_path / "lake").rglob("part-*")}:
        assert len(list(layer.glob("*=*"))) <= 16, layer
    rows_of = lake.state_rows("silver", done["silver"])
    (filters,) = re.findall(r"PartitionFilters: \[([^\n]*)\]", plan(rows_of))
    assert filters.count(",") < 20 and rows_of.count() == lake.silver.count()
    _same_layers(lake, refresh.build(every, f"{root}/full"))


def test_daily_tables_over_stored_layers_of_many_dates(spark, tmp_path):
    """Silver below the trips has few folders, and the daily tables, of the fleet
    and by vehicle, equal those without anything stored."""
    rows = bronze(spark, _forty_dates())
    stored = pipeline.build(rows, f"file://{tmp_path}")
    assert 1 < len(list((tmp_path / "silver").glob("*=*"))) <= 16
    found = trips.trip_ratios(trips.trips(telemetry.silver(rows)))
    for keys, n in ((), 40), (("vehicle_id",), 80):
        got = gold.daily_summary(stored.trips, keys)
        assert got.count() == n and same(got, gold.daily_summary(found, keys))


def test_stored_by_spans_of_days(spark, tmp_path, monkeypatch):
    """Merges where days share folders, a day before 1970 and no day among them."""
    monkeypatch.setattr(tables, "FOLDERS", 3)
    path, first = f"file://{tmp_path}/t", date(1969, 12, 25)
    rows = [(f"k{i % 5}", first + timedelta(days=i), float(i)) for i in range(20)] + [("k9", None, -1.0)]
    schema = "k string, day date, x double"
    table = tables.store_by(spark.createDataFrame(rows, schema), path, "day")
    assert table.columns == ["k", "x", "day"]
    assert sorted(map(tuple, table.collect()), key=str) == sorted(((k, x, d) for k, d, x in rows), key=str)
    names = sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir())
    assert names == ["day_span=-1", "day_span=0", "day_span=1", "day_span=__HIVE_DEFAULT_PARTITION__"]
    # k1 occurs on other days of the same folder too: only the day named is changed.
    named = spark.createDataFrame([("k1", rows[1][1], 100.0), ("k3", None, 5.0)], schema)
    before = files_of(tmp_path / "t")
    assert tables.upsert_stored(spark, path, named, ["k"], ["x"], "day") == [rows[1][1]]
    want = [(k, 100.0 if (k, d) == ("k1", rows[1][1]) else x, d) for k, d, x in rows]
    read = lambda: sorted(map(tuple, tables.stored_by(spark, path).collect()), key=str)
    assert read() == sorted(want, key=str)
    after = files_of(tmp_path / "t")
    assert all(after.get(f) == t for f, t in before.items() if "day_span=-1" not in f)
    # Without the day, all rows of the key.
    some = spark.createDataFrame([("k1", 7.0)], "k string, x double")
    assert tables.upsert_stored(spark, path, some, ["k"], ["x"], "day") == [d for k, d, _ in rows if k == "k1"]
    assert read() == sorted(((k, 7.0 if k == "k1" else x, d) for k, x, d in want), key=str)


def test_retention_where_days_share_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FOLDERS", 3)
    path = f"file://{tmp_path}/s"
    rows = [(f"i{n}", T0 + timedelta(days=n), n % 4 != 3) for n in range(24)] + [("late", T0, False), ("none", None, True)]
    df = spark.createDataFrame(rows, "id string, timestamp timestamp, synced boolean")
    tables.store_by(store.store_rows(df), path, store.DAY)
    assert len([p for p in (tmp_path / "s").iterdir() if p.is_dir()]) <= 4
    done = store.retain_stored(spark, path, 7, T0 + timedelta(days=20, hours=1))
    day = lambda n: (T0 + timedelta(days=n)).date()
    assert done == {"dropped": [day(n) for n in range(1, 14) if n % 4 != 3], "rewritten": [day(0)]}
    left = {i for i, at, ok in rows if at is None or at > T0 + timedelta(days=13) or not ok}
    assert {r["id"] for r in tables.stored_by(spark, path).collect()} == left
    ids = spark.createDataFrame([("i7",), ("late",), ("i20",)], "id string")
    assert store.mark_synced_stored(spark, path, ids) == [day(0), day(7)]
    flags = {r["id"]: r["synced"] for r in tables.stored_by(spark, path).collect()}
    assert flags == {i: ok or i in {"i7", "late"} for i, _, ok in rows if i in left}


def test_days_with_many_rows_keep_their_own_folder(spark, monkeypatch):
    monkeypatch.setattr(tables, "FOLDERS", 3)
    days = spark.range(60).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 3).cast("int")).alias("day"))
    assert tables.width_of(days, F.col("day")) > 1
    monkeypatch.setattr(tables, "FOLDER_ROWS", 3)
    assert tables.width_of(days, F.col("day")) == 1


def test_refresh_needs_slots_within_a_day(spark, tmp_path):
    with pytest.raises(ValueError):
        refresh.Lake(spark, str(tmp_path), gap=7 * 60)


# --- arrival and upload logs -------------------------------------------------


def test_arrival_lists_and_rewrites_little(spark, tmp_path, monkeypatch):
    """Ten batches: what a reader lists stays small, copies are settled on the way."""
    monkeypatch.setattr(ingest, "BatchLog", lambda *a, **k: BatchLog(*a, **k, fanout=3))
    root, rows = f"file://{tmp_path}", []
    for n in range(10):
        part = [{"at": s, "soc": float(10 * n + s), "_ingested_at": T0 + timedelta(hours=n), "id": f"{n}-{s}"} for s in range(n, n + 3)]
        rows += part
        bronze(spark, part).coalesce(1).write.parquet(f"{root}/in/{n}")
    stream = spark.readStream.schema(schemas.BRONZE).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
    ingest.drain(ingest.latest_on_arrival(stream, f"{root}/t", f"{root}/ck"))
    logs = [BatchLog(spark, f"{root}/t/{name}").manifest() for name in ("bronze", "latest")]
    assert [m.last for m in logs] == [9, 9] and all(len(m.entries) <= 4 for m in logs)
    assert sum(e.rows for e in logs[0].entries) == 30 and sum(e.rows for e in logs[1].entries) < 30
    got, want = ingest.latest(spark, f"{root}/t"), telemetry.dedup_latest(bronze(spark, rows))
    assert same(got.select(*want.columns), want) and ingest.arrived(spark, f"{root}/t").count() == 30
    some = ingest.latest(spark, f"{root}/t", where=F.col("timestamp") < T0 + timedelta(seconds=2))
    assert some.count() == 2


def test_a_failure_between_files_and_marks_neither_loses_nor_doubles(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    rows = [(f"i{n}", T0 + timedelta(seconds=n), n % 4 == 0) for n in range(20)]
    schema = "id string, timestamp timestamp, synced boolean"
    full = spark.createDataFrame(rows, schema).withColumn("vehicle_id", F.lit("v"))
    for name in schemas.MEASURE_NAMES:
        full = full.withColumn(name, F.lit(None).cast("double"))
    full.coalesce(1).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(full.schema).parquet(f"{root}/in")
    upload = lambda: ingest.drain(sync.sync_stream(stream, f"{root}/up", f"{root}/ck", "json", 7, marks=f"{root}/marks"))
    with monkeypatch.context() as broken:
        broken.setattr(BatchLog, "commit", lambda *a, **k: 1 / 0)
        with pytest.raises(Exception):
            upload()
    written = spark.read.json(f"{root}/up/vehicle_data_*.json").count()
    assert written == 15 and tuple(store.sync_status(sync.with_marks(full, f"{root}/marks")).first()) == (15, 5)
    upload()
    assert spark.read.json(f"{root}/up/vehicle_data_*.json").count() == 15
    assert tuple(store.sync_status(sync.with_marks(full, f"{root}/marks")).first()) == (0, 20)
    (entry,) = sync.upload_log(spark, f"{root}/marks").manifest().entries
    assert (entry.rows, entry.facts) == (15, {"min_id": "i1", "max_id": "i9", "upload": "vehicle_data_000000000000.json"})


# --- records set apart


def test_every_line_is_a_row_or_set_apart(spark, tmp_path):
    head = "timestamp," + ",".join(schemas.MEASURE_NAMES)
    good, untimed = "2024-01-01T12:00:00Z,50.5" + "," * 15, "yesterday,50.5" + "," * 15
    short, typed = "2024-01-01T12:00:00Z,50.5", "2024-01-01T12:00:00Z,x" + "," * 15
    root, landing = f"file://{tmp_path}", tmp_path / "landing"
    landing.mkdir()
    (landing / "vehicle_data_1.csv").write_text("\n".join([head, good, untimed, short, typed]) + "\n")

    def drain():
        ingest.drain(ingest.append_or_set_apart(files.csv_records(spark, f"{root}/landing"), root, f"{root}/ck"))
        bad = sorted((r["_reason"], r["_record"][:22], r["_source_file"][-18:]) for r in ingest.set_apart(spark, root).collect())
        return ingest.arrived(spark, root).count(), bad

    found = [
        ("damaged", short[:22], "vehicle_data_1.csv"), ("damaged", typed[:22], "vehicle_data_1.csv"),
        ("untimed", '{"timestamp":"yesterda', "vehicle_data_1.csv"),
    ]
    assert drain() == (1, found)
    assert drain() == (1, found)  # nothing new, nothing twice
    (landing / "vehicle_data_2.csv").write_text("\n".join([head, good, good]) + "\n")
    assert drain() == (3, found)


def test_json_lines_set_apart(spark, tmp_path):
    landing, root = tmp_path / "landing", f"file://{tmp_path}"
    landing.mkdir()
    (landing / "vehicle_data_1.json").write_text(
        '{"timestamp": "2024-01-01T12:00:00Z", "soc": 1.5}\n[{"timestamp": "2024-01-01T12:00:01Z", "socHD": 2.5}]\n'
        '{"timestamp": "2024-01-01T12:00:02Z", "soc": \n{"soc": 3.5}\n{"timestamp": "2024-01-01T12:00:03Z", "soc": "x"}\n'
    )
    ingest.drain(ingest.append_or_set_apart(files.json_records(spark, f"{root}/landing"), root, f"{root}/ck"))
    assert sorted(r["soc"] or r["soc_hd"] for r in ingest.arrived(spark, root).collect()) == [1.5, 2.5]
    bad = {r["_record"]: r["_reason"] for r in ingest.set_apart(spark, root).collect()}
    assert sorted(bad.values()) == ["damaged", "damaged", "untimed"]
    assert bad['{"soc":3.5}'] == "untimed"
    assert bad['{"timestamp": "2024-01-01T12:00:02Z", "soc": '] == "damaged"
