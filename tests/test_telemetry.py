"""Hand-made edge rows and plan checks of the telemetry operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from voltrail import schemas
from voltrail.functions.measures import fixed_avg, fixed_sum
from voltrail.operators import charging, frames, gold, samples, sessions, store, telemetry, trips
from voltrail.plans import pipeline
from voltrail.sources import exports, files, tables
from voltrail.streaming import ingest, state, sync

T0 = datetime(2024, 1, 1, 12, 0, 0)


def bronze(spark, rows):
    """Bronze rows from dicts; ``at`` is seconds after T0."""
    full = []
    for i, r in enumerate(rows):
        row = {f.name: None for f in schemas.BRONZE}
        row |= {"vehicle_id": "v0", "id": f"i{i:03d}", "_ingested_at": T0, "_source_file": "f"}
        row |= {k: v for k, v in r.items() if k != "at"}
        if "at" in r:
            row["timestamp"] = T0 + timedelta(seconds=r["at"])
        full.append(tuple(row[f.name] for f in schemas.BRONZE))
    return spark.createDataFrame(full, schemas.BRONZE)


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


# --- frames ----------------------------------------------------------------

FRAMES = [
    ("7EC 04 62 00 0D 64\r", "speed_mph", 100 * 0.621371),
    ("7EC056240D4FF38", "current_amps", -10.0),
    ("7EC05622885 02D0", "voltage_volts", 360.0),
    ("7EC04628334FF", "soc", 100.0),
    ("7EC056243AF8000", "soc_hd", 32768 * 100 / 65535),
    ("7EC0462434F32", "battery_avg_temp_c", 10.0),
    ("7EC0562 41B2 FFFF", "hvac_measured_power_w", -1.0),
    ("7EC0462451F01", "ac_compressor_on", 0.0),
    ("7EC0462451F00", "ac_compressor_on", 1.0),
    ("7EC0462451F02", "ac_compressor_on", 1.0),
    ("7EC056245F94650", "battery_capacity_ah", 180.0),
    ("7EC0562435703E8", "battery_resistance_mohm", 100.0),
    ("7E80441310064", "distance_mi", 100 * 0.621371),
    ("7E80341465A", "ambient_temp_f", 122.0),
    ("7EC622885", None, None), ("7EC0562288502G0", None, None), ("OK", None, None), ("", None, None), (None, None, None),
]


def _frames(spark):
    return spark.createDataFrame([("v", T0, f) for f, _, _ in FRAMES], schemas.FRAMES).withColumn(
        "n", F.monotonically_increasing_id()
    )


@pytest.mark.parametrize("strict", [False, True])
def test_decoded_values(spark, strict):
    got = sorted((r["signal"], r["value"]) for r in frames.decode_frames(_frames(spark), strict).collect())
    want = [(s, v) for f, s, v in FRAMES if s and not (strict and f.startswith("7EC622885"))]
    assert got == sorted(want)


def test_response_status(spark):
    rows = spark.createDataFrame([(x,) for x in ("OK", "?", "CAN ERROR", "SEARCHING...", " \r\n", "7EC04628334FF")], "raw string")
    got = {r["status"]: r["responses"] for r in frames.decode_quality(rows).collect()}
    assert got == {"ok": 1, "error": 2, "other": 1, "signal": 1}


def test_decoding_cleans_a_text_once_and_compiles(spark):
    stored = spark.read.schema(schemas.FRAMES).parquet(_stored(spark, _frames(spark).drop("n")))
    text = plan(frames.decode_frames(stored))
    assert text.count("regexp_replace") <= 4 and len(text) < 40_000  # shown with the node and in its inputs
    assert "Python" not in text


def _stored(spark, df) -> str:
    from voltrail.session import scratch

    path = scratch(spark, "test")
    df.write.parquet(path)
    return path


# --- samples ---------------------------------------------------------------


def test_live_efficiency(spark):
    rows = [(10.0, 0.0), (10.0, -5.0), (0.0, 0.0), (100.0, 1.0), (30.0, 10.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "s double, p double")
    got = [r[0] for r in df.select(samples.live_efficiency(F.col("s"), F.col("p"))).collect()]
    assert got == [-1, -1, None, -1, 3.0, None]


def test_relative_distance_settles_ties_by_value(spark):
    rows = [("v", T0, 5.0), ("v", T0, 3.0), ("v", T0 + timedelta(seconds=9), 9.0)]
    readings = spark.createDataFrame(rows, "vehicle_id string, timestamp timestamp, distance_mi double")
    got = sorted(r["relative_distance"] for r in samples.relative_distance(readings).collect())
    assert got == [0.0, 2.0, 6.0]
    resets = spark.createDataFrame([("v", T0)], "vehicle_id string, reset_at timestamp")
    got = sorted(r["relative_distance"] for r in samples.relative_distance(readings, resets).collect())
    assert got == [0.0, 2.0, 4.0]  # the zero is the last, largest reading of the instant, for what follows


# --- silver ----------------------------------------------------------------


def test_dedup_takes_the_latest_then_the_lowest_tie_break(spark):
    late = T0 + timedelta(hours=1)
    rows = [
        {"at": 0, "soc": 1.0}, {"at": 0, "soc": 2.0, "_ingested_at": late, "id": "b"},
        {"at": 0, "soc": 3.0, "_ingested_at": late, "id": "a"}, {"at": 0, "soc": 4.0, "vehicle_id": "v1"}, {"soc": 5.0},
    ]
    got = telemetry.dedup_latest(telemetry.timed(bronze(spark, rows)))
    assert sorted(r["soc"] for r in got.collect()) == [3.0, 4.0]


def test_unknown_vehicles_are_set_aside(spark):
    rows = [{"at": 0, "vehicle_id": None}, {"at": 0, "vehicle_id": None}, {"at": 0}]
    df = bronze(spark, rows)
    assert telemetry.silver(df).count() == 1 and telemetry.of_unknown_vehicle(df).count() == 2
    assert telemetry.silver(df, keys=()).count() == 1


def test_flags_and_guards(spark):
    rows = [
        {"at": 0, "speed_kmh": None, "current_amps": -5.0}, {"at": 1, "speed_kmh": 10, "current_amps": None},
        {"at": 2, "speed_kmh": 3, "current_amps": 10.0, "voltage_volts": 400.0},
        {"at": 3, "speed_kmh": 4, "current_amps": 1.25, "voltage_volts": 400.0},
        {"at": 4, "speed_kmh": 4, "current_amps": 1.275, "voltage_volts": 400.0}, {"at": 5, "speed_kmh": 201},
    ]
    got = {r["id"]: r for r in telemetry.silver(bronze(spark, rows)).collect()}
    assert (got["i000"]["is_moving"], got["i000"]["is_charging"], got["i000"]["is_regen"]) == (None, None, None)
    assert (got["i001"]["is_moving"], got["i001"]["is_charging"]) == (True, False)
    assert got["i002"]["instant_efficiency_mi_per_kwh"] is None and got["i003"]["instant_efficiency_mi_per_kwh"] is None
    assert got["i004"]["instant_efficiency_mi_per_kwh"] == round(4 * 0.621371 / 0.51, 2) and "i005" not in got


def test_silver_reads_only_needed_columns(spark):
    stored = spark.read.parquet(_stored(spark, bronze(spark, [{"at": 0}])))
    text = plan(trips.trips(telemetry.silver(stored)))
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert len(schema.split(",")) <= 16 and "battery_resistance_mohm" not in schema
    assert "Python" not in text and text.count("Scan parquet") == 1 or text.count("(1) Scan parquet") == 1


# --- sessions --------------------------------------------------------------


def _drive(*seconds, kw=10.0, speed=50):
    return [{"at": s, "speed_kmh": speed, "current_amps": kw * 1000 / 400, "voltage_volts": 400.0} for s in seconds]


def test_gap_limit(spark):
    near = telemetry.silver(bronze(spark, _drive(0, 300)))
    far = telemetry.silver(bronze(spark, _drive(0, 301)))
    assert trips.trips(near).count() == 1 and trips.trips(far).count() == 2


def test_boundary_interval(spark):
    silver = telemetry.silver(bronze(spark, _drive(0, 60, 60 + 13 * 3600, 120 + 13 * 3600)))
    carried = {r["trip_id"]: r["energy_consumed_kwh"] for r in trips.trips(silver).collect()}
    inside = {r["trip_id"]: r["energy_consumed_kwh"] for r in trips.trips(silver, carry_gap=False).collect()}
    assert inside == {1: 0.167, 2: 0.167} and carried[1] == 0.167
    assert carried[2] == pytest.approx(130.167)


def test_slots_equal_a_global_window(spark):
    rng = random.Random(1)
    at, rows = 0, []
    for _ in range(400):
        at += rng.choice([0, 1, 2, 30, 299, 300, 301, 900])
        rows.append((f"v{rng.randrange(2)}", T0 + timedelta(seconds=at)))
    df = spark.createDataFrame(rows, "vehicle_id string, timestamp timestamp").withColumn("n", F.monotonically_increasing_id())
    order = Window.partitionBy("vehicle_id").orderBy("timestamp")
    before = F.lag("timestamp").over(order)
    starts = F.when(before.isNull() | (F.unix_timestamp("timestamp") - F.unix_timestamp(before) > 300), 1).otherwise(0)
    plain = df.withColumn("starts", starts).withColumn("session_id", F.sum("starts").over(order))
    want = sorted((r["vehicle_id"], r["timestamp"], r["session_id"]) for r in plain.collect())
    for form in (sessions.sessionize, sessions.neighbours):
        assert sorted((r["vehicle_id"], r["timestamp"], r["session_id"]) for r in form(df).collect()) == want
    lags = sessions.neighbours(df).groupBy("vehicle_id", "timestamp").agg(F.sort_array(F.collect_list("prev_ts")).alias("p"))
    plain_lags = df.withColumn("prev_ts", before).groupBy("vehicle_id", "timestamp").agg(F.sort_array(F.collect_list("prev_ts")).alias("p"))
    assert sorted(map(tuple, lags.collect())) == sorted(map(tuple, plain_lags.collect()))


def test_energy_of_one_pass_equals_row_level(spark):
    rng = random.Random(2)
    rows = [
        {"at": 3 * i + (i // 50) * 1000, "speed_kmh": 40, "current_amps": rng.choice([None, rng.uniform(-50, 90)]), "voltage_volts": 380.0}
        for i in range(200)
    ]
    silver = telemetry.silver(bronze(spark, rows))
    order = Window.partitionBy("vehicle_id").orderBy("timestamp")
    step = F.unix_timestamp("timestamp") - F.unix_timestamp(F.lag("timestamp").over(order))
    plain = silver.withColumn("kwh", F.col("power_kw") * step / 3600)
    for use, column in ((F.col("power_kw") > 0, "energy_consumed_kwh"), (F.col("power_kw") < 0, "energy_regen_kwh")):
        want = plain.agg(F.sum(F.when(use, F.abs("kwh")))).first()[0]
        got = trips.trips(silver).agg(F.sum(column)).first()[0]
        assert abs(abs(got) - want) < 0.01
    assert trips.trips(silver).count() == 4


# --- sums ------------------------------------------------------------------


def test_sums_are_exact_at_any_size(spark):
    n = 200_000
    df = spark.range(n).select((F.lit(1e9) + F.col("id") % 7 + 0.123456789).alias("x"), F.col("id"))
    forward, back = (
        d.agg(fixed_sum(F.col("x"), 6), fixed_avg(F.col("x"), 6)).first() for d in (df.repartition(7), df.orderBy(F.desc("id")))
    )
    assert tuple(forward) == tuple(back)
    exact = sum(round((1e9 + i % 7 + 0.123456789) * 1e6) for i in range(n))
    assert exact > 2**53 and forward[0] == exact / 1e6


# --- gold ------------------------------------------------------------------


def test_buckets(spark):
    from voltrail.functions.measures import bucket

    edges = [20.0, 32.0, 50.0, 70.0, 85.0, 100.0]
    rows = spark.createDataFrame([(19.9,), (20.0,), (32.0,), (50.0,), (70.0,), (85.0,), (100.0,), (None,)], "x double")
    assert [r[0] for r in rows.select(bucket(F.col("x"), edges)).collect()] == [1, 2, 3, 4, 5, 6, 7, 7]


def test_stored_layers_and_kpis_without_capacity(spark, tmp_path):
    driven = [{**r, "distance_mi": 100.0 + i} for i, r in enumerate(_drive(0, 60, 120))]
    stored = pipeline.build(bronze(spark, driven), f"file://{tmp_path}/lake")
    built = pipeline.build_gold(stored)
    kpis = built["lifetime_kpis"].collect()
    assert len(kpis) == 1 and kpis[0]["initial_capacity_ah"] is None and kpis[0]["total_trips"] == 1
    text = plan(gold.lifetime_kpis(stored.trips, stored.charges, stored.silver))
    assert "Window" not in text  # neither dedup nor sessions again
    assert built["daily_summary"].count() == 1


def test_no_rows(spark, tmp_path):
    none = bronze(spark, [])
    silver = telemetry.silver(none)
    assert silver.count() == trips.trips(silver).count() == charging.charging_sessions(silver).count() == 0
    kpis = gold.lifetime_kpis(trips.trip_ratios(trips.trips(silver)), charging.charging_sessions(silver), silver)
    assert kpis.count() == 1 and gold.battery_health_daily(silver).count() == 0
    assert frames.decode_frames(spark.createDataFrame([], schemas.FRAMES)).count() == 0


# --- store -----------------------------------------------------------------


def test_retention_and_missing_flags(spark):
    old, new = T0 - timedelta(days=30), T0
    rows = [("a", old, True), ("b", old, False), ("c", new, True), ("d", None, True), ("e", old, None)]
    df = spark.createDataFrame(rows, "id string, timestamp timestamp, synced boolean")
    assert sorted(r["id"] for r in store.retain(df, 7, T0).collect()) == ["b", "c", "d", "e"]
    assert tuple(store.sync_status(df).first()) == (2, 3)
    assert sorted(r["id"] for r in store.pending(df).collect()) == ["b", "e"]
    marked = store.mark_synced(df, spark.createDataFrame([("e",)], "id string"))
    assert tuple(store.sync_status(marked).first()) == (1, 4)


# --- sources and sinks -----------------------------------------------------


def test_csv_of_a_fleet_comes_back_whole(spark, tmp_path):
    rows = [
        {"at": 0, "vehicle_id": "v0", "soc": 50.5, "ac_compressor_on": True}, {"at": 0, "vehicle_id": "v1", "soc": 60.5},
        {"at": 3, "vehicle_id": "v1", "ac_compressor_on": False},
    ]
    df, root = bronze(spark, rows), f"file://{tmp_path}"
    exports.export_csv(df, f"{root}/landing/vehicle_data_1.csv", 2)
    # An upload below a vehicle's folder, as a device writes it.
    folder = tmp_path / "landing" / "vehicle_id=v9"
    folder.mkdir(parents=True)
    (folder / "vehicle_data_x.csv").write_text(
        "timestamp,soc," + ",".join(schemas.MEASURE_NAMES[1:]) + "\n2024-01-01T12:00:00Z,70.5" + "," * 15 + "\n"
    )
    ingest.drain(ingest.append_stream(files.csv_stream(spark, f"{root}/landing"), f"{root}/out", f"{root}/ck"))
    got = spark.read.parquet(f"{root}/out")
    assert sorted((r["vehicle_id"], r["soc"], r["ac_compressor_on"]) for r in got.collect() if r["soc"]) == [
        ("v0", 50.5, True), ("v1", 60.5, None), ("v9", 70.5, None),
    ]
    assert telemetry.silver(got).count() == 4


def test_flags_as_text(spark):
    rows = spark.createDataFrame([("1",), ("0",), ("true",), ("",), (None,)], "x string")
    assert [r[0] for r in rows.select(files.parse_flag(F.col("x"))).collect()] == [True, False, True, None, None]


def test_layout_names_and_versions(spark, tmp_path):
    places = tables.init_layout(spark, f"file://{tmp_path}/lake")
    assert set(places) == {"bronze", "silver", "gold", "landing"} and (tmp_path / "lake" / "landing").is_dir()
    for bad in ("", "a b", "x;drop", "a`b"):
        with pytest.raises(ValueError):
            tables.safe_table_name(bad)
    assert tables.safe_table_name("bronze.raw-data_1") == "bronze.raw-data_1"
    root = f"file://{tmp_path}/v"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS versions LOCATION '{root}'")
    for n in range(4):
        tables.rebuild(spark.range(n), "versions.t", root)
    assert len(tables.prune_versions(spark, "versions.t", root, keep=2)) == 2
    assert tables.read(spark, "versions", "t").count() == 3
    assert exports.upload_path("d", "csv", T0) == "d/vehicle_data_20240101T120000Z.csv"


# --- streams ---------------------------------------------------------------


def test_latest_on_arrival_rebuilds_touched_dates(spark, tmp_path):
    root = f"file://{tmp_path}"
    late = T0 + timedelta(hours=2)
    parts = [
        [{"at": 0, "soc": 1.0}, {"at": 86400, "soc": 2.0}],
        [{"at": 0, "soc": 3.0, "_ingested_at": late}, {"at": 5, "soc": 4.0}],
        [{"at": 0, "soc": 5.0}],  # an older copy that arrives last
    ]
    for n, rows in enumerate(parts):
        bronze(spark, rows).coalesce(1).write.parquet(f"{root}/in/{n}")
        stream = spark.readStream.schema(schemas.BRONZE).parquet(f"{root}/in/*")
        ingest.drain(ingest.latest_on_arrival(stream, f"{root}/table", f"{root}/ck"))
    got = ingest.latest(spark, f"{root}/table")
    assert sorted(r["soc"] for r in got.collect()) == [2.0, 3.0, 4.0]


def test_live_state_is_compacted(spark, tmp_path):
    root = f"file://{tmp_path}"
    for n in range(3):
        rows = [(f"v{n % 2}", T0 + timedelta(seconds=n), "soc", float(n))]
        spark.createDataFrame(rows, schemas.SIGNALS).write.parquet(f"{root}/in/{n}")
        stream = spark.readStream.schema(schemas.SIGNALS).parquet(f"{root}/in/*")
        ingest.drain(state.live_state_stream(stream, f"{root}/state", f"{root}/ck"))
    before = sorted((r["vehicle_id"], r["soc"]) for r in state.live_state(spark, f"{root}/state").collect())
    state.compact_state(spark, f"{root}/state")
    after = sorted((r["vehicle_id"], r["soc"]) for r in state.live_state(spark, f"{root}/state").collect())
    assert before == after == [("v0", 2.0), ("v1", 1.0)]
    assert len(tables.list_folders(spark, f"{root}/state")) == 1


def test_uploaded_rows_are_marked(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = bronze(spark, _drive(0, 1, 2)).withColumn("synced", F.col("id") == "i000")
    rows.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    ingest.drain(sync.sync_stream(stream, f"{root}/up", f"{root}/ck", "json", marks=f"{root}/marks"))
    assert tuple(store.sync_status(sync.with_marks(rows, f"{root}/marks")).first()) == (0, 3)
    assert sync.EVERY_SYNC == {"processingTime": "300 seconds"}


def test_registry_has_sql_for_every_telemetry_query():
    import __spark_entry__ as entry

    from checks.oracle import ORACLE
    from checks.queries import REGISTRY

    assert set(REGISTRY) == set(ORACLE) and set(entry.oracle_sql()) <= set(entry.queries())
