"""The SQL that each query must agree with, for DuckDB over the same tables.

Statements are put together from named subqueries.  They use plain windows
over whole tables and exact decimals, so they share no method with the Spark
side.
"""

from __future__ import annotations

import re

# --- helpers ---------------------------------------------------------------


def rnd(x: str, n: int) -> str:
    """Half-up rounding of the printed value of a double."""
    return f"cast(round(cast(cast({x} as varchar) as decimal(38,18)), {n}) as double)"


def exact_sum(x: str, places: int) -> str:
    return f"cast(sum(cast({x} as decimal(18,{places}))) as double)"


def exact_avg(x: str, places: int) -> str:
    """Sum of whole last places over the count, then scaled."""
    whole = f"cast(round({x} * 1e{places}) as hugeint)"
    return f"(cast(sum({whole}) as double) / count({x}) / 1e{places})"


def kwh(watts: str, dt: str) -> str:
    """Exact watt-seconds as kWh."""
    return f"(cast(sum(cast(round(({watts}) * 1e3) as hugeint) * {dt}) as double) / 3.6e6)"


CTE: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def needed(sql: str, seen: list[str]) -> None:
    for name in CTE:
        if name not in seen and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
            needed(CTE[name], seen)
            if name not in seen:
                seen.append(name)


def add(key: str, sql: str) -> None:
    used: list[str] = []
    needed(sql, used)
    head = "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in used) + "\n" if used else ""
    ORACLE[key] = head + sql


# --- base tables -----------------------------------------------------------

CTE["ev"] = """
SELECT event_id AS e, event_id // 200 AS b, event_id % 200 AS p, value AS v,
       event_id % 10 = 0 AS tenth, (event_id // 200) % 4 = 3 AS chg,
       1704067200 + (event_id // 200) * 46800 + (event_id % 200) * 3 AS sec
FROM events"""

CTE["one_copy"] = """
SELECT e, 'v' || (b % 3) AS vehicle_id, 's-' || e AS id,
  CASE WHEN e % 103 <> 102 THEN make_timestamp(sec * 1000000) END AS timestamp,
  CASE WHEN tenth THEN 50 + p * 0.1e0 END AS soc,
  cast(CASE WHEN e % 97 = 96 THEN 250 WHEN chg THEN 0 ELSE 20 + (e * 7) % 80 END AS int) AS speed_kmh,
  CASE WHEN chg THEN -(2e0 + v / 4e0) ELSE v / 2e0 - 20e0 END AS current_amps,
  CASE WHEN e % 101 = 100 THEN 500e0 ELSE cast(350 + e % 40 AS double) END AS voltage_volts,
  1000e0 + e * 0.02e0 AS distance_mi,
  cast(10 + (b * 37) % 100 AS double) AS ambient_temp_f,
  CASE WHEN tenth THEN CASE WHEN chg THEN 20e0 + p * 0.3e0 ELSE 90e0 - p * 0.1e0 END END AS soc_hd,
  CASE WHEN tenth THEN cast(20 + b % 15 AS double) END AS battery_avg_temp_c,
  CASE WHEN tenth THEN 20 + b % 15 + (e % 7) * 0.5e0 END AS battery_max_temp_c,
  CASE WHEN tenth THEN 20 + b % 15 - (e % 6) * 0.5e0 END AS battery_min_temp_c,
  CASE WHEN tenth THEN 18e0 + b % 15 END AS battery_coolant_temp_c,
  CASE WHEN tenth THEN cast(500 + e % 1500 AS double) END AS hvac_measured_power_w,
  CASE WHEN tenth THEN cast(600 + e % 1500 AS double) END AS hvac_commanded_power_w,
  CASE WHEN tenth THEN e % 20 = 0 END AS ac_compressor_on,
  CASE WHEN p = 0 THEN 180e0 - b * 0.05e0 END AS battery_capacity_ah,
  CASE WHEN p = 0 THEN 100e0 + b * 0.1e0 END AS battery_resistance_mohm,
  make_timestamp((sec + 3600) * 1000000) AS _ingested_at,
  'vehicle_data_' || b || '.csv' AS _source_file
FROM ev"""

MEASURES = (
    "soc, speed_kmh, current_amps, voltage_volts, distance_mi, ambient_temp_f, soc_hd, "
    "battery_avg_temp_c, battery_max_temp_c, battery_min_temp_c, battery_coolant_temp_c, "
    "hvac_measured_power_w, hvac_commanded_power_w, ac_compressor_on, battery_capacity_ah, "
    "battery_resistance_mohm"
)

CTE["bronze"] = """
SELECT * EXCLUDE (e) FROM one_copy
UNION ALL BY NAME
SELECT * EXCLUDE (e) REPLACE ('d' || id AS id, soc + 0.5e0 AS soc,
       _ingested_at + INTERVAL 1 HOUR AS _ingested_at)
FROM one_copy WHERE e % 50 = 0"""


def latest(keys: str) -> str:
    return f"""
SELECT * FROM bronze WHERE timestamp IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY {keys} timestamp
  ORDER BY _ingested_at DESC, _source_file NULLS FIRST, id NULLS FIRST) = 1"""


CTE["latest"] = latest("vehicle_id,")
CTE["latest_unkeyed"] = latest("")

VALID = """(speed_kmh IS NULL OR speed_kmh BETWEEN 0 AND 200)
  AND (voltage_volts IS NULL OR voltage_volts BETWEEN 200 AND 450)
  AND (soc IS NULL OR soc BETWEEN 0 AND 100)"""

KW = "(current_amps * voltage_volts / 1000e0)"
DERIVED = {
    "date": "cast(timestamp AS date)",
    "hour": "cast(hour(timestamp) AS int)",
    "day_of_week": "cast(dayofweek(timestamp) + 1 AS int)",
    "speed_mph": rnd("speed_kmh * 0.621371e0", 1),
    "power_kw": rnd(KW, 3),
    "drivetrain_power_kw": rnd(f"({KW} - coalesce(hvac_measured_power_w, 0e0) / 1000e0)", 3),
    "ambient_temp_c": rnd("((ambient_temp_f - 32) * 5e0 / 9e0)", 1),
    "battery_temp_spread_c": rnd("(battery_max_temp_c - battery_min_temp_c)", 1),
    "hvac_power_kw": rnd("(hvac_measured_power_w / 1000e0)", 3),
    "instant_efficiency_mi_per_kwh": "CASE WHEN speed_kmh > 3 AND "
    + KW
    + " > 0.5e0 THEN "
    + rnd(f"(speed_kmh * 0.621371e0 / {KW})", 2)
    + " END",
    "is_moving": "speed_kmh > 0",
    "is_charging": "current_amps < -1e0 AND speed_kmh = 0",
    "is_regen": "current_amps < -1e0 AND speed_kmh > 0",
}


def derived(*names: str) -> str:
    return ", ".join(f"{DERIVED[n]} AS {n}" for n in names)


SILVER = f"""vehicle_id, id, timestamp, {derived("date", "hour", "day_of_week")}, soc, soc_hd,
  speed_kmh, {derived("speed_mph")}, current_amps, voltage_volts,
  {derived("power_kw", "drivetrain_power_kw")}, distance_mi, ambient_temp_f,
  {derived("ambient_temp_c")}, battery_avg_temp_c, battery_max_temp_c, battery_min_temp_c,
  battery_coolant_temp_c, {derived("battery_temp_spread_c")}, hvac_measured_power_w,
  {derived("hvac_power_kw")}, hvac_commanded_power_w, ac_compressor_on, battery_capacity_ah,
  battery_resistance_mohm,
  {derived("instant_efficiency_mi_per_kwh", "is_moving", "is_charging", "is_regen")}, _ingested_at"""

CTE["silver"] = f"SELECT {SILVER} FROM latest WHERE {VALID}"
CTE["silver_unkeyed"] = f"SELECT {SILVER} FROM latest_unkeyed WHERE {VALID}"

# --- sessions --------------------------------------------------------------


def steps(source: str, where: str, keys: str = "vehicle_id", gap: int = 300, ts: str = "timestamp"):
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""
SELECT *, sum(is_start) OVER ({part} ORDER BY {ts} ROWS UNBOUNDED PRECEDING) AS sid FROM (
  SELECT *, cast(floor(epoch({ts})) AS bigint) - cast(floor(epoch(prev_ts)) AS bigint) AS dt,
    CASE WHEN prev_ts IS NULL OR
      cast(floor(epoch({ts})) AS bigint) - cast(floor(epoch(prev_ts)) AS bigint) > {gap}
    THEN 1 ELSE 0 END AS is_start
  FROM (SELECT *, lag({ts}) OVER ({part} ORDER BY {ts}) AS prev_ts,
               lead({ts}) OVER ({part} ORDER BY {ts}) AS next_ts
        FROM {source} WHERE {where}))"""


CTE["drive"] = steps("silver", "is_moving")
CTE["drive_unkeyed"] = steps("silver_unkeyed", "is_moving", "")
CTE["charge"] = steps("silver", "is_charging")
CTE["power_steps"] = steps("silver", "power_kw IS NOT NULL")

INSIDE = "(CASE WHEN is_start = 1 THEN 0 ELSE dt END)"
MINUTES = rnd(
    "((floor(epoch(max(timestamp))) - floor(epoch(min(timestamp)))) / 60e0)", 1
)


def trip_sql(source: str, keys: str = "vehicle_id, ", dt: str = "dt") -> str:
    return f"""
SELECT {keys} cast(sid AS bigint) AS trip_id,
  min(timestamp) AS trip_start, max(timestamp) AS trip_end,
  {MINUTES} AS duration_minutes, count(*) AS sample_count,
  {rnd("(max(distance_mi) - min(distance_mi))", 2)} AS distance_miles,
  {rnd(f"(cast(sum(CASE WHEN power_kw > 0 THEN cast(round(power_kw * 1e3) AS hugeint) * {dt} ELSE 0 END) AS double) / 3.6e6)", 3)} AS energy_consumed_kwh,
  {rnd(f"(cast(sum(CASE WHEN power_kw < 0 THEN cast(round(abs(power_kw) * 1e3) AS hugeint) * {dt} ELSE 0 END) AS double) / 3.6e6)", 3)} AS energy_regen_kwh,
  {rnd(kwh("coalesce(hvac_power_kw, 0)", dt), 3)} AS hvac_energy_kwh,
  {rnd(exact_avg("speed_mph", 1), 1)} AS avg_speed_mph, max(speed_mph) AS max_speed_mph,
  first(soc_hd ORDER BY timestamp) AS soc_start, last(soc_hd ORDER BY timestamp) AS soc_end,
  {rnd(exact_avg("ambient_temp_f", 9), 1)} AS avg_ambient_temp_f,
  {rnd(exact_avg("battery_avg_temp_c", 9), 1)} AS avg_battery_temp_c
FROM {source} GROUP BY {keys} sid"""


CTE["trip"] = trip_sql("drive")
CTE["trip_inside"] = trip_sql("drive", dt=INSIDE)
CTE["trip_unkeyed"] = trip_sql("drive_unkeyed", "")
CTE["trip_full"] = f"""
SELECT *,
  CASE WHEN energy_consumed_kwh > 0 AND distance_miles > 0.1e0
       THEN {rnd("(distance_miles / energy_consumed_kwh)", 2)} END AS efficiency_mi_per_kwh,
  {rnd("(energy_consumed_kwh - energy_regen_kwh)", 3)} AS net_energy_kwh,
  {rnd("(soc_start - soc_end)", 2)} AS soc_used
FROM trip"""


def charge_sql(dt: str = "dt") -> str:
    return f"""
SELECT vehicle_id, cast(sid AS bigint) AS session_id,
  min(timestamp) AS charge_start, max(timestamp) AS charge_end,
  {MINUTES} AS duration_minutes, count(*) AS sample_count,
  min(soc_hd) AS soc_start, max(soc_hd) AS soc_end,
  {rnd("(max(soc_hd) - min(soc_hd))", 2)} AS soc_gained,
  {rnd(exact_avg("abs(power_kw)", 3), 2)} AS avg_charge_rate_kw,
  {rnd("max(abs(power_kw))", 2)} AS peak_charge_rate_kw,
  {rnd(kwh("abs(power_kw)", dt), 3)} AS energy_added_kwh,
  {rnd(exact_avg("battery_avg_temp_c", 9), 1)} AS avg_battery_temp_c
FROM charge GROUP BY vehicle_id, sid"""


CTE["charge_session"] = charge_sql()
CTE["charge_inside"] = charge_sql(INSIDE)

# --- sources and sinks -----------------------------------------------------

add("src1", f"SELECT vehicle_id, timestamp, {MEASURES} FROM bronze")
for name in ("src1_damaged", "src2_damaged"):
    add(
        name,
        """SELECT event_id, CASE WHEN event_id % 7 = 6 THEN 'damaged' WHEN event_id % 11 = 5 THEN 'untimed' ELSE 'row' END
  AS reason, true AS has_file FROM events""",
    )
add("src3", "SELECT * FROM bronze")
add("snk3", "SELECT vehicle_id, timestamp, power_kw FROM silver")
add("snk9", "SELECT event_id, event_id % 3 <> 0 AS is_safe FROM events")
add("src2", f"SELECT vehicle_id, timestamp, {MEASURES} FROM bronze")
add(
    "src4",
    "SELECT event_id, CASE WHEN event_id % 7 <> 6 THEN date_trunc('second', ts) END AS timestamp FROM events",
)
add(
    "src5",
    "SELECT count(*) AS n_rows, count(*) AS n_ids, count(*) AS n_ingest_times, count(*) AS n_sources FROM bronze",
)
add("src6", "SELECT vehicle_id, timestamp, date, speed_mph, power_kw FROM silver")
add("snk1", f"SELECT vehicle_id, id, timestamp, {MEASURES}, _ingested_at, _source_file FROM bronze")
add(
    "snk2",
    "SELECT id, timestamp, soc, CASE WHEN id LIKE 'd%' THEN soc_hd END AS soc_hd FROM bronze",
)
add(
    "snk4",
    """SELECT vehicle_id, timestamp, soc, speed_kmh, current_amps, voltage_volts, distance_mi,
  ambient_temp_f, true AS no_id, true AS has_ingest_time FROM bronze""",
)
add("snk5", "SELECT * FROM trip_full")
add(
    "snk6",
    "SELECT *, cast(NULL AS double) AS efficiency_mi_per_kwh, cast(NULL AS double) AS soc_used FROM trip",
)
add("snk7", "SELECT * FROM trip_full")
add("snk7_stored", "SELECT * FROM trip_full")
_INSERTED = {"vehicle_id", "timestamp", "soc", "speed_kmh", "current_amps", "voltage_volts",
             "distance_mi", "ambient_temp_f"}
_BRONZE_TYPES = {
    "vehicle_id": "varchar", "id": "varchar", "timestamp": "timestamp",
    **{m.strip(): "double" for m in MEASURES.split(",")},
    "speed_kmh": "int", "ac_compressor_on": "boolean",
    "_ingested_at": "timestamp", "_source_file": "varchar",
}
add(
    "snk8",
    "SELECT "
    + ", ".join(
        n if n in _INSERTED else f"cast(NULL AS {t}) AS {n}" for n, t in _BRONZE_TYPES.items()
    )
    + " FROM bronze",
)
add(
    "snk10",
    """SELECT cast(count(*) AS bigint) AS data_rows, cast(0 AS bigint) AS files_without_header,
  cast(0 AS bigint) AS files_too_long, cast(0 AS bigint) AS stray_commas FROM bronze""",
)
add(
    "snk11",
    """SELECT count(*) AS n_objects, count(speed_kmh) AS n_speed, count(soc_hd) AS n_soc_hd,
  count(timestamp) AS n_time, cast(0 AS bigint) AS n_null FROM bronze""",
)

# --- decoding --------------------------------------------------------------

CTE["fr"] = """
SELECT event_id AS e, event_id, 'v' || ((event_id // 200) % 3) AS vehicle_id,
  make_timestamp((1704067200 + event_id) * 1000000) AS timestamp,
  cast(event_id % 20 AS int) AS slot, (event_id // 20) % 3 AS turn,
  cast((event_id * 37) % 256 AS int) AS u1, cast((event_id * 7919) % 65536 AS int) AS u2
FROM events"""

_MARKS = [
    ("6240D4", 2), ("62000D", 1), ("622885", 2), ("628334", 1), ("6243AF", 2), ("62434F", 1),
    ("624349", 1), ("62434A", 1), ("6241A4", 1), ("6241B2", 2), ("6241B1", 2), ("62451F", 1),
    ("6245F9", 2), ("624357", 2), ("4131", 2), ("4146", 1),
]
_S2 = "(CASE WHEN u2 >= 32768 THEN u2 - 65536 ELSE u2 END)"
_VALUES = [
    ("current_amps", f"{_S2} / 20e0"),
    ("speed_mph", "u1 * 0.621371e0"),
    ("voltage_volts", "u2 / 2e0"),
    ("soc", "u1 * 100e0 / 255e0"),
    ("soc_hd", "u2 * 100e0 / 65535e0"),
    ("battery_avg_temp_c", "u1 - 40e0"),
    ("battery_max_temp_c", "u1 - 40e0"),
    ("battery_min_temp_c", "u1 - 40e0"),
    ("battery_coolant_temp_c", "u1 - 40e0"),
    ("hvac_measured_power_w", f"cast({_S2} AS double)"),
    ("hvac_commanded_power_w", f"cast({_S2} AS double)"),
    ("ac_compressor_on", "CASE WHEN u1 <> 1 THEN 1e0 ELSE 0e0 END"),
    ("battery_capacity_ah", "u2 / 100e0"),
    ("battery_resistance_mohm", "u2 / 10e0"),
    ("distance_mi", "u2 * 0.621371e0"),
    ("ambient_temp_f", "(u1 - 40e0) * 9e0 / 5e0 + 32e0"),
]
SIGNALS = [n for n, _ in _VALUES]


def _case(pick) -> str:
    return "CASE slot " + " ".join(f"WHEN {i} THEN {pick(i)}" for i in range(16)) + " END"


_NUMBER = _case(lambda i: "u1" if _MARKS[i][1] == 1 else "u2")
_MARK = _case(lambda i: f"'{_MARKS[i][0]}'")
CTE["sig"] = f"""
SELECT event_id, vehicle_id, timestamp, {_case(lambda i: f"'{_VALUES[i][0]}'")} AS signal,
  {_case(lambda i: f"({_VALUES[i][1]})")} AS value
FROM fr WHERE slot < 16"""
_LENGTH = _case(lambda i: f"'{len(_MARKS[i][0]) // 2 + _MARKS[i][1]:02X}'")
_HEX = _case(lambda i: "printf('%02X', u1)" if _MARKS[i][1] == 1 else "printf('%04X', u2)")
_JUNK = """CASE slot
  WHEN 16 THEN 'OK'
  WHEN 17 THEN CASE turn WHEN 0 THEN '?' WHEN 1 THEN 'CANERROR' ELSE '?' END
  WHEN 18 THEN CASE turn WHEN 0 THEN 'SEARCHING...' ELSE '' END
  ELSE CASE turn WHEN 0 THEN '7EC622885' WHEN 1 THEN '7EC0562288502G0' ELSE '7EC0462000D6' END END"""
_JUNK_MARK = "CASE WHEN slot = 19 THEN CASE WHEN turn < 2 THEN '622885' ELSE '62000D' END END"

add("dec0", "SELECT * FROM sig")
add("dec0_strict", "SELECT * FROM sig")
add(
    "dec1",
    f"SELECT event_id, CASE WHEN slot < 16 THEN '7EC' || {_LENGTH} || {_MARK} || {_HEX} ELSE {_JUNK} END AS text FROM fr",
)
add("dec2", f"SELECT event_id, CASE WHEN slot < 16 THEN {_MARK} ELSE {_JUNK_MARK} END AS mark FROM fr")
add("dec3", f"SELECT event_id, {_MARK} AS mark, cast({_NUMBER} AS int) AS number FROM fr WHERE slot < 16")
for _key, _names in {
    "dec4": ["current_amps"],
    "dec5": ["speed_mph"],
    "dec6": ["voltage_volts"],
    "dec7": ["soc"],
    "dec8": ["soc_hd"],
    "dec9": SIGNALS[5:9],
    "dec10": SIGNALS[9:11],
    "dec11": ["ac_compressor_on"],
    "dec12": ["battery_capacity_ah"],
    "dec13": ["battery_resistance_mohm"],
    "dec14": ["distance_mi"],
    "dec15": ["ambient_temp_f"],
}.items():
    add(_key, f"SELECT * FROM sig WHERE signal IN ({', '.join(repr(n) for n in _names)})")
CTE["status"] = """
SELECT event_id, slot, turn, CASE WHEN slot < 16 OR slot = 19 THEN 'signal' WHEN slot = 16 THEN 'ok'
  WHEN slot = 17 THEN 'error' ELSE 'other' END AS status FROM fr"""
add("dec16", "SELECT event_id, status FROM status")
add(
    "dec16_report",
    "SELECT status, count(*) AS responses FROM status WHERE NOT (slot = 18 AND turn > 0) GROUP BY status",
)
add("dec17", "SELECT event_id FROM fr WHERE NOT (slot = 18 AND turn > 0)")

# --- samples and live state ------------------------------------------------


def wide(bucket: str, source: str, group: str) -> str:
    columns = ", ".join(
        f"arg_max(value, timestamp) FILTER (signal = '{s}') AS {s}" for s in SIGNALS
    )
    return f"SELECT {bucket} {columns} FROM {source} GROUP BY {group}"


_CORE = "coalesce(speed_mph, current_amps, voltage_volts, soc) IS NOT NULL"
_30S = "make_timestamp(cast(floor(epoch(timestamp) / 30) AS bigint) * 30000000)"
CTE["sample"] = f"""
SELECT * REPLACE (ac_compressor_on <> 0 AS ac_compressor_on)
FROM ({wide(f"vehicle_id, {_30S} AS moment,", "sig", "ALL")}) WHERE {_CORE}""".replace(
    "GROUP BY ALL", "GROUP BY vehicle_id, moment"
)
_SAMPLE = "vehicle_id, moment AS timestamp, " + ", ".join(SIGNALS)
add("asm1", f"SELECT {_SAMPLE} FROM sample")
_3S = "make_timestamp(cast(floor(epoch(timestamp) / 3) AS bigint) * 3000000)"
add(
    "asm2",
    f"""SELECT vehicle_id, moment AS timestamp, speed_mph, soc, current_amps, voltage_volts
FROM ({wide(f"vehicle_id, {_3S} AS moment,", "sig", "vehicle_id, moment")}) WHERE {_CORE}""",
)
add(
    "asm3",
    "SELECT vehicle_id, moment AS timestamp, cast(trunc(speed_mph * 1.60934e0) AS int) AS speed_kmh FROM sample",
)
add(
    "asm3_exact",
    "SELECT vehicle_id, moment AS timestamp, cast(round(speed_mph / 0.621371e0) AS int) AS speed_kmh FROM sample",
)
add(
    "asm4",
    """SELECT id, distance_mi * 1.60934e0 AS distance_km, false AS synced,
  distance_mi * 1.60934e0 * 0.621371e0 AS distance_mi FROM bronze""",
)
CTE["store"] = f"""
SELECT vehicle_id, id, timestamp, {MEASURES},
  cast(regexp_extract(id, '([0-9]+)$', 1) AS bigint) % 3 = 0 AS synced FROM bronze"""
add(
    "asm5",
    """SELECT count(*) AS n_rows, count(*) AS n_ids, count(*) AS n_times,
  cast(count_if(synced AND speed_kmh > 50) AS bigint) AS n_synced, count(*) AS n_flags FROM store""",
)
CTE["state"] = wide("vehicle_id,", "sig", "vehicle_id")
add("liv1", "SELECT * FROM state")
add("liv2", "SELECT vehicle_id, moment AS timestamp, current_amps * voltage_volts / 1000e0 AS power_kw FROM sample")


def live_eff(speed: str, power: str) -> str:
    return f"""CASE WHEN {power} = 0 THEN CASE WHEN {speed} <> 0 THEN -1e0 END
  WHEN {speed} / {power} < 0 OR {speed} / {power} > 20 THEN -1e0
  ELSE abs({speed} / {power}) END"""


# rint() rounds halves to even.
add(
    "liv3",
    f"SELECT vehicle_id, timestamp, {live_eff('cast(speed_kmh AS double)', 'round_even(power_kw, 0)')} AS efficiency FROM silver",
)
add(
    "liv4",
    """SELECT vehicle_id, moment AS timestamp,
  current_amps * voltage_volts / 1000e0 - hvac_measured_power_w / 1000e0 AS drivetrain_power_kw FROM sample""",
)
add(
    "liv5",
    "SELECT vehicle_id, moment AS timestamp, battery_max_temp_c - battery_min_temp_c AS battery_temp_spread_c FROM sample",
)
add(
    "liv6",
    """SELECT vehicle_id, moment AS timestamp,
  distance_mi - first(distance_mi) OVER (PARTITION BY vehicle_id ORDER BY moment) AS relative_distance
FROM sample WHERE distance_mi IS NOT NULL""",
)
add(
    "liv6_resets",
    """, reading AS (SELECT vehicle_id, moment, distance_mi FROM sample WHERE distance_mi IS NOT NULL),
reset AS (
  SELECT 'v' || ((event_id // 200) % 3) AS vehicle_id,
    make_timestamp((1704067200 + event_id) * 1000000) AS reset_at
  FROM events WHERE event_id % 150 = 75),
zero AS (
  SELECT r.vehicle_id, r.reset_at, coalesce(d.distance_mi, 0e0) AS zero
  FROM reset r ASOF LEFT JOIN reading d ON d.vehicle_id = r.vehicle_id AND d.moment <= r.reset_at)
SELECT d.vehicle_id, d.moment AS timestamp, d.distance_mi - coalesce(z.zero,
  first(d.distance_mi) OVER (PARTITION BY d.vehicle_id ORDER BY d.moment)) AS relative_distance
FROM reading d ASOF LEFT JOIN zero z ON z.vehicle_id = d.vehicle_id AND z.reset_at < d.moment""",
)
# The statement above continues the list of named subqueries.
ORACLE["liv6_resets"] = ORACLE["liv6_resets"].replace(")\n, reading AS", "),\nreading AS")
add(
    "liv_view",
    f"""SELECT *, power_kw - hvac_measured_power_w / 1000e0 AS drivetrain_power_kw,
  battery_max_temp_c - battery_min_temp_c AS battery_temp_spread_c,
  {live_eff('speed_mph', 'power_kw')} AS efficiency
FROM (SELECT *, current_amps * voltage_volts / 1000e0 AS power_kw FROM state)""",
)

# --- store -----------------------------------------------------------------

_STORE = "id, vehicle_id, timestamp, soc, speed_kmh, synced"
add("sto1", f"SELECT {_STORE} FROM store WHERE NOT synced ORDER BY timestamp NULLS FIRST, id LIMIT 250")
add("sto2", "SELECT count(*) AS pending FROM store WHERE NOT synced")
add("sto3", f"SELECT id, vehicle_id, timestamp, soc, speed_kmh, synced OR speed_kmh > 60 AS synced FROM store")
add("sto4", f"SELECT {_STORE} FROM store ORDER BY timestamp DESC NULLS LAST, id DESC LIMIT 100")
add(
    "sto5",
    f"""SELECT {_STORE} FROM store WHERE timestamp >= TIMESTAMP '2024-01-03 04:00:00'
  AND timestamp <= TIMESTAMP '2024-01-09 03:05:00'""",
)
add(
    "sto6",
    f"""SELECT {_STORE} FROM store
  WHERE timestamp IS NULL OR NOT synced OR timestamp >= TIMESTAMP '2024-01-13 12:00:00'""",
)
for _key in ("sto3", "sto6"):
    ORACLE[f"{_key}_stored"] = ORACLE[_key]
add("sto7", "SELECT count(*) AS total FROM store")
add("sto8", f"SELECT {_STORE} FROM store WHERE false")
for _key, _cols, _part in (
    ("sto9", "vehicle_id, id", "PARTITION BY vehicle_id"),
    ("sto9_fleet", "id", ""),
):
    add(
        _key,
        f"""SELECT {_cols}, cast((row_number() OVER ({_part} ORDER BY timestamp NULLS FIRST, id) + 99) // 100 AS bigint) AS batch_no
FROM store WHERE NOT synced""",
    )
add(
    "sto10",
    "SELECT cast(count_if(NOT synced) AS bigint) AS pending, cast(count_if(synced) AS bigint) AS total_synced FROM store",
)

# --- silver ----------------------------------------------------------------

_RAW = "vehicle_id, id, timestamp, soc, speed_kmh, voltage_volts, _ingested_at"
add("sil1", f"SELECT {_RAW} FROM bronze WHERE timestamp IS NOT NULL")
add("sil2", f"SELECT {_RAW} FROM latest")
add("sil2_unkeyed", f"SELECT {_RAW} FROM latest_unkeyed")
add("sil3", f"SELECT {_RAW} FROM bronze WHERE {VALID}")
for _key, _names in {
    "sil4": ("date", "hour", "day_of_week"),
    "sil5": ("speed_mph",),
    "sil6": ("power_kw",),
    "sil7": ("drivetrain_power_kw",),
    "sil8": ("ambient_temp_c",),
    "sil9": ("battery_temp_spread_c",),
    "sil10": ("hvac_power_kw",),
    "sil11": ("instant_efficiency_mi_per_kwh",),
    "sil12": ("is_moving", "is_charging", "is_regen"),
}.items():
    add(_key, f"SELECT id, {derived(*_names)} FROM bronze WHERE timestamp IS NOT NULL")
add("sil13", "SELECT * FROM silver")

# --- sessions, trips, charging ---------------------------------------------

add("ses1", "SELECT vehicle_id, timestamp, prev_ts, next_ts FROM drive")
add("ses2", "SELECT vehicle_id, timestamp, cast(is_start AS int) AS is_start FROM drive")
add("ses3", "SELECT vehicle_id, timestamp, cast(sid AS bigint) AS session_id FROM drive")
CTE["event_steps"] = steps("events", "true", "", ts="ts")
CTE["user_steps"] = steps("events", "true", "user_id", 3600, "ts")
add("ses3_events", "SELECT event_id, cast(sid AS bigint) AS session_id FROM event_steps")
add(
    "ses3_users",
    "SELECT event_id, cast(is_start AS int) AS is_start, cast(sid AS bigint) AS session_id FROM user_steps",
)
add("ses4", "SELECT vehicle_id, timestamp, speed_kmh FROM silver WHERE is_moving")
add("ses4_charging", "SELECT vehicle_id, timestamp, current_amps FROM silver WHERE is_charging")
for _key, _cols in {
    "trp1": "trip_start, trip_end, duration_minutes, sample_count",
    "trp2": "distance_miles",
    "trp3": "energy_consumed_kwh",
    "trp4": "energy_regen_kwh",
    "trp5": "hvac_energy_kwh",
    "trp6": "avg_speed_mph, max_speed_mph",
    "trp7": "soc_start, soc_end",
    "trp8": "avg_ambient_temp_f, avg_battery_temp_c",
}.items():
    add(_key, f"SELECT vehicle_id, trip_id, {_cols} FROM trip")
add("trp9", "SELECT * FROM trip")
add("trp9_inside", "SELECT * FROM trip_inside")
add("trp9_unkeyed", "SELECT * FROM trip_unkeyed")
add("trp10", "SELECT * FROM trip_full")
for _key, _cols in {
    "chg1": "charge_start, charge_end, duration_minutes, sample_count",
    "chg2": "soc_start, soc_end, soc_gained",
    "chg3": "avg_charge_rate_kw, peak_charge_rate_kw",
    "chg4": "energy_added_kwh",
    "chg5": "avg_battery_temp_c",
}.items():
    add(_key, f"SELECT vehicle_id, session_id, {_cols} FROM charge_session")
add("chg6", "SELECT * FROM charge_session")
add("chg6_inside", "SELECT * FROM charge_inside")
add(
    "trp_integrate",
    f"""SELECT vehicle_id, cast(sid AS bigint) AS session_id, {rnd(kwh("power_kw", INSIDE), 3)} AS energy_kwh
FROM power_steps GROUP BY vehicle_id, sid""",
)

# --- gold ------------------------------------------------------------------


def ratio(a: str, b: str) -> str:
    return f"({a} / nullif({b}, 0))"


def gold(keys: str) -> dict[str, str]:
    """Gold statements; ``keys`` is empty or a column list ending in a comma."""
    by = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    on = f"USING ({keys.rstrip(', ')})" if keys else "ON true"
    end = "first(%s ORDER BY timestamp, vehicle_id)"
    last = "first(%s ORDER BY timestamp DESC, vehicle_id DESC)"
    out = {}
    out["gld1"] = f"""
SELECT {keys} {exact_sum("distance_miles", 2)} AS total_miles,
  {exact_sum("energy_consumed_kwh", 3)} AS total_energy_consumed_kwh,
  {exact_sum("energy_regen_kwh", 3)} AS total_energy_regen_kwh,
  {exact_sum("net_energy_kwh", 3)} AS total_net_energy_kwh,
  {exact_sum("hvac_energy_kwh", 3)} AS total_hvac_energy_kwh,
  count(*) AS total_trips, {exact_sum("duration_minutes", 1)} AS total_driving_minutes,
  {exact_avg("efficiency_mi_per_kwh", 2)} AS avg_efficiency, max(max_speed_mph) AS top_speed_mph
FROM trip_full WHERE distance_miles > 0.1e0 {by}"""
    out["gld2"] = f"""
SELECT {keys} {exact_sum("energy_added_kwh", 3)} AS total_energy_charged_kwh,
  count(*) AS total_charge_sessions, {exact_sum("duration_minutes", 1)} AS total_charge_minutes
FROM charge_session WHERE duration_minutes > 1 {by}"""
    out["gld3"] = f"""
SELECT {keys} {end % "battery_capacity_ah"} AS initial_capacity_ah,
  {last % "battery_capacity_ah"} AS latest_capacity_ah,
  {end % "battery_resistance_mohm"} AS initial_resistance_mohm,
  {last % "battery_resistance_mohm"} AS latest_resistance_mohm
FROM silver WHERE battery_capacity_ah > 0 {by}"""
    out["gld4"] = f"""
SELECT {keys} {rnd("total_miles", 1)} AS total_miles_driven,
  {rnd("t.total_energy_consumed_kwh", 1)} AS total_energy_consumed_kwh,
  {rnd("t.total_energy_regen_kwh", 1)} AS total_energy_regen_kwh,
  {rnd("t.total_net_energy_kwh", 1)} AS total_net_energy_kwh,
  {rnd("t.total_hvac_energy_kwh", 1)} AS total_hvac_energy_kwh,
  {rnd("c.total_energy_charged_kwh", 1)} AS total_energy_charged_kwh,
  {rnd(ratio("total_miles", "t.total_net_energy_kwh"), 2)} AS lifetime_efficiency_mi_per_kwh,
  {rnd("avg_efficiency", 2)} AS avg_trip_efficiency_mi_per_kwh,
  coalesce(t.total_trips, 0) AS total_trips,
  {rnd("(total_driving_minutes / 60e0)", 1)} AS total_driving_hours,
  {rnd(ratio("total_miles", "cast(t.total_trips AS double)"), 1)} AS avg_trip_distance_miles,
  top_speed_mph, coalesce(c.total_charge_sessions, 0) AS total_charge_sessions,
  {rnd("(total_charge_minutes / 60e0)", 1)} AS total_charge_hours,
  {rnd("(" + ratio("t.total_energy_regen_kwh", "t.total_energy_consumed_kwh") + " * 100)", 1)} AS regen_recovery_pct,
  {rnd("(" + ratio("t.total_hvac_energy_kwh", "t.total_energy_consumed_kwh") + " * 100)", 1)} AS hvac_energy_pct,
  initial_capacity_ah, latest_capacity_ah,
  {rnd("(" + ratio("latest_capacity_ah", "initial_capacity_ah") + " * 100)", 1)} AS battery_capacity_retention_pct,
  initial_resistance_mohm, latest_resistance_mohm
FROM ({out["gld1"]}) t FULL JOIN ({out["gld2"]}) c {on} FULL JOIN ({out["gld3"]}) h {on}"""
    out["gld5"] = f"""
SELECT {keys} cast(trip_start AS date) AS drive_date, count(*) AS trips,
  {rnd(exact_sum("distance_miles", 2), 1)} AS miles_driven,
  {rnd(exact_sum("net_energy_kwh", 3), 2)} AS net_energy_kwh,
  {rnd(exact_sum("energy_consumed_kwh", 3), 2)} AS energy_consumed_kwh,
  {rnd(exact_sum("energy_regen_kwh", 3), 2)} AS energy_regen_kwh,
  {rnd(exact_sum("hvac_energy_kwh", 3), 2)} AS hvac_energy_kwh,
  {rnd(ratio(exact_sum("distance_miles", 2), exact_sum("net_energy_kwh", 3)), 2)} AS efficiency_mi_per_kwh,
  {rnd(exact_sum("duration_minutes", 1), 1)} AS driving_minutes,
  {rnd(exact_avg("avg_speed_mph", 1), 1)} AS avg_speed_mph,
  {rnd(exact_avg("avg_ambient_temp_f", 1), 1)} AS avg_ambient_temp_f,
  {rnd(exact_avg("avg_battery_temp_c", 1), 1)} AS avg_battery_temp_c,
  max(soc_start) AS max_soc, min(soc_end) AS min_soc
FROM trip_full WHERE distance_miles > 0.1e0 GROUP BY {keys} cast(trip_start AS date)"""

    def period(unit: str, name: str, energy: str, time: str) -> str:
        return f"""
SELECT {keys} cast(date_trunc('{unit}', drive_date) AS timestamp) AS {name},
  cast(sum(trips) AS bigint) AS trips, {rnd(exact_sum("miles_driven", 1), 1)} AS miles_driven,
  {rnd(exact_sum("net_energy_kwh", 2), 2)} AS net_energy_kwh, {energy}
  {rnd(ratio(exact_sum("miles_driven", 1), exact_sum("net_energy_kwh", 2)), 2)} AS efficiency_mi_per_kwh,
  {time}, {rnd(exact_avg("avg_speed_mph", 1), 1)} AS avg_speed_mph,
  {rnd(exact_avg("avg_ambient_temp_f", 1), 1)} AS avg_ambient_temp_f
FROM ({out["gld5"]}) GROUP BY {keys} date_trunc('{unit}', drive_date)"""

    minutes = exact_sum("driving_minutes", 1)
    out["gld6"] = period("week", "week_start", "", f"{rnd(minutes, 1)} AS driving_minutes")
    more = "".join(
        f"{rnd(exact_sum(c, 2), 2)} AS {c}, "
        for c in ("energy_consumed_kwh", "energy_regen_kwh", "hvac_energy_kwh")
    )
    out["gld7"] = period("month", "month_start", more, f"{rnd(f'({minutes} / 60e0)', 1)} AS driving_hours")
    out["gld8"] = f"""
SELECT {keys} cast(hour(trip_start) AS int) AS hour_of_day, count(*) AS trip_count,
  {rnd(exact_avg("distance_miles", 2), 1)} AS avg_distance_miles,
  {rnd(exact_avg("efficiency_mi_per_kwh", 2), 2)} AS avg_efficiency,
  {rnd(exact_avg("avg_speed_mph", 1), 1)} AS avg_speed_mph,
  {rnd(exact_avg("duration_minutes", 1), 1)} AS avg_duration_minutes
FROM trip_full WHERE distance_miles > 0.1e0 GROUP BY {keys} hour(trip_start)"""
    out["gld9"] = f"""
SELECT {keys} date AS measure_date, {rnd(exact_avg("battery_capacity_ah", 9), 2)} AS avg_capacity_ah,
  {rnd(exact_avg("battery_resistance_mohm", 9), 1)} AS avg_resistance_mohm,
  {rnd(exact_avg("battery_avg_temp_c", 9), 1)} AS avg_battery_temp_c,
  {rnd("max(battery_temp_spread_c)", 1)} AS max_temp_spread_c,
  {rnd(exact_avg("battery_coolant_temp_c", 9), 1)} AS avg_coolant_temp_c
FROM silver WHERE battery_capacity_ah > 0 GROUP BY {keys} date"""

    def buckets(col: str, edges: list, labels: list, name: str, measures: str) -> str:
        pairs = list(zip(edges, labels, strict=False))
        text = " ".join(f"WHEN {col} < {e} THEN '{t}'" for e, t in pairs)
        nums = " ".join(f"WHEN {col} < {e} THEN {i}" for i, (e, _) in enumerate(pairs, 1))
        return f"""
SELECT {keys} CASE {text} ELSE '{labels[-1]}' END AS {name}, count(*) AS trip_count,
  {rnd(exact_avg("efficiency_mi_per_kwh", 2), 2)} AS avg_efficiency_mi_per_kwh,
  {rnd(exact_avg("distance_miles", 2), 1)} AS avg_distance_miles, {measures},
  cast(CASE {nums} ELSE {len(labels)} END AS int) AS bucket_order
FROM trip_full WHERE distance_miles > 1 AND efficiency_mi_per_kwh IS NOT NULL
GROUP BY {keys} {name}, bucket_order"""

    hvac, net = exact_avg("hvac_energy_kwh", 3), exact_avg("net_energy_kwh", 3)
    out["gld10"] = buckets(
        "avg_ambient_temp_f",
        [20, 32, 50, 70, 85, 100],
        ["< 20°F", "20-32°F", "32-50°F", "50-70°F", "70-85°F", "85-100°F", "100°F+"],
        "temp_range",
        f"{rnd(hvac, 3)} AS avg_hvac_energy_kwh, {rnd(f'({ratio(hvac, net)} * 100)', 1)} AS hvac_energy_pct",
    )
    share = ratio("energy_regen_kwh", "energy_consumed_kwh")
    out["gld11"] = buckets(
        "avg_speed_mph",
        [15, 25, 35, 45, 55, 65, 75],
        [
            "< 15 mph", "15-25 mph", "25-35 mph", "35-45 mph",
            "45-55 mph", "55-65 mph", "65-75 mph", "75+ mph",
        ],
        "speed_range",
        f"{rnd(net, 2)} AS avg_net_energy_kwh, {rnd(f'(avg({share}) * 100)', 1)} AS avg_regen_pct",
    )
    return out


for _name, _sql in gold("").items():
    add(_name, _sql)
for _name, _sql in gold("vehicle_id, ").items():
    add(f"{_name}_by_vehicle", _sql)

# --- dashboard -------------------------------------------------------------

_G = gold("")
CTE["kpis"], CTE["daily"], CTE["weekly"], CTE["monthly"] = (
    _G["gld4"], _G["gld5"], _G["gld6"], _G["gld7"],
)
CTE["hourly"], CTE["health"] = _G["gld8"], _G["gld9"]
CTE["by_temp"], CTE["by_speed"] = _G["gld10"], _G["gld11"]

add("src7", "SELECT month_start, 0.12e0 AS electricity_rate_per_kwh FROM monthly")
add(
    "dsh1",
    """SELECT total_miles_driven, lifetime_efficiency_mi_per_kwh, total_net_energy_kwh, total_trips,
  total_driving_hours, avg_trip_distance_miles, top_speed_mph, regen_recovery_pct, hvac_energy_pct,
  battery_capacity_retention_pct, total_charge_sessions, total_energy_charged_kwh FROM kpis""",
)
add(
    "dsh2",
    """SELECT drive_date, efficiency_mi_per_kwh, miles_driven, net_energy_kwh, avg_ambient_temp_f
FROM daily WHERE efficiency_mi_per_kwh IS NOT NULL""",
)
add("dsh3", "SELECT week_start, efficiency_mi_per_kwh, miles_driven, trips FROM weekly")
add(
    "dsh4",
    """SELECT strftime(month_start, '%Y-%m') AS month, efficiency_mi_per_kwh, miles_driven,
  net_energy_kwh, driving_hours, trips FROM monthly""",
)
add(
    "dsh5",
    """SELECT drive_date, energy_consumed_kwh, energy_regen_kwh, hvac_energy_kwh,
  net_energy_kwh - hvac_energy_kwh AS drivetrain_energy_kwh FROM daily""",
)
_NET, _HVAC = exact_sum("net_energy_kwh", 2), exact_sum("hvac_energy_kwh", 2)
add(
    "dsh6",
    f"""SELECT {rnd(f"({_NET} - {_HVAC})", 1)} AS drivetrain_kwh, {rnd(_HVAC, 1)} AS hvac_kwh,
  {rnd(exact_sum("energy_regen_kwh", 2), 1)} AS regen_recovered_kwh FROM daily""",
)
add(
    "dsh7",
    """SELECT drive_date,
  cast(sum(cast(miles_driven AS decimal(18,1))) OVER (ORDER BY drive_date) AS double) AS cumulative_miles,
  cast(sum(cast(net_energy_kwh AS decimal(18,2))) OVER (ORDER BY drive_date) AS double) AS cumulative_energy_kwh
FROM daily""",
)
add(
    "dsh8",
    """SELECT temp_range, trip_count, avg_efficiency_mi_per_kwh, avg_hvac_energy_kwh, hvac_energy_pct
FROM by_temp""",
)
add("dsh9", "SELECT speed_range, trip_count, avg_efficiency_mi_per_kwh, avg_regen_pct FROM by_speed")
add(
    "dsh10",
    """SELECT drive_date, avg_ambient_temp_f, efficiency_mi_per_kwh, miles_driven FROM daily
WHERE efficiency_mi_per_kwh IS NOT NULL""",
)
add("dsh11", "SELECT measure_date, avg_capacity_ah, avg_resistance_mohm FROM health")
add("dsh12", "SELECT measure_date, avg_battery_temp_c, max_temp_spread_c, avg_coolant_temp_c FROM health")
add(
    "dsh13",
    "SELECT hour_of_day, trip_count, avg_distance_miles, avg_efficiency, avg_speed_mph FROM hourly",
)
add(
    "dsh14",
    f"""SELECT dayname(any_value(date)) AS day_name, day_of_week,
  count(DISTINCT date) AS days_with_driving,
  {rnd(exact_avg("instant_efficiency_mi_per_kwh", 2), 2)} AS avg_efficiency,
  {rnd(exact_avg("speed_mph", 1), 1)} AS avg_speed_mph
FROM silver WHERE is_moving GROUP BY day_of_week""",
)
add(
    "dsh15",
    f"""SELECT vehicle_id, trip_id, trip_start, trip_end, duration_minutes,
  {rnd("distance_miles", 1)} AS distance_miles, efficiency_mi_per_kwh,
  {rnd("net_energy_kwh", 2)} AS net_energy_kwh, {rnd("energy_regen_kwh", 2)} AS energy_regen_kwh,
  {rnd("hvac_energy_kwh", 2)} AS hvac_energy_kwh, {rnd("avg_speed_mph", 1)} AS avg_speed_mph,
  max_speed_mph, {rnd("soc_start", 1)} AS soc_start_pct, {rnd("soc_end", 1)} AS soc_end_pct,
  {rnd("soc_used", 1)} AS soc_used_pct, {rnd("avg_ambient_temp_f", 0)} AS ambient_temp_f,
  {rnd("avg_battery_temp_c", 0)} AS battery_temp_c
FROM trip_full WHERE distance_miles > 0.1e0""",
)
add(
    "dsh16",
    f"""SELECT vehicle_id, session_id, charge_start, charge_end, duration_minutes,
  {rnd("soc_start", 1)} AS soc_start_pct, {rnd("soc_end", 1)} AS soc_end_pct,
  {rnd("soc_gained", 1)} AS soc_gained_pct, {rnd("avg_charge_rate_kw", 1)} AS avg_charge_kw,
  {rnd("peak_charge_rate_kw", 1)} AS peak_charge_kw, {rnd("energy_added_kwh", 2)} AS energy_added_kwh,
  {rnd("avg_battery_temp_c", 0)} AS battery_temp_c
FROM charge_session WHERE duration_minutes > 1""",
)
add(
    "dsh17",
    f"""SELECT CASE WHEN soc_start < 20 THEN '0-20%' WHEN soc_start < 40 THEN '20-40%'
  WHEN soc_start < 60 THEN '40-60%' WHEN soc_start < 80 THEN '60-80%' ELSE '80-100%' END AS starting_soc_range,
  count(*) AS sessions, {rnd(exact_avg("s.avg_charge_rate_kw", 2), 1)} AS avg_charge_rate_kw,
  {rnd(exact_avg("s.peak_charge_rate_kw", 2), 1)} AS avg_peak_charge_rate_kw
FROM charge_session s WHERE duration_minutes > 5 GROUP BY starting_soc_range""",
)
add(
    "dsh18",
    """SELECT vehicle_id, timestamp, speed_mph, power_kw, soc_hd AS soc, battery_avg_temp_c,
  hvac_power_kw, instant_efficiency_mi_per_kwh
FROM silver WHERE timestamp > TIMESTAMP '2024-01-19 12:00:00'""",
)
add(
    "dsh19",
    """SELECT vehicle_id, timestamp, soc_hd AS soc, is_charging, is_moving
FROM silver WHERE timestamp > TIMESTAMP '2024-01-13 12:00:00'""",
)
add(
    "dsh20",
    f"""SELECT month_start, strftime(month_start, '%Y-%m') AS month, net_energy_kwh,
  {rnd("(net_energy_kwh * 0.12e0)", 2)} AS estimated_cost,
  {rnd(ratio("miles_driven", "net_energy_kwh"), 2)} AS efficiency,
  {rnd(ratio("miles_driven", "(net_energy_kwh * 0.12e0)"), 1)} AS miles_per_dollar,
  {rnd("(miles_driven / 30e0 * 3.5e0)", 2)} AS gas_equivalent_cost
FROM monthly""",
)

# --- verification ----------------------------------------------------------

add(
    "ver1",
    """SELECT count(*) AS total_records, min(timestamp) AS earliest, max(timestamp) AS latest,
  count(DISTINCT cast(timestamp AS date)) AS days_of_data FROM bronze""",
)
add(
    "ver2",
    f"""SELECT vehicle_id, id, timestamp, {MEASURES}, _ingested_at, _source_file FROM bronze
ORDER BY timestamp DESC NULLS LAST, id DESC LIMIT 20""",
)
add(
    "ver3",
    """SELECT 'vehicle_telemetry' AS table_name, count(*) AS rows FROM silver
UNION ALL SELECT 'trips', count(*) FROM trip
UNION ALL SELECT 'charging_sessions', count(*) FROM charge_session""",
)

# --- streams ---------------------------------------------------------------

add("str1", f"SELECT vehicle_id, timestamp, {MEASURES} FROM bronze")
add("str2", f"SELECT {_RAW} FROM latest")
add(
    "str2_first",
    "SELECT DISTINCT vehicle_id, timestamp, speed_kmh FROM bronze WHERE timestamp IS NOT NULL",
)
# What a closed stream gives is what the batch gives.
add("str3", trip_sql("drive"))
add("str3_slots", trip_sql("drive"))
add("str3_inside", "SELECT * FROM trip_inside")
add("str3_charging", charge_sql())
add(
    "str4",
    "SELECT id, timestamp, speed_kmh, false AS synced FROM store WHERE NOT synced",
)
add(
    "str4_marks",
    "SELECT cast(0 AS bigint) AS pending, cast(count(*) AS bigint) AS total_synced FROM store",
)
add("str5", "SELECT * FROM state")
add("str6", f"SELECT {_SAMPLE} FROM sample")

# Layers that follow what arrives hold what a build from scratch holds.
for _key in ("sil13", "trp9", "chg6", *(f"gld{n}" for n in range(4, 12)), "dsh14"):
    ORACLE[f"{_key}_refreshed"] = ORACLE[_key]
