"""Declared schemas of the telemetry tables and upload files."""

from pyspark.sql import types as T

# Measurement columns and their types, in file order.
MEASURES = (
    ("soc", T.DoubleType(), "Displayed state of charge (%)"),
    ("speed_kmh", T.IntegerType(), "Vehicle speed (km/h)"),
    ("current_amps", T.DoubleType(), "Battery current, signed (A)"),
    ("voltage_volts", T.DoubleType(), "Battery voltage (V)"),
    ("distance_mi", T.DoubleType(), "Odometer since codes were cleared (mi)"),
    ("ambient_temp_f", T.DoubleType(), "Ambient temperature (F)"),
    ("soc_hd", T.DoubleType(), "High-resolution state of charge (%)"),
    ("battery_avg_temp_c", T.DoubleType(), "Mean battery temperature (C)"),
    ("battery_max_temp_c", T.DoubleType(), "Highest battery temperature (C)"),
    ("battery_min_temp_c", T.DoubleType(), "Lowest battery temperature (C)"),
    ("battery_coolant_temp_c", T.DoubleType(), "Battery coolant temperature (C)"),
    ("hvac_measured_power_w", T.DoubleType(), "Climate power drawn (W)"),
    ("hvac_commanded_power_w", T.DoubleType(), "Climate power requested (W)"),
    ("ac_compressor_on", T.BooleanType(), "Compressor running"),
    ("battery_capacity_ah", T.DoubleType(), "Battery capacity (Ah)"),
    ("battery_resistance_mohm", T.DoubleType(), "Battery resistance (mOhm)"),
)
MEASURE_NAMES = tuple(name for name, _, _ in MEASURES)

# JSON upload keys, by column name.
JSON_KEYS = {
    "id": "id",
    "timestamp": "timestamp",
    "soc": "soc",
    "speed_kmh": "speedKmh",
    "current_amps": "currentAmps",
    "voltage_volts": "voltageVolts",
    "distance_mi": "distanceMi",
    "ambient_temp_f": "ambientTempF",
    "soc_hd": "socHD",
    "battery_avg_temp_c": "batteryAvgTempC",
    "battery_max_temp_c": "batteryMaxTempC",
    "battery_min_temp_c": "batteryMinTempC",
    "battery_coolant_temp_c": "batteryCoolantTempC",
    "hvac_measured_power_w": "hvacMeasuredPowerW",
    "hvac_commanded_power_w": "hvacCommandedPowerW",
    "ac_compressor_on": "acCompressorOn",
    "battery_capacity_ah": "batteryCapacityAh",
    "battery_resistance_mohm": "batteryResistanceMOhm",
    "synced": "syncedToDatabricks",
}

# The columns a direct SQL insert fills.
INSERT_COLUMNS = (
    "timestamp", "soc", "speed_kmh", "current_amps",
    "voltage_volts", "distance_mi", "ambient_temp_f",
)

_MEASURE_FIELDS = [T.StructField(n, t, True, {"comment": c}) for n, t, c in MEASURES]

#: Bronze, preceded by the vehicle key this library adds to every table.
BRONZE = T.StructType(
    [
        T.StructField("vehicle_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        *_MEASURE_FIELDS,
        T.StructField("_ingested_at", T.TimestampType()),
        T.StructField("_source_file", T.StringType()),
    ]
)

#: CSV upload: 17 columns.  Times and flags arrive as text and are parsed on
#: read, because the writer spells flags ``1``/``0``.
CSV_FILE = T.StructType(
    [T.StructField("timestamp", T.StringType())]
    + [
        T.StructField(n, T.StringType() if isinstance(t, T.BooleanType) else t)
        for n, t, _ in MEASURES
    ]
)

#: JSON upload: both key spellings are accepted.
JSON_FILE = T.StructType(
    [T.StructField("vehicle_id", T.StringType()), T.StructField("timestamp", T.StringType())]
    + [T.StructField(n, t) for n, t, _ in MEASURES]
    + [
        T.StructField(JSON_KEYS[n], t)
        for n, t, _ in MEASURES
        if JSON_KEYS[n] != n
    ]
)

#: Raw device responses and decoded signals.
FRAMES = T.StructType(
    [
        T.StructField("vehicle_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("raw", T.StringType()),
    ]
)
SIGNALS = T.StructType(
    [
        T.StructField("vehicle_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("signal", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
