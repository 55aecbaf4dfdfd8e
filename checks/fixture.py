"""Telemetry derived from an ``events`` table, for checks and benchmarks.

Every event becomes one bronze row; blocks of 200 events are one drive or one
charge, 13 hours apart, spread over three vehicles.  Every 50th row arrives
twice, the second copy later and corrected.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail import schemas

EPOCH_2024 = 1704067200


def _index():
    return F.col("event_id")


def _block():
    return F.expr("event_id div 200")


def _vehicle():
    return F.concat(F.lit("v"), (_block() % 3).cast("string"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def bronze(events: DataFrame) -> DataFrame:
    """Bronze rows in the declared column order."""
    e, block, value = _index(), _block(), F.col("value")
    place, charging, tenth = e % 200, block % 4 == 3, e % 10 == 0

    def every_tenth(reading):
        return F.when(tenth, reading)

    seconds = F.lit(EPOCH_2024) + block * 46800 + place * 3
    t0 = F.timestamp_seconds(seconds)
    avg_temp = (20 + block % 15).cast("double")
    copies = F.explode(F.when(e % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    copy = F.col("copy")
    base = events.select(
        _vehicle().alias("vehicle_id"),
        F.concat(F.lit("s-"), e.cast("string")).alias("id"),
        F.when(e % 103 != 102, t0).alias("timestamp"),
        every_tenth(50 + place * 0.1).alias("soc"),
        F.when(e % 97 == 96, 250)
        .when(charging, 0)
        .otherwise(20 + (e * 7) % 80)
        .cast("int")
        .alias("speed_kmh"),
        F.when(charging, -(2.0 + value / 4.0)).otherwise(value / 2.0 - 20.0).alias("current_amps"),
        F.when(e % 101 == 100, F.lit(500.0))
        .otherwise((350 + e % 40).cast("double"))
        .alias("voltage_volts"),
        (1000.0 + e * 0.02).alias("distance_mi"),
        (10 + (block * 37) % 100).cast("double").alias("ambient_temp_f"),
        every_tenth(F.when(charging, 20.0 + place * 0.3).otherwise(90.0 - place * 0.1)).alias("soc_hd"),
        every_tenth(avg_temp).alias("battery_avg_temp_c"),
        every_tenth(avg_temp + (e % 7) * 0.5).alias("battery_max_temp_c"),
        every_tenth(avg_temp - (e % 6) * 0.5).alias("battery_min_temp_c"),
        every_tenth(avg_temp - 2.0).alias("battery_coolant_temp_c"),
        every_tenth((500 + e % 1500).cast("double")).alias("hvac_measured_power_w"),
        every_tenth((600 + e % 1500).cast("double")).alias("hvac_commanded_power_w"),
        every_tenth(e % 20 == 0).alias("ac_compressor_on"),
        F.when(place == 0, 180.0 - block * 0.05).alias("battery_capacity_ah"),
        F.when(place == 0, 100.0 + block * 0.1).alias("battery_resistance_mohm"),
        F.timestamp_seconds(seconds + 3600).alias("_ingested_at"),
        F.concat(F.lit("vehicle_data_"), block.cast("string"), F.lit(".csv")).alias("_source_file"),
        copies.alias("copy"),
    )
    return base.withColumns(
        {
            "id": F.concat(F.when(copy == 1, "d").otherwise(""), "id"),
            "soc": F.col("soc") + copy * 0.5,
            "_ingested_at": F.timestamp_seconds(F.unix_timestamp("_ingested_at") + copy * 3600),
        }
    ).select(*schemas.BRONZE.fieldNames())


# Response marks by slot of the frame cycle, with payload bytes.
_FRAME_MARKS = (
    ("6240D4", 2), ("62000D", 1), ("622885", 2), ("628334", 1), ("6243AF", 2),
    ("62434F", 1), ("624349", 1), ("62434A", 1), ("6241A4", 1), ("6241B2", 2),
    ("6241B1", 2), ("62451F", 1), ("6245F9", 2), ("624357", 2), ("4131", 2),
    ("4146", 1),
)


def frames(events: DataFrame) -> DataFrame:
    """One raw response per event and second.

    Of every 20 responses 16 carry a known number; the others are status
    texts, blanks and damaged responses.
    """
    e = _index()
    slot = e % 20

    def hex_of(value, digits):
        return F.lpad(F.hex(value), digits, "0")

    marks = F.array(
        *[F.struct(F.lit(m).alias("mark"), F.lit(n).alias("size")) for m, n in _FRAME_MARKS]
    )
    known = F.get(marks, slot.cast("int"))
    mark, size = known["mark"], known["size"]
    number = F.when(size == 1, (e * 37) % 256).otherwise((e * 7919) % 65536)
    length = hex_of((F.length(mark) / 2).cast("int") + size, 2)
    body = F.concat(length, mark, F.lpad(F.hex(number), 2 * size, F.lit("0")))
    spaced = F.concat(F.lit("7EC "), F.regexp_replace(body, "(..)", "$1 "), F.lit("\r"))
    text = (
        F.when(e % 3 == 1, spaced)
        .when(e % 3 == 2, F.concat(F.lit("7EC"), body, F.lit("\r\n")))
        .otherwise(F.concat(F.lit("7EC"), body))
    )
    turn = (e / 20).cast("long") % 3
    junk = (
        F.when(slot == 16, "OK\r")
        .when(slot == 17, F.element_at(F.array(F.lit("?"), F.lit("CAN ERROR"), F.lit("?\r")), (turn + 1).cast("int")))
        .when(slot == 18, F.element_at(F.array(F.lit("SEARCHING..."), F.lit(" \r\n"), F.lit("")), (turn + 1).cast("int")))
        .otherwise(F.element_at(F.array(F.lit("7EC622885"), F.lit("7EC0562288502G0"), F.lit("7EC0462000D6")), (turn + 1).cast("int")))
    )
    return events.select(
        "event_id",
        _vehicle().alias("vehicle_id"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + e).alias("timestamp"),
        F.when(slot < 16, text).otherwise(junk).alias("raw"),
    )


def resets(events: DataFrame) -> DataFrame:
    """A distance reset of the driving vehicle every 150 events."""
    return events.filter(_index() % 150 == 75).select(
        _vehicle().alias("vehicle_id"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + _index()).alias("reset_at"),
    )


def store(bronze: DataFrame) -> DataFrame:
    """Bronze rows as a sample store in which every third row is synced."""
    number = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    return bronze.drop("_ingested_at", "_source_file").withColumn("synced", number % 3 == 0)
