"""Upload files: CSV and JSON in the form the ingest side reads."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltrail import VEHICLE, schemas
from voltrail.operators.store import SYNC_BATCH

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def iso_time(ts: str = "timestamp") -> Column:
    """Whole seconds in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), ISO_SECONDS)


def upload_path(directory: str, fmt: str, at: datetime) -> str:
    """Path of one upload.  The stamp has no colons, which some file systems
    refuse."""
    return f"{directory}/vehicle_data_{at:%Y%m%dT%H%M%SZ}.{fmt}"


def csv_rows(samples: DataFrame) -> DataFrame:
    """The 17 file columns, after any vehicle key; flags as 1/0."""

    def cell(name: str, dtype: T.DataType) -> Column:
        flag = isinstance(dtype, T.BooleanType)
        return F.col(name).cast("int").alias(name) if flag else F.col(name)

    lead = [c for c in VEHICLE if c in samples.columns]
    return samples.select(
        *lead, iso_time().alias("timestamp"), *[cell(n, t) for n, t, _ in schemas.MEASURES]
    )


def export_csv(samples: DataFrame, path: str, batch: int = SYNC_BATCH, ordered: bool = True):
    """Write files of at most ``batch`` rows, oldest first, each with a header.

    The file form has no vehicle column; a fleet's rows go to one
    ``vehicle_id=...`` folder per vehicle, which the ingest side reads back.
    """
    rows = csv_rows(samples)
    lead = [c for c in VEHICLE if c in rows.columns]
    rows = rows.orderBy(*lead, "timestamp") if ordered else rows
    rows.write.mode("overwrite").partitionBy(*lead).options(
        header=True, nullValue="", emptyValue="", maxRecordsPerFile=batch
    ).csv(path)


def json_rows(samples: DataFrame) -> DataFrame:
    """The JSON keys.  The vehicle key is added when there is one."""
    lead = [c for c in ("vehicle_id",) if c in samples.columns]
    synced = F.coalesce("synced", F.lit(False)) if "synced" in samples.columns else F.lit(False)
    return samples.select(
        *lead,
        F.col("id"),
        iso_time().alias("timestamp"),
        *[F.col(n).alias(schemas.JSON_KEYS[n]) for n in schemas.MEASURE_NAMES],
        synced.alias(schemas.JSON_KEYS["synced"]),
    )


def export_json(samples: DataFrame, path: str, batch: int = SYNC_BATCH, ordered: bool = True):
    """Write files of at most ``batch`` objects; NULL keys are left out."""
    rows = json_rows(samples)
    rows = rows.orderBy("timestamp") if ordered else rows
    rows.write.mode("overwrite").options(
        ignoreNullFields=True, maxRecordsPerFile=batch
    ).json(path)
