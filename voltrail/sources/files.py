"""Upload files as streams: each new file is read once.

``csv_stream`` and ``json_stream`` give bronze rows, with NULL for what cannot
be read.  ``csv_records`` and ``json_records`` also tell which records are not
whole: ``_reason`` is ``damaged`` where a record or one of its values cannot be
read, ``untimed`` where it has no time, and NULL for good rows; ``_record`` is
the record as it came.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltrail import schemas

# Upload file names.
CSV_GLOB = "vehicle_data_*.csv"
JSON_GLOB = "vehicle_data_*.json"

#: The columns that set a record apart.
REASON, RECORD = "_reason", "_record"
_DAMAGED = "_damaged_text"

_PATH_KEY = "vehicle_id=([^/]+)/"


def parse_time(text: Column) -> Column:
    """ISO-8601 text to a timestamp; NULL if it is not one."""
    return F.try_to_timestamp(text)


def parse_flag(text: Column) -> Column:
    """``1``/``true`` and ``0``/``false`` to a boolean; NULL otherwise."""
    word = F.lower(F.trim(text))
    return F.when(word.isin("1", "true"), True).when(word.isin("0", "false"), False)


def with_lineage(df: DataFrame) -> DataFrame:
    """Random id, ingest time and source path."""
    return df.withColumns(
        {
            "id": F.expr("uuid()"),
            "_ingested_at": F.current_timestamp(),
            "_source_file": F.col("_metadata.file_path"),
        }
    )


def vehicle_of_path() -> Column:
    """The vehicle named by a ``vehicle_id=...`` folder, NULL if there is none."""
    return F.nullif(F.regexp_extract(F.col("_metadata.file_path"), _PATH_KEY, 1), F.lit(""))


def _uploads(directory: str, glob: str) -> str:
    """Uploads right below a folder and below its vehicle folders."""
    return f"{directory}/{{{glob},vehicle_id=*/{glob}}}"


def _bronze_columns(df: DataFrame) -> DataFrame:
    return df.select(*schemas.BRONZE.fieldNames())


def csv_stream(
    spark: SparkSession,
    directory: str,
    glob: str = CSV_GLOB,
    schema: T.StructType = schemas.CSV_FILE,
    **options,
) -> DataFrame:
    """CSV uploads as bronze rows.  The schema is fixed, nothing is inferred."""
    raw = (
        spark.readStream.schema(schema)
        .options(header=True, recursiveFileLookup=True, **options)
        .csv(_uploads(directory, glob))
    )
    return _bronze_columns(_csv_rows(raw))


def _csv_rows(raw: DataFrame) -> DataFrame:
    return with_lineage(raw.withColumn("vehicle_id", vehicle_of_path())).withColumns(
        {
            "timestamp": parse_time(F.col("timestamp")),
            "ac_compressor_on": parse_flag(F.col("ac_compressor_on")),
        }
    )


def json_stream(
    spark: SparkSession, directory: str, glob: str = JSON_GLOB, **options
) -> DataFrame:
    """JSON uploads as bronze rows.

    Reads one object per line or one array per line, with either spelling of
    the keys, in the same stream.
    """
    raw = (
        spark.readStream.schema(schemas.JSON_FILE)
        .options(recursiveFileLookup=True, **options)
        .json(_uploads(directory, glob))
    )
    return _bronze_columns(_json_rows(raw))


def _json_rows(raw: DataFrame) -> DataFrame:
    measures = {
        name: F.coalesce(F.col(name), F.col(schemas.JSON_KEYS[name]))
        for name in schemas.MEASURE_NAMES
        if schemas.JSON_KEYS[name] != name
    }
    return with_lineage(raw).withColumns(
        {
            "vehicle_id": F.coalesce(F.col("vehicle_id"), vehicle_of_path()),
            "timestamp": parse_time(F.col("timestamp")),
            **measures,
        }
    )


# --- records told apart


def _told(raw: DataFrame) -> DataFrame:
    """Add why a record is set apart, and its text."""
    given = F.to_json(F.struct(*[c for c in raw.columns if c != _DAMAGED]))
    reason = F.when(F.col(_DAMAGED).isNotNull(), "damaged").when(
        parse_time(F.col("timestamp")).isNull(), "untimed"
    )
    return raw.withColumn(REASON, reason).withColumn(
        RECORD, F.when(F.col(REASON).isNotNull(), F.coalesce(_DAMAGED, given))
    )


def _told_columns(rows: DataFrame) -> DataFrame:
    return rows.select(*schemas.BRONZE.fieldNames(), REASON, RECORD)


def _with_damaged(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(_DAMAGED, T.StringType())])


def csv_records(
    spark: SparkSession,
    directory: str,
    glob: str = CSV_GLOB,
    schema: T.StructType = schemas.CSV_FILE,
    **options,
) -> DataFrame:
    """CSV uploads as bronze rows with ``_reason`` and ``_record``.

    A line with more or fewer fields than the schema, or with a value of
    another type, is damaged.
    """
    raw = (
        spark.readStream.schema(_with_damaged(schema))
        .options(header=True, recursiveFileLookup=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_DAMAGED, **options)
        .csv(_uploads(directory, glob))
    )
    return _told_columns(_csv_rows(_told(raw)))


def json_records(spark: SparkSession, directory: str, glob: str = JSON_GLOB, **options) -> DataFrame:
    """JSON uploads as bronze rows with ``_reason`` and ``_record``.

    A line that is no JSON, or holds a value of another type, is damaged.
    """
    raw = (
        spark.readStream.schema(_with_damaged(schemas.JSON_FILE))
        .options(recursiveFileLookup=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_DAMAGED, **options)
        .json(_uploads(directory, glob))
    )
    return _told_columns(_json_rows(_told(raw)))
