"""Streams into tables: append, and latest copy on arrival."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voltrail import VEHICLE
from voltrail.operators.telemetry import dedup_latest, timed
from voltrail.sources.batches import BatchLog
from voltrail.sources.files import REASON, RECORD

AVAILABLE_NOW = {"availableNow": True}


def append_stream(
    df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append a stream to a parquet folder, each row once.

    Give every source its own folder and checkpoint: the folder's commit log
    covers the files of one stream only.
    """
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start(path)
    )


def drain(query: StreamingQuery) -> None:
    """Wait for a drain-and-stop stream; raises if it failed."""
    query.awaitTermination()


def bronze(spark: SparkSession, *paths: str) -> DataFrame:
    """The rows of all sources; columns that a source lacks are NULL."""
    first, *rest = [spark.read.parquet(p) for p in paths]
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


# --- latest copy on arrival ------------------------------------------------


def first_on_arrival(df: DataFrame, delay: str, keys=VEHICLE, ts: str = "timestamp") -> DataFrame:
    """Keep the first copy to arrive per key and instant, within ``delay``."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([*keys, ts])


def _arrivals(spark: SparkSession, root: str) -> BatchLog:
    return BatchLog(spark, f"{root}/bronze", ("_date",))


def _latest(spark: SparkSession, root: str, keys) -> BatchLog:
    return BatchLog(spark, f"{root}/latest", ("_date",), lambda rows: dedup_latest(rows, keys))


def latest_on_arrival(
    df: DataFrame, root: str, checkpoint: str, keys=VEHICLE, trigger: dict | None = None
) -> StreamingQuery:
    """Maintain bronze and the latest copy per key and instant below ``root``.

    Each batch is committed to two logs of batches: bronze, whose folders merge
    as they are, and the latest copies, where a merge keeps the latest copy of
    each row.  A batch writes its own rows and, over time, each row once per
    tier of the log, however many batches there were before, and lists the few
    folders its manifest names.  A replayed batch is committed once.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = timed(batch).withColumn("_date", F.to_date("timestamp")).persist()
        try:
            _arrivals(spark, root).commit(rows, batch_id)
            _latest(spark, root, keys).commit(rows, batch_id)
        finally:
            rows.unpersist()

    return (
        df.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def latest(spark: SparkSession, root: str, keys=VEHICLE, where: Column | None = None) -> DataFrame:
    """The latest copy per key and instant, with its date as ``_date``.

    The few folders of the log are compared on reading; ``where`` on key, time
    or date reaches the scan.
    """
    return _latest(spark, root, keys).read(where)


def arrived(spark: SparkSession, root: str, where: Column | None = None) -> DataFrame:
    """All copies that came in, with their date as ``_date``."""
    return _arrivals(spark, root).read(where)


def latest_when_closed(df: DataFrame, delay: str, keys=VEHICLE, ts: str = "timestamp") -> DataFrame:
    """The latest copy per key and instant, as a stream.

    A copy that arrives within ``delay`` of the newest event is taken into
    account; an instant comes out once it is older than that.
    """
    rest = [c for c in df.columns if c not in {*keys, ts}]
    version = F.struct("_ingested_at", F.struct("_source_file", "id"))
    best = F.max_by(F.struct(*rest), version)
    return (
        df.withWatermark(ts, delay).groupBy(*keys, ts).agg(best.alias("_row")).select(*keys, ts, "_row.*")
    )


# --- records set apart -----------------------------------------------------


def _quarantine(spark: SparkSession, root: str) -> BatchLog:
    return BatchLog(spark, f"{root}/quarantine")


def append_or_set_apart(
    records: DataFrame, root: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Commit good rows to bronze below ``root`` and all others to a quarantine.

    ``records`` come from ``files.csv_records`` or ``files.json_records``.  Each
    record that was read is in one of the two, once, also when a batch is
    replayed; ``arrived`` and ``set_apart`` read them.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        try:
            good = rows.filter(F.col(REASON).isNull()).drop(REASON, RECORD)
            _arrivals(spark, root).commit(good.withColumn("_date", F.to_date("timestamp")), batch_id)
            bad = rows.filter(F.col(REASON).isNotNull())
            _quarantine(spark, root).commit(
                bad.select("vehicle_id", "_ingested_at", "_source_file", REASON, RECORD), batch_id
            )
        finally:
            rows.unpersist()

    return (
        records.writeStream.foreachBatch(split)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def set_apart(spark: SparkSession, root: str) -> DataFrame:
    """The records in quarantine, with file, reason and text."""
    return _quarantine(spark, root).read()
