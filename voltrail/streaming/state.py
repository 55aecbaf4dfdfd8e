"""Live state and sample assembly on streams."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voltrail import VEHICLE
from voltrail.operators.samples import assemble, latest_state
from voltrail.operators.telemetry import dedup_latest
from voltrail.sources.tables import list_folders, remove_folders
from voltrail.streaming.ingest import AVAILABLE_NOW


def live_state_stream(
    signals: DataFrame, path: str, checkpoint: str, keys=VEHICLE, trigger: dict | None = None
) -> StreamingQuery:
    """Write the rows that changed in each batch, under the batch's number.

    State is one row per vehicle.  A replayed batch replaces its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{path}/{batch_id}"
        )

    return (
        latest_state(signals, keys)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def live_state(spark: SparkSession, path: str, keys=VEHICLE) -> DataFrame:
    """The newest state of each vehicle."""
    written = spark.read.parquet(f"{path}/*")
    return dedup_latest(written, keys, ts=None, version="_batch").drop("_batch")


def compact_state(spark: SparkSession, path: str, keys=VEHICLE) -> int:
    """Replace the folders of all batches so far by one; returns its number.

    Run it between batches.  The merged rows take the number of the newest
    batch and are complete before any folder goes, and a reader takes the
    newest row of each vehicle, so running it again after a failure is safe.
    """
    folders = list_folders(spark, path)
    numbers = sorted(int(f) for f in folders if f.isdigit())
    if len(numbers) < 2:
        return numbers[-1] if numbers else -1
    newest = numbers[-1]
    merged = dedup_latest(spark.read.parquet(f"{path}/*"), keys, ts=None, version="_batch")
    merged.write.mode("overwrite").parquet(f"{path}/upto-{newest}")
    remove_folders(spark, path, [f for f in folders if f != f"upto-{newest}"])
    return newest


def assemble_stream(
    signals: DataFrame, delay: str, interval: str = "3 seconds", keys=VEHICLE
) -> DataFrame:
    """Samples of closed intervals; the newest ones stay open until later data."""
    return assemble(signals.withWatermark("timestamp", delay), interval, keys)
