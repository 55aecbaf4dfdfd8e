"""Upload loop: drain new samples into files, batch by batch."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voltrail.operators.store import SYNC_BATCH, mark_synced, pending
from voltrail.sources.batches import BatchLog
from voltrail.sources.exports import export_csv, export_json
from voltrail.streaming.ingest import AVAILABLE_NOW

# Fixed value: seconds between automatic uploads.
AUTO_SYNC_SECONDS = 300
EVERY_SYNC = {"processingTime": f"{AUTO_SYNC_SECONDS} seconds"}

_WRITERS = {"csv": export_csv, "json": export_json}


def upload_log(spark: SparkSession, marks: str) -> BatchLog:
    """The ids of every committed upload."""
    return BatchLog(spark, marks, facts={"min_id": F.min("id"), "max_id": F.max("id")})


def sync_stream(
    samples: DataFrame,
    directory: str,
    checkpoint: str,
    fmt: str = "csv",
    batch: int = SYNC_BATCH,
    trigger: dict | None = None,
    marks: str | None = None,
) -> StreamingQuery:
    """Write pending samples as upload files of at most ``batch`` rows.

    A row counts as synced once the upload that holds it is committed.  The
    upload is named after the batch number, so a batch that is repeated after a
    failure replaces its own files.  Once its files are written, the ids of a
    batch are committed to the log below ``marks``, with the upload's name,
    number of rows and range of ids; ``with_marks`` reads committed ids only.
    Pass ``EVERY_SYNC`` as the trigger to keep uploading.
    """
    write = _WRITERS[fmt]

    def upload(rows: DataFrame, batch_id: int) -> None:
        name = f"vehicle_data_{batch_id:012d}.{fmt}"
        write(rows, f"{directory}/{name}", batch)
        if marks:
            upload_log(rows.sparkSession, marks).commit(rows.select("id"), batch_id, upload=name)

    return (
        pending(samples)
        .writeStream.foreachBatch(upload)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def with_marks(store: DataFrame, marks: str) -> DataFrame:
    """The store with every uploaded row marked as synced."""
    ids = upload_log(store.sparkSession, marks).read()
    return mark_synced(store, ids) if ids.columns else store
