"""The sample store: what is pending, what is recent, what may be deleted."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail import VEHICLE
from voltrail.operators.numbering import number_rows
from voltrail.sources import tables

# Default sizes.
RECENT_ROWS = 100
SYNC_BATCH = 100


def _time(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def is_synced() -> Column:
    """The flag; a row without one is pending."""
    return F.coalesce(F.col("synced"), F.lit(False))


def pending(store: DataFrame) -> DataFrame:
    return store.filter(~is_synced())


def unsynced(store: DataFrame, n: int = SYNC_BATCH) -> DataFrame:
    """The ``n`` oldest rows not yet synced."""
    return pending(store).orderBy("timestamp", "id").limit(n)


def pending_count(store: DataFrame) -> DataFrame:
    return pending(store).agg(F.count(F.lit(1)).alias("pending"))


def mark_synced(store: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Set the flag on every row whose id is in ``ids``."""
    done = ids.select(F.col(key).alias("_done")).distinct()
    joined = store.join(done, store[key] == F.col("_done"), "left")
    return joined.withColumn("synced", is_synced() | F.col("_done").isNotNull()).drop("_done")


def recent(store: DataFrame, n: int = RECENT_ROWS) -> DataFrame:
    """The ``n`` newest rows."""
    return store.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(n)


def between(store: DataFrame, start, end) -> DataFrame:
    """Rows from ``start`` to ``end``, both included, oldest first."""
    return store.filter(F.col("timestamp").between(_time(start), _time(end))).orderBy(
        "timestamp", "id"
    )


def retain(store: DataFrame, days: int, now: datetime | Column | None = None) -> DataFrame:
    """Drop rows that are both synced and older than ``days``; keep all others."""
    at = F.current_timestamp() if now is None else _time(now)
    cutoff = at - F.make_dt_interval(F.lit(days))
    expired = (F.col("timestamp") < cutoff) & F.col("synced")
    return store.filter(~F.coalesce(expired, F.lit(False)))


def total(store: DataFrame) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("total"))


def sync_batches(store: DataFrame, n: int = SYNC_BATCH, keys=VEHICLE) -> DataFrame:
    """Pending rows with the number of the upload batch they fall in, from 1,
    oldest first per vehicle."""
    numbered = number_rows(pending(store), ["timestamp", "id"], keys)
    return numbered.withColumn("batch_no", F.ceil(F.col("row_no") / n)).drop("row_no")


def sync_status(store: DataFrame) -> DataFrame:
    """Rows still pending and rows synced."""
    return store.agg(
        F.count_if(~is_synced()).alias("pending"),
        F.count_if(is_synced()).alias("total_synced"),
    )


# --- the store as a table by date ------------------------------------------

DAY = "date"


def store_rows(store: DataFrame) -> DataFrame:
    """Rows with the date they are stored under."""
    return store.withColumn(DAY, F.to_date("timestamp"))


def mark_synced_stored(spark: SparkSession, path: str, ids: DataFrame, key: str = "id") -> list:
    """``mark_synced`` on a table stored by date: rewrites the dates that hold
    a row to mark, found by a scan of id and flag, and returns them."""
    table = tables.stored_by(spark, path)
    open_rows = pending(table).select(key, DAY).join(ids.select(key), key, "left_semi")
    days = tables.values_of(open_rows, DAY)
    if days:
        rows = tables.stored_beside(spark, path, DAY, days)
        tables.replace_partitions(mark_synced(rows, ids, key).select(*table.columns), path, DAY, days)
    return days


def retain_stored(spark: SparkSession, path: str, days: int, now: datetime | Column | None = None) -> dict[str, list]:
    """``retain`` on a table stored by date: dates of which no row is left are
    dropped whole, dates that lose some rows are rewritten, and no other file
    is touched; where days share folders, theirs are rewritten for both.  Only
    dates up to the limit are searched."""
    at = F.current_timestamp() if now is None else _time(now)
    cutoff = at - F.make_dt_interval(F.lit(days))
    table = tables.stored_by(spark, path)
    expired = F.coalesce((F.col("timestamp") < cutoff) & F.col("synced"), F.lit(False))
    counted = (
        table.filter(F.col(DAY) <= F.to_date(cutoff))
        .groupBy(DAY)
        .agg(F.count_if(expired).alias("gone"), F.count(F.lit(1)).alias("n"))
        .filter("gone > 0")
    )
    found = sorted(tuple(r) for r in counted.collect())  # a row per date
    whole = [d for d, gone, n in found if gone == n]
    some = [d for d, gone, n in found if gone < n]
    apart = tables.layout_of(spark, path, DAY).width == 1
    changed = some if apart else sorted(whole + some)
    if changed:
        rows = tables.stored_beside(spark, path, DAY, changed).filter(~expired)
        tables.replace_partitions(rows, path, DAY, changed)
    if apart:
        tables.remove_folders(spark, path, [f"{DAY}={d}" for d in whole])
    return {"dropped": whole, "rewritten": some}
