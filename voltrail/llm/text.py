"""Words and tables, as all operators of this package read them."""

import contextlib
import ctypes
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but these blanks.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"
WORD_RE = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """The text, empty where it is NULL."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """All words of a text in order, as an array."""
    return F.filter(F.split(whole(text), f"[{BLANKS}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo ``n``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


#: Rows and bytes that a Python worker gets at once; texts may be very long.
BATCH_ROWS = 1_000
BATCH_BYTES = "16m"


def bounded_batches(df: DataFrame) -> None:
    """Bound the batches that Python workers get from this session."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """Return memory that a Python worker has freed to the system; a worker is
    used again by later stages, which should not find it taken."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some systems can
        ctypes.CDLL(None).malloc_trim(0)
