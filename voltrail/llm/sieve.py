"""A bitmap of bounded size that lets few rows of a large table through.

Before a join with a small part of a large table's keys, the keys are marked
in a bitmap; rows whose mark is missing cannot match and need not be shuffled.
The bitmap has at most ``MOST_BITS`` bits whatever the number of keys: with
more keys it lets more rows through, and the join that follows decides.
"""

import weakref

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27  # 16 MB at most
_BLOCK = 32_768  # bits in one of Spark's bitmaps


_MADE: weakref.WeakSet = weakref.WeakSet()


def release() -> None:
    """Give back the bitmaps made so far, on the driver and on all executors.
    Call it once every table that tests against them is written."""
    while _MADE:
        _MADE.pop().destroy()


class Sieve:
    def __init__(self, spark, bits: int, bitmap: np.ndarray):
        self.bits = bits
        self._shared = spark.sparkContext.broadcast(bitmap)
        _MADE.add(self._shared)

    @classmethod
    def of(cls, keys: DataFrame, *columns: str) -> "Sieve":
        """Mark all keys; columns of a table that is stored."""
        n = keys.count()
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, 16 * n - 1).bit_length()))
        bit = F.pmod(F.xxhash64(*columns), F.lit(bits)) + 1
        blocks = (
            keys.select(bit.alias("bit"))
            .groupBy(F.bitmap_bucket_number("bit").alias("block"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
            .collect()
        )
        bitmap = np.zeros(bits // 8, dtype=np.uint8)
        for block, part in blocks:
            at = (block - 1) * _BLOCK // 8
            bitmap[at : at + _BLOCK // 8] = np.frombuffer(part, dtype=np.uint8)
        return cls(keys.sparkSession, bits, bitmap)

    def may_hold(self, *columns) -> Column:
        """False only for rows whose key was not marked."""
        shared = self._shared

        @F.pandas_udf("boolean")
        def test(bit: pd.Series) -> pd.Series:
            b = bit.to_numpy()
            return pd.Series((shared.value[b >> 3] >> (b & 7)) & 1 == 1)

        return test(F.pmod(F.xxhash64(*columns), F.lit(self.bits)))
