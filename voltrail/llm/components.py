"""Connected components by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.session import checkpointed


def _least_of(neighbours: DataFrame) -> DataFrame:
    """(u, v, m) where m is the least neighbour of u, or u itself.

    The minimum is combined on each task.  The join back brings the edges of a
    vertex to one task: narrow rows, at most one per member of its group, and
    after a round or two every member has the edge to its root alone.
    """
    least = neighbours.groupBy("u").agg(F.min("v").alias("m"))
    return neighbours.join(least, "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least_of(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _least_of(down)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        near.select("u", F.col("m").alias("v"))
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.crc32(F.encode(F.col("u").cast("string"), "utf-8")))).first()
    return tuple(row)


def roots(edges: DataFrame) -> DataFrame:
    """``u`` and ``v``, the least vertex of its component, for every other
    vertex of the graph with edges (u, v).  Rounds grow with the logarithm of
    the longest path; each is fixed on shared storage."""
    now = checkpointed(edges.filter("u != v").distinct())
    state = _state(now)
    while True:
        now = checkpointed(_small_star(_large_star(now).filter("u != v").distinct()).filter("u != v").distinct())
        before, state = state, _state(now)
        if state == before:
            return now
