"""Mixing sources to target weights.

A source's words are summed, its target follows from the weights, and the
repetition rate is target / size.  Every document is then taken floor(rate)
times, and once more with a probability equal to the fraction, decided by a
hash of its id and a seed: no random state, so reruns and retried tasks agree.

Documents are never grouped: the only aggregate is a sum per source, combined
on each task first, and it comes back to the documents as a small table.  A
source that holds a third of all rows costs the same as any other.

Defined cases: a NULL text has size 0; a NULL source is a source, the last in
order; a source without words has rate 0; repeated rows with one id are taken
alike; a NULL id is decided by its text.  An input column with the name of a
result column is replaced.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrail.llm.text import word_count
from voltrail.session import checkpointed

WEIGHTS = (1, 2, 3)
MAX_RATE = 3
SEED = "mix-1"
#: Sources up to this number go to every task; beyond it the join shuffles.
SMALL_SOURCES = 100_000
_DRAWS = 16**12


def source_rates(
    sizes: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE
) -> DataFrame:
    """``source``, ``source_size``, ``target`` and ``rate`` per source.

    Weights repeat over the sources in code point order.  A target above
    ``max_rate`` times the source's size stops there and the rest is shared by
    weight: with sources in order of max_rate * size / weight, the ones that
    stop are the first ones, and the common level of all others follows from
    what is left.  ``sizes`` has ``source`` and ``size``; everything after the
    sum has one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = totals.withColumn("_weight", F.get(F.array(*[F.lit(w) for w in weights]), turn))
    limit = max_rate * F.col("source_size")
    ordered = Window.orderBy(limit / F.col("_weight"), F.col("source").asc_nulls_last())
    upto = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(upto), F.lit(0))
    weight_left = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(upto), F.lit(0))
    levels = weighed.withColumn("_level", left / weight_left)
    # The level of the first source that stays below its limit holds for all
    # that follow; the sources before it stop at their limits.
    fits = F.col("_level") * F.col("_weight") <= limit
    level = F.min_by(F.when(fits, F.col("_level")), F.when(fits, limit / F.col("_weight"))).over(everything)
    target = F.least(limit.cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("_weight"))
    return levels.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 48 bits of a hash."""
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 12)
    return F.conv(head, 16, 10).cast("double") / float(_DRAWS)


def with_copies(
    docs: DataFrame,
    weights=WEIGHTS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Documents with ``size``, ``source_size``, ``target`` and ``copies``."""
    added = ("size", "source_size", "target", "copies")
    kept = [c for c in docs.columns if c.lower() not in added]
    size = word_count(F.col(text_col))
    sizes = docs.select(F.col(source_col).alias("source"), size.alias("size"))
    rates = checkpointed(source_rates(sizes, weights)).select(
        F.col("source").alias("__vt_source"), "source_size", "target", F.col("rate").alias("__vt_rate")
    )
    small = rates.count() <= SMALL_SOURCES
    sized = docs.withColumn("size", size).select(*kept, "size")
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.coalesce(text_col, F.lit(""))))
    whole = F.floor("__vt_rate")
    again = (draw(key, seed) < F.col("__vt_rate") - whole).cast("long")
    joined = sized.join(
        F.broadcast(rates) if small else rates, F.col(source_col).eqNullSafe(F.col("__vt_source")), "left"
    )
    return joined.select(*kept, "size", "source_size", "target", (whole + again).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken.

    ``copy`` counts from 1.
    """
    taken = with_copies(docs, **options).filter("copies > 0")
    kept = [c for c in taken.columns if c.lower() != "copy"]
    return taken.select(*kept, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """Per document: its size, its source's size and target, words taken."""
    narrow = docs.select("doc_id", "source", "text")
    return with_copies(narrow, **options).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )
