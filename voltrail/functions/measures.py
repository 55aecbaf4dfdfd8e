"""Units, fixed-point sums and means, buckets."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit factors.
MILES_PER_KM = 0.621371
KM_PER_MILE = 1.60934


def kmh_to_mph(speed: Column) -> Column:
    return speed * MILES_PER_KM


def watts_to_kw(watts: Column) -> Column:
    return watts / 1000.0


def power_kw(amps: Column, volts: Column) -> Column:
    return amps * volts / 1000.0


def fahrenheit_to_celsius(temp: Column) -> Column:
    return (temp - 32) * 5.0 / 9.0


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, NULL where the denominator is zero."""
    return num / F.nullif(den, F.lit(0.0))


def ticks(value: Column, places: int) -> Column:
    """A decimal measure as a whole number of its last decimal place.

    The result is a decimal with room for sums over any number of rows: they
    are exact, so they do not depend on the order in which tasks deliver
    partial sums.  A value that is no finite number counts as unknown.
    """
    return F.rint(value * 10.0**places).try_cast("decimal(27,0)")


def fixed_sum(value: Column, places: int) -> Column:
    """Order-independent sum of a measure with ``places`` decimals."""
    return F.sum(ticks(value, places)).cast("double") / 10.0**places


def fixed_avg(value: Column, places: int) -> Column:
    """Order-independent mean of a measure with ``places`` decimals."""
    whole = ticks(value, places)
    return F.sum(whole).cast("double") / F.nullif(F.count(whole), F.lit(0)) / 10.0**places


def bucket(value: Column, edges: list[float]) -> Column:
    """1-based bucket number; an edge belongs to the upper bucket.

    NULL falls in the last bucket, as any value that is below no edge.
    """
    chain = reduce(
        lambda acc, e: acc.when(value < e[1], F.lit(e[0])),
        enumerate(edges[1:], 2),
        F.when(value < edges[0], F.lit(1)),
    )
    return chain.otherwise(F.lit(len(edges) + 1))


def label(order: Column, labels: list[str]) -> Column:
    """Text label of a 1-based bucket number."""
    return F.element_at(F.array(*[F.lit(t) for t in labels]), order)


def join_keyed(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on key columns where NULL keys match each other, keeping left's keys."""
    a, b = left.alias("a"), right.alias("b")
    cond = reduce(
        lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in on]
    )
    kept = [F.col(f"b.{c}") for c in right.columns if c not in on]
    return a.join(b, cond, how).select("a.*", *kept)
