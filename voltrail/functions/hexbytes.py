"""Hex text to numbers, with Spark's own string functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_frame(raw: Column) -> Column:
    """Remove blanks and line ends."""
    return F.regexp_replace(raw, "[ \\r\\n]", "")


def payload_after(text: Column, mark: Column, digits: Column) -> Column:
    """The ``digits`` hex characters that follow the first ``mark``.

    NULL if the text ends too early or holds anything but hex digits there.
    """
    cut = F.substr(text, F.position(mark, text) + F.length(mark), digits)
    whole = (F.length(cut) == digits) & cut.rlike("^[0-9A-Fa-f]+$")
    return F.when(whole, cut)


def hex_to_int(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("int")


def signed16(value: Column) -> Column:
    """Two's complement of a 16-bit value: the high byte carries the sign."""
    return F.when(value >= 32768, value - 65536).otherwise(value)
