"""Raw diagnostic responses to decoded signals."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrail.functions.hexbytes import hex_to_int, payload_after, signed16, strip_frame
from voltrail.functions.measures import MILES_PER_KM


@dataclass(frozen=True)
class Signal:
    """How one response is recognised and scaled.

    The value is ``(number - offset) * factor / divisor + shift``, in that
    order, of the payload read as an unsigned or two's complement number; a
    ``flag`` is 1.0 for every number but 1.
    """

    name: str
    mark: str
    size: int  # payload bytes
    signed: bool = False
    flag: bool = False
    offset: float = 0.0
    factor: float = 1.0
    divisor: float = 1.0
    shift: float = 0.0


# Response marks, payload sizes and scales.  The first mark that
# a response contains decides, so the order is part of the format.
SIGNALS = (
    Signal("current_amps", "6240D4", 2, signed=True, divisor=20.0),
    Signal("speed_mph", "62000D", 1, factor=MILES_PER_KM),
    Signal("voltage_volts", "622885", 2, divisor=2.0),
    Signal("soc", "628334", 1, factor=100.0, divisor=255.0),
    Signal("soc_hd", "6243AF", 2, factor=100.0, divisor=65535.0),
    Signal("battery_avg_temp_c", "62434F", 1, offset=40.0),
    Signal("battery_max_temp_c", "624349", 1, offset=40.0),
    Signal("battery_min_temp_c", "62434A", 1, offset=40.0),
    Signal("battery_coolant_temp_c", "6241A4", 1, offset=40.0),
    Signal("hvac_measured_power_w", "6241B2", 2, signed=True),
    Signal("hvac_commanded_power_w", "6241B1", 2, signed=True),
    Signal("ac_compressor_on", "62451F", 1, flag=True),
    Signal("battery_capacity_ah", "6245F9", 2, divisor=100.0),
    Signal("battery_resistance_mohm", "624357", 2, divisor=10.0),
    Signal("distance_mi", "4131", 2, factor=MILES_PER_KM),
    Signal("ambient_temp_f", "4146", 1, offset=40.0, factor=9.0, divisor=5.0, shift=32.0),
)
SIGNAL_NAMES = tuple(s.name for s in SIGNALS)

# In strict mode a mark must follow the responder id and the length byte.
_STRICT_HEAD = "^7E[0-9A-F]0[0-9A-F]"
_STRICT_PLACE = 6


def _rules(signals) -> Column:
    """The dictionary of signals as one constant array."""
    return F.array(
        *[
            F.struct(
                F.lit(s.name).alias("name"),
                F.lit(s.mark).alias("mark"),
                F.lit(2 * s.size).alias("digits"),
                F.lit(s.signed).alias("signed"),
                F.lit(s.flag).alias("flag"),
                F.lit(s.offset).alias("offset"),
                F.lit(s.factor).alias("factor"),
                F.lit(s.divisor).alias("divisor"),
                F.lit(s.shift).alias("shift"),
            )
            for s in signals
        ]
    )


def clean_frames(frames: DataFrame) -> DataFrame:
    return frames.withColumn("text", strip_frame(F.col("raw")))


def _with_rule(frames: DataFrame, strict: bool, signals) -> DataFrame:
    """Add the cleaned text and the ``rule`` of the first mark it contains.

    The rule comes from a generator, which the optimizer does not merge with
    what stands above it: the text is cleaned once and the dictionary searched
    once per row, however many columns are read from the rule.
    """
    text = F.col("text")
    if strict:
        test = lambda r: F.substr(text, F.lit(_STRICT_PLACE), F.length(r["mark"])) == r["mark"]
        rules = F.when(text.rlike(_STRICT_HEAD), _rules(signals))
    else:
        test = lambda r: F.contains(text, r["mark"])
        rules = _rules(signals)
    first = F.slice(F.filter(rules, test), 1, 1)
    return clean_frames(frames).select("*", F.explode_outer(first).alias("rule"))


def dispatch_frames(frames: DataFrame, strict: bool = False, signals=SIGNALS) -> DataFrame:
    """Add the cleaned text and the recognised mark."""
    return _with_rule(frames, strict, signals).withColumn("mark", F.col("rule.mark")).drop("rule")


def _numbered(frames: DataFrame, strict: bool, signals) -> DataFrame:
    found = _with_rule(frames, strict, signals).filter(F.col("rule").isNotNull())
    payload = payload_after(F.col("text"), F.col("rule.mark"), F.col("rule.digits"))
    return found.withColumn("number", hex_to_int(payload)).filter(F.col("number").isNotNull())


def payload_numbers(frames: DataFrame, strict: bool = False, signals=SIGNALS) -> DataFrame:
    """Recognised responses with the unsigned ``number`` in their payload.

    A response is looked at for one signal only: if its payload is short or
    not hex, the row drops out and no other mark in the text is tried.
    """
    return _numbered(frames, strict, signals).withColumn("mark", F.col("rule.mark")).drop("rule")


def _scaled() -> Column:
    rule, number = F.col("rule"), F.col("number")
    read = F.when(rule["signed"], signed16(number)).otherwise(number)
    value = (read - rule["offset"]) * rule["factor"] / rule["divisor"] + rule["shift"]
    return F.when(rule["flag"], (number != 1).cast("double")).otherwise(value)


def decode_frames(frames: DataFrame, strict: bool = False, signals=SIGNALS) -> DataFrame:
    """One row per decoded signal; responses that decode to nothing drop out."""
    keep = [c for c in frames.columns if c != "raw"]
    return _numbered(frames, strict, signals).select(
        *keep, F.col("rule.name").alias("signal"), _scaled().alias("value")
    )


def response_status(frames: DataFrame, strict: bool = False) -> DataFrame:
    """Classify responses: ``signal`` for a recognised one, else by content."""
    raw = F.col("raw")
    plain = (
        F.when(raw.contains("OK"), "ok")
        .when(raw.contains("?") | raw.contains("ERROR"), "error")
        .otherwise("other")
    )
    found = dispatch_frames(frames, strict)
    return found.withColumn(
        "status", F.when(F.col("mark").isNotNull(), "signal").otherwise(plain)
    )


def decode_quality(frames: DataFrame, strict: bool = False) -> DataFrame:
    """Responses per status."""
    return response_status(present(frames), strict).groupBy("status").agg(
        F.count(F.lit(1)).alias("responses")
    )


def present(frames: DataFrame) -> DataFrame:
    """Drop responses that are empty after trimming white space."""
    return frames.filter(F.trim(F.regexp_replace("raw", "\\s", " ")) != "")
