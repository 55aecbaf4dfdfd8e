"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one failure bit per rule, so that a policy - a named, versioned set of
rules - is a mask over stored bits: a new policy or an ablation reads the
ledger and never the texts.

Everything is Spark SQL; a document's work stays in its row and nothing is
shuffled before the ablation, which groups by bit pattern with a partial
aggregate on each task.

Defined cases: a NULL text counts as empty and fails ``few_words``; repeated
rows each get their row; a NULL id is kept as it is; other input columns are
ignored, whatever their names.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrail.llm.text import BLANKS, whole, words

WINDOW = 5

# Symbols counted, limits of the two base rules.
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_letters", "n_upper", "n_marks", "n_distinct_words",
)


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for a document that breaks the rule."""

    name: str
    fails: Callable[[], Column]


def _c(name: str) -> Column:
    return F.col(name)


#: The position of a rule is its bit; new rules are added at the end.
RULES = (
    Rule("few_words", lambda: _c("n_words") < MIN_WORDS),
    Rule("repeated_words", lambda: 100 * _c("n_repeat_words") > MAX_REPEAT_PERCENT * _c("n_words")),
    Rule("symbols", lambda: 5 * _c("n_symbols") > _c("n_words")),
    Rule("repeated_lines", lambda: 2 * _c("n_dup_lines") > _c("n_lines")),
    Rule("few_letters", lambda: 2 * _c("n_letters") < _c("word_chars")),
    Rule("capitals", lambda: 5 * _c("n_upper") > 4 * _c("n_letters")),
    Rule("exclamation", lambda: 2 * _c("n_marks") > _c("n_words")),
    Rule("word_length", lambda: (_c("word_chars") < 2 * _c("n_words")) | (_c("word_chars") > 25 * _c("n_words"))),
    Rule("few_distinct_words", lambda: 20 * _c("n_distinct_words") < _c("n_words")),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of the rules that count."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in dict.fromkeys(self.rules))


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", tuple(BIT)))}


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and every measurement."""
    text = whole(F.col(text_col))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        text.alias("_text"),
        F.transform(words(text), lambda x: F.xxhash64(x)).alias("_words"),
    )
    w, t = F.col("_words"), F.col("_text")
    last = F.size(w) - WINDOW
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{BLANKS}]"))
    joined = F.regexp_replace(t, f"[{BLANKS}]+", "")
    facts = base.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        F.transform(
            starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
        ).alias("_windows"),
        lines.alias("_lines"),
        joined.alias("_joined"),
    )
    j = F.col("_joined")

    def chars(kind: str) -> Column:
        """Characters of a class, counted by taking its runs out."""
        return (F.length(j) - F.length(F.regexp_replace(j, f"{kind}+", ""))).cast("long")

    counted = facts.select(
        "doc_id",
        "n_words",
        "n_distinct_words",
        "_windows",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.length(j).cast("long").alias("word_chars"),
        chars(SYMBOLS).alias("n_symbols"),
        chars("\\p{L}").alias("n_letters"),
        chars("\\p{Lu}").alias("n_upper"),
        chars("[!?]").alias("n_marks"),
        (F.size(F.array_distinct("_windows")) < F.size("_windows")).alias("_repeats"),
    )
    # Sorting (hash, place) pairs brings equal windows side by side; only texts
    # that have any get this far.  Their places, in order, each add the words
    # that the place before has not covered.
    by_hash = F.sort_array(
        F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    pairs = counted.withColumn("_pairs", F.when(F.col("_repeats"), by_hash))
    p, n = F.col("_pairs"), F.size("_pairs")

    def has_equal(x: Column, k: Column) -> Column:
        before = (k > 0) & (F.get(p, k - 1)["h"] == x["h"])
        return before | ((k + 1 < n) & (F.get(p, k + 1)["h"] == x["h"]))

    places = F.array_sort(F.transform(F.filter(p, has_equal), lambda x: x["i"]))
    placed = pairs.withColumn("_places", places)
    at = F.col("_places")
    gains = F.transform(
        at, lambda x, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get(at, k - 1)))
    )
    total = F.coalesce(F.aggregate(gains, F.lit(0), lambda a, x: a + x), F.lit(0))
    return placed.withColumn("n_repeat_words", total.cast("long")).select("doc_id", *MEASURES)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``failures``, one bit per broken rule."""
    bits = [F.when(r.fails(), F.lit(BIT[r.name])).otherwise(F.lit(0)) for r in RULES]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return measure(docs, id_col, text_col).withColumn("failures", mask.cast("long"))


def passes(policy: Policy) -> Column:
    return F.col("failures").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policies(entries: DataFrame, policies=tuple(POLICIES.values())) -> DataFrame:
    """Add ``kept_<version>`` for each policy."""
    return entries.withColumns({f"kept_{p.version}": passes(p) for p in policies})


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: what it fails, and what it alone fails.

    Documents are first counted per bit pattern, so all that follows reads at
    most one row per pattern that occurs.
    """
    masked = F.col("failures").bitwiseAND(F.lit(policy.mask).cast("long"))
    patterns = entries.groupBy(masked.alias("_bits")).agg(F.count(F.lit(1)).alias("_n"))
    rules = F.array(
        *[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules]
    )
    spread = patterns.select("_bits", "_n", F.inline(rules))
    hit = F.col("_bits").bitwiseAND(F.col("bit")) != 0
    return spread.groupBy("rule", "bit").agg(
        F.sum("_n").alias("n_docs"),
        F.coalesce(F.sum(F.when(hit, F.col("_n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("_bits") == F.col("bit"), F.col("_n"))), F.lit(0)).alias("n_failed_alone"),
        F.bit_or("_bits").alias("seen_bits"),
    )


def quality(docs: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """The verdict of a policy beside the base verdict."""
    base_failed = ~passes(BASE)
    return ledger(docs).select(
        "doc_id",
        *MEASURES[:5],
        base_failed.alias("base_failed"),
        (~base_failed & passes(policy)).alias("kept"),
        "failures",
    )
