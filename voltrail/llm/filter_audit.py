"""Filter interaction audit on failing-id relations.

Every filter is evaluated once and leaves one stored table: the row ids that
fail it.  From then on the texts are not read again.  What a filter ``f``
removes after a set of earlier filters, its prefix, is

    documents  LEFT SEMI  failing(f)  LEFT ANTI  failing(g) for g in the prefix

A branch per filter starts from its own failing rows and takes the other
filters in turn: each row stands once for a prefix without ``g`` and once for
the same prefix with ``g``, and an anti join with ``g``'s table takes the
second away where ``g`` has removed the row before.  So one semi join and one
anti join per other filter give the removals of all prefixes, and rows fall
away as they go.  All tables are partitioned by row id, shuffled once each and
reused by all branches.  Labels are left semi joins with the ids of a label.
Survivors follow from the part's documents less the removals along an order.

A row id is a digest of the id and the text, so rows that share an id are told
apart by their text; rows that are equal in both are counted together before
the joins, so no key has more rows than there are parts.  Copies of a text are
found under (digest, salt): a text that a third of all rows share is split over
``SALTS`` tasks, and only the salts that occur are joined.

Defined cases: a NULL text is empty; a NULL language is the part ``''``; a NULL
id has no smaller id, fails no copy filter and has no label; repeated rows count
each; an id with several labels has every label any of its rows gives; an empty
table has no parts and gives no rows; other columns are ignored, whatever their
names.
"""

import itertools
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrail.llm.text import whole, words
from voltrail.session import checkpointed, scratch

SALTS = 256

# Limits of the audited filters.
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITALS_PERCENT = 10
SYMBOLS = "[#$%&*|]"


@dataclass(frozen=True)
class Filter:
    """``fails`` reads ``_text`` and ``_words``; None stands for the copy
    filter, which needs the whole table."""

    name: str
    fails: Column | None


def filters() -> tuple[Filter, ...]:
    text, w = F.col("_text"), F.col("_words")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return (
        Filter("A", F.size(w) < MIN_WORDS),
        Filter("B", 100 * F.size(F.array_distinct(w)) < MIN_DISTINCT_PERCENT * F.size(w)),
        Filter("C", 100 * capitals > MAX_CAPITALS_PERCENT * F.length(text)),
        Filter("D", text.rlike(SYMBOLS)),
        Filter("E", None),
    )


@dataclass(frozen=True)
class Relations:
    """What an audit reads: all rows, and the failing ids of each filter."""

    rows: DataFrame  # row_id, doc_id, part
    failing: dict[str, DataFrame]  # row_id


def _copies(rows: DataFrame) -> DataFrame:
    """Row ids of texts that a smaller id holds too."""
    keyed = rows.filter(F.col("doc_id").isNotNull()).select(
        "row_id", "doc_id", "digest", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).alias("salt")
    )
    salted = keyed.groupBy("digest", "salt").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    firsts = (
        salted.groupBy("digest")
        .agg(F.min("least").alias("least"), F.max("most").alias("most"), F.collect_list("salt").alias("salts"))
        .filter("least < most")
        .select("digest", "least", F.explode("salts").alias("salt"))
    )
    return keyed.join(firsts, ["digest", "salt"]).filter("doc_id > least").select("row_id")


def store(docs: DataFrame, audited: tuple[Filter, ...] | None = None) -> Relations:
    """Evaluate every filter once; write the rows and one id table per filter."""
    audited = audited or filters()
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "filter-audit")
    own = [f for f in audited if f.fails is not None]
    base = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), whole(F.col("text")).alias("_text")
    ).withColumn("_words", words(F.col("_text")))
    digest = F.sha2("_text", 256)
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), digest)
    base.select(
        F.unhex(F.md5(name)).alias("row_id"),
        "doc_id",
        "part",
        F.unhex(digest).alias("digest"),
        *[f.fails.alias(f"fails_{f.name}") for f in own],
    ).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    failing = {}
    for f in audited:
        ids = _copies(rows) if f.fails is None else rows.filter(F.col(f"fails_{f.name}")).select("row_id")
        ids.distinct().write.parquet(f"{folder}/failing-{f.name}")
        failing[f.name] = spark.read.parquet(f"{folder}/failing-{f.name}")
    return Relations(rows.select("row_id", "doc_id", "part"), failing)


def _weights(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per row id and part: all, of good quality, toxic."""
    counted = rows.groupBy("row_id", "doc_id", "part").agg(F.count(F.lit(1)).alias("n"))

    def held(ids: DataFrame | None, name: str) -> DataFrame:
        some = counted if ids is None else counted.join(ids, "doc_id", "left_semi")
        return some.select(
            "row_id", "part", *[(F.col("n") if c == name else F.lit(0).cast("long")).alias(c) for c in KINDS]
        )

    def labelled(column: str) -> DataFrame:
        return labels.filter(F.col(column) == 1).select("doc_id").distinct()

    parts = held(None, "n").unionByName(held(labelled("quality"), "good")).unionByName(held(labelled("toxic"), "toxic"))
    return parts.groupBy("row_id", "part").agg(*[F.sum(c).alias(c) for c in KINDS])


KINDS = ("n", "good", "toxic")


def removals(weights: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """Documents that each filter removes after each set of other filters:
    ``part, filter, prefix`` (a bit per filter, in the order given) and counts."""
    bit = {name: 1 << i for i, name in enumerate(failing)}
    branches = []
    for name, ids in failing.items():
        left = weights.join(ids, "row_id", "left_semi").withColumn("prefix", F.lit(0))
        for other, gone in failing.items():
            if other == name:
                continue
            taken = F.col("prefix").bitwiseOR(F.lit(bit[other]))
            left = left.withColumn("prefix", F.explode(F.array("prefix", taken))).alias("l")
            before = F.col("l.prefix").bitwiseAND(F.lit(bit[other])) != 0
            same = F.col("l.row_id") == F.col("r.row_id")
            left = left.join(gone.alias("r"), same & before, "left_anti")
        branches.append(
            left.groupBy("part", "prefix")
            .agg(*[F.sum(c).alias(c) for c in KINDS])
            .select("part", F.lit(name).alias("filter"), "prefix", *KINDS)
        )
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out


def _steps(names: list[str]) -> Column:
    """Every order of the filters, step by step: a fixed table of k! k rows."""
    bit = {name: 1 << i for i, name in enumerate(names)}
    found = [
        {"filter_order": "".join(order), "step": i + 1, "filter": f, "prefix": sum(bit[g] for g in order[:i])}
        for order in itertools.permutations(names)
        for i, f in enumerate(order)
    ]
    kind = "array<struct<filter_order:string,step:int,filter:string,prefix:int>>"
    return F.from_json(F.lit(json.dumps(found)), kind)


def audit(docs: DataFrame, labels: DataFrame, audited: tuple[Filter, ...] | None = None) -> DataFrame:
    """One row per part, order of the filters and step; see the module's text.

    ``shapley`` is the filter's removals summed over all orders: those after a
    prefix of s filters count s! (k-1-s)! times.
    """
    relations = store(docs, audited)
    names = list(relations.failing)
    k, every = len(names), (1 << len(names)) - 1
    weights = _weights(relations.rows, labels)
    cells = checkpointed(removals(weights, relations.failing))
    orders = F.array(*[F.lit(math.factorial(s) * math.factorial(k - 1 - s)).cast("long") for s in range(k)])
    own = F.element_at(F.array(*[F.lit(1 << i) for i in range(k)]), F.array_position(F.array(*map(F.lit, names)), F.col("filter")).cast("int"))
    alone = F.col("prefix") == F.lit(every) - own
    totals = relations.rows.groupBy("part").agg(F.count(F.lit(1)).alias("total"))
    per_filter = cells.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("prefix") == 0, F.col("n"))).alias("failed"),
        F.sum(F.when(alone, F.col("n"))).alias("unique_fails"),
        F.sum(F.col("n") * F.element_at(orders, F.bit_count("prefix") + 1)).alias("shapley"),
    )
    dense = totals.select("part", "total", F.inline(_steps(names)))
    joined = dense.join(cells, ["part", "filter", "prefix"], "left").join(per_filter, ["part", "filter"], "left")

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("long")

    so_far = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.sum(count("n")).over(so_far)).cast("long").alias("kept"),
        count("n").alias("removed"),
        (count("failed") - count("n")).alias("redundant"),
        count("unique_fails").alias("unique_fails"),
        count("good").alias("good_lost"),
        count("toxic").alias("toxic_lost"),
        count("shapley").alias("shapley"),
    )
