"""Line dedup by a deletion-neighbourhood join, within one edit.

A line with a word goes where an earlier line - of any document, in the order
of ids and then of places - equals it, whatever its length, or where both have
``MIN_CHARS`` signs or more and are one edit (a sign put in, left out or
changed) apart: in a shorter line one edit makes another word.

1. Lines become hashes; equal lines become one row with their first place.
2. One edit leaves one half of a line as it is.  Lines that share no half with
   another line, which are nearly all, have no neighbour and emit nothing.
3. The others emit their variants as hashed keys: the line with one sign left
   out, marked with the place of that sign (equal keys: one sign changed), and
   unmarked (equal to the whole of another line: one sign put in).  Only signs
   of the half that may differ are left out.
4. Under a key all lines neighbour the earliest one, or the one line that is
   whole there, so a minimum per key finds the earliest neighbour; no pairs of
   a group are formed.  Each neighbour is verified by its edit distance.

Defined cases: a NULL text stays NULL; rows with one id and text count as one
document and keep the same lines; an id that is NULL comes after all others,
in an order given by the text; blank lines stay; other input columns
are kept by ``without_repeats``, but ``n_lines`` and ``n_removed`` are
replaced.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrail.llm.sieve import Sieve
from voltrail.llm.text import BLANKS, bounded_batches, whole
from voltrail.session import checkpointed

#: Signs from which lines also meet lines one edit away.
MIN_CHARS = 20
EDITS = 1

_LINE = ("a", "b")  # 128 bits that name a line
_PLACE = "decimal(38,0)"
_U64 = np.uint64
_FACTOR = _U64(0x9E3779B97F4A7C15)


def _row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """The order of documents, and a hash of the text."""
    text_hash = F.xxhash64(whole(F.col(text_col)))
    late = F.lit("1" + 20 * "0").cast(_PLACE) + text_hash.cast(_PLACE)
    return F.coalesce(F.col(id_col).cast(_PLACE), late).cast(_PLACE), text_hash


def _line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line that takes part, with its document's key."""
    order, text_hash = _row_key(id_col, text_col)
    # Keys are made before the lines are spread, so no line carries its text.
    keyed = docs.select(
        order.alias("_doc"), text_hash.alias("_hash"), F.split(whole(F.col(text_col)), "\n", -1).alias("_lines")
    )
    rows = keyed.select("_doc", "_hash", F.posexplode("_lines"))
    place = F.col("_doc") * F.lit(10**10).cast("decimal(11,0)") + F.col("pos")
    return rows.filter(F.col("col").rlike(f"[^{BLANKS}]")).select(
        "_doc", "_hash", F.col("pos").alias("line_no"), place.cast(_PLACE).alias("place"), F.col("col").alias("line"),
        F.xxhash64("col").alias("a"), F.xxhash64(F.lit("b"), "col").alias("b"),
    )


def _half_keys(line: Column) -> list[Column]:
    """Keys under which a line meets every line one edit away.

    ``m`` is the length of the shorter line; each half of it stays whole in
    one of the two cases.  A line may be the shorter one or the longer one.
    Short lines have no keys.
    """
    n = F.length(line)
    long = n >= MIN_CHARS
    out = []
    for m in (n, n - 1):
        h = F.floor(m / 2).cast("int")
        out.append(F.when(long, F.xxhash64(m, F.lit("head"), F.substr(line, F.lit(1), h))))
        out.append(F.when(long, F.xxhash64(m, F.lit("tail"), F.substr(line, n - (m - h) + 1, m - h))))
    return out


def variant_keys(line: str, halves: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed variants of a line, and which of them is the whole line.

    ``halves`` says which half keys the line shares: head and tail as a line
    of the shorter length, head and tail as the longer one.
    """
    points = np.frombuffer(line.encode("utf-32-le"), dtype="<u4").astype(_U64) + _U64(1)
    n = len(points)
    power = np.full(n + 1, _FACTOR, dtype=_U64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.r_[_U64(0), np.cumsum(points * power[:n], dtype=_U64)]
    # What is left without the sign at i: the rest moves one place forward.
    inverse = _U64(pow(int(_FACTOR), -1, 1 << 64))
    without = sums[:n] + (sums[n] - sums[1:]) * inverse

    def mix(h: np.ndarray, salt: np.ndarray) -> np.ndarray:
        h = (h ^ (salt * _U64(0xD6E8FEB86659FD93))) * _U64(0xBF58476D1CE4E5B9)
        h ^= h >> _U64(29)
        return h * _U64(0x94D049BB133111EB)

    keys, selves = [], []

    def emit(values: np.ndarray, length: int, marks: np.ndarray | int, is_self: bool) -> None:
        salt = _U64(length) * _U64(1_000_003) + np.asarray(marks, dtype=_U64)
        keys.append(mix(values, np.broadcast_to(salt, values.shape)))
        selves.append(np.full(len(values), is_self))

    def other_half(head_shared: bool, tail_shared: bool, m: int) -> np.ndarray:
        """Places that may differ: behind a shared head, before a shared tail."""
        h = m // 2
        places = np.arange(n)
        return places[(head_shared & (places >= h)) | (tail_shared & (places < n - (m - h)))]

    if halves[0] or halves[1]:
        at = other_half(halves[0], halves[1], n)
        emit(without[at], n, at + 1, False)
        emit(sums[n:], n, 0, True)
    if halves[2] or halves[3]:
        emit(without[other_half(halves[2], halves[3], n - 1)], n - 1, 0, False)
    return np.concatenate(keys).view(np.int64), np.concatenate(selves)


def _neighbours(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """``a``, ``b`` and ``near``, the first place of the earliest verified
    neighbour that comes before the line."""
    halves = [f"k{i}" for i in range(4)]
    spread = lines.select(*_LINE, F.posexplode(F.array(*halves)).alias("half", "key"))
    counted = checkpointed(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    shared = checkpointed(
        spread.filter(Sieve.of(counted, "key").may_hold("key"))
        .join(counted, "key")
        .groupBy(*_LINE)
        .agg(*[F.max(F.col("half") == i).alias(f"s{i}") for i in range(4)])
    )
    # The texts of these few lines: one instance of each, told by its place.
    first = checkpointed(
        lines.filter(Sieve.of(shared, *_LINE).may_hold(*_LINE)).join(shared, list(_LINE)).select(*_LINE, "first", *[f"s{i}" for i in range(4)])
    )
    texts = rows.select("place", "line", F.col("a").alias("_a"), F.col("b").alias("_b")).filter(
        Sieve.of(first, "first").may_hold("place")
    )
    few = checkpointed(
        texts.join(first, (F.col("place") == F.col("first")) & (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b")))
        .select(*_LINE, "first", "line", *[f"s{i}" for i in range(4)])
        .dropDuplicates(list(_LINE))
    )

    @F.pandas_udf("array<struct<key: long, self: boolean>>")
    def variants(line: pd.Series, s0: pd.Series, s1: pd.Series, s2: pd.Series, s3: pd.Series) -> pd.Series:
        found = [variant_keys(x, list(s)) for x, *s in zip(line, s0, s1, s2, s3, strict=True)]
        return pd.Series([[{"key": k, "self": w} for k, w in zip(*f, strict=True)] for f in found])

    bounded_batches(few)
    keyed = few.select(
        *_LINE, "first", F.explode(variants("line", "s0", "s1", "s2", "s3")).alias("v")
    ).select(*_LINE, "first", "v.*")
    # Keys of one line only, nearly all, are counted and then let go.
    several = checkpointed(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    dealt = checkpointed(keyed.filter(Sieve.of(several, "key").may_hold("key")))
    own = F.when(F.col("self"), F.col("first"))
    other = F.when(~F.col("self"), F.col("first"))
    least = dealt.groupBy("key").agg(
        F.min(own).alias("whole"), F.min(other).alias("less"), F.max("self").alias("any")
    )
    # A key with a whole line holds that line and lines with one sign more;
    # a marked key holds lines that differ in the marked sign.
    near = F.when(F.col("self"), F.col("less")).when(F.col("any"), F.col("whole")).otherwise(F.col("less"))
    pairs = (
        dealt.join(least, "key")
        .select(*_LINE, "first", near.alias("near"))
        .filter("near < first")
        .distinct()
    )
    mine = few.select(*_LINE, F.col("line"))
    theirs = few.select(F.col("first").alias("near"), F.col("line").alias("_other"))
    verified = pairs.join(mine, list(_LINE)).join(theirs, "near").filter(
        F.levenshtein("line", "_other", EDITS) >= 0
    )
    return verified.groupBy(*_LINE).agg(F.min("near").alias("near"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_doc``, ``_hash`` and ``removed``, the numbers of the lines that go,
    for each document that loses any."""
    rows = _line_rows(docs, id_col, text_col)
    instances = checkpointed(
        rows.select("_doc", "_hash", "line_no", "place", *_LINE, *[k.alias(f"k{i}") for i, k in enumerate(_half_keys(F.col("line")))])
    )
    lines = checkpointed(
        instances.groupBy(*_LINE).agg(
            F.min("place").alias("first"),
            F.count(F.lit(1)).alias("n"),
            *[F.first(f"k{i}").alias(f"k{i}") for i in range(4)],
        )
    )
    near = checkpointed(_neighbours(lines.filter("k0 is not null"), rows))
    wanted = (F.col("n") > 1) | Sieve.of(near, *_LINE).may_hold(*_LINE)
    earliest = checkpointed(
        lines.select(*_LINE, "first", "n")
        .filter(wanted)
        .join(near, list(_LINE), "left")
        .filter("n > 1 or near is not null")
        .select(*_LINE, F.coalesce("near", "first").alias("earliest"))
    )
    gone = instances.filter(Sieve.of(earliest, *_LINE).may_hold(*_LINE)).join(earliest, list(_LINE)).filter("place != earliest")
    return gone.groupBy("_doc", "_hash").agg(F.collect_set("line_no").alias("removed"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All input columns with the text's repeated lines taken out, and
    ``n_lines`` and ``n_removed``."""
    removed = checkpointed(repeated_lines(docs, id_col, text_col))
    kept = [c for c in docs.columns if c.lower() not in {"n_lines", "n_removed"}]
    order, text_hash = _row_key(id_col, text_col)
    r = removed.select(F.col("_doc").alias("__vt_doc"), F.col("_hash").alias("__vt_hash"), F.col("removed").alias("__vt_gone"))
    # Documents that lose nothing stay where they are; only the others move.
    tested = docs.select(*kept, Sieve.of(removed, "_hash").may_hold(text_hash).alias("__vt_may"))
    joined = (
        tested.filter("__vt_may")
        .join(r, (order == F.col("__vt_doc")) & (text_hash == F.col("__vt_hash")), "left")
        .select(*kept, "__vt_gone")
        .unionByName(tested.filter("not __vt_may").select(*kept, F.lit(None).cast("array<int>").alias("__vt_gone")))
    )
    lines = F.split(F.col(text_col), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__vt_gone"))
    # Bound as one struct: inside the inner lambda the text would be split for every line.
    bound = F.array(F.struct(lines.alias("lines"), stay.alias("stay")))
    kept_lines = F.transform(bound, lambda b: F.transform(b["stay"], lambda i: F.get(b["lines"], i)))
    left = F.array_join(F.get(kept_lines, F.lit(0)), "\n")
    text = F.when(F.col("__vt_gone").isNull(), F.col(text_col)).otherwise(left)
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in kept],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("__vt_gone").isNull(), 0).otherwise(F.size("__vt_gone")).cast("long").alias("n_removed"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``n_lines``, ``n_removed`` and the text left."""
    return without_repeats(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")
