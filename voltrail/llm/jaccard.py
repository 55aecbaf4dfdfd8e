"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts link where the Jaccard similarity of their word shingles reaches the
threshold.  Texts with equal shingle sets are one class, so copies cost a row
each and nothing more; all else works on one signature per class:

1. MinHash values of a class form bands; classes that share a band meet in a
   bucket.  A bucket of any size is cut into chunks, and a unit of work is one
   chunk or two of them, so no task holds a bucket;
2. in a unit, MinHash values are compared a few at a time, and a pair goes as
   soon as the posterior probability that it reaches the threshold falls below
   the tolerance.  A unit returns who hangs together with whom, not the pairs;
3. what hangs together is a cluster.  Clusters are cut into chunks the same
   way, and every pair of a cluster is verified on whole shingle sets.  A unit
   returns links per class and, again, who hangs together.

The bands miss a pair at the threshold with probability below 2e-10, pruning
drops it with less than ``TOLERANCE``; what is returned is exact.

Defined cases: a text of one to four words is one shingle, all its words; a
NULL text or one without words has no links and is a group of its own; rows
with one id and text are copies of each other; a NULL id is allowed, but gives
its group no number where no other id is in it; other input columns are kept
by ``one_of_each_group`` and ignored elsewhere.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.llm.components import roots
from voltrail.llm.hashing import shingle_sets
from voltrail.llm.sieve import Sieve
from voltrail.llm.text import bounded_batches, give_back
from voltrail.session import checkpointed

SHINGLE = 5
THRESHOLD = 0.8
#: Least posterior probability of a pair that is kept.
TOLERANCE = 1e-6
BANDS, BAND_ROWS = 32, 3
HASHES = BANDS * BAND_ROWS
#: MinHash values compared before each look at the posterior.
STEP = 16
#: Units up to this size are compared together, so many pairs at once.
SMALL_UNIT = 64
PAIRS_TOGETHER = 200_000
#: Rows of units, and of units with texts, that a task is given at once.
UNIT_ROWS, TEXT_ROWS = 20_000, 2_000
#: Classes in a chunk, and shingles in a chunk that is verified.
CHUNK = 512
CHUNK_SHINGLES = 2_000_000

_RANDOM = np.random.Generator(np.random.PCG64(7))
_FACTOR = _RANDOM.integers(0, 1 << 63, size=HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RANDOM.integers(0, 1 << 63, size=HASHES, dtype=np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096, None] * _FACTOR + _SHIFT
        part ^= part >> np.uint64(32)
        least = np.minimum(least, (part * np.uint64(0xD6E8FEB86659FD93)).min(axis=0))
    return (least >> np.uint64(40)).astype("<u2")


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches needed) at each look.

    With a uniform prior the posterior of a similarity after m of n matches
    is a beta distribution; its tail above the threshold is summed up on a
    fine grid.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log - log.max())
            if density[grid >= threshold].sum() / density.sum() >= tolerance:
                out.append((n, m))
                break
    return out


def surviving_pairs(a: np.ndarray, b: np.ndarray | None, looks) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of rows that no look at the posterior drops.

    ``b`` is None for the pairs within ``a``.
    """
    other = a if b is None else b
    left, right, n_before = None, None, 0
    for n, needed in looks:
        part = slice(n_before, n)
        if left is None:
            matches = np.zeros((len(a), len(other)), dtype=np.int16)
            for k in range(n_before, n):
                matches += a[:, k, None] == other[None, :, k]
            fits = matches >= needed
            if b is None:
                fits = np.triu(fits, 1)
            left, right = np.nonzero(fits)
            found = matches[left, right].astype(np.int64)
        else:
            found = found + (a[left, part] == other[right, part]).sum(axis=1)
            keep = found >= needed
            left, right, found = left[keep], right[keep], found[keep]
        n_before = n
    return left, right


def _least_members(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least place it hangs together with."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    return label


def _sharing_bands(a: np.ndarray, b: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Which pairs of rows share a band before number ``upto``."""
    same = (a == b).reshape(len(a), BANDS, BAND_ROWS).all(axis=2)
    return (same & (np.arange(BANDS) < upto[:, None])).any(axis=1)


def _spans(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start, and the end."""
    change = np.zeros(len(columns[0]), dtype=bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.r_[0, np.flatnonzero(change), len(change)] if len(change) else np.zeros(1, dtype=int)


def pruned_pairs(values: np.ndarray, starts: np.ndarray, cuts: np.ndarray, looks):
    """``surviving_pairs`` of many units that lie one behind the other.

    ``starts`` are their bounds; ``cuts`` the size of a unit's first chunk
    where it has two, else -1.  Small units of one size are compared together.
    """
    left, right = [], []
    sizes = np.diff(starts)
    for n in np.unique(sizes[(sizes <= SMALL_UNIT) & (cuts < 0)]).tolist():
        i, j = np.triu_indices(n, 1)
        at = starts[:-1][(sizes == n) & (cuts < 0)]
        step = max(1, PAIRS_TOGETHER // max(len(i), 1))
        for k in range(0, len(at), step):
            a = (at[k : k + step, None] + i).ravel()
            b = (at[k : k + step, None] + j).ravel()
            found, before = np.zeros(len(a), dtype=np.int64), 0
            for upto, needed in looks:
                found = found + (values[a, before:upto] == values[b, before:upto]).sum(axis=1)
                keep = found >= needed
                a, b, found, before = a[keep], b[keep], found[keep], upto
            left.append(a)
            right.append(b)
    # A unit of two chunks of which one is empty has no pairs.
    two = (cuts > 0) & (cuts < sizes)
    for k in np.flatnonzero((sizes > SMALL_UNIT) & (cuts < 0) | two).tolist():
        unit = values[starts[k] : starts[k + 1]]
        cut = max(int(cuts[k]), 0)
        a, b = surviving_pairs(unit[:cut], unit[cut:], looks) if cut else surviving_pairs(unit, None, looks)
        left.append(a + starts[k])
        right.append(b + starts[k] + cut)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


# --- classes ---------------------------------------------------------------


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``text_hash``, and ``set_id``, ``n_shingles`` and
    ``signature`` of its shingle set, NULL where it is empty."""

    @F.pandas_udf("set_id string, n_shingles int, signature binary")
    def signed(text: pd.Series) -> pd.DataFrame:
        rows = []
        for s in shingle_sets(text.fillna("").tolist(), SHINGLE):
            if len(s):
                name = hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest()
                rows.append((name, len(s), minhash(s).tobytes()))
            else:
                rows.append((None, None, None))
        give_back()
        return pd.DataFrame(rows, columns=["set_id", "n_shingles", "signature"])

    bounded_batches(docs)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"),
        signed(text_col).alias("_s"),
    ).select("doc_id", "text_hash", "_s.*")


def _classes(rows: DataFrame) -> DataFrame:
    """One row per shingle set; ``member`` points at a row that has it."""
    return (
        rows.filter("set_id is not null")
        .groupBy("set_id")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.min("doc_id").alias("first_id"),
            F.min(F.struct("doc_id", "text_hash")).alias("member"),
            # A row with an id stays before one without.
            F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("survivor"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
        )
    )


def _in_units(members: DataFrame, key: str, chunks) -> DataFrame:
    """Give every member to the units of its chunk.

    ``chunks`` is the number of chunks of the member's group.  A unit is a
    chunk by itself or two chunks; ``lo`` and ``hi`` name them.
    """
    own = F.pmod(F.xxhash64("set_id"), chunks).cast("int")
    cut = members.withColumns({"_n": chunks.cast("int"), "own": own})
    spread = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return spread.withColumns({"lo": F.least("own", "_other"), "hi": F.greatest("own", "_other")}).drop(
        "_n", "_other"
    )


# --- candidates ------------------------------------------------------------


def _clusters(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """``u``, ``v``: classes other than the least of their cluster, and it."""

    @F.pandas_udf("array<long>")
    def bands(signature: pd.Series) -> pd.Series:
        number = np.arange(BANDS, dtype=np.int64) << 48

        def keys(s: bytes) -> np.ndarray:
            v = np.frombuffer(s, dtype="<u2").astype(np.int64).reshape(BANDS, BAND_ROWS)
            return number | v[:, 0] << 32 | v[:, 1] << 16 | v[:, 2]

        return signature.map(keys)

    met = checkpointed(classes.select("set_id", F.explode(bands("signature")).alias("bucket")))
    shared = checkpointed(met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = met.filter(Sieve.of(shared, "bucket").may_hold("bucket")).join(shared, "bucket")
    chunks = F.ceil(F.col("n") / CHUNK)
    units = _in_units(members, "bucket", chunks).join(classes.select("set_id", "signature"), "set_id")
    looks = least_matches(threshold, tolerance)

    def prune(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bucket", "lo", "hi", "own", "set_id"])
        starts = _spans(*[rows[c].to_numpy() for c in ("bucket", "lo", "hi")])
        cuts = _cuts(rows, starts)
        values = np.frombuffer(b"".join(rows["signature"]), dtype="<u2").reshape(-1, HASHES)
        left, right = pruned_pairs(values, starts, cuts, looks)
        # A pair counts in the first band it shares, so it is looked at once.
        band = rows["bucket"].to_numpy() >> 48
        keep = [
            ~_sharing_bands(values[left[k : k + PAIRS_TOGETHER]], values[right[k : k + PAIRS_TOGETHER]], band[left[k : k + PAIRS_TOGETHER]])
            for k in range(0, len(left), PAIRS_TOGETHER)
        ]
        first = np.concatenate(keep) if keep else np.zeros(0, dtype=bool)
        names, place = np.unique(rows["set_id"].to_numpy(dtype=str), return_inverse=True)
        label = _least_members(len(names), place[left[first]], place[right[first]])
        linked = label != np.arange(len(names))
        return pd.DataFrame({"u": names[linked], "v": names[label[linked]]})

    found = _dealt(units, "bucket", shared, UNIT_ROWS).groupBy("_task").applyInPandas(prune, "u string, v string")
    return roots(found)


def _dealt(units: DataFrame, key: str, groups: DataFrame, rows_each: int) -> DataFrame:
    """Deal units out to tasks of about ``rows_each`` rows.

    A unit holds at most two chunks, so no task holds much more.
    """
    copies = F.col("n") * F.ceil(F.col("n") / CHUNK)
    total = groups.agg(F.coalesce(F.sum(copies), F.lit(0)).alias("rows")).first()["rows"]
    tasks = max(1, -(-int(total) // rows_each))
    return units.withColumn("_task", F.pmod(F.xxhash64(key, "lo", "hi"), F.lit(tasks)))


def _cuts(rows: pd.DataFrame, starts: np.ndarray) -> np.ndarray:
    """Per unit of two chunks the size of the first, -1 where it is one chunk."""
    lo, hi, own = (rows[c].to_numpy() for c in ("lo", "hi", "own"))
    if not len(rows):
        return np.zeros(0, dtype=np.int64)
    in_first = np.add.reduceat((own == lo).astype(np.int64), starts[:-1])
    return np.where(lo[starts[:-1]] == hi[starts[:-1]], -1, in_first)


# --- verification ----------------------------------------------------------


def _verified(docs: DataFrame, classes: DataFrame, clusters: DataFrame, threshold: float, text_col: str, id_col: str):
    """Per class and unit: documents linked there, and the least class that
    it hangs together with."""
    clustered = clusters.select(F.col("u").alias("set_id"), F.col("v").alias("cluster")).unionByName(
        clusters.select(F.col("v").alias("set_id"), F.col("v").alias("cluster")).distinct()
    )
    members = checkpointed(
        clustered.join(classes.select("set_id", "n_docs", "n_shingles", "member"), "set_id")
    )
    sizes = checkpointed(
        members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
    )
    chunks = F.ceil(F.greatest(F.col("n") / CHUNK, F.col("total") / CHUNK_SHINGLES))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(
        F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash")).alias("_m"),
        text.alias("text"),
    )
    m = F.col("member")
    wanted = members.select("set_id", m.alias("_w"))
    # Only one row per clustered class is read on; rows that are repeated
    # altogether would give it twice, so they are made one.
    chosen = (
        texts.filter(Sieve.of(members, "member.text_hash").may_hold("_m.text_hash"))
        .join(wanted, F.col("_m").eqNullSafe(F.col("_w")))
        .select("set_id", "text")
        .dropDuplicates(["set_id"])
    )
    units = _in_units(members.join(sizes, "cluster"), "cluster", chunks).join(chosen, "set_id")

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cluster", "lo", "hi", "own", "set_id"])
        starts = _spans(*[rows[c].to_numpy() for c in ("cluster", "lo", "hi")])
        names, n_docs = rows["set_id"].to_numpy(), rows["n_docs"].to_numpy()
        texts = rows["text"].tolist()
        links, label = np.zeros(len(names), dtype=np.int64), np.arange(len(names))
        for a, b, cut in zip(starts, starts[1:], _cuts(rows, starts), strict=False):
            if cut in (0, b - a):  # the other chunk is empty
                continue
            left, right = linked_pairs(shingle_sets(texts[a:b], SHINGLE), None if cut < 0 else int(cut), threshold)
            np.add.at(links, left + a, n_docs[right + a])
            np.add.at(links, right + a, n_docs[left + a])
            label[a:b] = a + _least_members(b - a, left, right)
        return pd.DataFrame({"set_id": names, "links": links, "root": names[label]})

    keep = ["cluster", "lo", "hi", "own", "set_id", "n_docs", "text"]
    dealt = _dealt(units.select(*keep), "cluster", sizes, TEXT_ROWS)
    return dealt.groupBy("_task").applyInPandas(verify, "set_id string, links long, root string")


def linked_pairs(sets: list[np.ndarray], cut: int | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs whose Jaccard similarity reaches the threshold.

    With ``cut``, pairs of one set before and one from that place on.
    """
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(column.max() + 1, dtype=bool)
    left, right = [], []
    for i in range(len(sets) if cut is None else cut):
        first = i + 1 if cut is None else cut
        if first >= len(sets):
            break
        own = column[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        both = np.add.reduceat(mark[column[starts[first] :]].astype(np.int64), starts[first:] - starts[first])
        mark[own] = False
        either = sizes[i] + sizes[first:] - both
        j = np.flatnonzero(both >= threshold * either - 1e-9) + first
        left.append(np.full(len(j), i))
        right.append(j)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


# --- results ---------------------------------------------------------------


def groups(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id``, ``text_hash``, ``class_id`` (the
    least id of all documents that links connect it with), ``group_size`` and
    ``n_links``, the number of documents it is linked with, copies included."""
    return _grouped(docs, threshold, tolerance, id_col, text_col).drop("survivor")


def _grouped(docs: DataFrame, threshold: float, tolerance: float, id_col: str, text_col: str) -> DataFrame:
    """``groups`` with ``survivor``, the row of the group that comes first by
    (id, NULL last; hash of the text); NULL for a document without words."""
    rows = checkpointed(signatures(docs, id_col, text_col))
    classes = checkpointed(_classes(rows))
    clusters = _clusters(classes, threshold, tolerance)
    verified = checkpointed(_verified(docs, classes, clusters, threshold, text_col, id_col))
    joined = roots(verified.select(F.col("set_id").alias("u"), F.col("root").alias("v")))
    links = verified.groupBy("set_id").agg(F.sum("links").alias("links"))
    rooted = (
        classes.select("set_id", "n_docs", "first_id", "survivor")
        .join(joined.select(F.col("u").alias("set_id"), F.col("v").alias("_root")), "set_id", "left")
        .join(links, "set_id", "left")
        .withColumn("_root", F.coalesce("_root", "set_id"))
    )
    whole = rooted.groupBy("_root").agg(
        F.min("first_id").alias("class_id"), F.sum("n_docs").alias("group_size"), F.min("survivor").alias("survivor")
    )
    facts = rooted.drop("survivor").join(whole, "_root").select(
        "set_id", "class_id", "group_size", "survivor", (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links")
    )
    named = rows.filter("set_id is not null").join(facts, "set_id")
    columns = ["doc_id", "text_hash", "class_id", "group_size", "n_links", "survivor"]
    alone = rows.filter("set_id is null").select(
        "doc_id",
        "text_hash",
        F.col("doc_id").alias("class_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(0).cast("long").alias("n_links"),
        F.lit(None).cast(named.schema["survivor"].dataType).alias("survivor"),
    )
    return named.select(*columns).unionByName(alone)


def join_counts(docs: DataFrame) -> DataFrame:
    """The join's result per document, without pointers."""
    return groups(docs).drop("text_hash")


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group, all input columns kept: the one with the
    least id; of several without an id, or with the same one, the one whose
    text has the least hash.

    Rows that are repeated altogether stay one; documents without words stay.
    """
    found = checkpointed(_grouped(docs, threshold, TOLERANCE, "doc_id", "text"))
    first = F.col("survivor")
    stays = F.col("doc_id").eqNullSafe(first["doc_id"]) & (F.col("text_hash") == first["text_hash"])
    gone = found.filter(first.isNotNull() & ~stays).select(
        F.col("doc_id").alias("__vt_id"), F.col("text_hash").alias("__vt_hash")
    )
    repeated = (
        found.groupBy("text_hash", "doc_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.col("doc_id").alias("__vt_id"), F.col("text_hash").alias("__vt_hash"))
    )
    # Only documents that may go or be repeated move; the others stay in place.
    touched = Sieve.of(checkpointed(gone.unionByName(repeated)), "__vt_hash")
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    marked = docs.withColumn("__vt_may", touched.may_hold(text_hash))
    match = F.col("doc_id").eqNullSafe(F.col("__vt_id")) & (text_hash == F.col("__vt_hash"))
    rest = marked.filter("__vt_may").drop("__vt_may").join(gone.distinct(), match, "left_anti")
    return marked.filter("not __vt_may").drop("__vt_may").unionByName(rest.dropDuplicates(["doc_id", "text"]))
