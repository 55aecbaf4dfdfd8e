"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order.  Pivots are a bounded
sample; every vector is indexed.  The index is cut into segments by a hash of
the id; a segment keeps one inverted file per pivot, with the vectors that
have it among their nearest and its place there.  A query walks the files of
its own nearest pivots, which sums up the footrule distance between the two
orders, and the closest part of the segment is then ranked by exact cosine.
The best of all segments are merged per query.

All of a segment's candidates at the last accepted footrule distance are
ranked, so groups of copies are never cut.  Segments are equally large
whatever the vectors are, and queries meet them in blocks, which bounds what a
task holds.

Defined cases: a vector that is NULL, zero, or holds NULL or non-finite
components takes no part, nor does a row without an id or with another length
than most vectors; rows with a query's id are its own and no candidates;
repeated rows are one candidate each, and one query; an empty table gives no
rows; other input columns are ignored.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pivots fitted, and the nearest ones that represent a vector.
PIVOTS = 256
NEAREST = 96
#: Part of a segment that is ranked exactly, and the least number of vectors.
RANKED_PART = 0.10
RANKED_LEAST = 256
#: Vectors in a segment and queries in a block.
SEGMENT = 4_096
QUERY_BLOCK = 2_048
QUERY_EVERY = 50

_MATCH = "query_id long, vec_id long, score double"


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``_id`` and ``_v`` of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v")).filter(
        F.col("_id").isNotNull() & F.col("_v").isNotNull()
    )
    v = F.col("_v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.filter(finite & F.exists(v, lambda x: x != 0))
    most = usable.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return usable.filter(F.size("_v") == (most["n"] if most else 0))


def fit_pivots(rows: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """Unit vectors of at most ``n`` distinct rows, drawn by a hash of the id."""
    drawn = rows.orderBy(F.xxhash64("_id", F.lit("pivot")), "_id").limit(4 * n).collect()
    unique = dict.fromkeys(tuple(r["_v"]) for r in drawn)
    return _unit(np.array(list(unique)[:n], dtype=float)) if unique else np.zeros((0, 0))


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def orders(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first, equal ones by number."""
    near = _unit(vectors) @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :nearest].astype(np.int32)


class Segment:
    """Inverted files of one part of the vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.nearest = min(nearest, len(pivots))
        seen = orders(vectors, pivots, self.nearest)
        pivot = seen.ravel()
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), self.nearest)
        place = np.tile(np.arange(self.nearest, dtype=np.int32), len(ids))
        by_pivot = np.argsort(pivot, kind="stable")
        bounds = np.searchsorted(pivot[by_pivot], np.arange(len(pivots) + 1))
        self.files = [
            (owner[by_pivot[a:b]], place[by_pivot[a:b]]) for a, b in zip(bounds, bounds[1:], strict=False)
        ]

    def agreement(self, order: np.ndarray) -> np.ndarray:
        """Largest footrule distance possible, less the distance, halved.

        A pivot that only one of two orders has counts as standing right
        behind the other's end, so only shared pivots add anything.
        """
        total = np.zeros(len(self.ids), dtype=np.int32)
        for at, pivot in enumerate(order.tolist()):
            owner, place = self.files[pivot]
            total[owner] += self.nearest - np.maximum(place, at)
        return total

    def search(self, query_id: int, query: np.ndarray, order: np.ndarray, k: int, part: float, least: int):
        """Ids and cosines of the ``k`` best of the closest part."""
        close = self.agreement(order)
        n = min(len(close), max(least, int(np.ceil(part * len(close)))))
        bar = np.partition(close, len(close) - n)[len(close) - n]
        ranked = np.flatnonzero((close >= bar) & (self.ids != query_id))
        dots = (self.vectors[ranked] * query).sum(axis=1)
        cosine = dots / (self.norms[ranked] * np.sqrt((query * query).sum()))
        best = np.lexsort((self.ids[ranked], -cosine))[:k]
        return self.ids[ranked[best]], cosine[best]


def search(
    vectors: DataFrame,
    k: int = 5,
    every: int = QUERY_EVERY,
    pivots: int = PIVOTS,
    nearest: int = NEAREST,
    part: float = RANKED_PART,
    least: int = RANKED_LEAST,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the nearest found.

    Queries are the rows whose id is divisible by ``every``.
    """
    rows = valid(vectors)
    n = rows.count()
    fitted = fit_pivots(rows, pivots)
    segments = max(1, -(-n // SEGMENT))
    queries = rows.filter(F.col("_id") % every == 0).distinct()
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    segment = F.pmod(F.xxhash64("_id", F.lit("segment")), F.lit(segments)).cast("int")
    block = F.pmod(F.xxhash64("_id", F.lit("block")), F.lit(blocks)).cast("int")

    def every_one(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        part_of = Segment(left["_id"].to_numpy(), np.stack(left["_v"].to_numpy()), fitted, nearest)
        asked = np.stack(right["_v"].to_numpy())
        found = [
            (q, *part_of.search(q, v, o, k, part, least))
            for q, v, o in zip(right["_id"].tolist(), asked, orders(asked, fitted, part_of.nearest), strict=True)
        ]
        return pd.DataFrame(
            {
                "query_id": np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]),
                "vec_id": np.concatenate([i for _, i, _ in found]),
                "score": np.concatenate([s for _, _, s in found]),
            }
        )

    cell = ["_segment", "_block"]
    indexed = rows.select("_id", "_v", segment.alias("_segment"), every_one(blocks).alias("_block"))
    asked = queries.select("_id", "_v", every_one(segments).alias("_segment"), block.alias("_block"))
    found = indexed.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInPandas(match, _MATCH)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
