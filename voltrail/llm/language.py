"""Language identification by multilingual mixture inference.

A language is a distribution over hashed character n-grams, counted in Spark.
A document is a mixture of languages: expectation-maximisation estimates the
proportions from the likelihoods of its n-grams, first over all languages,
then over sets of the strongest ones; the set with the best penalised
likelihood is the document's.

The model is a matrix of languages by buckets, so its size does not depend on
the corpus; the number of languages is checked.  Counting sends at most one
number per language, bucket and task through the shuffle.  A document is
scored in its own row.

Defined cases: a text that is NULL or has no letter is ``und`` with score 0,
as is every text when nothing was learned; a NULL id is learned from; a NULL
language is not; repeated rows count as often as they occur; other input
columns are ignored.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.llm.text import bounded_batches, id_remainder
from voltrail.session import checkpointed

BUCKETS = 1 << 15
MAX_LANGUAGES = 512
SMOOTHING = 0.5
ROUNDS = 12
#: Languages below this share are not tried in a set.
LEAST_SHARE = 0.02
#: Weight of log(n-grams) that a further language must gain in log-likelihood.
PENALTY = 2.0
UNDETERMINED = "und"
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint64)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: is it a letter."""
    table = np.zeros(0x110000, dtype=bool)
    table[:0x33480] = [chr(i).isalpha() for i in range(0x33480)]
    return table


def ngrams(text: str) -> np.ndarray:
    """Buckets of all letter bigrams and trigrams; other signs part words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    # Runs of other signs become one gap, also at both ends.
    signs = np.concatenate([[0], np.where(letter, points, 0), [0]]).astype(np.uint64)
    signs = signs[np.r_[True, (signs[1:] != 0) | (signs[:-1] != 0)]]
    two = signs[:-1] * _ODD[0] + signs[1:] * _ODD[1]
    three = two[:-1] + signs[2:] * _ODD[2] + np.uint64(1)
    mixed = np.concatenate([two, three])
    mixed = (mixed ^ (mixed >> np.uint64(15))) * _ODD[1]
    return ((mixed >> np.uint64(17)) % np.uint64(BUCKETS)).astype(np.int64)


def count_ngrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang``, ``bucket``, ``n`` over documents with a known language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if lang not in totals:
                    totals[lang] = np.zeros(BUCKETS, dtype=np.int64)
                totals[lang] += np.bincount(ngrams(text), minlength=BUCKETS)
        for lang, n in totals.items():
            used = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": used.astype(np.int32), "n": n[used]})

    bounded_batches(docs)
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    counted = known.mapInPandas(count, "lang string, bucket int, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Languages:
    """Log-probabilities of every bucket per language."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        smooth = counts + SMOOTHING
        self.p = smooth / smooth.sum(axis=1, keepdims=True)

    @classmethod
    def fit(cls, docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> "Languages":
        counts = checkpointed(count_ngrams(docs, text_col, lang_col))
        names = sorted(r[0] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
        if len(names) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        matrix = np.zeros((len(names), BUCKETS))
        place = {n: i for i, n in enumerate(names)}
        rows = counts.toPandas()  # languages times buckets, whatever the corpus
        matrix[rows["lang"].map(place).to_numpy(dtype=int), rows["bucket"].to_numpy(dtype=int)] = rows["n"]
        return cls(names, matrix)

    def mixtures(self, texts: list[str]) -> list[tuple[str, float, list[str], list[float]]]:
        """Language, its share, and the chosen set with shares, per text."""
        out: list = [(UNDETERMINED, 0.0, [], [])] * len(texts)
        if not self.names:
            return out
        found = []
        for i, text in enumerate(texts):
            counts = np.bincount(ngrams(text), minlength=1)
            used = np.flatnonzero(counts)
            if len(used):
                found.append((i, used, counts[used].astype(float)))
        if not found:
            return out
        sizes = np.array([len(u) for _, u, _ in found])
        like = self.p[:, np.concatenate([u for _, u, _ in found])].T
        weight = np.concatenate([n for _, _, n in found])
        total = np.array([n.sum() for _, _, n in found])
        start = np.full((len(found), len(self.names)), 1.0 / len(self.names))
        shares, _ = _em(like, weight, sizes, start)
        chosen = self._choose(like, weight, sizes, total, shares)
        for k, (i, _, _) in enumerate(found):
            best = int(np.argmax(chosen[k]))
            order = [j for j in np.argsort(-chosen[k], kind="stable") if chosen[k][j] > 0]
            out[i] = (
                self.names[best],
                float(min(1.0, shares[k][best])),
                [self.names[j] for j in order],
                [float(chosen[k][j]) for j in order],
            )
        return out

    def _choose(self, like, weight, sizes, total, shares) -> np.ndarray:
        """Shares within the best set of each text; 0 outside it."""
        rank = np.argsort(np.argsort(-shares, axis=1, kind="stable"), axis=1)
        best = (rank == 0).astype(float)
        _, gain = _em(like, weight, sizes, best, rounds=0)
        ends = np.cumsum(sizes)
        for k in range(2, shares.shape[1] + 1):
            tried = np.flatnonzero(np.sort(shares, axis=1)[:, -k] > LEAST_SHARE)
            if not len(tried):
                break
            rows = np.concatenate([np.arange(ends[t] - sizes[t], ends[t]) for t in tried])
            start = np.where(rank[tried] < k, shares[tried], 0.0)
            start /= start.sum(axis=1, keepdims=True)
            fit, value = _em(like[rows], weight[rows], sizes[tried], start)
            value -= PENALTY * (k - 1) * np.log(total[tried] + 1)
            better = value > gain[tried]
            best[tried[better]], gain[tried[better]] = fit[better], value[better]
        return best


def _em(like, weight, sizes, shares, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Shares after some rounds, and the log-likelihood of each text."""
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = np.add.reduceat(weight, starts)
    for _ in range(rounds):
        joint = like * shares[owner]
        joint *= (weight / joint.sum(axis=1))[:, None]
        shares = np.add.reduceat(joint, starts, axis=0) / total[:, None]
    fit = np.log((like * shares[owner]).sum(axis=1))
    return shares, np.add.reduceat(weight * fit, starts)


_FOUND = "lang_pred string, score double, languages array<string>, shares array<double>"
#: Texts whose mixtures are inferred together.
_TOGETHER = 250


def _inferred(model: Languages, text_col: str):
    @F.pandas_udf(_FOUND)
    def infer(text: pd.Series) -> pd.DataFrame:
        texts = text.fillna("").tolist()
        parts = [model.mixtures(texts[at : at + _TOGETHER]) for at in range(0, len(texts), _TOGETHER)]
        return pd.DataFrame(
            [row for part in parts for row in part], columns=["lang_pred", "score", "languages", "shares"]
        )

    # Else a filter on the result is pushed below it and infers every text a
    # second time, in a second set of Python workers.
    return infer.asNondeterministic()(text_col)


def predict(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every row, with the chosen set and its shares."""
    bounded_batches(docs)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        held_out(id_col).alias("held_out"),
        _inferred(model, text_col).alias("_found"),
    )
    return rows.select("doc_id", "held_out", "_found.*")


def identified(docs: DataFrame, model: Languages, text_col: str = "text") -> DataFrame:
    """All input columns with ``lang_pred`` and ``score``."""
    bounded_batches(docs)
    kept = [c for c in docs.columns if c.lower() not in {"lang_pred", "score"}]
    found = docs.select(*kept, _inferred(model, text_col).alias("_found"))
    return found.select(*kept, "_found.lang_pred", "_found.score")


def held_out(id_col: str = "doc_id"):
    """True for documents that the model does not learn from."""
    return F.coalesce(id_remainder(F.col(id_col), 4) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all."""
    return predict(docs, Languages.fit(docs.filter(~held_out())))
