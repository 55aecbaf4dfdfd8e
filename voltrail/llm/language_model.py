"""A Kneser-Ney language model counted in Spark and mapped into the workers.

Interpolated modified Kneser-Ney of order 2 over word tokens.  Counting runs
in three passes of bounded tasks:

1. words: hashes of tokens are counted per task, summed by Spark and stored
   as sorted arrays of hashes with their counts; a word's place is its number;
2. pairs: each task counts pairs of numbers and deals them, packed, to ranges
   of the pair order.  The ranges follow from the word counts and hold about
   equally many tokens; a word that a third of all tokens are is split by the
   word that follows.  Each range is stored as a sorted array;
3. per word, from the stored ranges: how many words it follows, and how many
   words follow it once, twice or more often, summed per block of numbers.

Workers map the stored files into memory and look tokens up by binary search.
The files lie in the folder that the cluster names for checkpoints; where it
is remote, a worker maps a local copy that it unlinks at once.  A retried task
writes files of its own and only reported files are read.

Defined cases: a NULL text counts as empty, an empty text is its end token
alone; a NULL id is learned from; a corpus without training text has no words,
and then every token has base probability 1 and score log10 of 1; repeated
rows count as often as they occur; other input columns are ignored.
"""

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.llm.hashing import word_hashes
from voltrail.llm.text import bounded_batches, id_remainder
from voltrail.session import checkpointed, scratch

#: Words in a stored block, tokens in a range of pairs.
WORD_BLOCK = 1_000_000
RANGE_TOKENS = 4_000_000
#: Pairs that a counting task holds before it adds up equal ones.
HELD_PAIRS = 3_000_000

#: The hash of the end token; no word has it but by chance.
END = np.int64(-6148914691236517205)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of all texts in order, and tokens per text."""
    words, per_text = word_hashes(texts, fold=True)
    return np.insert(words.view(np.int64), np.cumsum(per_text), END), per_text + 1


# --- stored arrays ---------------------------------------------------------


def _store(folder: str, name: str, array: np.ndarray) -> str:
    """Write an array's bytes below ``folder``; returns where."""
    system, root = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    system.create_dir(root, recursive=True)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(path) as out:
        out.write(np.ascontiguousarray(array).data.cast("B") if array.size else b"")
    return f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}"


@lru_cache(maxsize=4096)
def _mapped(uri: str, dtype: str) -> np.ndarray:
    """A stored array, mapped into memory."""
    system, path = pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    if system.get_file_info(path).size == 0:
        return np.zeros(0, dtype=dtype)
    if isinstance(system, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    handle, copy = tempfile.mkstemp()
    try:
        with system.open_input_stream(path) as source, os.fdopen(handle, "wb") as target:
            while chunk := source.read(1 << 22):
                target.write(chunk)
        return np.memmap(copy, dtype=dtype, mode="r")
    finally:
        os.unlink(copy)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte plane by byte plane, compressed."""
    planes = [a.view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, *dtypes: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    widths = [np.dtype(d).itemsize for d in dtypes]
    n, at, out = len(raw) // sum(widths), 0, []
    for dtype, w in zip(dtypes, widths, strict=True):
        plane = raw[at : at + n * w].reshape(w, n)
        out.append(np.ascontiguousarray(plane.T).view(dtype).ravel())
        at += n * w
    return out


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and where each starts."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[starts], starts


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    distinct, starts = _runs(keys[order])
    return distinct, np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]


def _locate(sorted_values: np.ndarray, firsts: np.ndarray, files: list[str], dtype: str):
    """Place of each of some sorted values in files that follow each other.

    Yields (slice of the values, file number, place, found).
    """
    bounds = np.r_[np.searchsorted(sorted_values, firsts, side="left"), len(sorted_values)]
    bounds[0] = 0
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if a < b:
            keys = _mapped(files[k], dtype)
            part = sorted_values[a:b]
            at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
            yield slice(a, b), k, at, keys[at] == part


# --- words -----------------------------------------------------------------


@dataclass(frozen=True)
class Words:
    """Stored words in the order of their hashes."""

    firsts: np.ndarray  # lowest hash of each block
    offsets: np.ndarray  # number of each block's first word
    keys: list[str]
    counts: list[str]
    total: int
    block: int  # words in a block of context counts

    @property
    def size(self) -> int:
        return int(self.offsets[-1])

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of each hash; -1 and 0 for an unknown word."""
        distinct, back = np.unique(hashes, return_inverse=True)
        number = np.full(len(distinct), -1, dtype=np.int64)
        count = np.zeros(len(distinct), dtype=np.int64)
        if self.size:
            for part, k, at, found in _locate(distinct, self.firsts, self.keys, "<i8"):
                number[part] = np.where(found, at + self.offsets[k], -1)
                count[part] = np.where(found, _mapped(self.counts[k], "<i8")[at], 0)
        return number[back], count[back]


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(text_col, F.lit("")).alias("text"))


def count_words(docs: DataFrame, folder: str, text_col: str = "text", word_block: int = WORD_BLOCK) -> Words:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            found, n = np.unique(tokens(batch["text"].tolist())[0], return_counts=True)
            keys, counts = _summed(np.r_[keys, found], np.r_[counts, n])
            if len(keys) > HELD_PAIRS:
                yield pd.DataFrame({"h": keys, "n": counts})
                keys, counts = keys[:0], counts[:0]
        yield pd.DataFrame({"h": keys, "n": counts})

    bounded_batches(docs)
    counted = checkpointed(
        _texts(docs, text_col).mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    )
    size = counted.count()
    blocks = max(1, -(-size // word_block))
    # Blocks are ranges of the hash, which is uniform, so they are equally large.
    block = F.least(F.lit(blocks - 1), F.floor((F.col("h") / 2.0**64 + 0.5) * blocks)).cast("int")

    def store(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("h")
        h, n = part["h"].to_numpy(dtype=np.int64), part["n"].to_numpy(dtype=np.int64)
        return pd.DataFrame(
            {
                "first": h[:1],
                "size": [len(h)],
                "total": [int(n.sum())],
                "keys": [_store(folder, "words", h)],
                "counts": [_store(folder, "word-counts", n)],
            }
        )

    stored = (
        counted.withColumn("block", block)
        .groupBy("block")
        .applyInPandas(store, "first long, size long, total long, keys string, counts string")
        .toPandas()  # one row per block of words
        .sort_values("first")
    )
    return Words(
        stored["first"].to_numpy(dtype=np.int64),
        np.r_[0, np.cumsum(stored["size"].to_numpy(dtype=np.int64))],
        stored["keys"].tolist(),
        stored["counts"].tolist(),
        int(stored["total"].sum()),
        word_block,
    )


# --- pairs -----------------------------------------------------------------


def _pairs(words: Words, texts: list[str]):
    """Pair of each token with the one before it, and facts on the tokens.

    The end token also stands before the first token of a text.  A pair is
    the two numbers in one integer; -1 where one of them is unknown.
    """
    hashes, per_text = tokens(texts)
    number, count = words.numbers(hashes)
    ends = np.cumsum(per_text)
    before = np.r_[0, number[:-1]]
    before[np.r_[0, ends[:-1]]] = number[ends[0] - 1]
    pair = np.where((before < 0) | (number < 0), -1, (before << 32) | number)
    return pair, before, number, count, per_text


def _range_firsts(words: Words, ranges: int) -> np.ndarray:
    """Pairs at which ranges of about equally many tokens start."""
    firsts, done, want = [0], 0, 1
    for k, file in enumerate(words.counts):
        counts = np.asarray(_mapped(file, "<i8"))
        upto = done + np.cumsum(counts)
        while want < ranges and words.total * want / ranges < upto[-1]:
            mass = words.total * want / ranges
            i = int(np.searchsorted(upto, mass, side="right"))
            # A word that spans several ranges is cut by the words that follow:
            # numbers of words follow hashes, so their mass is about uniform.
            inside = (mass - (upto[i] - counts[i])) / counts[i]
            firsts.append(((int(words.offsets[k]) + i) << 32) | int(inside * words.size))
            want += 1
        done = int(upto[-1])
    return np.array(sorted(set(firsts)), dtype=np.int64)


@dataclass(frozen=True)
class Pairs:
    firsts: np.ndarray
    keys: list[str]
    counts: list[str]
    counts_of_counts: np.ndarray  # pairs that occur once, twice, 3 and 4 times

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """How often each pair occurs."""
        distinct, back = np.unique(pairs, return_inverse=True)
        out = np.zeros(len(distinct), dtype=np.int64)
        known = np.searchsorted(distinct, 0)
        if len(self.firsts) and known < len(distinct):
            tail = out[known:]
            for part, k, at, found in _locate(distinct[known:], self.firsts, self.keys, "<i8"):
                tail[part] = np.where(found, _mapped(self.counts[k], "<u4")[at], 0)
        return out[back]


_STORED = "range int, first long, keys string, counts string, n1 long, n2 long, n3 long, n4 long"


def count_pairs(
    docs: DataFrame, words: Words, folder: str, text_col: str = "text", range_tokens: int = RANGE_TOKENS
) -> Pairs:
    ranges = max(1, -(-words.total // range_tokens))
    firsts = _range_firsts(words, ranges)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def deal(keys, counts):
            bounds = np.r_[np.searchsorted(keys, firsts), len(keys)]
            for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                if a < b:
                    part = keys[a:b]
                    packed = _pack(
                        (part >> 32).astype("<u4"), part.astype("<u4"), counts[a:b].astype("<u4")
                    )
                    yield pd.DataFrame({"range": [k], "packed": [packed]})

        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            found, n = np.unique(_pairs(words, batch["text"].tolist())[0], return_counts=True)
            keys, counts = _summed(np.r_[keys, found], np.r_[counts, n])
            if len(keys) > HELD_PAIRS:
                yield from deal(keys, counts)
                keys, counts = keys[:0], counts[:0]
        yield from deal(keys, counts)

    def store(part: pd.DataFrame) -> pd.DataFrame:
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for packed in part["packed"]:
            left, right, n = _unpack(packed, "<u4", "<u4", "<u4")
            more = (left.astype(np.int64) << 32) | right
            keys, counts = np.r_[keys, more], np.r_[counts, n.astype(np.int64)]
            if len(keys) > 2 * HELD_PAIRS:
                keys, counts = _summed(keys, counts)
        keys, counts = _summed(keys, counts)
        seen = np.bincount(np.minimum(counts, 5), minlength=6)
        return pd.DataFrame(
            {
                "range": [int(part["range"].iloc[0])],
                "first": keys[:1],
                "keys": [_store(folder, "pairs", keys)],
                "counts": [_store(folder, "pair-counts", counts.astype("<u4"))],
                **{f"n{i}": [int(seen[i])] for i in range(1, 5)},
            }
        )

    stored = (
        _texts(docs, text_col)
        .mapInPandas(count, "range int, packed binary")
        .groupBy("range")
        .applyInPandas(store, _STORED)
        .toPandas()  # one row per range of pairs
        .sort_values("first")
    )
    return Pairs(
        stored["first"].to_numpy(dtype=np.int64),
        stored["keys"].tolist(),
        stored["counts"].tolist(),
        stored[["n1", "n2", "n3", "n4"]].sum().to_numpy(dtype=float),
    )


# --- what follows and precedes a word ---------------------------------------


@dataclass(frozen=True)
class Contexts:
    """Per block of word numbers: words before, words after by frequency."""

    before: list[str]
    after: list[str]
    counts_of_counts: np.ndarray
    pairs: int


def count_contexts(spark, words: Words, pairs: Pairs, folder: str) -> Contexts:
    word_block = words.block
    files = spark.createDataFrame(list(zip(pairs.keys, pairs.counts, strict=True)), "keys string, counts string")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys_file, counts_file in zip(batch["keys"], batch["counts"], strict=True):
                keys = np.asarray(_mapped(keys_file, "<i8"))
                often = np.minimum(np.asarray(_mapped(counts_file, "<u4")), 3).astype(np.int64)
                left, starts = _runs(keys >> 32)
                after = np.stack([np.add.reduceat((often == i).astype(np.int64), starts) for i in (1, 2, 3)])
                right, before = np.unique(keys & 0xFFFFFFFF, return_counts=True)
                for kind, numbers, values in (
                    ("after", left, after),
                    ("before", right, before[None]),
                ):
                    blocks, at = _runs(numbers // word_block)
                    for block, a, b in zip(blocks, at, np.r_[at[1:], len(numbers)], strict=True):
                        packed = _pack(
                            (numbers[a:b] % word_block).astype("<u4"),
                            *[v[a:b].astype("<u4") for v in values],
                        )
                        yield pd.DataFrame({"kind": [kind], "block": [int(block)], "packed": [packed]})

    size = words.size

    def store(part: pd.DataFrame) -> pd.DataFrame:
        block, kind = int(part["block"].iloc[0]), part["kind"].iloc[0]
        columns = 3 if kind == "after" else 1
        total = np.zeros((min(word_block, size - block * word_block), columns), dtype=np.int64)
        for packed in part["packed"]:
            number, *values = _unpack(packed, *["<u4"] * (columns + 1))
            total[number] += np.stack(values, axis=1)
        seen = np.bincount(np.minimum(total[:, 0], 5), minlength=6) if kind == "before" else np.zeros(6, int)
        return pd.DataFrame(
            {
                "kind": [kind],
                "block": [block],
                "file": [_store(folder, kind, total.astype("<u4"))],
                **{f"n{i}": [int(seen[i])] for i in range(1, 5)},
                "n": [int(total.sum()) if kind == "before" else 0],
            }
        )

    stored = (
        files.repartition(max(1, len(pairs.keys)))
        .mapInPandas(split, "kind string, block int, packed binary")
        .groupBy("kind", "block")
        .applyInPandas(store, "kind string, block int, file string, n1 long, n2 long, n3 long, n4 long, n long")
        .toPandas()  # two rows per block of words
        .sort_values("block")
    )
    by = {kind: stored.loc[stored["kind"] == kind, "file"].tolist() for kind in ("before", "after")}
    return Contexts(
        by["before"],
        by["after"],
        stored[["n1", "n2", "n3", "n4"]].sum().to_numpy(dtype=float),
        int(stored["n"].sum()),
    )


def discounts(n: np.ndarray) -> np.ndarray:
    """What is taken off a count of 0, 1, 2, and 3 or more.

    Where a count of counts is 0 the estimate is undefined; a count then loses
    half of its least value, which keeps all probabilities positive.
    """
    out = np.array([0.0, 0.5, 0.5, 0.5])
    if (n[:3] > 0).all():
        y = n[0] / (n[0] + 2 * n[1])
        found = np.array([i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)])
        good = (found > 0) & (found < np.array([1, 2, 3]))
        out[1:] = np.where(good, found, 0.5)
    return out


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the few numbers that hold for all words."""

    words: Words
    pairs: Pairs
    contexts: Contexts

    @classmethod
    def fit(
        cls,
        docs: DataFrame,
        text_col: str = "text",
        word_block: int = WORD_BLOCK,
        range_tokens: int = RANGE_TOKENS,
    ) -> "Model":
        """Count a corpus; files go to a new folder below the shared one."""
        spark = docs.sparkSession
        folder = scratch(spark, "language-model")
        words = count_words(docs, folder, text_col, word_block)
        pairs = count_pairs(docs, words, folder, text_col, range_tokens)
        return cls(words, pairs, count_contexts(spark, words, pairs, folder))

    def _by_number(self, files: list[str], number: np.ndarray, columns: int) -> np.ndarray:
        out = np.zeros((len(number), columns), dtype=np.int64)
        block = number // self.words.block
        for k in np.unique(block[number >= 0]).tolist():
            here = block == k
            out[here] = _mapped(files[k], "<u4").reshape(-1, columns)[number[here] % self.words.block]
        return out

    def scores(self, texts: list[str]) -> pd.DataFrame:
        """Token numbers, unigram base score and model score of each text."""
        pair, before, number, count, per_text = _pairs(self.words, texts)
        starts = np.r_[0, np.cumsum(per_text)[:-1]]
        total, size = self.words.total, self.words.size
        base = np.log10((count + 0.5) / (total + 0.5 * (size + 1)))
        if size:
            score = np.log10(self._probability(pair, before, number))
        else:
            score = np.zeros(len(count))
        return pd.DataFrame(
            {
                "n_tokens": per_text,
                "n_known": np.add.reduceat((count > 0).astype(np.int64), starts),
                "base_score": np.add.reduceat(base, starts),
                "score": np.add.reduceat(score, starts),
            }
        )

    def _probability(self, pair, before, number) -> np.ndarray:
        word, back = np.unique(np.r_[number, before], return_inverse=True)
        number_at, before_at = back[: len(number)], back[len(number) :]
        # Words by how many different words they follow, over a uniform share.
        low = discounts(self.contexts.counts_of_counts)
        seen = self._by_number(self.contexts.before, word, 1)[:, 0]
        kinds = self.contexts.pairs
        by_kind = np.maximum(seen - low[np.minimum(seen, 3)], 0)
        left_over = self._left_over_low(low)
        lower = (by_kind + left_over / (self.words.size + 1)) / kinds
        # Pairs over that.
        high = discounts(self.pairs.counts_of_counts)
        after = self._by_number(self.contexts.after, word, 3)
        often = self._context_counts(word)
        spare = np.where(often > 0, (after @ high[1:]) / np.maximum(often, 1), 1.0)
        n = self.pairs.find(pair)
        context = often[before_at]
        direct = np.where(n > 0, (n - high[np.minimum(n, 3)]) / np.maximum(context, 1), 0.0)
        return direct + spare[before_at] * lower[number_at]

    def _left_over_low(self, low: np.ndarray) -> float:
        """All that the lower order's discounts take off."""
        n = self.contexts.counts_of_counts
        return float(low[1] * n[0] + low[2] * n[1] + low[3] * (self.words.size - n[0] - n[1]))

    def _context_counts(self, word: np.ndarray) -> np.ndarray:
        out = np.zeros(len(word), dtype=np.int64)
        block = np.searchsorted(self.words.offsets, word, side="right") - 1
        for k in np.unique(block[word >= 0]).tolist():
            here = (block == k) & (word >= 0)
            out[here] = _mapped(self.words.counts[k], "<i8")[word[here] - self.words.offsets[k]]
        return out


_SCORES = "n_tokens long, n_known long, base_score double, score double"


def held_out(id_col: str = "doc_id"):
    return F.coalesce(id_remainder(F.col(id_col), 5) == 1, F.lit(False))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    @F.pandas_udf(_SCORES)
    def scored(text: pd.Series) -> pd.DataFrame:
        return model.scores(text.fillna("").tolist())

    bounded_batches(docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), scored(text_col).alias("_s"))
    return rows.select(
        "doc_id",
        "held_out",
        "_s.n_tokens",
        "_s.n_known",
        F.lit(model.words.total).cast("long").alias("train_tokens"),
        "_s.base_score",
        "_s.score",
    )


def perplexity(score: str = "score", tokens: str = "n_tokens"):
    """Perplexity per token of a scored text."""
    return F.pow(F.lit(10.0), -F.col(score) / F.col(tokens))


def score_all(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, score all."""
    return score(docs, Model.fit(docs.filter(~held_out())))
