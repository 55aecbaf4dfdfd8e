"""SentencePiece BPE: encoding in vectorised merge rounds, and decoding.

The model file is read as it is; nothing is trained.  A text is cut into units
that no piece crosses, so units are independent of each other; the units of a
batch that a worker has not met yet are encoded together: their symbols lie in
one flat array, and each round finds the best pair of every unit (the lowest
rank, the leftmost on ties), merges it in all units at once and compacts the
array, until no unit has a pair left.  One merge per unit and round keeps the
library's order of merges also where a merge makes a better pair than the one
just used.  A round costs as much as there are symbols, so a long unit is first
cut wherever no piece holds both signs beside the cut, and what is still long
takes its merges, in the same order, from a heap.

A document's work stays in its row: nothing is shuffled, a lost task only
repeats its own rows, and a batch and the unit cache bound the memory.  Long
units are not remembered.

Defined cases: a NULL text counts as empty, and an empty text is the begin and
the end id; repeated rows each get their row; NULL ids are kept; other input
columns are ignored by ``encoded`` and kept by ``with_ids``.
"""

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltrail.llm.text import bounded_batches, give_back

#: Signs of several texts that are encoded together.
TOGETHER = 250_000
#: Units a worker remembers; the cache starts afresh beyond it.
CACHE_UNITS = 60_000
#: Symbols from which a unit is long.
LONG_UNIT = 256

# Field numbers and piece types of the model file.
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_SPACE = "▁"
_UNKNOWN_TEXT = " ⁇ "


def _replace_each_byte(error):
    return "�" * (error.end - error.start), error.end


codecs.register_error("each-byte", _replace_each_byte)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        else:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool

    @classmethod
    def load(cls, path: str) -> "Model":
        with open(path, "rb") as file:
            data = file.read()
        pieces, scores, kinds, prefix = [], [], [], True
        for number, value in _fields(data):
            if number == 1:
                entry = dict(_fields(value))
                pieces.append(entry[1].decode())
                scores.append(struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0)
                kinds.append(entry.get(3, _NORMAL))
            elif number == 2:
                if dict(_fields(value)).get(3, 1) != 2:
                    raise ValueError("not a BPE model")
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("the model normalises its texts")
                prefix = bool(rules.get(3, 1))
        if _USER in kinds:
            raise ValueError("the model has symbols of its user's own")
        return cls(pieces, scores, kinds, prefix)


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: Model):
        self.model = model
        kinds = model.kinds
        ids = {p: i for i, p in enumerate(model.pieces) if kinds[i] == _NORMAL}
        self.begin = model.pieces.index("<s>")
        self.end = model.pieces.index("</s>")
        byte_ids = [model.pieces.index(f"<0x{b:02X}>") for b in range(256)]
        self._byte_ids = np.array(byte_ids, dtype="<u4")
        # Symbols: pieces by id, then characters that occur only inside pieces.
        symbols = dict(ids)
        for p in ids:
            for c in p:
                symbols.setdefault(c, len(model.pieces) + len(symbols))
        self._width = max(symbols.values()) + 2
        self._symbol = np.full(0x110000, self._width - 1, dtype=np.int64)
        for c, s in symbols.items():
            if len(c) == 1:
                self._symbol[ord(c)] = s
        order = np.unique([-model.scores[i] for i in ids.values()], return_inverse=True)[1]
        rank = dict(zip(ids, order.tolist(), strict=True))
        pairs = {}
        for p, i in ids.items():
            for cut in range(1, len(p)):
                left, right = symbols.get(p[:cut]), symbols.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left * self._width + right] = (rank[p], i)
        keys = np.array(sorted(pairs), dtype=np.int64)
        self._keys = keys
        self._rank = np.array([pairs[k][0] for k in keys.tolist()], dtype=np.int64)
        self._made = np.array([pairs[k][1] for k in keys.tolist()], dtype=np.int64)
        self._unit = self._unit_pattern(ids)
        self._cache: dict[str, bytes] = {}
        beside = {ord(a) << 21 | ord(b) for p in ids for a, b in zip(p, p[1:], strict=False)}
        self._beside = np.array(sorted(beside), dtype=np.int64)
        self._controls = {i for i, k in enumerate(kinds) if k == _CONTROL}
        self._text = [self._piece_bytes(i) for i in range(len(model.pieces))]

    def _piece_bytes(self, i: int) -> bytes:
        kind, piece = self.model.kinds[i], self.model.pieces[i]
        if kind == _BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == _CONTROL:
            return b""
        if kind == _UNKNOWN:
            return _UNKNOWN_TEXT.encode()
        return piece.replace(_SPACE, " ").encode()

    @staticmethod
    def _unit_pattern(ids) -> re.Pattern:
        """Units that no piece crosses.

        Pieces have the space sign at their start only, so a unit starts at a
        run of signs; blanks that are in no longer piece stand alone.
        """
        long = [p for p in ids if len(p) > 1]
        alone = "".join(c for c in "\n\t\r\x0b\x0c" if not any(c in p for p in long))
        if any(_SPACE in p.lstrip(_SPACE) for p in long):
            return re.compile(r"(?s).+")
        return re.compile(f"{_SPACE}*[^{_SPACE}{alone}]+|{_SPACE}+" + (f"|[{alone}]" if alone else ""))

    # --- encoding ---------------------------------------------------------

    def _merge(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all units after all merges, and where each unit starts."""
        size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le"), dtype="<u4")
        flat = self._symbol[points]
        unit = np.repeat(np.arange(len(units)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = np.iinfo(np.int64).max
        while len(flat):
            key = flat[:-1] * self._width + flat[1:]
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            fits = (self._keys[at] == key) & (unit[:-1] == unit[1:])
            place = np.flatnonzero(fits)
            owner = unit[place]
            # rank and place in one number: the least is the leftmost best pair
            worth = self._rank[at[place]] * len(flat) + place
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]][: len(owner)])
            if not len(starts):
                done.append((unit, flat))
                break
            best = np.minimum.reduceat(worth, starts) % len(flat)
            flat[best] = self._made[at[best]]
            keep = np.ones(len(flat), dtype=bool)
            keep[best + 1] = False
            live = np.zeros(len(units), dtype=bool)
            live[owner[starts]] = True
            active = live[unit]
            if not active.all():
                done.append((unit[~active], flat[~active]))
            keep &= active
            flat, unit = flat[keep], unit[keep]
        units_of = np.concatenate([u for u, _ in done]) if done else unit
        all_symbols = np.concatenate([s for _, s in done]) if done else flat
        order = np.argsort(units_of, kind="stable")
        return all_symbols[order], np.searchsorted(units_of[order], np.arange(len(units) + 1))

    @cached_property
    def _pairs(self) -> dict[int, tuple[int, int]]:
        """Rank and piece of each pair; only long units need it."""
        return dict(zip(self._keys.tolist(), zip(self._rank.tolist(), self._made.tolist(), strict=True), strict=True))

    def _merge_long(self, unit: str) -> np.ndarray:
        """Symbols of one unit after all merges, best pair first from a heap."""
        flat = self._symbol[np.frombuffer(unit.encode("utf-32-le"), dtype="<u4")]
        n = len(flat)
        key = flat[:-1] * self._width + flat[1:]
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        place = np.flatnonzero(self._keys[at] == key)
        heap = (self._rank[at[place]] * n + place).tolist()
        heapq.heapify(heap)
        symbols, after, before = flat.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, width = self._pairs, self._width
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if symbols[i] < 0 or j == n:
                continue
            best = pairs.get(symbols[i] * width + symbols[j])
            if best is None or best[0] != rank:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = best[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := pairs.get(symbols[i] * width + symbols[k])) is not None:
                    heapq.heappush(heap, new[0] * n + i)
            if (h := before[i]) >= 0 and (new := pairs.get(symbols[h] * width + symbols[i])) is not None:
                heapq.heappush(heap, new[0] * n + h)
        merged = np.array(symbols, dtype=np.int64)
        return merged[merged >= 0]

    def _cut(self, unit: str) -> list[str]:
        """A long unit in parts that no piece crosses."""
        points = np.frombuffer(unit.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        key = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self._beside, key), len(self._beside) - 1)
        cuts = (np.flatnonzero(self._beside[at] != key) + 1).tolist()
        return [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True)]

    def _learn(self, units: list[str]) -> None:
        self._keep([u for u in units if len(u) < LONG_UNIT])
        for unit in (u for u in units if len(u) >= LONG_UNIT):
            self._keep([unit], self._merge_long(unit))

    def _keep(self, units: list[str], merged: np.ndarray | None = None) -> None:
        """Remember the ids of units; ``merged`` are the symbols of a long one."""
        if not units:
            return
        symbols, starts = self._merge(units) if merged is None else (merged, np.array([0, len(merged)]))
        pieces = len(self.model.pieces)
        raw = symbols.astype("<u4").tobytes()
        at = (4 * starts).tolist()
        self._cache.update(zip(units, map(raw.__getitem__, map(slice, at, at[1:])), strict=False))
        odd = np.unique(np.searchsorted(starts, np.flatnonzero(symbols >= pieces), side="right") - 1)
        for k in odd.tolist():  # these hold characters that are no piece: their bytes
            unit, parts, place = units[k], [], 0
            for s in symbols[starts[k] : starts[k + 1]].tolist():
                if s < pieces:
                    parts.append(struct.pack("<I", s))
                    place += len(self.model.pieces[s])
                else:
                    parts.append(self._byte_ids[list(unit[place].encode())].tobytes())
                    place += 1
            self._cache[unit] = b"".join(parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        out, held, signs = [], [], 0
        for text in texts:
            held.append(text)
            signs += len(text)
            if signs >= TOGETHER:
                out += self._encode(held)
                held, signs = [], 0
        return out + self._encode(held)

    def _encode(self, texts: list[str]) -> list[bytes]:
        head, tail = struct.pack("<I", self.begin), struct.pack("<I", self.end)
        prefix = _SPACE if self.model.dummy_prefix else ""
        split = [self._unit.findall(prefix + t.replace(" ", _SPACE)) if t else [] for t in texts]
        if len(self._cache) > CACHE_UNITS:
            self._cache.clear()
        for k, units in enumerate(split):
            if any(len(u) >= LONG_UNIT for u in units):
                split[k] = [p for u in units for p in (self._cut(u) if len(u) >= LONG_UNIT else (u,))]
        new = set(chain.from_iterable(split)).difference(self._cache)
        if new:
            self._learn(list(new))
        known = self._cache.__getitem__
        found = [b"".join((head, *map(known, units), tail)) for units in split]
        for unit in (u for u in new if len(u) >= LONG_UNIT):
            del self._cache[unit]
        return found

    # --- decoding ---------------------------------------------------------

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        spans, at = [], 0  # control pieces also end a run of byte pieces
        for i, n in enumerate(numbers):
            if n in self._controls:
                spans.append(numbers[at:i])
                at = i + 1
        spans.append(numbers[at:])
        raw = [b"".join(map(self._text.__getitem__, x)) for x in spans]
        if self.model.dummy_prefix:
            k = next((k for k, x in enumerate(spans) if x), None)
            if k is not None and self.model.pieces[spans[k][0]].startswith(_SPACE):
                raw[k] = raw[k][1:]
        return "".join(x.decode("utf-8", "each-byte") for x in raw)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a model file, built once per worker."""
    return Codec(Model.load(path))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def with_ids(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """All input columns and ``ids``, an array of int."""
    path = path or default_model()
    kept = [c for c in docs.columns if c.lower() != "ids"]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(text: pd.Series) -> pd.Series:
        found = codec(path).encode(text.fillna("").tolist())
        give_back()
        return pd.Series([np.frombuffer(x, dtype="<i4") for x in found])

    bounded_batches(docs)
    return docs.select(*kept, ids(text_col).alias("ids"))


def with_text(encoded_docs: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """All input columns and ``decoded``, the text of the ids; NULL ids give NULL."""
    path = path or default_model()
    kept = [c for c in encoded_docs.columns if c.lower() != "decoded"]

    @F.pandas_udf(T.StringType())
    def decoded(ids: pd.Series) -> pd.Series:
        back = codec(path).decode
        return ids.map(lambda x: None if x is None else back(np.asarray(x).astype("<u4").tobytes()))

    bounded_batches(encoded_docs)
    return encoded_docs.select(*kept, decoded(ids_col).alias("decoded"))


_DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids and of the text decoded from them, per document."""
    path = path or default_model()

    @F.pandas_udf(_DIGEST)
    def digest(text: pd.Series) -> pd.DataFrame:
        c = codec(path)
        ids = c.encode(text.fillna("").tolist())
        give_back()
        return pd.DataFrame(
            {
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids],
            }
        )

    bounded_batches(docs)
    return docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("_d")).select("doc_id", "_d.*")
