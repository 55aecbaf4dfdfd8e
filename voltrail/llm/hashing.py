"""Words and shingles of many texts as 64-bit hashes, in flat numpy arrays."""

import numpy as np

#: Bytes of several texts that are hashed together.
TOGETHER = 500_000

_U64 = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(1, 1 << 63, size=256, dtype=_U64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]  # A-Z read as a-z
_BASE = _U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U64(pow(int(_BASE), -1, 1 << 64))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers of a base; made for each batch, as a worker that
    is used again would hold them for good."""
    p = np.full(n, base, dtype=_U64)
    p[:1] = 1
    return np.multiply.accumulate(p, out=p)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes; a one-to-one map."""
    h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


def word_hashes(texts: list[str], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and words per text.

    ``fold`` reads A-Z as a-z.
    """
    if len(texts) > 1 and sum(map(len, texts)) > TOGETHER:
        half = len(texts) // 2
        parts = [word_hashes(texts[:half], fold), word_hashes(texts[half:], fold)]
        return np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts])
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.r_[0, edge]
    starts, ends = edge[0::2], edge[1::2]
    sums = np.r_[_U64(0), np.cumsum((_FOLDED if fold else _BYTE)[data] * _powers(_BASE, len(data)), dtype=_U64)]
    words = mixed((sums[ends] - sums[starts]) * _powers(_BASE_INVERSE, len(data))[starts])
    bounds = np.cumsum([0, *[len(r) + 1 for r in raw]])
    return words, np.diff(np.searchsorted(starts, bounds))


def shingle_sets(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """The distinct word shingles of each text, sorted.

    A text of fewer words is one shingle, all its words; one without words
    has none.
    """
    words, counts = word_hashes(texts)
    out, at = [], 0
    for n in counts.tolist():
        w = words[at : at + n]
        at += n
        width = min(n, size)
        if not n:
            out.append(np.zeros(0, dtype=_U64))
            continue
        h = np.zeros(n - width + 1, dtype=_U64)
        for k in range(width):
            h = h * _BASE + w[k : n - width + 1 + k]
        out.append(np.unique(mixed(h + _U64(width))))
    return out
