"""64-bit hashes of words and byte strings, vectorised over the bytes of many texts at once."""

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)
LOWER_BYTE = BYTE.copy()
LOWER_BYTE[65:91] = BYTE[97:123]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0..n-1 (or of its inverse), kept for the next call up to 4 million."""
    name = "inverse" if inverse else "base"
    held = _powers.get(name)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 20), INVERSE if inverse else BASE, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if len(held) <= 4 << 20:
            _powers[name] = held
    return held[:n]


def batches_of_bytes(texts: list[bytes], most: int = 2 << 20):
    """Index ranges of texts of about ``most`` bytes together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and where each text's words begin (len(texts) + 1 places)."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    blank = BLANK[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER_BYTE if lower else BYTE)[data] * powers(len(data)), out=total[1:])
    sums = (total[ends] - total[starts]) * powers(len(data), inverse=True)[starts]
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return mixed(sums + (ends - starts).astype(np.uint64)), np.searchsorted(starts, bounds)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole sequence if it is shorter."""
    if len(words) == 0:
        return words
    size_here = min(size, len(words))
    out = np.zeros(len(words) - size_here + 1, np.uint64)
    for k in range(size_here):
        out = mixed(out * BASE + words[k : k + len(out)])
    return out if size_here == size else mixed(out + np.uint64(size_here))
