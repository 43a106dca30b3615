"""Vectorised 64-bit hashes of the words of a text."""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
# Words longer than this are hashed one by one.
_LONG = 512
_STEP = 1 << 22
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 17), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs data[start:end].

    The hash is a polynomial of random byte values modulo 2^64, taken for all runs at once
    as differences of one prefix sum, and mixed with the run's length.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[:-1], out=sums[1:])
    length = (ends - starts).astype(np.uint64)
    out = mix((sums[ends] - sums[starts]) * inverse[starts] + length * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(ends - starts > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of ``text`` (runs of anything but ASCII white space), A-Z lower-cased."""
    raw, out, at = text.encode("utf-8", "surrogatepass").lower(), [], 0
    while at < len(raw):
        end = at + _STEP
        if end < len(raw):  # cut at white space, or wherever a word ends after it
            while end < len(raw) and not SPACE[raw[end]]:
                end += 1
        data = np.frombuffer(raw, np.uint8, min(end, len(raw)) - at, at)
        edge = np.diff(np.concatenate(([True], SPACE[data], [True])).astype(np.int8))
        out.append(run_hashes(data, np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words; of a shorter text, its whole sequence."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = mix((h ^ words[k : k + n]) * np.uint64(_BASE) + np.uint64(k))
    return np.unique(h)
