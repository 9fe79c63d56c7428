"""Words and shingles of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: The base times this is 1 in 64 bits.
_DIVIDE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones((2, 1), dtype=np.uint64)
#: Bytes that are hashed at once; a longer text is cut between words.
CHUNK = 1 << 18


def powers(n: int) -> np.ndarray:
    """Of the base and of its inverse, n at least."""
    global _powers
    if len(_powers[0]) < n:
        _powers = np.stack([np.cumprod(np.concatenate([[np.uint64(1)], np.full(n + (n >> 3), x)]), dtype=np.uint64) for x in (_BASE, _DIVIDE)])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start places of the words between the bytes 9-13 and 32: of each the sum of its bytes' values by the
    powers of their places in it, as a difference of running sums over all bytes, divided by the power of its start."""
    raw = np.frombuffer(data, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[raw], prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, dtype=np.uint64), start
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    up, down = powers(len(raw))
    np.multiply(_BYTE.take(raw), up[: len(raw)], out=total[1:])
    np.cumsum(total, out=total)
    return mix((total.take(end) - total.take(start)) * down.take(start) ^ (end - start).astype(np.uint64)), start


def word_hashes(texts: Sequence[str]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, A-Z lower-cased."""
    held: list[bytes] = []
    n = 0

    def flush() -> Iterator[np.ndarray]:
        joined = b"\n".join(held)
        h, start = _hash_words(joined)
        cut = np.searchsorted(start, np.cumsum([len(x) + 1 for x in held])[:-1])
        yield from np.split(h, cut)

    for t in texts:
        data = t.encode("utf-8", "surrogatepass").lower()
        if len(data) > CHUNK:
            if held:
                yield from flush()
                held, n = [], 0
            parts, a = [], 0
            while a < len(data):
                b = min(a + CHUNK, len(data))
                while b < len(data) and not _SPACE[data[b]]:
                    b += 1
                parts.append(_hash_words(data[a:b])[0])
                a = b
            yield np.concatenate(parts)
            continue
        if n + len(data) > CHUNK and held:
            yield from flush()
            held, n = [], 0
        held.append(data)
        n += len(data)
    if held:
        yield from flush()


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes (63 bits) of the k-word shingles; fewer words are one shingle, no words none."""
    n = len(words)
    if not n:
        return words
    w = min(k, n)
    h = np.full(n - w + 1, np.uint64(w))
    for i in range(w):
        h = h * _BASE + words[i : n - w + 1 + i]
    return np.unique(mix(h) >> np.uint64(1))
