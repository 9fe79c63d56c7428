"""A grouping genetic algorithm over a histogram of lengths.

Equal lengths are interchangeable, so a bin is a pattern, a tuple of (length, how many), and a solution says how many
bins have each pattern. Its size depends on the number of distinct lengths, not on the number of documents.
"""

from __future__ import annotations

import random

import numpy as np

Pattern = tuple[tuple[int, int], ...]
Solution = dict[Pattern, int]


def load(pattern: Pattern) -> int:
    return sum(a * k for a, k in pattern)


def bins(s: Solution) -> int:
    return sum(s.values())


def fitness(s: Solution, cap: int) -> tuple[float, float]:
    """Fewer bins first; of equally many, those where full and empty bins stand farthest apart."""
    n = bins(s)
    return -n, sum(m * (load(p) / cap) ** 2 for p, m in s.items()) / max(1, n)


def _add(s: Solution, pattern: Pattern, m: int) -> None:
    s[pattern] = s.get(pattern, 0) + m


def _complete(free: np.ndarray, space: int, rng: random.Random) -> list[int]:
    """Lengths that best fit a space: one or two that fill it, else the largest that goes in, and so on."""
    out: list[int] = []
    free = free.copy()
    while space:
        if space < len(free) and free[space] > 0:
            return [*out, space]
        top = min(space - 1, len(free) - 1)
        some = np.flatnonzero(free[: top + 1])
        if not len(some):
            return out
        both = some[(space - some <= top) & (some <= space // 2)]
        both = both[free[space - both] > 0]
        both = both[(2 * both != space) | (free[both] > 1)]
        if len(both):
            n = np.minimum(free[both], free[space - both])
            a = int(both[n.argmax()] if rng.random() < 0.7 else both[rng.randrange(len(both))])
            return [*out, a, space - a]
        a = int(some[-1])
        out.append(a)
        free[a] -= 1
        space -= a
    return out


def _fill(s: Solution, free: np.ndarray, cap: int, rng: random.Random) -> None:
    """Free items into new bins: the largest opens one, which is then completed; as many such bins as there are items."""
    while True:
        some = np.flatnonzero(free)
        if not len(some):
            return
        first = int(some[-1])
        free[first] -= 1
        items = [first, *_complete(free, cap - first, rng)]
        free[first] += 1
        sizes, k = np.unique(items, return_counts=True)
        m = int((free[sizes] // k).min())
        free[sizes] -= k * m
        _add(s, tuple(zip(sizes.tolist(), k.tolist(), strict=True)), m)


def _refit(s: Solution, free: np.ndarray, cap: int, rng: random.Random) -> None:
    """Displaced items into the open bins, fullest first, then into new ones."""
    for p in sorted((p for p in s if load(p) < cap), key=load, reverse=True):
        while p in s and free.any():
            items = _complete(free, cap - load(p), rng)
            if not items:
                break
            sizes, k = np.unique(items, return_counts=True)
            m = min(s[p], int((free[sizes] // k).min()))
            free[sizes] -= k * m
            more = dict(p)
            for a, n in zip(sizes.tolist(), k.tolist(), strict=True):
                more[a] = more.get(a, 0) + n
            s[p] -= m
            if not s[p]:
                del s[p]
            _add(s, tuple(sorted(more.items())), m)
    _fill(s, free, cap, rng)


def first_solution(counts: np.ndarray, cap: int, rng: random.Random) -> Solution:
    s: Solution = {}
    _fill(s, counts.copy(), cap, rng)
    return s


def crossover(one: Solution, two: Solution, counts: np.ndarray, cap: int, rng: random.Random) -> Solution:
    """Whole well-filled bins of two into one; bins of one that hold an item now present twice go; what else they held is placed again."""
    child: Solution = {}
    use = np.zeros(len(counts), dtype=np.int64)
    best = [p for p in two if load(p) >= cap - cap // 256]
    for p in rng.sample(best, (len(best) + 1) // 2):
        child[p] = two[p]
        for a, k in p:
            use[a] += k * two[p]
    rest = list(one.items())
    rng.shuffle(rest)
    rest.sort(key=lambda x: load(x[0]), reverse=True)
    for p, m in rest:
        fit = min(m, *(int((counts[a] - use[a]) // k) for a, k in p))
        if fit > 0:
            _add(child, p, fit)
            for a, k in p:
                use[a] += k * fit
    _refit(child, counts - use, cap, rng)
    return child


def mutate(s: Solution, counts: np.ndarray, cap: int, rng: random.Random) -> Solution:
    """Empty the open bins and a few others, and place what they held again."""
    out = dict(s)
    free = np.zeros(len(counts), dtype=np.int64)
    gone = [p for p in out if load(p) < cap] + rng.sample(list(out), max(1, len(out) // 16))
    for p in dict.fromkeys(gone):
        m = out.pop(p)
        for a, k in p:
            free[a] += k * m
    _refit(out, free, cap, rng)
    return out


def evolve(counts: np.ndarray, cap: int, seed: int, start: list[Solution], population: int, generations: int) -> list[Solution]:
    """One island for one epoch; the best two of its population."""
    rng = random.Random(seed)
    least = -(-int((counts * np.arange(len(counts))).sum()) // cap)
    pool = list(start)
    while len(pool) < population:
        pool.append(first_solution(counts, cap, rng))
    score = lambda s: fitness(s, cap)
    for _ in range(generations):
        pool.sort(key=score, reverse=True)
        if bins(pool[0]) <= least:
            break
        one, two = (min(rng.sample(range(len(pool)), 2)) for _ in range(2))
        child = crossover(pool[one], pool[two], counts, cap, rng)
        if rng.random() < 0.5:
            child = mutate(child, counts, cap, rng)
        pool[-1] = child
    pool.sort(key=score, reverse=True)
    return pool[:2]
