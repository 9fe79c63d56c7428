"""A bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word is the vector of its own entry (if the vocabulary has it) plus the mean vectors of its hashed character trigrams
and 5-grams, ends marked.
Windows of words run through one recurrent layer in each direction; attention weighs the steps; a logit comes out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .shingles import mix

WINDOW, STRIDE = 24, 12
DIM, HIDDEN, ATTEND = 12, 8, 8
#: Lengths of character n-grams, and the number of vectors they are hashed to.
GRAMS = {3: 4096, 5: 32_768}
#: Characters of texts, and words met for the first time, that are scored at once.
SOME, SOME_WORDS = 1 << 18, 1 << 13
_EDGE = ".,;:!?\"'()[]{}<>*_-"


def tokens(text: str) -> list[str]:
    return text.lower().split()


def grams(words: Sequence[str], n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of ^word$ one after another, where each word's begin, and how many it has (one at least)."""
    marked = [f"^{w}$".ljust(n, "$") for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(x) for x in marked])
    count = size - n + 1
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    at = np.arange(int(count.sum())) + np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]) - first, count)
    h = np.zeros(len(at), dtype=np.uint64)
    for i in range(n):
        h = (h ^ codes[at + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (mix(h) >> np.uint64(40)).astype(np.int64) % buckets, first, count


def starts(n: int) -> list[int]:
    """First words of the windows that cover n words, each overlapping the next by half or more."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


class Net:
    def __init__(self, vocabulary: list[str], seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        make = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}  # 0: not in the vocabulary
        self.p = {
            "word": make(len(vocabulary) + 1, DIM, scale=0.1), **{f"g{n}": make(k, DIM, scale=0.3) for n, k in GRAMS.items()},
            "w": make(DIM, 6 * HIDDEN, scale=0.4), "b": np.zeros(6 * HIDDEN, dtype=np.float32),
            "uf": make(HIDDEN, 3 * HIDDEN, scale=0.3), "ub": make(HIDDEN, 3 * HIDDEN, scale=0.3),
            "a": make(2 * HIDDEN, ATTEND, scale=0.4), "v": make(ATTEND, scale=0.4),
            "o": make(2 * HIDDEN, scale=0.4), "c": np.zeros(1, dtype=np.float32),
        }

    def own_ids(self, words: Sequence[str]) -> np.ndarray:
        return np.array([self.ids.get(w, 0) for w in words], dtype=np.int64)

    def vectors(self, words: Sequence[str]) -> np.ndarray:
        out = self.p["word"][self.own_ids(words)]
        for n, k in GRAMS.items():
            at, first, count = grams(words, n, k)
            out += np.add.reduceat(self.p[f"g{n}"][at], first, axis=0) / count[:, None].astype(np.float32)
        return out

    def project(self, words: Sequence[str]) -> np.ndarray:
        """What a word adds to the gates of both directions: all that scoring needs of it."""
        return self.vectors(words) @ self.p["w"] + self.p["b"]

    def _direction(self, x: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: list | None) -> np.ndarray:
        n, t, _ = x.shape
        h = np.zeros((n, HIDDEN), dtype=np.float32)
        out = np.empty((t, n, HIDDEN), dtype=np.float32)
        for i in range(t - 1, -1, -1) if back else range(t):
            hu = h @ u
            zr = 0.5 * np.tanh(0.5 * (x[:, i, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])) + 0.5
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            g = np.tanh(x[:, i, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = g + z * (h - g)
            new = np.where(mask[:, i, None], new, h)
            if keep is not None:
                keep.append((i, h, hu, z, r, g))
            h = new
            out[i] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows: x (n, WINDOW, 6 * HIDDEN) projected words, mask where there is a word."""
        tape_f, tape_b = ([], []) if keep is not None else (None, None)
        f = self._direction(x[:, :, : 3 * HIDDEN], mask, self.p["uf"], False, tape_f)
        b = self._direction(x[:, :, 3 * HIDDEN :], mask, self.p["ub"], True, tape_b)
        h = np.concatenate([f, b], axis=2)
        t = np.tanh(h @ self.p["a"])
        s = np.where(mask.T, t @ self.p["v"], -1e9)
        e = np.exp(s - s.max(axis=0))
        e /= e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", e, h)
        if keep is not None:
            keep.update(f=tape_f, b=tape_b, h=h, t=t, e=e, pooled=pooled)
        return pooled @ self.p["o"] + self.p["c"][0]

    def _back_direction(self, tape: list, mask: np.ndarray, u: np.ndarray, dout: np.ndarray, dx: np.ndarray) -> np.ndarray:
        du = np.zeros_like(u)
        dh = np.zeros_like(dout[0])
        for i, h, hu, z, r, g in reversed(tape):
            m = mask[:, i, None]
            d = dh + dout[i]
            dnew, dold = np.where(m, d, 0), np.where(m, 0, d)
            dg = dnew * (1 - z) * (1 - g * g)
            dz = dnew * (h - g) * z * (1 - z)
            dr = dg * hu[:, 2 * HIDDEN :] * r * (1 - r)
            dx[:, i] = np.concatenate([dz, dr, dg], axis=1)
            dhu = np.concatenate([dz, dr, dg * r], axis=1)
            du += h.T @ dhu
            dh = dold + dnew * z + dhu @ u.T
        return du

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        keep: dict = {}
        logit = self.forward(x, mask, keep)
        prob = 1 / (1 + np.exp(-logit))
        d = ((prob - y) * weight / len(y)).astype(np.float32)
        h, t, e = keep["h"], keep["t"], keep["e"]
        g = {"o": keep["pooled"].T @ d, "c": np.array([d.sum()], dtype=np.float32)}
        dpool = d[:, None] * self.p["o"]
        de = np.einsum("nh,tnh->tn", dpool, h)
        ds = e * (de - (e * de).sum(axis=0))
        dt = ds[:, :, None] * self.p["v"] * (1 - t * t)
        g["v"] = np.einsum("tn,tnk->k", ds, t)
        g["a"] = np.einsum("tnh,tnk->hk", h, dt)
        dh = e[:, :, None] * dpool + dt @ self.p["a"].T
        dx = np.empty_like(x)
        g["uf"] = self._back_direction(keep["f"], mask, self.p["uf"], dh[:, :, :HIDDEN], dx[:, :, : 3 * HIDDEN])
        g["ub"] = self._back_direction(keep["b"], mask, self.p["ub"], dh[:, :, HIDDEN:], dx[:, :, 3 * HIDDEN :])
        return g, dx, prob


def train(texts: list[str], labels: list[int], seed: int = 3, rounds: int = 5, batch: int = 192, rate: float = 0.02, vocabulary: int = 8000, drop: float = 0.3) -> Net | None:
    """A net fitted to document labels. In the first round every window has its document's label; then a document is
    what its highest window says, so only that one (of documents of label 0 also the next two) is learned from.

    None if a label is missing.
    """
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    docs = [[w.strip(_EDGE) for w in tokens(t)] for t in texts]
    seen: dict[str, int] = {}
    for ws in docs:
        for w in set(ws):
            seen[w] = seen.get(w, 0) + 1
    net = Net(sorted((w for w, n in seen.items() if n > 2 and len(w) > 1), key=lambda w: (-seen[w], w))[:vocabulary], seed)
    words = [" ", *sorted(seen)]
    at = {w: i for i, w in enumerate(words)}
    own = net.own_ids(words)
    spelled = {n: grams(words, n, k) for n, k in GRAMS.items()}
    windows, of = [], []
    for d, ws in enumerate(docs):
        ids = np.array([at[w] for w in ws], dtype=np.int64)
        for s in starts(len(ids)) if len(ids) else []:
            windows.append(np.pad(ids[s : s + WINDOW], (0, max(0, WINDOW - len(ids[s : s + WINDOW])))))
            of.append(d)
    windows, of = np.array(windows), np.array(of)
    y = np.array(labels, dtype=np.float32)[of]
    dense = [k for k in net.p if k not in ("word", *(f"g{n}" for n in GRAMS))]
    moment = {k: (np.zeros_like(net.p[k]), np.zeros_like(net.p[k])) for k in dense}
    squares = {k: np.full(len(v), 1e-6, dtype=np.float32) for k, v in net.p.items() if k not in dense}
    step = 0

    def scatter(name: str, rows: np.ndarray, g: np.ndarray) -> None:
        """Adagrad on the rows met, one scale a row."""
        order = np.argsort(rows, kind="stable")
        some, first = np.unique(rows[order], return_index=True)
        total = np.add.reduceat(g[order], first, axis=0)
        squares[name][some] += (total * total).mean(axis=1)
        net.p[name][some] -= 3 * rate * total / np.sqrt(squares[name][some])[:, None]

    def learn(index: np.ndarray, weight: np.ndarray) -> None:
        nonlocal step
        order = rng.permutation(len(index))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            w = windows[index[pick]]
            some, inverse = np.unique(w, return_inverse=True)
            known = np.where(rng.random(len(some)) < drop, 0, own[some])
            v = net.p["word"][known]
            met = {}
            for n, (code, first, count) in spelled.items():
                c = count[some]
                begin = np.concatenate([[0], np.cumsum(c)[:-1]])
                met[n] = code[np.arange(int(c.sum())) + np.repeat(first[some] - begin, c)], c
                v = v + np.add.reduceat(net.p[f"g{n}"][met[n][0]], begin, axis=0) / c[:, None].astype(np.float32)
            x = (v @ net.p["w"] + net.p["b"])[inverse.reshape(w.shape)]
            g, dx, _ = net.gradients(x, w > 0, y[index[pick]], weight[pick])
            flat = (dx * (w > 0)[:, :, None]).reshape(-1, dx.shape[2])
            by_word = np.argsort(inverse.ravel(), kind="stable")
            per_word = np.add.reduceat(flat[by_word], np.searchsorted(inverse.ravel()[by_word], np.arange(len(some))), axis=0)
            dv = per_word @ net.p["w"].T
            g["w"], g["b"] = v.T @ per_word, per_word.sum(axis=0)
            step += 1
            for k in dense:
                m, q = moment[k]
                m += 0.1 * (g[k] - m)
                q += 0.01 * (g[k] * g[k] - q)
                net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-7)
            scatter("word", known, dv)
            for n, (code, c) in met.items():
                scatter(f"g{n}", code, np.repeat(dv / c[:, None].astype(np.float32), c, axis=0))

    ones = max(1.0, y.sum())
    learn(np.arange(len(y)), np.where(y > 0, 0.5 * len(y) / ones, 0.5 * len(y) / max(1.0, len(y) - ones)).clip(0.2, 5).astype(np.float32))
    for _ in range(rounds):
        table = net.p["word"][own]
        for n, (code, first, count) in spelled.items():
            table = table + np.add.reduceat(net.p[f"g{n}"][code], first, axis=0) / count[:, None].astype(np.float32)
        table = table @ net.p["w"] + net.p["b"]
        logit = np.concatenate([net.forward(table[windows[i : i + 2048]], windows[i : i + 2048] > 0) for i in range(0, len(windows), 2048)])
        order = np.lexsort((-logit, of))
        rank = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        chosen = order[(rank == 0) | ((rank < 3) & (y[order] == 0))]
        learn(chosen, np.where(y[chosen] > 0, 1, 2).astype(np.float32))
    return net


class Scorer:
    """Scores of whole texts: the highest probability of all their windows; 0 for a text without words. Remembers the
    projections of a bounded number of words; works on SOME characters of texts and SOME_WORDS new words at a time, as what
    is made of them is many times as large."""

    def __init__(self, net: Net, size: int = 50_000) -> None:
        self.net, self.size = net, size
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.table = np.empty((self.size + 20_000, 6 * HIDDEN), dtype=np.float32)  # memory is taken as rows are written
        self.table[0] = 0  # no word

    def meet(self, new: list[str]) -> None:
        base = len(self.known) + 1
        if base + len(new) > len(self.table):
            self.table = np.concatenate([self.table[:base], np.empty((len(new), 6 * HIDDEN), dtype=np.float32)])
        for i in range(0, len(new), SOME_WORDS):
            some = new[i : i + SOME_WORDS]
            self.table[base + i : base + i + len(some)] = self.net.project([w.strip(_EDGE) for w in some])
        self.known.update(zip(new, range(base, base + len(new)), strict=True))
        self.chars += sum(map(len, new))

    def score(self, texts: Sequence[str], chunk: int = 1024) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        part = np.cumsum([len(t) for t in texts]) // SOME
        cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        return np.concatenate([self._score(texts[a:b], chunk) for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True)])

    def _score(self, texts: Sequence[str], chunk: int) -> np.ndarray:
        if len(self.known) > self.size or self.chars > 20_000_000:
            self.reset()
        docs = [tokens(t) for t in texts]
        known = self.known
        new = {w: None for ws in docs for w in ws if w not in known}
        if new:
            self.meet(list(new))
        rows, of = [], []
        out = np.zeros(len(docs))
        for d, ws in enumerate(docs):
            if ws:
                ids = np.array([known[w] for w in ws], dtype=np.int32)
                if len(ids) < WINDOW:
                    ids = np.pad(ids, (0, WINDOW - len(ids)))
                begin = np.array(starts(len(ids)))
                rows.append(ids[begin[:, None] + np.arange(WINDOW)])
                of.append(np.full(len(begin), d))
        if rows:
            windows, of = np.concatenate(rows), np.concatenate(of)
            for i in range(0, len(windows), chunk):
                w = windows[i : i + chunk]
                p = 1 / (1 + np.exp(-self.net.forward(self.table[w], w > 0).astype(np.float64)))
                np.maximum.at(out, of[i : i + chunk], p)
        return out
