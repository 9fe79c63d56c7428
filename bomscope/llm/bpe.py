"""Byte-level BPE by monoid tree reduction, and a cached whole-text encoder over it.

An encoding is a monoid: encode(x + y) depends on encode(x) and encode(y) and a window at the seam alone. A text is cut
into matches of the tokenizer's pattern; a match's bytes are encoded by halves, recursively, and neighbours are joined:
the last w tokens of the left and the first w of the right are re-encoded, and w doubles until the tokens outside
provably stay. The proof is the pair property of ranked merges: a sequence is the encoding of its bytes if and only if
every adjacent pair of it is the encoding of its own bytes; so only the two pairs at the window's edges need a check.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Sequence

import public_tokenizers
import regex

#: Blanks that start a match, and a blank that doesn't.
_BLANK, _RUN = re.compile(r" (?=\S)"), re.compile(r" (?=\s|\Z)")


#: The longest piece of a match that is remembered, in bytes; most pieces of a text's rare words are shorter than those.
KEPT = 8


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes, from a rank file or from a byte-level tokenizer's JSON file."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # Such files write each byte as a printable character: itself if it is one, else the next free one from U+0100 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = (c for c in range(256, 512))
    byte_of = {chr(b if b in shown else next(free)): b for b in range(256)}
    special = {t["id"] for t in spec["added_tokens"]}
    return {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if i not in special}


class TreeBPE:
    """Encoder and decoder over given ranks. memo_size bounds each of the memory's tables (entries); a full one is emptied."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, memo_size: int = 350_000) -> None:
        self.ranks = ranks
        self.bytes_of: dict[int, bytes] = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.size = memo_size
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.seams: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.longest = max(map(len, ranks))

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The merges themselves, lowest rank first, leftmost on ties; for the short windows at seams."""
        get, none = self.ranks.get, len(self.ranks) + (1 << 32)
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while rank:
            low = min(rank)
            if low == none:
                break
            at = rank.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del rank[at]
            if at:
                rank[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(rank):
                rank[at] = get(parts[at] + parts[at + 1], none)
        return tuple(map(self.ranks.__getitem__, parts))

    def window(self, data: bytes) -> tuple[int, ...]:
        got = self.seams.get(data)
        if got is None:
            if len(self.seams) >= self.size:
                self.seams.clear()
            got = self.seams[data] = self.merge(data)
        return got

    def holds(self, a: int, b: int) -> bool:
        """Is the pair the encoding of its own bytes?"""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= self.size:
                self.pairs.clear()
            got = self.pairs[a, b] = self.window(self.bytes_of[a] + self.bytes_of[b]) == (a, b)
        return got

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """encode(x + y) from encode(x) and encode(y); a seam that holds needs no window."""
        if not left or not right or self.holds(left[-1], right[0]):
            return left + right
        w = 1
        while True:
            i, j = max(0, len(left) - w), min(w, len(right))
            mid = self.window(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            if (i == 0 or self.holds(left[i - 1], mid[0])) and (j == len(right) or self.holds(mid[-1], right[j])):
                return left[:i] + mid + right[j:]
            w *= 2

    def whole(self, data: bytes) -> int | None:
        """The token that has these bytes and that their merges lead to; a vocabulary may hold others."""
        own = self.ranks.get(data)
        return own if own is not None and (len(data) == 1 or self.merge(data) == (own,)) else None

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """One match of the pattern, by halves; a half that is a token is done. Short pieces are remembered."""
        if not data:
            return ()
        pieces = self.pieces
        got = pieces.get(data)
        if got is not None:
            return got
        own = self.whole(data) if len(data) <= self.longest else None
        if own is not None:
            got = (own,)
        else:
            half = len(data) // 2
            x, y = data[:half], data[half:]
            left, right = pieces.get(x) or self.encode_bytes(x), pieces.get(y) or self.encode_bytes(y)
            got = left + right if self.pairs.get((left[-1], right[0])) else self.join(left, right)
        if len(data) <= KEPT:
            if len(pieces) >= self.size:
                pieces.clear()
            pieces[data] = got
        return got

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, each match of the pattern by itself; a match that is a token needs no merging."""
        out: list[int] = []
        ranks = self.ranks
        for m in self.pattern.findall(text):
            data = m.encode()
            own = ranks.get(data)
            if own is None:
                out += self.encode_bytes(data)
            else:
                out.append(own)
        return out

    def decode(self, ids: Sequence[int]) -> bytes:
        """Bytes of a sequence, halves concatenated up the tree."""
        if len(ids) > 4096:
            return self.decode(ids[: len(ids) // 2]) + self.decode(ids[len(ids) // 2 :])
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Memo(dict):
    """What make() gives for a blank and a word, of a bounded number of words: when it is full, it keeps those met again
    while the next fill."""

    def __init__(self, make: Callable[[str], object], size: int) -> None:
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, word: str) -> object:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        got = self.old.get(word)
        if got is None:
            got = self.make(" " + word)
        self[word] = got
        return got


def cut(text: str) -> tuple[str, list[str]]:
    """A text's start and the words that follow, each after the blank it lost.

    A blank before a character that isn't white space always starts a match of the pattern, so what stands between two
    such blanks is encoded alike anywhere.
    """
    first, *rest = _BLANK.split(text) if _RUN.search(text) else text.split(" ")
    return first, rest


class ByWord:
    """Whole texts by way of their words: ids, the ids as decimal text, and the bytes that the ids decode to."""

    def __init__(self, bpe: TreeBPE, size: int = 350_000) -> None:
        self.bpe = bpe
        self.known = Memo(bpe.encode, size)
        self.said = Memo(self.say, size)

    def say(self, text: str) -> tuple[str, bytes]:
        own = self.bpe.encode(text)
        return ",".join(map(str, own)), self.bpe.decode(own)

    def ids(self, text: str) -> list[int]:
        first, rest = cut(text)
        out = self.bpe.encode(first)
        for x in map(self.known.__getitem__, rest):
            out += x
        return out

    def digests(self, text: str) -> tuple[str, bytes]:
        """The ids in decimal with commas, and what they decode to, word by word up the tree."""
        first, rest = cut(text)
        got = [self.say(first), *map(self.said.__getitem__, rest)]
        return ",".join([x[0] for x in got if x[0]]), b"".join([x[1] for x in got])
