"""Byte-level BPE over a whole corpus by speculation and verification.

A pre-token ("word") is first cut greedily into its longest vocabulary entries.  That proposal is right
exactly when every adjacent pair of it could stand side by side in a finished merge, which is tested for all
pairs of all new words at once; only words with a failing pair are merged step by step.

Why the pair test suffices: merging runs in order of rank.  Just before rank m the piece of token ``a`` that
touches its right border is the element of a's right spine (a, its right part, that part's right part, ...)
which is already built while its parent is not; likewise the left spine of ``b``.  The border between a and b
is crossed if and only if some such two pieces merge at a rank m smaller than the rank of the left piece's
parent (equal ranks go left to right, so the parent wins) and not larger than that of the right piece's parent
(there the crossing pair is further left and wins).
"""

from __future__ import annotations

import heapq
import json
from itertools import chain

import numpy as np

NONE = np.int64(1) << 40
#: Words kept per Python worker; beyond it the cache starts anew, so memory stays bounded.
CACHE_WORDS = 400_000
#: Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in the vocabulary file: printable Latin-1 stands for itself, the
    others follow from code point 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_merges(raw: bytes) -> dict:
    """The vocabulary as arrays: bytes of each id, its two parts, and the sorted table of merges."""
    model = json.loads(raw)["model"]
    letters, vocab = _byte_letters(), model["vocab"]
    size = max(vocab.values()) + 1
    pieces: list[bytes] = [b""] * size
    for text, i in vocab.items():
        if all(c in letters for c in text):
            pieces[i] = bytes(letters[c] for c in text)
    rank = np.full(size, -1, np.int64)
    left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    for k, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        i = vocab[a + b]
        if rank[i] < 0:
            rank[i], left[i], right[i] = k, vocab[a], vocab[b]
    has = np.flatnonzero(rank >= 0)
    keys = left[has] * size + right[has]
    order = np.argsort(keys)
    return {"pieces": pieces, "rank": rank, "left": left, "right": right, "keys": keys[order], "merged": has[order]}


class Encoder:
    """Encodes texts; keeps the ids of words it has met."""

    def __init__(self, tables: dict, pattern: str = PATTERN, cache_words: int = CACHE_WORDS):
        import regex

        self.find = regex.compile(pattern).findall
        self.pieces, self.rank = tables["pieces"], tables["rank"]
        self.left, self.right, self.keys, self.merged = (tables[k] for k in ("left", "right", "keys", "merged"))
        self.size = len(self.pieces)
        self.ids = {p: i for i, p in enumerate(self.pieces) if p}
        self.longest = max(map(len, self.pieces))
        self.base = np.array([self.ids[bytes([b])] for b in range(256)])
        self.cache_words = cache_words
        self._reset()

    def _reset(self) -> None:
        self.word: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0
        self.pairs_known, self.pairs_ok = np.zeros(0, np.int64), np.zeros(0, bool)

    def greedy(self, word: bytes) -> list[int]:
        out, at, n, ids = [], 0, len(word), self.ids
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                i = ids.get(word[at:end])
                if i is not None:
                    out.append(i)
                    at = end
                    break
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merging step by step with a heap of candidate pairs; n log n in the length of the word."""
        part = [int(x) for x in self.base[np.frombuffer(word, np.uint8)]]
        nxt, prv = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < len(part):
                m = self.ids.get(self.pieces[part[i]] + self.pieces[part[j]])
                if m is not None and self.rank[m] >= 0:
                    heapq.heappush(heap, (int(self.rank[m]), i, part[i], part[j], m))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = nxt[i]
            if part[i] != a or j >= len(part) or part[j] != b:
                continue
            part[i], part[j], nxt[i] = m, -1, nxt[j]
            if nxt[j] < len(part):
                prv[nxt[j]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [p for p in part if p >= 0]

    def spine(self, tokens: np.ndarray, side: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The pieces down one side of each token, and the rank at which each disappears into its parent."""
        at, gone, out, until = tokens.copy(), np.full(len(tokens), NONE), [], []
        while (at >= 0).any():
            out.append(at)
            until.append(gone)
            gone = np.where(at >= 0, self.rank[at], -1)
            at = np.where(at >= 0, side[at], -1)
        return out, until

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        pa, ua = self.spine(a, self.right)
        pb, ub = self.spine(b, self.left)
        for x, ux in zip(pa, ua):
            for y, uy in zip(pb, ub):
                both = (x >= 0) & (y >= 0)
                key = np.where(both, x * self.size + y, -1)
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                m = np.where(both & (self.keys[k] == key), self.rank[self.merged[k]], NONE)
                ok &= ~((m < ux) & (m <= uy) & (m < NONE))
        return ok

    def learn(self, words: list[str]) -> None:
        """Ids of new words: propose all, test all pairs at once, merge the failing ones."""
        if len(self.word) + len(words) > self.cache_words and self.word:
            raise OverflowError
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ids = [[i] if (i := self.ids.get(r)) is not None else self.greedy(r) for r in raw]
        long = [k for k, x in enumerate(ids) if len(x) > 1]
        if long:
            lens = np.fromiter((len(ids[k]) for k in long), np.int64, len(long))
            flat = np.fromiter(chain.from_iterable(ids[k] for k in long), np.int64, int(lens.sum()))
            owner = np.repeat(np.arange(len(long)), lens)
            inner = owner[1:] == owner[:-1]
            pair = (flat[:-1] * self.size + flat[1:])[inner]
            fresh = np.setdiff1d(pair, self.pairs_known)
            if len(fresh):
                known = np.concatenate([self.pairs_known, fresh])
                good = np.concatenate([self.pairs_ok, self.compatible(fresh // self.size, fresh % self.size)])
                order = np.argsort(known)
                self.pairs_known, self.pairs_ok = known[order], good[order]
            bad = owner[:-1][inner][~self.pairs_ok[np.searchsorted(self.pairs_known, pair)]]
            for k in set(bad.tolist()):
                ids[long[k]] = self.exact(raw[long[k]])
        new, first = sum(map(len, ids)), len(self.word)
        while self.used + new > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
        while first + len(words) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.start, self.count))
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat[self.used : self.used + new] = np.fromiter(chain.from_iterable(ids), np.int32, new)
        self.start[first : first + len(words)] = self.used + np.cumsum(lens) - lens
        self.count[first : first + len(words)] = lens
        self.word.update(zip(words, range(first, first + len(words))))
        self.used += new

    def index(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For a batch of texts: the words' numbers, flat, and how many each text has."""
        found = [self.find(t) if t else [] for t in texts]
        try:
            new = set().union(*found).difference(self.word)
            if new:
                self.learn(sorted(new))
        except OverflowError:
            self._reset()
            if new := sorted(set().union(*found)):
                self.learn(new)
        many = np.fromiter(map(len, found), np.int64, len(found))
        get = self.word.__getitem__
        return np.fromiter(map(get, chain.from_iterable(found)), np.int64, int(many.sum())), many

    def sizes(self, texts: list[str | None]) -> np.ndarray:
        words, many = self.index(texts)
        ends = np.concatenate([[0], np.cumsum(self.count[words])])
        at = np.cumsum(many)
        return ends[at] - ends[at - many]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the offsets of each text."""
        words, many = self.index(texts)
        lens = self.count[words]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(self.start[words] - (ends - lens), lens)
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(many)])]
        return self.flat[take], offsets


_encoders: dict[int, Encoder] = {}


def encoder(key: int, tables) -> Encoder:
    """One encoder per Python worker and vocabulary; it outlives the task."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tables.value)
    return _encoders[key]
